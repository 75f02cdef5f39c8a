"""Registered queries of what takes several steps: vocabulary correction, whole analyses, stored results, reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions import text as tx
from turnwise.operators import calls as ca
from turnwise.operators import scoring as sc
from turnwise.operators import segments as seg
from turnwise.operators import vocabulary as vo
from turnwise.operators import whole as wh
from turnwise.plans.analysis import RULE_TYPES, RULES
from turnwise.plans.registry import CHUNKS, ORACLES, PII, QUERIES, SEG, query
from turnwise.sources import files as fi
from turnwise.sources import fixtures as fx
from turnwise.sources.scratch import scratch_folder
from turnwise.sources.store import AnalysisStore, analysis_rows
from turnwise.streaming import alerts
from turnwise.streaming import endpoints as ep


def domain_snap(spark, d):
    """Documents with their words brought to the nations' names, from 0.80 on, and to the long words of the benchmark texts, from 0.93 on."""
    words = fx.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(vo.WORD), F.lit(0))).alias("term")).where(F.char_length("term") >= 7)
    terms = fx.table(spark, d, "nation").select(F.lower("n_name").alias("term"), F.lit(True).alias("custom")).unionByName(words.withColumn("custom", F.lit(False)))
    terms = terms.groupBy("term").agg(F.max("custom").alias("custom")).withColumn("place", F.row_number().over(Window.orderBy(~F.col("custom"), "term")))  # a dictionary
    docs = fx.table(spark, d, "documents").select("doc_id", "text", F.regexp_extract_all("text", F.lit(vo.WORD), F.lit(0)).alias("before"))
    fixed = vo.domain_correct(docs, terms)
    after = F.regexp_extract_all("text", F.lit(vo.WORD), F.lit(0))
    changed = F.size(F.filter(F.arrays_zip(F.col("before").alias("a"), after.alias("b")), lambda p: ~p["a"].eqNullSafe(p["b"])))
    return fixed.select("doc_id", F.size("before").cast("long").alias("n_words"), changed.cast("long").alias("n_changed"), "text")


#: Likeness is no SQL function: tests/test_vocabulary.py holds it against loops over all pairs.
QUERIES["domain_snap"] = domain_snap


RUN = "[0-9](?:[ .-]?[0-9]){9,31}"
#: Segments that read a number aloud: that of the document whose id is 8 * conversation_id + segment_index, if it has one.
CALLS_SQL = fx.SEGMENTS_SQL.replace("\nsegments AS (", "\nsegments0 AS (") + f""",
shown AS (WITH {PII.replace(f"unnest(regexp_extract_all(text, '{RUN}'))", f"regexp_extract(text, '{RUN}')")} SELECT doc_id, kind, CASE kind WHEN 'pan' THEN '[KART NO GİZLENDİ] **** ' || right(p.n, 4) WHEN 'tckn' THEN '[TCKN GİZLENDİ] *********' || right(p.n, 2) WHEN 'phone' THEN '[TELEFON GİZLENDİ] *** ' || right(p.n, 4) ELSE regexp_extract(text, '{RUN}') END AS run FROM p JOIN documents USING (doc_id) WHERE n <> ''),
segments AS (SELECT s.* REPLACE (s.text || coalesce(' # ' || run, '') AS text), kind FROM segments0 s LEFT JOIN shown ON doc_id = 8 * conversation_id + segment_index)"""
CALLS = f"WITH {CALLS_SQL}"


def _of_calls(name: str) -> str:
    """The twin of another query over these calls."""
    return ORACLES[name].replace(fx.SEGMENTS_SQL, CALLS_SQL)


#: Small letters of a dotted capital I are two characters in the JVM.
DOTTED = CHUNKS.replace("lower(text), '@word'", "lower(replace(text, 'İ', 'i' || chr(775))), '@word'")
NAMES_SQL = ORACLES["competitors"].replace("FROM documents", "FROM (SELECT conversation_id AS doc_id, text FROM segments)")
TOPIC = "CASE lower({0}) WHEN 'the' THEN 't1' WHEN 'of the' THEN 't1' WHEN 'die' THEN 't2' WHEN 'que' THEN 't3' WHEN 'is' THEN 't3' END"
ANALYSIS_SQL = f"""{CALLS}, c AS ({CALLS}, {DOTTED} SELECT * FROM c), names AS (SELECT doc_id AS conversation_id, name FROM ({NAMES_SQL})),
h AS (SELECT conversation_id, max(sector) AS sector, max(agent_id) AS agent_id, max(end_ms) AS duration_ms, count(*) AS n_lines, string_agg(text, ' ' ORDER BY segment_index) AS transcript, 0 AS iban,
  count(*) FILTER (kind = 'pan') AS pan, count(*) FILTER (kind = 'tckn') AS tckn, count(*) FILTER (kind = 'phone') AS phone, count(DISTINCT speaker) FILTER (speaker IN ('SPEAKER_00', 'SPEAKER_01')) = 2 AND conversation_id % 3 < 2 AS reliable FROM segments GROUP BY conversation_id),
q AS (SELECT conversation_id, 0.65::DOUBLE * max(risk) + 0.35::DOUBLE * sum(risk * weight) / sum(weight) AS r, count(*) AS chunks FROM c GROUP BY 1),
z AS (SELECT q.*, least(1.0::DOUBLE, r + CASE WHEN r > 0.3 THEN least(0.2::DOUBLE, 0.1::DOUBLE * coalesce(named, 0)) ELSE 0 END) AS x FROM q LEFT JOIN (SELECT conversation_id, count(*) AS named FROM names GROUP BY 1) USING (conversation_id)),
hit AS ({_of_calls('keyword_engine')}),
tp AS (SELECT conversation_id, array_to_string(list_sort(list(DISTINCT t)), ',') AS topics FROM (SELECT conversation_id, coalesce({TOPIC.format('keyword')}, {TOPIC.format('matched_text')}) AS t FROM hit) WHERE t IS NOT NULL GROUP BY 1)
SELECT h.*, g.confidence AS asr_confidence, g.passes AS quality_gate, s.score AS empathy, s.wpm AS agent_wpm, s.interruptions AS customer_cuts, round(coalesce(x, 0), 6) AS churn_risk, coalesce(x >= 0.75, false) AS high_risk,
  CASE WHEN NOT reliable OR chunks IS NULL THEN 'low' WHEN chunks >= 4 THEN 'high' WHEN chunks >= 2 THEN 'medium' ELSE 'low' END AS churn_confidence, t.rate AS toxicity_rate, t.terms AS toxic_terms, t.is_clean, d.fcr, d.ces, d.adherence, d.status AS resolution, u.summary,
  coalesce(topics, '') AS topics, coalesce((SELECT array_to_string(list_sort(list(name)), ',') FROM names n WHERE n.conversation_id = h.conversation_id), '') AS competitors,
  (SELECT count(*) FROM hit n WHERE n.conversation_id = h.conversation_id) AS n_hits, (SELECT count(*) FROM ({_of_calls('compliance_violations')}) n WHERE n.conversation_id = h.conversation_id) AS n_violations, (SELECT count(*) FROM ({_of_calls('crosstalk_adjacent')}) n WHERE n.conversation_id = h.conversation_id) AS n_crosstalk
FROM h JOIN ({_of_calls('quality_gate')}) g USING (conversation_id) JOIN ({_of_calls('soft_skills').replace('SPEAKER_01', 'SPEAKER_00').replace("WHEN 'user' THEN 'SPEAKER_00'", "WHEN 'user' THEN 'SPEAKER_01'")}) s USING (conversation_id) LEFT JOIN z USING (conversation_id) JOIN ({_of_calls('toxicity')}) t USING (conversation_id)
JOIN ({_of_calls('discourse_metrics').replace('FROM segments WHERE segment_index % 3 = 2 GROUP BY 1', f"FROM ({_of_calls('interruptions')}) GROUP BY 1")}) d USING (conversation_id)
JOIN (SELECT doc_id AS conversation_id, summary FROM ({ORACLES['executive_summary'].replace('FROM documents', "FROM (SELECT conversation_id AS doc_id, string_agg(text, ' ' ORDER BY segment_index) AS text FROM segments GROUP BY 1)")})) u USING (conversation_id) LEFT JOIN tp USING (conversation_id)"""


def _calls(spark, d):
    numbers = fx.table(spark, d, "documents").select((F.col("doc_id")).alias("_id"), F.regexp_extract("text", RUN, 0).alias("_run")).where("_run <> ''")
    lines = fx.segments(spark, d).withColumn("_id", F.expr("8 * conversation_id + segment_index")).join(numbers, "_id", "left")
    method = F.expr("element_at(array('stereo', 'neural', 'text'), cast(conversation_id % 3 AS int) + 1)")
    return lines.withColumn("text", F.when(F.col("_run").isNull(), F.col("text")).otherwise(F.concat_ws(" # ", "text", "_run"))).withColumn("method", method).drop("_id", "_run")


def _call_rules(spark) -> wh.CallRules:
    topics = spark.createDataFrame([("t1", 1, ["the", "of the"]), ("t2", 2, ["die"]), ("t3", 3, ["que", "is"])], "topic_id string, place int, terms array<string>")
    return wh.CallRules(
        rules=spark.createDataFrame(RULES, RULE_TYPES),
        topics=topics,
        synonyms=spark.createDataFrame([("is", ["it is"])], "keyword string, synonyms array<string>"),
        skills={"listening": ["the", "und "], "compassion": ["que"], "solution": ["of the", "is"], "defensive": ["die "]},
        fast=140,
        patterns=[("promise", "of the", None), ("pressure", "que ", None), ("rate", "the ", "banking")],
        negators=["no", "is"],
        toxic=["the ", "die ", "que", "is"],
        shields=["and"],
        discourse={"positive": [" the "], "negative": [" que ", "und "], "effort": ["of the"], "greeting": ["is"], "notice": ["die "], "closing": ["que "]},
        agent_phrases=["of the"],
        churn_words=["the", "die", "que", "und", "is"],
        anchors=["the"],
        block=2,
        rivals=["there", "the", "which"],
        own_names=["three"],
    )


def _analysed(spark, d, output):
    return wh.analyze_calls(_calls(spark, d), _call_rules(spark), scratch_folder(spark, "calls"), (output,))[output]


@query(ANALYSIS_SQL)
def call_analysis(spark, d):
    """What an analysis finds about each call, in one row."""
    return _analysed(spark, d, "call_analysis")


@query(_of_calls("keyword_engine"))
def call_hits(spark, d):
    return _analysed(spark, d, "hits").drop("context")


@query(f"{CALLS} SELECT v.*, start_ms, end_ms, text FROM ({_of_calls('compliance_violations')}) v JOIN segments USING (conversation_id, segment_index)")
def call_violations(spark, d):
    return _analysed(spark, d, "violations")


@query(_of_calls("crosstalk_adjacent"))
def call_events(spark, d):
    return _analysed(spark, d, "events")


@query(f"""{CALLS}, k AS (SELECT conversation_id, count(*) AS n_hits, array_to_string(list_sort(list(DISTINCT sha256(conversation_id || ':' || segment_index))), ',') AS hit_lines FROM ({_of_calls('keyword_engine')}) GROUP BY 1)
SELECT CAST(conversation_id AS VARCHAR) AS conversation_id, CASE WHEN conversation_id % 3 = 2 THEN 'processing' ELSE 'completed' END AS status, CASE WHEN conversation_id % 3 < 2 THEN max(end_ms) / 1000 END AS duration_sec, CASE WHEN conversation_id % 3 < 2 THEN count(*) ELSE 0 END AS n_segments,
  CASE WHEN conversation_id % 3 < 2 THEN coalesce(max(n_hits), 0) ELSE 0 END AS n_hits, CASE WHEN conversation_id % 3 < 2 THEN coalesce(max(hit_lines), '') ELSE '' END AS hit_lines FROM segments LEFT JOIN k USING (conversation_id) GROUP BY conversation_id""")
def stored_analysis(spark, d):
    """Calls as the store has them: all opened, two thirds analysed, a third of them twice; and the keys of the lines that have hits."""
    found = wh.analyze_calls(_calls(spark, d), _call_rules(spark), scratch_folder(spark, "calls"), ("hits",))
    lines = found["lines"]
    heads = lines.groupBy("conversation_id").agg(F.max("agent_id").alias("agent_id"), F.max("sector").alias("sector"), (F.max("end_ms") / 1000.0).alias("duration_sec"), F.lit(None).cast("string").alias("full_transcript"), F.lit(0.0).alias("asr_confidence"), F.lit(True).alias("quality_gate_passed"), F.lit("{}").alias("metadata_json"))
    store = AnalysisStore(spark, scratch_folder(spark, "store"))
    store.open_calls("open", heads.select(F.col("conversation_id").cast("string").alias("conversation_id"), "agent_id"))
    for commit, part in (("one", "conversation_id % 3 < 2"), ("two", "conversation_id % 3 = 1")):
        store.write(commit, analysis_rows(heads.where(part), lines.where(part), found["hits"].where(part)), update=True)
    n_lines = store.read("segments").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_segments"))
    n_hits = store.read("hits").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_hits"), F.array_join(F.array_sort(F.collect_set("segment_id")), ",").alias("hit_lines"))
    rows = store.read("conversations").join(n_lines, "conversation_id", "left").join(n_hits, "conversation_id", "left").fillna(0, ["n_segments", "n_hits"]).fillna("", ["hit_lines"])
    return rows.select("conversation_id", "status", "duration_sec", "n_segments", "n_hits", "hit_lines")


@query(r"""WITH s AS (SELECT doc_id, unnest(x) AS text, unnest(range(len(x))) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '[.?!]') AS x FROM documents)), d AS (SELECT 100000 * doc_id + pos AS doc_id, list_filter(regexp_extract_all(lower(text), '@word'), lambda t: t NOT IN ('the', 'of')) AS w FROM s), b AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '@word'), lambda t: t NOT IN ('the', 'of')) AS w FROM benchmark),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d WHERE len(w) >= 5), m AS (SELECT doc_id, item_id AS prompt_id, n AS words, count(*) AS matched FROM u JOIN (SELECT item_id, unnest(list_distinct(w)) AS t FROM b) USING (t) GROUP BY ALL)
SELECT * FROM m WHERE matched >= 5 AND matched >= 0.6::DOUBLE * words""")
def prompt_overlap(spark, d):
    """Sentences of documents most of whose words are a benchmark text's."""
    sentences = fx.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "[.?!]", -1)).alias("pos", "text")).selectExpr("100000 * doc_id + pos AS doc_id", "text")
    return ca.prompt_overlap(sentences, fx.table(spark, d, "benchmark").select(F.col("item_id").alias("prompt_id"), "text"), ["the", "of"])


WORDS_SQL = "w AS (SELECT conversation_id, segment_index, word, speaker, start_ms + 400 * (word - 1) AS w_start, start_ms + 400 * word - 50 AS w_end FROM (SELECT *, unnest(range(1, n_words + 1)) AS word FROM segments))"


def _words(spark, d):
    words = fx.segments(spark, d).where("n_words > 0").select("conversation_id", "segment_index", "speaker", "start_ms", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_words"))).alias("word"))
    return words.withColumn("w_start", F.expr("start_ms + 400 * (word - 1)")).withColumn("w_end", F.expr("start_ms + 400 * word - 50")).drop("start_ms")


@query(f"""WITH {fx.SEGMENTS_SQL}, {fx.TURNS_SQL}, {WORDS_SQL}, o AS (SELECT w.*, turn_index, turn_speaker, 2 * t_start <= w_start + w_end AND w_start + w_end < 2 * t_end AS mid FROM w JOIN turns t ON t.conversation_id = w.conversation_id AND t_start < w_end AND t_end > w_start AND t_end > t_start),
f AS (SELECT conversation_id, segment_index, word, arg_min(turn_speaker, turn_index) FILTER (mid) AS turn_speaker, count(*) FILTER (mid) AS n FROM o GROUP BY ALL),
x AS (SELECT w.*, f.turn_speaker, coalesce(n, 0) AS n FROM w LEFT JOIN f USING (conversation_id, segment_index, word)),
c AS (SELECT x.conversation_id, x.segment_index, x.word, x.turn_speaker, x.n > 1 OR count(o.word) FILTER (o.turn_speaker <> coalesce(x.turn_speaker, x.speaker)) > 0 AS crosstalk FROM x LEFT JOIN o USING (conversation_id, segment_index, word) GROUP BY ALL)
SELECT conversation_id, segment_index, word, turn_speaker, crosstalk FROM c""".replace("GROUP BY ALL)\nSELECT conv", "GROUP BY x.conversation_id, x.segment_index, x.word, x.turn_speaker, x.n)\nSELECT conv"))
def words_in_turns(spark, d):
    """Each word's turn, and whether another speaker's turn touches it."""
    return seg.words_in_turns(_words(spark, d), fx.turns(spark, d)).select("conversation_id", "segment_index", "word", "turn_speaker", "crosstalk")


def live_partials(spark, d):
    """Partial and final utterances of every call's words, 400 ms each, every seventh one silent."""
    frames = _frames_of_words(spark, d)
    return ep.utterances(frames)


def _frames_of_words(spark, d):
    words = fx.segments(spark, d).where("n_words > 0").selectExpr("cast(conversation_id AS string) AS session_id", "start_ms", "posexplode(filter(split(text, '[ \\t\\r\\n]+'), x -> x <> '')) AS (i, text)")
    return words.selectExpr("session_id", "start_ms + 400 * i AS start", "start_ms + 400 * i + 400 AS end", "if(i % 7 in (5, 6), '', text) AS text")


def alert_history(spark, d):
    """What the alert rules of every keyword fire as the hits come in, in batches of five days."""
    hits, folder = fx.hits(spark, d).select("keyword", "conversation_id", "created_at"), scratch_folder(spark, "alerts")
    rules = hits.select("keyword").distinct().selectExpr("concat('rule-', keyword) AS rule_id", "keyword", "if(length(keyword) % 2 = 0, 7, 1) AS days", "-20.0D AS threshold_pct", "5 AS min_count", "60 * 24 * length(keyword) AS cooldown_min", "keyword <> 'error' AS is_active", "cast(null AS timestamp) AS last_triggered")
    edge = hits.agg(F.min("created_at").cast("date").alias("lo"), F.datediff(F.max("created_at"), F.min("created_at")).alias("n")).first()
    for number in range((edge["n"] or 0) // 5 + 1):
        batch = hits.where(F.floor(F.datediff("created_at", F.lit(edge["lo"])) / 5) == number)
        alerts.evaluate_batch(batch, number, rules, folder)
    return alerts.alert_events(spark, folder).select("batch", "rule_id", "keyword", "title", "summary", "severity", "pct_change", "fired_at")


#: Folds over what was heard and fired before: tests/test_live.py holds them against plain loops; the twin of live_partials is in twins.py.
QUERIES |= {f.__name__: f for f in (live_partials, alert_history)}


class HashModel:
    """A stand-in for a trained model: a score for each label that a hash of label and text gives."""

    def __init__(self, labels: list[str]):
        self.labels = labels

    def predict(self, texts: list[str]) -> list[list[float]]:
        from hashlib import md5

        return [[int(md5(f"{label}|{t}".encode()).hexdigest()[:8], 16) / 2**32 for label in self.labels] for t in texts]


def _hashed(label: str, text: str = "text") -> str:
    return f"CAST('0x' || substr(md5('{label}|' || {text}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


PATTERNS = [("promise", "of the", None), ("pressure", "que ", None), ("rate", "the ", "banking")]


@query(f"""{SEG}, v AS ({ORACLES['compliance_violations']}), c AS (SELECT conversation_id, segment_index, substr(text, 1, 400) AS text FROM segments s WHERE speaker = 'SPEAKER_00' AND n_words > 5 AND (contains(lower(text), 'an') OR contains(lower(text), 'un'))
  AND len(list_intersect(regexp_extract_all(lower(text), '@word'), ['no', 'is'])) = 0 AND NOT EXISTS (SELECT 1 FROM v WHERE v.conversation_id = s.conversation_id AND v.segment_index = s.segment_index)),
k AS (SELECT conversation_id, segment_index, CASE WHEN {_hashed('misleading promise')} > 0.8::DOUBLE THEN 'misleading promise' WHEN {_hashed('asking for password')} > 0.85::DOUBLE THEN 'asking for password' END AS violation FROM c)
SELECT *, CASE violation WHEN 'misleading promise' THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM k WHERE violation IS NOT NULL""")
def scored_violations(spark, d):
    """Violations that a model sees in the agents' lines that no pattern flags."""
    lines = sc.compliance_candidates(fx.segments(spark, d), "SPEAKER_00", PATTERNS, ["no", "is"], ["an", "un"])
    labels = [sc.PROMISE[0], sc.PASSWORD[0], "neutral conversation"]
    return sc.scored_violations(lines, sc.score_with(lines, sc.KEYS, lambda: HashModel(labels)))


@query(f"""{SEG}, {CHUNKS.split("g AS (SELECT conversation_id, chunk")[0]}
b AS (SELECT conversation_id, chunk, count(*) AS n, max(place) AS place, max(final) AS final, avg(floor(n_words / greatest(0.5, dur_ms / 1000.0) * 60)) AS wpm, string_agg(text, ' ' ORDER BY segment_index) AS text FROM k GROUP BY 1, 2),
w AS (SELECT *, 1 + 0.5::DOUBLE * place / greatest(1, final) AS weight, contains(lower(text), 'und ') OR list_contains(regexp_extract_all(lower(text), '@word'), 'there') AS anchored FROM b WHERE n = 2 OR place = final),
f AS (SELECT *, least(1.0::DOUBLE, ({_hashed('canceling service')} + {_hashed('switching to competitor')}) * CASE WHEN wpm > 190 THEN 1.4::DOUBLE WHEN wpm > 160 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * weight) AS raw FROM w)
SELECT conversation_id, chunk, round(wpm, 6) AS wpm, round(weight, 6) AS weight, round(CASE WHEN NOT anchored AND raw < 0.85 THEN raw * 0.1::DOUBLE ELSE raw END, 6) AS risk FROM f""")
def scored_churn(spark, d):
    """Risk of each block of a customer's lines by a model's scores."""
    blocks = sc.churn_blocks(fx.segments(spark, d), "SPEAKER_01", ["of the"], ["und "], ["there"], 2)
    found = sc.scored_churn(blocks, sc.score_with(blocks, ["conversation_id", "chunk"], lambda: HashModel(sc.LEAVING)))
    return found.select("conversation_id", "chunk", *[F.round(c, 6).alias(c) for c in ("wpm", "weight", "risk")])


EXCERPT = "CASE WHEN length(text) > 1024 THEN substr(text, 1, 512) || ' [SEP] ' || right(text, 512) ELSE text END"
NEGATIVE_SQL = f"""n AS (SELECT doc_id, text, trim(coalesce(text, '')) = '' AS blank, {_hashed('positive', EXCERPT)} AS p, {_hashed('negative', EXCERPT)} AS n FROM documents)"""


@query(f"WITH {NEGATIVE_SQL} SELECT doc_id, round(CASE WHEN blank THEN 0 ELSE n END, 6) AS negative, CASE WHEN blank THEN 'unknown' WHEN n > 0.7::DOUBLE AND n > p THEN 'high' WHEN n > 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS band FROM n")
def negativity(spark, d):
    """How negative a model finds each document."""
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    return sc.negativity(docs, "doc_id", lambda: HashModel(["positive", "negative"])).withColumn("negative", F.round("negative", 6))


@query(f"""WITH {NEGATIVE_SQL}, w AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN n END AS s, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '@word'), lambda t: t IN ('que', 'die'))) AS hits, len(regexp_extract_all(lower(coalesce(text, '')), '@word')) AS words FROM n),
v AS (SELECT doc_id, hits, CASE WHEN s IS NULL THEN CASE WHEN hits > 0 THEN least(0.95::DOUBLE, 0.12::DOUBLE * hits + 2.0::DOUBLE * hits / words) ELSE 0 END WHEN hits > 0 THEN greatest(s, least(0.99::DOUBLE, 0.45::DOUBLE + 0.05::DOUBLE * hits)) ELSE s END AS score FROM w)
SELECT doc_id, hits, round(score, 6) AS score, CASE WHEN score > 0.7::DOUBLE THEN 'high' WHEN score > 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS band FROM v""")
def toxicity_blend(spark, d):
    """Toxicity of each document by a model's score, which a third of them lack, and listed words."""
    docs = fx.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scored = docs.where("doc_id % 3 > 0").select("doc_id", sc.model_excerpt(F.col("text")).alias("text"))
    scores = sc.score_with(scored, ["doc_id"], lambda: HashModel(["negative"])).select("doc_id", F.col("score").alias("s"))
    words = docs.select("doc_id", tx.tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("words"), F.size(F.filter("w", lambda t: t.isin("que", "die"))).cast("long").alias("hits"))
    found = words.join(scores, "doc_id", "left").select("doc_id", "hits", sc.blended(F.col("s"), F.col("hits"), F.col("words")).alias("b"))
    return found.select("doc_id", "hits", F.round("b.score", 6).alias("score"), "b.band")


REPORT = """r AS (SELECT 'call_' || conv_id AS recording, ['telecom', 'banking', 'omni', 'insurance'][conv_id % 4 + 1] AS sector, turn, (conv_id * 7 + turn) % 50 / 10 AS elapsed_s, CAST((conv_id * 3 + turn) % 100 AS DOUBLE) AS confidence, CAST((conv_id + turn * 11) % 100 AS DOUBLE) AS quality,
  (conv_id + turn) % 2 = 0 AS passes, turn % 3 AS filtered, CASE WHEN conv_id % 3 = 0 THEN turn % 5 END AS errors, CASE WHEN conv_id % 3 = 0 THEN 10 + turn END AS words, ['low', 'medium', 'high'][(conv_id + turn) % 3 + 1] AS toxicity, (conv_id * 13 + turn * 7) % 100 / 100 AS negative, turn % 2 AS profane, CASE WHEN conv_id % 17 = 5 THEN 'no audio' END AS error FROM conversations)"""


@query(f"""WITH {REPORT}, g AS (SELECT sector, recording, grouping(sector, recording) AS g, count(*) FILTER (error IS NULL) AS done, count(*) FILTER (error IS NOT NULL) AS failed, max(error) AS error, coalesce(sum(elapsed_s) FILTER (error IS NULL), 0) AS elapsed_s, avg(confidence) FILTER (error IS NULL) AS confidence, avg(quality) FILTER (error IS NULL) AS quality,
  count(*) FILTER (error IS NULL AND passes) AS passed, coalesce(sum(filtered) FILTER (error IS NULL), 0)::BIGINT AS filtered, sum(errors) FILTER (error IS NULL) AS errors, sum(words) FILTER (error IS NULL) AS words, max(negative) FILTER (error IS NULL) AS negative, arg_max(toxicity, (negative, toxicity)) FILTER (error IS NULL) AS toxicity, coalesce(sum(profane) FILTER (error IS NULL), 0)::BIGINT AS profane
  FROM r GROUP BY ROLLUP (sector, recording)),
x AS (SELECT *, printf('%.1f s | confidence %.1f %% | quality %.0f %% | ', round(elapsed_s, 1), round(confidence, 1), round(quality, 0)) || CASE WHEN g > 0 THEN printf('%d of %d passed', passed, done) WHEN passed > 0 THEN 'passed' ELSE 'review' END || printf(' | filtered %d', filtered) || CASE WHEN words > 0 THEN printf(' | WER %.1f %%', round(100.0::DOUBLE * errors / words, 1)) ELSE '' END || printf(' | toxicity %s (%.1f %%) | profane %d', toxicity, round(100 * negative::DOUBLE, 1), profane) AS good FROM g)
SELECT sector, recording, CASE g WHEN 0 THEN 'recording' WHEN 1 THEN 'sector' ELSE 'total' END AS kind, '[' || CASE g WHEN 0 THEN sector || ' / ' || recording WHEN 1 THEN sector ELSE 'all' END || '] ' || CASE WHEN done > 0 THEN good || CASE WHEN g > 0 AND failed > 0 THEN printf(' | %d failed', failed) ELSE '' END WHEN g = 0 THEN 'error: ' || error ELSE printf('%d failed', failed) END AS line FROM x""")
def batch_report(spark, d):
    """Report lines of every call, sector and all."""
    rows = fx.table(spark, d, "conversations").selectExpr(
        "concat('call_', conv_id) AS recording", "element_at(array('telecom', 'banking', 'omni', 'insurance'), cast(conv_id % 4 AS int) + 1) AS sector", "((conv_id * 7 + turn) % 50) / 10.0D AS elapsed_s", "cast((conv_id * 3 + turn) % 100 AS double) AS confidence", "cast((conv_id + turn * 11) % 100 AS double) AS quality",
        "(conv_id + turn) % 2 = 0 AS passes", "turn % 3 AS filtered", "if(conv_id % 3 = 0, turn % 5, null) AS errors", "if(conv_id % 3 = 0, 10 + turn, null) AS words", "element_at(array('low', 'medium', 'high'), cast((conv_id + turn) % 3 AS int) + 1) AS toxicity", "((conv_id * 13 + turn * 7) % 100) / 100.0D AS negative", "turn % 2 AS profane", "if(conv_id % 17 = 5, 'no audio', null) AS error",
    )
    return fi.batch_report(rows)
