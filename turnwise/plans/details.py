"""Registered queries of transcripts in detail: exports, scopes, turns, paragraphs, regions, rescue, corrections, splits; each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.operators import calls as ca
from turnwise.operators import evaluation as ev
from turnwise.operators import folds
from turnwise.operators import governance as gov
from turnwise.operators import scoring as sc
from turnwise.operators import transcripts as tr
from turnwise.operators import trends
from turnwise.plans.registry import AS_OF, FIRED, HITS, QUERIES, SEG, _rules, _users, query  # noqa: F401
from turnwise.plans.workflows import HashModel, _hashed
from turnwise.sources import fixtures as fx

SHOWN = "CASE WHEN coalesce(speaker, '') = '' THEN 'Konuşmacı' WHEN contains(speaker, 'IVR') THEN 'IVR' WHEN speaker = 'SPEAKER_00' THEN 'Temsilci' WHEN speaker = 'SPEAKER_01' THEN 'Müşteri' ELSE speaker END"


@query(f"""{SEG} SELECT conversation_id, to_json({{'conversation': {{'id': conversation_id, 'full_transcript': string_agg(text, ' ' ORDER BY start_ms, segment_index), 'created_at': strftime(max(created_at), '%Y-%m-%dT%H:%M:%S'), 'sector': max(sector), 'duration_sec': max(end_ms) / 1000}},
'segments': list({{'start': start_ms / 1000, 'end': end_ms / 1000, 'text': text, 'speaker': speaker}} ORDER BY start_ms, segment_index)}})::VARCHAR AS json FROM segments GROUP BY conversation_id""")
def export_json(spark, d):
    return tr.export_json(fx.segments(spark, d))


@query(f"""{SEG} SELECT conversation_id, printf('# Görüşme %d' || chr(10) || '# Tarih: %s | Sektör: %s | Süre: %.0fs' || chr(10) || chr(10), conversation_id, strftime(max(created_at), '%Y-%m-%dT%H:%M:%S'), max(sector), round(max(end_ms) / 1000, 0))
|| string_agg(printf('[%02d:%02d] ', start_ms // 60000, start_ms // 1000 % 60) || {SHOWN} || ': ' || text, chr(10) ORDER BY start_ms, segment_index) AS text FROM segments GROUP BY conversation_id""")
def export_text(spark, d):
    return tr.export_text(fx.segments(spark, d))


@query(f"""{SEG}, {fx.HITS_SQL}, l AS (SELECT conversation_id, max(sector) AS sector, max(agent_id) AS agent_id, max(end_ms) AS duration_ms, string_agg(segment_index || '/' || speaker || '/' || text, chr(10) ORDER BY start_ms, segment_index) AS lines FROM segments GROUP BY 1),
h AS (SELECT conversation_id, string_agg(hit_id || '/' || keyword || '/' || topic, ',' ORDER BY created_at, hit_id) AS hits, array_to_string(list_sort(list(DISTINCT topic)), ',') AS topics FROM hits GROUP BY 1)
SELECT l.*, coalesce(hits, '') AS hits, coalesce(topics, '') AS topics FROM l LEFT JOIN h USING (conversation_id)""")
def conversation_full(spark, d):
    """Every call with its lines and hits in order."""
    found = tr.conversation_full(fx.segments(spark, d), fx.hits(spark, d))
    line = F.array_join(F.transform("lines", lambda x: F.concat_ws("/", x["segment_index"], x["speaker"], x["text"])), "\n")
    hit = F.array_join(F.transform("hits", lambda x: F.concat_ws("/", x["hit_id"], x["keyword"], x["topic"])), ",")
    return found.withColumn("lines", line).withColumn("hits", hit).withColumn("topics", F.array_join("topics", ","))


@query(f"""{SEG}, {fx.HITS_SQL}, v AS (SELECT 'lead_team_1' AS viewer, conversation_id FROM segments WHERE team = 'team_1' UNION SELECT 'agent_3', conversation_id FROM segments WHERE agent_id = 'agent_3' UNION SELECT 'watcher', conversation_id FROM segments),
c AS (SELECT viewer, conversation_id, max(created_at) AS created_at, substr(string_agg(text, ' ' ORDER BY segment_index), 1, 500) AS transcript FROM v JOIN segments USING (conversation_id) WHERE sector = 'telecom' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY viewer ORDER BY max(created_at) DESC, conversation_id) <= 200)
SELECT c.*, coalesce(n, 0) AS hit_count FROM c LEFT JOIN (SELECT conversation_id, count(*) AS n FROM hits GROUP BY 1) USING (conversation_id)""")
def list_visible(spark, d):
    """The telecom calls that three users see, newest first."""
    lines, hits, users, found = fx.segments(spark, d), fx.hits(spark, d), _users(spark, d), None
    for viewer in ("lead_team_1", "agent_3", "watcher"):
        one = tr.list_visible(lines, hits, users, viewer, "telecom").select(F.lit(viewer).alias("viewer"), "*")
        found = one if found is None else found.unionByName(one)
    return found


@query(f"{SEG} SELECT conversation_id, segment_index, string_agg(text, ' ') OVER (PARTITION BY conversation_id ORDER BY segment_index) AS text FROM segments")
def text_so_far(spark, d):
    return tr.text_so_far(fx.segments(spark, d))


SPACED = "SELECT conversation_id, segment_index, start_ms + 400 * segment_index AS start_ms, end_ms + 400 * segment_index AS end_ms, text, CASE WHEN segment_index % 5 <> 4 THEN '' ELSE speaker END AS speaker FROM segments"


@query(f"""{SEG}, s AS ({SPACED}), a AS (SELECT *, lower(trim(text)) AS t FROM s), b AS (SELECT *, contains(t, '?') OR ends_with(t, 'th.') OR ends_with(t, 'is.') AS asks, starts_with(t, 'the') OR starts_with(t, 'is') AS answers FROM a),
c AS (SELECT *, start_ms - lag(end_ms) OVER w AS p, lag(asks) OVER w AS asked FROM b WINDOW w AS (PARTITION BY conversation_id ORDER BY segment_index)),
g AS (SELECT *, CAST(sum(CASE WHEN p > 1500 OR (p > 400 AND asked) OR (p > 350 AND answers) THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY segment_index) AS BIGINT) AS turn_group FROM c)
SELECT conversation_id, segment_index, turn_group, CASE WHEN speaker <> '' THEN speaker WHEN turn_group % 2 = 0 THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS speaker FROM g""")
def text_turns(spark, d):
    """Turns of calls whose lines stand further apart, most of them without a speaker."""
    lines = fx.segments(spark, d).withColumn("start_ms", F.expr("start_ms + 400 * segment_index")).withColumn("end_ms", F.expr("end_ms + 400 * segment_index")).withColumn("speaker", F.expr("if(segment_index % 5 <> 4, '', speaker)"))
    return tr.text_turns(lines, ["th.", "is."], ["the", "is"])


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS p, list_filter(string_split(t, ' '), lambda w: w <> '') AS w FROM t),
c AS (SELECT doc_id, CASE WHEN len(p) <= 1 THEN w ELSE p END AS x, CASE WHEN len(p) <= 1 THEN 70 ELSE 4 END AS n FROM p WHERE len(w) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS paragraph, array_to_string(x[i * n + 1:i * n + n], ' ') AS text FROM (SELECT *, unnest(range((len(x) - 1) // n + 1)) AS i FROM c)""")
def paragraphs(spark, d):
    return tr.paragraphs(fx.table(spark, d, "documents"), "doc_id")


@query(f"""{SEG}, c AS (SELECT conversation_id, max(end_ms) AS length_ms, (conversation_id % 10) / 1000 AS rms FROM segments GROUP BY 1), s AS (SELECT conversation_id, start_ms, end_ms FROM segments WHERE segment_index % 3 = 1 AND conversation_id % 4 > 0),
p AS (SELECT conversation_id, greatest(0, start_ms - 300) AS s, least(length_ms, end_ms + 300) AS e FROM s JOIN c USING (conversation_id)),
f AS (SELECT *, coalesce(s - max(e) OVER (PARTITION BY conversation_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 3000, true) AS fresh FROM p),
r AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS region FROM f)
SELECT conversation_id, CAST(region AS BIGINT) AS region, min(s) AS start_ms, max(e) AS end_ms FROM r GROUP BY 1, 2 UNION ALL SELECT conversation_id, 1, 0, length_ms FROM c WHERE rms >= 0.006 AND conversation_id NOT IN (SELECT conversation_id FROM s)""")
def speech_regions(spark, d):
    """What to decode of each call, where a third of the lines were heard, and of a quarter of the calls none."""
    lines = fx.segments(spark, d)
    heads = lines.groupBy("conversation_id").agg(F.max("end_ms").alias("length_ms")).withColumn("rms", F.expr("(conversation_id % 10) / 1000.0D"))
    return tr.speech_regions(heads, lines.where("segment_index % 3 = 1 AND conversation_id % 4 > 0"))


@query(f"""{SEG}, n AS (SELECT conversation_id, list_sort(list(DISTINCT speaker)) AS names FROM segments GROUP BY 1)
SELECT conversation_id, CAST(len(names) AS INTEGER) AS speakers, CASE WHEN len(names) > 2 THEN list_filter(names, lambda s: s NOT IN ('SPEAKER_00', 'SPEAKER_01'))[1] END AS supervisor FROM n""")
def supervisors(spark, d):
    return tr.supervisors(fx.segments(spark, d), "SPEAKER_00", "SPEAKER_01")


SPOKEN = "list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '')"


@query(f"""{SEG}, w AS (SELECT *, {SPOKEN} AS w FROM segments), o AS (SELECT *, coalesce(avg_logprob, -1) <> -1 AND coalesce(avg_logprob, -1) < -0.5 AS low, last_value(CASE WHEN avg_logprob >= -0.5 AND text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context,
  len(list_filter(range(1, len(w) + 1), lambda i: length(regexp_replace(w[i], '[^\\p{{L}}\\p{{N}}_]', '', 'g')) >= 4 AND (7 * i + conversation_id) % 100 < 40)) AS odd FROM w),
s AS (SELECT *, CASE WHEN low THEN 0 ELSE odd END AS suspects FROM o)
SELECT conversation_id, segment_index, speaker, rank, suspects, coalesce(context, '') AS context FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, speaker ORDER BY segment_index) AS rank FROM s WHERE (low OR suspects >= 2) AND dur_ms BETWEEN 300 AND 15000) WHERE rank <= 8""")
def rescue_lines(spark, d):
    """Lines to decode again, by likelihood or by suspect words."""
    words = F.transform(F.filter(F.split("text", "[ \t\r\n]+"), lambda x: x != ""), lambda w, i: F.struct(w.alias("word"), (((i + 1) * 7 + F.col("conversation_id")) % 100 / 100.0).alias("probability")))
    return tr.rescue_lines(fx.segments(spark, d).withColumn("words", words))


@query(f"""{SEG}, c AS (SELECT conversation_id, CASE WHEN conversation_id % 7 > 0 THEN (conversation_id * 13) % 100 / 100 END AS confidence, CASE WHEN conversation_id % 5 > 0 THEN 60 + (conversation_id * 11) % 40 END AS audio_score, count(*) FILTER (avg_logprob < -1.2) AS filtered FROM segments GROUP BY 1)
SELECT conversation_id, coalesce(confidence < 0.45, false) OR coalesce(audio_score < 78, false) OR filtered > 0 AS again FROM c""")
def second_pass(spark, d):
    heads = fx.segments(spark, d).groupBy("conversation_id").agg(F.count_if(F.col("avg_logprob") < -1.2).alias("filtered"))
    return tr.second_pass(heads.withColumn("confidence", F.expr("if(conversation_id % 7 > 0, (conversation_id * 13) % 100 / 100.0D, null)")).withColumn("audio_score", F.expr("if(conversation_id % 5 > 0, 60.0D + (conversation_id * 11) % 40, null)")))


FIXES = "c AS (SELECT conversation_id, segment_index, k, CASE k WHEN 1 THEN 'SPEAKER_02' ELSE 'SPEAKER_0' || (segment_index % 2) END AS new_speaker FROM segments, (VALUES (1), (2)) v(k) WHERE segment_index % 2 = 0 AND (k = 1 OR conversation_id % 2 = 0))"


@query(f"""{SEG}, {FIXES}, m AS (SELECT conversation_id, segment_index, arg_max(new_speaker, k) AS new_speaker, count(*) AS corrections FROM c GROUP BY 1, 2)
SELECT s.conversation_id, s.segment_index, coalesce(new_speaker, s.speaker) AS speaker, coalesce(corrections, 0) AS corrections, CASE WHEN corrections = 2 THEN s.speaker || '>SPEAKER_02,SPEAKER_02>SPEAKER_0' || (s.segment_index % 2) WHEN corrections = 1 THEN s.speaker || '>SPEAKER_02' ELSE '' END AS log,
  CASE WHEN n_words = 0 THEN 0 WHEN new_speaker IS NULL THEN n_words ELSE (n_words + 1) // 2 END AS own_words FROM segments s LEFT JOIN m USING (conversation_id, segment_index)""")
def correct_speakers(spark, d):
    """Every second line corrected once or twice; its log, and how many of its words (each second one another's) have its speaker then."""
    lines = fx.segments(spark, d)
    words = lines.where("n_words > 0").select("conversation_id", "segment_index", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_words"))).alias("word"), F.col("speaker").alias("own")).selectExpr("conversation_id", "segment_index", "word", "if(word % 2 = 1 OR segment_index % 2 = 1, own, 'other') AS speaker")
    fixes = lines.where("segment_index % 2 = 0").select("conversation_id", "segment_index", F.explode(F.expr("if(conversation_id % 2 = 0, array(1, 2), array(1))")).alias("corrected_at")).selectExpr("*", "if(corrected_at = 1, 'SPEAKER_02', concat('SPEAKER_0', segment_index % 2)) AS new_speaker", "'qa' AS corrected_by", "'heard' AS reason")
    fixed, spoken, log = tr.correct_speakers(lines, words, fixes)
    entry = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.concat("old_speaker", F.lit(">"), "new_speaker").alias("e")))), lambda x: x["e"]), ",")
    told = log.groupBy(*tr.KEYS).agg(F.count(F.lit(1)).alias("corrections"), entry.alias("log"))
    mine = spoken.withColumnRenamed("speaker", "s").join(fixed.select(*tr.KEYS, "speaker"), tr.KEYS).groupBy(*tr.KEYS).agg(F.count_if(F.col("s") == F.col("speaker")).alias("own_words"))
    rows = fixed.select(*tr.KEYS, "speaker").join(told, tr.KEYS, "left").join(mine, tr.KEYS, "left")
    return rows.fillna(0, ["corrections", "own_words"]).fillna("", ["log"])


@query(r"""SELECT doc_id, list_reverse_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(text, '(?i)\b([0-9]{2,4})\s*(?:tl|lira|gb|usd|eur)', 1), regexp_extract_all(text, '(?i)\b(?:the|total|und)\s*([0-9]{2,4})\b', 1)), lambda x: CAST(x AS BIGINT)), lambda x: x BETWEEN 50 AND 100000))) AS amounts FROM (SELECT doc_id, text || ' total ' || (doc_id * 37 % 5000) || ' gb' AS text FROM documents WHERE text IS NOT NULL)""")
def price_points(spark, d):
    """Amounts in documents that end with one."""
    docs = fx.table(spark, d, "documents").where("text is not null").withColumn("text", F.expr("concat(text, ' total ', doc_id * 37 % 5000, ' gb')"))
    return docs.select("doc_id", tr.price_points(F.col("text"), ["tl", "lira", "gb", "usd", "eur"], ["the", "total", "und"]).alias("amounts"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('9|' || doc_id), doc_id) <= greatest(1, round_even((SELECT count(*) FROM documents) * 0.13::DOUBLE, 0)) THEN 'development' ELSE 'train' END AS split FROM documents")
def exact_split(spark, d):
    return tr.exact_split(fx.table(spark, d, "documents"), "doc_id", 9, 0.13)


@query(f"""WITH {fx.SEGMENTS_SQL}, {fx.TURNS_SQL}, u AS (SELECT DISTINCT 'call_' || conversation_id AS uri FROM turns), s AS (SELECT uri, CASE WHEN row_number() OVER (ORDER BY md5('9|' || uri), uri) <= greatest(1, round_even((SELECT count(*) FROM u) * 0.2::DOUBLE, 0)) THEN 'development' ELSE 'train' END AS split FROM u),
k AS (SELECT s.*, c.duration_sec FROM s JOIN (SELECT 'call_' || conversation_id AS uri, max(end_ms) / 1000 AS duration_sec FROM segments WHERE conversation_id % 9 > 0 GROUP BY 1) c USING (uri))
SELECT split, 'lst' AS kind, uri, uri AS value FROM k UNION ALL SELECT split, 'uem', uri, printf('%s 1 0.000 %.3f', uri, duration_sec) FROM k
UNION ALL SELECT split, 'rttm', uri, printf('SPEAKER call_%d 1 %.3f %.3f <NA> <NA> %s <NA> <NA>', conversation_id, t_start / 1000, (t_end - t_start) / 1000, turn_speaker) FROM k JOIN turns ON uri = 'call_' || conversation_id WHERE t_end > t_start""")
def protocol_lines(spark, d):
    """The lines of a split's files; recordings of a ninth of the calls are not there."""
    turns = fx.turns(spark, d).selectExpr("concat('call_', conversation_id) AS uri", "t_start", "t_end", "turn_speaker AS speaker")
    heads = fx.segments(spark, d).where("conversation_id % 9 > 0").groupBy("conversation_id").agg((F.max("end_ms") / 1000.0).alias("duration_sec")).selectExpr("concat('call_', conversation_id) AS uri", "duration_sec")
    split = tr.exact_split(turns, "uri", 9, 0.2)
    return tr.protocol_lines(split, heads, ca.write_rttm(turns)).drop("at")


@query(f"""{SEG}, {{}}""".replace("{}", """x AS (SELECT *, sum(CASE WHEN speaker = 'SPEAKER_01' AND segment_index % 2 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY segment_index) AS event FROM segments),
b AS (SELECT conversation_id, 15 * count(DISTINCT event) AS bonus FROM x WHERE event > 0 AND speaker = 'SPEAKER_00' AND n_words > 5 GROUP BY 1),
m AS (SELECT conversation_id, max(contains(lower(text), 'the')::INT) + max(contains(lower(text), 'und ')::INT) AS li, max(contains(lower(text), 'die ')::INT) AS de, CAST(floor(avg(floor(n_words / greatest(0.5, dur_ms / 1000.0) * 60))) AS BIGINT) AS wpm FROM segments WHERE speaker = 'SPEAKER_00' AND length(trim(text)) >= 2 GROUP BY 1),
c AS (SELECT conversation_id, count(*) AS cuts FROM (SELECT *, max(end_ms) OVER (PARTITION BY conversation_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS till, lag(speaker) OVER w AS ps, lag(dur_ms) OVER w AS pd FROM segments WHERE length(text) >= 2 WINDOW w AS (PARTITION BY conversation_id ORDER BY segment_index))
  WHERE ps <> speaker AND speaker = 'SPEAKER_00' AND till - start_ms > 700 AND till - start_ms <= 2500 AND pd >= 800 GROUP BY 1)
SELECT conversation_id, CAST(greatest(0, least(100, 50 + least(20, 10 * coalesce(li, 0)) + least(30, coalesce(bonus, 0)) - least(40, 20 * coalesce(de, 0)) - least(30, 8 * coalesce(cuts, 0)))) AS BIGINT) AS score, coalesce(wpm, 0) AS wpm, coalesce(cuts, 0) AS interruptions
FROM (SELECT DISTINCT conversation_id FROM segments) LEFT JOIN m USING (conversation_id) LEFT JOIN c USING (conversation_id) LEFT JOIN b USING (conversation_id)"""))
def soft_skills_in_crisis(spark, d):
    """Scores of the agents with the bonus for calming an angry customer."""
    lines = fx.segments(spark, d)
    events = lines.withColumn("angry", F.expr("speaker = 'SPEAKER_01' AND segment_index % 2 = 1")).withColumn("positive", F.expr("speaker = 'SPEAKER_00' AND n_words > 5"))
    return ev.soft_skills(lines, "SPEAKER_00", {"listening": ["the", "und "], "defensive": ["die "]}, ca.crisis_bonus(events), 1000)


@query(f"""{SEG}, g AS (SELECT *, NOT (n_words > 3 AND (contains(lower(text), 'die ') OR contains(lower(text), 'un '))) OR {_hashed('defensive')} > 0.6::DOUBLE AS ok FROM segments WHERE speaker = 'SPEAKER_00' AND length(trim(text)) >= 2),
m AS (SELECT conversation_id, max((contains(lower(text), 'die ') AND ok)::INT) + max((contains(lower(text), 'un ') AND ok)::INT) AS de, CAST(floor(avg(floor(n_words / greatest(0.5, dur_ms / 1000.0) * 60))) AS BIGINT) AS wpm FROM g GROUP BY 1),
c AS (SELECT conversation_id, count(*) AS cuts FROM (SELECT *, max(end_ms) OVER (PARTITION BY conversation_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS till, lag(speaker) OVER w AS ps, lag(dur_ms) OVER w AS pd FROM segments WHERE length(text) >= 2 WINDOW w AS (PARTITION BY conversation_id ORDER BY segment_index))
  WHERE ps <> speaker AND speaker = 'SPEAKER_00' AND till - start_ms > 700 AND till - start_ms <= 2500 AND pd >= 800 GROUP BY 1)
SELECT conversation_id, CAST(greatest(0, 50 - least(40, 20 * coalesce(de, 0)) - least(30, 8 * coalesce(cuts, 0))) AS BIGINT) AS score, coalesce(wpm, 0) AS wpm, coalesce(cuts, 0) AS interruptions FROM (SELECT DISTINCT conversation_id FROM segments) LEFT JOIN m USING (conversation_id) LEFT JOIN c USING (conversation_id)""")
def soft_skills_weighed(spark, d):
    """Scores of the agents whose defensive phrases a model weighs."""
    lines = sc.weigh_defensive(fx.segments(spark, d), "SPEAKER_00", ["die ", "un "], lambda: HashModel(["defensive"]))
    return ev.soft_skills(lines, "SPEAKER_00", {"defensive": ["die ", "un "]}, None, 1000, "weighed")


@query(f"""{SEG}, n AS (SELECT conversation_id, segment_index, start_ms, end_ms, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(text), '([.?!;])\\\\s+', '\\\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM segments WHERE trim(text) <> ''),
l AS (SELECT *, CASE WHEN len(p) <= 1 OR end_ms - start_ms <= 2500 THEN [text] ELSE p END AS q FROM n),
t AS (SELECT *, list_reduce(range(1, len(q) + 1), lambda a, i: list_append(a, CASE WHEN i = len(q) THEN end_ms ELSE CAST(round((a[-1] + greatest(100, end_ms - start_ms) * length(q[i]) / list_sum(list_transform(q, lambda s: length(s)))) / 10) AS BIGINT) * 10 END), [start_ms]) AS cuts FROM l),
s AS (SELECT conversation_id, segment_index, i - 1 AS part, cuts[i] AS s, cuts[i + 1] AS e FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM t)), w AS (SELECT conversation_id, segment_index, word, start_ms + 400 * (word - 1) AS ws, start_ms + 400 * word - 50 AS we FROM (SELECT *, unnest(range(1, n_words + 1)) AS word FROM segments)),
m AS (SELECT conversation_id, segment_index, part, string_agg(word, ',' ORDER BY ws, word) AS words FROM s JOIN w USING (conversation_id, segment_index) WHERE ws < e AND we > s GROUP BY ALL)
SELECT conversation_id, segment_index, CAST(part AS INTEGER) AS part, coalesce(words, '') AS words FROM s LEFT JOIN m USING (conversation_id, segment_index, part)""".replace("\\\\", "\\"))
def sentence_words(spark, d):
    """The words of every sentence of every line."""
    words = fx.segments(spark, d).where("n_words > 0").select("conversation_id", "segment_index", "start_ms", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_words"))).alias("word"))
    words = words.selectExpr("conversation_id", "segment_index", "word", "start_ms + 400 * (word - 1) AS w_start", "start_ms + 400 * word - 50 AS w_end")
    return tr.sentence_words(folds.split_sentences(fx.segments(spark, d)), words).withColumn("words", F.array_join("words", ","))


@query(f"""{HITS}, {FIRED} SELECT rule_id, to_json({{'title': title, 'summary': summary, 'severity': severity, 'details': {{'keyword': keyword, 'pct_change': pct_change::DOUBLE}}, 'timestamp': '{AS_OF}'}})::VARCHAR AS payload FROM e""")
def alert_bodies(spark, d):
    """The whole body that each alert sends."""
    return trends.alert_payloads(trends.evaluate_alerts(fx.hits(spark, d), _rules(spark, d), AS_OF)[0], AS_OF)


@query("SELECT 'agent_' || vec_id AS agent, TIMESTAMP '2024-01-01' + to_hours(vec_id % 50) AS enrolled_at, CAST(len(embedding) AS BIGINT) AS dimensions, 'model_' || (vec_id % 3) AS model FROM embeddings")
def voiceprint_models(spark, d):
    prints = fx.table(spark, d, "embeddings").selectExpr("concat('agent_', vec_id) AS agent", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(vec_id % 50 AS int)) AS enrolled_at", "embedding AS print", "concat('model_', vec_id % 3) AS model")
    return gov.list_voiceprints(prints)
