"""Operators over call segments: filters, alignment, sequence rules, scores of a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions import text as tx


_KEYS = ["conversation_id", "segment_index"]


def _call():
    """The lines of a call in order."""
    return Window.partitionBy("conversation_id").orderBy("segment_index")


def _before():
    return _call().rowsBetween(Window.unboundedPreceding, -1)


def sequential_scan(df: DataFrame, keys: list[str], order: list[str], init: Column, step) -> DataFrame:
    """Fold each group's rows in order with step(acc, row); acc is the array of rows kept so far. For rules that see what was kept."""
    row = F.struct(*order, *[c for c in df.columns if c not in (*keys, *order)])
    kept = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows")).select(*keys, F.aggregate("_rows", init, step).alias("_kept"))
    return kept.select(*keys, F.inline("_kept"))


def dedup_loops(segments: DataFrame, gap_ms: int = 25_000, short_gap_ms: int = 15_000, short_words: int = 4, look_back: int = 4) -> DataFrame:
    """Drop a line that repeats one of its speaker's last kept ones: the same text soon after, or a short line one of which holds the other."""
    rows = segments.select("conversation_id", "segment_index", "start_ms", "end_ms", "speaker", "n_words", F.lower(F.trim("text")).alias("t"))
    empty = F.array().cast("array<struct<segment_index:bigint,start_ms:bigint,end_ms:bigint,speaker:string,n_words:bigint,t:string>>")

    def step(acc, x):
        mine = F.slice(F.reverse(F.filter(acc, lambda k: k["speaker"] == x["speaker"])), 1, look_back)
        gap = lambda k: x["start_ms"] - k["end_ms"]
        same = F.exists(mine, lambda k: (k["t"] == x["t"]) & (gap(k) < gap_ms))
        held = F.exists(mine, lambda k: (x["n_words"] <= short_words) & (gap(k) < short_gap_ms) & (F.contains(k["t"], x["t"]) | F.contains(x["t"], k["t"])))
        return F.when(same | held, acc).otherwise(F.concat(acc, F.array(x)))

    return sequential_scan(rows, ["conversation_id"], ["segment_index"], empty, step).select("conversation_id", "segment_index")


def smooth_speakers(segments: DataFrame, most_words: int = 3, gap_ms: int = 1500) -> DataFrame:
    """A short line between two of one other speaker, close to both, takes their speaker; a change is seen by the next line."""
    nxt = lambda c: F.lead(c).over(_call())
    rows = segments.select("conversation_id", "segment_index", "start_ms", "end_ms", "speaker", "n_words", nxt("speaker").alias("ns"), nxt("start_ms").alias("nstart"))
    empty = F.array().cast("array<struct<segment_index:bigint,start_ms:bigint,end_ms:bigint,speaker:string,n_words:bigint,ns:string,nstart:bigint>>")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        flip = (x["n_words"] <= most_words) & (last["speaker"] == x["ns"]) & (last["speaker"] != x["speaker"]) & (x["start_ms"] - last["end_ms"] < gap_ms) & (x["nstart"] - x["end_ms"] < gap_ms)
        out = F.struct(x["segment_index"].alias("segment_index"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), F.when(F.coalesce(flip, F.lit(False)), last["speaker"]).otherwise(x["speaker"]).alias("speaker"), x["n_words"].alias("n_words"), x["ns"].alias("ns"), x["nstart"].alias("nstart"))
        return F.concat(acc, F.array(out))

    return sequential_scan(rows, ["conversation_id"], ["segment_index"], empty, step).select("conversation_id", "segment_index", "speaker")


def asr_confidence(segments: DataFrame) -> DataFrame:
    """Duration-weighted mean of exp(logprob) over known ones in (-1, 0]; 0 where none."""
    known = F.col("avg_logprob").isNotNull() & (F.col("avg_logprob") > -1) & (F.col("avg_logprob") <= 0)
    weight = F.greatest(F.col("dur_ms") / 1000.0, F.lit(0.1))
    found = segments.groupBy("conversation_id").agg(F.sum(F.when(known, F.exp("avg_logprob") * weight)).alias("a"), F.sum(F.when(known, weight)).alias("b"))
    return found.select("conversation_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("a") / F.col("b"), F.lit(0.0)))), 3).alias("confidence"))


def quality_gate(confidences: DataFrame, gate: float = 0.45) -> DataFrame:
    """Passes where there is no data (0) or enough confidence."""
    return confidences.withColumn("passes", (F.col("confidence") == 0) | (F.col("confidence") >= gate))


def flag_phrases(segments: DataFrame, phrases: list[str], before_ms: int | None = None) -> DataFrame:
    """Segments that hold a phrase, case-folded, starting by `before_ms` if given."""
    hit = F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower("text"), p))
    return segments.withColumn("flagged", hit if before_ms is None else hit & (F.col("start_ms") <= before_ms)).select("conversation_id", "segment_index", "flagged")


def transcript_search(segments: DataFrame, query: str) -> DataFrame:
    found = segments.where(F.contains(tx.fold(F.col("text")), F.lit(query.lower())))
    return found.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("matches"))


def neighbour_context(segments: DataFrame, below: float = -0.7, chars: int = 200) -> DataFrame:
    """Uncertain lines with the start of the line before and after."""
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, chars)
    rows = segments.select("conversation_id", "segment_index", "avg_logprob", cut(F.lag("text").over(_call())).alias("before"), cut(F.lead("text").over(_call())).alias("after"))
    return rows.where(F.col("avg_logprob") < below).drop("avg_logprob")


def rescue_candidates(segments: DataFrame, below: float = -0.5, most: int = 8) -> DataFrame:
    """The first uncertain lines of each channel, 0.3 to 15 s long, with the latest confident text before them."""
    rows = segments.withColumn("context", F.last(F.when(F.col("avg_logprob") >= below, F.col("text")), ignorenulls=True).over(_before())).where((F.col("avg_logprob") < below) & F.col("dur_ms").between(300, 15_000))
    rank = F.row_number().over(Window.partitionBy("conversation_id", "speaker").orderBy("segment_index"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("conversation_id", "segment_index", "speaker", F.col("rank").cast("long").alias("rank"), "context")


def keyword_hits(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits of rules(rule_id, term, sector_scope): the words of a term in a row, whole words, once for each segment and term; with the text around.

    Runs of as many words as some term has are joined with the terms, which are a dimension and mostly broadcast; a run's row holds
    nothing but its keys, and the texts of hits alone are joined again.
    """
    terms = rules.withColumn("n", F.size(F.split("term", " ")))
    lengths = sorted(r["n"] for r in terms.select("n").distinct().collect())  # a few: how many words terms have
    runs = F.flatten(F.array(*[F.transform(tx.ngrams(F.col("w"), n), lambda g, i: F.struct(g.alias("term"), i.alias("at"))) for n in lengths])) if lengths else F.array().cast("array<struct<term:string,at:int>>")
    # a run's first place is all that counts
    places = segments.select(*_KEYS, "sector", tx.tokens(F.col("text")).alias("w")).select(*_KEYS, "sector", F.inline(runs))
    found = places.join(terms, "term").where(F.col("sector_scope").isNull() | F.array_contains("sector_scope", F.col("sector")))
    found = found.groupBy(*_KEYS, "rule_id", "term").agg(F.min(F.col("at").cast("long")).alias("word_index"))
    return found.join(segments.select(*_KEYS, "text"), _KEYS).select(*_KEYS, "rule_id", "term", "word_index", tx.context_window(F.col("text"), F.col("term")).alias("context"))


def align_segments_to_turns(segments: DataFrame, turns: DataFrame, bucket_ms: int = 30_000) -> DataFrame:
    """Each segment's speaker: that of the turn it overlaps most (the first on ties), else its own, else that of the call's first turn.

    Spans are dealt to 30-second buckets of their call, so a long recording makes no quadratic pairs; a pair counts in the bucket where
    its overlap starts.
    """
    spread = lambda df, s, e: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / bucket_ms), F.floor((F.col(e) - 1) / bucket_ms))))
    a = spread(segments.select("conversation_id", "segment_index", "start_ms", "end_ms", "speaker"), "start_ms", "end_ms")
    b = spread(turns, "t_start", "t_end")
    overlap = F.least("end_ms", "t_end") - F.greatest("start_ms", "t_start")
    met = a.join(b, ["conversation_id", "_b"]).withColumn("overlap", overlap).where((F.col("overlap") > 0) & (F.floor(F.greatest("start_ms", "t_start") / bucket_ms) == F.col("_b")))
    best = met.groupBy("conversation_id", "segment_index").agg(F.max_by("turn_speaker", F.struct("overlap", -F.col("turn_index"))).alias("aligned"))
    first = turns.groupBy("conversation_id").agg(F.min_by("turn_speaker", "turn_index").alias("opening"))
    out = segments.select(*_KEYS, "speaker").join(best, _KEYS, "left").join(first, "conversation_id", "left")
    return out.select(*_KEYS, F.coalesce("aligned", "speaker", "opening").alias("speaker"))


def crosstalk_adjacent(segments: DataFrame, least_ms: int = 100) -> DataFrame:
    """Following lines of different speakers that overlap."""
    rows = segments.withColumn("ns", F.lead("speaker").over(_call())).withColumn("nstart", F.lead("start_ms").over(_call())).withColumn("overlap_ms", F.col("end_ms") - F.col("nstart"))
    return rows.where((F.col("ns") != F.col("speaker")) & (F.col("overlap_ms") > least_ms)).select("conversation_id", "segment_index", "overlap_ms", F.when(F.col("overlap_ms") > 1000, "high").otherwise("low").alias("intensity"))


def interruptions(segments: DataFrame, agent: str) -> DataFrame:
    """Lines of the agent that begin 0.7 to 2.5 s before another speaker's line, of at least 0.8 s, has ended."""
    rows = segments.where(F.length("text") >= 2).select("*", F.max("end_ms").over(_before()).alias("till"), F.lag("speaker").over(_call()).alias("ps"), F.lag("dur_ms").over(_call()).alias("pd"))
    over = F.col("till") - F.col("start_ms")
    return rows.where((F.col("ps") != F.col("speaker")) & (F.col("speaker") == agent) & (over > 700) & (over <= 2500) & (F.col("pd") >= 800)).select("conversation_id", "segment_index", over.alias("overlap_ms"))


def group_text_turns(segments: DataFrame) -> DataFrame:
    """Turns by pauses: over 1.5 s, or over 0.4 s after a question."""
    gap = F.col("start_ms") - F.lag("end_ms").over(_call())
    new = F.coalesce((gap > 1500) | ((gap > 400) & F.lag("text").over(_call()).rlike(r"\?\s*$")), F.lit(False))
    return segments.withColumn("new", new.cast("long")).select("conversation_id", "segment_index", F.sum("new").over(_call()).alias("turn_group"))


def merge_regions(segments: DataFrame, pad_ms: int = 300, gap_ms: int = 3000) -> DataFrame:
    """Padded speech regions, joined where the silence between is at most `gap_ms`."""
    spans = segments.select("conversation_id", F.greatest(F.lit(0), F.col("start_ms") - pad_ms).alias("s"), (F.col("end_ms") + pad_ms).alias("e"), "segment_index")
    order = Window.partitionBy("conversation_id").orderBy("s", "e", "segment_index")
    fresh = spans.withColumn("till", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("new", F.coalesce(F.col("s") - F.col("till") > gap_ms, F.lit(True)).cast("long"))
    return fresh.withColumn("region", F.sum("new").over(order)).groupBy("conversation_id", "region").agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms"))


def identify_roles(segments: DataFrame, agent_phrases: list[str], customer_phrases: list[str]) -> DataFrame:
    """Points for each speaker; the most is the agent, the next the customer (ties by speaker)."""
    held = lambda ps: sum((F.contains(F.lower("text"), F.lit(p)).cast("long") for p in ps), F.lit(0))
    lines = segments.withColumn("opens", (F.row_number().over(_call()) == 1).cast("long")).withColumn("p", 5 * held(agent_phrases) - 3 * held(customer_phrases) - 2 * F.regexp_count("text", F.lit(r"\?")))
    points = lines.groupBy("conversation_id", "speaker").agg((F.sum("p") + 4 * F.max("opens") + F.when(F.avg("n_words") > 12, 3).otherwise(0)).alias("points"))
    rank = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("points"), "speaker"))
    return points.withColumn("rank", rank).select("conversation_id", "speaker", "points", F.when(F.col("rank") == 1, "agent").when(F.col("rank") == 2, "customer").otherwise("other").alias("role"))


def speaker_stats(segments: DataFrame) -> DataFrame:
    return segments.groupBy("conversation_id").agg(F.max("end_ms").alias("duration_ms"), F.count_distinct("speaker").alias("speakers"), F.array_join(F.sort_array(F.collect_set("speaker")), ",").alias("names"))


def shielded_terms(text: Column, terms: list[str], negators: list[str], chars: int = 30) -> Column:
    """The terms that a text holds, lower-cased, at some place that no negator stands before: within `chars` characters before the last space there, or after it."""
    low = F.lower(text)
    listed = F.array(*[F.lit(n) for n in negators]).cast("array<string>")

    def held(term: str) -> Column:
        parts = F.split(low, r"\Q" + term + r"\E", -1)

        def step(acc, part):
            # of what stands before this place only as much is carried on as a negator may be in
            before = F.concat(acc["tail"], part)
            space = F.char_length(before) - F.char_length(F.substring_index(before, " ", -1))
            around = F.substring(before, F.greatest(F.lit(1), space - chars), F.char_length(before))
            free = ~F.exists(listed, lambda n: F.contains(around, n))
            return F.struct(F.concat(around, F.lit(term)).alias("tail"), (acc["free"] | free).alias("free"))

        start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("free"))
        return F.when(F.size(parts) > 1, F.aggregate(F.slice(parts, F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), start, step)["free"]).otherwise(False)

    return F.array_compact(F.array(*[F.when(held(t), F.lit(t)) for t in terms]))


def toxicity_rate(segments: DataFrame, terms: list[str], negators: list[str] = ()) -> DataFrame:
    """Distinct matched terms of a call over its words; a term after a negator does not count."""
    words = segments.select("conversation_id", "n_words", "segment_index", shielded_terms(F.col("text"), terms, list(negators)).alias("hit"))
    found = words.groupBy("conversation_id").agg(F.sum("n_words").alias("words"), F.size(F.array_distinct(F.flatten(F.collect_set("hit")))).cast("long").alias("terms"), F.count_if(F.size("hit") > 0).alias("flagged"))
    return found.select("conversation_id", "terms", "flagged", F.round(F.col("terms") / F.greatest(F.lit(1), "words"), 4).alias("rate"), (F.col("flagged") == 0).alias("is_clean"))


def corpus_wer(pairs: DataFrame) -> DataFrame:
    """pairs(domain, reference, hypothesis) -> for each domain edits, reference words, error rate and accuracy in percent."""
    w = lambda c: F.filter(F.split(F.lower(c), "[ \t\r\n]+"), lambda x: x != "")
    scored = pairs.select("domain", F.size(w("reference")).alias("n"), tx.word_edits(w("reference"), w("hypothesis")).alias("e"))
    found = scored.groupBy("domain").agg(F.sum(F.col("e").cast("long")).alias("edits"), F.sum(F.col("n").cast("long")).alias("words"))
    rate = 100.0 * F.col("edits") / F.greatest(F.lit(1), "words")
    return found.select("domain", "edits", "words", F.round(rate, 4).alias("wer"), F.round(F.greatest(F.lit(0.0), 100 - rate), 4).alias("accuracy"))


def export_srt(segments: DataFrame) -> DataFrame:
    """The subtitle file of each call."""
    at = F.row_number().over(Window.partitionBy("conversation_id").orderBy("start_ms", "segment_index"))
    block = F.format_string("%d\n%s --> %s\n%s: %s\n", at, tx.srt_timestamp(F.col("start_ms")), tx.srt_timestamp(F.col("end_ms")), "speaker", "text")
    rows = segments.select("conversation_id", at.alias("k"), block.alias("b"))
    return rows.groupBy("conversation_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "b"))), lambda x: x["b"]), "\n").alias("srt"))


def running_transcript(segments: DataFrame) -> DataFrame:
    """The words and characters said up to each line, and the first line of the call."""
    upto = _call().rowsBetween(Window.unboundedPreceding, 0)
    return segments.select("conversation_id", "segment_index", F.sum("n_words").over(upto).alias("words_so_far"), F.sum(F.length("text").cast("long")).over(upto).alias("chars_so_far"))


def needs_second_pass(segments: DataFrame, gate: float = 0.45, floor: float = -1.1) -> DataFrame:
    """Calls to decode again: known but low confidence, or a line under the floor."""
    low = segments.groupBy("conversation_id").agg(F.count_if(F.col("avg_logprob") < floor).alias("low_lines"))
    found = asr_confidence(segments).join(low, "conversation_id")
    return found.withColumn("again", ((F.col("confidence") > 0) & (F.col("confidence") < gate)) | (F.col("low_lines") > 0))


def metric_tone(confidences: DataFrame, good: float = 92, warn: float = 75) -> DataFrame:
    """The colour of a confidence in percent."""
    percent = 100 * F.col("confidence")
    return confidences.withColumn("tone", F.when(percent >= good, "good").when(percent >= warn, "warn").otherwise("bad"))


def blended_toxicity(segments: DataFrame, terms: list[str]) -> DataFrame:
    """A call's toxicity from matched words alone: min(0.95, 0.12 * hits + 2 * hits / words), and its band."""
    hits = F.size(F.filter(tx.tokens(F.col("text")), lambda t: t.isin(terms))).cast("long")
    found = segments.groupBy("conversation_id").agg(F.sum(hits).alias("hits"), F.sum("n_words").alias("words"))
    score = F.round(F.least(F.lit(0.95), 0.12 * F.col("hits") + 2.0 * F.col("hits") / F.greatest(F.lit(1), "words")), 6)
    return found.select("conversation_id", "hits", score.alias("score")).withColumn("band", F.when(F.col("score") > 0.7, "high").when(F.col("score") > 0.4, "medium").otherwise("low"))


def align_words_to_turns(segments: DataFrame, turns: DataFrame, word_ms: int = 400, bucket_ms: int = 30_000) -> DataFrame:
    """Words vote for the turns that hold their middle; a segment's speaker has most votes (ties by name), else its own. Words in several turns are cross-talk."""
    words = segments.select("conversation_id", "segment_index", F.explode(F.sequence(F.lit(1), F.col("n_words"))).alias("word"), "start_ms", "n_words").where("n_words > 0")
    words = words.withColumn("mid", F.col("start_ms") + word_ms * (F.col("word") - 1) + word_ms // 2).withColumn("_b", F.floor(F.col("mid") / bucket_ms))
    spread = turns.withColumn("_b", F.explode(F.sequence(F.floor(F.col("t_start") / bucket_ms), F.floor((F.col("t_end") - 1) / bucket_ms))))
    met = words.join(spread, ["conversation_id", "_b"]).where("mid >= t_start and mid < t_end")
    votes = met.groupBy("conversation_id", "segment_index", "turn_speaker").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("conversation_id", "segment_index").agg(F.min(F.struct((-F.col("n")).alias("n"), "turn_speaker")).alias("m"))
    crossed = met.groupBy("conversation_id", "segment_index", "word").agg(F.count(F.lit(1)).alias("n")).groupBy("conversation_id", "segment_index").agg(F.count_if(F.col("n") > 1).alias("crossed"))
    keys = ["conversation_id", "segment_index"]
    out = segments.select(*keys, "speaker").join(best, keys, "left").join(crossed, keys, "left")
    return out.select(*keys, F.coalesce("m.turn_speaker", "speaker").alias("speaker"), F.coalesce("crossed", F.lit(0)).alias("crosstalk_words"))


def words_in_turns(words: DataFrame, turns: DataFrame, bucket_ms: int = 30_000) -> DataFrame:
    """words(conversation_id, segment_index, word, w_start, w_end, ...) with `turn_speaker`, the first turn (by turn_index) that holds the word's middle, else
    null, and `crosstalk`: several turns hold its middle, or a turn of another speaker than the word's (null: its segment's `speaker`) overlaps it at all.

    Overlaps come from one sweep over a call: of all turns, and of the word's speaker's, those that have begun before the word's end
    less those that have ended by its start. So no word meets a turn but those around its middle. Turns and words without length overlap
    nothing.
    """
    keys = ["conversation_id", "segment_index", "word"]
    whole = turns.where("t_end > t_start").select("conversation_id", "turn_index", "t_start", "t_end", "turn_speaker")
    spread = whole.withColumn("_b", F.explode(F.sequence(F.floor(F.col("t_start") / bucket_ms), F.floor((F.col("t_end") - 1) / bucket_ms))))
    # twice the middle is whole
    placed = words.withColumn("_m", F.col("w_start") + F.col("w_end")).withColumn("_b", F.floor(F.col("_m") / (2 * bucket_ms)))
    held = placed.select(*keys, "_m", "_b").join(spread, ["conversation_id", "_b"]).where("_m >= 2 * t_start and _m < 2 * t_end")
    held = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("turn_index", "turn_speaker")).alias("_first"))
    rows = words.join(held, keys, "left").withColumn("turn_speaker", F.col("_first.turn_speaker")).withColumn("_who", F.coalesce("turn_speaker", "speaker"))

    event = lambda t, rank, who, begun, ended: F.struct(t.alias("t"), F.lit(rank).alias("rank"), who.alias("who"), F.lit(begun).alias("begun"), F.lit(ended).alias("ended"))
    none = F.lit(None)
    of_turns = whole.select("conversation_id", none.cast("bigint").alias("segment_index"), none.cast("bigint").alias("word"), F.inline(F.array(event(F.col("t_end"), 0, F.col("turn_speaker"), 0, 1), event(F.col("t_start"), 3, F.col("turn_speaker"), 1, 0))))
    # a word asks behind the ends at its start, and before the starts at its end
    asked = rows.where("w_end > w_start").select("conversation_id", F.col("segment_index").cast("bigint").alias("segment_index"), F.col("word").cast("bigint").alias("word"), F.inline(F.array(event(F.col("w_start"), 1, F.col("_who"), 0, 0), event(F.col("w_end"), 2, F.col("_who"), 0, 0))))
    upto = lambda *by: Window.partitionBy("conversation_id", *by).orderBy("t", "rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda column: F.sum(column).over(upto()) - F.sum(column).over(upto("who"))
    swept = of_turns.unionByName(asked).withColumn("others", F.when(F.col("rank") == 2, count("begun")).otherwise(-count("ended"))).where("rank in (1, 2)")
    crossed = swept.groupBy(*keys).agg((F.sum("others") > 0).alias("_crossed"))
    out = rows.join(crossed, keys, "left")
    return out.withColumn("crosstalk", F.coalesce(F.col("_n") > 1, F.lit(False)) | F.coalesce("_crossed", F.lit(False))).drop("_n", "_first", "_who", "_crossed")


def crosstalk_from_regions(regions: DataFrame, segments: DataFrame, high_ms: int = 1000, bucket_ms: int = 30_000) -> DataFrame:
    """Regions(conversation_id, r_start, r_end) in which at least two speakers are active, with their speakers and intensity."""
    spread = lambda df, s, e: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / bucket_ms), F.floor((F.col(e) - 1) / bucket_ms))))
    met = spread(regions, "r_start", "r_end").join(spread(segments.select("conversation_id", "start_ms", "end_ms", "speaker"), "start_ms", "end_ms"), ["conversation_id", "_b"])
    found = met.where("start_ms < r_end and r_start < end_ms").groupBy("conversation_id", "r_start", "r_end").agg(F.sort_array(F.collect_set("speaker")).alias("s"))
    return found.where(F.size("s") >= 2).select("conversation_id", "r_start", "r_end", F.array_join("s", ",").alias("speakers"), F.when(F.col("r_end") - F.col("r_start") > high_ms, "high").otherwise("low").alias("intensity"))


def reading_paragraphs(segments: DataFrame, sentences: int = 4) -> DataFrame:
    """The sentences of a line in paragraphs of so many."""
    parts = F.filter(F.transform(F.split("text", "[.?!]"), lambda x: F.trim(x)), lambda x: x != "")
    rows = segments.select("conversation_id", "segment_index", F.posexplode(parts).alias("pos", "sentence")).withColumn("paragraph", F.floor(F.col("pos") / sentences))
    found = rows.groupBy("conversation_id", "segment_index", "paragraph").agg(F.sort_array(F.collect_list(F.struct("pos", "sentence"))).alias("x"))
    return found.select("conversation_id", "segment_index", "paragraph", F.array_join(F.transform("x", lambda y: y["sentence"]), ". ").alias("text"))


def evenly_spaced_sample(df: DataFrame, key: str, n: int, bins: int = 4096) -> DataFrame:
    """(key, k): every (rows div n)-th row in the order of a unique numeric key, the first n of them. Null keys are left out.

    Rows are numbered within slices of the key's range; only the counts of the slices are ordered in one task.
    """
    rows = df.where(F.col(key).isNotNull()).select(key)
    edge = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not edge["n"] or n < 1:
        return rows.limit(0).withColumn("k", F.lit(0).cast("long"))
    width = max(1e-300, (edge["hi"] - edge["lo"]) / bins)
    binned = rows.withColumn("_b", F.least(F.lit(bins - 1), F.floor((F.col(key) - edge["lo"]) / width)))
    counts = binned.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))  # a row for each slice
    at = F.row_number().over(Window.partitionBy("_b").orderBy(key)) + F.col("_before") - 1
    step = max(1, edge["n"] // n)
    placed = binned.join(F.broadcast(before), "_b").withColumn("_at", at)  # `bins` rows at most
    return placed.where((F.col("_at") % step == 0) & (F.col("_at") < step * n)).select(key, (F.col("_at") / step + 1).cast("long").alias("k"))


def read_segments(payloads: DataFrame) -> DataFrame:
    """(conversation_id, sector, at, start_ms, end_ms, text, speaker) of JSON payloads(value); `at` is the place in the array, missing times are 0."""
    kind = "conversation_id bigint, sector string, segments array<struct<start_ms:bigint,end_ms:bigint,text:string,speaker:string>>"
    rows = payloads.select(F.from_json("value", kind).alias("p")).select("p.conversation_id", "p.sector", F.posexplode("p.segments").alias("at", "s"))
    return rows.select("conversation_id", "sector", F.col("at").cast("long").alias("at"), F.coalesce("s.start_ms", F.lit(0)).alias("start_ms"), F.coalesce("s.end_ms", F.lit(0)).alias("end_ms"), "s.text", "s.speaker")


def preceding_context(segments: DataFrame, below: float = -0.5) -> DataFrame:
    """The latest confident text before each line of its call."""
    return segments.select(*_KEYS, F.last(F.when(F.col("avg_logprob") >= below, F.col("text")), ignorenulls=True).over(_before()).alias("context"))
