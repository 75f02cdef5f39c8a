"""Operators over decoded lines and whole calls: gates, guards, scores, violations, pairings, speaker-turn files."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from turnwise.functions import text as tx
from turnwise.sources.scratch import scratch_folder

EMOTIONS = ["angry", "frustrated", "satisfied", "anxious", "neutral"]
KEYS = ["conversation_id", "segment_index"]


def _order():
    return Window.partitionBy("conversation_id").orderBy("segment_index")


def holds_any(text: Column, phrases: list[str]) -> Column:
    """Whether the lower-cased text holds one of the phrases."""
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower(text), p))


def decoder_gate(lines: DataFrame, artifacts: list[str] = ()) -> DataFrame:
    """Lines marked dropped: likely silence, doubtful and repetitive, or a known artifact pattern."""
    gone = (F.col("no_speech") > 0.6) | ((F.col("avg_logprob") < -0.8) & (F.col("compression") > 1.8))
    for pattern in artifacts:
        gone = gone | F.col("text").rlike(pattern)
    return lines.select(*KEYS, F.coalesce(gone, F.lit(False)).alias("dropped"))


def retention_expired(files: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Keys of the files last changed over so many hours before `as_of`."""
    return files.where(F.col("modified_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))).select("file_id")


def accept_rescue(old: DataFrame, new: DataFrame, doubtful: float = -0.5, gain: float = 0.1) -> DataFrame:
    """Whether a line's new decoding replaces the old: clearly likelier than a doubtful one, or no less likely with fewer suspect words."""
    better = (F.col("avg_logprob") < doubtful) & (F.col("new_logprob") >= F.col("avg_logprob") + gain)
    cleaner = (F.col("new_logprob") >= F.col("avg_logprob")) & (F.col("new_suspects") < F.col("suspects"))
    return old.join(new, KEYS).select(*KEYS, F.coalesce(better | cleaner, F.lit(False)).alias("accepted"))


def semantic_role_guard(segments: DataFrame, agent: str, customer: str, agent_phrases: list[str], customer_phrases: list[str], least_ms: int = 200) -> DataFrame:
    """A line with strong phrases of one role only goes to that role; it interrupts if it starts before another's line has ended."""
    a, c = holds_any(F.col("text"), agent_phrases), holds_any(F.col("text"), customer_phrases)
    fixed = F.when((F.col("speaker") == customer) & a & ~c, agent).when((F.col("speaker") == agent) & c & ~a, customer).otherwise(F.col("speaker"))
    rows = segments.withColumn("fixed", fixed)
    cuts = (F.col("start_ms") < F.lag("end_ms").over(_order()) - least_ms) & (F.col("fixed") != F.lag("fixed").over(_order()))
    return rows.select(*KEYS, F.col("fixed").alias("speaker"), (F.col("fixed") != F.col("speaker")).alias("flipped"), F.coalesce(cuts, F.lit(False)).alias("interrupts"))


def discourse_metrics(segments: DataFrame, interruptions: DataFrame, phrases: dict[str, list[str]]) -> DataFrame:
    """First-contact resolution (0 to 100), customer effort (1 to 5) and adherence (0 to 100) of each call.

    phrases has lists `positive`, `negative`, `effort`, `greeting`, `notice` and `closing`, matched in the call's joined text.
    """
    lines = F.sort_array(F.collect_list(F.struct("segment_index", "text")))
    calls = segments.groupBy("conversation_id").agg(F.lower(F.array_join(F.transform(lines, lambda x: x["text"]), " ")).alias("t"), F.count(F.lit(1)).alias("n"))
    cut = interruptions.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("cuts"))
    found = lambda kind: sum((F.contains("t", F.lit(p)).cast("int") for p in phrases[kind]), F.lit(0))
    any_of = lambda kind: (found(kind) > 0).cast("int")
    clamp = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    fcr = clamp(70.0 + 15.0 * found("positive") - 25.0 * found("negative"), 0.0, 100.0)
    ces = clamp(1.0 + 1.5 * found("effort") + F.when(F.coalesce("cuts", F.lit(0)) / F.col("n") > 0.15, 1.0).otherwise(0.0), 1.0, 5.0)
    adherence = 34 * any_of("greeting") + 33 * any_of("notice") + 33 * any_of("closing")
    out = calls.join(cut, "conversation_id", "left").select("conversation_id", fcr.alias("fcr"), ces.alias("ces"), adherence.alias("adherence"))
    return out.withColumn("status", F.when(F.col("fcr") >= 75, "resolved").when(F.col("fcr") <= 40, "unresolved").otherwise("pending"))


def prefix_hits(text: Column, term: str, excluded: list[str]) -> Column:
    """How many words begin with the term and with none of the excluded longer prefixes."""
    return F.size(F.filter(tx.tokens(text), lambda t: F.startswith(t, F.lit(term)) & ~F.exists(F.array(*[F.lit(x) for x in excluded]), lambda x: F.startswith(t, x)))).cast("long")


def score_texts(df: DataFrame, keys: list[str], lexicon: dict[str, list[str]]) -> DataFrame:
    """(keys, label, score): the share of a text's words in each label's list. Any model that returns these columns can stand in."""
    words = df.select(*keys, tx.tokens(F.col("text")).alias("w"))
    share = lambda listed: F.size(F.filter("w", lambda t: t.isin(listed))) / F.greatest(F.lit(1), F.size("w"))
    return words.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("label"), share(v).alias("score")) for k, v in lexicon.items()])))


def emotion_scores(scores: DataFrame) -> DataFrame:
    """Five emotions that sum to 1, sentiment and the strongest emotion (the first on ties) from shares labelled positive and negative."""
    one = lambda label: F.max(F.when(F.col("label") == label, F.col("score")))
    rows = scores.groupBy(*KEYS).agg(one("positive").alias("pos"), one("negative").alias("neg")).withColumn("neu", 1 - F.col("pos") - F.col("neg"))
    raw = [F.col("neg") * 0.45, F.col("neg") * 0.35, F.col("pos"), F.col("neg") * 0.2, F.col("neu")]
    total = raw[0] + raw[1] + raw[2] + raw[3] + raw[4]
    rows = rows.select(*KEYS, *[(r / total).alias(n) for r, n in zip(raw, EMOTIONS, strict=True)], (F.col("pos") - F.col("neg")).alias("sentiment"))
    top, pick = F.greatest(*EMOTIONS), F.lit("neutral")
    for n in reversed(EMOTIONS):
        pick = F.when(F.col(n) == top, n).otherwise(pick)
    return rows.select(*KEYS, *[F.round(n, 6).alias(n) for n in EMOTIONS], F.round("sentiment", 6).alias("sentiment"), pick.alias("category"))


def latest_emotion(emotions: DataFrame) -> DataFrame:
    """The emotion of each call's last line."""
    return emotions.groupBy("conversation_id").agg(F.max_by("category", "segment_index").alias("emotion"))


def negativity_band(positive: Column, negative: Column) -> Column:
    return F.when((negative > 0.7) & (negative > positive), "high").when(negative > 0.5, "medium").otherwise("low")


def separation_reliable(calls: DataFrame, methods: list[str]) -> DataFrame:
    """Whether a call's two roles are known, differ, and come from a trusted method."""
    fine = F.col("agent").isNotNull() & F.col("customer").isNotNull() & (F.col("agent") != F.col("customer")) & F.col("method").isin(methods)
    return calls.select("conversation_id", F.coalesce(fine, F.lit(False)).alias("reliable"))


def negated(text: Column, phrase: Column, negators: list[str], chars: int = 50) -> Column:
    """Whether a negator stands as a word within so many characters of the phrase's first place; cut words count whole."""
    at = F.instr(text, phrase)
    left = F.regexp_extract(F.substring(text, F.lit(1), at - 1), rf"(?s)(\S*.{{0,{chars}}})\z", 1)  # $ would leave a last line break out
    right = F.regexp_extract(F.substring(text, at + F.length(phrase), F.length(text)), rf"(?s)^(.{{0,{chars}}}\S*)", 1)
    return F.arrays_overlap(tx.tokens(F.concat_ws(" ", left, right)), F.array(*[F.lit(n) for n in negators]))


def compliance_violations(segments: DataFrame, agent: str, patterns: list[tuple[str, str, str | None]], negators: list[str]) -> DataFrame:
    """The first (name, phrase, sector or None) of the list, those of the line's sector before general ones, that an agent's line holds without negation."""
    ordered = sorted(patterns, key=lambda p: p[2] is None)
    lines = segments.where(F.col("speaker") == agent).select(*KEYS, "sector", F.lower("text").alias("t"))
    pick = F.lit(None).cast("string")
    for name, phrase, sector in reversed(ordered):
        hit = F.contains("t", F.lit(phrase)) & ~negated(F.col("t"), F.lit(phrase), negators)
        pick = F.when(hit if sector is None else hit & (F.col("sector") == sector), name).otherwise(pick)
    return lines.select(*KEYS, pick.alias("violation")).where("violation is not null").withColumn("severity", F.lit("CRITICAL"))


def crisis_bonus(segments: DataFrame, bonus: int = 15) -> DataFrame:
    """Points of a call: once for each angry customer line that a positive agent line follows before the next angry one."""
    rows = segments.withColumn("event", F.sum(F.col("angry").cast("long")).over(_order())).where("event > 0 and positive")
    return rows.groupBy("conversation_id").agg((bonus * F.count_distinct("event")).alias("bonus"))


def prompt_echo(docs: DataFrame, prompts: DataFrame, stop: list[str], n: int = 5) -> DataFrame:
    """Documents that hold a run of n words of a prompt, stop words left out. Spark broadcasts the prompts only where they are small."""
    words = lambda: F.filter(tx.tokens(F.col("text")), lambda t: ~t.isin(stop))
    runs = lambda df, *keys: df.select(*keys, F.explode(F.array_distinct(tx.ngrams(words(), n))).alias("run"))
    return runs(docs, "doc_id").join(runs(prompts).distinct(), "run", "left_semi").select("doc_id").distinct()


def prompt_overlap(docs: DataFrame, prompts: DataFrame, stop: list[str], least_words: int = 5, ratio: float = 0.6) -> DataFrame:
    """(doc_id, prompt_id, words, matched) of the texts most of whose words are a prompt's: `least_words` of them at least, and at least `ratio` of all.

    Words are counted as often as they stand in the text, stop words left out. A text that matches lacks at most (1 - ratio) of its
    words, so of one word more than that, taken in an order, the prompt has at least one: texts meet prompts by those words only, the ones
    that fewest prompts have, and pairs that meet are counted out. Words without a prompt come first in that order and need no
    join; texts that have too many of them are left out at once, by two counts a text, and only the others are stored and move. Null texts
    match nothing; rows of docs(doc_id, text) that are equal count once.
    """
    words = lambda: F.filter(tx.tokens(F.col("text")), lambda t: ~t.isin(stop))
    listed = prompts.select("prompt_id", F.array_distinct(words()).alias("have")).where("size(have) > 0").dropDuplicates()
    common = listed.select(F.explode("have").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    lack = F.floor(F.col("size") * (1 - ratio) + 1e-9)
    texts = docs.where("text is not null").select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    said = texts.select("key", words().alias("w")).where(F.size("w") >= least_words).select("key", F.size("w").alias("size"), F.posexplode("w").alias("at", "word"))
    known = said.join(common, "word", "left").groupBy("key", "size").agg(F.count_if(F.col("at") == 0).alias("rows"), F.count("n").alias("known"))
    able = known.where((F.col("known") >= least_words * F.col("rows")) & (F.col("size") * F.col("rows") - F.col("known") <= lack * F.col("rows")))
    folder = scratch_folder(docs.sparkSession, "overlap")
    able.select("key").distinct().write.parquet(f"{folder}/able")
    few = texts.join(docs.sparkSession.read.parquet(f"{folder}/able"), "key", "left_semi").distinct().withColumn("w", words()).withColumn("size", F.size("w"))
    few.select("doc_id", "key", "w", lack.alias("lack")).write.parquet(f"{folder}/texts")
    text = docs.sparkSession.read.parquet(f"{folder}/texts")
    spoken = text.select("key", "lack", F.explode("w").alias("word")).groupBy("key", "lack", "word").agg(F.count(F.lit(1)).alias("times"))
    known = spoken.join(common, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = Window.partitionBy("key").orderBy("n", "word").rowsBetween(Window.unboundedPreceding, -1)
    probes = known.withColumn("before", F.coalesce(F.sum("times").over(before), F.lit(0))).where("before <= lack and n > 0").select("key", "word")
    pairs = probes.join(listed.select("prompt_id", F.explode("have").alias("word")), "word").select("key", "prompt_id").distinct()
    met = pairs.join(text, "key").join(listed, "prompt_id")
    counted = met.select("doc_id", "prompt_id", F.size("w").cast("long").alias("words"), F.size(F.filter("w", lambda t: F.array_contains("have", t))).cast("long").alias("matched"))
    return counted.where((F.col("matched") >= least_words) & (F.col("matched") >= ratio * F.col("words") - 1e-9)).distinct()


def echoes(docs: DataFrame, prompts: DataFrame, stop: list[str]) -> DataFrame:
    """Documents that echo one of prompts(prompt_id, text): by a run of five of its words, or by most of their words being its."""
    return prompt_echo(docs, prompts, stop).unionByName(prompt_overlap(docs, prompts, stop).select("doc_id")).distinct()


def write_rttm(turns: DataFrame) -> DataFrame:
    """A speaker-turn line for each turn of positive length."""
    seconds = lambda ms: F.format_string("%.3f", ms / 1000.0)
    line = F.concat_ws(" ", F.lit("SPEAKER"), F.col("uri"), F.lit("1"), seconds(F.col("t_start")), seconds(F.col("t_end") - F.col("t_start")), F.lit("<NA> <NA>"), F.col("speaker"), F.lit("<NA> <NA>"))
    return turns.where("t_end > t_start").select("uri", line.alias("value"))


def read_rttm(lines: DataFrame) -> DataFrame:
    """Turns (uri, start, duration, speaker; seconds) of speaker-turn lines; other lines and those without a positive length go."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.startswith("value", F.lit("SPEAKER "))).select(F.get(p, 1).alias("uri"), F.get(p, 3).try_cast("double").alias("start"), F.get(p, 4).try_cast("double").alias("duration"), F.get(p, 7).alias("speaker"))
    return rows.where("start is not null and duration > 0 and speaker is not null")


def pair_audio_reference(recordings: DataFrame, references: DataFrame, extensions: tuple[str, ...] = ("wav", "mp3", "flac", "m4a")) -> DataFrame:
    """The recording of each reference, by stem, the first of the extensions; null where there is none."""
    rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    best = recordings.select(F.regexp_replace("name", r"\.[^.]+$", "").alias("stem"), rank.alias("rank"), "name").where("rank > 0").groupBy("stem").agg(F.min(F.struct("rank", "name")).alias("m"))
    return references.join(best, "stem", "left").select("stem", F.col("m.name").alias("audio"))


def segment_keys(segments: DataFrame, hits: DataFrame) -> DataFrame:
    """Each line with its stored key and its number of hits, the rows that an analysis writes."""
    n = hits.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    key = F.sha2(F.concat_ws(":", "conversation_id", "segment_index"), 256)
    return segments.select(*KEYS).join(n, KEYS, "left").select(*KEYS, key.alias("segment_id"), F.coalesce("n", F.lit(0)).alias("hits"))


def merge_reviewed(rows: DataFrame) -> DataFrame:
    """Lines that a person has corrected and left with text."""
    return rows.where(F.col("corrected") & (F.length(F.trim("text")) > 0))


def churn_chunks(segments: DataFrame, customer: str, agent_phrases: list[str], listed: list[str], anchors: list[str], lines: int = 5, fast: tuple[float, float] = (190, 1.4), brisk: tuple[float, float] = (160, 1.2)) -> DataFrame:
    """Risk of each block of a customer's lines: share of listed words, raised by speech rate and place in the call, cut to a tenth without an anchor.

    Lines under 3 characters or with an agent's phrase are left out. A last block of fewer lines counts only if the call ends in it.
    """
    place = F.row_number().over(_order()) - 1
    rows = segments.withColumn("at", place).withColumn("last", F.count(F.lit(1)).over(Window.partitionBy("conversation_id")) - 1)
    kept = rows.where((F.col("speaker") == customer) & (F.length(F.trim("text")) >= 3) & ~holds_any(F.col("text"), agent_phrases))
    kept = kept.withColumn("chunk", F.floor((F.row_number().over(_order()) - 1) / lines)).withColumn("w", tx.tokens(F.col("text")))
    hit = F.size(F.filter("w", lambda t: t.isin(listed)))
    found = kept.groupBy("conversation_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"), F.max("last").alias("last"), F.avg(tx.wpm(F.col("n_words"), F.col("dur_ms"))).alias("wpm"), F.sum(hit).alias("hits"), F.sum(F.size("w")).alias("words"), F.max(holds_any(F.col("text"), anchors)).alias("anchored"))
    found = found.where((F.col("n") == lines) | (F.col("at") == F.col("last")))
    weight = 1.0 + 0.5 * F.col("at") / F.greatest(F.lit(1), "last")
    pace = F.when(F.col("wpm") > fast[0], fast[1]).when(F.col("wpm") > brisk[0], brisk[1]).otherwise(1.0)
    found = found.withColumn("weight", weight).withColumn("risk", F.least(F.lit(1.0), F.col("hits") / F.greatest(F.lit(1), "words") * pace * F.col("weight")))
    return found.select("conversation_id", "chunk", "wpm", "weight", F.when(~F.col("anchored") & (F.col("risk") < 0.85), F.col("risk") * 0.1).otherwise(F.col("risk")).alias("risk"))


def churn_risk(chunks: DataFrame, competitors: DataFrame, alarm: float = 0.75) -> DataFrame:
    """A call's risk: 0.65 of its worst block and 0.35 of the weighted mean, with up to 0.2 more for competitors named; alarm and confidence."""
    found = chunks.groupBy("conversation_id").agg((0.65 * F.max("risk") + 0.35 * F.sum(F.col("risk") * F.col("weight")) / F.sum("weight")).alias("r"), F.count(F.lit(1)).alias("chunks"))
    more = F.when(F.col("r") > 0.3, F.least(F.lit(0.2), 0.1 * F.coalesce("named", F.lit(0)))).otherwise(0.0)
    risk = F.least(F.lit(1.0), F.col("r") + more)
    out = found.join(competitors, "conversation_id", "left").select("conversation_id", "chunks", F.round(risk, 6).alias("risk"), (risk >= alarm).alias("alarm"))
    return out.withColumn("confidence", F.when(F.col("chunks") >= 4, "high").when(F.col("chunks") >= 2, "medium").otherwise("low"))


def executive_summary(docs: DataFrame, sentences: int = 2) -> DataFrame:
    """The sentences with most of the text's frequent words (of 4 letters or more), in their order; short texts whole.

    A text is scored where it lies, so nothing is shuffled.
    """
    parts = F.filter(F.transform(F.split("text", "[.?!]"), lambda x: F.trim(x)), lambda x: x != "")
    words = F.transform(parts, lambda x: F.filter(tx.tokens(x), lambda t: F.length(t) >= 4))
    rows = docs.where("text is not null").select("doc_id", "text", words.alias("w")).where("size(w) > 0")
    schema = T.StructType([rows.schema["doc_id"], rows.schema["text"], T.StructField("top", T.ArrayType(T.IntegerType()))])
    top = rows.mapInArrow(lambda batches: _best_sentences(batches, sentences), schema)
    chosen = top.withColumn("parts", parts).withColumn("summary", F.array_join(F.transform("top", lambda i: F.get("parts", i)), ". "))
    return chosen.select("doc_id", F.when(F.size("parts") <= sentences, F.col("text")).otherwise(F.col("summary")).alias("summary"))


def _best_sentences(batches: Iterable[pa.RecordBatch], sentences: int) -> Iterable[pa.RecordBatch]:
    """doc_id, text and the places, from 0, of the sentences of highest score; w holds the words of each sentence. A few texts are worked on at once."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 64):
            some = batch.slice(begin, 64)
            per_text = some.column("w").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            spoken = some.column("w").flatten()
            per_sentence = spoken.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            codes = spoken.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.repeat(np.arange(len(per_text)), per_text)
            sentence = np.repeat(np.arange(len(per_sentence)), per_sentence)
            _, place, times = np.unique(text[sentence] * (codes.max(initial=0) + 1) + codes, return_inverse=True, return_counts=True)
            total = np.bincount(sentence, weights=times[place], minlength=len(per_sentence))
            score = np.round(total / np.sqrt(np.maximum(1, per_sentence)), 9)
            start = np.cumsum(per_text) - per_text
            best = np.lexsort((np.arange(len(text)), -score, text))
            best = np.sort(best[np.arange(len(text)) - start[text] < sentences])
            offsets = np.concatenate([[0], np.cumsum(np.minimum(per_text, sentences))]).astype(np.int32)
            top = pa.ListArray.from_arrays(pa.array(offsets), pa.array((best - start[text[best]]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text"), top], names=["doc_id", "text", "top"])


def competitors(docs: DataFrame, names: list[str], own: list[str]) -> DataFrame:
    """(doc_id, name): names that a text holds as a word, or, from 5 letters on, within one edit; own words do not count."""
    words = docs.select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("t")).where(~F.col("t").isin(own))
    near = lambda n: (F.col("t") == n) | (F.levenshtein(F.col("t"), F.lit(n), 1) >= 0 if len(n) >= 5 else F.lit(False))
    found = words.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(near(n), n) for n in names]))).alias("name"))
    return found.distinct()


def mix_and_holdout(rows: DataFrame, seed: int, ratio: int, holdout: float) -> DataFrame:
    """rows(key, queue): all reviewed rows, a keyed share of them held out, and at most `ratio` times as many automatic ones, those of smallest keyed hash.

    Only the counts of 65,536 hash prefixes meet in one task; the exact cut is made inside the one prefix where it falls.
    """
    hashed = rows.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("key").cast("string")))).withColumn("p", F.substring("h", 1, 4))
    reviewed, auto = hashed.where("queue = 'review'"), hashed.where("queue = 'auto'")
    counts = auto.groupBy("p").agg(F.count(F.lit(1)).alias("n")).crossJoin(reviewed.agg((ratio * F.count(F.lit(1))).alias("cap")))
    cuts = counts.withColumn("before", F.sum("n").over(Window.orderBy("p")) - F.col("n")).where("before < cap")
    met = auto.join(cuts, "p")
    whole, cut = met.where("before + n <= cap"), met.where("before + n > cap")
    cut = cut.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("h", "key"))).where("before + k <= cap")
    part = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / float(1 << 32)
    kept = reviewed.select("key", F.when(part < holdout, "holdout").otherwise("train").alias("split"))
    return kept.unionByName(whole.unionByName(cut.drop("k")).select("key", F.lit("train").alias("split")))


def best_hypothesis(rows: DataFrame) -> DataFrame:
    """The profile with the highest score of each recording: confidence, less 4 a filtered line, plus words (at most 160) / 80, 3 x coverage and 2 x quality."""
    score = F.col("confidence") - 4 * F.col("filtered") + F.least(F.lit(160), "n_words") / 80 + 3 * F.col("coverage") + 2 * F.col("quality")
    scored = rows.withColumn("score", F.round(score, 6))
    best = scored.groupBy("recording_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "profile")).alias("m"))
    return best.select("recording_id", F.col("m.profile").alias("profile"), (-F.col("m.s")).alias("score"))


def offset_words(words: Column, offset: Column) -> Column:
    """An array of struct(word, start, end), in seconds, shifted; times rounded to milliseconds."""
    return F.transform(words, lambda w: F.struct(w["word"].alias("word"), F.round(w["start"] + offset, 3).alias("start"), F.round(w["end"] + offset, 3).alias("end")))


def correct_terms(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Patterns replaced in their order; counts the replacements and keeps raw_text where the text has changed, else empty."""
    out = df.withColumn("raw_text", F.col("text")).withColumn("n_changes", F.lit(0).cast("long"))
    for pattern, to in rules:
        out = out.withColumn("n_changes", F.col("n_changes") + F.regexp_count("text", F.lit(pattern))).withColumn("text", F.regexp_replace("text", pattern, to))
    return out.withColumn("raw_text", F.when(F.col("raw_text") != F.col("text"), F.col("raw_text")).otherwise(""))


def crosstalk_eligible(events: DataFrame, least_ms: int = 300) -> DataFrame:
    """Overlaps long enough to separate, each separated text beside its speaker; texts beyond the speakers are named stream_n, from 1."""
    pairs = F.transform("texts", lambda t, i: F.struct(F.coalesce(F.get("speakers", i), F.concat(F.lit("stream_"), i + 1)).alias("speaker"), t.alias("text")))
    return events.where(F.col("t_end") - F.col("t_start") >= least_ms).select("event_id", F.inline(pairs))
