"""Rules over a call's lines that depend on what was kept or changed before: folds in JVM functions, a call at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.operators.segments import sequential_scan

KEYS = ["conversation_id", "segment_index"]


def verify_short_turns(segments: DataFrame, short: list[str], first: str, second: str) -> DataFrame:
    """(keys, speaker, corrected): an acknowledgement of the speaker of both neighbours goes to the other one; the next line sees the change."""
    said = F.regexp_replace(F.trim(F.lower("text")), r"[.?!,]+$", "")
    nxt = F.lead("speaker").over(Window.partitionBy("conversation_id").orderBy("segment_index"))
    rows = segments.select(*KEYS, "speaker", said.isin(short).alias("is_short"), nxt.alias("ns"))
    empty = F.array().cast("array<struct<segment_index:bigint,speaker:string,corrected:boolean>>")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))["speaker"]
        flip = F.coalesce(x["is_short"] & (last == x["ns"]) & (last == x["speaker"]), F.lit(False))
        other = F.when(x["speaker"] == first, second).otherwise(first)
        return F.concat(acc, F.array(F.struct(x["segment_index"].alias("segment_index"), F.when(flip, other).otherwise(x["speaker"]).alias("speaker"), flip.alias("corrected"))))

    return sequential_scan(rows, ["conversation_id"], ["segment_index"], empty, step)


def dedup_asr(segments: DataFrame, backchannels: list[str]) -> DataFrame:
    """(keys) of the lines that are no decoder loop: a speaker's line against the last one kept of theirs.

    Equal texts count a streak. An acknowledgement (listed, or of one word) repeats within 1.2 s, or from the third time within 6 s;
    other lines within 3 s, or from the second time within 10 s; a line of up to four words that holds or is held by the last one
    within 0.8 s. Lines without letters or digits go.
    """
    norm = F.trim(F.regexp_replace(F.lower("text"), r"(?U)[^\w\s]", ""))
    rows = segments.select(*KEYS, F.coalesce("speaker", F.lit("default")).alias("spk"), "start_ms", "end_ms", norm.alias("t")).where("t <> ''")
    rows = rows.withColumn("n", F.size(F.split("t", r"\s+"))).withColumn("back", F.col("t").isin(backchannels) | (F.col("n") <= 1))
    empty = F.struct(F.array().cast("array<struct<segment_index:bigint>>").alias("out"), F.lit(None).cast("bigint").alias("end"), F.lit(None).cast("string").alias("t"), F.lit(0).alias("streak"))

    def step(acc, x):
        gap = x["start_ms"] - acc["end"]
        same = F.coalesce(x["t"] == acc["t"], F.lit(False))
        streak = F.when(same, acc["streak"] + 1).when(acc["t"].isNull(), acc["streak"]).otherwise(0)
        loop = F.when(x["back"], (gap < 1200) | ((streak >= 3) & (gap < 6000))).otherwise((gap < 3000) | ((streak >= 2) & (gap < 10_000)))
        part = ~x["back"] & (x["n"] <= 4) & (F.contains(acc["t"], x["t"]) | F.contains(x["t"], acc["t"])) & (gap < 800)
        drop = F.coalesce(F.when(same, loop).otherwise(part), F.lit(False))
        kept = F.concat(acc["out"], F.array(F.struct(x["segment_index"].alias("segment_index"))))
        return F.struct(F.when(drop, acc["out"]).otherwise(kept).alias("out"), F.when(drop, acc["end"]).otherwise(x["end_ms"]).alias("end"), F.when(drop, acc["t"]).otherwise(x["t"]).alias("t"), streak.alias("streak"))

    row = F.struct("segment_index", "start_ms", "end_ms", "t", "n", "back")
    # a speaker of a call is one group, so its lines bound what a task holds
    folded = rows.groupBy("conversation_id", "spk").agg(F.sort_array(F.collect_list(row)).alias("rows")).select("conversation_id", F.aggregate("rows", empty, step)["out"].alias("out"))
    return folded.select("conversation_id", F.inline("out"))


def drop_overlaps(segments: DataFrame, least_ms: int = 1000, long_ms: int = 12_000) -> DataFrame:
    """(keys) of the lines that stay: of two that follow each other and overlap by a second, one over 12 s and three times the other's length goes."""
    rows = segments.select(*KEYS, "start_ms", "end_ms")
    kind = "struct<segment_index:bigint,start_ms:bigint,end_ms:bigint>"
    empty = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(None).cast(kind).alias("held"))

    def step(acc, x):
        held = acc["held"]
        overlap = F.least(held["end_ms"], x["end_ms"]) - F.greatest(held["start_ms"], x["start_ms"])
        length = lambda s: F.greatest(F.lit(0).cast("bigint"), s["end_ms"] - s["start_ms"])
        longer = lambda a, b: held.isNotNull() & (overlap >= least_ms) & (length(a) > F.greatest(F.lit(long_ms).cast("bigint"), 3 * length(b)))
        now = F.struct(*[x[c].alias(c) for c in ("segment_index", "start_ms", "end_ms")])
        drop_held, drop_now = F.coalesce(longer(held, x), F.lit(False)), F.coalesce(longer(x, held), F.lit(False))
        out = F.when(held.isNull() | drop_held | drop_now, acc["out"]).otherwise(F.concat(acc["out"], F.array(held)))
        return F.struct(out.alias("out"), F.when(drop_now & ~drop_held, held).otherwise(now).alias("held"))

    row = F.struct("segment_index", "start_ms", "end_ms")
    folded = rows.groupBy("conversation_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).select("conversation_id", F.aggregate("rows", empty, step).alias("x"))
    return folded.select("conversation_id", F.inline(F.array_compact(F.concat("x.out", F.array("x.held"))))).select(*KEYS)


def split_sentences(segments: DataFrame, least_ms: int = 2500) -> DataFrame:
    """(keys, part, start_ms, end_ms, text): lines over 2.5 s cut behind . ? ! and ;, each sentence's time in proportion to its characters.

    Ends are rounded to hundredths of a second and carried on; the last sentence ends with its line. Blank lines go.
    """
    parts = F.filter(F.transform(F.split(F.trim("text"), r"(?<=[.?!;])\s+", -1), F.trim), lambda s: s != "")
    rows = segments.where(F.trim("text") != "").select(*KEYS, "start_ms", "end_ms", "text", parts.alias("p"))
    whole = (F.size("p") <= 1) | (F.col("end_ms") - F.col("start_ms") <= least_ms)
    total = F.aggregate("p", F.lit(0), lambda a, s: a + F.char_length(s))
    start = F.struct(F.col("start_ms").cast("bigint").alias("at"), F.array().cast("array<struct<part:int,start_ms:bigint,end_ms:bigint,text:string>>").alias("out"))

    def step(acc, s):
        k = F.size(acc["out"])
        exact = acc["at"] + F.greatest(F.lit(100), F.col("end_ms") - F.col("start_ms")) * F.char_length(s) / total
        end = F.when(k == F.size("p") - 1, F.col("end_ms")).otherwise(F.round(exact / 10.0).cast("bigint") * 10)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(k.alias("part"), acc["at"].alias("start_ms"), end.alias("end_ms"), s.alias("text")))).alias("out"))

    one = F.array(F.struct(F.lit(0).alias("part"), F.col("start_ms").cast("bigint").alias("start_ms"), F.col("end_ms").cast("bigint").alias("end_ms"), F.col("text").alias("text")))
    return rows.select(*KEYS, F.inline(F.when(whole, one).otherwise(F.aggregate("p", start, step)["out"])))


def live_coaching(chunks: DataFrame, escalation: list[str], consent: list[str], after_s: float = 15.0) -> DataFrame:
    """(session_id, chunk, alert) of chunks(session_id, chunk, text, elapsed_s, is_interruption), one alert a chunk at most.

    escalation:phrase once for each listed phrase, the first of the list in the chunk; interruption at the second one, once; consent
    once, where none of the consent phrases was said until `after_s`. A chunk with an earlier alert is not searched for consent.
    """
    said = lambda listed, x: F.filter(F.array(*[F.lit(p) for p in listed]), lambda p: F.contains(x["t"], p))
    rows = chunks.where("text <> ''").select("session_id", "chunk", F.trim(F.lower("text")).alias("t"), "elapsed_s", F.coalesce("is_interruption", F.lit(False)).alias("cut"))
    empty = F.struct(F.array().cast("array<struct<chunk:bigint,alert:string>>").alias("out"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("cuts"), F.lit(False).alias("consent"))

    def step(acc, x):
        fresh = F.try_element_at(F.filter(said(escalation, x), lambda p: ~F.array_contains(acc["seen"], p)), F.lit(1))
        cuts = acc["cuts"] + F.when(fresh.isNull() & x["cut"], 1).otherwise(0)
        warned = fresh.isNull() & x["cut"] & (cuts >= 2) & ~F.array_contains(acc["seen"], "interruption")
        early = fresh.isNotNull() | warned
        agreed = acc["consent"] | (~early & (F.size(said(consent, x)) > 0))
        remind = ~early & (x["elapsed_s"] > after_s) & ~agreed & ~F.array_contains(acc["seen"], "consent")
        mark = F.coalesce(fresh, F.when(warned, "interruption").when(remind, "consent"))
        alert = F.when(fresh.isNotNull(), F.concat(F.lit("escalation:"), fresh)).otherwise(mark)
        out = F.when(mark.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(x["chunk"].alias("chunk"), alert.alias("alert")))))
        seen = F.when(mark.isNull(), acc["seen"]).otherwise(F.concat(acc["seen"], F.array(mark)))
        return F.struct(out.alias("out"), seen.alias("seen"), cuts.alias("cuts"), agreed.alias("consent"))

    row = F.struct("chunk", "t", "elapsed_s", "cut")
    folded = rows.groupBy("session_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).select("session_id", F.aggregate("rows", empty, step)["out"].alias("out"))
    return folded.select("session_id", F.inline("out"))
