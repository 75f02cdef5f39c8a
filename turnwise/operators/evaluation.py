"""Scores of calls and of decodings: transcription quality, suspicious lines, soft skills, speaker error rate, punctuation of reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions import text as tx
from turnwise.operators import segments as seg

KEYS = ["conversation_id", "segment_index"]


def _clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def transcription_quality(lines: DataFrame) -> DataFrame:
    """(conversation_id, confidence in percent, avg_logprob, avg_no_speech, repetition_risk), weighted by duration.

    lines(dur_ms, avg_logprob, no_speech, compression): missing ones count as -1, 0 and 1.
    """
    w = F.greatest(F.lit(0.1), F.col("dur_ms") / 1000.0)
    mean = lambda x: F.sum(x * w) / F.sum(w)
    found = lines.groupBy("conversation_id").agg(
        mean(F.coalesce("avg_logprob", F.lit(-1.0))).alias("avg_logprob"),
        mean(F.coalesce("no_speech", F.lit(0.0))).alias("avg_no_speech"),
        _clamp(mean(F.greatest(F.lit(0.0), F.coalesce("compression", F.lit(1.0)) - 2.4)) / 1.5).alias("repetition_risk"),
    )
    score = 0.45 * _clamp((F.col("avg_logprob") + 1.8) / 1.4) + 0.40 * _clamp(1 - F.col("avg_no_speech")) + 0.15 * (1 - F.col("repetition_risk"))
    return found.withColumn("confidence", 100 * score)


def suspicious_segments(lines: DataFrame) -> DataFrame:
    """Lines that a decoder has likely made up: silent, doubtful, or too repetitive for their number of words. Rules in their order."""
    w, n = F.col("w"), F.size("w")
    unique = F.size(F.array_distinct(w)) / F.greatest(F.lit(1), n)
    text = F.trim("text")
    said = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    lp, quiet, packed = F.coalesce("avg_logprob", F.lit(-1.0)), F.coalesce("no_speech", F.lit(0.0)), F.coalesce("compression", F.lit(1.0))
    early = (quiet > 0.6) | ((lp < -0.8) & ((packed > 1.8) | (said < 3))) | ((F.char_length(text) > 10) & (n < 2))
    late = ((n >= 12) & (unique < 0.30)) | ((n >= 16) & (tx.repeated_ngram_ratio(w, 3) > 0.35)) | ((n >= 10) & (tx.repeated_ngram_ratio(w, 2) > 0.55))
    late = late | ((packed > 2.0) & ((lp < -0.4) | (quiet > 0.40))) | (F.col("dur_ms") > 60_000)
    flagged = F.when(early, True).when(n < 5, (n >= 2) & (F.size(F.array_distinct(w)) == 1)).otherwise(late)
    return lines.withColumn("w", tx.tokens(F.col("text"))).select(*KEYS, F.coalesce(flagged, F.lit(False)).alias("suspicious"))


def soft_skills(segments: DataFrame, agent: str, phrases: dict[str, list[str]], crisis: DataFrame | None = None, fast: int = 170, weighed: str | None = None) -> DataFrame:
    """(conversation_id, score 0 to 100, wpm, interruptions) of the agent of each call.

    50, plus 10 (to 20), 15 (to 30) and 15 (to 30) for each different phrase of the lists `listening`, `compassion` and `solution`, plus
    the crisis bonus (to 30; crisis holds conversation_id, bonus), less 20 (to 40) for each `defensive` one, 5 (to 20) for each line over
    `fast` words a minute and 8 (to 30) for each interruption. Lines under two characters are left out. `weighed` names a column that says of which lines defensive phrases count.
    """
    lines = segments.where((F.col("speaker") == agent) & (F.char_length(F.trim("text")) >= 2))
    counts = lambda kind: F.col(weighed) if weighed and kind == "defensive" else F.lit(True)
    said = lambda kind: sum((F.max((F.contains(F.lower("text"), F.lit(p.lower())) & counts(kind)).cast("int")) for p in phrases.get(kind, [])), F.lit(0))
    pace = F.floor(F.col("n_words") / F.greatest(F.lit(0.5), F.col("dur_ms") / 1000.0) * 60)
    mine = lines.groupBy("conversation_id").agg(*[said(k).alias(k) for k in ("listening", "compassion", "solution", "defensive")], F.count_if(pace > fast).alias("rushed"), F.floor(F.avg(pace)).alias("wpm"))
    cuts = seg.interruptions(segments, agent).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("interruptions"))
    calls = segments.select("conversation_id").distinct().join(mine, "conversation_id", "left").join(cuts, "conversation_id", "left")
    calls = calls.join(crisis, "conversation_id", "left") if crisis is not None else calls.withColumn("bonus", F.lit(0))
    calls = calls.fillna(0, ["listening", "compassion", "solution", "defensive", "rushed", "wpm", "interruptions", "bonus"])
    up_to = lambda most, x: F.least(F.lit(most), x)
    score = 50 + up_to(20, 10 * F.col("listening")) + up_to(30, 15 * F.col("compassion")) + up_to(30, 15 * F.col("solution")) + up_to(30, F.col("bonus"))
    score = score - up_to(40, 20 * F.col("defensive")) - up_to(20, 5 * F.col("rushed")) - up_to(30, 8 * F.col("interruptions"))
    return calls.select("conversation_id", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long").alias("score"), F.col("wpm").cast("long").alias("wpm"), "interruptions")


def best_pairing(overlap: np.ndarray) -> float:
    """The largest total of a pairing of rows with columns, each used once: the Hungarian method, cubic in the speakers, without a limit.

    Rows enter one after another; each grows a tree of tight columns, by prices kept on both sides, until it meets a free column, and
    the pairs on the way there swap. Overlaps are not negative, so pairing all of the shorter side is best.
    """
    cost = -np.asarray(overlap, float)
    if not cost.size:
        return 0.0
    if cost.shape[0] > cost.shape[1]:
        cost = cost.T
    n, m = cost.shape
    row_price, column_price, of = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)  # column m is where a row enters
    for row in range(n):
        of[m], at = row, m
        gap, came, seen = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while of[at] >= 0:
            seen[at] = True
            now = of[at]
            slack = cost[now] - row_price[now] - column_price[:m]
            closer = ~seen[:m] & (slack < gap)
            gap[closer], came[closer] = slack[closer], at
            best = int(np.where(seen[:m], np.inf, gap).argmin())
            step = gap[best]
            row_price[of[seen]] += step
            column_price[seen] -= step
            gap[~seen[:m]] -= step
            at = best
        while at != m:
            of[at], at = of[came[at]], came[at]
    used = np.flatnonzero(of[:m] >= 0)
    return float(-cost[of[used], used].sum())


def corpus_der(reference: DataFrame, hypothesis: DataFrame, collar_ms: int = 250, bucket_ms: int = 30_000) -> DataFrame:
    """(uri, total, missed, false_alarm, confusion, der): speaker error of each recording, times in milliseconds.

    reference and hypothesis hold (uri, t_start, t_end, speaker). Half a collar on both sides of each reference boundary is left out,
    overlapping speech is kept. Speakers, any number of them, are paired so that most time agrees. Recordings without reference speech have a null rate.
    Spans are cut at every boundary and meet turns in buckets of their recording, so long recordings make no quadratic pairs.
    """
    fine = lambda df: df.where("t_end > t_start and speaker is not null").select("uri", "t_start", "t_end", "speaker").distinct()
    ref, hyp = fine(reference), fine(hypothesis)
    half = collar_ms // 2
    edges = lambda df: df.select("uri", F.explode(F.array("t_start", "t_end")).alias("t"))
    around = edges(ref).distinct().select("uri", F.inline(F.array(F.struct((F.col("t") - half).alias("t"), F.lit(1).alias("d")), F.struct((F.col("t") + half).alias("t"), F.lit(-1).alias("d")))))
    cuts = edges(ref).unionByName(edges(hyp)).withColumn("d", F.lit(0)).unionByName(around).groupBy("uri", "t").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("uri").orderBy("t")
    spans = cuts.withColumn("inside", F.sum("d").over(order)).withColumn("end", F.lead("t").over(order)).where("end is not null and inside = 0 and end > t").select("uri", F.col("t").alias("begin"), "end")
    spread = lambda df, s, e: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / bucket_ms), F.floor((F.col(e) - 1) / bucket_ms))))
    # a span lies within one turn's boundaries or outside it; it meets a turn in the bucket where it begins
    at = spans.withColumn("_b", F.floor(F.col("begin") / bucket_ms))
    active = lambda df, name: at.join(spread(df, "t_start", "t_end"), ["uri", "_b"]).where("t_start <= begin and begin < t_end").select("uri", "begin", "end", F.col("speaker").alias(name)).distinct()
    r, h = active(ref, "r"), active(hyp, "h")
    count = lambda df, name: df.groupBy("uri", "begin", "end").agg(F.count(F.lit(1)).alias(name))
    both = count(r, "nr").join(count(h, "nh"), ["uri", "begin", "end"], "full").fillna(0, ["nr", "nh"]).withColumn("ms", F.col("end") - F.col("begin"))
    sums = both.groupBy("uri").agg(F.sum(F.col("ms") * F.col("nr")).alias("total"), F.sum(F.col("ms") * F.greatest(F.lit(0), F.col("nr") - F.col("nh"))).alias("missed"), F.sum(F.col("ms") * F.greatest(F.lit(0), F.col("nh") - F.col("nr"))).alias("false_alarm"), F.sum(F.col("ms") * F.least("nr", "nh")).alias("paired"))
    met = r.join(h, ["uri", "begin", "end"]).groupBy("uri", "r", "h").agg(F.sum(F.col("end") - F.col("begin")).alias("ms"))

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot(index="r", columns="h", values="ms").fillna(0).to_numpy()
        return pd.DataFrame({"uri": [rows["uri"].iloc[0]], "correct": [int(best_pairing(table))]})

    # a recording's table of speakers by speakers
    found = sums.join(met.groupBy("uri").applyInPandas(pair, "uri string, correct long"), "uri", "left").fillna(0, ["correct"]).withColumn("confusion", F.col("paired") - F.col("correct"))
    return found.select("uri", "total", "missed", "false_alarm", "confusion", F.when(F.col("total") > 0, (F.col("missed") + F.col("false_alarm") + F.col("confusion")) / F.col("total")).alias("der"))


def evaluation_report(scores: DataFrame, rate: str, most: float) -> DataFrame:
    """One row of scores(errors, total, rate): recordings, overall rate (errors over total), plain mean and whether it passes at `most`."""
    found = scores.agg(F.count(F.lit(1)).alias("recordings"), (F.sum("errors") / F.sum("total")).alias("overall"), F.avg(rate).alias("mean"))
    return found.withColumn("passes", F.coalesce(F.col("overall") <= most, F.lit(False)))


def churn_trajectory(chunks: DataFrame) -> DataFrame:
    """(conversation_id, states, deescalated, retention) of chunks(conversation_id, chunk, risk, critical, price): each chunk is critical, price or stable.

    critical from a risk of 0.65 or where flagged, price from 0.40 or where flagged. A call that was not stable and ends so is
    de-escalated. retention falls with the call's last state and highest risk.
    """
    state = F.when((F.col("risk") >= 0.65) | F.col("critical"), "critical").when((F.col("risk") >= 0.40) | F.col("price"), "price").otherwise("stable")
    calls = chunks.groupBy("conversation_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", state.alias("s")))), lambda x: x["s"]).alias("states"), F.max("risk").alias("worst"))
    last = F.element_at("states", -1)
    calmed = (last == "stable") & F.exists(F.slice("states", 1, F.size("states") - 1), lambda s: s != "stable")
    retention = F.when(last == "critical", F.greatest(F.lit(20.0), 100 - F.col("worst") * 70)).when(last == "price", F.greatest(F.lit(50.0), 100 - F.col("worst") * 40)).otherwise(100.0)
    return calls.select("conversation_id", F.array_join("states", ",").alias("states"), calmed.alias("deescalated"), retention.alias("retention"))


def crm_note(scores: DataFrame, least_chars: int = 10) -> DataFrame:
    """(conversation_id, facet, label): the best label of each facet, from scores(conversation_id, facet, label, score, n_chars); `unknown` for texts too short."""
    best = scores.groupBy("conversation_id", "facet").agg(F.max("n_chars").alias("n"), F.min(F.struct((-F.col("score")).alias("s"), "label")).alias("m"))
    return best.select("conversation_id", "facet", F.when(F.col("n") < least_chars, "unknown").otherwise(F.col("m.label")).alias("label"))
