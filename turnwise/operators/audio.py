"""Line quality, levels, bleed and turns from frame energies of two-channel recordings.

Frames hold (recording_id, channel, frame, energy, peak, n_samples, n_clipped, n_silent); energy is the mean square of samples in -1..1,
and frames of a recording have equal lengths but for the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ZERO = 1e-7


def line_quality_mos(frames: DataFrame, gap_frames: int = 10) -> DataFrame:
    """(recording_id, channel, mos, grade, snr_db, clipping_pct, dropout_pct, alert) from 1 to 5, of each channel.

    The signal-to-noise ratio compares the louder half of the frames that are not digital zero with their quietest 15 %, from four of them
    on; dropouts are runs of at most `gap_frames` zero frames between others. A channel is ordered in one task.
    """
    by = ["recording_id", "channel"]
    active = F.col("energy") >= ZERO
    loud = frames.where(active).select(*by, "energy", F.row_number().over(Window.partitionBy(*by).orderBy("energy", "frame")).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("n"))
    noise, speech = F.greatest(F.lit(1), F.floor(F.col("n") * 0.15)), F.greatest(F.lit(1), F.floor(F.col("n") * 0.5))
    power = loud.groupBy(*by).agg(F.max("n").alias("n"), (F.avg(F.when(F.col("k") <= noise, F.col("energy"))) + 1e-9).alias("noise"), (F.avg(F.when(F.col("k") > speech, F.col("energy"))) + 1e-9).alias("speech"))
    power = power.select(*by, F.when(F.col("n") >= 4, 10 * F.log10(F.col("speech") / F.col("noise"))).otherwise(0.0).alias("snr"))
    # runs of zero frames: those between the same active frames
    order = Window.partitionBy(*by).orderBy("frame")
    runs = frames.withColumn("run", F.sum(active.cast("long")).over(order)).withColumn("zero", (~active).cast("long")).groupBy(*by, "run").agg(F.sum("zero").alias("zeros"), F.count(F.lit(1)).alias("rows"))
    last = F.max("run").over(Window.partitionBy(*by))
    inner = runs.withColumn("last", last)
    gaps = inner.groupBy(*by).agg(F.sum(F.when((F.col("run") > 0) & (F.col("run") < F.col("last")) & F.col("zeros").between(1, gap_frames), F.col("zeros")).otherwise(0)).alias("lost"), F.sum(F.when((F.col("run") > 0) & (F.col("run") < F.col("last")), F.col("rows")).when((F.col("run") == F.col("last")) & (F.col("last") > 0), 1).otherwise(0)).alias("span"), F.max("last").alias("actives"))
    clipped = frames.groupBy(*by).agg((F.sum("n_clipped") / F.greatest(F.lit(1), F.sum("n_samples")) * 100).alias("clipping_pct"))
    rows = clipped.join(power, by, "left").join(gaps, by, "left").fillna(0.0, ["snr"])
    rows = rows.withColumn("dropout_pct", F.when(F.col("actives") >= 2, F.col("lost") / F.greatest(F.lit(1), "span") * 100).otherwise(0.0))
    less = F.when(F.col("snr") < 30, (30 - F.greatest(F.lit(5.0), "snr")) * 0.08).otherwise(0.0) + F.when(F.col("clipping_pct") > 0.5, F.least(F.lit(2.0), F.col("clipping_pct") * 0.4)).otherwise(0.0) + F.when(F.col("dropout_pct") > 1, F.least(F.lit(2.5), F.col("dropout_pct") * 0.2)).otherwise(0.0)
    rows = rows.withColumn("mos", F.round(F.greatest(F.lit(1.0), F.least(F.lit(5.0), 4.8 - less)), 2))
    grade = F.when(F.col("mos") >= 4.0, "excellent").when(F.col("mos") >= 3.2, "good").when(F.col("mos") >= 2.5, "fair").otherwise("poor")
    return rows.select(*by, "mos", grade.alias("grade"), F.round("snr", 1).alias("snr_db"), F.round("clipping_pct", 2).alias("clipping_pct"), F.round("dropout_pct", 2).alias("dropout_pct"), ((F.col("mos") < 3.0) | (F.col("clipping_pct") > 4.0) | (F.col("dropout_pct") > 8.0)).alias("alert"))


def level_quality(frames: DataFrame, review: float = 78.0) -> DataFrame:
    """(recording_id, score, label, rms_dbfs, peak_dbfs, clipped_pct, silent_pct): 100 less what low levels, clipping and silence cost."""
    sums = frames.groupBy("recording_id").agg(F.sum(F.col("energy") * F.col("n_samples")).alias("e"), F.sum("n_samples").alias("n"), F.max("peak").alias("peak"), F.sum("n_clipped").alias("c"), F.sum("n_silent").alias("s"))
    db = lambda x: 20 * F.log10(F.greatest(x, F.lit(1 / 32768.0)))
    rows = sums.where("n > 0").select("recording_id", db(F.sqrt(F.col("e") / F.col("n"))).alias("rms_dbfs"), db(F.col("peak")).alias("peak_dbfs"), (F.col("c") / F.col("n") * 100).alias("clipped_pct"), (F.col("s") / F.col("n") * 100).alias("silent_pct"))
    less = F.when(F.col("rms_dbfs") < -42, 30).when(F.col("rms_dbfs") < -34, 15).otherwise(0) + F.when((F.col("peak_dbfs") > -0.3) | (F.col("clipped_pct") > 0.15), 25).otherwise(0) + F.when(F.col("silent_pct") > 82, 20).when(F.col("silent_pct") > 68, 10).otherwise(0)
    rows = rows.withColumn("score", (100 - less).cast("double"))
    return rows.select("recording_id", "score", F.when(F.col("score") >= 85, "good").when(F.col("score") >= review, "fair").otherwise("risky").alias("label"), "rms_dbfs", "peak_dbfs", "clipped_pct", "silent_pct")


def bleed_filter(segments: DataFrame, frames: DataFrame, frame_ms: int = 250, louder: float = 4.0, quiet: float = 0.015) -> DataFrame:
    """(recording_id, segment_index) of the lines that are no bleed: over a line's frames the other channel is not `louder` times as loud while its own is under `quiet`.

    Lines hold (recording_id, segment_index, channel 0 or 1, start_ms, end_ms) and meet the frames that begin in them; a line without frames stays.
    The lines of a recording are one row, listed by blocks of 128 frames; frames pass it where they lie, and are neither sorted nor, if they
    are dealt by recording already, shuffled.
    """
    first = F.ceil(F.col("start_ms") / frame_ms)
    lines = segments.select("recording_id", F.struct("segment_index", F.col("channel").alias("own"), first.alias("begin"), F.greatest(first + 1, F.ceil(F.col("end_ms") / frame_ms)).alias("end")).alias("line"))
    per = lines.withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("line.begin") / 128)), F.greatest(F.lit(0), F.floor((F.col("line.end") - 1) / 128)))))
    per = per.groupBy("recording_id", "block").agg(F.collect_list("line").alias("lines")).groupBy("recording_id").agg(F.max("block").alias("last"), F.map_from_entries(F.collect_list(F.struct("block", "lines"))).alias("at"))
    blocks = per.select("recording_id", F.transform(F.sequence(F.lit(0).cast("long"), "last"), lambda i: F.try_element_at("at", i)).alias("blocks"))
    held = lambda line: (F.col("frame") >= line["begin"]) & (F.col("frame") < line["end"])
    near = F.filter(F.get("blocks", F.floor(F.col("frame") / 128).cast("int")), held)
    met = frames.join(blocks.hint("shuffle_hash"), "recording_id").select("recording_id", "channel", "energy", "n_samples", F.inline(near))
    level = lambda own: F.sqrt(F.sum(F.when((F.col("channel") == F.col("own")) == F.lit(own), F.col("energy") * F.col("n_samples"))) / F.sum(F.when((F.col("channel") == F.col("own")) == F.lit(own), F.col("n_samples"))))
    levels = met.groupBy("recording_id", "segment_index").agg(F.coalesce(level(True), F.lit(0.0)).alias("own"), F.coalesce(level(False), F.lit(0.0)).alias("other"))
    bleeding = levels.where((F.col("other") > louder * F.col("own")) & (F.col("own") < quiet))
    return segments.select("recording_id", "segment_index").join(bleeding, ["recording_id", "segment_index"], "left_anti")


def turns_from_energy(frames: DataFrame, frame_ms: int = 250, margin: float = 1.3, least: float = 1e-5, agree: int = 2) -> DataFrame:
    """(recording_id, start_ms, end_ms, speaker): who speaks by the louder channel, a change after `agree` frames that agree. Speakers are the channel's numbers.

    A fold over a recording's frames, which are one row while it runs.
    """
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("energy")))
    wide = frames.groupBy("recording_id", "frame").agg(F.coalesce(pick(0), F.lit(0.0)).alias("l"), F.coalesce(pick(1), F.lit(0.0)).alias("r"))
    louder = F.when((F.col("l") > F.col("r") * margin) & (F.col("l") > least), 0).when((F.col("r") > F.col("l") * margin) & (F.col("r") > least), 1)
    rows = wide.select("recording_id", F.struct(F.col("frame").cast("bigint").alias("frame"), louder.alias("w")).alias("x"))
    begin = F.struct(F.array().cast("array<struct<start_ms:bigint,end_ms:bigint,speaker:int>>").alias("out"), F.lit(0).alias("now"), F.lit(0).cast("bigint").alias("since"), F.lit(0).alias("waiting"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("end"))

    def step(acc, x):
        w = F.coalesce(x["w"], acc["now"])
        n = F.when(w == acc["waiting"], acc["n"] + 1).otherwise(1)
        switch = (w != acc["now"]) & (n >= agree)
        at = x["frame"] * frame_ms
        turn = F.array(F.struct(acc["since"].alias("start_ms"), at.alias("end_ms"), acc["now"].alias("speaker")))
        out = F.when(switch & (at > acc["since"]), F.concat(acc["out"], turn)).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(switch, w).otherwise(acc["now"]).alias("now"), F.when(switch, at).otherwise(acc["since"]).alias("since"), w.alias("waiting"), n.alias("n"), (at + frame_ms).alias("end"))

    folded = rows.groupBy("recording_id").agg(F.sort_array(F.collect_list("x")).alias("rows")).select("recording_id", F.aggregate("rows", begin, step).alias("a"))
    last = F.array(F.struct(F.col("a.since").alias("start_ms"), F.col("a.end").alias("end_ms"), F.col("a.now").alias("speaker")))
    return folded.select("recording_id", F.inline(F.when(F.col("a.end") > F.col("a.since"), F.concat("a.out", last)).otherwise(F.col("a.out"))))
