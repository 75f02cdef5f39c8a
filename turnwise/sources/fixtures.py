"""Call tables derived by Spark from the driver's tables (segments, hits, turns, words, frames)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Timed, speaker-labelled segments of every call; times in whole milliseconds. Calls are dealt to so many tasks, if given, and else to as many as Spark takes for their size."""
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id AS conversation_id", "turn AS segment_index", "role", "text")
    c = c.withColumn("n_words", F.expr("cast(size(filter(split(text, '[ \\\\t\\\\r\\\\n]+'), x -> x <> '')) AS bigint)"))
    c = c.withColumn("dur_ms", F.greatest(F.lit(500), 400 * F.col("n_words")))
    c = c if tasks is None else c.repartition(tasks, "conversation_id")
    w = Window.partitionBy("conversation_id").orderBy("segment_index").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("prev_ms", F.coalesce(F.sum("dur_ms").over(w), F.lit(0)))
    return c.selectExpr(
        "conversation_id", "segment_index", "text", "n_words", "dur_ms",
        "greatest(0, if(segment_index % 3 = 2, prev_ms - 1000, prev_ms)) AS start_ms", "prev_ms + dur_ms AS end_ms",
        "CASE role WHEN 'assistant' THEN 'SPEAKER_00' WHEN 'user' THEN 'SPEAKER_01' ELSE 'IVR' END AS speaker",
        "if((conversation_id + segment_index) % 11 = 0, NULL, -cast((7 * conversation_id + 13 * segment_index) % 130 AS double) / 100) AS avg_logprob",
        "element_at(array('telecom', 'banking', 'omni', 'insurance'), cast(conversation_id % 4 AS int) + 1) AS sector",
        "concat('agent_', conversation_id % 7) AS agent_id", "concat('team_', (conversation_id % 7) % 3) AS team",
        "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(6 * conversation_id AS int)) AS created_at",
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits from the event stream."""
    return table(spark, sf_dir, "events").selectExpr("event_id AS hit_id", "event_type AS keyword", "concat(event_type, '-', user_id % 10) AS topic", "user_id AS conversation_id", "ts AS created_at", "value")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns: the segments 300 ms later."""
    return segments(spark, sf_dir).selectExpr("conversation_id", "segment_index AS turn_index", "start_ms + 300 AS t_start", "end_ms + 300 AS t_end", "speaker AS turn_speaker")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 250 ms of both channels of every call, their energies from a formula, with gaps of three zero frames."""
    # dealt by number: so little data would else go to one task, which then makes all frames
    calls = segments(spark, sf_dir, int(spark.conf.get("spark.sql.shuffle.partitions"))).groupBy("conversation_id").agg(F.max("end_ms").alias("end_ms"))
    rows = calls.select(F.col("conversation_id").alias("recording_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end_ms") / 250))).alias("frame")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel"))
    level = "cast((recording_id * 7 + frame * 13 + channel * 29) % 100 AS double)"
    energy = f"if((frame + recording_id) % 17 IN (3, 4, 5), 0.0D, {level} * {level} / 20000.0D * if((frame div 9 + channel) % 2 = 0, 1.0D, 0.01D))"
    return rows.selectExpr("recording_id", "channel", "frame", f"{energy} AS energy", f"least(1.0D, {level} / 70.0D) AS peak", "4000L AS n_samples", f"if({level} > 97, 300L, 0L) AS n_clipped", f"if({level} < 60, 4000L, 100L) AS n_silent")


#: The same tables for DuckDB.
SEGMENTS_SQL = """
c0 AS (SELECT conv_id AS conversation_id, turn AS segment_index, role, text,
  CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM conversations),
c1 AS (SELECT *, greatest(500, 400 * n_words) AS dur_ms FROM c0),
c2 AS (SELECT *, CAST(coalesce(sum(dur_ms) OVER (PARTITION BY conversation_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prev_ms FROM c1),
segments AS (SELECT conversation_id, segment_index, text, n_words, dur_ms,
  greatest(0, CASE WHEN segment_index % 3 = 2 THEN prev_ms - 1000 ELSE prev_ms END) AS start_ms, prev_ms + dur_ms AS end_ms,
  CASE role WHEN 'assistant' THEN 'SPEAKER_00' WHEN 'user' THEN 'SPEAKER_01' ELSE 'IVR' END AS speaker,
  CASE WHEN (conversation_id + segment_index) % 11 = 0 THEN NULL ELSE -CAST((7 * conversation_id + 13 * segment_index) % 130 AS DOUBLE) / 100 END AS avg_logprob,
  ['telecom', 'banking', 'omni', 'insurance'][conversation_id % 4 + 1] AS sector,
  'agent_' || (conversation_id % 7) AS agent_id, 'team_' || ((conversation_id % 7) % 3) AS team,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(6 * conversation_id AS INTEGER)) AS created_at FROM c2)"""
HITS_SQL = "hits AS (SELECT event_id AS hit_id, event_type AS keyword, event_type || '-' || (user_id % 10) AS topic, user_id AS conversation_id, ts AS created_at, value FROM events)"
TURNS_SQL = "turns AS (SELECT conversation_id, segment_index AS turn_index, start_ms + 300 AS t_start, end_ms + 300 AS t_end, speaker AS turn_speaker FROM segments)"
FRAMES_SQL = """
f0 AS (SELECT conversation_id AS recording_id, unnest(range(0, CAST(max(end_ms) // 250 AS BIGINT) + 1)) AS frame FROM segments GROUP BY 1), f1 AS (SELECT *, unnest([0, 1]) AS channel FROM f0),
f2 AS (SELECT *, CAST((recording_id * 7 + frame * 13 + channel * 29) % 100 AS DOUBLE) AS v FROM f1),
frames AS (SELECT recording_id, channel, frame, CASE WHEN (frame + recording_id) % 17 IN (3, 4, 5) THEN 0::DOUBLE ELSE v * v / 20000::DOUBLE * CASE WHEN (frame // 9 + channel) % 2 = 0 THEN 1::DOUBLE ELSE 0.01::DOUBLE END END AS energy,
  least(1::DOUBLE, v / 70::DOUBLE) AS peak, 4000 AS n_samples, CASE WHEN v > 97 THEN 300 ELSE 0 END AS n_clipped, CASE WHEN v < 60 THEN 4000 ELSE 100 END AS n_silent FROM f2)"""
