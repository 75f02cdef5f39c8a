"""Alert rules over hits as they arrive: each batch is evaluated against what is stored, and may run twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import trends as tr

HITS = "keyword string, conversation_id long, created_at timestamp"
EVENTS = "rule_id string, keyword string, title string, summary string, severity string, pct_change double, payload string, fired_at timestamp"


def _stored(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """What the batches have stored, those before `before` only."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.schema(f"{schema}, batch long").parquet(folder)
    return rows if before is None else rows.where(F.col("batch") < before)


def evaluate_batch(batch: DataFrame, number: int, rules: DataFrame, folder: str) -> None:
    """Store the hits of a batch(keyword, conversation_id, created_at) and the events that they set off, under `folder`.

    Rules (those of trends.evaluate_alerts) look at all hits stored by then, as of just after the batch's latest one. When a rule was
    last triggered is the latest event that earlier batches have stored for it, or its own last_triggered: so a batch that runs again
    sees what it saw at first and replaces what it wrote, and cooldowns outlive a restart. Hits without a time count nowhere; a
    batch without others fires nothing. Only hits within twice the longest window are read back.
    """
    spark = batch.sparkSession
    batch.select("keyword", "conversation_id", "created_at").write.mode("overwrite").parquet(f"{folder}/hits/batch={number}")
    own = spark.read.schema(HITS).parquet(f"{folder}/hits/batch={number}")
    latest = own.agg(F.date_format(F.max("created_at") + F.expr("interval 1 microsecond"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    if latest is None:
        spark.createDataFrame([], EVENTS).write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
        return
    fired = _stored(spark, f"{folder}/events", EVENTS, number).groupBy("rule_id").agg(F.max("fired_at").alias("_fired"))
    known = rules.join(fired, "rule_id", "left").withColumn("last_triggered", F.greatest(F.col("last_triggered").cast("timestamp"), "_fired")).drop("_fired")
    longest = rules.agg(F.max("days")).first()[0] or 0
    back = F.lit(latest).cast("timestamp") - F.make_dt_interval(days=F.lit(2 * longest + 1))
    hits = _stored(spark, f"{folder}/hits", HITS, number + 1).where(F.col("created_at") >= back)
    events = tr.evaluate_alerts(hits, known, latest)[0]
    events = events.join(tr.alert_payloads(events, latest), "rule_id").withColumn("fired_at", F.lit(latest).cast("timestamp"))
    events.select(*[F.col(c).cast(t) for c, t in (x.split() for x in EVENTS.split(", "))]).write.mode("overwrite").parquet(f"{folder}/events/batch={number}")


def alert_sink(hits: DataFrame, rules: DataFrame, folder: str, checkpoint: str):
    """The writer, to be started, of a stream of hits(keyword, conversation_id, created_at) that keeps alert events under `folder`."""
    return hits.writeStream.foreachBatch(lambda batch, number: evaluate_batch(batch, number, rules, folder)).option("checkpointLocation", checkpoint)


def alert_events(spark: SparkSession, folder: str) -> DataFrame:
    """EVENTS and the batch of each."""
    return _stored(spark, f"{folder}/events", EVENTS)
