from pyspark.sql import functions as F

from turnwise.sources import fixtures as fx
from turnwise.streaming import trends as st

from .conftest import SF


def test_a_stream_of_hits_gives_the_batch_counts(spark, tmp_path):
    hits = fx.hits(spark, SF).withColumn("created_at", F.col("created_at").cast("timestamp"))
    folder = str(tmp_path / "hits")
    hits.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    query = st.streaming_trends(stream).writeStream.outputMode("complete").format("memory").queryName("trend_counts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("trend_counts").collect()))
    assert got == sorted(map(tuple, st.streaming_trends(hits).collect())) and got
