"""Operators that take a batch or a streaming DataFrame alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import text as tx


def streaming_trends(hits: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Hits of each keyword in sliding windows. Rows later than the watermark are left out of a stream; a batch has none. A stream's created_at must be a timestamp with zone."""
    counts = hits.withWatermark("created_at", late).groupBy(F.window("created_at", window, slide).alias("w"), "keyword").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "keyword", "n")


def stream_segment_analysis(segments: DataFrame, terms: list[str]) -> DataFrame:
    """Lines with their listed words and number of card numbers; stateless."""
    found = F.array_join(F.sort_array(F.array_intersect(tx.tokens(F.col("text")), F.array(*[F.lit(t) for t in terms]))), ",")
    return segments.select("conversation_id", "segment_index", found.alias("terms"), F.size(tx.card_numbers(F.col("text"))).cast("long").alias("cards"))
