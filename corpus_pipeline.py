"""The corpus pipeline: quality, toxicity, line dedup, near-dedup, packing.

A stage decides on each row by its id and text, so rows that share an id with another text, or have none, get their own decision;
equal rows get equal ones. Each stage takes null and empty texts, repeated rows, empty tables and further columns as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import lines, minhash, packing, quality, toxicity
from turnwise.llm.common import Scratch

_HASH = "_tw_text"


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(_HASH, F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose id and text are not among gone(doc_id, _HASH); null ids are equal."""
    g = gone.select(F.col("doc_id").alias("_g_id"), F.col(_HASH).alias("_g_text")).distinct()
    hashed = _hashed(docs)
    return hashed.join(g, hashed["doc_id"].eqNullSafe(g["_g_id"]) & (hashed[_HASH] == g["_g_text"]), "left_anti").select(*docs.columns)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the importance resampling keeps: null and empty texts go, ties at the last key stay, equal rows stay or go together."""
    return _without(docs, quality.resample(_hashed(docs), _labels(spark, sf_dir), carry=(_HASH,)).where("not kept"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score stays under the threshold; a null text is scored as an empty one, equal rows stay or go together."""
    return _without(docs, toxicity.score(_hashed(docs), _labels(spark, sf_dir), carry=(_HASH,)).where("predicted = 1"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the lines that occur earlier; n_chars follows the text. Null texts and rows with a null id stay as they are; rows of one id count as one document."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates, and one of equal rows. Texts without words and null ids are in no group and stay."""
    hashed = _hashed(docs)
    twice = hashed.groupBy("doc_id", _HASH).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id", _HASH)
    once = hashed.join(twice, ["doc_id", _HASH], "left_anti").select(*docs.columns)
    first = hashed.join(twice, ["doc_id", _HASH], "left_semi").dropDuplicates(["doc_id", _HASH]).select(*docs.columns)
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return once.unionByName(first).join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of at most 2048 tokens, a row for each piece of each row; a null text is an empty one, a null id stays null."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", keep_one_of_each), ("packing", pack)]
#: Trained models and tokenizers are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder and read again."""
    docs, tmp = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = tmp.table(docs)
    return docs
