"""The operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import NEIGHBOURS_SQL

#: 0.5 to 0.95 of the positive's score, all pairs of anchors and rows.
NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, list_inner_product(a.x, r.x)::BIGINT AS score
  FROM r AS a, r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""

#: Base32 of SHA-1: five hexadecimal digits are four of its characters.
WARC_SQL = """
WITH r AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex,
    row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS place, first(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS one
  FROM pages
), g AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INTEGER, 5))::BIGINT) AS parts FROM r)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN one END AS refers_to
FROM g"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import resample

    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import edited_fingerprints

    return edited_fingerprints(_read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    found = dedup_lines(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepieces import digest, encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded_col="decoded")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), digest("ids").alias("ids_crc32"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op10_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import conversations_as_rows, pair_neighbours, preference_pairs, spans_text

    found = preference_pairs(pair_neighbours(conversations_as_rows(_read(spark, sf_dir, "conversations"))))
    return found.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen_text", "rejected_text", spans_text("chosen_spans").alias("chosen_trained"), spans_text("rejected_spans").alias("rejected_trained"))


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    return hard_negatives(_read(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_read(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_quality_classifier,
        op3_toxicity,
        op4_best_fit_packing,
        op5_document_fingerprints,
        op6_line_dedup,
        op7_language_id,
        op8_embedding_near_dedup,
        op9_sentencepiece,
        op10_preference_formatting,
        op11_hard_negative_mining,
        op12_embedding_whitening,
        op13_warc,
    )
}
ORACLES: dict[str, str] = {"op10_preference_formatting": NEIGHBOURS_SQL, "op11_hard_negative_mining": NEGATIVES_SQL, "op13_warc": WARC_SQL}
