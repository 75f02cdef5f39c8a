"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each distinct run of five words is hashed once; the top bits of the hash name a bin, which keeps its least hash. Empty bins
borrow from a full one found along their own keyed sequence of bins (optimal densification). The low bits of every bin, packed as
hexadecimal digits, are the fingerprint; likeness subtracts the chance agreement of so few bits.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, successors

BINS, BITS = 128, 4
#: Probes that are tried one by one.
TRIED = 12


def probes(bins: int = BINS, seed: int = 5) -> list[list[int]]:
    """For each bin the order in which it looks for a full one."""
    out = []
    for b in range(bins):
        order = [x for x in range(bins) if x != b]
        random.Random(seed * 1000 + b).shuffle(order)
        out.append(order)
    return out


def with_fingerprint(df: DataFrame, text: Column, name: str, size: int = 5) -> DataFrame:
    """Add column `name`: 128 hexadecimal digits, or an empty string for a text without words.

    Words are runs between ASCII white space, in lower case; fewer than `size` words make one run. Null is empty. Equal texts
    have equal fingerprints.
    """
    none = F.slice(F.array(F.lit(0).cast("long")), 1, 0)  # its type holds no nulls, so the sort is one of plain numbers
    df = df.withColumn("_w", F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), ""))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).drop("_w")
    runs = F.transform(F.sequence(F.lit(0), F.size("_h") - size), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(size)]))
    df = df.withColumn("_s", F.sort_array(F.when(F.size("_h") >= size, runs).when(F.size("_h") > 0, F.array(F.xxhash64(F.col("_h").cast("string")))).otherwise(none))).drop("_h")
    shift = 64 - (BINS - 1).bit_length()
    # the first of each bin: its top bits differ from those before
    df = df.withColumn("_m", F.filter("_s", lambda x, i: F.coalesce(F.shiftright(x.bitwiseXOR(F.get("_s", i - 1)), shift) != 0, F.lit(True)))).drop("_s")
    df = df.withColumn("_b", F.transform("_m", lambda x: F.shiftright(x, shift) + BINS // 2))
    placed = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get("_m", (F.array_position("_b", b.cast("long")) - 1).cast("int")))
    df = df.withColumn("_v", F.when(F.size("_m") == BINS, F.col("_m")).otherwise(placed)).drop("_b")
    table = F.from_json(F.lit(json.dumps(probes())), "array<array<int>>")  # one folded constant
    # the first few probes are tried one by one, which mostly ends there; the whole order only where all of them are empty
    near = lambda i: [F.get("_v", F.get(F.get(table, i), F.lit(k))) for k in range(TRIED)]
    far = lambda i: F.get("_v", F.get(F.filter(F.get(table, i), lambda j: F.get("_v", j).isNotNull()), F.lit(0)))
    digit = lambda x: F.substring(F.lit("0123456789abcdef"), (x.bitwiseAND(2**BITS - 1) + 1).cast("int"), F.lit(1))
    filled = F.transform("_v", lambda x, i: digit(F.coalesce(x, *near(i), far(i))))
    return df.withColumn(name, F.when(F.size("_m") == 0, F.lit("")).otherwise(F.array_join(filled, ""))).drop("_m", "_v")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints, 0 to 1; empty ones are like each other only."""
    same = F.lit(0)
    for k in range(BINS * BITS // 64):
        word = lambda x: F.conv(F.substring(x, 16 * k + 1, 16), 16, -10).cast("long")  # noqa: E731, B023
        differ = word(a).bitwiseXOR(word(b))
        # each digit's four bits are joined in its lowest one
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, 1))
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, 2)).bitwiseAND(F.lit(0x1111111111111111))
        same = same + 16 - F.bit_count(differ)
    same, chance = same / F.lit(float(BINS)), 1.0 / 2**BITS
    return F.when((a == "") | (b == ""), F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))).when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document in ascending
    id, or all of it; after the last comes the first. Null texts are empty; different texts of one id follow each other by their
    hash, equal rows have the same next document; null ids come first. Other columns are ignored; an empty table gives no rows.

    Only ids, hashes and lengths are ordered. Each text then goes to its own row, where its first half and what the document before
    takes of it are cut out, and these halves meet: the texts are shuffled twice, whatever the number of documents.
    """
    tmp = Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("h", F.xxhash64("text")).withColumn("n_chars", F.char_length("text").cast("long"))
    keys = own.groupBy("doc_id", "h").agg(F.max("n_chars").alias("n"), F.count(F.lit(1)).alias("copies"))
    order = successors(tmp, keys.select("doc_id", "h", "n", "copies"))
    before = order.select(F.col("next.doc_id").alias("k_id"), F.col("next.h").alias("k_h"), F.col("next.copies").alias("copies"), F.col("doc_id").alias("prev_id"), F.col("h").alias("prev_h"), F.floor(F.col("n") / 2).cast("int").alias("taken"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    parts = with_fingerprint(own, F.col("text"), "fingerprint").join(before, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h")))
    parts = tmp.table(parts.select("doc_id", "h", "n_chars", "copies", "fingerprint", F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")).alias("head"), "prev_id", "prev_h", F.substring("text", F.lit(1), F.col("taken")).alias("given")))
    sent = parts.select("prev_id", "prev_h", "given", F.col("fingerprint").alias("next_fingerprint"), "copies")
    sent = sent.where("copies = 1").unionByName(sent.where("copies > 1").dropDuplicates(["prev_id", "prev_h"])).drop("copies")
    both = parts.select("doc_id", "h", "n_chars", "fingerprint", "head").join(sent, F.col("doc_id").eqNullSafe(F.col("prev_id")) & (F.col("h") == F.col("prev_h")))
    both = both.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", F.concat("head", "given").alias("edited"))
    both = with_fingerprint(both, F.col("edited"), "edited_fingerprint").withColumn("edited_sha256", F.sha2("edited", 256))
    return both.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
