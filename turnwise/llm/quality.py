"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .text import mix, slices, span_hashes, text_bytes

BUCKETS = 1 << 16


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first of each text): runs of letters, of digits or of one other sign; white space parts them."""
    kind = np.full(256, 3, np.int64)
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    kind[48:58] = 2
    kind[[32, *range(9, 14)]] = 0
    k = kind[data]
    k = np.where(k == 3, 4 + data.astype(np.int64), k)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero((k != 0) & (np.concatenate([[True], k[1:] != k[:-1]]) | cut[:n]))
    ends = np.flatnonzero((k != 0) & (np.concatenate([k[1:] != k[:-1], [True]]) | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def gram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): the hashed unigrams and bigrams of each text, of its words and of their shapes."""
    data, offsets = text_bytes(texts)
    starts, ends, first = tokens(data, offsets)
    words = span_hashes(data, starts, ends)
    count = np.diff(first)
    # shape: kind of the first two bytes and length up to 15, so that words never seen still count
    two = np.minimum(starts + 1, np.maximum(ends - 1, 0))
    shout = (data[starts] >= 65) & (data[starts] <= 90) if len(starts) else np.zeros(0, bool)
    again = (data[two] >= 65) & (data[two] <= 90) if len(starts) else np.zeros(0, bool)
    sign = ~(((data[starts] | 32) >= 97) & ((data[starts] | 32) <= 122) | (data[starts] >= 128)) if len(starts) else np.zeros(0, bool)
    shape = (shout * 1 + again * 2 + 4 * np.minimum(ends - starts, 15)).astype(np.uint64)
    shape = np.where(sign, words, mix(shape + np.uint64(1 << 40)))
    pairs = np.zeros((2, len(words)), np.uint64)
    if len(words) > 1:
        pairs[0, :-1] = mix(shape[:-1] * np.uint64(3) + shape[1:])
        pairs[1, :-1] = mix(words[:-1] * np.uint64(5) + words[1:])
    last = first[1:][count > 0] - 1
    grams = np.stack([words, shape, *pairs], 1) & np.uint64(BUCKETS - 1)
    keep = np.ones((len(words), 4), bool)
    keep[last, 2:] = False
    sizes = np.where(count > 0, 4 * count - 2, 0)
    return grams[keep].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def importance(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_labels: int, carry: tuple[str, ...], tmp: Scratch) -> DataFrame:
    """(doc_id, carried columns, label, weight, n): the sum of log-ratios of the target's to the raw text's n-gram model over a text's n n-grams.

    The raw model counts all documents, the target those labelled 1 among at most `most_labels` labelled ids.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    marked = F.broadcast(tmp.table(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)))  # at most most_labels rows
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry).join(marked, "doc_id", "left")

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                grams, offsets = gram_buckets(part.column("text"))
                good = np.repeat(part.column("label").fill_null(0).to_numpy() == 1, np.diff(offsets))
                raw += np.bincount(grams, minlength=BUCKETS)
                target += np.bincount(grams[good], minlength=BUCKETS)
        b = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(raw[b]), pa.array(target[b])], ["b", "raw", "target"])

    counted = rows.select("text", "label").mapInArrow(count, "b long, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # BUCKETS rows at most
    b, raw, target = (counted[k].to_numpy() for k in ("b", "raw", "target"))
    both = np.zeros((2, BUCKETS))
    both[0, b], both[1, b] = raw, target
    logp = np.log((both + 0.5) / (both + 0.5).sum(1, keepdims=True))
    ratio = spark.sparkContext.broadcast(logp[1] - logp[0] if both[1].any() else np.zeros(BUCKETS))

    def weigh(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                grams, offsets = gram_buckets(part.column("text"))
                sums = np.concatenate([[0], np.cumsum(ratio.value[grams])])
                size = np.diff(offsets)
                total = sums[offsets[1:]] - sums[offsets[:-1]]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *carry, "label")), pa.array(total), pa.array(size)], ["doc_id", *carry, "label", "weight", "n"])

    schema = rows.select("doc_id", *carry, "label").schema.add("weight", "double").add("n", "long")
    return tmp.table(rows.mapInArrow(weigh, schema))


def good_share(found: DataFrame) -> float | None:
    """The share of good ones among labelled texts that have n-grams; None where labels are of one kind or there are none."""
    seen = found.where("n > 0").agg(F.avg("label").alias("share")).first()["share"]
    return seen if seen is not None and 0 < seen < 1 else None


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labels: int = 50_000, temperature: float = 1.0, share: float | None = None, seed: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, weight, gumbel_key, kept) for each row.

    weight is the logarithm of a text's importance: the sum over its n-grams of the log-ratio of the target's to the raw text's model.
    gumbel_key is weight / temperature plus Gumbel noise drawn from a keyed hash of the id; the k rows of the largest keys are kept,
    k being `share` of the rows that have n-grams. Where no share is given it is that of good ones among labelled rows, which are
    taken for a fair sample of all rows; with labels of one kind, k is the number of rows whose weight is not negative. So rows with
    much evidence stay or go, and others are sampled by their importance. Ties at the last key are all kept. Rows with an empty or
    null text have no n-grams and are not kept. Without labels of 1 all weights are 0 and all other rows are the sample. Repeated ids
    get the same noise, a null id none. Other columns than those named in `carry` are ignored.
    """
    tmp = Scratch(docs.sparkSession)
    found = importance(docs, labels, id_col, text_col, label_col, most_labels, carry, tmp)
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noise = F.when(F.col("doc_id").isNull(), 0.0).otherwise(-F.log(-F.log(uniform)))
    keyed = found.withColumn("gumbel_key", F.col("weight") / temperature + noise)
    return gumbel_top(tmp.table(keyed), carry, good_share(found) if share is None else share)


def gumbel_top(keyed: DataFrame, carry: tuple[str, ...] = (), share: float | None = None) -> DataFrame:
    """keyed(doc_id, weight, gumbel_key, n) with `kept`: the largest keys among rows with n-grams, `share` of them, or as many as weights are not negative."""
    k = keyed.where("n > 0 and weight >= 0").count() if share is None else round(share * keyed.where("n > 0").count())
    last = kth_largest(keyed.where("n > 0"), "gumbel_key", k)
    return keyed.select("doc_id", *carry, "weight", "gumbel_key", ((F.col("n") > 0) & (F.col("gumbel_key") >= last)).alias("kept"))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value, exactly, by histograms that narrow to one value; nothing is sorted or gathered."""
    if k <= 0:
        return float("inf")
    edge = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi, left = edge["lo"], edge["hi"], k
    while lo < hi:
        width = (hi - lo) / bins
        inside = df.where((F.col(column) >= lo) & (F.col(column) <= hi))
        at = F.least(F.lit(bins - 1), F.floor((F.col(column) - lo) / width)) if width > 0 else F.lit(0)
        rows = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("bin")).collect()
        for r in rows:
            if left <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            left -= r["n"]
        if r["n"] <= 1:
            break
    return hi if lo == hi else lo
