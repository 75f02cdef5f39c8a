"""Toxicity: gradient-boosted trees over dense features with isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import segment_reduce, slices, span_hashes, text_bytes, word_spans

#: Common insults the lexicon starts from, and second-person words.
SEED_INSULTS = "idiot idiots moron stupid dumb loser scum trash pathetic worthless clown disgusting fool imbecile jerk bastard bitch asshole crap shit fuck idiota imbécil estúpido estúpida basura payaso tonto idioten dummkopf arschloch abschaum trottel scheiße connard imbécile stupide ordure crétin nul merde".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted tú ti tus vosotros".split()
FEATURES = ["lexicon_density", "lexicon_hits", "stem_density", "stem_hits", "worst_word", "near_second_person", "second_person", "capitals", "shouted", "exclamations", "punctuation", "obfuscated", "stretched", "words"]

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Characters read as the letters they stand in for.
for _a, _b in zip(b"013457@$", b"oieastas", strict=True):
    _FOLD[_a] = _b
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def crc_part(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4


def folded_words(texts: pa.Array):
    """Words without signs, look-alikes read as letters: (bytes, starts, ends, first word of each text, raw bytes, raw offsets)."""
    raw, offsets = text_bytes(texts)
    data = _FOLD[raw]
    keep = _LETTER[data] | _SPACE[raw]
    kept = np.concatenate([[0], np.cumsum(keep)])
    data, inner = data[keep], kept[offsets]
    starts, ends, first = word_spans(data, inner)
    return data, starts, ends, first, raw, offsets


def prefix_ends(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    return np.minimum(starts + size, ends)


def keys_of(words: list[str]) -> np.ndarray:
    data, starts, ends, *_ = folded_words(pa.array([" ".join(words)]))
    return np.unique(span_hashes(data, starts, ends))


def word_keys(data, starts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word and of its first four and five bytes; 0 where it is no longer than that."""
    whole = span_hashes(data, starts, ends)
    out = [whole]
    for size in (4, 5):
        h = span_hashes(data, starts, prefix_ends(starts, ends, size)) ^ np.uint64(size)
        h[ends - starts <= size] = 0
        out.append(h)
    return tuple(out)


def look_up(keys: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, weights[at], 0.0)


def feature_matrix(texts: pa.Array, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    data, starts, ends, first, raw, offsets = folded_words(texts)
    n = len(offsets) - 1
    keys = word_keys(data, starts, ends)
    known, weights = lexicon
    weight = [look_up(k, known, weights) for k in keys]
    hit = weight[0] > 0
    stem = (weight[1] > 0) | (weight[2] > 0)
    worst = np.maximum(weight[0], np.maximum(weight[1], weight[2]))
    you = look_up(keys[0], keys_of(SECOND_PERSON), np.ones(len(keys_of(SECOND_PERSON)))) > 0
    count = np.diff(first)
    per = np.maximum(1, count)
    total = lambda x: segment_reduce(np.add, x.astype(float), first, 0.0)
    # a second-person word within five words of a hit, in the same text
    run = np.concatenate([[0], np.cumsum(you)])
    of_word = np.repeat(np.arange(n), count)
    lo, hi = np.maximum(np.arange(len(you)) - 5, first[of_word]), np.minimum(np.arange(len(you)) + 6, first[of_word + 1])
    near = (hit | stem) & (run[hi] - run[lo] > 0)
    size = np.maximum(1, np.diff(offsets))
    bytes_of = lambda x: segment_reduce(np.add, x.astype(np.int64), offsets, 0)
    upper = (raw >= 65) & (raw <= 90)
    alpha = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    sign = ~alpha & ~_SPACE[raw] & ~((raw >= 48) & (raw <= 57))
    inner = np.zeros(len(raw), bool)
    same = np.zeros(len(raw), bool)
    both_upper = np.zeros(len(raw), bool)
    if len(raw) > 2:
        inner[1:-1] = ~alpha[1:-1] & ~_SPACE[raw[1:-1]] & alpha[:-2] & alpha[2:]
        same[2:] = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & alpha[2:]
        both_upper[1:] = upper[1:] & upper[:-1]
    return np.stack([total(hit) / per, np.log1p(total(hit)), total(stem) / per, np.log1p(total(stem)), segment_reduce(np.maximum, worst, first, 0.0), total(near) / per, total(you) / per, bytes_of(upper) / size, bytes_of(both_upper) / size, bytes_of(raw == 33) / size, bytes_of(sign) / size, bytes_of(inner) / per, bytes_of(same) / per, np.log1p(count)], 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """(doc_id, label, part) of at most `most` labelled ids, the first by a hash of the id; those held out are left out."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("double").alias("label"))
    rows = rows.withColumn("part", crc_part(F.col("doc_id"))).where("part <> 2")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learn_lexicon(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words and stems that mark toxic documents, with their log-odds, and the seeds.

    texts holds (text, label) of a bounded sample, so its words do. A key counts once a document.
    """

    def count(batches):
        seen: dict[float, list] = {0.0: [], 1.0: []}
        docs = [0, 0]
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts, ends, first, *_ = folded_words(part.column("text"))
                label = part.column("label").to_numpy()
                of_word = np.repeat(np.arange(len(label)), np.diff(first))
                docs[0], docs[1] = docs[0] + int((label == 0).sum()), docs[1] + int((label == 1).sum())
                for keys in word_keys(data, starts, ends):
                    for value in (0.0, 1.0):
                        own = (label[of_word] == value) & (keys != 0)
                        pair = np.unique(np.stack([of_word[own].astype(np.uint64), keys[own]], 1), axis=0) if own.any() else np.zeros((0, 2), np.uint64)
                        seen[value].append(np.unique(pair[:, 1], return_counts=True))
        sums: dict[int, list] = {0: docs}
        for value, found in seen.items():
            for keys, n in found:
                for k, c in zip(keys.tolist(), n.tolist(), strict=True):
                    sums.setdefault(k, [0, 0])[int(value)] += c
        keys = np.array(list(sums), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], ["key", "clean", "toxic"])

    tally = texts.mapInArrow(count, "key long, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    size = tally.where("key = 0").first()
    clean, toxic = (size["clean"], size["toxic"]) if size else (0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    found = tally.where(f"key <> 0 and toxic >= 4 and toxic * {clean + 1} >= 6 * clean * {toxic + 1}").select("key", odds.alias("odds")).toPandas()
    learned = dict(zip(found["key"].to_numpy().view(np.uint64).tolist(), found["odds"].tolist(), strict=True))
    for k in keys_of(SEED_INSULTS).tolist():
        learned[k] = max(learned.get(k, 0.0), 2.0)
    keys = np.array(sorted(learned), np.uint64)
    return keys, np.array([learned[k] for k in keys.tolist()])


def _rows(x: np.ndarray) -> pa.Array:
    """An array<double> column of a matrix."""
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.reshape(-1)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, most_labels: int = 30_000, trees: int = 15, depth: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, held_out, score, predicted) for each document; score is the calibrated chance that its label is 1.

    Learns from at most `most_labels` labelled ids, never from those whose crc32 (of the id as text) modulo 4 is 2. The lexicon that
    gives a labelled text its features is learned from the other two remainders, so no text meets its own words; trees and
    calibration are fitted on these features of all, and other texts are scored by the lexicon of all. Where the labels hold a single
    class, every score is the share of label 1 (0 without labels). Labels other than 0 and 1 are left out; of labels that differ for
    one id the larger counts, of its texts the first in order. A null text is empty; null ids are scored, never learned from, and
    their held_out is false. Repeated rows give a row each. Other columns than those named in `carry` are ignored.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    from .common import Scratch

    tmp = Scratch(docs.sparkSession)
    spark = docs.sparkSession
    sample = F.broadcast(tmp.table(labelled_sample(docs, labels, id_col, label_col, most_labels)))  # at most most_labels rows
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    texts = tmp.table(rows.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "label", "part").agg(F.min("text").alias("text")))
    folds = [r["part"] for r in texts.select("part").distinct().collect()]  # three at most
    lexicons = spark.sparkContext.broadcast({None: learn_lexicon(texts.select("text", "label"))} | {k: learn_lexicon(texts.where(F.col("part") != k).select("text", "label")) for k in folds})

    def own_features(batches):
        names = ["doc_id", "label", "part"]
        for batch in batches:
            for part in slices(batch, "text"):
                fold, x = part.column("part").to_numpy(), np.zeros((part.num_rows, len(FEATURES)))
                for k in np.unique(fold).tolist():
                    x[fold == k] = feature_matrix(part.column("text").filter(pa.array(fold == k)), lexicons.value[k])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), _rows(x)], [*names, "x"])

    def features(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *carry)), _rows(feature_matrix(part.column("text"), lexicons.value[None]))], ["doc_id", *carry, "x"])

    learned = tmp.table(texts.mapInArrow(own_features, "doc_id long, label double, part long, x array<double>").withColumn("features", array_to_vector("x")))
    out = rows.mapInArrow(features, rows.select("doc_id", *carry).schema.add("x", T.ArrayType(T.DoubleType())))
    both = lambda df: df.agg(F.count_distinct("label")).first()[0] == 2
    if both(learned):
        model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=3).fit(learned.coalesce(8))
        raw = lambda df: model.transform(df).withColumn("raw", vector_to_array("rawPrediction")[1])
        curve = IsotonicRegression(labelCol="label", featuresCol="raw").fit(raw(learned).select("raw", "label").coalesce(8))
        out = raw(out.withColumn("features", array_to_vector("x"))).withColumn("prediction", F.lit(0)).drop("prediction", "probability", "rawPrediction")
        out = curve.transform(out).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction")))
    else:
        share = learned.agg(F.avg("label")).first()[0] or 0.0
        out = out.withColumn("score", F.lit(float(share)))
    return out.select("doc_id", *carry, F.coalesce(crc_part(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
