"""Quality and toxicity against their labels, and their edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from turnwise.llm.quality import BUCKETS, gumbel_top, kth_largest, resample
from turnwise.llm.text import mix, span_hashes
from turnwise.llm.toxicity import score

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (1, None), (5, ""), (None, "some words of a text"), (9, "word " * 100_000), (9, "word " * 100_000)]


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def edges(spark):
    """Odd rows with columns that clash with those of the operators."""
    return spark.createDataFrame([(i, t, 1, "x") for i, t in EDGES], "doc_id long, text string, score int, weight string")


def test_quality_follows_the_labels(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    got = resample(docs, labels)
    assert got.count() == docs.count()
    kept = {r.quality: r.share for r in got.join(labels, "doc_id").where("quality IS NOT NULL").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.9 and kept[0] < 0.2


def test_quality_edges(spark):
    labels = read(spark, "labels")
    got = resample(edges(spark), labels)
    assert got.count() == len(EDGES) and got.where("kept IS NULL OR weight IS NULL").isEmpty()
    assert resample(edges(spark).limit(0), labels).isEmpty()


def test_toxicity_on_held_out_documents(spark):
    # at sf0.01 the trees see about a dozen toxic documents and find 9 of 14 held-out ones only; the README lists that
    docs, labels = read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1")
    got = score(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = got.where("held_out").join(labels, "doc_id").where("toxic IS NOT NULL").select("toxic", "predicted").collect()
    toxic = [r.predicted for r in held if r.toxic == 1]
    clean = [r.predicted for r in held if r.toxic == 0]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_toxicity_edges(spark):
    labels = read(spark, "labels")
    got = score(edges(spark), labels)
    assert got.count() == len(EDGES) and got.where("score IS NULL OR predicted IS NULL OR held_out IS NULL").isEmpty()
    assert score(edges(spark).limit(0), labels).isEmpty()


def test_quality_on_held_out_labels(spark):
    docs, labels = read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1").where("quality is not null")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    held = resample(docs, labels.where(~out)).join(labels.where(out), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    kept = {r.quality: r.share for r in held}
    assert kept[1] > 0.97 and kept[0] < 0.1, kept


def test_weights_are_those_of_plain_counts(spark):
    docs, labels = read(spark, "documents", "/root/testdata/sf0.001"), read(spark, "labels", "/root/testdata/sf0.001")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    one = lambda x: int(mix(np.array([x % 2**64], np.uint64))[0])

    def grams(text):
        words = [m[0] for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|([^A-Za-z0-9\x80-\xff\x20\x09-\x0d])\1*", (text or "").encode())]
        own = [int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
        upper = lambda c: 65 <= c <= 90
        shape = [h if re.match(rb"[^A-Za-z\x80-\xff]", w) else one(upper(w[0]) + 2 * upper(w[min(1, len(w) - 1)]) + 4 * min(len(w), 15) + (1 << 40)) for w, h in zip(words, own, strict=True)]
        pairs = [one(x * 3 + y) for x, y in zip(shape, shape[1:])] + [one(x * 5 + y) for x, y in zip(own, own[1:])]
        return [g % BUCKETS for g in own + shape + pairs]

    texts = {r.doc_id: grams(r.text) for r in docs.collect()}
    raw = Counter(g for t in texts.values() for g in t)
    target = Counter(g for i, t in texts.items() if i in good for g in t)
    of = lambda model, g: math.log((model[g] + 0.5) / (sum(model.values()) + 0.5 * BUCKETS))
    ratio = {g: of(target, g) - of(raw, g) for g in raw}
    for r in resample(docs, labels).collect():
        assert math.isclose(r.weight, sum(ratio[g] for g in texts[r.doc_id]), rel_tol=1e-9, abs_tol=1e-6)


def test_the_sample_has_the_share_of_good_labels(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    has = docs.where("length(trim(text)) > 0")
    share = has.join(labels.where("quality IS NOT NULL"), "doc_id").agg(F.avg("quality")).first()[0]
    assert resample(docs, labels).where("kept").count() == round(share * has.count())
    assert resample(docs, labels, share=0.25).where("kept").count() == round(0.25 * has.count())


def test_rows_are_sampled_by_their_importance(spark):
    # many rows of few weights: those with more evidence are kept more often, at rates that Gumbel top-k gives
    weights = [-3.0, -1.0, -0.25, 0.0, 0.25, 1.0, 3.0]
    keyed = spark.range(70_000).selectExpr("id as doc_id", f"element_at(array({','.join(f'{w}D' for w in weights)}), cast(id % 7 as int) + 1) as weight", "1L as n")
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    got = gumbel_top(keyed.withColumn("gumbel_key", F.col("weight") - F.log(-F.log(uniform))))
    assert got.where("kept").count() == 40_000
    rate = {r.weight: r.share for r in got.groupBy("weight").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    # the key of the last row is one number for all, so a weight's odds follow from it
    last = got.where("kept").agg(F.min("gumbel_key")).first()[0]
    for w in weights:
        assert abs(rate[w] - (1 - math.exp(-math.exp(w - last)))) < 0.02
    assert sorted(rate.values()) == [rate[w] for w in weights] and rate[3.0] - rate[-3.0] > 0.8


def test_ties_and_the_kth_largest(spark):
    rows = [(i, float(x), float(x), 1) for i, x in enumerate([3, 1, 1, 1, -1, -1, 0.5])] + [(9, 5.0, 5.0, 0)]
    keyed = spark.createDataFrame(rows, "doc_id long, weight double, gumbel_key double, n long")
    assert [kth_largest(keyed, "weight", k) for k in (1, 2, 3, 4, 5, 8)] == [5.0, 3.0, 1.0, 1.0, 1.0, -1.0]
    assert sorted(r.doc_id for r in gumbel_top(keyed).where("kept").collect()) == [0, 1, 2, 3, 6]
    tied = keyed.withColumn("gumbel_key", F.lit(1.0))
    assert gumbel_top(tied).where("kept").count() == 7  # all but the row without n-grams


def test_labels_of_one_kind(spark):
    docs, labels = read(spark, "documents", "/root/testdata/sf0.001"), read(spark, "labels", "/root/testdata/sf0.001")
    one = resample(docs, labels.where("quality = 1"))
    assert 0 < one.where("kept").count() < docs.count()
    none = resample(docs, labels.limit(0))
    assert none.where("not kept").join(docs.where("length(trim(text)) > 0"), "doc_id").isEmpty()
    assert score(docs, labels.where("toxic = 0")).where("score <> 0").isEmpty()
    assert score(docs, labels.limit(0)).where("score <> 0").isEmpty()
    torn = labels.union(labels.withColumn("toxic", F.lit(1)).limit(5)).union(labels.limit(5))
    assert score(docs, torn).count() == docs.count()
