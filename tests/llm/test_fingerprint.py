import hashlib
import random

from pyspark.sql import functions as F

from turnwise.llm.common import Scratch, successors
from turnwise.llm.fingerprint import BINS, edited_fingerprints, likeness, probes, with_fingerprint

from .test_minhash import shingle_set


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        turned = rows[k + 1 :] + rows[:k]
        following = next((u for j, u in turned if (j, u) != (i, t)), t)  # equal rows have the same next one
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, following))
    return out


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in edited_fingerprints(docs).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) == len(want)
    errors, by_text = [], {}
    for i, n, sha, text, edited, following in want:
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        if len(text.split()) >= 100:  # a few runs leave a few values to compare
            errors += [abs(r.near_edited - jaccard(text, edited)), abs(r.near_next - jaccard(text, following))]
    assert sum(errors) / len(errors) < 0.05 and max(errors) < 0.35


def test_edges(spark):
    rows = [(5, "a b c d e f g"), (None, "x"), (2, None), (3, ""), (3, ""), (4, "é" * 9), (7, "p q r"), (7, "p q r"), (9, "w " * 50000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fingerprint int, _range int")
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in edited_fingerprints(docs).collect()))
    assert got == sorted((-1 if i is None else i, n, sha) for i, n, sha, *_ in brute(rows))
    assert edited_fingerprints(docs.limit(0)).count() == 0
    assert edited_fingerprints(docs.limit(1)).collect()[0].near_next == 1.0


def plain_fingerprint(values):
    """128 digits from 64-bit run hashes, one bin at a time."""
    bins = [None] * BINS
    for x in values:
        b = (x >> 57) + 64
        bins[b] = x if bins[b] is None else min(bins[b], x)
    if not values:
        return ""
    order = probes()
    full = [x if x is not None else next(bins[j] for j in order[b] if bins[j] is not None) for b, x in enumerate(bins)]
    return "".join("0123456789abcdef"[x & 15] for x in full)


def test_fingerprints_are_those_of_a_plain_loop(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 4, 5, 6, 9, 20, 60, 150, 400, 3000)] + ["  Led and\tTRAILED \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    hashed = F.transform(F.array_remove(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))
    rows = with_fingerprint(docs, F.col("text"), "fp").select("doc_id", "fp", hashed.alias("h")).collect()
    runs = {r.doc_id: [tuple(r.h[i : i + 5]) for i in range(len(r.h) - 4)] for r in rows}
    flat = spark.createDataFrame([(i, *run) for i, x in runs.items() for run in x], "i int, a long, b long, c long, d long, e long")
    values = {i: [] for i in runs}
    for r in flat.select("i", F.xxhash64("a", "b", "c", "d", "e").alias("x")).collect():
        values[r.i].append(r.x)
    for r in rows:
        if len(r.h) >= 5 or not r.h:
            assert r.fp == plain_fingerprint(values[r.doc_id])
        else:
            assert len(r.fp) == BINS and len(set(r.fp)) == 1


def test_likeness_counts_equal_digits(spark):
    rng = random.Random(5)
    digits = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(BINS))
    pairs = [(a, "".join(x if rng.random() < p else y for x, y in zip(a, digits(), strict=True))) for p in (0, 0.3, 0.8, 1) for a in (digits(), digits())] + [("", digits()), ("", "")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(likeness(F.col("a"), F.col("b"))).collect()]
    for (a, b), x in zip(pairs, got, strict=True):
        same = sum(p == q for p, q in zip(a, b)) / BINS
        assert abs(x - (max(0, (same - 1 / 16) / (15 / 16)) if a and b else float(a == b))) < 1e-9


def test_the_order_goes_over_many_ranges(spark):
    keys = spark.range(1000).selectExpr("if(id = 500, null, id * 7) as doc_id", "id % 3 as h").repartition(5)
    got = {(r.doc_id, r.h): (r.next.doc_id, r.next.h) for r in successors(Scratch(spark), keys, 30).collect()}
    order = sorted(got, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert len(got) == 1000 and all(got[k] == order[(i + 1) % 1000] for i, k in enumerate(order))
