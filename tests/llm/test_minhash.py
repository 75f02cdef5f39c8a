import re
from collections import defaultdict

from turnwise.llm import minhash
from turnwise.llm.common import Scratch
from turnwise.llm.minhash import miss_chance, near_duplicates


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets, holders = {i: shingle_set(t) for i, t in rows}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    near = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_edges(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(3, " ".join(words), 1), (1, " ".join(words[:39]), 1), (7, " ".join(words[1:]) + " x", 1), (4, None, 1), (5, "", 1), (6, "a b", 1), (8, "A\tB ", 1), (None, "a b", 1), (9, " ".join(words), 1), (9, " ".join(words), 1), (10, " ".join(str(i % 977) for i in range(60000)), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keys int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(-1, 1, None, True), (1, 35, 1, True), (3, 36, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 36, 1, False), (8, 1, 6, False), (9, 36, 1, False), (9, 36, 1, False), (10, 977, 10, True)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_miss_chance():
    assert miss_chance(75, 24, 3) < 5e-6


def test_an_id_with_two_texts_keeps_the_links_of_both(spark):
    a, b = ([f"{k}{i}" for i in range(60)] for k in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*b, "more"])), (3, " ".join([*a, "more"])), (4, " ".join(b)), (9, "something else, with no link to any of these")]
    for some in (rows, rows[1:2] + rows[:1] + rows[2:]):
        got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(some, "doc_id long, text string")).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 9)}
    # the same without the id that joins them: two groups
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([(1, " ".join(a)), *rows[2:5]], "doc_id long, text string")).collect()}
    assert got == {1: 1, 3: 1, 2: 2, 4: 2}


def test_blocks_give_the_pairs_of_a_plain_loop(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from turnwise.llm import minhash as module

    monkeypatch.setattr(module, "BLOCK", 4)
    draw, rows = random.Random(6), []
    for i in range(60):
        full = [(1 << 63) - 1 if draw.random() < 0.7 else draw.getrandbits(62) for _ in range(module.WORDS)]
        rows.append((draw.randrange(3), (i, i * 7), (draw.randrange(4), 0), draw.randrange(600, 1000), full, [draw.randrange(6) for _ in range(3)]))
    df = spark.createDataFrame(rows, f"u long, cls {module.CLASS}, c {module.CLASS}, n long, bits array<long>, vs array<long>")
    want, ones = set(), lambda x: bin(x & (2**64 - 1)).count("1")
    for x in rows:
        for y in rows:
            alone = [sum(ones(p & ~q) for p, q in zip(s[4], t[4])) for s, t in ((x, y), (y, x))]
            both = min(x[3] - alone[0], y[3] - alone[1])
            if x[0] == y[0] and x[1] < y[1] and x[2] != y[2] and min(x[3], y[3]) * 100 >= 75 * max(x[3], y[3]) and any(p == q for p, q in zip(x[5], y[5])) and 100 * both >= 75 * (x[3] + y[3] - both):
                want.add((x[1][0], y[1][0]))
    got = {(r.a, r.b) for r in module.block_pairs(df, 75).select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b")).collect()}
    assert got == want and len(want) > 8


def test_open_rows_are_those_of_a_plain_loop(spark):
    import random

    from turnwise.llm import minhash as module
    from turnwise.llm.common import Scratch

    draw, factors, tmp = random.Random(8), 3, Scratch(spark)
    rows = [((i, i * 7), (draw.randrange(12), 0), [k * 1000 + draw.randrange(9) for k in range(2 * factors)]) for i in range(60)]
    flat = [(cls, c, -1, k, key) for cls, c, keys in rows for k, key in enumerate(keys)]
    keyed = spark.createDataFrame(flat, f"cls {module.CLASS}, c {module.CLASS}, few long, k int, key long")
    want = {(u, x[0][0]) for x in rows for y in rows if x[1] != y[1] for u in set(x[2][:factors]) & set(y[2][:factors]) if set(x[2][factors:]) & set(y[2][factors:])}
    got = [(r.u, r.cls.doc) for r in module.open_rows(tmp, module.mixed_keys(tmp, keyed, factors)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) < len(rows) * factors
    assert module.open_rows(tmp, module.mixed_keys(tmp, keyed.limit(0), factors)).isEmpty()


def test_exploded_tables_are_never_broadcast(spark, monkeypatch):
    """Few buckets may be; the tables, which Spark takes for as small as what they are made of, may not."""
    side = "struct<doc:long,s:long>"
    rows = [((i, 0), (i % 40, 0), [i % 7, 100 + i % 11], [i % 5, 200 + i % 13]) for i in range(200)]
    mixed = spark.createDataFrame(rows, f"cls {side}, c {side}, us array<long>, vs array<long>")
    found = {}
    for few in (minhash.FEW, 0):
        monkeypatch.setattr(minhash, "FEW", few)
        rows = minhash.open_rows(Scratch(spark), mixed)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan, "BuildLeft" in plan) == (few > 0, False)
        found[few] = sorted(rows.collect())
    assert found[0] == found[250_000] and found[0]
