import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from turnwise.llm.common import Scratch
from turnwise.llm.packing import best_fit, fractional, knapsack, pack, pack_documents, plan, rounded

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, rows, capacity=2048):
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            x = ids[s : s + capacity]
            want[(doc, k, s, len(x), zlib.crc32(x.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack_documents(docs, PATH).collect()
    n = check([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], rows)
    assert n <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_edges(spark):
    rows = [(1, None, 3), (2, "", 3), (2, "", 3), (3, "it's  İ<|endoftext|>x ÀB c d 日本   \x1c1234 'S ", 3), (None, "a b c", 3), (5, "word " * 5000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    got = pack_documents(docs, PATH, with_ids=True).collect()
    check([r[:2] for r in rows], got)
    assert all(len(r.ids) == r.length for r in got)
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(3)
    counts = {int(x): int(n) for x, n in Counter(rng.integers(1, 101, 5000).tolist()).items()}
    rows = plan(counts, 100)
    assert max(s + m // a for _, _, m, a, s, _ in rows) <= sum(m for _, m in best_fit(counts, 100))
    seen = Counter()
    for x, _, m, _, _, _ in rows:
        seen[x] += m
    assert seen == counts


def fewest(pieces, capacity):
    """The exact number of sequences, by trying every place for each piece."""
    best = len(pieces)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(pieces):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= pieces[k] and rooms[i] not in rooms[:i]:
                go(k + 1, [r - pieces[k] * (j == i) for j, r in enumerate(rooms)])
        go(k + 1, [*rooms, capacity - pieces[k]])

    go(0, [])
    return best


def test_the_program_bounds_the_exact_number_and_its_rounding_comes_close():
    rng = np.random.default_rng(8)
    for _ in range(12):
        capacity = int(rng.integers(8, 30))
        pieces = sorted(rng.integers(1, capacity + 1, 9).tolist(), reverse=True)
        counts = dict(Counter(pieces))
        used, total, bound = fractional(counts, capacity)
        exact = fewest(pieces, capacity)
        assert all(sum(x * a for x, a in key) <= capacity for key in used)
        for x, n in counts.items():
            assert sum(u * a for key, u in used.items() for y, a in key if y == x) >= n - 1e-3
        assert bound <= exact + 1e-9 and bound <= total + 1e-9
        groups = rounded(counts, capacity)
        got = sum(m for _, m in groups)
        assert exact <= got <= exact + 1 and got <= np.ceil(total) + len(counts)


def test_the_program_closes_the_gap_and_is_used():
    rng = np.random.default_rng(9)
    counts = {int(x): int(n) for x, n in Counter(np.minimum(rng.lognormal(4, 1, 6000), 512).astype(int) + 1).items() if x <= 512}
    used, total, bound = fractional(counts, 512)
    assert total <= 1.02 * bound
    groups = rounded(counts, 512)
    assert sum(m for held, m in groups if sum(x * a for x, a in held.items()) == 512) > 0.5 * total
    assert sum(m for _, m in groups) <= min(np.ceil(total), sum(m for _, m in best_fit(counts, 512)))


def test_knapsack_is_the_best_of_all():
    worth = np.full(13, -np.inf)
    worth[[2, 3, 5, 7]] = [1.0, 1.7, 3.1, 4.2]
    best, _ = knapsack(worth)
    for room in range(13):
        assert abs(best[room] - max(a * 1.0 + b * 1.7 + c * 3.1 + d * 4.2 for a in range(7) for b in range(5) for c in range(3) for d in range(2) if 2 * a + 3 * b + 5 * c + 7 * d <= room)) < 1e-9


def test_a_hot_length_is_dealt_to_several_tasks(spark):
    tmp = Scratch(spark)
    rows = spark.range(500).selectExpr("id % 200 as doc_id", "int(0) as piece", "if(id < 400, 7L, id % 60 + 1) as length")
    got = pack(tmp.table(rows), tmp, 64, rows_per_salt=30).collect()
    assert len(got) == 500
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        ends = [0]
        for offset, length in sorted(held):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 64
