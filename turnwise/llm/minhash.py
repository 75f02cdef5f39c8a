"""MinHash near-duplicates with tensored banding.

A table key is a pair of factor keys, one from each of two small collections, so `factors`**2 tables need the hashes of
2 * `factors` keys only. Keys found in one class alone are dropped before the pairs are formed. Candidates are confirmed on full
sets of shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, join_hot
from .text import list_column, segment_reduce, shingle_sets, signed, slices

#: 64-bit words of a set's bitmap.
WORDS = 16
#: About how many classes of one left key are compared at once.
BLOCK = 64
#: A class of equal sets: its smallest id, and a hash of its set, since an id may come with several texts.
CLASS = "struct<doc:bigint,s:bigint>"


def _factor_keys(values: np.ndarray, offsets: np.ndarray, factors: int, width: int, seed: int) -> np.ndarray:
    """(documents, 2 * factors): each key joins `width` minima."""
    draw = np.random.default_rng(seed)
    keys = np.zeros((len(offsets) - 1, 2 * factors), np.uint64)
    for k in range(2 * factors):
        key = np.full(len(offsets) - 1, k + 1, np.uint64)
        for _ in range(width):
            a, b = draw.integers(1, 1 << 63, 2, np.uint64) * np.uint64(2) + np.uint64(1)
            least = segment_reduce(np.minimum, (values ^ (values >> np.uint64(29))) * a + b, offsets, np.uint64(0))
            key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        keys[:, k] = key
    return keys


def shingle_table(docs: DataFrame, id_col: str, text_col: str, factors: int, width: int, size: int, seed: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, factor keys): set_a and set_b together stand for the whole set."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values, offsets = shingle_sets(part.column("text"), size)
                n = len(offsets) - 1
                a = _set_sum(values, offsets)
                b = segment_reduce(np.add, (values ^ (values >> np.uint64(31))) * (values | np.uint64(1)), offsets, np.uint64(0))
                keys = _factor_keys(values, offsets, factors, width, seed)
                rows = np.arange(n + 1) * 2 * factors
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), signed(a), signed(b), list_column(keys.reshape(-1), rows)], ["doc_id", "n_shingles", "set_a", "set_b", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>")


def bitmaps(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, WORDS): a bit for each value that a document's set has in its top bits."""
    n, bits = len(offsets) - 1, 64 * WORDS
    flags = np.zeros(n * bits, bool)
    flags[np.repeat(np.arange(n), np.diff(offsets)) * bits + (values >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(flags.reshape(n, bits), axis=1, bitorder="little").view(np.uint64).reshape(n, WORDS)


def can_reach(n, bits, other_n, other_bits, percent: int) -> np.ndarray:
    """Matrix of which sets of two tables can be as similar as `percent`, by their sizes and bitmaps.

    Each bit that only one bitmap has stands for a member, at least, that only that set has; so no pair that is similar enough fails.
    """
    n, other_n = n[:, None], other_n[None, :]
    x, y = bits[:, None, :], other_bits[None, :, :]
    both = np.minimum(n - np.bitwise_count(x & ~y).sum(2, dtype=np.int64), other_n - np.bitwise_count(y & ~x).sum(2, dtype=np.int64))
    return 100 * both >= percent * (n + other_n - both)


def _set_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return segment_reduce(np.add, values * np.uint64(0xD6E8FEB86659FD93), offsets, np.uint64(0))


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, size: int) -> DataFrame:
    """(cls, n, members, bits) of the wanted classes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values, offsets = shingle_sets(part.column("text"), size)
                cls = pa.StructArray.from_arrays([part.column("id"), signed(_set_sum(values, offsets))], ["doc", "s"])
                yield pa.RecordBatch.from_arrays([cls, pa.array(np.diff(offsets)), list_column(values, offsets), list_column(bitmaps(values, offsets).reshape(-1), np.arange(len(offsets)) * WORDS)], ["cls", "n", "members", "bits"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = texts.join(wanted.select(F.col("cls.doc").alias("id")).distinct(), "id", "left_semi").mapInArrow(run, f"cls {CLASS}, n long, members array<long>, bits array<long>")
    # an id that is repeated gives its sets again, and those of its other texts
    return found.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("members").alias("members"))


def _confirmed(tmp: Scratch, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored pairs (a, b) with 100 * intersection >= percent * union, on full sets."""

    def run(batches):
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = np.zeros(batch.num_rows, bool)
            lv, rv = left.values.to_numpy(), right.values.to_numpy()
            lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
            for i in range(batch.num_rows):
                x, y = lv[lo[i] : lo[i + 1]].view(np.uint64), rv[ro[i] : ro[i + 1]].view(np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    one = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("members").alias("left"))
    two = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("members").alias("right"))
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    # sizes first, so that full sets travel for pairs that can be near only
    sized = join_hot(join_hot(pairs, two.drop("right"), ["b"], "a"), one.drop("left"), ["a"], "b", counted=pairs)
    sized = tmp.table(sized.where(near).select("a", "b"))
    met = join_hot(join_hot(sized, two.drop("nb"), ["b"], "a"), one.drop("na"), ["a"], "b", counted=sized)
    return met.select("a", "b", "left", "right").mapInArrow(run, f"a {CLASS}, b {CLASS}")


def block_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes that share a left and a right key, are in different components and can be similar enough, from open_(u, cls, c, n, bits, vs).

    The classes of a left key are dealt to blocks of about BLOCK. Blocks, not classes, are joined, and a key with many blocks is salted
    over about the root of their number of tasks; only pairs that pass leave.
    """
    sizes = open_.groupBy("u").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).alias("blocks"), F.count(F.lit(1)).alias("_n"))
    dealt = join_hot(open_, sizes.select("u", "blocks", F.ceil(F.sqrt("blocks")).alias("salts")), ["u"], "cls", counts=sizes.select("u", "_n")).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    packed = dealt.groupBy("u", "block", "salts").agg(F.collect_list(F.struct("cls", "c", "n", "bits", "vs")).alias("rows"))
    one = packed.select("u", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("rows").alias("one"))
    two = packed.select("u", F.col("block").alias("j"), F.pmod("block", "salts").alias("salt"), F.col("rows").alias("two"))

    def opened(block):
        rows = block.values
        name = lambda c: np.stack([rows.field(c).field(k).to_numpy() for k in ("doc", "s")], 1)
        table = lambda c: rows.field(c).flatten().to_numpy().view(np.uint64).reshape(len(rows), -1)
        return name("cls"), name("c"), rows.field("n").to_numpy(), table("bits"), table("vs")

    def compare(batches):
        for batch in batches:
            for x, y in zip(batch.column("one"), batch.column("two"), strict=True):
                (a, ca, na, ba, va), (b, cb, nb, bb, vb) = opened(x), opened(y)
                open_pairs = (ca[:, None, :] != cb[None, :, :]).any(2) & (np.minimum(na[:, None], nb) * 100 >= np.maximum(na[:, None], nb) * percent)
                open_pairs &= (va[:, None, :] == vb[None, :, :]).any(2)
                i, j = np.nonzero(open_pairs & can_reach(na, ba, nb, bb, percent))
                less = (a[i, 0] < b[j, 0]) | ((a[i, 0] == b[j, 0]) & (a[i, 1] < b[j, 1]))
                lo, hi = np.where(less[:, None], a[i], b[j]), np.where(less[:, None], b[j], a[i])
                ends = [pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(e[:, 0])), pa.array(np.ascontiguousarray(e[:, 1]))], ["doc", "s"]) for e in (lo, hi)]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return one.join(two, ["u", "salt"]).where("i <= j").select("one", "two").mapInArrow(compare, f"a {CLASS}, b {CLASS}").distinct()


def mixed_keys(tmp: Scratch, keyed: DataFrame, factors: int) -> DataFrame:
    """(cls, c, few, us, vs) from keyed(cls, c, few, k, key): the left and right keys that classes of different components have.

    The components of a key are compared by a hash; two that have the same one, in a key of no others, would be taken for one (2**-64).
    """
    h = F.xxhash64("c")
    keys = tmp.table(keyed.groupBy("key").agg(F.min(h).alias("lo"), F.max(h).alias("hi"), F.count(F.lit(1)).alias("_n")).where("lo <> hi").select("key", "_n"))
    met = join_hot(keyed, keys.select("key"), ["key"], "cls", counts=keys)
    side = lambda test: F.collect_list(F.when(test, F.col("key")))
    return met.groupBy("cls", "c", "few").agg(side(F.col("k") < factors).alias("us"), side(F.col("k") >= factors).alias("vs"))


def voted(tmp: Scratch, keyed: DataFrame, first) -> DataFrame:
    """(a, b): each class of keyed(cls, c, few, key) with the class of another component that most of its keys name, two of them at least. A key names its most copied class, or its least copied one where `first` is F.max."""
    named = keyed.groupBy("key").agg(first(F.struct("few", "cls", "c")).alias("rep"), F.count(F.lit(1)).alias("_n"), F.min(F.xxhash64("c")).alias("lo"), F.max(F.xxhash64("c")).alias("hi"))
    named = tmp.table(named.where("lo <> hi").select("key", "rep", "_n"))
    votes = join_hot(keyed.select("cls", "c", "key"), named.drop("_n"), ["key"], "cls", counts=named.select("key", "_n")).where("c <> rep.c")
    best = votes.groupBy("cls", "rep").agg(F.count(F.lit(1)).alias("votes")).where("votes > 1").groupBy("cls").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "rep")).alias("best"))
    return best.select(F.least("best.rep.cls", "cls").alias("a"), F.greatest("best.rep.cls", "cls").alias("b")).distinct()


#: Buckets that are broadcast, 8 bytes each.
FEW = 250_000


def open_rows(tmp: Scratch, mixed: DataFrame) -> DataFrame:
    """(u, cls, c) from mixed(cls, c, us, vs): a row for each class and left key that has, with one of its right keys, classes of different components."""
    mixed = tmp.table(mixed)
    one = mixed.select("cls", "c", "vs", F.explode("us").alias("u"))
    tables = one.select("cls", "c", "u", F.explode("vs").alias("v")).select("cls", "c", "u", F.xxhash64("u", "v").alias("bucket"))
    h = F.xxhash64("c")
    buckets = tmp.table(tables.groupBy("bucket").agg(F.min(h).alias("lo"), F.max(h).alias("hi"), F.count(F.lit(1)).alias("_n")).where("lo <> hi").select("bucket", "_n"))
    if buckets.count() <= FEW:
        return tables.join(F.broadcast(buckets.select("bucket")), "bucket").select("u", "cls", "c").distinct()
    # Spark sizes the tables as the classes they are made of, 576 times too small, and must not broadcast them
    return join_hot(tables, buckets.select("bucket"), ["bucket"], "cls", counts=buckets, grown=True).select("u", "cls", "c").distinct()


def _links_of_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): the classes of each id that has several, each linked with its first."""
    key = F.struct("set_a", "set_b", "n_shingles")
    several = rows.groupBy("doc_id").agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first <> last")
    edges = rows.join(several, "doc_id").where(key != F.col("first")).select("first", key.alias("other")).distinct()
    named = lambda k, x: classes.select(key.alias(k), F.col("cls").alias(x))
    return edges.join(named("first", "x"), "first").join(named("other", "y"), "other").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, factors: int = 24, width: int = 3, size: int = 5, seed: int = 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document.

    Documents with the same set form a class. Candidate pairs of classes are those that share a factor key of each collection;
    a pair at the threshold is missed with a chance under 2 * (1 - 0.75**width)**factors, 4e-6 here. The most copied class
    of each key is put to the key's other components, and a class is compared with the one it is given most often, then the same with the least copied, so that large
    groups collapse. The pairs of keys are formed only then, of keys that still join different components; all members of such
    a table's bucket are compared with each other, so no candidate goes unchecked. Those meet in blocks of each left key, and
    only pairs whose sizes and bitmaps leave the threshold in reach go on to full sets.

    Null and empty texts have an empty set and stay alone; so does a null id, whose component is null and which is kept. Rows
    that repeat an id are returned each; where its texts differ, the id links their classes. Other columns are ignored.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent lies in 1..100")
    tmp = Scratch(docs.sparkSession)
    rows = tmp.table(shingle_table(docs, id_col, text_col, factors, width, size, seed))
    some = rows.where("n_shingles > 0 and doc_id is not null")
    classes = tmp.table(some.groupBy("set_a", "set_b", "n_shingles").agg(F.struct(F.min("doc_id").alias("doc"), F.col("set_a").alias("s")).alias("cls"), F.min_by("keys", "doc_id").alias("keys"), (-F.count(F.lit(1))).alias("few")))
    listed = classes.select("cls", F.col("cls").alias("c"), "few", F.posexplode("keys").alias("k", "key"))
    live = tmp.table(mixed_keys(tmp, listed, factors).where("size(us) > 0 and size(vs) > 0"))
    sets = tmp.table(_sets(docs, id_col, text_col, live.select("cls"), size))
    links = tmp.table(_links_of_ids(some, classes))
    tried = tmp.table(links.limit(0))
    right_keys = classes.select("cls", F.slice("keys", factors + 1, factors).alias("vs"))
    for step in ("vote", "vote again", "rest"):
        found = components(tmp, links)
        placed = live.join(found.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "few", "us", "vs", F.coalesce("component", "cls").alias("c"))
        placed = tmp.table(placed)
        keyed = placed.select("cls", "c", "few", F.posexplode(F.concat("us", "vs")).alias("k", "key"), F.size("us").alias("left"))
        keyed = keyed.select("cls", "c", "few", "key", F.when(F.col("k") < F.col("left"), 0).otherwise(factors).alias("k"))
        if step == "rest":
            pairs = block_pairs(open_rows(tmp, mixed_keys(tmp, keyed, factors)).join(sets.select("cls", "n", "bits"), "cls").join(right_keys, "cls"), percent)
        else:
            pairs = voted(tmp, keyed, F.min if step == "vote" else F.max)
        fresh = tmp.table(pairs.join(tried, ["a", "b"], "left_anti"))
        more = tmp.table(_confirmed(tmp, fresh, sets, percent))
        both, all_tried = tmp.table(links.unionByName(more)), tmp.table(tried.unionByName(fresh))
        tmp.drop(found, placed, links, more, fresh, tried)
        links, tried = both, all_tried
    found = components(tmp, links)
    tmp.drop(tried, sets, live, links)
    of_class = classes.join(found.withColumnRenamed("id", "cls"), "cls", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "cls").alias("c"))
    out = join_hot(rows.drop("keys"), of_class, ["set_a", "set_b", "n_shingles"], "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c.doc", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def miss_chance(percent: int, factors: int, width: int) -> float:
    """At most this chance of missing a pair at the threshold."""
    return min(1.0, 2 * math.pow(1 - (percent / 100) ** width, factors))
