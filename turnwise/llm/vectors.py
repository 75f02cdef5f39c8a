"""Embedding near-duplicates: Euclidean p-stable hashing of normalised vectors, then exact cosine."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

#: Rows of a chunk that are multiplied at once.
PANEL = 512


@lru_cache(4)
def _projection(d: int, tables: int, projections: int, width: float, seed: int):
    """Gaussian directions, offsets and the mixer that joins the quantised values of a table."""
    draw = np.random.default_rng(seed + d)
    return draw.standard_normal((tables * projections, d)).T.copy(), draw.uniform(0, width, tables * projections), draw.integers(1, 1 << 62, projections) * 2 + 1


def smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0..n-1 reaches by the links (i, j)."""
    label = np.arange(n)
    while True:
        both = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, both)
        np.minimum.at(new, j, both)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, tables: int = 100, projections: int = 16, width: float = 2.0, chunk: int = 2048, seed: int = 8) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector; a link is a cosine of at least `threshold`, in double precision.

    Equal vectors form a class. A table's bucket is the quantised value of `projections` Gaussian projections of the unit
    vector; a pair at cosine 0.95 is missed by all 100 tables with a chance of 6e-6. Buckets are cut into chunks by a hash of
    the id and compared chunk by chunk, so none is gathered whole; a pair counts in the first table where it meets. Links never
    leave the task that finds them: of each block of two chunks come, for each class, its number of links and the smallest class
    it reaches there, so a large cluster gives rows in the number of its classes and blocks, not of its pairs.

    Null vectors, zero vectors and those with null or non-finite components have no links and are kept; so are null ids, whose
    component is null. Vectors of different sizes are never compared. Rows that repeat an id: each row gets the links of its id,
    and equal vectors under one id are one vector. Other columns are ignored.
    """
    tmp = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = rows.where("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)").dropDuplicates()
    classes = tmp.table(fine.groupBy("v").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("copies")))

    def units(batch):
        v = batch.column("v")
        offsets, flat = v.offsets.to_numpy(), v.values.to_numpy()
        for d in np.unique(np.diff(offsets)).tolist():
            own = np.flatnonzero(np.diff(offsets) == d)
            x = flat[offsets[own][:, None] + np.arange(d)]
            x = x / np.abs(x).max(1, keepdims=True)
            yield own, d, x / np.sqrt((x * x).sum(1, keepdims=True))

    def codes(x, d):
        a, b, mixer = _projection(d, tables, projections, width, seed)
        return (np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, projections) * mixer).sum(2) + d

    def key_rows(batches):
        for whole in batches:
            for batch in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                for own, d, x in units(batch):
                    c = codes(x, d)
                    ids = batch.column("cls").to_numpy()[own]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))), pa.array(c.reshape(-1))], ["cls", "t", "code"])

    keys = tmp.table(classes.select("cls", "v").mapInArrow(key_rows, "cls long, t int, code long"))
    crowded = keys.groupBy("t", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.expr(f"cast(ceil(n / {chunk}) as int)")
    dealt = keys.join(crowded, ["t", "code"]).select("t", "code", "cls", parts.alias("p"), F.pmod(F.xxhash64("cls", "t"), parts).cast("int").alias("part"))
    # chunk i meets chunk j in block (i, j), i <= j
    blocks = dealt.select("t", "code", "cls", "part", F.explode(F.expr("transform(sequence(0, p - 1), j -> struct(least(part, j) as i, greatest(part, j) as j))")).alias("b"))
    blocks = blocks.select("t", F.xxhash64("t", "code", "b.i", "b.j").alias("block"), F.when(F.col("b.i") == F.col("b.j"), F.lit(2)).when(F.col("part") == F.col("b.i"), F.lit(0)).otherwise(F.lit(1)).alias("side"), "cls")
    full = blocks.join(classes, "cls")

    def compare(rows):
        """(class, its links, the smallest class that it reaches) of the blocks in rows, which hold whole blocks, sorted."""
        batch = rows.combine_chunks().to_batches()[0]
        block, t, side, ids, copies = (batch.column(k).to_numpy() for k in ("block", "t", "side", "cls", "copies"))
        for own, d, x in units(batch):
            code = None
            known, first, of_id = np.unique(ids[own], return_index=True, return_inverse=True)
            weight = copies[own][first]
            cuts = [0, *(np.flatnonzero(block[own][1:] != block[own][:-1]) + 1).tolist(), len(own)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                sides = side[own[s:e]]
                # within a chunk each pair once; between two chunks from the first to the second
                one, two = (np.arange(s, e),) * 2 if sides[0] == 2 else (s + np.flatnonzero(sides == 0), s + np.flatnonzero(sides == 1))
                if e - s < 2 or not len(one) or not len(two):
                    continue
                now, pairs = int(t[own[s]]), []
                if now and code is None:
                    code = codes(x[first], d)
                for some in np.split(one, range(PANEL, len(one), PANEL)):
                    i, j = np.nonzero(x[some] @ x[two].T >= threshold - 1e-9)
                    i, j = some[i], two[j]
                    keep = i < j if sides[0] == 2 else np.ones(len(i), bool)
                    i, j = i[keep], j[keep]
                    for earlier in range(now):
                        if not len(i):
                            break
                        fresh = code[of_id[i], earlier] != code[of_id[j], earlier]
                        i, j = i[fresh], j[fresh]
                    same = np.einsum("nd,nd->n", x[i], x[j]) >= threshold
                    pairs.append((of_id[i[same]], of_id[j[same]]))
                i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
                if len(i):
                    n = np.bincount(i, weight[j], len(known)) + np.bincount(j, weight[i], len(known))
                    met = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(known[met]), pa.array(n[met].astype(np.int64)), pa.array(known[smallest(len(known), i, j)[met]])], ["cls", "n", "least"])

    def linked(batches):
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            block = rows.column("block").to_numpy()
            begin = int(np.flatnonzero(block == block[-1])[0])  # the last block may go on in the next batch
            if begin:
                yield from compare(rows.slice(0, begin))
            waiting = rows.slice(begin)
        if waiting is not None:
            yield from compare(waiting)

    met = tmp.table(full.repartition("block").sortWithinPartitions("block").select("t", "block", "side", "cls", "copies", "v").mapInArrow(linked, "cls long, n long, least long"))
    counts = met.groupBy("cls").agg(F.sum("n").alias("n"))
    found = components(tmp, met.select(F.col("cls").alias("a"), F.col("least").alias("b")))
    of_class = classes.join(counts, "cls", "left").join(found.withColumnRenamed("id", "cls"), "cls", "left")
    of_class = of_class.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "cls").alias("c"))
    of_id = fine.join(of_class, "v").groupBy("id").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    out = rows.select("id").join(of_id, "id", "left").select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
