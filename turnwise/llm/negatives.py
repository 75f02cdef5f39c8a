"""Hard-negative mining: length buckets with sorted coordinate lists, feasible ranges of focus coordinates, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Slack of the feasible ranges, which are computed in double precision; scores are exact.
SLACK = 1e-9
LOW = -(1 << 63)


def prepared(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """(id, label, x, d, norm, row): rows with an id, a label and finite components, equal ones once.

    Every label whose id is divisible by 7 is (label + 1) % 10. x = floor(scale * component), held within the square root of
    2^62 / d, so that every inner product fits a long. `row` tells rows of one id apart.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    most = "floor(sqrt(pow(2.0D, 62) / greatest(size(v), 1)))"
    # clipped before the floor, which would not fit a long else
    x = F.expr(f"transform(v, c -> cast(floor(greatest(-{most}, least({most}, c * {float(scale)!r}D))) as bigint))")
    rows = rows.select("id", F.expr("if(id % 7 = 0, (label + 1) % 10, label)").alias("label"), x.alias("x"), F.size("v").alias("d")).distinct()
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    return rows.select("*", norm.alias("norm"), F.xxhash64("id", "label", "x").alias("row"))


class Index:
    """Rows of one length bucket: unit vectors with a sorted list for each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, x: np.ndarray):
        by_id = np.lexsort((rows, ids))
        self.ids, self.labels, self.rows, self.x = ids[by_id], labels[by_id], rows[by_id], x[by_id]
        real = self.x.astype(float)
        self.lengths = np.sqrt((real * real).sum(1))
        self.low, self.high = self.lengths.min(), self.lengths.max()
        unit = np.divide(real, self.lengths[:, None], out=np.zeros_like(real), where=self.lengths[:, None] > 0)
        self.order = unit.argsort(0).T.copy()
        self.sorted = np.take_along_axis(unit.T, self.order, 1)
        # products and their sums are whole numbers that doubles hold
        self.real = real if np.abs(real).max(initial=0) < 2.0**20 and real.shape[1] < 1 << 12 else None

    def candidates(self, q: np.ndarray, length: float, least: int, focus: int) -> np.ndarray | None:
        """Places of the rows that can have an inner product of at least `least` with q; None for all.

        A unit vector whose cosine with q is at least c differs from q by an angle of acos(c) at most, and so each of its
        coordinates lies in a range around q's: those of the `focus` largest ones of q are looked up in the sorted lists, and
        what lies in all ranges is left.
        """
        if length == 0 or not self.high:
            return None if least <= 0 else np.zeros(0, np.int64)
        reach = self.high if least > 0 else self.low  # the length at which the least cosine is lowest
        if not reach:
            return None
        cosine = least / (length * reach) - SLACK
        if cosine > 1:
            return np.zeros(0, np.int64)
        if cosine <= -1:
            return None
        angle, own = np.arccos(cosine), np.arccos(np.clip(q / length, -1, 1))
        met, ranges = None, []
        for f in np.argsort(-np.abs(q), kind="stable")[:focus].tolist():
            low, high = np.cos(min(np.pi, own[f] + angle)) - SLACK, np.cos(max(0.0, own[f] - angle)) + SLACK
            begin, end = np.searchsorted(self.sorted[f], low, "left"), np.searchsorted(self.sorted[f], high, "right")
            if end - begin < len(self.ids):
                ranges.append((end - begin, f, begin, end))
        if not ranges:
            return None
        for _, f, begin, end in sorted(ranges):
            own_set = np.zeros(len(self.ids), bool)
            own_set[self.order[f, begin:end]] = True
            met = own_set if met is None else met & own_set
        return np.flatnonzero(met)

    def scores(self, q: np.ndarray, at: np.ndarray | None) -> np.ndarray:
        """Exact inner products."""
        if self.real is not None and np.abs(q).max(initial=0) < 1 << 20:
            whole = at is None or 2 * len(at) > len(self.ids)
            s = (self.real if whole else self.real[at]) @ q.astype(float)
            return (s[at] if whole and at is not None else s).astype(np.int64)
        return (self.x if at is None else self.x[at]) @ q


def first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, the earlier first among equal ones."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return some[np.argsort(-scores[some], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")[:k]


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def search_block(index: Index, queries: pa.Table, k: int, focus: int, same: bool) -> list[tuple]:
    """(anchor_id, anchor, group, id, row, score) of a bucket's rows for a block of queries.

    A query has windows (group, least, most, score and id of the k-th row known): of the rows with the label (same) or with other
    ones, the k first in each window, without what comes after the k-th known.
    """
    q_all, found = _matrix(queries.column("x"), index.x.shape[1]), []
    for q, r in zip(q_all, queries.drop_columns(["x"]).to_pylist(), strict=True):
        windows = r["windows"]
        length = float(np.sqrt((q.astype(float) ** 2).sum()))
        at = index.candidates(q, length, min(max(w["least"], w["score"]) for w in windows), focus)
        if at is not None and not len(at):
            continue
        s = index.scores(q, at)
        at = np.arange(len(s)) if at is None else at
        fits = index.labels[at] == r["label"]
        if same:
            fits &= ~((index.ids[at] == r["id"]) & (index.rows[at] == r["row"]))
        else:
            fits = ~fits
        for w in windows:
            own = np.flatnonzero(fits & (s >= max(w["least"], w["score"])) & (s <= w["most"]))
            if w["known"] is not None:
                own = own[(s[own] > w["score"]) | (index.ids[at[own]] <= w["known"])]
            for p in own[first(s[own], k)].tolist():
                found.append((r["id"], r["row"], w["group"], int(index.ids[at[p]]), int(index.rows[at[p]]), int(s[p])))
    return found


WINDOWS = "array<struct<group:bigint,least:bigint,most:bigint,score:bigint,known:bigint>>"
FOUND = "anchor_id long, anchor long, group long, id long, row long, score long"
ANCHOR = ["anchor_id", "anchor"]


class Search:
    """Exact searches for the first rows of each query's windows among all rows.

    Rows are dealt to rounds by a hash: each round has up to `step` times the rows of all earlier ones, and what it finds is the
    threshold of the next, so of all the rows that a query meets, few are found for each round, whatever their number. In a
    round, rows of a length bucket are dealt to chunks and queries to blocks of bounded size; a chunk meets a block as
    one group. A query goes only to buckets that are long enough for its threshold.
    """

    def __init__(self, tmp: Scratch, rows: DataFrame, buckets: int, chunk: int, block: int, focus: int, step: int = 16):
        self.tmp, self.chunk, self.block, self.focus = tmp, chunk, block, focus
        # sizes of vectors are few, and so are the rows of these tables and of stats below
        sizes = {r["d"]: r for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("norm", [(i + 1) / buckets for i in range(buckets - 1)] or [0.5], 10_000).alias("cuts")).collect()}
        total = sum(r["n"] for r in sizes.values())
        self.rounds, power = 1, 1
        while power * step * chunk <= total or power == 1 and chunk < total:
            power, self.rounds = power * step, self.rounds + 1
        cuts = []  # for each size of vectors, of the quantiles as many as fill its buckets
        for d, r in sizes.items():
            n = min(buckets, max(1, r["n"] // chunk))
            cuts.append((d, sorted({r["cuts"][i * buckets // n - 1] for i in range(1, n)})))
        cuts = F.broadcast(rows.sparkSession.createDataFrame(cuts, "d int, cuts array<double>"))
        dealt = F.pmod(F.xxhash64("row", F.lit("round")), F.lit(power))
        turn, p = F.lit(self.rounds - 1), 1
        for t in range(self.rounds - 2, -1, -1):
            p *= step
            turn = F.when(dealt % p == 0, F.lit(t)).otherwise(turn)
        self.rows = tmp.table(rows.join(cuts, "d").select(*rows.columns, F.expr("size(filter(cuts, c -> c < norm))").alias("bucket"), turn.alias("turn")))
        stats = self.rows.groupBy("turn", "d", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("low"), F.max("norm").alias("high")).collect()
        #: (turn, d, bucket, chunks, low, high): a row for each round, size of vectors and bucket
        self.stats = [(r["turn"], r["d"], r["bucket"], -(-r["n"] // chunk), r["low"], r["high"]) for r in stats]

    def run(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """queries(id, row, label, x, d, norm, windows) -> FOUND, the first k rows of each window by score and then id, a stored table."""
        spark, tmp = queries.sparkSession, self.tmp
        blocks = max(1, -(-queries.count() // self.block))
        queries = queries.withColumn("q", F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)).cast("int"))
        best = None
        for turn in range(self.rounds):
            places = [s[1:] for s in self.stats if s[0] == turn]
            if not places:
                continue
            stats = F.broadcast(spark.createDataFrame(places, "d int, bucket int, chunks int, low double, high double"))
            now = queries if best is None else self._tightened(queries, best, k)
            least = F.array_min(F.transform("windows", lambda w: F.greatest(w["least"], w["score"]))).cast("double")
            # a product of lengths bounds the score
            reached = now.join(stats, "d").where(least <= F.greatest(F.col("norm") * F.col("high") * (1 + SLACK) + SLACK, F.lit(0.0)))
            unit = F.xxhash64("d", "bucket", "c", "q").alias("unit")
            sent = reached.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(unit, "id", "row", "label", "x", "windows").toDF("unit", "id", "row", "label", "x", "windows")
            rows = self.rows.where(F.col("turn") == turn).join(stats.select("d", "bucket", "chunks"), ["d", "bucket"])
            rows = rows.withColumn("c", F.pmod(F.xxhash64("row", F.lit("chunk")), F.col("chunks")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            rows = rows.select(unit, "id", "row", "label", "x").toDF("unit", "id", "row", "label", "x")
            focus = self.focus

            def compare(left: pa.Table, right: pa.Table) -> pa.Table:
                found = []
                if left.num_rows and right.num_rows:
                    d = len(left.column("x")[0])
                    index = Index(*(left.column(c).to_numpy() for c in ("id", "label", "row")), _matrix(left.column("x"), d))
                    found = search_block(index, right, k, focus, same)
                columns = list(zip(*found, strict=True)) or [()] * 6
                return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "anchor", "group", "id", "row", "score"])

            met = rows.groupBy("unit").cogroup(sent.groupBy("unit")).applyInArrow(compare, FOUND)
            both = met if best is None else met.unionByName(best)
            ranked = both.withColumn("n", F.row_number().over(Window.partitionBy(*ANCHOR, "group").orderBy(F.desc("score"), "id", "row")))
            old, best = best, tmp.table(ranked.where(F.col("n") <= k).drop("n"))
            if old is not None:
                tmp.drop(old)
        return tmp.table(spark.createDataFrame([], FOUND)) if best is None else best

    def _tightened(self, queries: DataFrame, best: DataFrame, k: int) -> DataFrame:
        """Windows with the k-th row known; those with fewer rows stay as they are."""
        last = best.groupBy(*ANCHOR, "group").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("score", (-F.col("id")).alias("after"))).alias("last")).where(F.col("n") == k)
        of_anchor = last.groupBy(*ANCHOR).agg(F.map_from_entries(F.collect_list(F.struct("group", "last"))).alias("lasts"))  # a group for each window of an anchor
        now = queries.join(of_anchor.withColumnsRenamed({"anchor_id": "id", "anchor": "row"}), ["id", "row"], "left")
        known = F.expr("transform(windows, w -> if(lasts[w.group] is null, w, named_struct('group', w.group, 'least', w.least, 'most', w.most, 'score', lasts[w.group].score, 'known', -lasts[w.group].after)))")
        return now.withColumn("windows", known.cast(WINDOWS)).drop("lasts")


def hard_negatives(vectors: DataFrame, anchors: str = "id % 50 = 0", positives: int = 5, negatives: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", buckets: int = 32, chunk: int = 4096, block: int = 4096, focus: int = 3) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    Scores are integer inner products of floored vectors (`prepared`), higher ones first, ties by the smaller id. An anchor's
    positives are its first `positives` other rows of the same label; for each, the first `negatives` rows of other labels
    whose score is from 50 % to 95 % of the positive's. A positive with a negative score has no such row.

    Rows with a null id, label or vector, or with null or non-finite components, take no part; an empty vector has only scores
    of 0. Rows equal in id, label and vector are one row; rows of one id that differ are different rows, each an anchor if the
    id is. Vectors of different sizes never meet. Other columns are ignored. An empty table gives an empty result.
    """
    tmp = Scratch(vectors.sparkSession)
    search = Search(tmp, tmp.table(prepared(vectors, id_col, vec_col, label_col)), buckets, chunk, block, focus)
    queries = search.rows.where(anchors).select("id", "row", "label", "x", "d", "norm")
    everything = F.array(F.struct(F.lit(0).alias("group"), F.lit(LOW).alias("least"), F.lit(-LOW - 1).alias("most"), F.lit(LOW).alias("score"), F.lit(None).alias("known"))).cast(WINDOWS)
    best = search.run(queries.withColumn("windows", everything), positives, same=True).select(*ANCHOR, F.col("id").alias("positive_id"), F.col("row").alias("positive_row"), F.col("score").alias("positive_score"))
    # 50 p <= 100 s <= 95 p: whole s from ceil(p / 2) to floor(19 p / 20); equal scores share a window
    window = F.struct(F.col("positive_score").alias("group"), F.expr("positive_score div 2 + positive_score % 2").alias("least"), F.expr("positive_score - (positive_score div 20 + if(positive_score % 20 = 0, 0, 1))").alias("most"), F.lit(LOW).alias("score"), F.lit(None).cast("long").alias("known"))
    windows = best.where("positive_score >= 0").groupBy(*ANCHOR).agg(F.collect_set(window).alias("windows"))  # `positives` at most
    mined = search.run(queries.join(windows.withColumn("windows", F.col("windows").cast(WINDOWS)).withColumnsRenamed({"anchor_id": "id", "anchor": "row"}), ["id", "row"]), negatives, same=False)
    ranked = mined.select(*ANCHOR, F.col("group").alias("positive_score"), F.row_number().over(Window.partitionBy(*ANCHOR, "group").orderBy(F.desc("score"), "id", "row")).alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(ranked, [*ANCHOR, "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
