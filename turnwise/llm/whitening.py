"""Embedding whitening: shifted CholeskyQR over distributed Gram passes, then the SVD of R."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Tasks that add up the partial sums of all tasks before the last one.
FAN = 32
#: Rows that are multiplied at once.
PANEL = 4096
LONG = (1 << 63) - 1


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of an array column, which all have d components."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return flat[offsets[0] : offsets[-1]].reshape(-1, d)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """(id, x): rows whose vector is not null and whose components are all finite; x = floor(scale * component), held within a long."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where("v is not null and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")

    def floors(batches):
        for batch in batches:
            v = batch.column("v")
            x = np.floor(scale * v.values.to_numpy(zero_copy_only=False))
            with np.errstate(invalid="ignore"):
                x = np.where(x >= 2.0**63, LONG, np.where(x < -(2.0**63), -LONG - 1, x.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(v.offsets, pa.array(x.astype(np.int64)))], ["id", "x"])

    return rows.mapInArrow(floors, f"id {dict(rows.dtypes)['id']}, x array<bigint>")


def solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a times the inverse of the upper triangular r, by substitution for all rows at once."""
    q = np.empty_like(a)
    for j in range(len(r)):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def summed(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of part(batches of a task); tasks add up what FAN of them share, one adds up the rest."""

    def first(batches):
        yield pa.RecordBatch.from_arrays([pa.array([part(batches).reshape(-1)], pa.list_(pa.float64()))], ["s"])

    def again(batches):
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("s")[i].values.to_numpy()
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["s"])

    parts = rows.mapInArrow(first, "s array<double>")
    for n in (FAN, 1):
        parts = parts.repartition(n).mapInArrow(again, "s array<double>")
    return np.array(parts.first()["s"])


def triangle(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular r with r'r = gram + shift; a shift that is too small for the Cholesky factor to be real grows tenfold."""
    g = (gram + gram.T) / 2
    least = len(g) * np.finfo(float).eps * max(np.diag(g).max(), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, least)


class Whitening:
    """mean, components (rows, by falling variance), variances and their total, of n vectors with component sums `sums`."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, variances: np.ndarray):
        self.n, self.sums, self.components, self.variances = n, sums, components, variances
        self.mean = np.array([s / n for s in sums])
        self.total = float(variances.sum())
        d = len(sums)
        #: Variances beyond what rounding makes of none.
        self.positive = variances > variances.max(initial=0) * (max(d, 64) * np.finfo(float).eps) ** 2
        self.identity_error: float | None = None

    def apply(self, x: np.ndarray, k: int) -> np.ndarray:
        """Whitened coordinates 1..k of the rows of x; nan for a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.positive[:k], np.sqrt(self.variances[:k]), np.nan)
            return ((x - self.mean) @ self.components[:k].T) / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over the dimensions of (n * x - sum)^2; null where it is beyond a long."""
        most = self.n * int(max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))) + max((abs(s) for s in self.sums), default=0)
        if most * most * max(1, x.shape[1]) <= LONG:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(1).tolist()
        y = self.n * x.astype(object) - np.array(self.sums, object)
        return [int(v) if v <= LONG else None for v in (y * y).sum(1)]


def fit(distinct: DataFrame, d: int, k: int, most_passes: int = 8) -> Whitening:
    """Fit on distinct(x), a stored table of vectors of d components without repeats.

    Each pass divides the centred rows by the triangles so far (a solve for each, no inverse), adds up their Gram matrix and takes
    its Cholesky factor as the next triangle. The first Gram matrix is shifted by 11 (n d + d (d + 1)) u times its largest diagonal
    sum, so that its factor is real for any condition of the rows; later ones only as far as rounding asks. Passes end when
    the rows that went in were orthonormal to 1e-8, so that with the last factor they are to rounding. The product of the
    triangles is the R of a QR factorisation; its SVD gives components and variances. The driver holds d x d matrices only.
    """
    sums = {r["i"]: int(r["s"]) for r in distinct.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()}
    n = distinct.count()
    sums = [sums[i] for i in range(d)]
    mean = np.array([s / n for s in sums])

    def centred(batches):
        for batch in batches:
            x = matrix(batch.column("x"), d)
            for i in range(0, len(x), PANEL):
                yield x[i : i + PANEL] - mean

    factors: list[np.ndarray] = []
    for turn in range(most_passes):

        def gram(batches, known=tuple(factors)):
            total = np.zeros((d, d))
            for a in centred(batches):
                for r in known:
                    a = solve(a, r)
                total += a.T @ a
            return total

        g = summed(distinct, gram).reshape(d, d)
        if not np.diag(g).max() > 0:
            break  # one vector only: nothing varies
        factors.append(triangle(g, 0.0 if turn else 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.abs(g).sum(1).max()))
        if turn and np.abs(g - np.eye(d)).max() <= 1e-8:
            break
    if not factors:
        return Whitening(n, sums, np.eye(d), np.zeros(d))
    r = factors[0]
    for f in factors[1:]:
        r = f @ r
    _, s, vt = np.linalg.svd(r)
    sign = np.sign(vt[np.arange(d), np.abs(vt).argmax(1)])
    model = Whitening(n, sums, vt * sign[:, None], s * s / n)
    k = min(k, d)
    good = model.positive[:k]

    def whitened(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = np.nan_to_num(model.apply(matrix(batch.column("x"), d), k))
            w = np.column_stack([w, np.ones(len(w))])
            total += w.T @ w
        return total

    second = summed(distinct, whitened).reshape(k + 1, k + 1) / n
    covariance = second[:k, :k] - np.outer(second[k, :k], second[k, :k])  # the rows are centred: the means are rounding
    model.identity_error = float(np.abs(covariance - np.eye(k))[np.ix_(good, good)].max(initial=0))
    return model


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 4, scale: float = 256.0) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and its first k components.

    Vectors that are null or hold null or non-finite components are left out. The others are floored to whole numbers
    (`quantised`); the fit weighs each different one once, and every row is then whitened where it stands, without a join. Repeated
    rows and ids each give their own rows, null ids too. Vectors of different sizes are different spaces, fitted one after another;
    one of size 0 has no component, and so no rows. A component without variance has a null `whitened` and explains 0, or null
    if nothing varies; `deviation` is null where it is beyond a long. Other columns are ignored.
    """
    spark, tmp = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = tmp.table(quantised(vectors, id_col, vec_col, scale))
    schema = f"vec_id {dict(rows.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = spark.createDataFrame([], schema)
    for d in sorted(r["d"] for r in rows.where("size(x) > 0").groupBy(F.size("x").alias("d")).agg(F.lit(1)).select("d").collect()):
        of_size = rows.where(F.size("x") == d)
        distinct = tmp.table(of_size.select("x").distinct())
        model = fit(distinct, d, k)
        tmp.drop(distinct)
        found = found.unionByName(of_size.mapInArrow(_whitened(model, d, min(k, d)), schema))
    return found


def _whitened(model: Whitening, d: int, k: int):
    explained = [float(v / model.total) if model.total > 0 else None for v in model.variances[:k]]

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, PANEL) for i in range(0, whole.num_rows, PANEL)):
                x = matrix(batch.column("x"), d)
                w, m = model.apply(x, k).reshape(-1), len(x)
                columns = [
                    batch.column("id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(explained * m, pa.float64()),
                    pa.array([model.identity_error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run
