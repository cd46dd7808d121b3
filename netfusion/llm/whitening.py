"""PCA whitening of embeddings by a tall-skinny QR (TSQR).

Entries are held as integers, so sums are exact and every row is centred without cancellation: (n*x - S)/n. Each partition reduces its
centred rows to one R factor, batch by batch; R factors meet eight at a time in a tree of shuffles, until one is left, whose singular
values and right vectors are those of the whole centred matrix. The covariance is never formed, so its condition is not squared.
What reaches the driver is d sums, one d x d factor and one k x k check, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netfusion.llm.common import cut

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
FAN_IN = 8
#: Entries beyond this have no exact long form and count as non-finite.
LARGEST = 2.0**40
#: A component is without variance if its singular value is below this share of the first, times the dimension.
RANK = 1e-14


def _entries(column) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(which rows hold a vector of finite entries, for each length the positions of its rows and their integers)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.list_(pa.float64()))
    size = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null entries become nan, null vectors have none
    starts = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    good = size >= 0
    bad = np.flatnonzero(~(np.abs(flat) < LARGEST))
    good[np.searchsorted(starts + np.maximum(size, 0), bad, "right")] = False
    out = []
    for d in np.unique(size[good & (size > 0)]).tolist():
        at = np.flatnonzero(good & (size == d))
        out.append((at, np.floor(SCALE * flat[starts[at][:, None] + np.arange(d)]).astype(np.int64) + SHIFT))
    return good, out


def sums(vectors: DataFrame, embedding: str = "embedding") -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, S, least, greatest) of the integer vectors, by dimension; vectors of several lengths are an error."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in _entries(batch.column(0))[1]:
                n, s, lo, hi = held.get(x.shape[1], (0, np.zeros(x.shape[1], np.int64), x[0], x[0]))
                held[x.shape[1]] = [n + len(x), s + x.sum(0), np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0))]
        for d, (n, s, lo, hi) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(s), pa.array(lo), pa.array(hi)], names=["d", "at", "n", "s", "lo", "hi"])

    parts = vectors.select(embedding).mapInArrow(run, "d long, at long, n long, s long, lo long, hi long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = sorted(parts.groupBy("d", "at").agg(exact("n"), exact("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect(), key=lambda r: r["at"])
    if len({r["d"] for r in rows}) > 1:
        raise ValueError(f"vectors have lengths {sorted({r['d'] for r in rows})}")
    n = int(rows[0]["n"]) if rows else 0
    return n, np.array([int(r["s"]) for r in rows], object), np.array([r["lo"] for r in rows], np.int64), np.array([r["hi"] for r in rows], np.int64)


class Centring:
    """n*x - S, exact: in longs where they hold it, else in Python integers."""

    def __init__(self, n: int, s: np.ndarray, low: np.ndarray, high: np.ndarray):
        most = max((max(int(n * int(h) - t), int(t - n * int(lo))) for t, lo, h in zip(s, low, high, strict=True)), default=0)
        big = max(n * max(abs(int(v)) for v in (*low, *high, 0)), most, max((abs(v) for v in s), default=0))
        self.n, self.small = n, big < 1 << 62 and len(s) * most * most < 1 << 62
        self.s = s.astype(np.int64) if self.small else s

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.n * (x if self.small else x.astype(object)) - self.s

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[Decimal]:
        y = self(x)
        return [Decimal(int(v)) if abs(int(v)) < 10**38 else None for v in (y * y).sum(1)]


def _r(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def r_factor(vectors: DataFrame, centring: Centring, embedding: str = "embedding") -> np.ndarray:
    """The R factor of all centred vectors, from a tree of partial ones."""
    import pyarrow as pa
    from pyspark import TaskContext

    d = len(centring.s)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for _, x in _entries(batch.column(0))[1]:
                r = _r(np.vstack([r, centring.centred(x)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["id", "r"])

    def meet(table: pa.Table) -> pa.Table:
        r = np.zeros((0, d))
        for other in table.column("r"):
            r = _r(np.vstack([r, np.frombuffer(other.as_py()).reshape(-1, d)]))
        return pa.table({"id": pa.array([table.column("id")[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    tree = cut(vectors.select(embedding).mapInArrow(leaf, "id long, r binary"))
    left = tree.count()
    while left > 1:
        left = -(-left // FAN_IN)
        tree = tree.withColumn("id", F.pmod("id", F.lit(left))).groupBy("id").applyInArrow(meet, "id long, r binary")
    return np.frombuffer(tree.first()["r"]).reshape(-1, d)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    vectors: vec_id, embedding (array of float or double); more columns are ignored. Vectors that are null, hold a null, a non-finite entry or
    one beyond +-2^40 are left out, of the fit too. A null vec_id keeps its rows; repeated rows are vectors of their own. There are as
    many components as dimensions, ``components`` at most; one without variance (fewer different vectors than dimensions, a constant
    dimension) explains 0 and whitens to null, and identity_error is over the others, null if there are none. Equal eigenvalues leave
    the choice of their vectors open. Empty vectors and an empty table give no rows; vectors of different lengths raise a ValueError.
    A deviation of over 38 digits is null.
    """
    import pyarrow as pa

    spark, rows = vectors.sparkSession, vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    n, s, low, high = sums(rows)
    if not n:
        return spark.createDataFrame([], schema)
    centring = Centring(n, s, low, high)
    _, sigma, right = np.linalg.svd(r_factor(rows, centring))
    sigma = np.append(sigma, np.zeros(len(s) - len(sigma)))
    k = min(components, len(s))
    known = sigma[:k] > RANK * len(s) * max(sigma[0], np.finfo(float).tiny)
    explained = np.where(known, sigma[:k] ** 2 / (sigma @ sigma if known.any() else 1.0), 0.0)
    rank = int(known.sum())
    axes = right[:rank].T * (np.sqrt(n) / sigma[:rank])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rank, rank))
        for batch in batches:
            for _, x in _entries(batch.column(0))[1]:
                w = centring.centred(x) @ axes
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rank * rank)), pa.array(total.ravel())], names=["at", "v"])

    found = rows.select("embedding").mapInArrow(check, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    error = found.select(F.max(F.abs(F.col("v") / n - F.when(F.pmod("at", F.lit(rank + 1)) == 0, 1.0).otherwise(0.0)))).first()[0] if rank else None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _entries(batch.column(1))[1]:
                w = np.full((len(x), k), np.nan)
                w[:, :rank] = centring.centred(x) @ axes
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(centring.deviations(x), pa.decimal128(38, 0)), lists], names=["vec_id", "deviation", "w"])

    out = rows.mapInArrow(project, "vec_id long, deviation decimal(38,0), w array<double>")
    shares = F.array(*[F.lit(float(e)) for e in explained])
    out = out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
