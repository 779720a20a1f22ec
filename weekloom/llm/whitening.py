"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers x = floor(1024 c) + 100000, so counts, sums and squared deviations are exact. With n vectors and sums
S, a centred entry is x - S/n, taken as (x - q) - r/n with S = q n + r, which rounds once, at the end.

Every pass multiplies the centred table with a narrow matrix, X'(XQ)/n, block by block: tasks add up their blocks, Spark
adds up the tasks' sums by dimension, and the driver gets one matrix of dimensions by columns, whatever the rows. The
covariance itself is never formed. A round of the iteration:

1. filter: the columns go through a Chebyshev polynomial in the covariance, by its three-term recurrence (a pass a degree). It is
   at most 1 on the unwanted interval, from 0 to the least Ritz value of the block, and grows fast above it;
2. QR makes the columns orthonormal, one more pass and Rayleigh-Ritz give eigenvalues and vectors;
3. certification: the wanted pairs must satisfy |Vq - eq| <= tolerance x the largest eigenvalue (or stand at the level of
   rounding), and must be the same after a round in which fresh random columns took part, which would have grown into any
   wanted direction that the block had missed. A column's residual comes with the result.

The block has guard columns beside the wanted ones; where it is as wide as the table, the first round is exact.

Defined cases: vectors that are null, or hold null or non-finite entries, are dropped, and so are those with an entry beyond
2**40 (whose x isn't exact in a double) and those whose length isn't the one that most vectors have (the shorter of two
equally frequent ones). A null id stays null; repeated rows count as often as they occur. Directions without variance (fewer
vectors than dimensions, constant tables) have no whitened form and are left out, so a table of one vector or none gives no
rows. A squared deviation beyond a long is null. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .carry import quoted
from .scratch import staged

SCALE, SHIFT = 1024.0, 100_000
#: Columns of the block beyond the wanted ones, those of them drawn anew in every round, and the highest degree.
GUARD, FRESH, DEGREE = 24, 2, 20
#: Residuals relative to the largest eigenvalue: certified below the first, or below the second if no round improves them.
TOLERANCE, LEVEL = 1e-14, 1e-12
MOST_ROUNDS = 200
#: A direction of less variance than this, relative to the first, has none.
NO_VARIANCE = 1e-12
BLOCK_BYTES, LARGEST = 2 << 20, 2.0**40


def blocks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A staged table of blocks: ``size`` (of a vector), ``n``, ``ids`` and the integers ``x``, row after row; usable vectors only."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column(1), batch.column(0)
            there = np.asarray(lists.is_valid())
            flat, sizes = lists.flatten(), np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            cut = np.concatenate([[0], np.cumsum(sizes)])
            value = np.asarray(flat.fill_null(np.nan), np.float64)
            bad = np.concatenate([[0], np.cumsum(~(np.abs(value) < LARGEST))])  # NaN too
            usable = there & (bad[cut[1:]] == bad[cut[:-1]])
            for size in np.unique(sizes[usable]).tolist():
                rows = np.flatnonzero(usable & (sizes == size))
                step = max(1, BLOCK_BYTES // (8 * max(1, size)))
                for a in range(0, len(rows), step):
                    own = rows[a : a + step]
                    x = np.floor(SCALE * value[cut[own][:, None] + np.arange(size)]).astype(np.int64) + SHIFT
                    of = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids.take(pa.array(own)))
                    sizes_of = [pa.array([k], pa.int32()) for k in (size, len(own))]
                    yield pa.RecordBatch.from_arrays([*sizes_of, of, pa.array([x.tobytes()], pa.binary())], names=["size", "n", "ids", "x"])

    kind = vectors.schema[id_col].dataType
    asked = vectors.select(quoted(id_col).alias("i"), quoted(vector_col).cast("array<double>").alias("v"))
    schema = StructType([StructField("size", IntegerType()), StructField("n", IntegerType()), StructField("ids", ArrayType(kind)), StructField("x", BinaryType())])
    return staged(asked.mapInArrow(pack, schema), "vectors")


def _arrays(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, n x size integers) of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column("ids")[k].values, np.frombuffer(batch.column("x")[k].as_buffer(), np.int64).reshape(-1, size)


def _summed(table: DataFrame, size: int, rows: int, columns: int, of) -> np.ndarray:
    """The sum over all blocks of the ``rows`` x ``columns`` matrices that ``of`` makes, added up by Spark row by row."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for _, x in _arrays(batches, size):
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), *[pa.array(c) for c in total.T]], names=["row", *[f"c{k}" for k in range(columns)]])

    schema = "row int, " + ", ".join(f"c{k} double" for k in range(columns))
    sums = table.select("ids", "x").mapInArrow(partial, schema).groupBy("row").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(columns)])
    found = sums.toArrow().sort_by("row")  # one row a dimension
    return np.array([found[f"c{k}"].to_numpy() for k in range(columns)]).T.reshape(rows, columns)


@dataclass
class Moments:
    """n, and sums S of each dimension as quotient and rest."""

    n: int
    quotient: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.quotient).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - S)^2 of each row; null beyond a long."""
        off = x - self.quotient
        most = int(np.abs(off).max(initial=0)) * self.n + self.n
        if most * most * x.shape[1] < 1 << 63:
            d = self.n * off - self.rest
            return (d * d).sum(axis=1).tolist()
        d = self.n * off.astype(object) - self.rest.astype(object)
        return [s if s < 1 << 63 else None for s in (d * d).sum(axis=1).tolist()]


def moments(table: DataFrame, size: int) -> Moments:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, np.int64)
        for _, x in _arrays(batches, size):
            n, total = n + len(x), total + (x - SHIFT).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"row": pa.array(np.arange(size, dtype=np.int32)), "n": pa.array(np.full(size, n)), "s": pa.array(total)})

    sums = table.select("ids", "x").mapInArrow(add, "row int, n long, s long").groupBy("row").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = sorted(sums.collect())  # one row a dimension
    n = int(found[0]["n"])
    whole = [int(r["s"]) + n * SHIFT for r in found]
    return Moments(n, np.array([s // n for s in whole], np.int64), np.array([s % n for s in whole], np.int64))


@dataclass
class Spectrum:
    """Eigenvalues (falling), unit eigenvectors as columns, residuals relative to the first eigenvalue, passes over the table."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def leading(apply, size: int, wanted: int, seed: int = 12, guard: int = GUARD, degree: int = DEGREE) -> Spectrum:
    """The ``wanted`` leading eigenpairs of the symmetric operator ``apply`` (a matrix of columns to V times it), certified."""
    wanted, width = min(wanted, size), min(wanted + guard, size)
    fresh = FRESH if width < size else 0
    draw = np.random.default_rng(seed)
    q = np.linalg.qr(draw.standard_normal((size, width)))[0]
    passes, best, old = 0, np.inf, None
    for _ in range(MOST_ROUNDS):
        y = apply(q)
        passes += 1
        values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        top = values[0]
        if top <= 0.0:
            return Spectrum(np.zeros(0), np.zeros((size, 0)), np.zeros(0), passes)
        residuals = np.linalg.norm(y - q * values, axis=0)[:wanted] / top
        now = residuals.max()
        same = old is not None and np.abs(values[:wanted] - old).max() <= LEVEL * top
        if width == size or (same and (now <= TOLERANCE or best / 2 < now <= LEVEL)):
            return Spectrum(values[:wanted], q[:, :wanted], residuals, passes)
        best, old = min(best, now), values[:wanted]
        kept = q[:, : width - fresh]
        q = np.linalg.qr(np.hstack([kept, draw.standard_normal((size, fresh))]))[0]
        bound = max(values[width - fresh - 1], top * 1e-9)
        # the degree keeps what the polynomial makes of the wanted columns within 1e6 of each other
        reach = lambda e: np.arccosh(max(1.0, 2 * e / bound - 1))  # noqa: B023, E731
        m = int(np.clip(np.log(1e6) / max(reach(top) - reach(values[wanted - 1]), 1e-9), 2, degree))
        q, passes = np.linalg.qr(_filtered(apply, q, bound, top, m))[0], passes + m
    raise RuntimeError(f"no certified eigenpairs after {MOST_ROUNDS} rounds: residual {best:.1e}")


def _filtered(apply, q: np.ndarray, bound: float, top: float, m: int) -> np.ndarray:
    """T_m((V - c) / c) q with c = bound / 2, scaled by its value at ``top`` so that nothing overflows; m passes."""
    centre = bound / 2
    sigma = first = centre / (top - centre)
    before, now = q, (apply(q) - centre * q) * (sigma / centre)
    for _ in range(m - 1):
        ahead = 1 / (2 / first - sigma)
        before, now = now, 2 * (ahead / centre) * (apply(now) - centre * now) - sigma * ahead * before
        sigma = ahead
    return now


def usual_size(table: DataFrame) -> int | None:
    """The length that most vectors have, the shorter of two equally frequent ones."""
    sizes = table.groupBy("size").agg(F.sum("n").alias("n")).filter("size > 0").orderBy(F.desc("n"), "size").first()
    return None if sizes is None else int(sizes["size"])


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = 8) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error, residual) per usable vector and component."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType
    table = blocks(vectors, id_col, vector_col)
    schema = StructType().add(id_col, kind).add("component", "integer").add("n", "long").add("deviation", "long")
    for name in ("whitened", "explained", "identity_error", "residual"):
        schema = schema.add(name, "double")
    size = usual_size(table)
    if size is None:
        return spark.createDataFrame([], schema)
    table = table.filter(F.col("size") == size)
    m = moments(table, size)

    def product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        c = m.centred(x)
        return c.T @ (c @ q)

    found = leading(lambda q: _summed(table, size, size, q.shape[1], lambda x: product(x, q)) / m.n, size, wanted)
    some = found.values > NO_VARIANCE * (found.values[0] if len(found.values) else 1.0)
    if not some.any():
        return spark.createDataFrame([], schema)
    values, basis, residuals = found.values[some], found.vectors[:, some] / np.sqrt(found.values[some]), found.residuals[some]
    r = len(values)

    def second(x: np.ndarray) -> np.ndarray:
        c = m.centred(x)
        w = c @ basis
        return np.vstack([w.T @ w, w.sum(axis=0), np.full(r, (c * c).sum())])

    sums = _summed(table, size, r + 2, r, second) / m.n
    error = float(np.abs(sums[:r] - np.outer(sums[r], sums[r]) - np.eye(r)).max())
    explained = values / sums[r + 1, 0]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _arrays(batches, size):
            rows, all_rows = len(x), len(x) * r
            take = pa.array(np.repeat(np.arange(rows), r))
            yield pa.RecordBatch.from_arrays([
                ids.take(take), pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), rows)), pa.array(np.full(all_rows, m.n)),
                pa.array(m.deviations(x), pa.int64()).take(take), pa.array((m.centred(x) @ basis).ravel()),
                pa.array(np.tile(explained, rows)), pa.array(np.full(all_rows, error)), pa.array(np.tile(residuals, rows)),
            ], names=schema.names)

    return table.select("ids", "x").mapInArrow(project, schema)


def whitening_query(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
