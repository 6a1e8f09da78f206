"""Whitening of embeddings by incremental eigendecomposition.

A partition keeps the eigenvalues and eigenvectors of its scatter matrix and takes centred rows in by rank-one updates: the new eigenvalues
are the roots of the secular equation, with deflation of directions that the row has no part in and of equal eigenvalues. A batch's centred rows are first
condensed to as many rows as there are dimensions (of the same scatter). The spectra of partitions are combined in a tree of tasks, again
by rank-one updates. At last the eigenvectors are refined by Rayleigh-Ritz steps: the covariance in their basis is summed over all rows, and its
own eigenvectors, a matrix of dimension squared, rotate the basis.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows condensed at once; states that one task combines; refinements at most, and the error at which they end.
BATCH, FAN, REFINEMENTS, ERROR = 1024, 8, 4, 1e-9
#: Directions with a smaller share of the largest variance can't be scaled to one.
FLAT = 1e-12
_LONG = 2**63


def _roots(d: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(w2 / (d - t)) = 0 for rising d: (pole that a root is measured from, distance from it)."""
    n = len(d)
    upper = np.r_[d[1:], d[-1] + w2.sum()]
    middle = (d + upper) / 2
    value = 1 + (w2 / (d - middle[:, None])).sum(1)
    # Rising in each gap: where it is positive in the middle, the root is nearer to the left pole.
    origin = np.where((value >= 0) | (np.arange(n) == n - 1), np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    delta = d - d[origin][:, None]
    low, high = np.where(origin == np.arange(n), 0, d - d[origin]), upper - d[origin]
    low, high = np.where((origin == np.arange(n)) & (value < 0), middle - d[origin], low), np.where(value >= 0, middle - d[origin], high)
    t = (low + high) / 2
    here = np.arange(n)
    for _ in range(80):
        gap = delta - t[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = w2 / gap
            f = 1 + parts.sum(1)
            slope = (parts / gap).sum(1)
            noise = 4e-16 * (1 + np.abs(parts).sum(1))
        above = f >= 0
        high, low = np.where(above, t, high), np.where(above, low, t)
        # Next point: the root of c + s / (pole - t) that has the value and the slope here, for the nearer pole.
        near = gap[here, origin]
        s = slope * near * near
        c = f - slope * near
        with np.errstate(divide="ignore", invalid="ignore"):
            step = t + near + s / c
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        done = (np.abs(new - t) <= 4e-16 * np.abs(new)) | (np.abs(f) <= noise)
        if done.all():
            break
        t = np.where(done, t, new)
    return origin, t


def rank_one(values: np.ndarray, vectors: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``vectors @ diag(values) @ vectors.T + z z.T``."""
    w = vectors.T @ z
    norm2 = float(w @ w)
    scale = max(values[-1], norm2)
    if norm2 == 0:
        return values, vectors
    tiny = 4e-16 * scale
    # Equal eigenvalues: a reflection leaves one of them with all of the row's part.
    starts = np.flatnonzero(np.r_[True, np.diff(values) > tiny])
    vectors = vectors.copy()
    for a, b in zip(starts, np.r_[starts[1:], len(values)], strict=True):
        if b - a > 1 and (part := np.linalg.norm(w[a:b])) > 0:
            v = w[a:b].copy()
            v[0] += part if v[0] >= 0 else -part
            v /= np.linalg.norm(v)
            vectors[:, a:b] -= 2 * np.outer(vectors[:, a:b] @ v, v)
            w[a], w[a + 1 : b] = -part if w[a] >= 0 else part, 0
    live = np.flatnonzero(np.abs(w) * np.sqrt(norm2) > tiny)
    if len(live):
        d, u = values[live], w[live]
        origin, t = _roots(d, u * u)
        # d_i - root_j without cancellation, and the row that has exactly these roots (for orthogonal vectors).
        gap = (d[:, None] - d[origin][None, :]) - t[None, :]
        n = len(d)
        poles = d[:, None] - d[None, :]
        poles[np.arange(n), np.arange(n)] = 1
        ratio = gap / poles
        ratio[np.arange(n), np.arange(n)] = -gap[np.arange(n), np.arange(n)]
        exact = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.sign(u)
        q = exact[:, None] / gap
        q /= np.sqrt((q * q).sum(0))
        vectors[:, live] = vectors[:, live] @ q
        values = values.copy()
        values[live] = d[origin] + t
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Number, exact sums and centred scatter of some rows of whole numbers."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, [0] * size, np.zeros(size), np.eye(size))

    def mean(self) -> np.ndarray:
        return np.array([float(s) for s in self.sums]) / max(1, self.n)

    def _shift(self, n: int, sums: list[int]) -> None:
        """Rank-one update for the distance of two means, and the sums of both."""
        if self.n and n:
            apart = np.array([(a * n - b * self.n) / (self.n * n) for a, b in zip(self.sums, sums, strict=True)])
            self.values, self.vectors = rank_one(self.values, self.vectors, apart * np.sqrt(self.n * n / (self.n + n)))
        self.n, self.sums = self.n + n, [a + b for a, b in zip(self.sums, sums, strict=True)]

    def add_rows(self, x: np.ndarray) -> None:
        sums = whole_sums(x)
        centre = np.array([s // len(x) for s in sums], dtype=np.int64)
        away = (x - centre).astype(np.float64)
        away -= away.mean(0)
        for row in np.linalg.qr(away, mode="r") if len(x) > x.shape[1] else away:
            self.values, self.vectors = rank_one(self.values, self.vectors, row)
        self._shift(len(x), sums)

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector * np.sqrt(value))
        self._shift(other.n, other.sums)


def whole_sums(x: np.ndarray) -> list[int]:
    """Exact column sums of longs, whatever their size."""
    return [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]


def _whole(column: pa.Array, size: int, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their whole components)."""
    rows, out = [], []
    for i, v in enumerate(column):
        if v.is_valid and len(v.values) == size and v.values.null_count == 0:
            x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(x).all() and (np.abs(x) < _LONG / 4).all():
                rows.append(i)
                out.append(x.astype(np.int64) + shift)
    return np.array(rows, dtype=np.int64), np.array(out, dtype=np.int64).reshape(len(out), size)


def _spectra(size: int, scale: int, shift: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Spectrum.empty(size)
        for batch in batches:
            _, x = _whole(batch.column("v"), size, scale, shift)
            for at in range(0, len(x), BATCH):
                state.add_rows(x[at : at + BATCH])
        if state.n:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    return work


def _combined(states: DataFrame, partitions: int, combine) -> list:
    """One state out of those of all partitions, by a tree of tasks of ``FAN`` states; empty where there is none."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        first, *rest = (pickle.loads(s) for s in rows.sort_values("part")["state"])
        for other in rest:
            first = combine(first, other)
        return pd.DataFrame({"part": [rows["part"].iloc[0] // FAN], "state": [pickle.dumps(first)]})

    level = states.select(F.spark_partition_id().cast("long").alias("part"), "state")
    left = partitions
    while left > 1:
        level = level.groupBy(F.floor(F.col("part") / FAN).alias("_group")).applyInPandas(work, "part long, state binary")
        left = -(-left // FAN)
    return [pickle.loads(r["state"]) for r in level.select("state").collect()]


def _merge(a: Spectrum, b: Spectrum) -> Spectrum:
    a.merge(b)
    return a


def _away(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows less the mean, rounded once."""
    centre = [s // n for s in sums]
    return (x - np.array(centre, dtype=np.int64)).astype(np.float64) - np.array([(s - c * n) / n for s, c in zip(sums, centre, strict=True)])


def _ritz(shared, size: int, scale: int, shift: int):
    """Sums and products of a partition's rows in the current basis."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, basis = shared.value
        total, products, seen = np.zeros(basis.shape[1]), np.zeros((basis.shape[1], basis.shape[1])), 0
        for batch in batches:
            _, x = _whole(batch.column("v"), size, scale, shift)
            for at in range(0, len(x), BATCH):
                y = _away(x[at : at + BATCH], n, sums) @ basis
                total, products, seen = total + y.sum(0), products + y.T @ y, seen + len(y)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((total, products))], pa.binary())], ["state"])

    return work


def _covariance(rows: DataFrame, spectrum: Spectrum, basis: np.ndarray, scale: int, shift: int) -> np.ndarray:
    shared = rows.sparkSession.sparkContext.broadcast((spectrum.n, spectrum.sums, basis))
    states = rows.mapInArrow(_ritz(shared, len(spectrum.sums), scale, shift), "state binary")
    total, products = _combined(states, rows.rdd.getNumPartitions(), lambda a, b: (a[0] + b[0], a[1] + b[1]))[0]
    mean = total / spectrum.n
    return products / spectrum.n - np.outer(mean, mean)


def _whiten(shared, size: int, scale: int, shift: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, basis, explained, error = shared.value
        k = basis.shape[1]
        for batch in batches:
            rows, x = _whole(batch.column("v"), size, scale, shift)
            ids = batch.column("id").take(pa.array(rows))
            for at in range(0, len(rows), BATCH):
                part = x[at : at + BATCH]
                y = _away(part, n, sums) @ basis
                deviation = pa.array([d if d < _LONG else None for d in (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in part.tolist())], pa.int64())
                each = pa.array(np.repeat(np.arange(len(part)), k))
                columns = [ids.slice(at, len(part)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(each), n)), deviation.take(each)]
                columns += [pa.array(y.ravel()), pa.array(np.tile(explained, len(part))), pa.array(np.full(len(each), error))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return work


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, dimension: int | None = None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row and component up to ``components``, numbered from 1.

    A component x is floor(scale * c) + shift; the covariance is that of all rows, divisor n. Signs make the entry of largest size of each
    eigenvector positive. deviation is exact, and null where it does not fit a long.

    Vectors that are null, of another length than ``dimension`` (by default the most frequent one), hold null or non-finite entries or
    entries beyond a long are dropped. Rows without an id keep a null id; repeated rows are rows. Components whose variance is zero
    (or below 1e-12 of the largest) can't be whitened and have no rows: an empty table, one row, and equal rows give an empty result.
    What goes through the driver is of the dimension squared.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = f"{id_col} {rows.schema['id'].dataType.simpleString()}"
    schema = f"{kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if dimension is None:
        common = rows.where("v is not null and not exists(v, c -> c is null)").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dimension = common["d"] if common else 0
    found = _combined(rows.mapInArrow(_spectra(dimension, scale, shift), "state binary"), rows.rdd.getNumPartitions(), _merge) if dimension else []
    if not found:
        return spark.createDataFrame([], schema)
    spectrum: Spectrum = found[0]
    basis = spectrum.vectors[:, ::-1]
    for _ in range(REFINEMENTS):
        ritz = _covariance(rows, spectrum, basis, scale, shift)
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, basis = values[::-1], np.linalg.qr(basis @ turn[:, ::-1])[0]
        live = np.flatnonzero(values[:components] > FLAT * max(values[0], 0))
        if not len(live):
            return spark.createDataFrame([], schema)
        lead = basis[:, live] * np.sign(basis[np.abs(basis[:, live]).argmax(0), live])
        scaled = lead / np.sqrt(values[live])
        error = float(np.abs(_covariance(rows, spectrum, scaled, scale, shift) - np.eye(len(live))).max())
        if error <= ERROR:
            break
    explained = values[live] / values.sum()
    shared = spark.sparkContext.broadcast((spectrum.n, spectrum.sums, scaled, explained, error))
    return rows.mapInArrow(_whiten(shared, dimension, scale, shift), schema.replace(kind, f"id {rows.schema['id'].dataType.simpleString()}")).withColumnRenamed("id", id_col)
