"""Near-duplicate vectors by an inverted multi-index.

The halves of the normalised vectors have codebooks of their own; their product is the grid of cells. A query meets cells in the order of
a bound on the distance to anything inside (the multi-sequence order of two sorted lists) and stops where no link can be
missed, or where a measured recall is reached, then every candidate is verified in double precision.

The bound of a half: a point of codeword i is at least ``(d_i^2 - d_a^2) / (2 |c_i - c_a|)`` from a query whose nearest codeword is a. The
sum over both halves can't exceed ``2 - 2 cosine`` for a link: the traversal stops there, and nothing is missed. A recall below 1 stops
it earlier, where the links of a bounded sample of queries, found by brute force among all vectors, show that recall.

Equal vectors are one row. Rows are dealt out by cell and packed into blocks, so a block has few cells and is all that travels: blocks
meet without a shuffle, each two of them once and only where one's vectors visit a cell of the other, and no vector is copied for a
visit. A task gives counts and a spanning forest of the links that it saw, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden.llm.tables import components, keep, small_batches

COSINE = 0.9
#: Vectors from which the codebooks are learned, at most.
SAMPLE = 8192
RECALL = 1.0
#: Queries whose links are counted for a recall below 1, and steps of the reach they are counted in.
PROBES, STEPS = 256, 1000
#: Vectors of a block and its bytes, at most (but a few vectors at least); rows compared at once; links held by a task before they are merged.
MEMBERS, BLOCK_BYTES, QUERIES, HELD = 2048, 1 << 20, 256, 1 << 20


def _pack(dimension: int, kind: str):
    """Valid vectors as bytes of numbers of a ``kind``; null for those that link with nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(v), dimension), False).to_numpy(zero_copy_only=False))
            # A null number is not finite here.
            x = v.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), dimension)
            good = np.isfinite(x).all(1) & x.any(1)
            place = np.full(batch.num_rows, -1)
            place[fits[good]] = np.arange(good.sum())
            yield pa.RecordBatch.from_arrays([batch.column("id"), _binary(x[good], kind).take(pa.array(place, mask=place < 0))], ["id", "vector"])

    return work


def _binary(x: np.ndarray, kind: str) -> pa.Array:
    """Rows as bytes."""
    rows = np.ascontiguousarray(x, dtype=kind)
    return pa.Array.from_buffers(pa.binary(rows.itemsize * x.shape[1]), len(x), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _unit(data: bytes, n: int, kind: str) -> np.ndarray:
    x = np.frombuffer(data, dtype=kind).astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T)


def codebook(x: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    """k means of a sample, started from rows far apart in it."""
    rng = np.random.default_rng(1)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(turns):
        near = _distances(x, c).argmin(1)
        for i in range(len(c)):
            if (near == i).any():
                c[i] = x[near == i].mean(0)
    return np.unique(c, axis=0)


def visited(bounds1: np.ndarray, bounds2: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, codeword 1, codeword 2) of all cells that the multi-sequence order meets before ``reach``.

    Both lists are sorted; for each codeword of the first the traversal takes those of the second up to what is left of the reach.
    """
    order2 = np.argsort(bounds2, axis=1)
    sorted2 = np.take_along_axis(bounds2, order2, axis=1)
    q, i = np.nonzero(bounds1 <= reach)
    upto = (sorted2[q] <= (reach - bounds1[q, i])[:, None]).sum(1)
    row = np.repeat(np.arange(len(q)), upto)
    step = np.arange(len(row)) - np.repeat(np.cumsum(upto) - upto, upto)
    return q[row], i[row], order2[q[row], step]


def _bounds(x: np.ndarray, books) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For either half: the bound of every codeword for every vector, and the vectors' own codewords."""
    half, bounds, own = x.shape[1] // 2, [], []
    for c, h in zip(books, (x[:, :half], x[:, half:]), strict=True):
        d = _distances(h, c)
        a = d.argmin(1)
        own.append(a)
        bounds.append(np.maximum(0, d - d[np.arange(len(d)), a][:, None]) ** 2 / (2 * np.sqrt(_distances(c, c)) + np.eye(len(c)))[a] ** 2)
    return bounds, own


def _reaches(shared, cosine: float, full: float, kind: str):
    """Links of the probes with a batch's vectors, counted by the step of the reach that finds them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, probes = shared.value
        bounds, _ = _bounds(probes, books)
        found = np.zeros(STEPS + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.column("vector").slice(at, 1024)
                x = _unit(b"".join(part.to_pylist()), len(part), kind)
                _, own = _bounds(x, books)
                near = probes @ x.T
                q, m = np.nonzero((near >= cosine) & (near < 1 - 1e-12))
                need = bounds[0][q, own[0][m]] + bounds[1][q, own[1][m]]
                found += np.bincount(np.minimum(STEPS, np.ceil(need / full * STEPS)).astype(int), minlength=STEPS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS + 1)), pa.array(found)], ["step", "n"])

    return work


def _sampled(valid: DataFrame, salt: int, most: int, kind: str) -> np.ndarray:
    """Different ones of the first ``most`` vectors by a hash."""
    found = dict.fromkeys(bytes(r["vector"]) for r in valid.orderBy(F.xxhash64("id", "vector", F.lit(salt)), "id").limit(most).select("vector").collect())
    return _unit(b"".join(found), len(found), kind) if found else np.zeros((0, 1))


def measured_reach(valid: DataFrame, books, cosine: float, recall: float, full: float, kind: str) -> float:
    """Least reach that finds the share ``recall`` of the probes' links with all vectors; all of it when they have no links."""
    shared = valid.sparkSession.sparkContext.broadcast((books, _sampled(valid, 1, PROBES, kind)))
    found = {r["step"]: r["n"] for r in valid.select("vector").mapInArrow(_reaches(shared, cosine, full, kind), "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()}
    upto = np.cumsum([found.get(i, 0) for i in range(STEPS + 1)])
    return full if not upto[-1] else full * float(np.argmax(upto >= recall * upto[-1])) / STEPS


def _place(books, dimension: int, kind: str):
    """Own cell of every valid vector; equal vectors of a batch are one row, with their least id and number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pack(dimension, kind)(batches):
            valid = pa.Table.from_batches([batch]).filter(pc.and_(batch.column("vector").is_valid(), batch.column("id").is_valid()))
            each = valid.group_by("vector").aggregate([("id", "min"), ("id", "count")]).combine_chunks()
            for part in each.to_batches(max_chunksize=1024):
                # Products of one shape round alike, so equal vectors of other batches get the same cell.
                x = np.zeros((1024, dimension))
                x[: part.num_rows] = _unit(b"".join(part.column("vector").to_pylist()), part.num_rows, kind)
                _, own = _bounds(x, books.value)
                cell = pa.array((own[0] * len(books.value[1]) + own[1])[: part.num_rows].astype(np.int64))
                yield pa.RecordBatch.from_arrays([cell, part.column("vector"), part.column("id_min"), part.column("id_count")], ["cell", "vector", "rep", "times"])

    return work


_BLOCK = "ids array<long>, times array<long>, place array<long>, vectors binary, cells array<long>, visits array<long>"


def _blocks(books, reach: float, most: int, kind: str):
    """Blocks of rows as they come: their ids, numbers, cells and vectors, and the different cells that they are in and that they visit."""

    def packed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        data, cell = b"".join(t.column("vector").to_pylist()), t.column("cell").to_numpy()
        bounds, _ = _bounds(_unit(data, len(t), kind), books.value)
        _, i, j = visited(*bounds, reach)
        values = [[t.column("rep").to_pylist()], [t.column("times").to_pylist()], [cell.tolist()], [data], [np.unique(cell).tolist()], [np.unique(i * len(books.value[1]) + j).tolist()]]
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, kind_) for v, kind_ in zip(values, (longs, longs, longs, pa.binary(), longs, longs), strict=True)], ["ids", "times", "place", "vectors", "cells", "visits"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - n)
                held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
                if n == most:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return work


def _unpacked(kind: str):
    """The rows of blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = np.frombuffer(row["vectors"], dtype=kind).reshape(len(row["ids"]), -1)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["times"], pa.int64()), _binary(rows, kind)], ["rep", "times", "vector"])

    return work


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Root of each of n nodes under the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class _Side:
    """A block: its ids, numbers, vectors in either precision, bounds, and the cells that its rows are in."""

    def __init__(self, batch: pa.RecordBatch, at: int, side: str, books, kind: str):
        of = lambda name: batch.column(f"{side}_{name}")[at]
        self.block = of("block").as_py()
        self.ids, self.times, place = (of(name).values.to_numpy() for name in ("ids", "times", "place"))
        self.x = _unit(of("vectors").as_buffer(), len(self.ids), kind)
        self.short = self.x.astype(np.float32)
        self.bounds, _ = _bounds(self.x, books)
        cells, self.place = np.unique(place, return_inverse=True)
        self.words = cells // len(books[1]), cells % len(books[1])

    def visits(self, other: _Side, reach: float) -> np.ndarray:
        """Which rows visit which of the other's cells."""
        return self.bounds[0][:, other.words[0]] + self.bounds[1][:, other.words[1]] <= reach


class _Found:
    """Links of a task: a forest of them and the number of each id's."""

    def __init__(self):
        self.pairs, self.counts, self.n = [], [], 0

    def add(self, pairs: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        hit = counts > 0
        self.pairs.append(pairs)
        self.counts.append(np.c_[ids[hit], counts[hit]])
        self.n += len(pairs) + int(hit.sum())
        if self.n > 2 * HELD:
            self.merge()

    def merge(self) -> None:
        pairs, counts = (np.concatenate([np.zeros((0, 2), dtype=np.int64), *x]) for x in (self.pairs, self.counts))
        ids, ends = np.unique(pairs, return_inverse=True)
        ends = ends.reshape(-1, 2)
        root = forest(ends[:, 0], ends[:, 1], len(ids))
        tied = np.flatnonzero(root != np.arange(len(root)))
        own, place = np.unique(counts[:, 0], return_inverse=True)
        total = np.zeros(len(own), dtype=np.int64)
        np.add.at(total, place, counts[:, 1])
        self.pairs, self.counts = [np.c_[ids[tied], ids[root[tied]]]], [np.c_[own, total]]
        # What can't be merged does not count again.
        self.n = 0


def _linked(a: _Side, b: _Side, cosine: float, reach: float, found: _Found) -> None:
    """Links between two blocks, or within one, where a row visits the other's cell; each row counts those that it visits."""
    same = a.block == b.block
    there, back = a.visits(b, reach), b.visits(a, reach)
    rows = np.flatnonzero(there.any(1) | back.any(0)[a.place])
    members = np.flatnonzero(there.any(0)[b.place] | back.any(1))
    # What single precision can take from a product of unit vectors; whatever may link is computed again in double precision.
    least = np.float32(cosine - (a.x.shape[1] + 8) * 2.0**-23)
    y = b.short[members].T
    counts_a, counts_b = np.zeros(len(a.ids), dtype=np.int64), np.zeros(len(b.ids), dtype=np.int64)
    for at in range(0, len(rows), QUERIES):
        part = rows[at : at + QUERIES]
        near = a.short[part] @ y >= least
        some = np.flatnonzero(near.any(1))
        if not len(some):
            continue
        q, m = part[some], members[near[some].any(0)]
        linked = (a.x[q] @ b.x[m].T >= cosine) & (a.ids[q][:, None] != b.ids[m])
        seen = linked & there[q][:, b.place[m]]
        counts_a[q] += (seen * b.times[m]).sum(1)
        if not same:
            seen_back = linked & back[m][:, a.place[q]].T
            counts_b[m] += (seen_back * a.times[q][:, None]).sum(0)
            seen |= seen_back
        i, j = np.nonzero(seen)
        if len(i):
            root = forest(i, j + len(q), len(q) + len(m))
            ids = np.r_[a.ids[q], b.ids[m]]
            tied = np.flatnonzero(root != np.arange(len(root)))
            found.add(np.c_[ids[tied], ids[root[tied]]], ids[:0], ids[:0])
    found.add(np.zeros((0, 2), dtype=np.int64), np.r_[a.ids, b.ids], np.r_[counts_a, counts_b])


def _compare(books, cosine: float, reach: float, kind: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, a = _Found(), None
        for batch in batches:
            for at in range(batch.num_rows):
                # One block meets many, one after the other.
                if a is None or a.block != batch.column("a_block")[at].as_py():
                    a = _Side(batch, at, "a", books.value, kind)
                b = a if a.block == batch.column("b_block")[at].as_py() else _Side(batch, at, "b", books.value, kind)
                _linked(a, b, cosine, reach, found)
        found.merge()
        pairs, counts = found.pairs[0], found.counts[0]
        out = np.concatenate([np.c_[pairs, np.zeros(len(pairs), dtype=np.int64)], np.c_[counts[:, 0], counts]])
        for at in range(0, len(out), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out[at : at + (1 << 16)].T], ["a", "b", "n"])

    return work


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE, dimension: int | None = None) -> DataFrame:
    """Per row: the id, n_links (other rows with a cosine of ``cosine`` or more), component_id (smallest id that links reach), kept.

    Vectors that are null, zero, of another length than ``dimension`` (by default the most frequent one), or that hold null or
    non-finite numbers link with nothing; so do rows without an id, whose component is null and which are not kept. Repeated rows are
    rows, and link. Codebooks come from ``sample`` vectors at most, the first by a hash; all vectors are indexed.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    element = vectors.select(vector_col).schema[0].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    lengths = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d")
    common = (lengths if dimension is None else lengths.where(F.col("d") == dimension)).first()
    if dimension is None:
        dimension = common["d"] if common else 0
    packed = rows.mapInArrow(_pack(dimension, kind), "id long, vector binary")
    valid = packed.where("vector is not null and id is not null")
    x = _sampled(valid, 0, sample, kind)
    if len(x):
        k = max(1, round(common["count"] ** 0.25 / 1.5))
        books = tuple(codebook(h.copy(), k) for h in (x[:, : dimension // 2], x[:, dimension // 2 :]))
    else:
        books = (np.zeros((1, 1)), np.zeros((1, 1)))
    full = 2 - 2 * cosine
    reach = (full if recall >= 1 or not len(x) else measured_reach(valid, books, cosine, recall, full, kind)) + 1e-9
    shared = spark.sparkContext.broadcast(books)
    most = max(min(MEMBERS, 64), min(MEMBERS, BLOCK_BYTES // max(1, dimension * np.dtype(kind).itemsize)))
    placed = rows.mapInArrow(_place(shared, dimension, kind), "cell long, vector binary, rep long, times long")
    dealt = placed.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "cell", "vector")
    reps = dealt.groupBy("cell", "vector").agg(F.min("rep").alias("rep"), F.sum("times").alias("times")).sortWithinPartitions("cell", "vector")
    with small_batches(spark):
        blocks = keep(reps.mapInArrow(_blocks(shared, reach, most, kind), _BLOCK).withColumn("block", F.monotonically_increasing_id()), "vector-blocks")
        a, b = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "ab")
        # Of two blocks one order is taken, this or that by turns, so that tasks get alike; then a look at the cells.
        once = F.when((F.col("a_block") + F.col("b_block")) % 2 == 0, F.col("a_block") <= F.col("b_block")).otherwise(F.col("a_block") > F.col("b_block"))
        meet = once & (F.arrays_overlap("a_visits", "b_cells") | F.arrays_overlap("b_visits", "a_cells"))
        met = a.hint("shuffle_replicate_nl").join(b, meet).drop("a_cells", "a_visits", "b_cells", "b_visits")
        compared = keep(met.mapInArrow(_compare(shared, cosine, reach, kind), "a long, b long, n long"), "block-links")
        counts = compared.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        roots = components(compared.where("a <> b").select("a", "b")).select(F.col("node").alias("rep"), "root")
        # Vectors themselves stay in the blocks: rows find theirs by a digest.
        digest = F.unhex(F.sha2("vector", 256)).alias("digest")
        reps = keep(blocks.select("ids", "times", "vectors").mapInArrow(_unpacked(kind), "rep long, times long, vector binary").select("rep", "times", digest), "digests")
    known = reps.join(counts, "rep", "left").join(roots, "rep", "left").select("digest", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    known = known.groupBy("digest").agg(F.max("n_links").alias("n_links"), F.min("root").alias("root"))
    named = packed.select("id", F.when(F.col("id").isNotNull(), digest).alias("digest")).join(known, "digest", "left")
    component = F.coalesce("root", "id")
    return named.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
