"""Hard negatives by an inverted multi-index under integer inner products.

Either half of the vectors has a codebook; the product of the two is the grid of cells. For an anchor, a codeword's half score is bounded by
its inner product with the codeword plus the half anchor's length times the codeword's radius, and a cell by the sum of its halves. A
multi-sequence heap gives the cells by falling bound. Two rounds make a search certain: the first cells give a score that the last wanted
row reaches at least, and the second round visits all cells whose bound reaches that score. Positives are searched first; their scores set
the windows that negatives are searched in, and cells that lie above all windows are passed over.

Equal vectors of one label are one member with their smallest ids. Members are dealt out by cell and packed into blocks, anchors too;
blocks meet without a shuffle where an anchor visits a cell of the other, so nothing is copied for a visit. A task gives the best few rows
of each request, never all scores.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.tables import keep, small_batches

#: Vectors that the codebooks are learned from, at most; members that a cell holds on average; cells of the first round.
SAMPLE, CELL, FIRST = 8192, 1024, 8
#: Members and requests of a block, and bytes of either, at most (but a few at least).
MEMBERS, REQUESTS, BLOCK_BYTES = 4096, 512, 1 << 20
_LONG = 2.0**63
_LOWEST, _HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _pack(scale: int):
    """Whole components as bytes of short integers, or of doubles where one is too large; null for vectors that take no part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for v in batch.column("v"):
                row, size = None, None
                if v.is_valid and v.values.null_count == 0:
                    x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                    if np.isfinite(x).all() and x @ x < _LONG:
                        # + 0.0 makes one vector of those that differ in the sign of a zero.
                        row, size = (x.astype("<i2") if np.abs(x).max(initial=0) < 2**15 else x + 0.0).tobytes(), len(x)
                out.append(row)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(out, pa.binary()), pa.array(sizes, pa.int32())], ["id", "label", "vector", "size"])

    return work


def _matrix(blobs, sizes, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    if all(len(b) == 2 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), dtype="<i2").astype(np.float64).reshape(len(blobs), width)
    x = np.zeros((len(blobs), width))
    for row, blob, size in zip(x, blobs, sizes, strict=True):
        row[:size] = np.frombuffer(blob, dtype="<i2" if len(blob) == 2 * size else "<f8")
    return x


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles as far as they hold every sum, else longs (no sum leaves them, as no squared length does)."""
    far = np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * a.shape[1]
    return (a @ x.T).astype(np.int64) if far < 2.0**53 else a.astype(np.int64) @ x.astype(np.int64).T


def _codebook(x: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(turns):
        near = _nearest(x, c)[0]
        for i in range(len(c)):
            if (near == i).any():
                c[i] = x[near == i].mean(0)
    return np.unique(c, axis=0)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of every row, and the distance to it, rounded up."""
    near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
    away = x - c[near]
    return near, np.sqrt((away * away).sum(1)) * (1 + 1e-9)


def best_first(upper1: np.ndarray, upper2: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, codeword 1, codeword 2) of all cells by falling sum of the halves' bounds; codewords without members are left out."""
    order1, order2 = np.argsort(-upper1, kind="stable"), np.argsort(-upper2, kind="stable")
    u1, u2 = upper1[order1].tolist(), upper2[order2].tolist()
    n1, n2 = int(np.isfinite(u1).sum()), int(np.isfinite(u2).sum())
    heap = [(-(u1[0] + u2[0]), 0, 0)] if n1 and n2 else []
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(order1[i]), int(order2[j])
        if j + 1 < n2:
            heapq.heappush(heap, (-(u1[i] + u2[j + 1]), i, j + 1))
        if j == 0 and i + 1 < n1:
            heapq.heappush(heap, (-(u1[i + 1] + u2[0]), i + 1, 0))


def _cells(x: np.ndarray, books) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of every row, and its distance to either codeword."""
    half = x.shape[1] // 2
    (i, d1), (j, d2) = _nearest(x[:, :half], books[0]), _nearest(x[:, half:], books[1])
    return (i * len(books[1]) + j).astype(np.int64), d1, d2


def _place(shared, width: int, most: int):
    """Cell of every member, with its distance to either codeword; equal ones of a batch are one row with their ``most`` smallest ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = pa.Table.from_batches([batch]).group_by(["vector", "label", "size"], use_threads=False).aggregate([("id", "list")]).combine_chunks()
            for part in each.to_batches(max_chunksize=2048):
                cell, d1, d2 = _cells(_matrix(part.column("vector").to_pylist(), part.column("size").to_pylist(), width), shared.value)
                ids = pa.array([sorted(some)[:most] for some in part.column("id_list").to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(cell), *(part.column(c) for c in ("vector", "label", "size")), ids, pa.array(d1), pa.array(d2)], ["cell", "vector", "label", "size", "ids", "d1", "d2"])

    return work


def _own_cell(shared, width: int):
    """Rows with their cell, by which neighbours get into one block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, _, _ = _cells(_matrix(batch.column("vector").to_pylist(), batch.column("size").to_pylist(), width), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return work


def _rows_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows as they come, so many at a time."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - n)
            held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
            if n == most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _one_row(batch: pa.RecordBatch) -> list[pa.Array]:
    """Every column as one array."""
    return [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), c) for c in batch.columns]


def _member_blocks(most: int):
    """Blocks of members, and the different cells that they are in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _rows_of(batches, most):
            cells = pa.array([np.unique(part.column("cell").to_numpy()).tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*_one_row(part), cells], [*part.schema.names, "cells"])

    return work


class _Requests:
    """Anchors with what bounds their scores in every cell."""

    def __init__(self, x: np.ndarray, least: list, most: list, books, radii, first_round: bool):
        self.x, self.books, self.first_round = x, books, first_round
        half, n = x.shape[1] // 2, len(x)
        parts = (x[:, :half], x[:, half:])
        p = [h @ c.T for h, c in zip(parts, books, strict=True)]
        # Codewords without members have no radius, and nothing is asked of them.
        length = [np.sqrt((h * h).sum(1)) for h in parts]
        reach = [np.where(np.isfinite(r), d[:, None] * np.where(np.isfinite(r), r, 0), -np.inf) for d, r in zip(length, radii, strict=True)]
        self.upper = [a + d for a, d in zip(p, reach, strict=True)]
        self.lower = [a - d for a, d in zip(p, reach, strict=True)]
        sides = [np.abs(a).max(1, initial=0) + np.where(np.isfinite(d), d, 0).max(1, initial=0) for a, d in zip(p, reach, strict=True)]
        self.room = 1e-9 * (sides[0] + sides[1]) + 1e-6
        self.least = np.array([-np.inf if v is None else v for v in least], dtype=np.float64)
        self.most = np.array([np.inf if v is None else v for v in most], dtype=np.float64)
        self.first = np.full((n, FIRST), -1, dtype=np.int64)
        for q in range(n if first_round else 0):
            for place, (_, i, j) in zip(range(FIRST), best_first(self.upper[0][q], self.upper[1][q])):
                self.first[q, place] = i * len(books[1]) + j

    def visits(self, cells: np.ndarray) -> np.ndarray:
        """Which anchors visit which of the cells: the first ones, or all whose bound reaches ``least``, unless all in them scores above ``most``."""
        i, j = cells // len(self.books[1]), cells % len(self.books[1])
        bound, low = self.upper[0][:, i] + self.upper[1][:, j], self.lower[0][:, i] + self.lower[1][:, j]
        seen = (self.first[:, :, None] == cells).any(1) if self.first_round else np.isfinite(bound)
        return seen & (bound + self.room[:, None] >= self.least[:, None]) & (low - self.room[:, None] <= self.most[:, None])


def _request_blocks(shared, width: int, first_round: bool, most: int):
    """Blocks of anchors, and the cells that any of them visits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, radii = shared.value
        every = np.arange(len(books[0]) * len(books[1]))
        for part in _rows_of(batches, most):
            asked = _Requests(_matrix(part.column("vector").to_pylist(), part.column("size").to_pylist(), width), part.column("least").to_pylist(), part.column("most").to_pylist(), books, radii, first_round)
            visits = [at + np.flatnonzero(asked.visits(every[at : at + 4096]).any(0)) for at in range(0, len(every), 4096)]
            yield pa.RecordBatch.from_arrays([*_one_row(part), pa.array([np.concatenate(visits).tolist()], pa.list_(pa.int64()))], [*part.schema.names, "visits"])

    return work


_ANCHOR = ["anchor", "id", "label", "vector", "size", "windows"]
_FOUND = "anchor long, positive long, id long, score long"


class _Best:
    """The best rows so far of each anchor of a block, in each of its windows."""

    def __init__(self, anchors: np.ndarray, own: np.ndarray, windows: list, wanted: int, same: bool):
        self.anchors, self.own, self.wanted, self.same = anchors, own, wanted, same
        many = 1 if same else max((len(w) for w in windows), default=0)
        n = len(anchors)
        # A window that an anchor lacks holds no score.
        self.low, self.high, self.positive = np.full((many, n), _HIGHEST), np.full((many, n), _LOWEST), np.zeros((many, n), dtype=np.int64)
        if same:
            self.low[:], self.high[:] = _LOWEST, _HIGHEST
        else:
            for q, some in enumerate(windows):
                for w, window in enumerate(some):
                    self.low[w, q], self.high[w, q], self.positive[w, q] = window["low"], window["high"], window["positive"]
        self.held = [np.zeros((0, 3), dtype=np.int64) for _ in range(many)]

    def offer(self, q: np.ndarray, scores: np.ndarray, fits: np.ndarray, members: _Members, m: np.ndarray) -> None:
        """Scores of the anchors ``q`` with the members ``m``, of which those count that fit."""
        for w, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            near = fits & (scores >= low[q][:, None])
            if not self.same:
                near &= scores <= high[q][:, None]
            if np.count_nonzero(near) > 8 * (self.wanted + 1) * len(q) and len(m) > self.wanted:
                # No more than the wanted members, and those that score as the last of them; the anchor alone is none.
                near &= ~(members.alone[m] & (members.first[m] == self.own[q][:, None]))
                ranked = np.where(near, scores, _LOWEST)
                near &= scores >= np.partition(ranked, len(m) - self.wanted, axis=1)[:, len(m) - self.wanted][:, None]
            i, j = np.nonzero(near)
            if len(i):
                self.keep(w, q[i], scores[i, j], m[j], members)

    def keep(self, w: int, q: np.ndarray, scores: np.ndarray, m: np.ndarray, members: _Members) -> None:
        times = members.counts[m]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        new = np.c_[np.repeat(q, times), np.repeat(scores, times), members.ids[np.repeat(members.starts[m], times) + place]]
        rows = np.concatenate([self.held[w], new[new[:, 2] != self.own[new[:, 0]]]])
        # No score is the lowest long, so each can be turned round.
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        begins = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]]) if len(rows) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.r_[begins, len(rows)])
        rank = np.arange(len(rows)) - np.repeat(begins, sizes)
        self.held[w] = rows = rows[rank < self.wanted]
        last = rank[rank < self.wanted] == self.wanted - 1
        self.low[w, rows[last, 0]] = np.maximum(self.low[w, rows[last, 0]], rows[last, 1])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for w, held in enumerate(self.held):
            q, score, found = held.T
            positive = pa.array(self.positive[w, q], mask=np.full(len(q), self.same))
            yield pa.RecordBatch.from_arrays([pa.array(self.anchors[q]), positive, pa.array(np.ascontiguousarray(found)), pa.array(np.ascontiguousarray(score))], ["anchor", "positive", "id", "score"])


class _Members:
    """A block of members."""

    def __init__(self, batch: pa.RecordBatch, at: int, width: int, codes: dict):
        of = lambda name: batch.column(f"b_{name}")[at].values
        self.sizes = of("size").to_numpy()
        self.x = _matrix(of("vector").to_pylist(), self.sizes, width)
        self.labels = _coded(of("label"), codes)
        self.cells, self.place = np.unique(of("cell").to_numpy(), return_inverse=True)
        ids = of("ids")
        self.counts, self.ids = pc.list_value_length(ids).to_numpy().astype(np.int64), ids.flatten().to_numpy()
        self.starts = np.cumsum(self.counts) - self.counts
        self.alone, self.first = self.counts == 1, self.ids[self.starts]


def _coded(labels: pa.Array, codes: dict) -> np.ndarray:
    """A number for each label."""
    return np.array([codes.setdefault(label, len(codes)) for label in labels.to_pylist()], dtype=np.int64)


def _compare(shared, width: int, same: bool, wanted: int, first_round: bool):
    """Best rows of every request in a task's blocks: of its own label (``same``), or of other labels in each of its windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, block, best = {}, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                # One block of requests meets many of members, one after the other.
                if block != batch.column("a_block")[at].as_py():
                    if best is not None:
                        yield from best.rows()
                    of = lambda name: batch.column(f"a_{name}")[at].values  # noqa: B023, E731
                    block, sizes, labels = batch.column("a_block")[at].as_py(), of("size").to_numpy(), _coded(of("label"), codes)
                    asked = _Requests(_matrix(of("vector").to_pylist(), sizes, width), of("least").to_pylist(), of("most").to_pylist(), *shared.value, first_round)
                    best = _Best(of("anchor").to_numpy(), of("id").to_numpy(), of("windows").to_pylist(), wanted, same)
                members = _Members(batch, at, width, codes)
                seen = asked.visits(members.cells)
                q, m = np.flatnonzero(seen.any(1)), np.flatnonzero(seen.any(0)[members.place])
                for part in (q[at_ : at_ + 256] for at_ in range(0, len(q), 256)):
                    fits = seen[part][:, members.place[m]] & ((labels[part][:, None] == members.labels[m]) == same) & (sizes[part][:, None] == members.sizes[m])
                    best.offer(part, _scores(asked.x[part], members.x[m]), fits, members, m)
        if best is not None:
            yield from best.rows()

    return work


def _meet(requests: DataFrame, members: DataFrame, shared, width: int, same: bool, wanted: int, first_round: bool, most: int) -> DataFrame:
    """Best rows of each request among the members of the cells that it visits, by blocks of either."""
    kind = dict(requests.dtypes)
    columns = [*_ANCHOR, "least", "most"]
    dealt = requests.repartitionByRange(max(1, int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "cell", "anchor").sortWithinPartitions("cell", "anchor").select(columns)
    schema = ", ".join(f"{c} array<{kind[c]}>" for c in columns) + ", visits array<long>"
    asked = keep(dealt.mapInArrow(_request_blocks(shared, width, first_round, most), schema).withColumn("block", F.monotonically_increasing_id()), "visits")
    a, b = asked.select(*[F.col(c).alias(f"a_{c}") for c in asked.columns]), members.select(*[F.col(c).alias(f"b_{c}") for c in members.columns])
    met = a.hint("shuffle_replicate_nl").join(b, F.arrays_overlap("a_visits", "b_cells")).drop("a_visits", "b_cells")
    return met.mapInArrow(_compare(shared, width, same, wanted, first_round), _FOUND)


def _first(found: DataFrame, wanted: int, *by: str) -> DataFrame:
    """The first rows of each ``by``: higher scores first, then smaller ids."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, percent: int = 80, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every row of ``vectors`` for which ``anchor`` is true.

    Components are floor(scale * x); a score is an inner product, exact. An anchor's positives are the best other rows of its label; for
    each, its negatives are the best rows of other labels whose score is at least ``percent`` of the positive's and not above it. Higher scores
    come first, then smaller ids. All vectors are searched; codebooks come from ``sample`` of them at most, the first by a hash.

    Rows without an id, a label or a vector, with null or non-finite components, or of a squared length beyond a long take no
    part. Rows of one id, label and vector count once, and no row of the anchor's id is its positive or negative. Vectors of different length have no
    score. Other columns are not looked at; an empty table, or one without anchors, gives an empty result.
    """
    spark = vectors.sparkSession
    label = vectors.select(label_col).schema[0].dataType.simpleString()
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    packed = rows.select("id", F.struct("label", "is_anchor").alias("label"), "v").mapInArrow(_pack(scale), f"id long, label struct<label: {label}, is_anchor: boolean>, vector binary, size int")
    known = keep(packed.where("vector is not null").groupBy("id", "label.label", "vector", "size").agg(F.max("label.is_anchor").alias("is_anchor")), "whole-vectors")
    counted = known.agg(F.max("size").alias("width"), F.count("*").alias("n")).first()
    width = max(2, counted["width"] or 0)
    learned = known.select("vector", "size").orderBy(F.xxhash64("vector"), "vector").limit(sample).collect()
    x, k = _matrix([r["vector"] for r in learned], [r["size"] for r in learned], width), max(1, round((counted["n"] / CELL) ** 0.5))
    half = width // 2
    books = tuple(_codebook(h, k) if len(h) else np.zeros((1, h.shape[1])) for h in (x[:, :half], x[:, half:]))
    # One id more than wanted, as the anchor's own does not count.
    enough = max(positives, negatives) + 1
    placing = spark.sparkContext.broadcast(books)
    schema = f"cell long, vector binary, label {label}, size int, ids array<long>, d1 double, d2 double"
    placed = known.select("id", "vector", "label", "size").mapInArrow(_place(placing, width, enough), schema)
    dealt = placed.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "cell", "vector")
    ids = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, enough).alias("ids")
    members = dealt.groupBy("cell", "vector", "label", "size").agg(ids, F.max("d1").alias("d1"), F.max("d2").alias("d2")).sortWithinPartitions("cell", "vector")
    block = lambda most: max(min(most, 64), min(most, BLOCK_BYTES // (2 * width)))
    arrays = schema.replace("cell long", "cell array<long>").replace("vector binary", "vector array<binary>").replace(f"label {label}", f"label array<{label}>")
    arrays = arrays.replace("size int", "size array<int>").replace("ids array<long>", "ids array<array<long>>").replace("d1 double, d2 double", "d1 array<double>, d2 array<double>, cells array<long>")
    with small_batches(spark):
        blocks = keep(members.mapInArrow(_member_blocks(block(MEMBERS)), arrays), "members")
    radii = [np.full(len(c), -np.inf) for c in books]
    away = blocks.select(F.inline(F.arrays_zip("cell", "d1", "d2")))
    words = (F.floor(F.col("cell") / len(books[1])), F.col("cell") % len(books[1]))
    for r, word, d in zip(radii, words, ("d1", "d2"), strict=True):
        for row in away.groupBy(word.alias("word")).agg(F.max(d).alias("d")).collect():
            r[row["word"]] = row["d"]
    blocks = blocks.drop("d1", "d2")
    shared = spark.sparkContext.broadcast((books, radii))

    def meet(requests: DataFrame, same: bool, wanted: int, first_round: bool) -> DataFrame:
        return _meet(requests, blocks, shared, width, same, wanted, first_round, block(REQUESTS))

    def search(asked: DataFrame, same: bool, wanted: int, by: tuple[str, ...], least: Column) -> DataFrame:
        """Both rounds; ``least`` of the first round's rows (and the request's own least) bounds what the second has to visit, which finds all."""
        with small_batches(spark):
            near = keep(_first(meet(asked, same, wanted, True), wanted, *by), "first-round")
            reached = near.groupBy(*by).agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") == wanted)
            bound = asked.drop("least").join(least(asked, reached), "anchor", "left")
            return keep(_first(meet(bound.select(asked.columns), same, wanted, False), wanted, *by), "found")

    no_windows = F.array().cast("array<struct<positive: long, low: long, high: long>>").alias("windows")
    unbounded = [F.lit(None).cast("long").alias(c) for c in ("least", "most")]
    picked = known.where("is_anchor").select(F.xxhash64("id", "label", "vector").alias("anchor"), "id", "label", "vector", "size")
    anchors = keep(picked.mapInArrow(_own_cell(placing, width), f"anchor long, id long, label {label}, vector binary, size int, cell long"), "anchors")
    good = search(anchors.select("*", no_windows, *unbounded), True, positives, ("anchor",), lambda _, reached: reached.select("anchor", F.col("worst").alias("least")))
    # ceil(percent * score / 100) in whole numbers; a window of a negative score is empty.
    low = F.ceil(F.col("score").cast("decimal(20,0)") * percent / 100).cast("long")
    window = F.struct(F.col("id").alias("positive"), low.alias("low"), F.col("score").alias("high"))
    windows = good.select("anchor", window.alias("w")).where("w.low <= w.high").groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("windows"))
    asked = anchors.join(windows, "anchor").select(*_ANCHOR, "cell", F.array_min("windows.low").alias("least"), F.array_max("windows.high").alias("most"))

    def open_windows(requests: DataFrame, reached: DataFrame) -> DataFrame:
        each = requests.select("anchor", F.inline("windows")).join(reached, ["anchor", "positive"], "left")
        return each.groupBy("anchor").agg(F.min(F.coalesce("worst", "low")).alias("least"))

    bad = search(asked, False, negatives, ("anchor", "positive"), open_windows)
    named = good.select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score")).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return bad.join(named, ["anchor", "positive"]).select(
        "anchor_id", F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
