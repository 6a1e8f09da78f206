"""Quality by nearest labelled neighbours in a latent space.

Texts become two TF-IDF vectors: of their terms (real words, runs of two and of three characters, hashed) and of byte trigrams of their
shape (kinds of letters, digits, the signs themselves). Each becomes a latent vector by the leading directions of a labelled sample. Every
document's vectors are compared with all labelled ones, block by block, and the nearest ones vote, weighted by their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.wordstream import PLAIN_WORDS, U, Words, character_runs, chunks, gram_counts

#: Labelled rows that are learned from, at most; 2 MB of latent vectors at this size are broadcast, and 8 MB of directions.
SAMPLE = 4096
#: Slots of shapes and of terms, latent directions of either.
WIDTH, LATENT, NEIGHBOURS = 1024, 32, 25
TERMS, RUNS, ROUNDS = 1 << 16, (2, 3), 6
SIZES = (1, 2, 3)

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = ord("a"), ord("A"), ord("0"), 0x80


@dataclass
class Terms:
    """Terms of some documents: those of document d are ``bounds[d]:bounds[d + 1]``."""

    slots: np.ndarray
    values: np.ndarray
    bounds: np.ndarray

    def times(self, matrix: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.bounds) - 1, matrix.shape[1]))
        for d, (a, b) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)):
            out[d] = self.values[a:b] @ matrix[self.slots[a:b]]
        return out

    def transposed_times(self, matrix: np.ndarray) -> np.ndarray:
        out = np.zeros((TERMS, matrix.shape[1]), dtype=np.float32)
        for d, (a, b) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)):
            out[self.slots[a:b]] += self.values[a:b, None] * matrix[d]  # a document has a slot once
        return out

    def weighted(self, idf: np.ndarray) -> Terms:
        """Times the inverse document frequencies, each document at length 1."""
        values = self.values * idf[self.slots]
        sums = np.r_[0, np.cumsum(values.astype(float) ** 2)]
        length = np.sqrt(np.maximum(np.diff(sums[self.bounds]), 1e-24))
        return Terms(self.slots, (values / np.repeat(length, np.diff(self.bounds))).astype(np.float32), self.bounds)


def _terms(texts: pa.Array) -> Terms:
    keys, docs = [], len(texts)
    for row, end, data, offsets in chunks(pc.utf8_lower(texts)):
        words = Words(data, offsets, PLAIN_WORDS, False)
        found = [(words.of_word(), words.hashes()), *(character_runs(data, offsets, n) for n in RUNS)]
        keys += [(doc + row).astype(U) << U(32) | hashes >> U(64 - TERMS.bit_length() + 1) for doc, hashes in found]
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, dtype=U)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.r_[first, len(key)])
    return Terms((key[first] & U(0xFFFFFFFF)).astype(np.int32), np.log1p(count).astype(np.float32), np.searchsorted(key[first] >> U(32), np.arange(docs + 1).astype(U)))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, Terms]]:
    column = pc.fill_null(column, "")
    for row, end, data, offsets in chunks(column, 1024):
        yield np.log1p(gram_counts(_SHAPE[data], offsets, SIZES, WIDTH)), _terms(column.slice(row, end - row))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]


@dataclass
class Neighbours:
    """Latent spaces and labelled vectors of a fitted sample."""

    idf: np.ndarray
    space: np.ndarray
    term_idf: np.ndarray
    term_space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, x: np.ndarray, terms: Terms) -> np.ndarray:
        return np.hstack([_unit(_unit(x * self.idf) @ self.space), _unit(terms.weighted(self.term_idf).times(self.term_space))]) / np.sqrt(2)

    def score(self, x: np.ndarray, terms: Terms) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), self.prior)
        near = self.latent(x, terms) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(near, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** 8
        vote = (weight * self.labels[top]).sum(1) / np.maximum(weight.sum(1), 1e-12)
        return np.where((x.sum(1) > 0) & (weight.sum(1) > 0), np.clip(vote, 0, 1), self.prior)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, slots, values = [], [], []
        for x, terms in _vectors(batch.column("_text")):
            rows += [r.astype(np.float32).tobytes() for r in x]
            for a, b in zip(terms.bounds[:-1], terms.bounds[1:], strict=True):
                slots.append(terms.slots[a:b].tobytes())
                values.append(terms.values[a:b].tobytes())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in (rows, slots, values)), batch.column("label")], ["features", "slots", "values", "label"])


def _term_space(terms: Terms) -> np.ndarray:
    """Leading directions of weighted terms by subspace iteration, which never holds the full matrix."""
    n = len(terms.bounds) - 1
    y = np.random.default_rng(1).normal(size=(n, min(n, LATENT + 16)))
    for _ in range(ROUNDS):
        y = np.linalg.qr(terms.times(terms.transposed_times(y.astype(np.float32))))[0]
    down = terms.transposed_times(y.astype(np.float32))
    values, mix = np.linalg.eigh(down.T.astype(float) @ down)
    order = np.argsort(values)[::-1][:LATENT]
    return (down @ (mix[:, order] / np.sqrt(np.maximum(values[order], 1e-12)))).astype(np.float32)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label") -> Neighbours:
    """Learn from a sample (text, label 0 or 1) that is already bounded; rows without a label are left out."""
    rows = labelled.select(F.col(text_col).alias("_text"), F.col(label_col).cast("double").alias("label")).where("label is not null").mapInArrow(_features, "features binary, slots binary, values binary, label double").collect()
    if not rows:
        return Neighbours(np.ones(WIDTH), np.zeros((WIDTH, 1)), np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 2)), np.zeros(0), 0.5)
    x = np.frombuffer(b"".join(r.features for r in rows), dtype=np.float32).reshape(len(rows), WIDTH).astype(float)
    terms = Terms(np.frombuffer(b"".join(r["slots"] for r in rows), dtype=np.int32), np.frombuffer(b"".join(r["values"] for r in rows), dtype=np.float32), np.r_[0, np.cumsum([len(r["slots"]) // 4 for r in rows])])
    y = np.array([r.label for r in rows])
    del rows
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    weighted = _unit(x * idf)
    values, directions = np.linalg.eigh(weighted.T @ weighted)
    space = directions[:, np.argsort(values)[::-1][:LATENT]]
    term_idf = (np.log((1 + len(x)) / (1 + np.bincount(terms.slots, minlength=TERMS))) + 1).astype(np.float32)
    model = Neighbours(idf, space, term_idf, _term_space(terms.weighted(term_idf)), np.zeros((0, 0)), y, float(y.mean()))
    model.vectors = model.latent(x, terms)
    return model


def bounded(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows, the first by a hash of their id: the same ones however the table is dealt."""
    return rows.orderBy(F.xxhash64(id_col), id_col).limit(most)


def _score(model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.score(*part) for part in _vectors(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["_id", "score"])

    return work


def score_quality(docs: DataFrame, model: Neighbours, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """Per document: the id, score (0 to 1) and predicted (1 from ``cut`` on).

    Null and empty texts get the labelled rows' mean. Every row gives a row; other columns are not looked at. A model of no rows
    scores 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_score(shared), f"_id {docs.schema[id_col].dataType.simpleString()}, score double")
    return scored.select(F.col("_id").alias(id_col), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text, by folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
