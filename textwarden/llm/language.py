"""Language by nearest centroids of TF-IDF byte n-grams.

Each language of a bounded sample is split into a few clusters by spherical k-means; a text goes to the language of the centroid with
the largest cosine. A text further from it than nearly all the language's sample texts of its length are is rejected: the
bound is a quantile for each language and length class. Where few sample texts have a length, their longer ones are cut to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.quality import _unit
from textwarden.llm.wordstream import chunks, gram_counts, lean, slices

#: Labelled texts that are learned from, at most; features of a text and clusters of a language.
SAMPLE, WIDTH, CLUSTERS = 4096, 2048, 4
SIZES = (1, 2, 3)
#: A text is rejected below this share of the least cosine but for one in a hundred of the sample's texts of its length.
REJECT = 0.9
#: Length classes are powers of two of bytes, the last one open; one with fewer texts than ENOUGH takes cut texts as well.
CLASSES, ENOUGH = 21, 100
UNKNOWN = "und"

_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[97:123], _LETTERS[128:] = np.arange(97, 123), np.arange(128, 256)


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, length classes) of some texts at a time."""
    for _, _, data, offsets in chunks(pc.utf8_lower(pc.fill_null(column, "")), 128, 1 << 18):
        size = np.minimum(np.log2(np.maximum(1, np.diff(offsets))).astype(int), CLASSES - 1)
        yield np.log1p(gram_counts(_LETTERS[data], offsets, SIZES, WIDTH)), size


@dataclass
class Centroids:
    idf: np.ndarray
    centres: np.ndarray
    names: list[str]
    #: Sums of the sample's vectors at each centroid, and (centroid, length class) bounds.
    sums: np.ndarray
    least: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = _unit(x * self.idf) @ self.centres.T
        best = near.argmax(1)
        return best, near[np.arange(len(x)), best]


@lean
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r.astype(np.float32).tobytes() for x, _ in _vectors(batch.column("_text")) for r in x]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("lang")], ["features", "lang"])


def _without(model: Centroids, x: np.ndarray, lang: str, near: np.ndarray) -> np.ndarray:
    """Largest cosines of ``near`` with the centroids of a language once ``x`` is taken out of its own one."""
    own = np.flatnonzero(np.array(model.names) == lang)
    sums = model.sums[own].copy()
    sums[(model.centres[own] @ x).argmax()] -= x
    length = np.sqrt((sums * sums).sum(1))
    return np.where(length > 1e-6, near @ sums.T / np.maximum(length, 1e-6), 0).max(1)


def _spread(model):
    """Cosine of every sample text (cut 0), and of its beginnings that fall into shorter classes (cut 1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Centroids = model.value
        for batch in batches:
            langs, sizes, cuts, cosines = [], [], [], []
            for text, lang in zip(batch.column("_text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                raw = text.encode()
                heads = [raw[: 1 << k].decode("utf-8", "ignore") for k in range(2, CLASSES) if 1 << k < len(raw)]
                parts = [text, *(h for h in heads if any(c.isalpha() for c in h))]
                got = list(_vectors(pa.array(parts)))
                x = _unit(np.concatenate([x for x, _ in got]) * own.idf)
                cosines += _without(own, x[0], lang, x).tolist()
                sizes += np.concatenate([size for _, size in got]).tolist()
                langs += [lang] * len(parts)
                cuts += [0] + [1] * (len(parts) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(cuts, pa.int32()), pa.array(cosines, pa.float64())], ["lang", "size", "cut", "cosine"])

    return lean(work)


def _least(rows: list, name: str) -> np.ndarray:
    """Bound of a language for each length class. Cosines grow with length: where few texts have it, no less than for shorter ones."""
    out = np.zeros(CLASSES)
    for k in range(CLASSES):
        whole = [r["cosine"] for r in rows if (r["lang"], r["size"], r["cut"]) == (name, k, 0)]
        cut = [r["cosine"] for r in rows if (r["lang"], r["size"], r["cut"]) == (name, k, 1)]
        mine = whole if len(whole) >= ENOUGH else whole + cut
        bound = float(np.quantile(mine, 0.01)) if mine else 0.0
        out[k] = bound if len(whole) >= ENOUGH else max(bound, out[k - 1] if k else 0.0)
    return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", clusters: int = CLUSTERS) -> Centroids:
    """Learn from a sample that is already bounded; rows without a language or a letter are left out."""
    texts = labelled.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("lang")).where("lang is not null and _text rlike '\\\\p{L}'")
    rows = texts.mapInArrow(_features, "features binary, lang string").collect()
    if not rows:
        return Centroids(np.ones(WIDTH), np.zeros((1, WIDTH)), [UNKNOWN], np.zeros((1, WIDTH)), np.zeros((1, CLASSES)))
    x = np.frombuffer(b"".join(r.features for r in rows), dtype=np.float32).reshape(len(rows), WIDTH).astype(float)
    langs = np.array([r.lang for r in rows])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    x = _unit(x * idf)
    centres, names, sums = [], [], []
    for name in sorted(set(langs.tolist())):
        own = x[langs == name]
        c = own[np.linspace(0, len(own) - 1, min(clusters, len(own))).astype(int)]
        for _ in range(10):
            near = (own @ c.T).argmax(1)
            c = _unit(np.array([own[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))]))
        near = (own @ c.T).argmax(1)
        sums += [own[near == i].sum(0) for i in range(len(c))]
        centres.append(c)
        names += [name] * len(c)
    model = Centroids(idf, np.concatenate(centres), names, np.array(sums), np.zeros((len(names), CLASSES)))
    spread = texts.mapInArrow(_spread(labelled.sparkSession.sparkContext.broadcast(model)), "lang string, size int, cut int, cosine double").collect()
    least = {name: _least([r for r in spread if r["lang"] == name], name) for name in set(names)}
    model.least = np.array([least[name] for name in names])
    return model


def _identify(model, reject: float, text_col: str, keep_rejected: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Centroids = model.value
        for batch in batches:
            rows = batch.column("row")
            texts = rows.field(text_col)
            for at, n in slices(texts):
                part = texts.slice(at, n)
                letters = np.asarray(pc.fill_null(pc.match_substring_regex(part, r"\p{L}"), False))
                names, scores, far = [], [], []
                for x, size in _vectors(part):
                    best, near = own.nearest(x)
                    names += [own.names[i] for i in best]
                    scores.append(np.clip(near, 0, 1))
                    far.append(near < reject * own.least[best, size])
                rejected = ~letters | np.concatenate(far)
                out = pa.RecordBatch.from_arrays([rows.slice(at, n), pa.array(np.where(letters, names, UNKNOWN), pa.string()), pa.array(np.where(letters, np.concatenate(scores), 0.0)), pa.array(rejected)], ["row", "lang_pred", "score", "rejected"])
                yield out if keep_rejected else out.filter(pa.array(~rejected))

    return lean(work)


def identify(docs: DataFrame, model: Centroids, text_col: str = "text", reject: float = REJECT, keep_rejected: bool = True) -> DataFrame:
    """(row, lang_pred, score, rejected): row holds the columns of ``docs`` as they were, nulls and repeated rows included.

    A null text, or one without a letter, is ``und``, scores 0 and is rejected. Any other gets a learned language and its cosine,
    and is rejected when it is further from it than the sample's texts of its length. ``keep_rejected=False`` leaves rejected rows out
    before they go back to the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(_identify(shared, reject, text_col, keep_rejected), schema)
