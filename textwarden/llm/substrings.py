"""Repeated passages by anchored chunks of every document, matched by content; this replaces a relative Lempel-Ziv parse.

The corpus is cut into chunks, here called factors, where any two equal passages are cut alike: of the ``SEED``-word runs in a
window of ``width`` words, the one with the smallest hash is the window's anchor, and neighbouring windows with one anchor
make a factor. Factors are grouped by their content's hash, so no document meets an index of the others. A factor that stands whole at two places is a duplicate. Where factors differ around one anchor,
which is at the ends of passages, the windows across the factors' boundaries are compared one by one.

Counts are taken before anything is joined, so a passage in a third of all documents is one row for each task. Only
distinct factors are opened at their boundaries. Nothing is gathered beyond one document's factors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.tables import keep
from textwarden.llm.wordstream import BLANK_WORDS, Runs, U, Words, mix, signed, words_in

WIDTH = 35
SEED = 8
#: The low bits of a seed's rank hold its place in the chunk; the others are the top of its hash.
_PLACE = U((1 << 27) - 1)


def _sliding_least(x: np.ndarray, span: int) -> np.ndarray:
    """Least of every ``span`` neighbours, by doubling."""
    n, held = len(x) - span + 1, 1
    while held * 2 <= span:
        x = np.minimum(x[:-held], x[held:])
        held *= 2
    return np.minimum(x[:n], x[span - held : span - held + n])


def cut_factors(words: Words, width: int = WIDTH, seed: int = SEED) -> dict[str, np.ndarray]:
    """Factors of the chunk's documents: doc, first window's place in the document, windows, anchor and content hash."""
    empty = np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(words.room() >= width)
    if not len(starts):
        return {k: empty for k in ("doc", "first", "n", "anchor", "factor", "at")}
    runs = Runs(words.hashes())
    seeds = runs.all(seed)
    least = _sliding_least((seeds & ~_PLACE) | np.arange(len(seeds), dtype=U), width - seed + 1)
    anchor = (least[starts] & _PLACE).astype(np.int64)
    fresh = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first, n, at = starts[fresh], np.diff(np.r_[fresh, len(starts)]), anchor[fresh]
    content = runs.at(first, first + n + width - 1)
    content = mix(content ^ (n.astype(U) * U(0x9E3779B97F4A7C15) + (at - first).astype(U) * U(0xC2B2AE3D27D4EB4F)))
    doc = np.searchsorted(words.bounds, first, side="right") - 1
    return {"doc": doc, "first": first - words.bounds[doc], "n": n, "anchor": signed(seeds[at]), "factor": signed(content), "at": first}


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and the text's hash: rows that agree in id and text share what is found, repeated rows stay rows."""
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["_id"].eqNullSafe(right["_id"]) & (left["_hash"] == right["_hash"])


def _anchors(width: int, seed: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in words_in(batch.column("_text"), BLANK_WORDS, False):
                yield pa.RecordBatch.from_arrays([pa.array(cut_factors(words, width, seed)["anchor"])], ["anchor"])

    return work


def _factors(width: int, seed: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, words in words_in(batch.column("_text"), BLANK_WORDS, False):
                found = cut_factors(words, width, seed)
                rows = pa.array(found["doc"] + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(rows), batch.column("_hash").take(rows), *(pa.array(found[k]) for k in ("anchor", "factor")), *(pa.array(found[k].astype(np.int32)) for k in ("first", "n"))],
                    ["_id", "_hash", "anchor", "factor", "first", "n"],
                )

    return work


def _boundary_windows(width: int):
    """Windows of the factors that a row of a document lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened = batch.column("opened")
            for row, end, words in words_in(batch.column("_text"), BLANK_WORDS, False):
                runs = Runs(words.hashes())
                part = opened.slice(row, end - row)
                flat = part.flatten()
                if not len(flat):
                    continue
                doc = np.repeat(np.arange(end - row), part.value_lengths().to_numpy())
                first, n = (flat.field(k).to_numpy().astype(np.int64) for k in ("first", "n"))
                of = np.repeat(np.arange(len(first)), n)
                idx = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                at = (words.bounds[doc] + first)[of] + idx
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [flat.field("anchor").take(rows), flat.field("factor").take(rows), pa.array(idx.astype(np.int32)), pa.array(signed(runs.at(at, at + width)))],
                    ["anchor", "factor", "idx", "window"],
                )

    return work


def parse_factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """Duplicate factors of every document.

    Columns: _id, _hash (of the text), first (word at which the factor's first window starts), n (its windows), mask (bit i
    set: the window that starts at ``first`` + i stands elsewhere too), source (the smallest place of the same
    factor: id, text hash and word; for whole factors this is the reference that the document copies).
    """
    if not 0 < width - seed + 1 <= 62:
        raise ValueError("a factor's windows must fit a 62-bit mask: width - seed + 1 is to be from 1 to 62")
    rows = _identified(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = rows.select("_text")
    often = texts.mapInArrow(_anchors(width, seed), "anchor long").groupBy("anchor").count().where("count > 1").select("anchor")
    schema = f"_id {id_type}, _hash long, anchor long, factor long, first int, n int"
    factors = keep(rows.mapInArrow(_factors(width, seed), schema).join(often, "anchor"), "factors")
    place = F.struct("_id", "_hash", "first", "n")
    distinct = keep(factors.groupBy("anchor", "factor").agg(F.count("*").alias("times"), F.min(place).alias("source")), "distinct-factors")
    torn = distinct.groupBy("anchor").count().where("count > 1").select("anchor")
    torn_factors = distinct.join(torn, "anchor").select(F.col("source._id").alias("_id"), F.col("source._hash").alias("_hash"), F.struct("anchor", "factor", F.col("source.first").alias("first"), F.col("source.n").alias("n")).alias("f"))
    opened = torn_factors.groupBy("_id", "_hash").agg(F.collect_list("f").alias("opened"))
    windows = opened.join(rows, _same_row(opened, rows), "left").select("_text", "opened").mapInArrow(_boundary_windows(width), "anchor long, factor long, idx int, window long").distinct()
    windows = keep(windows, "boundary-windows")
    again = windows.groupBy("anchor", "window").count().where("count > 1").select("anchor", "window")
    masks = windows.join(again, ["anchor", "window"]).groupBy("anchor", "factor").agg(F.bit_or(F.expr("shiftleft(1L, idx)")).alias("crossing"))
    whole = F.when(F.col("times") > 1, F.expr("shiftleft(1L, source.n) - 1"))
    known = distinct.join(masks, ["anchor", "factor"], "left").withColumn("mask", F.coalesce(whole, "crossing")).where("mask is not null")
    known = known.select("anchor", "factor", "mask", "source")
    return factors.join(known, ["anchor", "factor"]).select("_id", "_hash", "first", "n", "mask", "source")


def _cut_out(width: int, fields: list[str], with_text: bool):
    """Drop the covered words; per document the counts, the digest and, if asked, the text that stays."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = batch.column("_text"), batch.column("spans")
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for row, end, words in words_in(text, BLANK_WORDS, False):
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                part = spans.slice(row, end - row)
                flat = part.flatten()
                if len(flat):
                    lengths = np.where(part.is_valid().to_numpy(zero_copy_only=False), part.value_lengths().fill_null(0).to_numpy(), 0)
                    doc = np.repeat(np.arange(end - row), lengths)
                    first, mask = (flat.field(k).to_numpy().astype(np.int64) for k in ("first", "mask"))
                    bits = (mask[:, None] >> np.arange(63)) & 1
                    of, idx = np.nonzero(bits)
                    at = (words.bounds[doc] + first)[of] + idx
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), np.minimum(words.bounds[:-1], len(gone))) if len(words.counts) else []
                removed = np.where(words.counts > 0, removed, 0)
                for d in range(end - row):
                    own = words.texts(d)
                    if removed[d]:
                        lo, hi = words.bounds[d], words.bounds[d + 1]
                        own = [w for w, g in zip(own, gone[lo:hi].tolist(), strict=True) if not g]
                    kept = b" ".join(own)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        kept_texts.append((text[row + d].as_py() if not removed[d] else kept.decode()))
                n_words += words.counts.tolist()
                n_removed += removed.tolist()
            columns = {f: batch.column(f) for f in fields if f not in ("_text", "spans")}
            columns |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if with_text:
                columns["kept_text"] = pa.array(kept_texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return work


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = True, seed: int = SEED) -> DataFrame:
    """Each document without the words that a repeated window of ``width`` words covers.

    Columns: the id, n_words, n_removed, kept_sha256 and, ``with_text``, kept_text (the text itself where nothing goes, else the
    kept words joined by one space). A null or empty text, and one of fewer words than a window, loses nothing; a null text
    stays null. Null and repeated ids are fine: every input row gives a row; rows equal in id and text count as two places.
    Other columns are not looked at. An empty table gives an empty result.
    """
    rows = _identified(docs, id_col, text_col)
    factors = parse_factors(docs, id_col, text_col, width, seed)
    spans = factors.groupBy("_id", "_hash").agg(F.collect_set(F.struct("first", "mask")).alias("spans"))
    joined = rows.join(spans, _same_row(rows, spans), "left").select(rows["_id"], rows["_text"], "spans")
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    out = joined.mapInArrow(_cut_out(width, ["_id", "_text", "spans"], with_text), schema)
    return out.withColumnRenamed("_id", id_col)
