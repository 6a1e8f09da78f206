"""Benchmark decontamination: documents streamed through a suffix automaton of the test items.

Items are the query set. They come in blocks of bounded words, each of which becomes one automaton; documents
pass block after block, in place, without a shuffle. One block holds ``BLOCK_WORDS`` words (some tens of MB when built).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.automaton import TextIndex, plain_words
from textwarden.llm.tables import keep
from textwarden.llm.wordstream import PLAIN_WORDS, lean, slices, words_in

WIDTH = 10
BLOCK_WORDS = 100_000
#: Bytes of text whose words are looked up at once; a longer text is taken alone.
PIECE = 1 << 18
_SPANS = "array<struct<first: int, end: int>>"


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> Iterator[TextIndex]:
    """Automata of all items, one block of about ``block_words`` words at a time; an item is never cut."""
    texts = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    n_words = texts.agg(F.sum(F.expr("length(text)") / 2 + 1)).first()[0] or 0
    blocks = max(1, int(n_words // (2 * block_words)) + 1)
    for block in range(blocks):
        own = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        yield TextIndex([(r.id, plain_words(r.text)) for r in own.toLocalIterator()], width)


def _scan(index, columns: list[str]):
    """Add a block's occurrences to the spans (words that it covers, merged) and ids in the rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: TextIndex = index.value
        for batch in (b.slice(*part) for b in batches for part in slices(b.column("_text"))):
            spans, ids, n_words = batch.column("_spans").to_pylist(), batch.column("_ids").to_pylist(), []
            for row, _, words in words_in(batch.column("_text"), PLAIN_WORDS, True, PIECE):
                n_words += words.counts.tolist()
                found: dict[int, tuple[list, set]] = {}
                for first, end, keys in own.hits(words):
                    d = int(np.searchsorted(words.bounds, first, side="right")) - 1
                    at, named = found.setdefault(d, ([], set()))
                    base = int(words.bounds[d])
                    at.append((first - base, end - base))
                    named.update(keys)
                for d, (at, named) in found.items():
                    merged: list[list[int]] = []
                    for first, end in sorted([*at, *((s["first"], s["end"]) for s in spans[row + d])]):
                        if merged and first <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        else:
                            merged.append([first, end])
                    spans[row + d] = [{"first": a, "end": b} for a, b in merged]
                    ids[row + d] = sorted({*ids[row + d], *(k for k in named if k is not None)})
            held = [batch.column(c) for c in columns]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*held, pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(ids, pa.list_(pa.string()))], [*columns, "_n_words", "_spans", "_ids"])

    return lean(work)


def benchmark_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``docs`` but the text (as ``c0``, ``c1``... by their places) with _text, _n_words, _spans of hit words and _ids of items.

    A null text has no words; a null item id marks words but is not listed. Empty tables are fine.
    """
    others = {f"c{i}": c for i, c in enumerate(docs.columns) if c != text_col}
    rows = docs.select(*(F.col(c).alias(name) for name, c in others.items()), F.col(text_col).alias("_text"), F.expr(f"cast(array() as {_SPANS})").alias("_spans"), F.expr("cast(array() as array<string>)").alias("_ids"))
    columns = [*others, "_text"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(columns)])
    schema = f"{kinds}, _n_words long, _spans {_SPANS}, _ids array<string>"
    for block, index in enumerate(item_blocks(items, item_id, item_text, width, block_words)):
        rows = (keep(rows, "decontamination-block") if block else rows).mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(index), columns), schema)
    return rows


@lean
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without the bytes of their hit words; a text without hits is passed on as it is."""
    for batch in (b.slice(*part) for b in batches for part in slices(b.column("_text"))):
        spans, out = batch.column("_spans").to_pylist(), batch.column("_text").to_pylist()
        for row, end, words in words_in(batch.column("_text"), PLAIN_WORDS, True, PIECE):
            for d in range(end - row):
                if spans[row + d]:
                    raw, lead = out[row + d].encode(), int(words.offsets[d])
                    pieces, at = [], 0
                    for s in spans[row + d]:
                        lo, hi = int(words.starts[words.bounds[d] + s["first"]]) - lead, int(words.ends[words.bounds[d] + s["end"] - 1]) - lead
                        pieces.append(raw[at:lo])
                        at = hi
                    out[row + d] = b"".join([*pieces, raw[at:]]).decode("utf-8", "ignore")
        columns = [batch.column(i) for i in range(batch.num_columns)]
        columns[batch.schema.get_field_index("_text")] = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", max_coverage: float = 0.5, **options) -> DataFrame:
    """The documents with hit spans taken out of the texts; those with more than ``max_coverage`` of their words hit are left out.

    Columns and their order stay. Documents without a hit are passed on unchanged, null texts included.
    """
    rows = benchmark_hits(docs, items, text_col, **options)
    held = rows.where(F.expr(f"_n_words = 0 or size(_spans) = 0 or aggregate(_spans, 0, (n, s) -> n + s.end - s.first) <= {max_coverage} * _n_words"))
    clean = held.mapInArrow(_cut, rows.schema)
    return clean.select(*((F.col("_text") if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))


def contamination_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: the id, n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined) and contaminated."""
    rows = benchmark_hits(docs.select(id_col, text_col), items, text_col, **options)
    n_hit = F.expr("cast(aggregate(_spans, 0, (n, s) -> n + s.end - s.first) as long)")
    return rows.select(
        F.col("c0").alias(id_col), F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_ids")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
