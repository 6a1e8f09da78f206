"""Words and their hashes for whole Arrow batches: numpy over the batch's bytes, no Python object for a word.

Hashes are polynomials over odd multipliers modulo 2**64, finished by a bit mixer; sums from the left make the hash of every
run of bytes or words a difference of two of them. All constants come from one generator, so every worker agrees.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text worked on at once; longer single texts are taken whole.
CHUNK = 1 << 20
#: Bytes of text that come back from a Python task in one batch.
SLICE = 1 << 20

Batches = Iterator[pa.RecordBatch]


def lean(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for mapInArrow that gives freed memory back after its task; what a pool holds on to would stay with the worker for later stages."""

    @wraps(work)
    def run(batches: Batches) -> Batches:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        # The C library has no such call everywhere.
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """The public SplitMix64 finisher."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_BYTES = mix((np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)))
_STEPS = {"byte": 0x2545F4914F6CDD1D, "word": 0xD1342543DE82EF95}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}

#: Lower-case A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between ASCII blanks: all but 0x20 and 0x09-0x0D.
BLANK_WORDS = np.ones(256, dtype=bool)
BLANK_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of plain words: digits, lower-case letters and everything beyond ASCII.
PLAIN_WORDS = np.zeros(256, dtype=bool)
PLAIN_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, at least ``n`` of them."""
    held = _POWERS.get(kind)
    if held is None or len(held[0]) < n:
        n, step = max(n, min(CHUNK, 1 << max(16, (n - 2).bit_length())) + 1), _STEPS[kind]
        tables = []
        for base in (step, pow(step, -1, 1 << 64)):
            table = np.full(n, base, dtype=U)
            table[0] = 1
            tables.append(np.cumprod(table))
        held = _POWERS[kind] = tables[0], tables[1]
    return held


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values, out=out[1:])
    return out


class Words:
    """The words of some documents: ``bounds[d]:bounds[d + 1]`` are the places of document d's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, lower: bool):
        self.data = data = LOWER[data] if lower else data
        n, inside = len(data), letters[data]
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            cut = offsets[1:-1]
            before[cut[cut < n]] = False
            after[cut[cut > 0] - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.offsets, self.bounds = offsets, np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        up, down = _powers("byte", n + 1)
        sums = _sums(_BYTES[self.data] * up[:n])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def of_word(self) -> np.ndarray:
        """Document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def room(self) -> np.ndarray:
        """For each word, how many words its document has from there on."""
        return np.repeat(self.bounds[1:], self.counts) - np.arange(len(self))

    def texts(self, d: int) -> list[bytes]:
        """The words of document ``d``."""
        lo, hi = self.bounds[d], self.bounds[d + 1]
        if lo == hi:
            return []
        base = self.starts[lo]
        raw = self.data[base : self.ends[hi - 1]].tobytes()
        return [raw[a:b] for a, b in zip((self.starts[lo:hi] - base).tolist(), (self.ends[lo:hi] - base).tolist(), strict=True)]


class Runs:
    """Hashes of runs of consecutive words, out of sums from the left."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _powers("word", len(hashes) + 1)
        self.sums = _sums(hashes * up[: len(hashes)])

    def at(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.down[first])

    def all(self, k: int) -> np.ndarray:
        """Of every k consecutive words, also across documents: callers leave those out by ``room``."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, dtype=U)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def chunks(column: pa.Array, rows: int = 1 << 30, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a string column; null counts as empty, no document is cut."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        end = min(end, row + rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of parts of a string column that hold about ``size`` bytes each; a longer text is alone."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
    at, before = 0, 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield at, end - at
        at, before = end, int(ends[end - 1])


def words_in(column: pa.Array, letters: np.ndarray, lower: bool, size: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    for row, end, data, offsets in chunks(column, size=size):
        yield row, end, Words(data, offsets, letters, lower)


def gram_counts(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], width: int) -> np.ndarray:
    """(document, slot) counts of hashed byte n-grams of the given sizes; none reaches into the next document."""
    docs = len(offsets) - 1
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    room = offsets[1:][doc] - np.arange(len(data))
    out = np.zeros(docs * width)
    code = np.zeros(len(data), dtype=U)
    for n in range(1, max(sizes) + 1):
        held = len(data) - n + 1
        if held <= 0:
            break
        code = (code[:held] << U(8)) | data[n - 1 :]
        if n in sizes:
            fits = room[:held] >= n
            slot = ((code[fits] + U(n << 40)) * U(0x9E3779B97F4A7C15)) >> U(64 - width.bit_length() + 1)
            out += np.bincount(doc[:held][fits] * width + slot.astype(np.int64), minlength=docs * width)
    return out.reshape(docs, width)


def character_runs(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of n UTF-8 characters; none reaches into the next document."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    ends = np.r_[starts, len(data)][n:]
    starts = starts[: len(ends)]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    fits = ends <= offsets[doc + 1]
    starts, ends, doc = starts[fits], ends[fits], doc[fits]
    up, down = _powers("byte", len(data) + 1)
    sums = _sums(_BYTES[data] * up[: len(data)])
    return doc, mix((sums[ends] - sums[starts]) * down[starts] + U(n))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
