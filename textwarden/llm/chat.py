"""Chat formatting with typed content parts.

A visitor flattens a turn's parts (text, image, audio, document) in order: texts are escaped, attachments become numbered placeholders whose
reference and token count are recorded. Control strings inside texts are escaped reversibly, so the formatted turns
can be read back exactly. Turns are formatted row by row; a conversation is its turns in order. Reading back streams over sorted
turns with one running digest, so a conversation of any length needs no more memory than a turn.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template and the control strings that texts must not contain.
OPEN, CLOSE = "<|turn|>", "<|end|>"
ESCAPE = "~"
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "\0")
PARTS = "array<struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
TOKENS_OF_A_PAGE, TOKENS_OF_A_SECOND, TILE = 256, 12.5, 28

_PIECE = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*?){re.escape(CLOSE)}\n", re.S)


def escape(text: str) -> str:
    text = text.replace(ESCAPE, f"{ESCAPE}0")
    for i, control in enumerate(CONTROLS, 1):
        text = text.replace(control, f"{ESCAPE}{i}")
    return text


def unescape(text: str) -> str:
    return re.sub(rf"{ESCAPE}(\d)", lambda m: (ESCAPE, *CONTROLS)[int(m[1])], text)


class Flatten:
    """Visits a turn's parts; ``text`` is what the template holds, ``attachments`` what stands behind its placeholders."""

    def __init__(self) -> None:
        self.text, self.attachments = "", []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.text += escape(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or TILE) / TILE) * math.ceil((part.get("height") or TILE) / TILE)
        self._attach("image", part, tiles)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * TOKENS_OF_A_SECOND))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 1) * TOKENS_OF_A_PAGE)

    def visit_other(self, part: dict) -> None:
        """A kind without a method is kept as an attachment of no tokens."""
        self._attach("other", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.text += f"<|{kind}:{len(self.attachments)}|>"
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "tokens": tokens})


_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces, attached = [], []
        for role, text, parts in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            flat = Flatten()
            for part in [{"text": text}] if parts is None else [p or {} for p in parts]:
                flat.visit(part)
            name = escape(role or "").replace("\n", f"{ESCAPE}9")
            pieces.append(f"{OPEN}{name}\n{flat.text}{CLOSE}\n")
            attached.append(flat.attachments)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(pieces, pa.string()), pa.array(attached, _ATTACHED)], ["conv_id", "turn", "piece", "attachments"])


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, piece, attachments) of turns (conv_id, turn, role, text and, if there, parts).

    A conversation's format is its pieces by turn. A null text is empty, a null role too; parts, where given, stand instead of
    the text, null parts are empty texts. Other columns are not looked at; repeated rows are turns of their own.
    """
    parts = F.col("parts").cast(PARTS) if "parts" in turns.columns else F.lit(None).cast(PARTS)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", parts.alias("parts"))
    return rows.mapInArrow(_format, "conv_id long, turn long, piece string, attachments array<struct<kind: string, ref: string, tokens: int>>")


def parse_piece(piece: str) -> list[tuple[str, str]]:
    """(role, text with placeholders left as they are) of every turn of a formatted text."""
    return [(unescape(role.replace(f"{ESCAPE}9", "\n")), unescape(body)) for role, body in _PIECE.findall(piece)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, begun, n, chars, loss, turns, loss_sum = None, False, 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def row() -> tuple:
        return now, n, turns.hexdigest(), loss, loss_sum.hexdigest(), chars

    for batch in batches:
        done = []
        for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if not begun or conv != now:
                done += [row()] if begun else []
                now, begun, n, chars, loss, turns, loss_sum = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            chars += len(piece)
            for role, text in parse_piece(piece):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    loss += len(text)
                    loss_sum.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row(), kinds, strict=True)], names)


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, read from its pieces in order of turn (ties by piece, null turns first): n_turns, turns_sha256 (role, line feed,
    text, line feed per turn), loss_chars and loss_sha256 of the assistant's texts, formatted_chars. Null ids are one conversation."""
    dealt = pieces.select("conv_id", "turn", "piece").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    return dealt.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
