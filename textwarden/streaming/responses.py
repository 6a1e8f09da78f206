"""Streams of chats with a state per conversation or response: canaries across chunks, and reversible masking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textwarden.operators.vault import fill_marks, with_marks


def _options(ttl_ms: int | None) -> dict[str, str]:
    """State with a time limit needs the processing-time mode, in which a stream never comes to an end by itself."""
    return {"outputMode": "Append", "timeMode": "None" if ttl_ms is None else "ProcessingTime"}


class _Tails(StatefulProcessor):
    """Last characters of a response, and the chunks that came before their turn."""

    def __init__(self, tokens: Sequence[str], ttl_ms: int | None, key: Sequence[str]):
        self._tokens, self._ttl, self._key = sorted(set(filter(None, tokens))), ttl_ms, list(key)
        self._reach = max(1, max(map(len, self._tokens), default=0) - 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        read = T.StructType([T.StructField("tail", T.StringType()), T.StructField("length", T.LongType()), T.StructField("next", T.LongType()), T.StructField("early", T.LongType())])
        self._read = handle.getValueState("read", read, self._ttl)
        self._early = handle.getMapState(
            "early", T.StructType([T.StructField("no", T.LongType())]), T.StructType([T.StructField("text", T.StringType())]), self._ttl
        )

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        tail, length, following, early = self._read.get() if self._read.exists() else ("", 0, 0, 0)
        waiting: dict[int, str] = {}
        for frame in rows:
            if not len(frame):
                continue
            waiting.update((int(no), text or "") for no, text in zip(frame["chunk_no_"], frame["text_"]) if no >= following)
            out = []
            while True:
                text = waiting.pop(following, None)
                if text is None and early and self._early.containsKey((following,)):
                    (text,) = self._early.getValue((following,))
                    self._early.removeKey((following,))
                    early -= 1
                if text is None:
                    break
                window = tail + text
                for token in self._tokens:
                    at = window.find(token, max(0, len(tail) - len(token) + 1))
                    while at >= 0:
                        out.append((token, length - len(tail) + at + 1, following))
                        at = window.find(token, at + 1)
                tail, length, following = window[-self._reach :], length + len(text), following + 1
            if out:
                found = pd.DataFrame(out, columns=["token", "position", "chunk_no"])
                for place, name in enumerate(self._key):
                    found.insert(place, name, key[place])
                yield found
        for no, text in waiting.items():
            early += not self._early.containsKey((no,))
            self._early.updateValue((no,), (text,))
        self._read.update((tail, length, following, early))

    def close(self) -> None:
        pass


def canary_stream(chunks: DataFrame, response: Sequence[str], chunk_no: str, text: str, tokens: Sequence[str], ttl_ms: int | None = None) -> DataFrame:
    """(response columns, token, position, chunk_no) of a stream of chunks numbered from 0; the same rows as ``chunks.split_leaks``.

    The state of a response is its last characters, one fewer than the longest token has, and what arrived early;
    with ``ttl_ms`` it ends so long after the response's last chunk, else it stays. A chunk that comes twice is read once.
    """
    read = chunks.select(*response, F.col(chunk_no).cast("long").alias("chunk_no_"), F.col(text).alias("text_"))
    fields = [read.schema[name] for name in response]
    schema = T.StructType([*fields, T.StructField("token", T.StringType()), T.StructField("position", T.LongType()), T.StructField("chunk_no", T.LongType())])
    return read.groupBy(*response).transformWithStateInPandas(_Tails(tokens, ttl_ms, response), outputStructType=schema, **_options(ttl_ms))


class _Numbers(StatefulProcessor):
    """Numbers of a conversation's vaulted values, as far as it has come."""

    def __init__(self, ttl_ms: int | None):
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = T.StructField("kind", T.StringType())
        self._known = handle.getMapState(
            "known", T.StructType([kind, T.StructField("original", T.StringType())]), T.StructType([T.StructField("n", T.LongType())]), self._ttl
        )
        self._last = handle.getMapState("last", T.StructType([kind]), T.StructType([T.StructField("n", T.LongType())]), self._ttl)

    def _number(self, kind: str, original: str) -> tuple[int, bool]:
        if self._known.containsKey((kind, original)):
            return self._known.getValue((kind, original))[0], False
        n = 1 + (self._last.getValue((kind,))[0] if self._last.containsKey((kind,)) else 0)
        self._known.updateValue((kind, original), (n,))
        self._last.updateValue((kind,), (n,))
        return n, True

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            out = []
            if not len(frame):
                continue
            ordered = frame.sort_values("turn_")
            for turn, marked, values in zip(ordered["turn_"], ordered["marked_"], ordered["values_"]):
                names = [(v["kind"], int(v["place"]), v["original"], *self._number(v["kind"], v["original"])) for v in values]
                out.append((key[0], int(turn), marked, sorted(({"kind": k, "place": p, "n": n} for k, p, _, n, _ in names), key=lambda x: (x["kind"], x["place"])),
                            [{"kind": k, "n": n, "original": o} for k, _, o, n, new in names if new]))
            yield pd.DataFrame(out, columns=["_conv", "_turn", "_marked", "_names", "vaulted"])

    def close(self) -> None:
        pass


def mask_reversibly_stream(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", ttl_ms: int | None = None) -> DataFrame:
    """(conversation, turn, masked, vaulted): turns with placeholders, and what each adds to the vault (kind, n, original).

    Values are found in the row; the state holds the numbers that a conversation has given so far; with ``ttl_ms``
    they end so long after they were given. Numbers go by arrival, rows that arrive together by turn.
    """
    marked = with_marks(turns, text).select(
        F.col(conversation).alias("_conv"), F.col(turn).cast("long").alias("turn_"), F.col("_marked").alias("marked_"), F.col("_values").alias("values_")
    )
    conv = marked.schema["_conv"].dataType.simpleString()
    schema = f"_conv {conv}, _turn long, _marked string, _names array<struct<kind: string, place: int, n: long>>, vaulted array<struct<kind: string, n: long, original: string>>"
    numbered = marked.groupBy("_conv").transformWithStateInPandas(_Numbers(ttl_ms), outputStructType=schema, **_options(ttl_ms))
    return numbered.select(F.col("_conv").alias(conversation), F.col("_turn").alias(turn), fill_marks(F.col("_marked"), F.col("_names")).alias("masked"), "vaulted")
