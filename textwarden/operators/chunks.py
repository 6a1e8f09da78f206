"""Canary tokens in responses that arrive in chunks, wherever a chunk ends.

A chunk is read behind the last characters of what came before it: one fewer than the longest token has, so every place is
seen whole in exactly one chunk, the one that it ends in. That overlap crosses any number of short chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textwarden.functions.regex import let
from textwarden.operators.sequence import BLOCK_ROWS

# Stands before a text, so that a token at its start is a cut like any other. Unicode reserves it as "not a character".
_FRONT = "﷐"


def places(text: Column, token: Column) -> Column:
    """Where ``token`` starts in ``text``, from 1, overlapping places included."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E)"))
    pieces = F.split(F.concat(F.lit(_FRONT), text), quoted, -1)
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts"))

    def cut(state: Column, piece: Column) -> Column:
        total = state["total"] + F.length(piece)
        return F.struct(total.alias("total"), F.concat(state["starts"], F.array(total)).alias("starts"))

    found = let(pieces, lambda parts: F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, cut)["starts"])
    return F.when(F.contains(text, token), found).otherwise(F.array().cast("array<int>"))


def _tail(parts: Column, reach: int) -> Column:
    return F.right(F.array_join(parts, ""), F.lit(reach))


def split_leaks(
    chunks: DataFrame, response: Sequence[str], chunk_no: str, text: str, tokens: str | Sequence[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(response columns, token, position, chunk_no): every place of every token, its first character counted from 1.

    ``chunk_no`` is the chunk that a place ends in; chunks of a response have different, non-negative numbers. Null and
    empty chunks hold nothing. ``tokens`` names an array column, or is a list. A response is cut into blocks of chunk numbers, and
    one row per block carries length and last characters on, so a long response spreads over tasks.
    """
    key = list(response)
    if isinstance(tokens, str):
        lengths = chunks.agg(F.max(F.array_max(F.transform(tokens, F.length)))).first()
        longest, listed = lengths[0] or 0, F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    else:
        longest, listed = max(map(len, tokens), default=0), F.array(*[F.lit(token) for token in tokens]).cast("array<string>")
    reach = max(1, longest - 1)
    wanted = F.array_distinct(F.filter(listed, lambda token: token.isNotNull() & (token != "")))
    df = chunks.where(F.length(text) > 0).select(
        *key, F.col(chunk_no).cast("long").alias("_no"), F.col(text).alias("_text"), wanted.alias("_tokens"),
        F.call_function("div", F.col(chunk_no), F.lit(block_rows)).alias("_block"),
    )
    inside = Window.partitionBy(*key, "_block").orderBy("_no")
    ends = F.collect_list(F.right("_text", F.lit(reach)))
    df = df.withColumns(
        {
            "_tail_inside": _tail(ends.over(inside.rowsBetween(-reach, -1)), reach),
            "_n_inside": F.coalesce(F.sum(F.length("_text")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    blocks = df.groupBy(*key, "_block").agg(
        F.sum(F.length("_text")).alias("_n_block"),
        F.max_by(F.right(F.concat("_tail_inside", "_text"), F.lit(reach)), "_no").alias("_end_block"),
    )
    earlier = Window.partitionBy(*key).orderBy("_block")
    carries = blocks.select(
        *key, "_block",
        F.coalesce(F.sum("_n_block").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n_carry"),
        _tail(F.collect_list("_end_block").over(earlier.rowsBetween(-reach, -1)), reach).alias("_tail_carry"),
    )
    joined = df.join(carries, [*key, "_block"]).select(
        *key, "_no", "_text", "_tokens", (F.col("_n_carry") + F.col("_n_inside")).alias("_before"),
        F.right(F.concat("_tail_carry", "_tail_inside"), F.lit(reach)).alias("_tail"),
    )
    read = joined.withColumn("_window", F.concat("_tail", "_text"))

    def of_token(token: Column) -> Column:
        ended = F.filter(places(F.col("_window"), token), lambda place: place + F.length(token) - 1 > F.length("_tail"))
        return F.transform(ended, lambda place: F.struct(token.alias("token"), (F.col("_before") - F.length("_tail") + place).cast("long").alias("position")))

    hits = F.flatten(F.transform(F.filter("_tokens", lambda token: F.contains("_window", token)), of_token))
    return read.select(*key, F.col("_no").alias("chunk_no"), F.explode(hits).alias("_hit")).select(*key, "_hit.token", "_hit.position", "chunk_no")
