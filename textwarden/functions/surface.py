"""Readings of HTTP request surfaces: what a downstream interpreter sees instead of what was typed."""

from __future__ import annotations

import base64
import binascii

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden import fixed_values as fv
from textwarden.functions.regex import let, replace_matches, series_udf
from textwarden.functions.text import decode_entities

_WORD = "[A-Za-z0-9_]"
_C0_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
_VERSIONED_COMMENT = r"(?d)/\*!\d*(.*?)\*/"
_COMMENT = r"(?d)/\*.*?\*/"
_OVERLONG = r"(?i)%c[01](?:%[89ab][0-9a-f]|(?=[./\\]|%2e|%2f|%5c))"


def _shifted_text(block: str) -> str | None:
    """Printable ASCII held by one UTF-7 shift block, or None."""
    code = block.replace(",", "/")
    if not 0 < len(code) <= 256:
        return None
    try:
        raw = base64.b64decode(code + "=" * (-len(code) % 4), validate=True)
        plain = raw.decode("utf-16-be")
    except (binascii.Error, ValueError):
        return None
    return plain if plain and all(" " <= letter <= "~" for letter in plain) else None


def _undo_utf7(text: str) -> str:
    pieces, rest = [], text
    while True:
        head, plus, tail = rest.partition("+")
        pieces.append(head)
        if not plus:
            return "".join(pieces)
        block, dash, after = tail.partition("-")
        plain = _shifted_text(block) if dash else None
        pieces.append("+" if plain is None else plain)
        rest = tail if plain is None else after


@series_udf(T.StringType())
def _undo_utf7_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_undo_utf7, na_action="ignore")


def decode_utf7(text: Column) -> Column:
    """UTF-7 shift sequences that hide printable ASCII. Such a block always starts with A and one of C to H."""
    return F.coalesce(_undo_utf7_udf(F.when(text.rlike(r"\+A[C-H].*-"), text)), text)


@series_udf(T.ArrayType(T.StringType()))
def _undo_utf7_each_udf(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: [_undo_utf7(text) for text in texts], na_action="ignore")


def decode_utf7_each(texts: Column) -> Column:
    wanted = F.exists(texts, lambda text: text.rlike(r"\+A[C-H].*-"))
    return F.coalesce(_undo_utf7_each_udf(F.when(wanted, texts)), texts)


def _shorten_overlong(text: Column) -> Column:
    """Two-byte overlong escapes become the one-byte escape they stand for; stray lead bytes are dropped."""

    def short(escape: Column) -> Column:
        high = F.translate(F.lower(F.substring(escape, 5, 1)), "89ab", "0123").cast("int")
        high = high + F.when(F.substring(escape, 3, 1) == "1", 4).otherwise(0)
        return F.when(F.length(escape) == 6, F.concat(F.lit("%"), high.cast("string"), F.substring(escape, 6, 1)))

    return replace_matches(text, _OVERLONG, short)


def decode_escapes(text: Column) -> Column:
    """Query unescaping to a fixed point within five rounds; a malformed escape stops it."""
    rounds = F.aggregate(
        F.array(*[F.lit(number) for number in range(5)]),
        text,
        lambda current, _: F.coalesce(F.try_url_decode(_shorten_overlong(current)), current),
    )
    return F.when(text.rlike("[%+]"), rounds).otherwise(text)


def unwrap_comments(text: Column, around: str = " ", instead: str = " ") -> Column:
    """Versioned SQL comments give way to their content, other comments to ``instead``."""
    opened = F.regexp_replace(text, _VERSIONED_COMMENT, f"{around}$1{around}")
    return F.when(F.contains(text, F.lit("/*")), F.regexp_replace(opened, _COMMENT, instead)).otherwise(text)


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, _C0_CONTROLS, "")


def collapse_line_breaks(text: Column) -> Column:
    """Tabs and line breaks vanish inside a word and become a blank elsewhere."""
    inside = F.regexp_replace(text, rf"(?<={_WORD})[\t\r\n](?={_WORD})", "")
    return F.translate(inside, "\t\r\n", "   ")


def decode_shifted(text: Column) -> Column:
    """Query escapes, overlong bytes and entities of a text whose UTF-7 is undone."""
    return let(decode_escapes(text), decode_entities)


def decode_surface(text: Column) -> Column:
    """UTF-7, query escapes, overlong bytes and entities, in that order."""
    return decode_shifted(decode_utf7(text))


def spaced_view(decoded: Column) -> Column:
    return strip_controls(unwrap_comments(decoded))


def compact_view(decoded: Column) -> Column:
    return collapse_line_breaks(strip_controls(unwrap_comments(decoded, around="", instead="")))


def needs_compact_view(raw: Column) -> Column:
    return raw.rlike(r"/\*|[\x00\t\r\n]")


def query_values(query: Column) -> Column:
    """Raw values of the parameters of a query string; a part without '=' counts as a value."""
    return F.transform(
        F.split(query, "&", -1),
        lambda part: F.when(F.contains(part, F.lit("=")), F.regexp_replace(part, "^[^=]*=", "")).otherwise(part),
    )


def pollution_candidate(query: Column) -> Column:
    return F.contains(query, F.lit("&")) & query.rlike(fv.POLLUTION_MARK)
