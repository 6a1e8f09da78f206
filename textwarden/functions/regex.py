"""Building blocks for rule matching with literal patterns.

Patterns are always literals, so Spark compiles each one once per task and the optimizer sees plain predicates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql import functions as F

_ASCII_EDGE = (
    "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)


def ascii_words(pattern: str) -> str:
    """Java pattern whose word boundaries are ASCII and whose dot stops at a newline only."""
    return "(?d)" + re.sub(r"(?<!\\)\\b", lambda _: _ASCII_EDGE, pattern)


def unicode_words(pattern: str, flags: str = "") -> str:
    r"""Java pattern in which \b, \w, \d, \s and case folding follow Unicode."""
    return f"(?Ud{flags})" + pattern


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def has_literals(lowered: Column, groups: Sequence[Sequence[str]]) -> Column:
    """True when the lower-cased text holds at least one literal of every group."""
    return all_of([any_of([F.contains(lowered, F.lit(word)) for word in group]) for group in groups])


def first_rule(conditions: Sequence[Column]) -> Column:
    """1-based number of the first condition that holds, NULL when none does; later ones are not evaluated."""
    chain = F.when(conditions[0], F.lit(1))
    for number, condition in enumerate(conditions[1:], start=2):
        chain = chain.when(condition, F.lit(number))
    return chain


def pick(values: Sequence, number: Column) -> Column:
    """Literal from ``values`` at a 1-based position column."""
    return F.get(F.array(*[F.lit(value) for value in values]), number - 1)


def matched_text(text: Column, patterns: Sequence[str], number: Column) -> Column:
    """The text matched by the numbered pattern; evaluated for rows with a number only."""
    return F.when(
        number.isNotNull(),
        F.call_function("regexp_extract", text, pick(patterns, number), F.lit(0)),
    )


# A code point that Unicode reserves as "not a character".
_CUT = "\ufdd0"


def replace_matches(text: Column, pattern: str, replacement: Callable[[Column], Column]) -> Column:
    """Replace every match by an expression of the match: cut the text at the matches, rewrite them, zip both back.

    Cutting at one character keeps the compiled pattern in use; splitting by the pattern itself would compile it for
    every row, so that form serves only texts that hold the cut character.
    """
    gaps = F.when(F.contains(text, F.lit(_CUT)), F.split(text, pattern, -1)).otherwise(
        F.split(F.regexp_replace(text, pattern, _CUT), _CUT, -1)
    )
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(
        gaps,
        F.transform(matches, replacement),
        lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))),
    )
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def series_udf(return_type: T.DataType):
    """Arrow UDF that the optimizer evaluates exactly once, where it is written.

    Marked non-deterministic because projections would otherwise be merged and the call copied into every use.
    """

    def wrap(function):
        return F.pandas_udf(function, return_type).asNondeterministic()

    return wrap
