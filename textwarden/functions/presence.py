"""Cheap looks at whole texts before costly steps: which of them can hold something at all.

Each look is one pattern over Arrow strings, matched in linear time whatever the number of alternatives. It may say yes too often
but never no too often, so the exact step after it runs only where it can find something, and results stay the same.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache
from itertools import product

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarden import fixed_values as fv

# Letters that case folding turns into ASCII letters although lower-casing does not.
FOLDING_LETTERS = ("ſ", "ı", "İ")
_CODE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_GAP = r"[-_. \t\r\n]*"
_GROUPS = 3


def found_in(texts: Column, *patterns: str) -> Column:
    """For each text of an array, a number whose bits tell which of the patterns (RE2, no case) match."""

    @F.arrow_udf("array<int>")
    def look(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        bits = pa.repeat(pa.scalar(0, pa.int32()), len(flat))
        for place, pattern in enumerate(patterns):
            bits = pc.add(bits, pc.if_else(pc.match_substring_regex(flat, pattern), pa.scalar(1 << place, pa.int32()), pa.scalar(0, pa.int32())))
        bounds = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.fill_null(pc.cast(pc.list_value_length(lists), pa.int64()), 0))])
        found = pa.ListArray.from_arrays(bounds.cast(pa.int32()), bits)
        return pc.if_else(lists.is_valid(), found, pa.scalar(None, found.type))

    return look.asNondeterministic()(F.transform(texts, F.make_valid_utf8))


def words_pattern(words: Sequence[str], whole: Sequence[str] = ()) -> str:
    """Pattern of texts that may hold one of the words in any case; those in ``whole`` stand between other than word characters."""
    bounded = [re.escape(word) for word in words if word in whole]
    free = [re.escape(word) for word in words if word not in whole]
    between = [rf"(?:^|[^a-z0-9_])(?:{'|'.join(bounded)})(?:$|[^a-z0-9_])"] if bounded else []
    return "(?i)" + "|".join([f"(?-i:[{''.join(FOLDING_LETTERS)}])", *free, *between])


# All that counts as white space in rules, inside of a class.
_SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _loose(rule: str) -> str:
    """A rule without word boundaries and without limits of repetition: it matches in all texts that the rule matches in."""
    out, in_class = [], False
    for piece in re.finditer(r"\(\?[a-z]+\)|\{\d+,\d+\}|\\?.", rule, re.S):
        word = piece.group()
        if word in (r"\b", "(?i)"):
            continue
        if word == r"\s":
            word = _SPACES if in_class else f"[{_SPACES}]"
        elif word.startswith("{"):
            word = "*"
        elif len(word) == 2 and word.startswith("\\") and word[1].isalnum():
            raise ValueError(f"no loose form of {word} in {rule}")
        in_class = word == "[" or in_class and word != "]"
        out.append(word)
    return "".join(out)


@cache
def _odd_letters(letters: str) -> str:
    """Characters that fold to one of these letters as Java folds them, but its own upper and lower case."""
    wanted = set(letters.lower())
    odd = [c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))) if len(c.upper()) == len(c.lower()) == 1 or c in FOLDING_LETTERS]
    return "".join(c for c in odd if c not in wanted and c.lower() not in wanted and (c.upper().lower()[:1] in wanted or c.lower()[:1] in wanted) or c in FOLDING_LETTERS)


def rules_pattern(rules: Sequence[str]) -> str:
    """Pattern of texts that one of the rules may match in, in any case."""
    odd = _odd_letters("".join(sorted({c for rule in rules for c in rule if c.isalpha()})))
    # With case folded, ſ would be any s.
    return "(?is)" + "|".join([f"(?-i:[{odd}])", *map(_loose, rules)])


def _letters(wanted) -> str:
    return "[" + re.escape("".join(letter for value, letter in enumerate(_CODE) if wanted(value))) + "]"


def _base64_group(before: int, after: int) -> str | None:
    """Four code letters whose three bytes go on with a text of printable characters: so many bytes of a character are missing before and after."""
    lead = {2: 1, 3: 2, 4: 3}
    first = {1: _letters(lambda v: 8 <= v < 32), 0: _letters(lambda v: 32 <= v < 48), 2: _letters(lambda v: 48 <= v < 56), 3: _letters(lambda v: 56 <= v < 60), 4: _letters(lambda v: 60 <= v < 62)}
    second = {1: _letters(lambda v: 2 <= v % 16 < 8), 0: _letters(lambda v: 8 <= v % 16 < 12), 2: _letters(lambda v: 12 <= v % 16 < 14), 3: _letters(lambda v: v % 16 == 14), 4: _letters(lambda v: v % 16 == 15)}
    mod = [_letters(lambda v, rest=rest: v % 4 == rest) for rest in range(4)]
    some = _letters(lambda v: True)
    third = {
        1: f"(?:{mod[1]}{_GAP}{some}|{mod[0]}{_GAP}{_letters(lambda v: v >= 32)})", 0: f"{mod[2]}{_GAP}{some}",
        2: f"{mod[3]}{_GAP}{_letters(lambda v: v < 32)}", 3: f"{mod[3]}{_GAP}{_letters(lambda v: 32 <= v < 48)}", 4: f"{mod[3]}{_GAP}{_letters(lambda v: v >= 48)}",
    }
    ways = []
    for kinds in product(range(5), repeat=3):  # 0: a byte that goes on, 1: ASCII, else the first of so many bytes
        missing = before
        for kind in kinds:
            if (kind == 0) != (missing > 0):
                break
            missing = missing - 1 if kind == 0 else lead.get(kind, 0)
        else:
            if missing == after:
                ways.append(_GAP.join((first[kinds[0]], second[kinds[1]], third[kinds[2]])))
    return f"(?:{'|'.join(ways)})" if ways else None


def _base64_start(before: int, groups: int, closed: bool) -> str:
    """The first groups of readable code; ``closed`` if no byte may be missing after them."""
    if groups == 0:
        return ""
    ways = []
    for after in range(4):
        group = _base64_group(before, after)
        if group and not (closed and groups == 1 and after):
            rest = _base64_start(after, groups - 1, closed)
            ways.append(group + (_GAP + rest if rest else ""))
    return f"(?:{'|'.join(ways)})" if ways else r"[^\x00-\x{10FFFF}]"


def base64_run_pattern() -> str:
    """Pattern of texts that may hold a readable base64 run: padding, or whole groups of code that start as printable text does.

    Code is read four letters by four. Runs of fewer groups than are looked at have to end after them.
    """
    begin = rf"(?:^|[^A-Za-z0-9+/ \t\r\n]){_GAP}"
    end = rf"{_GAP}(?:$|[^-A-Za-z0-9+/_. \t\r\n])"
    short = [_base64_start(0, groups, True) + end for groups in range(1, _GROUPS)]
    return rf"[-A-Za-z0-9+/_. \t\r\n]=|{begin}(?:{'|'.join([_base64_start(0, _GROUPS, False), *short])})"


def stage_pattern() -> str:
    """Pattern of texts that a normalization stage other than the squeezing of doubled letters may change, now or after that squeezing.

    Squeezing takes characters out of runs of the same one only, so what it can bring about stands in the text with each character repeated.
    """
    letters = "|".join(f"{letter}+" for letter in _CODE[:52])
    marks = "".join(fv.LEET_SINGLES) + "\\&%|"
    pairs = [re.escape(pair) for pair in fv.LEET_PAIRS if pair.isalpha()]
    words = "|".join("".join(f"{letter}+" for letter in word) for word in fv.SQUEEZE_WORDS)
    spaced = rf"(?:^|[^A-Za-z0-9_])(?:(?:{letters})[\t-\r .*|_-]+){{5}}[A-Za-z]"
    return "|".join([r"[^\x00-\x7F]", f"[{re.escape(marks)}]", *pairs, f"(?i:{words})", spaced])


#: Texts with a token of 16 characters or more, whatever counts as white space beyond ASCII.
LONG_TOKEN = r"[^\t-\r ]{16}"
