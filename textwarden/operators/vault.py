"""Reversible masking: personal data becomes numbered placeholders, and a vault has what they stand for.

Within a conversation equal values share a placeholder, numbered by first occurrence. A text that already holds something
like a placeholder has that vaulted as well, so putting the values back gives every text as it was. Values that show only in the
matching form of a text (hidden by invisible characters, spelled digits and so on) can't be cut out of it: such a text is vaulted whole.

The vault is secret: write it apart from the masked texts, and drop it when the conversation is over. So is the shared folder, which
keeps the values between the steps of masking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden import fixed_values as fv
from textwarden.functions.regex import any_of, replace_matches, unicode_words
from textwarden.operators.barrier import pin
from textwarden.operators.pii import with_matching_form
from textwarden.operators.sequence import with_preceding
from textwarden.session import written

LITERAL, WHOLE = "LITERAL", "TEXT"
KINDS = (LITERAL, *[label for label, *_ in fv.PII_RULES], WHOLE)
PLACEHOLDER = rf"<(?:{'|'.join(KINDS)})_[0-9]+>"
# One reserved character marks a value of each kind until its number is known; texts that hold such a character have it vaulted.
_MARKS = {kind: chr(0xFDD1 + place) for place, kind in enumerate(KINDS)}
_RULES = ((LITERAL, rf"{PLACEHOLDER}|[\x{{fdd0}}-\x{{fdef}}]"), *[(label, unicode_words(pattern)) for label, pattern, _ in fv.PII_RULES])
_PLACE_BITS, _BLOCK_TURNS = 31, 4096


def with_marks(df: DataFrame, text: str) -> DataFrame:
    """Add ``_marked`` (text with one mark per value) and ``_values`` (kind, place among its kind, original)."""
    kept = df.columns
    df = df.withColumn("_marked", F.coalesce(F.col(text), F.lit("")))
    for number, (kind, pattern) in enumerate(_RULES):
        current = F.col("_marked")
        df = df.withColumns(
            {f"_v{number}": F.regexp_extract_all(current, F.lit(pattern), F.lit(0)), "_marked": F.regexp_replace(current, pattern, _MARKS[kind])}
        )
    df = with_matching_form(df, "_marked", "_form")
    hidden = any_of([F.col("_form").rlike(pattern) for _, pattern in _RULES[1:]])

    def listed(kind: str, originals: Column) -> Column:
        return F.transform(originals, lambda value, place: F.struct(F.lit(kind).alias("kind"), place.alias("place"), value.alias("original")))

    found = F.concat(*[listed(kind, F.col(f"_v{number}")) for number, (kind, _) in enumerate(_RULES)])
    whole = listed(WHOLE, F.array(F.col(text)))
    return pin(df, {
        "_values": F.when(hidden, whole).otherwise(found), "_marked": F.when(hidden, _MARKS[WHOLE]).otherwise(F.col("_marked")),
    }).select(*kept, "_marked", "_values")


def _numbered(marked: DataFrame, conversation: str, turn: str) -> DataFrame:
    """(conversation, kind, n, original): each different value, numbered by first occurrence without one task per conversation."""
    values = marked.select(F.col(conversation).alias("_conv"), F.col(turn).cast("long").alias("_turn"), F.inline("_values"))
    firsts = values.groupBy("_conv", "kind", "original").agg(F.min(F.struct("_turn", "place")).alias("_first")).select(
        F.struct("_conv", "kind").alias("_sequence"), "original",
        (F.shiftleft(F.col("_first._turn"), _PLACE_BITS) + F.col("_first.place")).alias("_order"),
    )
    ranked = with_preceding(firsts, "_sequence", "_order", F.lit(True), F.lit(None).cast("string"), _BLOCK_TURNS << _PLACE_BITS)
    return ranked.select(F.col("_sequence._conv").alias(conversation), F.col("_sequence.kind").alias("kind"), (F.col("n_before") + 1).alias("n"), "original")


def placeholder(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("<"), kind, F.lit("_"), n.cast("string"), F.lit(">"))


def fill_marks(marked: Column, names: Column) -> Column:
    """Marks replaced by placeholders; ``names`` is an array of (kind, place, n) in that order."""
    filled = marked
    for kind, mark in _MARKS.items():
        own = F.transform(F.filter(names, lambda name: name["kind"] == kind), lambda name: placeholder(name["kind"], name["n"]))  # noqa: B023
        parts = F.zip_with(F.split(filled, mark, -1), own, lambda part, name: F.concat(part, F.coalesce(name, F.lit(""))))
        filled = F.when(F.contains(filled, F.lit(mark)), F.array_join(parts, "")).otherwise(filled)
    return filled


def mask_reversibly(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns with ``masked`` in place of the text; vault of conversation, kind, n, original).

    Turns are numbered 0 to 2**32 - 1, each number once in a conversation. A null text is masked as an empty one. Turns without a
    conversation have no vault: their values are cut out for good, a reserved character in their place.

    The marked turns and the vault are read several times, so both are kept in the shared folder, which is as secret as the vault itself.
    """
    marked = written(with_marks(turns, text).drop(text), "vault-marked")
    vault = written(_numbered(marked, conversation, turn), "vault-entries")
    values = marked.select(conversation, turn, F.inline("_values"))
    named = values.join(vault, [conversation, "kind", "original"]).groupBy(conversation, turn).agg(
        F.array_sort(F.collect_list(F.struct("kind", "place", "n"))).alias("_names")
    )
    open_turns = marked.join(named, [conversation, turn], "left")
    masked = F.when(F.col("_names").isNull(), F.col("_marked")).otherwise(fill_marks(F.col("_marked"), F.col("_names")))
    return open_turns.withColumn("masked", masked).drop("_marked", "_values", "_names"), vault


def unmask(texts: DataFrame, vault: DataFrame, conversation: str, key: list[str], text: str, out: str = "unmasked") -> DataFrame:
    """Add ``out``: the text with all placeholders of its conversation's vault put back; others stay as they are.

    ``key`` (with the conversation) names a row. Only placeholders that occur are joined, so a row gets no more of the vault than it
    needs. What is put back is not searched again.
    """
    row = [conversation, *key]
    asked = texts.select(*row, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(PLACEHOLDER), F.lit(0)))).alias("_name"))
    entries = vault.select(conversation, placeholder(F.col("kind"), F.col("n")).alias("_name"), "original")
    known = asked.join(entries, [conversation, "_name"]).groupBy(*row).agg(
        F.map_from_entries(F.collect_list(F.struct("_name", "original"))).alias("_known")
    )
    restored = replace_matches(F.col(text), PLACEHOLDER, lambda name: F.coalesce(F.try_element_at(F.col("_known"), name), name))
    joined = texts.join(known, row, "left")
    return joined.withColumn(out, F.when(F.col("_known").isNull(), F.col(text)).otherwise(restored)).drop("_known")
