"""Personal data and secrets: masking, counts per type, inventories and per-turn masking of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden import fixed_values as fv
from textwarden.functions import text as tx
from textwarden.operators.barrier import pin
from textwarden.functions.regex import let, replace_matches, series_udf, unicode_words

import unicodedata

import pandas as pd
from pyspark.sql import types as T

_WORDS = "|".join((*fv.DIGIT_WORDS, *fv.LEET_DIGIT_WORDS))
_WORD_RUN = unicode_words(rf"(?i)\b(?:{_WORDS})\b(?:[\s-]++(?:{_WORDS})\b){{5,}}+")
_PLAIN_WORDS = "|".join(fv.DIGIT_WORDS)
_SDK_WORD_RUN = unicode_words(rf"(?i)(?<!\w)(?:{_PLAIN_WORDS})(?:[\s-]++(?:{_PLAIN_WORDS})(?!\w)){{6,}}+")
_CHINESE_RUN = unicode_words(rf"(?:[{fv.CHINESE_DIGITS}]\s*+){{6,}}+")
_THAI_WORDS = "|".join(fv.THAI_DIGIT_WORDS)
_THAI_RUN = unicode_words(rf"(?:{_THAI_WORDS}|\s){{6,}}+")
_SPLIT_KEY = unicode_words(r"\bsk-(?:[A-Za-z0-9_-]\s*+){10,64}")
# Characters that compatibility composition leaves alone whatever surrounds them.
_MAY_COMPOSE = r"[^\x00-\x7FÀ-ı]"
_LITERALS = {
    "API_KEY": r"sk-|ghp_|AKIA", "EMAIL": "@", "THAI_ID": r"(?U)\d", "CREDIT_CARD": r"(?U)\d", "PHONE": r"(?U)\d",
    "THAI_NATIONAL_ID": r"(?U)\d", "PHONE_NUMBER": r"(?U)\d",
}
RULES = {"gateway": fv.PII_RULES, "sdk": fv.SDK_PII_RULES}


@series_udf(T.StringType())
def _compatibility_form(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: unicodedata.normalize("NFKC", text), na_action="ignore")


def _digits_of_words(run: Column) -> Column:
    table = fv.LEET_DIGIT_WORDS | fv.DIGIT_WORDS
    digits = F.create_map(*[F.lit(item) for pair in table.items() for item in pair])
    words = F.regexp_extract_all(run, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda word: F.coalesce(F.try_element_at(digits, F.lower(word)), word)), "")


def _digits_of_thai(run: Column) -> Column:
    digits = F.create_map(*[F.lit(x) for n, word in enumerate(fv.THAI_DIGIT_WORDS) for x in (word, str(n))])
    words = F.regexp_extract_all(run, F.lit(_THAI_WORDS), F.lit(0))
    return F.array_join(F.transform(words, lambda word: F.try_element_at(digits, word)), "")


def _digits_of_chinese(run: Column) -> Column:
    return F.translate(F.regexp_replace(run, r"(?U)\s", ""), fv.CHINESE_DIGITS, "0123456789")


def with_matching_form(df: DataFrame, text: str, out: str, profile: str = "gateway") -> DataFrame:
    """Add the form of a text in which values are searched: plain digits, no invisible characters, keys rejoined."""
    source = F.col(text)
    beyond_ascii = F.octet_length(source) != F.length(source)
    plain_digits = F.translate(source, fv.ROMAN_NUMERALS, fv.ROMAN_DIGITS)
    visible = (
        tx.strip_zero_width(plain_digits) if profile == "sdk"
        else F.regexp_replace(plain_digits, f"[{fv.PII_INVISIBLES}]", "")
    )
    df = df.withColumn(out, F.when(beyond_ascii, visible).otherwise(source))
    # Only texts with characters that can change travel to the Arrow UDF; others send NULL.
    composed = _compatibility_form(F.when(F.col(out).rlike(_MAY_COMPOSE), F.col(out)))
    df = df.withColumn(out, F.coalesce(composed, F.col(out)))
    steps = [(_SDK_WORD_RUN if profile == "sdk" else _WORD_RUN, _digits_of_words)]
    if profile == "gateway":
        steps += [(_CHINESE_RUN, _digits_of_chinese), (_THAI_RUN, _digits_of_thai)]
    steps.append((_SPLIT_KEY, lambda key: F.regexp_replace(key, r"(?U)\s+", "")))
    form = F.col(out)
    for pattern, rewrite in steps:
        form = let(form, lambda current: replace_matches(current, pattern, rewrite))
    return df.withColumn(out, form)


def mask_pii(
    df: DataFrame, text: str, out: str = "pii", profile: str = "gateway", counts: bool = False
) -> DataFrame:
    """Add struct(sanitized_text, has_pii, entities); with ``counts`` also one ``n_<type>`` column per type.

    Types are masked in order, each in the text that the earlier ones left, and counted on that text.
    """
    kept = df.columns
    df = with_matching_form(df, text, "_form", profile)
    rules = RULES[profile]
    for number, (label, pattern, placeholder) in enumerate(rules):
        current, java = F.col("_form"), unicode_words(pattern)
        hits = F.when(current.rlike(_LITERALS[label]), F.regexp_count(current, F.lit(java))).otherwise(0)
        df = df.withColumn(f"_n{number}", hits)
        df = df.withColumn(
            "_form", F.when(F.col(f"_n{number}") > 0, F.regexp_replace(current, java, F.lit(placeholder))).otherwise(current)
        )
    entities = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"_n{n}") > 0, F.struct(F.lit(label).alias("type"), F.col(f"_n{n}").cast("bigint").alias("count")))
                for n, (label, _, _) in enumerate(rules)
            ]
        )
    )
    masked = F.struct(
        F.coalesce(F.col("_form"), F.lit("")).alias("sanitized_text"),
        (F.size(entities) > 0).alias("has_pii"),
        entities.alias("entities"),
    )
    numbered = {
        f"n_{label.lower()}": F.coalesce(F.col(f"_n{n}"), F.lit(0)).cast("bigint") for n, (label, _, _) in enumerate(rules)
    } if counts else {}
    return pin(df, {out: masked} | numbered).select(*kept, out, *numbered)


def entity_rollup(df: DataFrame, text: str, *by: str, profile: str = "gateway") -> DataFrame:
    """Texts and hits per entity type, optionally by further columns; counts combine map-side."""
    masked = mask_pii(df, text, out="_pii", profile=profile)
    found = masked.select(*by, F.explode("_pii.entities").alias("_entity"))
    return (
        found.groupBy(*by, F.col("_entity.type").alias("entity"))
        .agg(F.count("*").alias("texts"), F.sum("_entity.count").alias("hits"))
    )


def inventory(df: DataFrame, id_col: str, text: str, profile: str = "gateway") -> DataFrame:
    """Types found per text, in masking order, for texts that have any."""
    masked = mask_pii(df.select(id_col, text), text, out="_pii", profile=profile).where("_pii.has_pii")
    return masked.select(
        id_col, F.array_join(F.transform("_pii.entities", lambda entity: entity["type"]), ",").alias("types")
    )


def mask_turns(conversations: DataFrame, text: str = "text", profile: str = "gateway") -> DataFrame:
    """Mask every turn on its own, keeping the turn structure; action says whether the text changed."""
    masked = mask_pii(conversations, text, out="_pii", profile=profile)
    sanitized = F.col("_pii.sanitized_text")
    return masked.withColumns(
        {"masked": sanitized, "action": F.when(sanitized != F.col(text), "MASKED").otherwise("ALLOWED")}
    ).drop("_pii", text)
