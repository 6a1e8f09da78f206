"""Chat requests: prompts out of bodies and turns, and sanitized text back into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden import fixed_values as fv


def _string_of(value: Column) -> Column:
    """The string a JSON value is; NULL for values of any other type."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _messages(body: Column) -> Column:
    fields = F.from_json(body, "map<string,variant>")
    return F.try_variant_get(F.try_element_at(fields, F.lit("messages")), "$", "array<variant>")


def extract_prompt(body: Column) -> Column:
    """Prompt text of a chat body: all string message contents, else all flat keys, else the body itself."""
    contents = F.array_compact(
        F.transform(
            F.coalesce(_messages(body), F.array().cast("array<variant>")),
            lambda message: _string_of(F.try_variant_get(message, "$.content", "variant")),
        )
    )
    fields = F.from_json(body, "map<string,variant>")
    flat = F.filter(
        F.array(*[_string_of(F.try_element_at(fields, F.lit(key))) for key in fv.FLAT_PROMPT_KEYS]),
        lambda part: part.isNotNull() & (part != ""),
    )
    return (
        F.when(F.size(contents) > 0, F.array_join(contents, fv.TURN_SEPARATOR))
        .when(F.size(flat) > 0, F.array_join(flat, fv.TURN_SEPARATOR))
        .otherwise(F.coalesce(body, F.lit("")))
    )


def replace_prompt(body: Column, sanitized: Column) -> Column:
    """Body with the sanitized text put back into every message it came from.

    When the text no longer splits into as many parts as there were contents, the last message takes all of it and
    the others become empty. Bodies without messages take the parts under the flat keys that they came from, in the same way
    (the first of them takes a text in other parts, the others become empty); bodies without either become the text.
    """
    fields = F.from_json(body, "map<string,variant>")
    messages = _messages(body)
    is_content = F.transform(
        messages, lambda message: _string_of(F.try_variant_get(message, "$.content", "variant")).isNotNull()
    )
    total = F.size(F.filter(is_content, lambda flag: flag))
    parts = F.split(sanitized, fv.TURN_SEPARATOR, -1)
    kept_apart = F.size(parts) == total

    def rewritten(message: Column, place: Column) -> Column:
        before = F.size(F.filter(F.slice(is_content, F.lit(1), place), lambda flag: flag))
        text = F.when(kept_apart, F.get(parts, before)).when(before == total - 1, sanitized).otherwise("")
        members = F.try_variant_get(message, "$", "map<string,variant>")
        updated = F.map_concat(
            F.map_filter(members, lambda name, _: name != "content"),
            F.create_map(F.lit("content"), F.to_variant_object(F.array(text))),
        )
        changed = F.transform_values(
            updated,
            lambda name, value: F.when(name == "content", F.try_variant_get(value, "$[0]", "variant")).otherwise(value),
        )
        return F.when(F.get(is_content, place), F.to_variant_object(changed)).otherwise(message)

    def sorted_json(members: Column) -> Column:
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(members), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))))

    def with_member(name: Column, value: Column) -> Column:
        others = F.map_filter(fields, lambda key, _: key != name)
        return sorted_json(F.map_concat(others, F.map_from_arrays(F.array(name), F.array(value))))

    new_messages = F.to_variant_object(F.transform(messages, rewritten))
    said = F.filter(
        F.array(*[F.lit(key) for key in fv.FLAT_PROMPT_KEYS]),
        lambda key: F.coalesce(_string_of(F.try_element_at(fields, key)) != "", F.lit(False)),
    )
    apart = F.size(parts) == F.size(said)
    new_texts = F.transform(said, lambda key, place: F.when(apart, F.get(parts, place)).when(place == 0, sanitized).otherwise(""))
    new_values = F.transform(new_texts, lambda text: F.try_variant_get(F.to_variant_object(F.array(text)), "$[0]", "variant"))
    unsaid = F.map_filter(fields, lambda key, _: ~F.array_contains(said, key))
    flat = F.map_concat(unsaid, F.map_from_arrays(said, new_values))
    return (
        F.when(total > 0, with_member(F.lit("messages"), new_messages))
        .when(F.size(said) > 0, sorted_json(flat))
        .otherwise(sanitized)
    )


def _joined(turns: DataFrame, conversation: str, turn: str, text: str, out: str) -> DataFrame:
    return turns.groupBy(conversation).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(turn, text))), lambda entry: entry[text]), fv.TURN_SEPARATOR
        ).alias(out),
        F.count("*").alias("n_turns"),
    )


def assemble(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text",
    max_bytes: int | None = None, out: str = "prompt",
) -> DataFrame:
    """One row per conversation: its turns in order, joined by the turn separator, whatever its size.

    With ``max_bytes`` the prompt of a larger conversation is NULL, which is the payload-too-large case. Sizes are then
    added up first (with map-side sums), and its turns are dropped before turns are collected.
    """
    if max_bytes is None:
        return _joined(turns, conversation, turn, text, out)
    separator_bytes = len(fv.TURN_SEPARATOR.encode())
    sizes = turns.groupBy(conversation).agg(
        F.count("*").alias("n_turns"),
        (F.sum(F.octet_length(text)) + F.lit(separator_bytes) * (F.count("*") - 1)).alias("n_bytes"),
    )
    oversize = sizes.where(F.col("n_bytes") > max_bytes)
    fitting = turns.select(conversation, turn, text).join(oversize.select(conversation), conversation, "left_anti")
    joined = _joined(fitting, conversation, turn, text, out)
    too_large = oversize.select(conversation, F.lit(None).cast("string").alias(out), "n_turns")
    return joined.unionByName(too_large)
