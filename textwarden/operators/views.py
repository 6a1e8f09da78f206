"""Alternate readings of a text: what obfuscated or encoded text says once it is undone.

The readings of one text stay in one array column, so the job is a pure projection: no shuffle, no explode and no
key are needed, and a row costs only what its own text triggers.

1. The normalization stages run cumulatively until nothing changes; in the first passes every change is one reading,
   and what further passes come to is one more, so that hostile nesting cannot multiply a text.
2. ROT13 of the text and of its normalized form.
3. Texts hidden in base64 or hex, each also normalized and rotated, layer by layer until no layer holds another.

Readings are ordered depth first and equal texts count once. All are kept unless a ``limit`` is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden import fixed_values as fv
from textwarden.functions import presence
from textwarden.functions import text as tx
from textwarden.functions.regex import let
from textwarden.operators.barrier import pin

_STAGES = dict(
    zip(
        fv.STAGE_LABELS,
        (
            tx.decode_unicode_escapes,
            tx.decode_entities,
            tx.decode_percent,
            tx.unicode_skeleton,
            tx.strip_zero_width,
            tx.collapse_spaced_letters,
            tx.deleet,
            tx.squeeze_keywords,
            tx.squeeze_doubles,
        ),
    )
)
_SDK_STAGES = {label: _STAGES[label] for label in fv.STAGE_LABELS[:6]} | {fv.STAGE_LABELS[6]: tx.leet_singles}
PROFILES = {"gateway": _STAGES, "sdk": _SDK_STAGES}
_PASSES = 3
# A layer shortens a text to three quarters at most, so a text of the longest possible string ends before this.
_LAYERS = 80
_READING = "array<struct<label:string,text:string>>"
_STATE = f"struct<current:string,trail:string,readings:{_READING},settled:boolean>"
_SOURCE = "array<struct<key:string,path:string,text:string,may_hold:int>>"
_HIDDEN = "array<struct<key:string,path:string,text:string>>"
# Both kinds of base64 candidates: texts that are decoded themselves are searched for all.
_ANY = 3


def _advance(state: Column, following: Column, label: str) -> Column:
    """State after one stage: when the text changed, its label joins the trail and the text is one more reading."""
    trail = F.concat_ws(" + ", state["trail"], F.lit(label))
    reading = F.struct(trail.alias("label"), following.alias("text"))
    changed = F.struct(
        following.alias("current"),
        trail.alias("trail"),
        F.concat(state["readings"], F.array(reading)).cast(_READING).alias("readings"),
        state["settled"].alias("settled"),
    )
    return F.when(following != state["current"], changed).otherwise(state)


def _apply(state: Column, label: str, stage) -> Column:
    return let(
        state,
        lambda before: let(stage(before["current"]), lambda after: _advance(before, after, label)),
    )


def _normalized(text: Column, stages: dict, may_change: Column) -> Column:
    """Struct of the fully normalized text, the trail of labels and the readings on the way.

    Where ``may_change`` is false (see ``presence.stage_pattern``), squeezing doubled letters once is all that the passes come to. A pass that changes nothing settles the text, and later passes are skipped. Passes after the first few add one
    reading together. Every one undoes some encoding, so a text has fewer of them than characters.
    """

    def one_pass(start: Column, _: Column) -> Column:
        state = start
        for label, stage in stages.items():
            state = _apply(state, label, stage)
        settled = let(
            state,
            lambda end: F.struct(
                end["current"].alias("current"),
                end["trail"].alias("trail"),
                end["readings"].alias("readings"),
                (end["current"] == start["current"]).alias("settled"),
            ),
        )
        return F.when(start["settled"], start).otherwise(settled)

    start = F.struct(
        text.alias("current"),
        F.lit(None).cast("string").alias("trail"),
        F.array().cast(_READING).alias("readings"),
        F.lit(False).alias("settled"),
    )
    first = F.aggregate(F.array(*[F.lit(number) for number in range(_PASSES)]), start.cast(_STATE), one_pass)

    def further(state: Column, _: Column) -> Column:
        following = let(
            _normalize_once(state["current"], stages),
            lambda after: F.struct(after.alias("current"), (after == state["current"]).alias("settled")),
        )
        return F.when(state["settled"], state).otherwise(following)

    def finish(state: Column) -> Column:
        rest = F.aggregate(
            F.sequence(F.lit(0), F.length(state["current"])),
            F.struct(state["current"].alias("current"), state["settled"].alias("settled")),
            further,
        )
        return F.when(state["settled"], state).otherwise(
            let(rest, lambda end: _advance(state, end["current"], fv.FURTHER_PASSES_LABEL))
        )

    squeeze = fv.STAGE_LABELS[-1]
    squeezed = _apply(start.cast(_STATE), squeeze, stages[squeeze]) if squeeze in stages else start.cast(_STATE)
    return F.when(may_change, let(first, finish)).otherwise(squeezed)


def _found_payloads(source: Column) -> Column:
    """Payloads of one source as structs of key, path and text."""

    def found(payloads: Column, label: str, rank: str) -> Column:
        path = F.when(source["path"] == "", F.lit(label)).otherwise(F.concat(source["path"], F.lit(f"->{label}")))
        return F.transform(
            payloads,
            lambda payload, place: F.struct(
                F.concat(source["key"], F.lit(rank), F.lpad(place.cast("string"), 8, "0")).alias("key"),
                path.alias("path"),
                payload.alias("text"),
            ),
        )

    return F.concat(
        found(tx.base64_payloads(source["text"], source["may_hold"]), "base64", "a"),
        found(tx.hex_payloads(source["text"]), "hex", "b"),
    )


def _hidden_readings(texts: Column, may_hold: Column, stages: dict) -> Column:
    """Readings of nested encodings in a text, its normalized form (NULL if equal) and its rotated form, undone layer by layer, in depth-first order."""

    def source(place: int, key: str, path: str) -> Column:
        named = F.struct(F.lit(key).alias("key"), F.lit(path).alias("path"), texts[place].alias("text"), may_hold[place].alias("may_hold"))
        return F.when(texts[place].isNotNull(), named)

    sources = F.array_compact(F.array(source(0, "1", ""), source(1, "2", "normalized"), source(2, "3", "rot13")))
    views = [("0", "-decoded payload", 0), ("1", "-decoded + normalized", 1), ("2", "-decoded + ROT13", 2)]
    below = [("3", "", 0), ("4", "->normalized", 1), ("5", "->rot13", 2)]

    def structs(hit: Column, texts: Column, rows: list[tuple[str, str, int]], *more: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    F.concat(hit["key"], F.lit(slot)).alias("key"),
                    F.concat(hit["path"], F.lit(suffix)).alias("path"),
                    F.get(texts, F.lit(which)).alias("text"),
                    *more,
                )
                for slot, suffix, which in rows
            ]
        )

    def one_layer(state: Column, _: Column) -> Column:
        found = F.flatten(F.transform(state["sources"], _found_payloads))
        # Three texts per payload: as found, normalized, rotated.
        paired = F.transform(
            found,
            lambda hit: F.struct(
                hit.alias("hit"), F.array(hit["text"], _normalize_once(hit["text"], stages), tx.rot13(hit["text"])).alias("texts")
            ),
        )
        return let(
            paired,
            lambda pairs: F.struct(
                _first_of_each_text(
                    F.flatten(F.transform(pairs, lambda pair: structs(pair["hit"], pair["texts"], below, F.lit(_ANY).alias("may_hold"))))
                ).cast(_SOURCE).alias("sources"),
                F.concat(
                    state["readings"],
                    F.flatten(F.transform(pairs, lambda pair: structs(pair["hit"], pair["texts"], views))),
                ).cast(_HIDDEN).alias("readings"),
            ),
        )

    start = F.struct(sources.cast(_SOURCE).alias("sources"), F.array().cast(_HIDDEN).alias("readings"))
    layers = F.aggregate(
        F.sequence(F.lit(1), F.lit(_LAYERS)),
        start,
        lambda state, number: F.when(F.size(state["sources"]) == 0, state).otherwise(one_layer(state, number)),
    )
    return F.transform(
        F.array_sort(layers["readings"]),
        lambda entry: F.struct(entry["path"].alias("label"), entry["text"].alias("text")),
    )


def _first_of_each_text(entries: Column) -> Column:
    """Entries (structs with a text) but those whose text an earlier one has."""
    return let(
        entries,
        lambda rows: let(
            F.transform(rows, lambda row: row["text"]),
            lambda texts: F.filter(rows, lambda row, place: F.array_position(texts, row["text"]) == place + 1),
        ),
    )


def _normalize_once(text: Column, stages: dict) -> Column:
    for stage in stages.values():
        text = let(text, stage)
    return text


def with_views(
    df: DataFrame, text: str, out: str = "views", limit: int | None = None, profile: str = "gateway"
) -> DataFrame:
    """Add an array column of (label, text) readings of ``text``; NULL text gives NULL."""
    stages = PROFILES[profile]
    raw, current = F.col(text), F.col("_state.current")
    df = df.withColumn("_may_change", presence.found_in(F.array(raw), presence.stage_pattern()))
    df = pin(df, {"_state": F.when(raw.isNotNull(), _normalized(raw, stages, F.coalesce(F.col("_may_change")[0] > 0, F.lit(True))))})
    df = pin(df, {"_sources": F.when(raw.isNotNull(), F.array(raw, F.when(current != raw, current), tx.rot13(raw)))})
    df = df.withColumn("_may_hold", presence.found_in(F.col("_sources"), presence.base64_run_pattern(), presence.LONG_TOKEN))
    rotations = F.array_compact(
        F.array(
            F.struct(F.lit(fv.ROT13_LABEL).alias("label"), F.col("_sources")[2].alias("text")),
            F.when(
                current != raw,
                F.struct(F.lit(fv.ROT13_NORMALIZED_LABEL).alias("label"), tx.rot13(current).alias("text")),
            ),
        )
    )
    every = F.concat(F.col("_state.readings"), rotations, _hidden_readings(F.col("_sources"), F.col("_may_hold"), stages)).cast(_READING)
    first_readings = _first_of_each_text(
        F.filter(every, lambda reading: (reading["text"] != "") & (reading["text"] != raw))
    )
    if limit is not None:
        first_readings = F.slice(first_readings, 1, limit)
    return pin(df, {out: F.when(raw.isNotNull(), first_readings)}).drop("_state", "_sources", "_may_change", "_may_hold")


def deobfuscate(df: DataFrame, id_col: str, text: str, limit: int | None = None) -> DataFrame:
    """One row per reading: id, view number from 1, label, text."""
    viewed = with_views(df.select(id_col, text), text, "_views", limit)
    return viewed.select(id_col, F.posexplode("_views").alias("_place", "_view")).select(
        id_col, (F.col("_place") + 1).alias("view_no"), F.col("_view.label"), F.col("_view.text")
    )
