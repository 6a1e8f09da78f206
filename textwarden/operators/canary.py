"""Canary leaks: which secret, if any, a model response discloses, and how.

The tokens of a response are an array column (from the route it belongs to, or one literal list), so a response is
compared with its own few tokens inside its row and no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden import fixed_values as fv
from textwarden.functions import text as tx
from textwarden.functions.regex import let, unicode_words
from textwarden.operators.barrier import pin
from textwarden.operators.views import with_views

_SEPARATORS = unicode_words(fv.CANARY_SEPARATORS)
_DECIMAL_CODES = r"(?U)(?:\b\d{2,3}\b[ ,]++(?=\d)){5,}+\d{2,3}\b"


def bare(text: Column) -> Column:
    """Text without the separators one may put between letters."""
    return F.regexp_replace(text, _SEPARATORS, "")


def canonical(text: Column) -> Column:
    return F.lower(tx.deleet(bare(text)))


def every_other(text: Column, offset: int) -> Column:
    """Every second character from the first (offset 0) or the second (offset 1) on."""
    return F.regexp_replace(text, r"(?s)(.).?" if offset == 0 else r"(?s).(.?)", "$1")


def _decimal_texts(text: Column) -> Column:
    """Texts written as six or more decimal character codes between blanks."""
    runs = F.regexp_extract_all(text, F.lit(_DECIMAL_CODES), F.lit(0))
    numbers = F.transform(
        F.filter(runs, lambda run: ~F.contains(run, F.lit(","))),
        lambda run: F.transform(F.split(run, " +"), lambda code: code.cast("int")),
    )
    return F.transform(
        F.filter(numbers, lambda codes: F.forall(codes, lambda code: code.between(32, 126))),
        lambda codes: F.array_join(F.transform(codes, lambda code: F.chr(code)), ""),
    )


def _strict_base64(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(fv.CANARY_BASE64_RUN), F.lit(0))
    whole = F.filter(runs, lambda run: F.length(run) % 4 == 0)
    return F.transform(
        whole,
        lambda run: F.translate(
            F.make_valid_utf8(F.try_to_binary(run, F.lit("base64")).cast("string")), "�", ""
        ),
    )


def _hex_texts(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(fv.CANARY_HEX_RUN), F.lit(0))
    return F.transform(runs, lambda run: F.translate(F.make_valid_utf8(F.unhex(run).cast("string")), "�", ""))


def _encoded_forms(text: Column, views: Column | None, profile: str) -> Column:
    """Other readings of a response that may hold a secret; ``views`` are its de-obfuscated readings."""
    visible = tx.strip_zero_width(text)
    parts = [F.array(visible, tx.decode_percent(visible), bare(visible))]
    if views is not None:
        parts.append(F.transform(views, lambda reading: reading["text"]))
    parts += [F.array(tx.rot13(text)), _strict_base64(text), _hex_texts(text)]
    if profile == "gateway":
        parts += [
            F.array(tx.decode_entities(text)), _decimal_texts(text),
            F.array(tx.squeeze_doubles(text), every_other(text, 0), every_other(text, 1)),
        ]
    return F.array_distinct(F.array_compact(F.concat(*parts)))


def find_leaks(
    responses: DataFrame,
    text: str,
    tokens: str | Sequence[str],
    out: str = "canary",
    deep: bool = True,
    profile: str = "gateway",
    strict_reference: bool = True,
) -> DataFrame:
    """Add struct(detected, threat_type, reason, leaked_token, kind) for the first leaked token, in list order.

    ``tokens`` names an array column or is a list. ``deep=False`` compares the response as written and in its simple
    forms, but leaves out the de-obfuscated readings. With ``strict_reference=False`` thinned-out tokens count only
    from 12 characters on.
    """
    kept = responses.columns
    listed = F.col(tokens) if isinstance(tokens, str) else F.array(*[F.lit(token) for token in tokens]).cast("array<string>")
    df = responses.withColumn("_tokens", F.filter(listed, lambda token: token.isNotNull() & (token != "")))
    has_tokens = F.coalesce(F.size("_tokens") > 0, F.lit(False)) & F.coalesce(F.col(text) != "", F.lit(False))
    df = df.withColumn("_response", F.when(has_tokens, F.col(text)))
    response = F.col("_response")
    minimum = 1 if strict_reference else fv.MIN_PARTIAL_TOKEN
    cut = fv.MIN_PARTIAL_TOKEN

    def direct_kind(token: Column) -> Column:
        def shown(part: Column) -> Column:
            return (part != "") & F.contains(response, part)

        kinds = F.when(F.contains(response, token), fv.CANARY_KINDS[0])
        if profile == "sdk":
            return kinds
        evens, odds = every_other(token, 0), every_other(token, 1)
        long_enough = F.length(token) > cut
        return (
            kinds.when(F.contains(response, F.reverse(token)), fv.CANARY_KINDS[1])
            .when(shown(evens) & (F.length(evens) >= minimum), fv.CANARY_KINDS[2])
            .when(shown(odds) & (F.length(odds) >= minimum), fv.CANARY_KINDS[3])
            .when(F.contains(every_other(response, 0), token), fv.CANARY_KINDS[4])
            .when(F.contains(every_other(response, 1), token), fv.CANARY_KINDS[5])
            .when(long_enough & shown(F.substring(token, 1, cut)), fv.CANARY_KINDS[6])
            .when(long_enough & shown(F.right(token, F.lit(cut))), fv.CANARY_KINDS[7])
        )

    df = df.withColumn("_direct", F.transform("_tokens", direct_kind))
    # Encoded forms matter unless the first token already leaks as written.
    df = df.withColumn("_probe", F.when(F.get("_direct", F.lit(0)).isNull(), response))
    if deep:
        df = with_views(df, "_probe", "_views", profile=profile)
    views = F.col("_views") if deep else None
    df = df.withColumn("_forms", _encoded_forms(F.col("_probe"), views, profile))
    df = df.withColumns(
        {"_bare": F.transform("_forms", bare), "_canonical": F.transform("_forms", canonical)}
    )

    def encoded(token: Column) -> Column:
        def in_any(forms: str, needle: Column) -> Column:
            return let(needle, lambda wanted: (wanted != "") & F.exists(forms, lambda form: F.contains(form, wanted)))

        return F.coalesce(
            in_any("_forms", token) | in_any("_bare", bare(token)) | in_any("_canonical", canonical(token)), F.lit(False)
        )

    judged = F.zip_with(
        "_tokens",
        "_direct",
        lambda token, kind: F.struct(
            token.alias("token"), F.coalesce(kind, F.when(encoded(token), fv.CANARY_KINDS[8])).alias("kind")
        ),
    )
    df = pin(df, {"_leak": F.get(F.filter(judged, lambda leak: leak["kind"].isNotNull()), F.lit(0))})
    leak = F.col("_leak")
    lead = "Canary token leaked in model output (" if profile == "gateway" else "Canary secret token detected in LLM response output ("
    found = leak.isNotNull()
    result = F.struct(
        found.alias("detected"),
        F.when(found, "CANARY_LEAK").otherwise("NONE").alias("threat_type"),
        F.when(found, F.concat(F.lit(lead), leak["kind"], F.lit(")"))).otherwise("response clean").alias("reason"),
        leak["token"].alias("leaked_token"),
        leak["kind"].alias("kind"),
    )
    return df.withColumn(out, result).select(*kept, out)


def guard_output(responses: DataFrame, text: str, tokens: str | Sequence[str], **options) -> DataFrame:
    """Replace leaking responses and say why: adds allowed, sanitized_response, threat_type, reason."""
    judged = find_leaks(responses, text, tokens, out="_leak", **options)
    leaked = F.col("_leak.detected")
    return judged.withColumns(
        {
            "allowed": ~leaked,
            "sanitized_response": F.when(leaked, fv.CANARY_REPLACEMENT).otherwise(F.col(text)),
            "threat_type": F.col("_leak.threat_type"),
            "reason": F.col("_leak.reason"),
        }
    ).drop("_leak")


def route_tokens(responses: DataFrame, routes: DataFrame, route_id: str = "route_id") -> DataFrame:
    """Attach to each response the canary tokens of its route, when the route guards its output.

    An equi-join on the route id: Spark broadcasts the routes when their size allows it, and otherwise adaptive
    execution splits the partitions of a busy route.
    """
    guarded = routes.where("guardrails.output_guard").select(
        F.col("id").alias(route_id), F.col("canary_tokens")
    )
    return responses.join(guarded, route_id, "left")
