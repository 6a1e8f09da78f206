"""Request-threat scan over path, query, parameter values, headers and body of logged requests.

Surfaces stay in arrays inside the request row and are scanned in place, so one request needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden import fixed_values as fv
from textwarden.functions import surface as sf
from textwarden.functions import text as tx
from textwarden.operators.barrier import pin
from textwarden.functions.regex import all_of, ascii_words, first_rule, let, matched_text, pick, unicode_words

VERDICT = (
    "struct<blocked:boolean,threat_type:string,severity:string,reason:string,matched_rule:string,"
    "matched_sample:string,surface:string>"
)
CATEGORIES = ("PATH_TRAVERSAL", "CMD_INJECTION", "SQL_INJECTION", "XSS")


@dataclass(frozen=True)
class Family:
    """Rules of one kind with the gate a text must pass before any of them is tried."""

    category: str
    rules: tuple
    gate: tuple[str, ...] = ()
    instead: tuple[str, ...] = ()


TRAVERSAL = Family("PATH_TRAVERSAL", fv.PATH_TRAVERSAL_RULES, fv.PATH_TRAVERSAL_GATE)
COMMAND = Family("CMD_INJECTION", fv.COMMAND_RULES, fv.COMMAND_GATE)
STRICT_COMMAND = Family("CMD_INJECTION", fv.STRICT_COMMAND_RULES, fv.STRICT_COMMAND_GATE)
COMPACT_SQL = Family("SQL_INJECTION", fv.COMPACT_SQL_RULES)
SQL = Family("SQL_INJECTION", fv.SQL_RULES, fv.SQL_GATE, fv.SQL_COMPARISON_GATE)
XSS = Family("XSS", fv.XSS_RULES, fv.XSS_GATE)
FAMILIES = (TRAVERSAL, COMMAND, STRICT_COMMAND, COMPACT_SQL, SQL, XSS)
_CATALOGUE = [(family.category, *rule) for family in FAMILIES for rule in family.rules]
_FIRST_NUMBER = {}
for _family in FAMILIES:
    _FIRST_NUMBER[_family] = sum(len(f.rules) for f in FAMILIES[: FAMILIES.index(_family)])
_JAVA = [ascii_words(rule[4]) for rule in _CATALOGUE]


def _gate(text: Column, family: Family) -> Column:
    passes = all_of([text.rlike(ascii_words(pattern)) for pattern in (*family.gate, "")])
    if family.instead:
        compares = all_of([text.rlike(ascii_words(p)) for p in (*family.gate[:1], *family.instead)])
        passes = passes | compares
    return passes


def rule_number(text: Column, *families: Family) -> Column:
    """Catalogue number of the first matching rule over the families in order; NULL when the text is clean."""
    numbers = []
    for family in families:
        local = first_rule([text.rlike(ascii_words(rule[3])) for rule in family.rules])
        number = local + _FIRST_NUMBER[family]
        numbers.append(F.when(_gate(text, family), number) if family.gate else number)
    return F.coalesce(*numbers)


def _sample(text: Column, number: Column) -> Column:
    found = tx.strip(matched_text(text, _JAVA, number))
    return F.when(F.length(found) > 50, F.concat(F.substring(found, 1, 50), F.lit("..."))).otherwise(found)


def _entries(category: str, marked: bool, *parts: tuple[str, Column]) -> Column:
    """Entries to scan for a category, from (surface, text or array of texts) in order.

    Marked entries also face the strict command rules, or the rules for compact SQL.
    """

    def entry(surface: str, text: Column) -> Column:
        return F.struct(
            F.lit(surface).alias("surface"), text.alias("text"), F.lit(category).alias("category"), F.lit(marked).alias("marked")
        )

    return F.concat(
        *[
            F.transform(texts, lambda text: entry(surface, text)) if surface in _PLURAL else F.array(entry(surface, texts))
            for surface, texts in parts
        ]
    )


_PLURAL = ("value", "header")


def _entry_number(entry: Column) -> Column:
    text, category, marked = entry["text"], entry["category"], entry["marked"]
    return (
        F.when(category == "PATH_TRAVERSAL", rule_number(text, TRAVERSAL))
        .when(
            category == "CMD_INJECTION",
            F.coalesce(rule_number(text, COMMAND), F.when(marked, rule_number(text, STRICT_COMMAND))),
        )
        .when(
            category == "SQL_INJECTION",
            F.coalesce(F.when(marked, rule_number(text, COMPACT_SQL)), rule_number(text, SQL)),
        )
        .otherwise(rule_number(text, XSS))
    )


def _first_hit(entries: Column) -> Column:
    """First entry that a rule matches, as struct(surface, text, number)."""
    scanned = F.transform(
        F.filter(entries, lambda entry: entry["text"].isNotNull()),
        lambda entry: F.struct(
            entry["surface"].alias("surface"), entry["text"].alias("text"), _entry_number(entry).alias("number")
        ),
    )
    return F.get(F.filter(scanned, lambda hit: hit["number"].isNotNull()), F.lit(0))


def scanned_headers(headers: Column) -> Column:
    """Values of the headers that are scanned, in name order."""
    wanted = F.map_filter(headers, lambda name, _: F.lower(name).isin(*fv.SCANNED_HEADERS))
    return F.flatten(F.transform(F.array_sort(F.map_entries(wanted)), lambda entry: entry["value"]))


def scan_requests(
    df: DataFrame,
    path: str | None = "path",
    query: str | None = "query",
    headers: str | None = "headers",
    body: str | None = "body",
    categories: Sequence[str] = CATEGORIES,
    out: str = "verdict",
) -> DataFrame:
    """Add the scan verdict of each request; ``None`` leaves a surface out."""
    kept = df.columns
    nothing = F.lit(None).cast("string")
    df = df.withColumns(
        {
            "_path_raw": F.col(path) if path else nothing,
            "_query_raw": F.col(query) if query else nothing,
            "_body_raw": F.col(body) if body else nothing,
            "_headers_raw": F.coalesce(scanned_headers(F.col(headers)), F.array().cast("array<string>"))
            if headers else F.array().cast("array<string>"),
        }
    )
    values = F.when(sf.pollution_candidate(F.col("_query_raw")), sf.query_values(F.col("_query_raw")))
    df = df.withColumn("_values_raw", F.coalesce(values, F.array().cast("array<string>")))
    # UTF-7 needs the one Arrow UDF, so all surfaces that can hold it pass through it once, as plain columns.
    single = ("_path", "_query", "_body")
    df = df.withColumns({f"{name}_shifted": sf.decode_utf7(F.col(f"{name}_raw")) for name in single})
    df = df.withColumns({f"{name}_shifted": sf.decode_utf7_each(F.col(f"{name}_raw")) for name in ("_headers", "_values")})
    df = df.withColumns({f"{name}_decoded": sf.decode_shifted(F.col(f"{name}_shifted")) for name in single})
    df = df.withColumns(
        {f"{name}_decoded": F.transform(F.col(f"{name}_shifted"), sf.decode_shifted) for name in ("_headers", "_values")}
    )
    df = df.withColumns({name: sf.spaced_view(F.col(f"{name}_decoded")) for name in single})
    spaced_values = F.filter(F.transform(F.col("_values_decoded"), sf.spaced_view), lambda value: value != "")
    df = df.withColumns(
        {
            "_headers": F.transform(F.col("_headers_decoded"), sf.spaced_view),
            "_values": let(
                spaced_values,
                lambda found: F.when(F.size(found) < 2, found).otherwise(F.concat(found, F.array(F.array_join(found, "")))),
            ),
        }
    )
    compact = {}
    for name in single:
        view = sf.compact_view(F.col(f"{name}_decoded"))
        compact[f"{name}_compact"] = F.when(sf.needs_compact_view(F.col(f"{name}_raw")) & (view != F.col(name)), view)
        compact[f"{name}_unbroken"] = F.when(F.col(name).rlike(r"[\t\r\n]"), sf.collapse_line_breaks(F.col(name)))
    pairs = F.arrays_zip(F.col("_headers_raw").alias("raw"), F.col("_headers_decoded").alias("decoded"))
    compact["_headers_compact"] = F.transform(
        F.filter(pairs, lambda pair: sf.needs_compact_view(pair["raw"])),
        lambda pair: sf.compact_view(pair["decoded"]),
    )
    compact["_headers_unbroken"] = F.transform(
        F.filter(F.col("_headers"), lambda value: value.rlike(r"[\t\r\n]")), sf.collapse_line_breaks
    )
    df = df.withColumns(compact)

    c = F.col
    p, q, b = ("path", c("_path")), ("query", c("_query")), ("body", c("_body"))
    v, h = ("value", c("_values")), ("header", c("_headers"))

    def entries(category: str, *parts, marked: bool = False) -> Column:
        return _entries(category, marked, *parts)

    def compacted(name: str) -> Column:
        return entries("SQL_INJECTION", (name, c(f"_{name}_compact")), marked=True)

    def unbroken(name: str) -> tuple[str, Column]:
        return (name, c(f"_{name}_unbroken"))

    command, sql, xss = CATEGORIES[1:]
    in_order = {
        "PATH_TRAVERSAL": [entries("PATH_TRAVERSAL", p, q, v, b, h)],
        command: [entries(command, p, q, v, h, marked=True), entries(command, b)],
        sql: [
            entries(sql, p), compacted("path"), entries(sql, q), compacted("query"), entries(sql, v, b), compacted("body"),
            entries(sql, h), entries(sql, ("header", c("_headers_compact")), marked=True),
        ],
        xss: [
            entries(
                xss, p, unbroken("path"), q, unbroken("query"), v, b, unbroken("body"), h,
                ("header", c("_headers_unbroken")),
            )
        ],
    }
    chosen = [part for category in CATEGORIES if category in categories for part in in_order[category]]
    df = pin(df, {"_hit": _first_hit(F.concat(*chosen))})
    return df.withColumn(out, _verdict(F.col("_hit"))).select(*kept, out)


def _verdict(hit: Column) -> Column:
    number = hit["number"]

    def field(place: int) -> Column:
        return pick([rule[place] for rule in _CATALOGUE], number)

    blocked = F.struct(
        F.lit(True).alias("blocked"), field(0).alias("threat_type"), field(2).alias("severity"),
        field(3).alias("reason"), field(1).alias("matched_rule"), _sample(hit["text"], number).alias("matched_sample"),
        hit["surface"].alias("surface"),
    )
    clean = F.struct(
        F.lit(False).alias("blocked"), F.lit("NONE").alias("threat_type"), F.lit("LOW").alias("severity"),
        F.lit("payload verified clean").alias("reason"), F.lit("").alias("matched_rule"),
        F.lit("").alias("matched_sample"), F.lit("").alias("surface"),
    )
    return F.when(number.isNotNull(), blocked).otherwise(clean).cast(VERDICT)


def scan_early_traversal(df: DataFrame, uri: str, query: str, headers: str | None = None, out: str = "early") -> DataFrame:
    """Verdict on the full request URI before routing, for requests that hold '..' in it; others stay clean."""
    climbs = F.contains(F.coalesce(F.col(uri), F.lit("")), F.lit("..")) | F.contains(F.coalesce(F.col(query), F.lit("")), F.lit(".."))
    kept = df.columns
    df = df.withColumns({"_uri": F.when(climbs, F.col(uri)), "_uri_query": F.when(climbs, F.col(query))})
    df = scan_requests(df, path="_uri", query="_uri_query", headers=headers, body=None, out=out)
    return df.withColumn(out, F.when(climbs, F.col(out)).otherwise(_verdict(F.lit(None).cast("struct<surface:string,text:string,number:int>")))).select(*kept, out)


# --- in-process profile ----------------------------------------------------------------------------------------

_SDK = [
    (threat, rule_id, *rule)
    for threat, rule_id, rules in (
        ("COMMAND_INJECTION", "waf_cmd_1", fv.SDK_COMMAND_RULES), ("PATH_TRAVERSAL", "waf_path_1", fv.SDK_PATH_RULES),
        ("SQL_INJECTION", "waf_sqli_1", fv.SDK_SQL_RULES), ("XSS", "waf_xss_1", fv.SDK_XSS_RULES),
    )
    for rule in rules
]


def scan_texts(df: DataFrame, text: str, out: str = "verdict", profile: str = "sdk") -> DataFrame:
    """Add the verdict of the in-process rules on a plain text column.

    ``profile='sdk'`` reads the text as it is; ``profile='sdk_decoded'`` undoes query escapes, entities and comments first.
    """
    kept = df.columns
    subject = F.col(text)
    if profile == "sdk_decoded":
        subject = sf.unwrap_comments(tx.decode_entities(sf.decode_escapes(subject)))
    df = df.withColumn("_subject", subject)
    number = first_rule([F.col("_subject").rlike(unicode_words(rule[4])) for rule in _SDK])
    df = pin(df, {"_number": number})
    found = F.col("_number").isNotNull()

    def field(place: int, otherwise: str) -> Column:
        return F.when(found, pick([rule[place] for rule in _SDK], F.col("_number"))).otherwise(otherwise)

    result = F.struct(
        found.alias("blocked"), field(0, "").alias("threat_type"), field(2, "").alias("reason"),
        field(1, "").alias("rule_id"), field(3, "").alias("standard_code"),
        F.when(found, 1.0).otherwise(0.0).alias("confidence"),
    )
    return df.withColumn(out, result).select(*kept, out)
