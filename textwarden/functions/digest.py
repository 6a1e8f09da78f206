"""Hashes of audit records and checkpoints, and their timestamps as nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labelled fields of a record payload, in hash order.
PAYLOAD_FIELDS = (
    ("prev", "prev_record_hash"), ("ts", "ts_ns"), ("trace", "trace_id"), ("client", "client_id"),
    ("ip", "client_ip"), ("route", "route"), ("act", "action"), ("threat", "threat_category"),
    ("sev", "severity"), ("conf", "confidence"), ("reason", "reason"), ("rule", "matched_rule"),
)


def _field(label: str, column: Column) -> Column:
    return F.concat(F.lit(f"{label}:"), F.coalesce(column.cast("string"), F.lit("")))


def payload_tail(row: dict[str, Column]) -> Column:
    """Hash payload of a record without its leading previous-hash field."""
    fields = []
    for label, name in PAYLOAD_FIELDS[1:]:
        column = row[name]
        if name == "confidence":
            column = F.format_string("%.4f", F.coalesce(column, F.lit(0.0)))
        fields.append(_field(label, column))
    version = F.coalesce(row["checkpoint_version"], F.lit(0))
    suffix = F.when(version > 0, F.concat(F.lit("|checkpoint_version:"), version.cast("string"))).otherwise("")
    return F.concat(F.concat_ws("|", *fields), suffix)


def record_hash(row: dict[str, Column]) -> Column:
    """SHA-256 of the record payload, previous hash included."""
    return F.sha2(F.concat(_field("prev", row["prev_record_hash"]), F.lit("|"), payload_tail(row)), 256)


def checkpoint_hash(record_count: Column, tip_hash: Column) -> Column:
    return F.sha2(
        F.concat(F.lit("checkpoint:v1|count:"), record_count.cast("string"), F.lit("|tip:"), tip_hash), 256
    )


def rfc3339_nanos(text: Column) -> Column:
    """RFC 3339 text to nanoseconds since the epoch, without passing through microsecond timestamps."""
    seconds = F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d)", 1)
    fraction = F.rpad(F.regexp_extract(text, r":\d\d\.(\d{1,9})", 1), 9, "0")
    sign = F.when(F.regexp_extract(text, r"([+-])\d\d:\d\d$", 1) == "-", -1).otherwise(1)
    hours = F.regexp_extract(text, r"[+-](\d\d):\d\d$", 1)
    minutes = F.regexp_extract(text, r"[+-]\d\d:(\d\d)$", 1)
    offset = F.when(hours == "", 0).otherwise(
        sign * (F.try_to_number(hours, F.lit("99")).cast("bigint") * 3600
                + F.try_to_number(minutes, F.lit("99")).cast("bigint") * 60)
    )
    stamp = F.to_timestamp_ntz(F.replace(F.upper(seconds), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(
        seconds != "", epoch_micros(stamp) * 1000 - offset * 1_000_000_000 + fraction.cast("bigint")
    )


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, from its fields; the session zone plays no part."""
    stamp = ts.cast("timestamp_ntz")
    micros = (F.extract(F.lit("SECOND"), stamp) * 1_000_000).cast("bigint")
    minutes = F.unix_date(stamp.cast("date")).cast("bigint") * 1440 + F.hour(stamp) * 60 + F.minute(stamp)
    return minutes * 60_000_000 + micros


def nanos_rfc3339(nanos: Column) -> Column:
    """Nanoseconds to RFC 3339 in UTC, trailing zeros of the fraction trimmed."""
    seconds = F.call_function("div", nanos - F.pmod(nanos, F.lit(1_000_000_000)), F.lit(1_000_000_000))
    stamp = F.timestamp_add("SECOND", seconds, F.lit("1970-01-01").cast("timestamp_ntz"))
    digits = F.rtrim(F.lpad(F.pmod(nanos, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("0"))
    fraction = F.when(digits == "", "").otherwise(F.concat(F.lit("."), digits))
    return F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))
