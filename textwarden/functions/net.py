"""Addresses and paths as columns."""

from __future__ import annotations

import ipaddress
import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden.functions.regex import any_of, series_udf

_OCTET = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_MAPPED_PREFIX = "0" * 20 + "ffff"


def clean_path(path: Column) -> Column:
    """Shortest lexical form of a path: no empty or '.' segments, '..' takes its parent with it."""
    segments = F.filter(F.split(path, "/", -1), lambda part: ~part.isin("", "."))
    rooted = F.startswith(path, F.lit("/"))

    def step(done: Column, part: Column) -> Column:
        parent = F.try_element_at(done, F.lit(-1))
        can_drop = parent.isNotNull() & (parent != "..")
        dropped = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        climbed = F.when(can_drop, dropped).when(rooted, done).otherwise(F.concat(done, F.array(part)))
        return F.when(part == "..", climbed).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    cleaned = F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)
    return F.when(path.rlike(r"^$|//|(?:^|/)\.\.?(?:/|$)|./$"), cleaned).otherwise(path)


def cleaned(path: str) -> str:
    """``clean_path`` of one configured path."""
    done: list[str] = []
    rooted = path.startswith("/")
    for part in path.split("/"):
        if part == ".." and done and done[-1] != "..":
            done.pop()
        elif part not in ("", ".") and not (part == ".." and rooted):
            done.append(part)
    return ("/" if rooted else "") + "/".join(done) or "."


def lookup(entries: dict[str, tuple], kind: str, key: Column) -> Column:
    """Entry of a key in a configured table, as a column of type ``kind``: a hash table written into the row's expression.

    A map is searched from its first key on, so keys are dealt over as many maps as there are keys by the CRC-32 of their bytes.
    """
    if not entries:
        return F.lit(None).cast(kind)
    slots: list[list[str]] = [[] for _ in entries]
    for name in entries:
        slots[zlib.crc32(name.encode()) % len(slots)].append(name)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{kind}>"))
    fields = lambda values: F.struct(*[F.lit(value) for value in values]).cast(kind)
    maps = [F.map_from_arrays(F.array(*[F.lit(name) for name in slot]), F.array(*[fields(entries[name]) for name in slot])) if slot else empty for slot in slots]
    return F.try_element_at(F.get(F.array(*maps), F.pmod(F.crc32(key.cast("binary")), F.lit(len(slots))).cast("int")), key)


def parent_prefixes(path: Column) -> Column:
    """The path itself and each ancestor ending at a segment boundary, as an array."""
    parts = F.split(path, "/", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda length: F.array_join(F.slice(parts, F.lit(1), length), "/")
    )


def peer_host(remote: Column) -> Column:
    """Host of a 'host:port' or '[v6]:port' address; anything else is taken as it stands."""
    bracketed = F.regexp_extract(remote, r"^\[([^\]]*)\]:[^:]*$", 1)
    plain = F.regexp_extract(remote, r"^([^:\[\]]*):[^:]*$", 1)
    return F.when(bracketed != "", bracketed).when(plain != "", plain).otherwise(remote)


def ipv4_number(address: Column) -> Column:
    """IPv4 address as BIGINT; NULL when it is not one."""
    parts = F.split(address, r"\.")
    number = sum(
        (F.get(parts, F.lit(place)).cast("bigint") * (256 ** (3 - place)) for place in range(4)), F.lit(0)
    )
    return F.when(address.rlike(_IPV4), number)


def _ipv6_key(text: str) -> str | None:
    try:
        parsed = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return f"{int(parsed):032x}|{parsed.ipv4_mapped or parsed.compressed}"


@series_udf(T.StringType())
def _ipv6_key_udf(addresses: pd.Series) -> pd.Series:
    return addresses.map(_ipv6_key, na_action="ignore")


@series_udf(T.ArrayType(T.StringType()))
def _ipv6_keys_udf(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: [_ipv6_key(text) for text in texts], na_action="ignore")


def _ipv4_key(address: Column) -> Column:
    number = ipv4_number(address)
    return F.concat(F.lit(_MAPPED_PREFIX), F.lpad(F.lower(F.hex(number)), 8, "0"), F.lit("|"), address)


def address_key(address: Column) -> Column:
    """Sortable key 'hex|canonical' of an IPv4 or IPv6 address, NULL for anything else. IPv4 stays in the JVM."""
    return F.coalesce(_ipv4_key(address), _ipv6_key_udf(F.when(F.contains(address, F.lit(":")), address)))


def address_keys(addresses: Column) -> Column:
    """Keys of an array of addresses."""
    has_v6 = F.exists(addresses, lambda address: F.contains(address, F.lit(":")))
    v6 = _ipv6_keys_udf(F.when(has_v6, addresses))
    v4 = F.transform(addresses, _ipv4_key)
    return F.when(v6.isNull(), v4).otherwise(F.zip_with(v4, v6, lambda a, b: F.coalesce(a, b)))


def network_ranges(entries: Sequence[str]) -> list[tuple[str, str]]:
    """Hex bounds of trusted networks; single addresses count as one-host networks, bad entries are skipped."""
    ranges = []
    for entry in entries:
        try:
            network = ipaddress.ip_network(entry.strip(), strict=False)
        except ValueError:
            continue
        offset = 0xFFFF << 32 if network.version == 4 else 0
        low, high = (offset + int(edge) for edge in (network.network_address, network.broadcast_address))
        ranges.append((f"{low:032x}", f"{high:032x}"))
    return ranges


def in_ranges(key: Column, ranges: Sequence[tuple[str, str]]) -> Column:
    if not ranges:
        return F.lit(False)
    digits = F.substring(key, 1, 32)
    return any_of([digits.between(low, high) for low, high in ranges])


def masked_digits(digits: Column, bits: Column) -> Column:
    """Leading ``bits`` bits of 32 hex digits as a text: whole digits, then the value of the bits that are left."""
    whole, left = F.floor(bits / 4).cast("int"), F.pmod(bits, F.lit(4))
    value = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    return F.concat(F.substr(digits, F.lit(1), whole), F.when(left > 0, F.concat(F.lit("."), F.call_function("shiftright", value, (4 - left).cast("int")))).otherwise(F.lit("")))


def network_keys(networks: DataFrame, column: str) -> DataFrame:
    """(bits, prefix) of every network 'address/length' or single address, IPv4 as mapped IPv6; bad entries are skipped."""
    entry = F.split(F.trim(F.col(column)), "/", -1)
    length = F.try_element_at(entry, F.lit(2))
    is_v4 = ~F.contains(entry[0], F.lit(":"))
    number = F.when(F.size(entry) == 1, F.lit(128)).when(length.rlike(r"^\d{1,3}$") & (F.size(entry) == 2), length.cast("int") + F.when(is_v4, 96).otherwise(0))
    parsed = networks.select(F.substring(address_key(entry[0]), 1, 32).alias("_digits"), number.alias("bits"))
    return parsed.where("_digits is not null and bits between 0 and 128").select("bits", masked_digits(F.col("_digits"), F.col("bits")).alias("prefix")).distinct()
