"""Routes, identities, roles, client addresses and the outcome of a request."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textwarden import fixed_values as fv
from textwarden.functions import net
from textwarden.functions.regex import any_of
from textwarden.operators import canary, prompts, requests as scans
from textwarden.operators.barrier import pin
from textwarden.schemas import ROUTE
from textwarden.session import written


SWITCHES = ("fast_waf", "prompt_injection", "jailbreak", "pii_masking", "output_guard", "agentic_sentinel")


@dataclass(frozen=True)
class Route:
    """One configured route and the checks switched on for it."""

    id: str
    path: str
    type: str = "rest"
    auth_required: bool = False
    required_roles: tuple[str, ...] = ()
    canary_tokens: tuple[str, ...] = ()
    fast_waf: bool = False
    prompt_injection: bool = False
    jailbreak: bool = False
    pii_masking: bool = False
    output_guard: bool = False
    agentic_sentinel: bool = False
    upstream: str = field(default="")


def sized_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Configured rows as a local relation: its size is known, so joins with it broadcast it or shuffle, as the size asks."""
    kind = T.StructType.fromDDL(schema)
    named = [dict(zip(kind.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(named, to_arrow_schema(kind)), kind)


def routes_frame(spark: SparkSession, routes: Sequence[Route]) -> DataFrame:
    """Configured routes as a table, in declaration order; it is made of Arrow rows, so Spark knows its size."""
    rows = [
        (
            number, r.id, r.path, r.upstream, r.type, r.auth_required, list(r.required_roles), list(r.canary_tokens),
            {name: getattr(r, name) for name in SWITCHES},
        )
        for number, r in enumerate(routes, start=1)
    ]
    return sized_frame(spark, rows, ROUTE)


def compiled_route(routes: Sequence[Route], path: Column) -> Column:
    """Id of the best of the configured routes, in the row: no join, no shuffle, whatever the log's size.

    Routes become hash tables in the expression. A path looks itself up, each of its ancestors at a segment boundary, and its first
    characters for the lengths only that a ``*`` behind other than a slash has; the cost does not grow with the number of routes.
    """
    tables: dict[str, dict] = {"exact": {}, "segments": {}, "starts": {}}
    for number, route in enumerate(routes, start=1):
        target = net.cleaned(route.path)
        tables["exact"].setdefault(target, (number, route.id))
        if target.endswith("/*"):
            tables["segments"].setdefault(target[:-2], (number, route.id))
        elif target.endswith("*"):
            tables["starts"].setdefault(target[:-1], (number, route.id))
    kind = "struct<route_no:int,id:string>"
    find = lambda table, key: net.lookup(tables[table], kind, key)
    # A long expression used at several places is bound once, as a lambda's variable.
    def best(clean: Column) -> Column:
        found = [F.array(find("starts", F.substr(clean, F.lit(1), F.lit(length)))) for length in sorted({len(p) for p in tables["starts"]})]
        if tables["segments"]:
            found.append(F.transform(net.parent_prefixes(clean), lambda prefix: find("segments", prefix)))
        covering = F.array_min(F.concat(*found)) if found else F.lit(None).cast(kind)
        return F.coalesce(find("exact", clean), covering)["id"]

    return F.get(F.transform(F.array(net.clean_path(path)), best), F.lit(0))


def match_routes(requests: DataFrame, routes: DataFrame | Sequence[Route], path: str = "path", out: str = "route_id") -> DataFrame:
    """Add the id of the best route: an exact path first, else the first declared wildcard that covers the path.

    Configured routes (``Route`` objects) are compiled into the row, see ``compiled_route``. For a table of routes, a wildcard covers a path when its prefix is one of the path's own prefixes, so matching is an equi-join of the
    distinct paths' prefixes with the routes' keys, and its result an equi-join back on the path. Neither side is
    assumed small: Spark broadcasts by measured size, and adaptive execution splits the partitions of a hot path.
    """
    if not isinstance(routes, DataFrame):
        return requests.withColumn(out, compiled_route(routes, F.col(path)))
    cleaned = net.clean_path(F.col("path"))
    ends_wide, ends_star = F.endswith(cleaned, F.lit("/*")), F.endswith(cleaned, F.lit("*"))
    keyed = routes.select(
        "route_no", F.col("id").alias("_id"),
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.concat(F.lit("="), cleaned).alias("key"), F.lit(0).alias("rank")),
                    F.when(ends_wide, F.struct(F.concat(F.lit("/"), F.regexp_replace(cleaned, r"/\*$", "")).alias("key"), F.lit(1).alias("rank"))),
                    F.when(ends_star & ~ends_wide, F.struct(F.concat(F.lit("*"), F.regexp_replace(cleaned, r"\*$", "")).alias("key"), F.lit(1).alias("rank"))),
                )
            )
        ).alias("_key"),
    ).select("route_no", "_id", "_key.*")
    paths = requests.select(F.col(path).alias("_path")).distinct()
    request_path = F.col("_clean")
    starts = F.transform(
        F.sequence(F.lit(0), F.length(request_path)), lambda length: F.concat(F.lit("*"), F.substr(request_path, F.lit(1), length))
    )
    prefixes = F.transform(net.parent_prefixes(request_path), lambda prefix: F.concat(F.lit("/"), prefix))
    candidates = paths.withColumn("_clean", net.clean_path(F.col("_path"))).select(
        "_path", F.explode(F.concat(F.array(F.concat(F.lit("="), request_path)), prefixes, starts)).alias("key")
    )
    matched = candidates.join(keyed, "key").groupBy("_path").agg(
        F.min_by("_id", F.struct("rank", "route_no")).alias(out)
    )
    return requests.join(matched, requests[path].eqNullSafe(matched["_path"]), "left").drop("_path")


def unrouted(requests: DataFrame, routes: DataFrame | Sequence[Route], path: str = "path") -> DataFrame:
    """Requests that no route serves."""
    return match_routes(requests, routes, path, "_route").where("_route is null").drop("_route")


def presented_key(headers: Column, name: str = "X-API-Key") -> Column:
    """API key of a request: its own header, else a bearer token."""

    def value(header: str) -> Column:
        named = F.map_filter(headers, lambda key, _: F.lower(key) == header.lower())
        return F.get(F.get(F.map_values(named), F.lit(0)), F.lit(0))

    own, bearer = value(name), value("Authorization")
    return F.when(F.coalesce(own, F.lit("")) != "", own).when(
        F.startswith(bearer, F.lit("Bearer ")) & (F.length(bearer) > 7), F.substr(bearer, F.lit(8))
    )


def identify(requests: DataFrame, api_keys: DataFrame, key: Column, out: str = "identity") -> DataFrame:
    """Add the identity of each API key by its SHA-256 digest; NULL for a missing or unknown key.

    An equi-join on the digest. A key behind a large share of the requests is no hazard: the key table is broadcast
    when it is small (make configured keys a table with ``sized_frame``), and skewed partitions are split when it is not.
    """
    hashed = requests.withColumn("key_hash", F.sha2(key, 256))
    known = api_keys.select(
        "key_hash",
        F.struct(
            F.col("id").alias("subject"), "tenant_id", F.lit("API_KEY").alias("auth_type"), "roles",
        ).alias(out),
    )
    return hashed.join(known, "key_hash", "left").drop("key_hash")


def first_identity(*identities: Column) -> Column:
    """Identity from the first authenticator that succeeded."""
    return F.coalesce(*identities)


def missing_role(required: Column, roles: Column) -> Column:
    """First required role that is not held, ignoring case; NULL when all are held."""
    held = F.transform(F.coalesce(roles, F.array().cast("array<string>")), F.lower)
    return F.get(F.filter(required, lambda role: ~F.array_contains(held, F.lower(role))), F.lit(0))


def client_ip(df: DataFrame, remote: str, forwarded: str, trusted: Sequence[str], out: str = "client_ip") -> DataFrame:
    """Add the address to record: the peer, or behind a trusted proxy the rightmost hop that is not one itself.

    The trusted networks are configuration, so membership is a chain of literal range tests and needs no join.
    """
    if not trusted:
        return df.withColumn(out, F.col(remote))
    kept = df.columns
    ranges = net.network_ranges(trusted)
    hops = F.transform(F.split(F.coalesce(F.col(forwarded), F.lit("")), ",", -1), lambda hop: F.trim(hop))
    df = df.withColumns({"_peer": net.address_key(net.peer_host(F.col(remote))), "_hops": F.reverse(hops)})
    df = df.withColumn("_keys", net.address_keys(F.col("_hops")))
    untrusted = F.filter("_keys", lambda key: key.isNotNull() & ~net.in_ranges(key, ranges))
    vouched = F.regexp_replace(F.get(untrusted, F.lit(0)), r"^[^|]*\|", "")
    behind_proxy = F.coalesce(net.in_ranges(F.col("_peer"), ranges), F.lit(False))
    return df.withColumn(out, F.coalesce(F.when(behind_proxy, vouched), F.col(remote))).select(*kept, out)


def trusted_addresses(addresses: DataFrame, networks: DataFrame, column: str = "network") -> DataFrame:
    """Those address keys (column address) that lie in a network of the table, once each.

    An equi-join on the masked address for each of the at most 129 prefix lengths that occur; no range is compared.
    """
    known = net.network_keys(networks, column)
    lengths = F.array(*[F.lit(r["bits"]) for r in known.select("bits").distinct().collect()]).cast("array<int>")
    digits = F.substring("address", 1, 32)
    probes = addresses.select("address").where("address is not null").distinct().select("address", F.explode(lengths).alias("bits"))
    return probes.withColumn("prefix", net.masked_digits(digits, F.col("bits"))).join(known, ["bits", "prefix"], "left_semi").select("address").distinct()


def client_ip_by_table(df: DataFrame, id_col: str, remote: str, forwarded: str, networks: DataFrame, column: str = "network", out: str = "client_ip") -> DataFrame:
    """``client_ip`` for networks that are a table of any size: the peer, or behind a trusted one the rightmost hop that is not trusted.

    Each distinct address meets the networks once; the log meets the trusted addresses, and only hops behind trusted peers are
    exploded. ``id_col`` is a unique key; rows without one keep their peer. Networks that can't be read are skipped, and an empty table trusts nobody.
    """
    kept = df.columns
    hops = F.transform(F.split(F.coalesce(F.col(forwarded), F.lit("")), ",", -1), lambda hop: F.trim(hop))
    # Addresses are parsed once and the trusted ones found once, although both are read several times.
    keyed = df.select(id_col, net.address_key(net.peer_host(F.col(remote))).alias("_peer"), net.address_keys(F.reverse(hops)).alias("_hops"))
    keyed = written(keyed, "address-keys")
    seen = keyed.select(F.explode(F.concat("_hops", F.array("_peer"))).alias("address"))
    trusted = written(trusted_addresses(seen, networks, column), "trusted-addresses")
    behind = keyed.where(F.col(id_col).isNotNull()).select(id_col, F.col("_peer").alias("address"), "_hops").join(trusted, "address", "left_semi")
    each = behind.select(id_col, F.posexplode("_hops").alias("_place", "address")).where("address is not null").join(trusted, "address", "left_anti")
    vouched = each.groupBy(id_col).agg(F.min_by("address", "_place").alias("_vouched"))
    found = F.regexp_replace("_vouched", r"^[^|]*\|", "")
    return df.join(vouched, id_col, "left").withColumn(out, F.coalesce(found, F.col(remote))).select(*kept, out)


def stale_signatures(log: DataFrame, signed_at: str, received_at: str, max_age: int = fv.SIGNATURE_MAX_AGE_SECONDS) -> DataFrame:
    """Signed requests whose timestamp (epoch seconds) is further than ``max_age`` from their arrival."""
    age = F.abs(F.col(received_at) - F.col(signed_at))
    return log.where(F.col(signed_at).isNotNull()).withColumn("age_seconds", age).where(age > max_age)


def replay(
    requests: DataFrame,
    routes: DataFrame | Sequence[Route],
    api_keys: DataFrame,
    deep: bool = True,
    max_bytes: int = fv.MAX_BODY_BYTES,
    include_preroute: bool = True,
) -> DataFrame:
    """Replay the pipeline over a request log and add the outcome of every request.

    Expects path, query, headers, body, prompt, response, upstream_status and the optional body_status (see
    ``sources.bodies``). Adds route_id, status, error, threat_type, severity, action, reason. The first stage that
    refuses decides: early traversal, routing, upgrade, identity, roles, body, signatures, guard, upstream, canary.
    """
    kept = requests.columns
    df = requests if "body_status" in kept else requests.withColumn("body_status", F.lit("ok"))
    uri = F.concat(F.col("path"), F.when(F.col("query") != "", F.concat(F.lit("?"), F.col("query"))).otherwise(""))
    df = scans.scan_early_traversal(df.withColumn("_full_uri", uri), "_full_uri", "query", "headers", out="_early")
    df = match_routes(df, routes, "path", "route_id")
    table = routes if isinstance(routes, DataFrame) else routes_frame(requests.sparkSession, routes)
    policy = table.select(
        F.col("id").alias("route_id"), F.col("type").alias("_type"), F.col("auth_required").alias("_auth"),
        F.col("required_roles").alias("_required"), F.col("canary_tokens").alias("_tokens"), F.col("guardrails").alias("_on"),
    )
    df = identify(df.join(policy, "route_id", "left"), api_keys, presented_key(F.col("headers")), "_identity")
    switches = F.col("_on")
    upgrade = F.exists(F.map_keys("headers"), lambda name: F.lower(name) == "upgrade")
    lacking = missing_role(F.col("_required"), F.col("_identity.roles"))
    inspects = any_of([switches[name] for name in ("prompt_injection", "jailbreak", "pii_masking", "agentic_sentinel")])
    inspects = inspects & (F.coalesce(F.col("prompt"), F.lit("")) != "")
    early, scan, decision, leak = (F.col(name) for name in ("_early", "_scan", "_guard", "_leak"))
    before_scan = [
        early["blocked"], F.col("route_id").isNull(), upgrade & ~F.lower("_type").isin("ws", "websocket"),
        F.col("_auth") & F.col("_identity").isNull(), F.col("_auth") & lacking.isNotNull(),
        (F.octet_length("body") > max_bytes) | (F.col("body_status") == "too_large"), F.col("body_status") == "unsupported",
        F.col("body_status") == "malformed",
    ]
    # A check sees only the requests that it can still refuse: those that no stage before it refuses, on routes that ask for it.
    holds = lambda condition: F.coalesce(condition, F.lit(False))
    df = pin(df, {"_open": ~any_of([holds(condition) for condition in before_scan])})
    df = pin(df, {f"_waf_{name}": F.when(F.col("_open") & switches["fast_waf"], F.col(name)) for name in ("path", "query", "headers", "body")})
    df = scans.scan_requests(df, *[f"_waf_{name}" for name in ("path", "query", "headers", "body")], out="_scan")
    df = pin(df, {"_asked": F.when(F.col("_open") & ~holds(switches["fast_waf"] & scan["blocked"]) & inspects, F.col("prompt"))})
    guard = prompts.GuardPolicy(
        switches["prompt_injection"], switches["jailbreak"], switches["pii_masking"], F.lit(fv.SENSITIVITY_THRESHOLD)
    )
    df = prompts.decide(df, "_asked", guard, "_guard", deep=deep)
    answered = F.col("_open") & ~holds(switches["fast_waf"] & scan["blocked"]) & ~holds(inspects & ~decision["allowed"])
    answered = answered & F.col("upstream_status").isNotNull() & ~holds(F.octet_length("response") > max_bytes)
    df = pin(df, {"_guarded": F.when(answered & switches["output_guard"], F.col("_tokens"))})
    df = canary.find_leaks(df, "response", "_guarded", out="_leak", deep=deep)
    masked = inspects & (decision["sanitized_prompt"] != F.col("prompt"))

    def outcome(status, error: str, threat="NONE", severity="LOW", action="BLOCKED", reason="", counted=True) -> Column:
        column = lambda value: value if isinstance(value, Column) else F.lit(value)
        return F.struct(
            column(status).cast("int").alias("status"), F.lit(error).alias("error"), column(threat).alias("threat_type"),
            column(severity).alias("severity"), column(action).alias("action"), column(reason).alias("reason"),
            F.lit(counted).alias("counted"),
        )

    stages = [
        (before_scan[0], outcome(403, "SECURITY_VIOLATION", early["threat_type"], early["severity"], reason=early["reason"], counted=include_preroute)),
        (before_scan[1], outcome(404, "ROUTE_NOT_FOUND", reason="no matching route found for path", counted=include_preroute)),
        (before_scan[2], outcome(400, "PROTOCOL_UPGRADE_REJECTED", reason="Upgrade requests are not permitted on this route", counted=include_preroute)),
        (before_scan[3], outcome(401, "UNAUTHORIZED", severity="HIGH", reason="Authentication failed", counted=include_preroute)),
        (before_scan[4], outcome(403, "FORBIDDEN", severity="HIGH", reason=F.concat(F.lit("Insufficient permissions: missing role '"), lacking, F.lit("'")), counted=include_preroute)),
        (before_scan[5], outcome(413, "payload_too_large", counted=include_preroute)),
        (before_scan[6], outcome(415, "unsupported_content_encoding", counted=include_preroute)),
        (before_scan[7], outcome(400, "invalid_content_encoding", counted=include_preroute)),
        (switches["fast_waf"] & scan["blocked"], outcome(403, "SECURITY_VIOLATION", scan["threat_type"], scan["severity"], reason=scan["reason"])),
        (inspects & ~decision["allowed"], outcome(403, "AI_SECURITY_VIOLATION", decision["threat_type"], decision["risk_level"], reason=decision["reason"])),
        (F.col("upstream_status").isNull(), outcome(502, "UPSTREAM_UNAVAILABLE", severity="HIGH", reason="Upstream connection failure", counted=include_preroute)),
        (F.octet_length("response") > max_bytes, outcome(502, "UPSTREAM_TOO_LARGE", counted=include_preroute)),
        (leak["detected"], outcome(502, "CANARY_SECRET_LEAK", "CANARY_LEAK", "CRITICAL", reason=leak["reason"])),
        (masked, outcome(F.col("upstream_status"), "", "PII_DETECTED", "MEDIUM", "MASKED", decision["reason"])),
    ]
    chain = F.when(F.coalesce(stages[0][0], F.lit(False)), stages[0][1])
    for condition, result in stages[1:]:
        chain = chain.when(F.coalesce(condition, F.lit(False)), result)
    chain = chain.otherwise(outcome(F.col("upstream_status"), "", action="ALLOWED"))
    client = F.coalesce(F.col("_identity.subject"), F.lit("anonymous"))
    return df.withColumns({"_outcome": chain, "client_id": client}).select(*kept, "route_id", "client_id", "_outcome.*")
