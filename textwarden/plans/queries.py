"""Registered queries: each reads its whole tables, plants texts, and runs the library's jobs."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden import fixed_values as fv
from textwarden.functions import net
from textwarden.functions import surface as sf
from textwarden.functions import text as tx
from textwarden.functions.digest import epoch_micros
from textwarden.operators import (
    audit, audit_lines, buckets, canary, chunks, conversations, evaluation, metrics, pii, prompts, requests, routing, vault, views,
)
from textwarden.operators.routing import Route
from textwarden.plans import plants
from textwarden.schemas import API_KEY
from textwarden.session import SETTINGS, shared_folder, spread, written
from textwarden.sources import audit_log, exposition
from textwarden.streaming import jobs, responses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
WRITERS, ROTATION = 8, 86_400

ROUTES = (
    Route("llm-chat", "/v1/chat/completions", "llm", True, ("user",), plants.TOKENS[:2], prompt_injection=True, jailbreak=True,
          pii_masking=True, output_guard=True),
    Route("rest-api", "/api/*", "rest", True, ("user",), fast_waf=True),
    Route("static", "/static*", "rest"),
    Route("api-users", "/api/users/42", "rest", True, ("Admin",), fast_waf=True),
)
API_KEYS = (
    ("admin-demo-key", "admin-user", "default-tenant", ["admin", "developer", "user"], 1000),
    ("client-demo-key", "app-client-1", "client-tenant", ["user"], 100),
)


def query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str, texts) -> DataFrame:
    documents = spread(_table(spark, folder, "documents"))
    return documents.withColumn("text", F.concat("text", plants.planted(F.col("doc_id"), texts)))


def _turns(spark: SparkSession, folder: str, texts) -> DataFrame:
    turns = spread(_table(spark, folder, "conversations"))
    return turns.withColumn("text", F.concat("text", plants.planted(F.col("conv_id") + F.col("turn"), texts)))


def _split_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns that end with half an attack and open with the other half of the turn before."""
    turns = spread(_table(spark, folder, "conversations"))
    place = F.col("conv_id") * 3 + F.col("turn")
    front = plants.planted(place + (len(plants.TURN_FRONTS) - 1), plants.TURN_FRONTS)
    return turns.withColumn("text", F.concat(front, F.col("text"), plants.planted(place, plants.TURN_ENDS)))


def _verdict_columns(name: str) -> list[Column]:
    return [F.col(f"{name}.{field}").alias(field) for field in ("detected", "confidence", "rule", "matched_sample", "reason")]


# --- personal data ---------------------------------------------------------------------------------------------

@query
def pii_corpus_mask(spark, folder):
    masked = pii.mask_pii(_documents(spark, folder, plants.PII), "text", counts=True)
    counts = [f"n_{label.lower()}" for label, *_ in fv.PII_RULES]
    return masked.select("doc_id", F.col("pii.sanitized_text").alias("masked"), *counts)


@query
def pii_entity_rollup(spark, folder):
    return pii.entity_rollup(_documents(spark, folder, plants.PII), "text")


@query
def pii_by_language(spark, folder):
    return pii.entity_rollup(_documents(spark, folder, plants.PII), "text", "lang")


@query
def pii_inventory(spark, folder):
    return pii.inventory(_documents(spark, folder, plants.PII), "doc_id", "text")


@query
def pii_conversation_mask(spark, folder):
    return pii.mask_turns(_turns(spark, folder, plants.PII)).select("conv_id", "turn", "role", "masked", "action")


@query
def pii_sdk_mask(spark, folder):
    masked = pii.mask_pii(_documents(spark, folder, plants.PII), "text", profile="sdk")
    types = F.array_join(F.transform("pii.entities", lambda entity: entity["type"]), ",")
    return masked.select("doc_id", F.col("pii.sanitized_text").alias("masked"), types.alias("types"))


def _vaulted(spark, folder) -> tuple[DataFrame, DataFrame]:
    return vault.mask_reversibly(_turns(spark, folder, plants.VAULT).select("conv_id", "turn", "text"))


@query
def vault_mask(spark, folder):
    return _vaulted(spark, folder)[0]


@query
def vault_entries(spark, folder):
    return _vaulted(spark, folder)[1]


@query
def vault_round_trip(spark, folder):
    """Masked turns with their values put back."""
    masked, entries = _vaulted(spark, folder)
    return vault.unmask(written(masked, "vault-masked"), entries, "conv_id", ["turn"], "masked").select("conv_id", "turn", "unmasked")


@query
def vault_answers(spark, folder):
    """Answers that name the conversation's placeholders, one that it has not and one in the wrong case, as the client sees them."""
    _, entries = _vaulted(spark, folder)
    said = F.lit("Call <PHONE_1> or <PHONE_2>, write <EMAIL_1>, not <EMAIL_77> or <phone_1>; it said <LITERAL_1>.")
    answers = _table(spark, folder, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn")).withColumn("text", said)
    return vault.unmask(answers, entries, "conv_id", ["turn"], "text").select("conv_id", "unmasked")


# --- prompt guard ----------------------------------------------------------------------------------------------

@query
def prompt_injection_scan(spark, folder):
    found = prompts.detect(_documents(spark, folder, plants.PROMPTS), "text", jailbreak=None)
    return found.select("doc_id", *_verdict_columns("injection"))


@query
def jailbreak_scan(spark, folder):
    found = prompts.detect(_documents(spark, folder, plants.PROMPTS), "text", injection=None)
    return found.select("doc_id", *_verdict_columns("jailbreak"))


@query
def oversize_prompts(spark, folder):
    found = prompts.detect(_documents(spark, folder, plants.PROMPTS), "text", jailbreak=None)
    return found.where("injection.rule = 'pi_oversize'").select("doc_id", "n_chars", F.col("injection.reason").alias("reason"))


@query
def cross_turn_injection(spark, folder):
    joined = conversations.assemble(_split_turns(spark, folder))
    found = prompts.detect(joined, "prompt")
    hit = found.where("injection.detected or jailbreak.detected")
    return hit.select(
        "conv_id", F.col("injection.rule").alias("injection_rule"), F.col("injection.reason").alias("injection_reason"),
        F.col("jailbreak.rule").alias("jailbreak_rule"), F.col("jailbreak.reason").alias("jailbreak_reason"),
    )


@query
def guard_decision(spark, folder):
    decided = prompts.decide(_turns(spark, folder, plants.PROMPTS), "text")
    return decided.select("conv_id", "turn", "decision.*")


@query
def guard_decision_deep(spark, folder):
    decided = prompts.decide(_documents(spark, folder, plants.HIDDEN), "text")
    return decided.select("doc_id", F.col("decision.allowed").alias("allowed"), F.col("decision.threat_type").alias("threat_type"), F.col("decision.reason").alias("reason"))


@query
def guard_policy_switches(spark, folder):
    """Verdicts under per-row policies: roles switch checks on and raise the threshold."""
    role = F.col("role")
    policy = prompts.GuardPolicy(
        prompt_injection=role != "system", jailbreak=role == "user", pii_masking=role != "assistant",
        threshold=F.when(role == "assistant", 0.9).otherwise(0.7),
    )
    decided = prompts.decide(_turns(spark, folder, plants.PROMPTS), "text", policy)
    return decided.groupBy("role", "decision.threat_type").agg(
        F.count("*").alias("n"), F.count_if(~F.col("decision.allowed")).alias("blocked")
    )


@query
def risk_levels(spark, folder):
    judged = prompts.fallback_judgement(_turns(spark, folder, plants.PROMPTS), "text")
    score = F.col("judgement.risk_score")
    return judged.select(
        "conv_id", "turn", F.col("judgement.threat_category").alias("threat_category"), score.cast("bigint").alias("risk_score"),
        prompts.risk_level(score).alias("risk_level"), F.col("judgement.suggested_action").alias("suggested_action"),
        F.col("judgement.standard_code").alias("standard_code"),
    )


@query
def guard_fallback(spark, folder):
    """Requests joined with the verdicts that arrived; answers to system turns are missing."""
    turns = _turns(spark, folder, plants.PROMPTS).withColumn("request", F.concat_ws("-", "conv_id", "turn"))
    answered = prompts.decide(turns.where("role <> 'system'"), "text").select("request", "decision.allowed", "decision.threat_type")
    closed = prompts.with_fallback(turns.select("request", "role"), answered, "request", "BLOCK").withColumn("mode", F.lit("BLOCK"))
    opened = prompts.with_fallback(turns.select("request", "role"), answered, "request", "ALLOW").withColumn("mode", F.lit("ALLOW"))
    return closed.unionByName(opened).groupBy("mode", "role", "threat_type").agg(
        F.count("*").alias("n"), F.count_if("allowed").alias("allowed"), F.sum(F.col("status").cast("bigint")).alias("status_sum")
    )


@query
def sdk_guard_decision(spark, folder):
    decided = prompts.sdk_decide(_turns(spark, folder, plants.PROMPTS), "text")
    return decided.select(
        "conv_id", "turn", *[F.col(f"decision.{name}").alias(name) for name in ("is_blocked", "threat_category", "standard_code", "confidence", "masked_text", "has_pii")]
    )


# --- requests --------------------------------------------------------------------------------------------------

def _pages(spark, folder) -> DataFrame:
    """Request log made from the crawl: path and query of each URL, with planted queries, cookies and bodies."""
    pages = spread(_table(spark, folder, "pages").select("page_id", "url"))
    page = F.col("page_id")
    url_query = F.regexp_extract("url", r"\?([^#]*)", 1)
    planted = plants.planted(page, plants.QUERIES)
    query_text = F.when(planted == "", url_query).when(url_query == "", planted).otherwise(F.concat(url_query, F.lit("&"), planted))
    cookie = plants.planted(page, plants.COOKIES)
    headers = F.create_map(
        F.lit("User-Agent"), F.array(F.lit("Mozilla/5.0 (X11; Linux x86_64)")), F.lit("Accept"), F.array(F.lit("a;b | /bin/sh")),
        F.lit("Cookie"), F.array(cookie),
    )
    return pages.select(
        "page_id", F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1).alias("path"), query_text.alias("query"),
        headers.alias("headers"), plants.planted(page, plants.BODIES).alias("body"),
    )


@query
def request_threat_scan(spark, folder):
    scanned = requests.scan_requests(_pages(spark, folder))
    return scanned.select("page_id", "verdict.*")


@query
def surface_breakdown(spark, folder):
    scanned = requests.scan_requests(_pages(spark, folder)).where("verdict.blocked")
    return scanned.groupBy("verdict.surface", "verdict.threat_type", "verdict.severity").agg(F.count("*").alias("n"))


@query
def request_scan_switches(spark, folder):
    """Scan with only the script and SQL categories switched on."""
    scanned = requests.scan_requests(_pages(spark, folder), categories=("SQL_INJECTION", "XSS"))
    return scanned.groupBy("verdict.matched_rule").agg(F.count("*").alias("n"))


@query
def pollution_views(spark, folder):
    """Parameter values of the candidate queries, decoded, and their concatenation."""
    pages = _pages(spark, folder).where(sf.pollution_candidate(F.col("query")))
    decoded = F.filter(
        F.transform(sf.query_values(F.col("query")), lambda value: sf.spaced_view(sf.decode_shifted(value))), lambda value: value != ""
    )
    each = pages.withColumn("_values", decoded)
    return each.select("page_id", F.size("_values").cast("bigint").alias("n_values"), F.array_join("_values", "").alias("joined"), F.array_join("_values", "|").alias("listed"))


@query
def early_traversal(spark, folder):
    pages = _pages(spark, folder).withColumn("uri", F.concat_ws("?", "path", "query"))
    scanned = requests.scan_early_traversal(pages, "uri", "query", "headers")
    return scanned.where("early.blocked").select("page_id", F.col("early.threat_type").alias("threat_type"), F.col("early.matched_rule").alias("matched_rule"))


@query
def html_rule_report(spark, folder):
    """How many crawled pages each script rule would hit: the surface most full of markup."""
    html = spread(_table(spark, folder, "pages").select("html"))
    counted = [F.count_if(F.col("html").rlike(requests.ascii_words(rule[3]))).alias(rule[0]) for rule in fv.XSS_RULES]
    return html.agg(F.count("*").alias("pages"), *counted)


@query
def sdk_request_scan(spark, folder):
    scanned = requests.scan_texts(_pages(spark, folder), "query", profile="sdk")
    decoded = requests.scan_texts(scanned, "query", out="decoded", profile="sdk_decoded")
    return decoded.select(
        "page_id", F.col("verdict.blocked").alias("blocked"), F.col("verdict.threat_type").alias("threat_type"), F.col("verdict.reason").alias("reason"),
        F.col("decoded.threat_type").alias("decoded_threat_type"), F.col("decoded.reason").alias("decoded_reason"),
    )


@query
def surface_normal_forms(spark, folder):
    """Comment-unwrapped and compact forms of the decoded queries."""
    decoded = _pages(spark, folder).withColumn("_decoded", sf.decode_shifted(F.col("query")))
    return decoded.select("page_id", sf.spaced_view(F.col("_decoded")).alias("spaced"), sf.compact_view(F.col("_decoded")).alias("compact"))


# --- de-obfuscation --------------------------------------------------------------------------------------------

@query
def zero_width_scan(spark, folder):
    documents = _documents(spark, folder, plants.HIDDEN)
    visible = tx.strip_zero_width(F.col("text"))
    return documents.where(visible != F.col("text")).select("doc_id", visible.alias("text"))


@query
def rot13_scan(spark, folder):
    documents = _documents(spark, folder, plants.HIDDEN).withColumn("turned", tx.rot13(F.col("text")))
    found = prompts.detect(documents, "turned", jailbreak=None, deep=False)
    return found.where("injection.confidence >= 0.7").select("doc_id", F.col("injection.rule").alias("rule"), F.md5("turned").alias("digest"))


@query
def hex_payloads(spark, folder):
    documents = _documents(spark, folder, plants.HIDDEN)
    return documents.select("doc_id", F.posexplode(tx.hex_payloads(F.col("text"))).alias("place", "payload")).select(
        "doc_id", F.col("place").cast("bigint").alias("place"), "payload"
    )


@query
def base64_payloads(spark, folder):
    documents = _documents(spark, folder, plants.HIDDEN)
    return documents.select("doc_id", F.posexplode(tx.base64_payloads(F.col("text"))).alias("place", "payload")).select(
        "doc_id", F.col("place").cast("bigint").alias("place"), "payload"
    )


@query
def keyword_squeeze_scan(spark, folder):
    documents = _documents(spark, folder, plants.HIDDEN)
    squeezed = tx.squeeze_keywords(F.col("text"))
    return documents.where(squeezed != F.col("text")).select("doc_id", squeezed.alias("text"))


@query
def doubled_letters(spark, folder):
    documents = _documents(spark, folder, plants.HIDDEN).withColumn("squeezed", tx.squeeze_doubles(F.col("text")))
    changed = documents.where("squeezed <> text")
    return changed.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text") - F.length("squeezed")).alias("dropped"))


@query
def leet_letters(spark, folder):
    documents = _documents(spark, folder, plants.HIDDEN)
    plain = tx.leet_singles(F.col("text"))
    return documents.where(plain != F.col("text")).select("doc_id", F.md5(plain).alias("digest"))


@query
def percent_texts(spark, folder):
    documents = _documents(spark, folder, plants.HIDDEN)
    decoded = tx.decode_percent(F.col("text"))
    return documents.where(decoded != F.col("text")).select("doc_id", F.md5(decoded).alias("digest"))


@query
def page_entities(spark, folder):
    """Pages whose text changes when entities are decoded."""
    pages = spread(_table(spark, folder, "pages")).withColumn("decoded", tx.decode_entities(F.col("html")))
    return pages.where("decoded <> html").select("page_id", F.md5("decoded").alias("digest"))


@query
def accent_skeletons(spark, folder):
    documents = _documents(spark, folder, plants.HIDDEN).withColumn("plain", tx.unicode_skeleton(F.col("text")))
    return documents.where("plain <> text").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("plain")).alias("n_chars"), F.sum(F.octet_length("plain")).alias("n_bytes"))


@query
def deobfuscated_views(spark, folder):
    return views.deobfuscate(_documents(spark, folder, plants.HIDDEN), "doc_id", "text").groupBy("label").agg(F.count("*").alias("n"))


@query
def deobfuscated_scan(spark, folder):
    found = prompts.detect(_documents(spark, folder, plants.HIDDEN), "text")
    return found.where("injection.detected or jailbreak.detected").select(
        "doc_id", F.col("injection.rule").alias("injection_rule"), F.col("injection.reason").alias("injection_reason"), F.col("jailbreak.rule").alias("jailbreak_rule")
    )


# --- chat bodies -----------------------------------------------------------------------------------------------

def _bodies(spark, folder) -> DataFrame:
    """Chat bodies of conversations, every third one with a flat prompt instead of messages."""
    turns = _turns(spark, folder, plants.PII)
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    messages = F.transform("turns", lambda turn: F.struct(turn["role"].alias("role"), turn["text"].alias("content")))
    chat = F.to_json(F.struct(F.lit("m").alias("model"), messages.alias("messages")))
    flat = F.to_json(F.struct(F.get("turns", F.lit(0))["text"].alias("prompt"), F.lit(plants.ASIDE).alias("input"), F.lit(7).alias("n")))
    return listed.select("conv_id", F.when(F.pmod("conv_id", F.lit(3)) == 2, flat).otherwise(chat).alias("body"))


@query
def extract_prompts(spark, folder):
    bodies = _bodies(spark, folder)
    return bodies.select("conv_id", conversations.extract_prompt(F.col("body")).alias("prompt"))


@query
def body_rewrite(spark, folder):
    """Bodies with masked prompts written back, read again."""
    bodies = _bodies(spark, folder).withColumn("prompt", conversations.extract_prompt(F.col("body")))
    masked = pii.mask_pii(bodies, "prompt")
    rewritten = masked.withColumn("body", conversations.replace_prompt(F.col("body"), F.col("pii.sanitized_text")))
    return rewritten.select("conv_id", conversations.extract_prompt(F.col("body")).alias("prompt"))


# --- canaries --------------------------------------------------------------------------------------------------

def _responses(spark, folder) -> DataFrame:
    return _turns(spark, folder, plants.LEAKS).where("role = 'assistant'")


@query
def canary_leaks(spark, folder):
    judged = canary.find_leaks(_responses(spark, folder), "text", plants.TOKENS)
    return judged.where("canary.detected").select("conv_id", "turn", F.col("canary.leaked_token").alias("leaked_token"), F.col("canary.kind").alias("kind"))


@query
def canary_by_kind(spark, folder):
    judged = canary.find_leaks(_responses(spark, folder), "text", plants.TOKENS)
    return judged.groupBy("canary.kind").agg(F.count("*").alias("n"))


@query
def canary_deep(spark, folder):
    """Tokens that responses hold in an encoding."""
    judged = canary.find_leaks(_turns(spark, folder, plants.DEEP_LEAKS).where("role = 'assistant'"), "text", plants.TOKENS)
    return judged.where("canary.detected").select("conv_id", "turn", F.col("canary.leaked_token").alias("leaked_token"), F.col("canary.kind").alias("kind"))


def _chunks(turns: DataFrame) -> DataFrame:
    """Assistant turns cut into chunks of 3 to 13 characters, so that planted tokens are split everywhere."""
    size = (F.pmod("conv_id", F.lit(11)) + 3).cast("int")
    said = turns.where("role = 'assistant'").withColumn("_size", size)
    numbers = F.sequence(F.lit(0), F.call_function("div", F.length("text") - 1, F.col("_size")).cast("int"))
    each = said.where("text <> ''").select("conv_id", "turn", "text", "_size", F.explode(numbers).alias("chunk_no"))
    return each.select("conv_id", "turn", "chunk_no", F.substr("text", F.col("chunk_no") * F.col("_size") + 1, F.col("_size")).alias("text"))


@query
def canary_chunks(spark, folder):
    """Places of tokens in responses that come in chunks."""
    return chunks.split_leaks(_chunks(_turns(spark, folder, plants.LEAKS)), ["conv_id", "turn"], "chunk_no", "text", plants.TOKENS)


@query
def output_guard(spark, folder):
    guarded = canary.guard_output(_responses(spark, folder), "text", plants.TOKENS)
    return guarded.select("conv_id", "turn", "allowed", "sanitized_response", "threat_type", "reason")


@query
def route_canaries(spark, folder):
    """Responses compared with the tokens of the route they belong to."""
    responses = _responses(spark, folder).withColumn("route_id", plants.planted(F.col("conv_id"), [route.id for route in ROUTES]))
    tokens = canary.route_tokens(responses, routing.routes_frame(spark, ROUTES))
    judged = canary.find_leaks(tokens, "text", "canary_tokens")
    return judged.groupBy("route_id").agg(F.count("*").alias("n"), F.count_if("canary.detected").alias("leaks"))


@query
def canary_sdk(spark, folder):
    judged = canary.find_leaks(_responses(spark, folder), "text", plants.TOKENS, profile="sdk")
    return judged.where("canary.detected").select("conv_id", "turn", F.col("canary.leaked_token").alias("leaked_token"), F.col("canary.kind").alias("kind"))


# --- routing ---------------------------------------------------------------------------------------------------

def _log(spark, folder) -> DataFrame:
    """Request log made from the events: path, key, peer and forwarded header by event."""
    events = _table(spark, folder, "events")
    event = F.col("event_id")
    key = plants.planted(event, plants.KEYS)
    keyed = F.pmod(event, F.lit(2)) == 0
    headers = F.when(key == "", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))).when(
        keyed, F.create_map(F.lit("X-API-Key"), F.array(key))
    ).otherwise(F.create_map(F.lit("authorization"), F.array(F.concat(F.lit("Bearer "), key))))
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value", plants.planted(event, plants.PATHS).alias("path"), headers.alias("headers"),
        plants.planted(event, plants.REMOTES).alias("remote"), plants.planted(event, plants.FORWARDED).alias("forwarded"),
    )


def _keys(spark) -> DataFrame:
    frame = routing.sized_frame(spark, API_KEYS, "key string, id string, tenant_id string, roles array<string>, rate_limit int")
    return frame.select(F.sha2("key", 256).alias("key_hash"), "id", "tenant_id", "roles", "rate_limit")


@query
def route_match(spark, folder):
    matched = routing.match_routes(_log(spark, folder), ROUTES)
    return matched.select("event_id", F.coalesce("route_id", F.lit("-")).alias("route_id"))


@query
def unrouted(spark, folder):
    return routing.unrouted(_log(spark, folder), ROUTES).groupBy("path").agg(F.count("*").alias("n"))


@query
def clean_paths(spark, folder):
    return _log(spark, folder).groupBy("path", net.clean_path(F.col("path")).alias("clean")).agg(F.count("*").alias("n"))


@query
def identity_join(spark, folder):
    log = _log(spark, folder)
    found = routing.identify(log, _keys(spark), routing.presented_key(F.col("headers")))
    second = routing.identify(found, _keys(spark), F.when(F.col("user_id") == 7, F.lit(API_KEYS[1][0])), out="second")
    identity = routing.first_identity(F.col("identity"), F.col("second"))
    return second.select("event_id", F.coalesce(identity["subject"], F.lit("-")).alias("subject"), F.coalesce(identity["tenant_id"], F.lit("-")).alias("tenant_id"))


@query
def role_denials(spark, folder):
    matched = routing.match_routes(_log(spark, folder), ROUTES)
    needed = routing.routes_frame(spark, ROUTES).where("auth_required").select(F.col("id").alias("route_id"), "required_roles")
    known = routing.identify(matched.join(needed, "route_id"), _keys(spark), routing.presented_key(F.col("headers"))).where("identity is not null")
    lacking = routing.missing_role(F.col("required_roles"), F.col("identity.roles"))
    return known.withColumn("missing", lacking).where("missing is not null").select("event_id", "route_id", F.col("identity.subject").alias("subject"), "missing")


@query
def client_addresses(spark, folder):
    attributed = routing.client_ip(_log(spark, folder), "remote", "forwarded", plants.TRUSTED)
    return attributed.select("event_id", "client_ip")


@query
def client_addresses_by_table(spark, folder):
    """Client addresses where the trusted networks are a table: one network of IPv4 or IPv6 for each customer."""
    k, e = F.col("c_custkey"), F.col("event_id")
    part = lambda n: F.concat(F.lit("10."), F.pmod(F.floor(n / 256), F.lit(256)), F.lit("."), F.pmod(n, F.lit(256)))
    six = lambda n: F.concat(F.lit("fd00:"), F.lower(F.hex(n)))
    network = F.when(k % 3 == 0, F.concat(part(k), F.lit(".0/24"))).when(k % 3 == 1, F.concat(six(k), F.lit("::/32"))).otherwise(F.concat(part(k), F.lit(".128/25")))
    networks = _table(spark, folder, "customer").select(network.alias("network"))
    n = e % 2000 + 1
    remote = F.when(e % 4 == 3, F.concat(F.lit("["), six(n), F.lit("::5]:443"))).otherwise(F.concat(part(n), F.lit("."), e % 250 + 1, F.lit(":80")))
    forwarded = F.concat(F.lit("198.51.100."), e % 200, F.lit(", "), six(n + 1), F.lit("::7, "), part(n + 2), F.lit("."), (e * 7) % 256)
    log = spread(_table(spark, folder, "events")).select("event_id", remote.alias("remote"), forwarded.alias("forwarded"))
    return routing.client_ip_by_table(log, "event_id", "remote", "forwarded", networks).select("event_id", "client_ip")


@query
def stale_signatures(spark, folder):
    """Requests signed at a time that the event value shifts away from their arrival."""
    log = _log(spark, folder)
    arrived = F.call_function("div", epoch_micros(F.col("ts")), F.lit(1_000_000))
    signed = arrived - F.floor(F.col("value") * 10).cast("bigint") + 200
    stale = routing.stale_signatures(log.select("event_id", arrived.alias("received_at"), signed.alias("signed_at")), "signed_at", "received_at")
    return stale.select("event_id", "age_seconds")


@query
def decision_replay(spark, folder):
    """Outcome of every event replayed as a request with planted query, body, prompt and response."""
    event = F.col("event_id")
    log = spread(_log(spark, folder)).select(
        "event_id", "path", "headers", plants.planted(event, plants.QUERIES).alias("query"),
        plants.planted(event, plants.BODIES).alias("body"), F.trim(plants.planted(event, plants.PROMPTS)).alias("prompt"),
        plants.planted(event, plants.LEAKS).alias("response"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("int")).otherwise(200).alias("upstream_status"),
    )
    outcome = routing.replay(log, ROUTES, _keys(spark))
    return outcome.select(
        "event_id", F.coalesce("route_id", F.lit("-")).alias("route_id"), "client_id", F.col("status").cast("bigint").alias("status"),
        "error", "threat_type", "severity", "action",
    )


# --- audit -----------------------------------------------------------------------------------------------------

def _audit_events(spark, folder) -> DataFrame:
    events = _table(spark, folder, "events")
    kind = F.col("event_type")
    threat = F.when(kind == "error", "SQL_INJECTION").when(kind == "click", "PII_DETECTED").otherwise("NONE")
    return events.select(
        "event_id", (epoch_micros(F.col("ts")) * 1000).alias("ts_ns"), F.concat(F.lit("trace-"), F.col("event_id").cast("string")).alias("trace_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("client_id"), F.lit("10.0.0.1").alias("client_ip"),
        F.concat(F.lit("/api/"), kind).alias("route"), F.when(kind == "error", "BLOCKED").when(kind == "click", "MASKED").otherwise("ALLOWED").alias("action"),
        audit.audit_category(threat).alias("threat_category"), F.when(kind == "error", "CRITICAL").otherwise("LOW").alias("severity"),
        F.when(kind == "error", 1.0).when(kind == "click", 0.95).otherwise(0.0).alias("confidence"),
        F.when(kind == "error", "blocked by rule").otherwise("").alias("reason"), F.when(kind == "error", "sqli_union_select").otherwise("").alias("matched_rule"),
    )


def _chains(spark, folder) -> DataFrame:
    events = audit.assign_chains(_audit_events(spark, folder), "event_id", "ts_ns", WRITERS, ROTATION)
    return audit.build_chains(events, ["ts_ns", "event_id"])


@query
def audit_build(spark, folder):
    return _chains(spark, folder).select("event_id", "chain_id", "record_no", "prev_record_hash", "record_hash")


@query
def audit_checkpoints(spark, folder):
    """Checkpoints with a short interval, and the closing one of every chain."""
    marks = audit.checkpoints(_chains(spark, folder), interval=16)
    return marks.select("chain_id", "record_count", "tip_hash", "checkpoint_hash", F.col("closing").cast("bigint").alias("closing"))


@query
def audit_recover(spark, folder):
    parsed = audit_log.parse_lines(audit_log.log_lines(_chains(spark, folder)))
    return audit_log.recover_tips(parsed)


def _chained_events(spark, folder) -> DataFrame:
    return audit.assign_chains(_audit_events(spark, folder), "event_id", "ts_ns", WRITERS, ROTATION)


@query
def audit_append(spark, folder):
    """Logs written up to noon of each day, read, appended to from their tips, read again and verified."""
    events = _chained_events(spark, folder)
    path, order = shared_folder(spark, "audit-log"), ["ts_ns", "event_id"]
    morning = F.pmod("ts_ns", F.lit(86_400_000_000_000)) < 43_200_000_000_000
    audit_log.write_log(audit_lines.link_lines(events.where(morning), order), path, 0)
    audit_lines.append_log(spark, events.where(~morning), order, path)
    parsed = audit_log.parse_lines(audit_log.read_log(spark, path))
    verdicts = audit.verify_chains(parsed, block_rows=1 << 20).select("chain_id", "valid", "total_records", F.coalesce("reason", F.lit("")).alias("reason"))
    return verdicts.join(audit_log.recover_tips(parsed).select("chain_id", "tip_hash"), "chain_id")


@query
def audit_file_verify(spark, folder):
    """The tampered logs of ``audit_tampered``, through files."""
    path = shared_folder(spark, "audit-files")
    audit_log.write_log(_tampered_lines(_chains(spark, folder)), path)
    parsed = audit_log.parse_lines(audit_log.read_log(spark, path))
    return audit.verify_chains(parsed, block_rows=1 << 20).select("chain_id", "valid", "total_records", "broken_at_index", _kind("reason"))


@query
def audit_verify(spark, folder):
    parsed = audit_log.parse_lines(audit_lines.link_lines(_chained_events(spark, folder), ["ts_ns", "event_id"]))
    return audit.verify_chains(parsed).select("chain_id", "valid", "total_records", F.coalesce("reason", F.lit("")).alias("reason"))


def _kind(reason: str) -> Column:
    """The part of a reason before its first number."""
    return F.trim(F.regexp_extract(F.coalesce(reason, F.lit("")), r"^[^0-9:]*", 0)).alias("reason")


def _tampered_lines(chains: DataFrame) -> DataFrame:
    altered = chains.withColumn("action", F.when(F.pmod("event_id", F.lit(97)) == 0, "ALLOWED-X").otherwise(F.col("action")))
    kept = altered.where(F.pmod("event_id", F.lit(89)) != 0)
    lines = audit_log.record_lines(kept).unionByName(audit_log.checkpoint_lines(audit.checkpoints(chains)))
    return lines.withColumn("value", F.when(F.contains("value", F.lit('"trace_id":"trace-83')), F.substring("value", 1, 40)).otherwise(F.col("value")))


@query
def audit_tampered(spark, folder):
    """Logs in which some actions were changed, some records dropped and some lines broken."""
    broken = _tampered_lines(_chains(spark, folder))
    return audit.verify_chains(audit_log.parse_lines(broken)).select("chain_id", "valid", "total_records", "broken_at_index", _kind("reason"))


@query
def audit_truncated(spark, folder):
    """Logs whose tail is cut: the last record and the closing checkpoint of even writers are gone.

    Chains and parsed lines are kept in the shared folder: both are read several times, and each record is hashed once.
    """
    chains = written(_chains(spark, folder), "audit-chains")
    ends = audit.chain_tips(chains).select("chain_id", F.col("record_count").alias("_last"))
    cut = F.pmod("event_id", F.lit(2)) == 0
    kept = chains.join(ends, "chain_id").where(~(cut & (F.col("record_no") == F.col("_last")))).drop("_last")
    marks = audit.checkpoints(chains).where(~(F.substring_index("chain_id", "-", -1).cast("int") % 2 == 0))
    lines = audit_log.record_lines(kept).unionByName(audit_log.checkpoint_lines(marks))
    parsed = written(audit_log.parse_lines(lines), "audit-lines")
    strict = audit.verify_chains(parsed, True).select("chain_id", F.lit("strict").alias("mode"), "valid", "total_records", F.coalesce("reason", F.lit("")).alias("reason"))
    lenient = audit.verify_chains(parsed, False).select("chain_id", F.lit("lenient").alias("mode"), "valid", "total_records", F.coalesce("reason", F.lit("")).alias("reason"))
    return strict.unionByName(lenient)


# --- metrics ---------------------------------------------------------------------------------------------------

def _outcomes(spark, folder) -> DataFrame:
    events = _table(spark, folder, "events")
    kind, cents = F.col("event_type"), F.floor(F.col("value") * 100).cast("bigint")
    return events.select(
        "event_id", "ts", F.concat(F.lit("trace-"), F.col("event_id").cast("string")).alias("trace_id"), F.col("user_id").alias("client_id"),
        F.when(kind == "error", 403).when(kind == "signup", 502).otherwise(200).alias("status"),
        F.when(kind.isin("error", "signup"), "BLOCKED").when(kind == "click", "MASKED").otherwise("ALLOWED").alias("action"),
        F.when(kind == "error", "SQL_INJECTION").when(kind == "signup", "CANARY_LEAK").when(kind == "click", "PII_DETECTED").otherwise("NONE").alias("threat_category"),
        F.when(kind == "signup", "CRITICAL").when(kind == "error", F.when(F.pmod("user_id", F.lit(2)) == 0, "HIGH").otherwise("CRITICAL")).otherwise("MEDIUM").alias("severity"),
        cents.alias("waf_us"), (cents * 3).alias("guard_us"), (cents * 7 + 11).alias("proxy_us"),
    )


def _rounded(names, places=6) -> list[Column]:
    return [F.round(name, places).alias(name) for name in names]


_AVERAGES = [f"avg_{name}_ms" for name in metrics.COMPONENTS]


@query
def soc_counters(spark, folder):
    return metrics.counters(_outcomes(spark, folder))


@query
def threat_breakdown(spark, folder):
    return metrics.threat_breakdown(_outcomes(spark, folder))


@query
def threat_rollup(spark, folder):
    rolled = metrics.threat_severity_rollup(_outcomes(spark, folder))
    return rolled.select(F.coalesce("threat_category", F.lit("*")).alias("threat_category"), F.coalesce("severity", F.lit("*")).alias("severity"), F.col("level").cast("bigint").alias("level"), "n")


@query
def status_breakdown(spark, folder):
    return metrics.status_breakdown(_outcomes(spark, folder)).withColumn("status", F.col("status").cast("bigint"))


@query
def latency_avg(spark, folder):
    return metrics.latency_averages(_outcomes(spark, folder)).select(*_rounded(_AVERAGES, 9))


@query
def recent_events(spark, folder):
    recent = metrics.recent_events(_outcomes(spark, folder), ["ts", "trace_id"])
    return recent.select("trace_id", "client_id", "action", "threat_category", "severity")


@query
def metrics_snapshot(spark, folder):
    snap = metrics.snapshot(_outcomes(spark, folder), ["ts", "trace_id"], ["action", "threat_category"])
    entries = lambda name: F.array_join(F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ";").alias(name)
    return snap.select(
        "total", "allowed", "blocked", "masked", *_rounded(_AVERAGES, 9), entries("threat_breakdown"), entries("status_breakdown"),
        F.array_join(F.transform("recent_events", lambda e: e["trace_id"]), ",").alias("recent_traces"),
    )


@query
def metrics_export(spark, folder):
    lines = exposition.exposition_lines(metrics.long_form(_outcomes(spark, folder)))
    return lines.select(F.col("family").cast("bigint").alias("family"), F.col("part").cast("bigint").alias("part"), "key", "line")


@query
def rate_breaches(spark, folder):
    """Clients over a small per-minute quota, with a table of own quotas."""
    outcomes = _outcomes(spark, folder).withColumn("route_key", F.pmod("client_id", F.lit(3)))
    quotas = outcomes.select("route_key").distinct().where("route_key <> 2").withColumn("rate_limit", (F.col("route_key") + 1).cast("int"))
    found = metrics.rate_breaches(outcomes, "route_key", "ts", quotas, per_minute=1, burst=0)
    return found.select("route_key", F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "n", F.col("allowed").cast("bigint").alias("allowed"))


@query
def token_buckets(spark, folder):
    """Requests per known client, else per address, against quotas a day: two clients make half of all requests."""
    log = routing.client_ip(_log(spark, folder), "remote", "forwarded", plants.TRUSTED)
    known = routing.identify(log, _keys(spark), routing.presented_key(F.col("headers")))
    known = known.withColumn("client", buckets.client_key(F.col("identity.subject"), F.col("client_ip")))
    rate = F.when(F.col("identity.subject") == API_KEYS[0][1], 60).when(F.col("identity").isNull(), 20)
    judged = buckets.token_bucket(known, F.col("client"), "ts", "event_id", F.coalesce(rate, F.lit(40)), 5, period_seconds=86_400, block_ticks=256)
    return judged.select("event_id", "client", "admitted", F.col("tokens_left").cast("bigint").alias("tokens_left"))


# --- evaluation ------------------------------------------------------------------------------------------------

def _cases(spark, folder) -> DataFrame:
    """Labelled documents with the guard's raw verdict on their planted text; an attack is a planted attack."""
    documents = _documents(spark, folder, plants.PROMPTS).join(_table(spark, folder, "labels"), "doc_id")
    found = prompts.detect(documents, "text")
    number = F.pmod("doc_id", F.lit(len(plants.PROMPTS)))
    clean = list(plants.WELL_MEANT)
    detected = (F.col("injection.detected") & (F.col("injection.confidence") >= 0.7)) | F.col("jailbreak.detected")
    return found.select(
        "doc_id", "lang", "toxic", "quality", (~number.isin(*clean)).alias("is_attack"), detected.alias("detected"),
        F.when(F.col("injection.rule") != "", F.col("injection.rule")).otherwise(F.col("jailbreak.rule")).alias("rule"),
    )


_SCORES = ["block_rate", "fp_rate", "precision", "recall", "f1", "youden"]


@query
def detector_scores(spark, folder):
    scored = evaluation.score_by_category(_cases(spark, folder), "lang", "is_attack", "detected")
    return scored.select("lang", "tp", "fp", "tn", "fn", *_rounded(_SCORES))


@query
def score_overall(spark, folder):
    overall = evaluation.score_overall(_cases(spark, folder), "lang", "is_attack", "detected")
    return overall.select("average", "cases", *_rounded(["block_rate", "fp_rate", "f1", "youden"]))


@query
def gate_violations(spark, folder):
    scored = evaluation.score_by_category(_cases(spark, folder).withColumn("group", F.concat_ws("-", "lang", "quality")), "group", "is_attack", "detected")
    return evaluation.gate_violations(scored).select("group", "violation")


@query
def rating_bands(spark, folder):
    scored = evaluation.score_by_category(_cases(spark, folder), "lang", "is_attack", "detected")
    return scored.select("lang", evaluation.rating_band(F.col("youden")).alias("youden_band"), evaluation.rating_band(F.col("f1")).alias("f1_band"))


def _bypasses(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Missed attacks per language as bypasses with measured durations, and a baseline that differs from them.

    Both come from the missed attacks, which are kept in the shared folder, because each is read several times and the texts are scanned once.
    """
    path = shared_folder(spark, "missed-attacks")
    found = _cases(spark, folder).where("is_attack and not detected").select("doc_id", "lang")
    found.write.parquet(path)
    missed = spark.read.schema(found.schema).parquet(path)
    name = F.concat(F.lit("case "), F.pmod("doc_id", F.lit(50)).cast("string"))
    now = missed.select(F.col("lang").alias("harness"), F.concat(name, F.lit(" ("), F.col("doc_id").cast("string"), F.lit(".5ms)")).alias("name"))
    cases = missed.where("lang <> 'es'").where(F.pmod("doc_id", F.lit(7)) != 0)
    known = cases.select(F.col("lang").alias("harness"), name.alias("name")).distinct()
    limits = known.groupBy("harness").agg(F.count("*").cast("int").alias("max_bypasses"))
    return now, known.join(limits, "harness")


@query
def ratchet_diff(spark, folder):
    now, baseline = _bypasses(spark, folder)
    compared = evaluation.ratchet(now, baseline)
    return compared.select("harness", "bypassed", "new", "fixed", F.coalesce("allowed", F.lit(-1)).cast("bigint").alias("allowed"), "status")


@query
def ratchet_cases(spark, folder):
    now, baseline = _bypasses(spark, folder)
    return evaluation.ratchet_cases(now, baseline)


@query
def false_positive_report(spark, folder):
    return evaluation.false_positives(_cases(spark, folder).withColumn("is_attack", F.col("toxic") == 1), "is_attack", "rule")


@query
def shielded_comparison(spark, folder):
    """Models given by nation with assumed defences, next to the measured shielded rates."""
    nation = _table(spark, folder, "nation")
    key = F.col("n_nationkey")
    models = nation.select(
        F.col("n_name").alias("model"), (0.7 + key / 100).alias("native_pi_defense"), (0.6 + key / 100).alias("native_jb_defense"), (key * 20 + 100).cast("double").alias("avg_base_latency_ms")
    )
    compared = evaluation.with_overhead(evaluation.shielded_comparison(models, _cases(spark, folder), "is_attack", "detected"), 0.00903)
    return compared.select("model", *_rounded(["native_defense", "shielded_defense", "fp_rate", "f1_score", "uplift", "total_latency_ms", "overhead_pct"]))


# --- streams ---------------------------------------------------------------------------------------------------

def _table_stream(spark, folder, name: str) -> DataFrame:
    """A table as a file stream, whether it is one file or a folder of them; the source takes a single file by a pattern only."""
    return spark.readStream.schema(_table(spark, folder, name).schema).parquet(f"{folder}/{{{name}}}.parquet")


def _event_stream(spark, folder) -> DataFrame:
    stream = _table_stream(spark, folder, "events")
    return stream.withColumn("ts", F.timestamp_micros(epoch_micros(F.col("ts"))))


def _run(spark, frame: DataFrame, mode: str, purpose: str, each=None) -> str:
    """Run a stream over all available data into the shared folder, and return where its result lies."""
    target = shared_folder(spark, purpose)
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{target}/progress").trigger(availableNow=True)
    if each is None:
        writer = writer.format("parquet").option("path", f"{target}/rows")
    else:
        writer = writer.foreachBatch(each(f"{target}/rows"))
    writer.start().awaitTermination()
    return f"{target}/rows"


def _run_stateful(spark, frame: DataFrame, purpose: str) -> str:
    """Run a stream with processors of its own, which need the store that keeps state out of the heap."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, SETTINGS[name])
    try:
        return _run(spark, frame, "append", purpose)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _turn_stream(spark, folder, texts) -> DataFrame:
    stream = _table_stream(spark, folder, "conversations")
    return stream.withColumn("text", F.concat("text", plants.planted(F.col("conv_id") + F.col("turn"), texts)))


def _replace(path: str):
    """foreachBatch function for complete mode: each batch is the whole result so far."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(path)


def _stream_outcomes(stream: DataFrame) -> DataFrame:
    kind, cents = F.col("event_type"), F.floor(F.col("value") * 100).cast("bigint")
    return stream.select(
        "event_id", "ts", F.concat(F.lit("trace-"), F.col("event_id").cast("string")).alias("trace_id"),
        F.when(kind.isin("error", "signup"), "BLOCKED").when(kind == "click", "MASKED").otherwise("ALLOWED").alias("action"),
        F.when(kind == "error", "SQL_INJECTION").when(kind == "signup", "CANARY_LEAK").when(kind == "click", "PII_DETECTED").otherwise("NONE").alias("threat_category"),
        cents.alias("waf_us"), (cents * 3).alias("guard_us"), (cents * 7 + 11).alias("proxy_us"),
    )


@query
def stream_metrics(spark, folder):
    windowed = jobs.windowed_metrics(_stream_outcomes(_event_stream(spark, folder)), "ts", "1 day")
    flat = windowed.select(F.unix_seconds("window.start").alias("start_s"), "total", "allowed", "blocked", "masked", *_rounded(_AVERAGES, 9))
    return spark.read.parquet(_run(spark, flat, "complete", "stream-metrics", _replace))


@query
def stream_sliding_metrics(spark, folder):
    windowed = jobs.windowed_metrics(_stream_outcomes(_event_stream(spark, folder)), "ts", "2 days", "1 day", "10 minutes", "action")
    flat = windowed.select(F.unix_seconds("window.start").alias("start_s"), "action", "total", *_rounded(_AVERAGES, 9))
    return spark.read.parquet(_run(spark, flat, "complete", "stream-sliding", _replace))


@query
def stream_recent(spark, folder):
    stream = _stream_outcomes(_event_stream(spark, folder))
    path = _run(spark, stream, "append", "stream-recent", lambda rows: jobs.keep_recent(rows, ["ts", "trace_id"]))
    batches = spark.read.parquet(path)
    latest = batches.agg(F.max("batch").alias("batch"))
    return batches.join(latest, "batch").select("trace_id", "action", "threat_category")


@query
def stream_audit(spark, folder):
    stream = _event_stream(spark, folder)
    events = audit.assign_chains(
        stream.select(
            "event_id", (F.unix_micros("ts") * 1000).alias("ts_ns"), F.concat(F.lit("trace-"), F.col("event_id").cast("string")).alias("trace_id"),
            F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("client_id"), F.lit("10.0.0.1").alias("client_ip"),
            F.concat(F.lit("/api/"), F.col("event_type")).alias("route"), F.lit("ALLOWED").alias("action"), F.lit("NONE").alias("threat_category"),
            F.lit("LOW").alias("severity"), F.lit(0.0).alias("confidence"), F.lit("").alias("reason"), F.lit("").alias("matched_rule"),
        ),
        "event_id", "ts_ns", WRITERS, ROTATION,
    )
    rows = spark.read.parquet(_run_stateful(spark, jobs.chain_stream(events), "stream-audit"))
    return rows.where("kind = 'RECORD'").select("event_id", "chain_id", "record_no", "record_hash")


@query
def stream_distinct_traces(spark, folder):
    """Repeated trace ids (a user's events within the watermark) dropped; each user's first event always stays."""
    stream = _stream_outcomes(_event_stream(spark, folder)).withColumn("trace_id", F.concat("trace_id", F.lit("-x")))
    kept = jobs.drop_repeated_traces(stream.unionByName(stream), "trace_id", "ts")
    return spark.read.parquet(_run(spark, kept.select("event_id", "trace_id", "action"), "append", "stream-distinct"))


@query
def stream_guard(spark, folder):
    """Conversations as a stream through the guard."""
    decided = jobs.guard_stream(_turn_stream(spark, folder, plants.PROMPTS), "text").select("conv_id", "turn", "decision.allowed", "decision.threat_type", "decision.risk_level")
    return spark.read.parquet(_run(spark, decided, "append", "stream-guard"))


@query
def stream_canary(spark, folder):
    """Places of tokens in a stream of chunks, the last characters of each response kept as state."""
    found = responses.canary_stream(_chunks(_turn_stream(spark, folder, plants.LEAKS)), ["conv_id", "turn"], "chunk_no", "text", plants.TOKENS)
    return spark.read.parquet(_run_stateful(spark, found, "stream-canary"))


@query
def stream_vault(spark, folder):
    """Turns masked reversibly as a stream."""
    masked = responses.mask_reversibly_stream(_turn_stream(spark, folder, plants.VAULT))
    return spark.read.parquet(_run_stateful(spark, masked, "stream-vault")).select("conv_id", "turn", "masked")
