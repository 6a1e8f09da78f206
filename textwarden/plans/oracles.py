"""ANSI SQL (DuckDB dialect) that computes the registered queries independently on the same tables."""

from __future__ import annotations

import re

from textwarden import fixed_values as fv
from textwarden.functions.text import _PYTHON_SPACES
from textwarden.plans import plants
from textwarden.plans.plants import planted_sql, quoted
from textwarden.plans.queries import API_KEYS, ROTATION, ROUTES, WRITERS

ORACLES: dict[str, str] = {}
SPACES = quoted(_PYTHON_SPACES)
_EDGE_L, _EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def q(text: str) -> str:
    return quoted(text)


def docs(texts) -> str:
    return f"(SELECT doc_id, lang, source, n_chars, text || {planted_sql('doc_id', texts)} AS text FROM documents)"


def turns(texts) -> str:
    return f"(SELECT conv_id, turn, role, text || {planted_sql('conv_id + turn', texts)} AS text FROM conversations)"


# --- personal data ---------------------------------------------------------------------------------------------

def _form(text: str, invisible: str) -> str:
    # The only characters of the test data and plants that compatibility composition changes: Thai SARA AM.
    composed = f"replace({text}, {q(chr(0x0E33))}, {q(chr(0x0E4D) + chr(0x0E32))})"
    plain = f"regexp_replace(translate({composed}, {q(fv.ROMAN_NUMERALS)}, {q(fv.ROMAN_DIGITS)}), {q(invisible)}, '', 'g')"
    return f"regexp_replace({plain}, {q(r'(\bsk-[A-Za-z0-9_-]{10,64})\s+([^A-Za-z0-9_-]|$)')}, {q(r'\1\2')}, 'g')"


def _replace(text: str, label: str, pattern: str, placeholder: str) -> str:
    if label == "CREDIT_CARD" and "(?<!" in pattern:
        edged = _EDGE_L + r"(?:[0-9][ -]?){11,18}[0-9]" + _EDGE_R
        target = rf"\1{placeholder}\2"
    elif label == "PHONE":
        thai = r"(?:\+66|0)[-.\s]?[2689][-.\s]?[0-9][-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"
        other = r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"
        edged = f"{_EDGE_L}{thai}{_EDGE_R}|(^|[^\\p{{L}}\\p{{N}}_+]){other}{_EDGE_R}"
        target = rf"\1\3{placeholder}\2\4"
    else:
        return f"regexp_replace({text}, {q(pattern)}, {q(placeholder)}, 'g')"
    once = f"regexp_replace({text}, {q(edged)}, {q(target)}, 'g')"
    return f"regexp_replace({once}, {q(edged)}, {q(target)}, 'g')"


def masked_sql(source: str, keys: str, rules=fv.PII_RULES, invisible=f"[{fv.PII_INVISIBLES}]") -> str:
    """(keys, original, masked, n_<type>...) over a source with a text column."""
    ctes = [f"m0 AS (SELECT {keys}, text AS original, {_form('text', invisible)} AS t FROM {source})"]
    names = []
    for n, (label, pattern, placeholder) in enumerate(rules):
        new = _replace("t", label, pattern, placeholder)
        count = f"CAST((length(t2) - length(replace(t2, {q(placeholder)}, ''))) / {len(placeholder)} AS BIGINT)"
        carried = "".join(f", {name}" for name in names)
        names.append(f"n_{label.lower()}")
        ctes.append(
            f"m{n + 1} AS (SELECT {keys}, original{carried}, {count} AS {names[-1]}, t2 AS t FROM (SELECT *, {new} AS t2 FROM m{n}))"
        )
    return f"(WITH {', '.join(ctes)} SELECT {keys}, original, t AS masked, {', '.join(names)} FROM m{len(rules)})"


_N = [f"n_{label.lower()}" for label, *_ in fv.PII_RULES]
_DOC_MASK = masked_sql(docs(plants.PII), "doc_id, lang")
_UNPIVOT = " UNION ALL ".join(
    f"SELECT doc_id, lang, {q(label)} AS entity, n_{label.lower()} AS hits, {n} AS place FROM masked WHERE n_{label.lower()} > 0"
    for n, (label, *_) in enumerate(fv.PII_RULES)
)
ORACLES["pii_corpus_mask"] = f"SELECT doc_id, masked, {', '.join(_N)} FROM {_DOC_MASK}"
_ENT = f"WITH masked AS (SELECT * FROM {_DOC_MASK}), e AS ({_UNPIVOT})"
ORACLES["pii_entity_rollup"] = f"{_ENT} SELECT entity, count(*) AS texts, CAST(sum(hits) AS BIGINT) AS hits FROM e GROUP BY 1"
ORACLES["pii_by_language"] = f"{_ENT} SELECT lang, entity, count(*) AS texts, CAST(sum(hits) AS BIGINT) AS hits FROM e GROUP BY 1, 2"
ORACLES["pii_inventory"] = f"{_ENT} SELECT doc_id, string_agg(entity, ',' ORDER BY place) AS types FROM e GROUP BY 1"
ORACLES["pii_conversation_mask"] = (
    f"SELECT conv_id, turn, role, masked, CASE WHEN masked <> original THEN 'MASKED' ELSE 'ALLOWED' END AS action "
    f"FROM {masked_sql(turns(plants.PII), 'conv_id, turn, role')}"
)
_ZERO = "[​-‍﻿­‎‏‪-‮⁠-⁤᠎͏]"
_SDK_TYPES = ", ".join(f"CASE WHEN n_{label.lower()} > 0 THEN {q(label)} END" for label, *_ in fv.SDK_PII_RULES)
ORACLES["pii_sdk_mask"] = (
    f"SELECT doc_id, masked, concat_ws(',', {_SDK_TYPES}) AS types FROM {masked_sql(docs(plants.PII), 'doc_id', fv.SDK_PII_RULES, _ZERO)}"
)


# --- prompt guard ----------------------------------------------------------------------------------------------

_INJECTION = [f"(?sm){p}" for p in fv.INJECTION_PATTERNS] + [fv.DELIMITER_PATTERN]
_JAILBREAK = [f"(?sm){p}" for p in fv.JAILBREAK_PATTERNS]


def number_sql(text: str, patterns) -> str:
    arms = " ".join(f"WHEN regexp_matches({text}, {q(p)}) THEN {n}" for n, p in enumerate(patterns, start=1))
    return f"(CASE {arms} END)"


def sample_sql(text: str, number: str, patterns) -> str:
    arms = " ".join(f"WHEN {n} THEN regexp_extract({text}, {q(p)}, 0)" for n, p in enumerate(patterns, start=1))
    return f"(CASE {number} {arms} END)"


def verdict_sql(source: str, keys: str, kind: str, text: str = "text") -> str:
    """Verdict of the raw and boundary-free readings: keys, detected, confidence, rule, matched_sample, reason."""
    patterns, lead, clean = (
        (_INJECTION, fv.INJECTION_REASON, "clean prompt") if kind == "pi" else (_JAILBREAK, fv.JAILBREAK_REASON, "safe prompt")
    )
    glued = f"replace(replace(c, {q(fv.TURN_SEPARATOR)}, ''), {q(fv.TURN_MARK)}, '')"
    spaced = f"replace(replace(c, {q(fv.TURN_SEPARATOR)}, ' '), {q(fv.TURN_MARK)}, ' ')"
    delimiter = str(len(_INJECTION)) if kind == "pi" else "-1"
    oversize = f"n IS NULL AND length(o) > {fv.MAX_PROMPT_CHARS}" if kind == "pi" else "false"
    return f"""(
      WITH a AS (SELECT {keys}, {text} AS o, trim({text}, {SPACES}) AS c FROM {source}),
      b AS (SELECT *, {number_sql('c', patterns)} AS n1, {glued} AS g, {spaced} AS s FROM a),
      d AS (SELECT *, CASE WHEN n1 IS NULL AND g <> c THEN {number_sql('g', patterns)} END AS n2 FROM b),
      e AS (SELECT *, CASE WHEN n1 IS NULL AND n2 IS NULL AND s <> c THEN {number_sql('s', patterns)} END AS n3 FROM d),
      f AS (SELECT *, coalesce(n1, n2, n3) AS n, CASE WHEN n1 IS NOT NULL THEN c WHEN n2 IS NOT NULL THEN g ELSE s END AS t,
        CASE WHEN n1 IS NOT NULL THEN '' WHEN n2 IS NOT NULL THEN ' [via {fv.BOUNDARY_LABELS[0]}]'
             WHEN n3 IS NOT NULL THEN ' [via {fv.BOUNDARY_LABELS[1]}]' ELSE '' END AS via FROM e),
      h AS (SELECT *, {sample_sql('t', 'n', patterns)} AS m FROM f)
      SELECT {keys}, o AS original,
        CASE WHEN c = '' THEN false WHEN {oversize} THEN true ELSE n IS NOT NULL END AS detected,
        CASE WHEN c = '' THEN 0.0::DOUBLE WHEN {oversize} THEN {fv.OVERSIZE_CONFIDENCE}::DOUBLE WHEN n = {delimiter} THEN {fv.DELIMITER_CONFIDENCE}::DOUBLE
             WHEN n IS NOT NULL THEN {fv.INJECTION_CONFIDENCE}::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
        CASE WHEN c = '' THEN '' WHEN {oversize} THEN 'pi_oversize' WHEN n = {delimiter} THEN 'pi_delimiter_escape'
             WHEN n IS NOT NULL THEN '{kind}_rule_' || n ELSE '' END AS rule,
        CASE WHEN c = '' THEN '' WHEN {oversize} THEN left(o, 80) WHEN n = {delimiter} THEN left(t, 80) WHEN n IS NOT NULL THEN left(m, 80) ELSE '' END AS matched_sample,
        CASE WHEN c = '' THEN '' WHEN {oversize} THEN 'Prompt exceeds max length (' || length(o) || ' > {fv.MAX_PROMPT_CHARS}) — possible DoS/obfuscation'
             WHEN n = {delimiter} THEN {q(fv.DELIMITER_REASON)} || via
             WHEN n IS NOT NULL THEN {q(lead)} || left(m, 40) || '...)' || via ELSE {q(clean)} END AS reason
      FROM h)"""


_FIELDS = "detected, confidence, rule, matched_sample, reason"
ORACLES["prompt_injection_scan"] = f"SELECT doc_id, {_FIELDS} FROM {verdict_sql(docs(plants.PROMPTS), 'doc_id', 'pi')}"
ORACLES["jailbreak_scan"] = f"SELECT doc_id, {_FIELDS} FROM {verdict_sql(docs(plants.PROMPTS), 'doc_id', 'jb')}"
ORACLES["oversize_prompts"] = (
    f"SELECT doc_id, n_chars, reason FROM {verdict_sql(docs(plants.PROMPTS), 'doc_id, n_chars', 'pi')} WHERE rule = 'pi_oversize'"
)
_PLACE = "conv_id * 3 + turn"
_SPLIT = (
    f"(SELECT conv_id, turn, {planted_sql(f'{_PLACE} + {len(plants.TURN_FRONTS) - 1}', plants.TURN_FRONTS)} || text || {planted_sql(_PLACE, plants.TURN_ENDS)} AS text FROM conversations)"
)
_JOINED = (
    f"(SELECT conv_id, string_agg(text, {q(fv.TURN_SEPARATOR)} ORDER BY turn) AS text FROM {_SPLIT} GROUP BY 1)"
)
ORACLES["cross_turn_injection"] = (
    f"SELECT conv_id, i.rule AS injection_rule, i.reason AS injection_reason, j.rule AS jailbreak_rule, j.reason AS jailbreak_reason "
    f"FROM {verdict_sql(_JOINED, 'conv_id', 'pi')} i JOIN {verdict_sql(_JOINED, 'conv_id', 'jb')} j USING (conv_id) "
    f"WHERE i.detected OR j.detected"
)


def decision_sql(source: str, keys: str, threshold="0.7", pi_on="true", jb_on="true", pii_on="true") -> str:
    """Decision cascade over a source with keys, role and text."""
    listed = ", ".join(f"CASE WHEN n_{label.lower()} > 0 THEN {q(label)} END" for label, *_ in fv.PII_RULES)
    return f"""(
      WITH i AS (SELECT * FROM {verdict_sql(source, keys, 'pi')}), j AS (SELECT * FROM {verdict_sql(source, keys, 'jb')}),
      p AS (SELECT *, concat_ws(''', ''', {listed}) AS types FROM {masked_sql(source, keys)}),
      k AS (SELECT {keys}, i.original, p.masked, p.types, {pi_on} AND i.detected AND i.confidence >= {threshold} AS bi, i.confidence AS ci, i.reason AS ri,
        {jb_on} AND j.detected AND j.confidence >= {threshold} AS bj, j.confidence AS cj, j.reason AS rj, {pii_on} AND p.types <> '' AS bp
        FROM i JOIN j USING ({keys}) JOIN p USING ({keys}))
      SELECT {keys}, NOT (bi OR bj) AS allowed, CASE WHEN NOT bi AND NOT bj AND bp THEN masked ELSE original END AS sanitized_prompt,
        CASE WHEN bi THEN 'PROMPT_INJECTION' WHEN bj THEN 'JAILBREAK' WHEN bp THEN 'PII_DETECTED' ELSE 'NONE' END AS threat_type,
        CASE WHEN bi THEN 'CRITICAL' WHEN bj THEN 'HIGH' WHEN bp THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
        CASE WHEN bi THEN ci WHEN bj THEN cj WHEN bp THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
        CASE WHEN bi THEN ri WHEN bj THEN rj WHEN bp THEN 'Masked sensitive PII entities: [''' || types || ''']' ELSE 'request passed guardrails' END AS reason
      FROM k)"""


_PTURNS = turns(plants.PROMPTS)
_CT = "conv_id, turn, role"
ORACLES["guard_decision"] = (
    f"SELECT conv_id, turn, allowed, sanitized_prompt, threat_type, risk_level, confidence, reason FROM {decision_sql(_PTURNS, _CT)}"
)
_SWITCHED = decision_sql(
    _PTURNS, _CT, "(CASE WHEN role = 'assistant' THEN 0.9 ELSE 0.7 END)", "role <> 'system'", "role = 'user'", "role <> 'assistant'"
)
ORACLES["guard_policy_switches"] = (
    f"SELECT role, threat_type, count(*) AS n, count(*) FILTER (WHERE NOT allowed) AS blocked FROM {_SWITCHED} GROUP BY 1, 2"
)
ORACLES["risk_levels"] = f"""
  WITH i AS (SELECT * FROM {verdict_sql(_PTURNS, _CT, 'pi')}), j AS (SELECT * FROM {verdict_sql(_PTURNS, _CT, 'jb')}),
  k AS (SELECT conv_id, turn, CASE WHEN i.detected THEN 'PROMPT_INJECTION' WHEN j.detected THEN 'JAILBREAK' ELSE 'NONE' END AS threat_category,
    CAST(CASE WHEN i.detected THEN round(i.confidence * 100) WHEN j.detected THEN round(j.confidence * 100)
      WHEN trim(i.original, {SPACES}) = '' THEN 0 ELSE 5 END AS BIGINT) AS risk_score
    FROM i JOIN j USING (conv_id, turn))
  SELECT conv_id, turn, threat_category, risk_score, CASE WHEN risk_score >= 90 THEN 'CRITICAL' WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    CASE WHEN threat_category = 'NONE' THEN 'PASS' ELSE 'BLOCK' END AS suggested_action,
    CASE threat_category WHEN 'PROMPT_INJECTION' THEN {q(fv.JUDGE_STANDARD_CODE['PROMPT_INJECTION'])} WHEN 'JAILBREAK' THEN {q(fv.JUDGE_STANDARD_CODE['JAILBREAK'])} ELSE 'NONE' END AS standard_code
  FROM k"""
ORACLES["guard_fallback"] = f"""
  WITH d AS (SELECT * FROM {decision_sql(_PTURNS, _CT)}), m AS (SELECT unnest(['BLOCK', 'ALLOW']) AS mode),
  r AS (SELECT mode, role, CASE WHEN role = 'system' THEN 'GUARD_UNAVAILABLE' ELSE threat_type END AS threat_type,
    CASE WHEN role = 'system' THEN mode = 'ALLOW' ELSE allowed END AS ok,
    CASE WHEN role = 'system' THEN (CASE WHEN mode = 'ALLOW' THEN 200 ELSE 502 END) WHEN NOT allowed THEN 403 ELSE 200 END AS status FROM d, m)
  SELECT mode, role, threat_type, count(*) AS n, count(*) FILTER (WHERE ok) AS allowed, CAST(sum(status) AS BIGINT) AS status_sum FROM r GROUP BY 1, 2, 3"""

_SDK_RULES = [
    (threat, *rule)
    for threat, rules in (
        ("COMMAND_INJECTION", fv.SDK_COMMAND_RULES), ("PATH_TRAVERSAL", fv.SDK_PATH_RULES), ("SQL_INJECTION", fv.SDK_SQL_RULES), ("XSS", fv.SDK_XSS_RULES),
    )
    for rule in rules
]


def _sdk(text: str, place: int, otherwise: str = "''") -> str:
    arms = " ".join(f"WHEN regexp_matches({text}, {q(rule[3])}) THEN {q(rule[place])}" for rule in _SDK_RULES)
    return f"(CASE {arms} ELSE {otherwise} END)"


_SDK_PI = list(fv.INJECTION_PATTERNS[: fv.SDK_INJECTION_COUNT])
_SDK_JB = [*fv.JAILBREAK_PATTERNS[:8], fv.SDK_JAILBREAK_RULE_9, *fv.JAILBREAK_PATTERNS[9:]]
ORACLES["sdk_guard_decision"] = f"""
  WITH p AS (SELECT * FROM {masked_sql(_PTURNS, _CT, fv.SDK_PII_RULES, _ZERO)}),
  k AS (SELECT *, {_sdk('original', 0)} AS w, {_sdk('original', 2)} AS wc, {number_sql('original', _SDK_PI)} IS NOT NULL AS i,
    {number_sql('original', _SDK_JB)} IS NOT NULL AS j FROM p)
  SELECT conv_id, turn, w <> '' OR i OR j AS is_blocked, CASE WHEN w <> '' THEN w WHEN i THEN 'PROMPT_INJECTION' WHEN j THEN 'JAILBREAK' ELSE 'NONE' END AS threat_category,
    CASE WHEN w <> '' THEN wc WHEN i THEN {q(fv.JUDGE_STANDARD_CODE['PROMPT_INJECTION'])} WHEN j THEN {q(fv.JUDGE_STANDARD_CODE['JAILBREAK'])} ELSE '' END AS standard_code,
    CASE WHEN w <> '' THEN 1.0::DOUBLE WHEN i OR j THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
    CASE WHEN NOT (w <> '' OR i OR j) THEN masked END AS masked_text,
    NOT (w <> '' OR i OR j) AND ({' OR '.join(f'n_{label.lower()} > 0' for label, *_ in fv.SDK_PII_RULES)}) AS has_pii
  FROM k"""


# --- requests --------------------------------------------------------------------------------------------------

_URLQ = r"regexp_extract(url, '\?([^#]*)', 1)"
_PLANTED_Q = planted_sql("page_id", plants.QUERIES)
PAGES = f"""(SELECT page_id, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path,
  CASE WHEN {_PLANTED_Q} = '' THEN {_URLQ} WHEN {_URLQ} = '' THEN {_PLANTED_Q} ELSE {_URLQ} || '&' || {_PLANTED_Q} END AS query,
  {planted_sql('page_id', plants.COOKIES)} AS cookie, 'Mozilla/5.0 (X11; Linux x86_64)' AS agent, {planted_sql('page_id', plants.BODIES)} AS body FROM pages)"""


def decoded_sql(text: str, rounds: int = 3) -> str:
    for _ in range(rounds):
        text = f"(CASE WHEN regexp_matches({text}, '%([^0-9a-fA-F]|$|[0-9a-fA-F]([^0-9a-fA-F]|$))') THEN {text} ELSE url_decode(replace({text}, '+', ' ')) END)"
    # The entities of the planted queries; '&not' counts without a semicolon.
    return f"replace(replace(replace({text}, '&lt;', '<'), '&gt;', '>'), '&not', '¬')"


def comments_sql(text: str, around: str = " ", instead: str = " ") -> str:
    opened = f"regexp_replace({text}, {q(r'/\*![0-9]*(.*?)\*/')}, {q(rf'{around}\1{around}')}, 'g')"
    return f"regexp_replace({opened}, {q(r'/\*.*?\*/')}, {q(instead)}, 'g')"


def compact_sql(decoded: str) -> str:
    joined = comments_sql(decoded, "", "")
    for _ in range(2):
        joined = f"regexp_replace({joined}, '([A-Za-z0-9_])[\t\r\n]([A-Za-z0-9_])', {q(r'\1\2')}, 'g')"
    return f"translate({joined}, '\t\r\n', '   ')"


_RULES = {
    "PT": fv.PATH_TRAVERSAL_RULES, "CMD": fv.COMMAND_RULES, "STRICT": fv.STRICT_COMMAND_RULES, "COMPACT": fv.COMPACT_SQL_RULES, "SQL": fv.SQL_RULES, "XSS": fv.XSS_RULES,
}
_GATES = {"PT": fv.PATH_TRAVERSAL_GATE, "CMD": fv.COMMAND_GATE, "STRICT": fv.STRICT_COMMAND_GATE, "COMPACT": (), "XSS": fv.XSS_GATE}


def _matches(text: str, patterns) -> str:
    return " AND ".join(f"regexp_matches({text}, {q(p)})" for p in patterns) or "true"


def rule_sql(text: str, *families: str) -> str:
    parts = []
    for family in families:
        arms = " ".join(f"WHEN regexp_matches({text}, {q(rule[3])}) THEN {q(rule[0])}" for rule in _RULES[family])
        if family == "SQL":
            a, b = fv.SQL_GATE
            gate = f"{_matches(text, [a])} AND ({_matches(text, [b])} OR ({_matches(text, fv.SQL_COMPARISON_GATE)}))"
        else:
            gate = _matches(text, _GATES[family])
        parts.append(f"(CASE WHEN {gate} THEN (CASE {arms} END) END)")
    return f"coalesce({', '.join(parts)})" if len(parts) > 1 else parts[0]


_ALL_RULES = [rule for rules in _RULES.values() for rule in rules]
_CATEGORY = {rule[0]: {"PT": "PATH_TRAVERSAL", "CMD": "CMD_INJECTION", "STRICT": "CMD_INJECTION", "COMPACT": "SQL_INJECTION", "SQL": "SQL_INJECTION", "XSS": "XSS"}[family] for family, rules in _RULES.items() for rule in rules}


def _of_rule(rule: str, values: dict[str, str], otherwise: str) -> str:
    arms = " ".join(f"WHEN {q(name)} THEN {q(value)}" for name, value in values.items())
    return f"(CASE {rule} {arms} ELSE {q(otherwise)} END)"


# The signature lists as one SQL list each, to read the sample again by rule name.
_SAMPLE_ARMS = " ".join(f"WHEN {q(rule[0])} THEN regexp_extract(text, {q(rule[3])}, 0)" for rule in _ALL_RULES)
_CANDIDATE = f"contains(query, '&') AND regexp_matches(query, {q(fv.POLLUTION_MARK)})"
_VALUE = f"CASE WHEN contains(p, '=') THEN regexp_replace(p, '^[^=]*=', '') ELSE p END"
_VALUES = (
    f"list_filter(list_transform(list_transform(string_split(query, '&'), lambda p: {_VALUE}), lambda v: {comments_sql(decoded_sql('v', 2))}), lambda v: v <> '')"
)


def scan_sql(source: str, key: str, categories=("PT", "CMD", "SQL", "XSS")) -> str:
    """(key, rule, surface, text) of the first hit by category order and surface order, one row per key."""
    orders = {
        "PT": ["path", "query", "value", "body", "header"], "CMD": ["path", "query", "value", "header", "body"],
        "SQL": ["path", "path_c", "query", "query_c", "value", "body", "body_c", "header", "header_c"], "XSS": ["path", "query", "value", "body", "header"],
    }
    ranks = []
    for number, category in enumerate(categories):
        for place, kind in enumerate(orders[category]):
            if category == "CMD":
                families = ("CMD",) if kind == "body" else ("CMD", "STRICT")
            elif category == "SQL":
                families = ("COMPACT", "SQL") if kind.endswith("_c") else ("SQL",)
            else:
                families = (category,)
            ranks.append(
                f"SELECT {key}, {number * 100 + place} AS major, pos, {q(kind.split('_')[0])} AS surface, text, {rule_sql('text', *families)} AS rule FROM s WHERE kind = {q(kind)}"
            )
    spaced = lambda column: comments_sql(f"d_{column}")
    needs = lambda column: f"regexp_matches({column}, '/\\*|[\t\r\n]')"
    return f"""(
      WITH r AS (SELECT *, {decoded_sql('path')} AS d_path, {decoded_sql('query')} AS d_query, {decoded_sql('body')} AS d_body, {decoded_sql('cookie')} AS d_cookie, {decoded_sql('agent')} AS d_agent,
        CASE WHEN {_CANDIDATE} THEN {_VALUES} ELSE [] END AS vals FROM {source}),
      v AS (SELECT *, CASE WHEN len(vals) < 2 THEN vals ELSE list_append(vals, array_to_string(vals, '')) END AS values_ FROM r),
      s AS (
        SELECT {key}, 'path' AS kind, 0 AS pos, {spaced('path')} AS text FROM v UNION ALL SELECT {key}, 'query', 0, {spaced('query')} FROM v
        UNION ALL SELECT {key}, 'body', 0, {spaced('body')} FROM v UNION ALL SELECT {key}, 'header', 0, {spaced('cookie')} FROM v UNION ALL SELECT {key}, 'header', 1, {spaced('agent')} FROM v
        UNION ALL SELECT {key}, 'value', i, values_[i] FROM (SELECT {key}, values_, unnest(range(1, len(values_) + 1)) AS i FROM v)
        UNION ALL SELECT {key}, 'query_c', 0, {compact_sql('d_query')} FROM v WHERE {needs('query')} AND {compact_sql('d_query')} <> {spaced('query')}
        UNION ALL SELECT {key}, 'body_c', 0, {compact_sql('d_body')} FROM v WHERE {needs('body')} AND {compact_sql('d_body')} <> {spaced('body')}
        UNION ALL SELECT {key}, 'header_c', 0, {compact_sql('d_cookie')} FROM v WHERE {needs('cookie')}),
      hits AS ({' UNION ALL '.join(ranks)}),
      f AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY major, pos) AS nth FROM hits WHERE rule IS NOT NULL)
      SELECT k.{key}, f.rule, f.surface, f.text FROM {source} k LEFT JOIN (SELECT * FROM f WHERE nth = 1) f USING ({key}))"""


_SEVERITY = {rule[0]: rule[1] for rule in _ALL_RULES}
_REASON = {rule[0]: rule[2] for rule in _ALL_RULES}
_SCAN = scan_sql(PAGES, "page_id")
ORACLES["request_threat_scan"] = f"""
  WITH h AS (SELECT *, trim(CASE rule {_SAMPLE_ARMS} END, {SPACES}) AS m FROM {_SCAN})
  SELECT page_id, rule IS NOT NULL AS blocked, {_of_rule('rule', _CATEGORY, 'NONE')} AS threat_type, {_of_rule('rule', _SEVERITY, 'LOW')} AS severity,
    {_of_rule('rule', _REASON, 'payload verified clean')} AS reason, coalesce(rule, '') AS matched_rule,
    coalesce(CASE WHEN length(m) > 50 THEN left(m, 50) || '...' ELSE m END, '') AS matched_sample, coalesce(surface, '') AS surface FROM h"""
ORACLES["surface_breakdown"] = (
    f"SELECT surface, {_of_rule('rule', _CATEGORY, 'NONE')} AS threat_type, {_of_rule('rule', _SEVERITY, 'LOW')} AS severity, count(*) AS n FROM {_SCAN} WHERE rule IS NOT NULL GROUP BY 1, 2, 3"
)
ORACLES["request_scan_switches"] = (
    f"SELECT coalesce(rule, '') AS matched_rule, count(*) AS n FROM {scan_sql(PAGES, 'page_id', ('SQL', 'XSS'))} GROUP BY 1"
)
ORACLES["pollution_views"] = (
    f"SELECT page_id, len(v) AS n_values, array_to_string(v, '') AS joined, array_to_string(v, '|') AS listed FROM (SELECT page_id, {_VALUES} AS v FROM {PAGES} WHERE {_CANDIDATE})"
)
_URI = f"(SELECT page_id, path || '?' || query AS path, query, cookie, agent, '' AS body FROM {PAGES} WHERE contains(path || '?' || query, '..'))"
ORACLES["early_traversal"] = (
    f"SELECT page_id, {_of_rule('rule', _CATEGORY, 'NONE')} AS threat_type, rule AS matched_rule FROM {scan_sql(_URI, 'page_id')} WHERE rule IS NOT NULL"
)
ORACLES["html_rule_report"] = "SELECT count(*) AS pages, " + ", ".join(
    f"count(*) FILTER (WHERE regexp_matches(html, {q(rule[3])})) AS {rule[0]}" for rule in fv.XSS_RULES
) + " FROM pages"
_SDK_DECODED = comments_sql("d")
ORACLES["sdk_request_scan"] = f"""
  WITH a AS (SELECT page_id, query, {decoded_sql('query')} AS d FROM {PAGES}), b AS (SELECT *, {_SDK_DECODED} AS e FROM a)
  SELECT page_id, {_sdk('query', 0)} <> '' AS blocked, {_sdk('query', 0)} AS threat_type, {_sdk('query', 1)} AS reason,
    {_sdk('e', 0)} AS decoded_threat_type, {_sdk('e', 1)} AS decoded_reason FROM b"""
ORACLES["surface_normal_forms"] = (
    f"SELECT page_id, {comments_sql('d')} AS spaced, {compact_sql('d')} AS compact FROM (SELECT page_id, {decoded_sql('query')} AS d FROM {PAGES})"
)


# --- de-obfuscation --------------------------------------------------------------------------------------------

_HIDDEN = docs(plants.HIDDEN)
_LOW = "abcdefghijklmnopqrstuvwxyz"
_FROM, _TO = _LOW + _LOW.upper(), _LOW[13:] + _LOW[:13] + (_LOW[13:] + _LOW[:13]).upper()
ORACLES["zero_width_scan"] = (
    f"SELECT doc_id, regexp_replace(text, {q(_ZERO)}, '', 'g') AS text FROM {_HIDDEN} WHERE regexp_matches(text, {q(_ZERO)})"
)
_TURNED = f"(SELECT doc_id, translate(text, {q(_FROM)}, {q(_TO)}) AS text FROM {_HIDDEN})"
ORACLES["rot13_scan"] = (
    f"SELECT doc_id, rule, md5(original) AS digest FROM {verdict_sql(_TURNED, 'doc_id', 'pi')} WHERE confidence >= 0.7"
)
_PRINTABLE = r"^[\p{L}\p{M}\p{N}\p{P}\p{S} ]+$"
# Well-formed UTF-8 sequences in hex digits, one blank after each byte; other bytes are skipped.
_C = "[89ab][0-9a-f] "
_UTF8 = (
    f"(?i)[0-7][0-9a-f] |(?:c[2-9a-f]|d[0-9a-f]) {_C}|e0 [ab][0-9a-f] {_C}|e[1-9a-cef] {_C}{_C}|ed [89][0-9a-f] {_C}"
    f"|f0 [9ab][0-9a-f] {_C}{_C}|f[1-3] {_C}{_C}{_C}|f4 8[0-9a-f] {_C}{_C}"
)
ORACLES["hex_payloads"] = f"""
  WITH a AS (SELECT doc_id, list_filter(regexp_extract_all(text, {q(r'\b[0-9a-fA-F]{16,}\b')}), lambda x: length(x) % 2 = 0) AS runs FROM {_HIDDEN}),
  b AS (SELECT doc_id, unnest(runs) AS run, unnest(range(len(runs))) AS i FROM a),
  c AS (SELECT doc_id, i, array_to_string(list_transform(regexp_extract_all(regexp_replace(run, '(..)', {q(r'\1 ')}, 'g'), {q(_UTF8)}), lambda x: decode(unhex(replace(x, ' ', '')))), '') AS payload FROM b),
  d AS (SELECT doc_id, i, payload, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place FROM c WHERE regexp_matches(payload, {q(_PRINTABLE)}) AND regexp_matches(payload, '[^ ]'))
  SELECT doc_id, place, payload FROM d"""
_SQUEEZED = "text"
for _word in fv.SQUEEZE_WORDS:
    _SQUEEZED = f"regexp_replace({_SQUEEZED}, {q(r'(?i)\b' + ''.join(c + '+' for c in _word) + r'\b')}, {q(_word)}, 'g')"
ORACLES["keyword_squeeze_scan"] = f"SELECT doc_id, s AS text FROM (SELECT doc_id, text, {_SQUEEZED} AS s FROM {_HIDDEN}) WHERE s <> text"
# RE2 has no back-reference: split into characters and drop those equal to the one before, newlines kept.
ORACLES["doubled_letters"] = f"""
  WITH a AS (SELECT doc_id, lang, string_split(text, '') AS c FROM {_HIDDEN}),
  b AS (SELECT lang, len(list_filter(list_zip(c[2:], c[:-2]), lambda x: x[1] = x[2] AND x[1] <> chr(10))) AS dropped FROM a)
  SELECT lang, count(*) AS n, CAST(sum(dropped) AS BIGINT) AS dropped FROM b WHERE dropped > 0 GROUP BY 1"""
ORACLES["leet_letters"] = (
    f"SELECT doc_id, md5(s) AS digest FROM (SELECT doc_id, text, translate(text, {q(''.join(fv.LEET_SINGLES))}, {q(''.join(fv.LEET_SINGLES.values()))}) AS s FROM {_HIDDEN}) WHERE s <> text"
)
ORACLES["percent_texts"] = f"SELECT doc_id, md5(s) AS digest FROM (SELECT doc_id, text, replace(text, '%69', 'i') AS s FROM {_HIDDEN}) WHERE s <> text"

# The entities that occur in the crawl; a bare '&amp' counts too. Three rounds.
_ENTITIES = "html"
for _ in range(3):
    for _name, _value in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&"), ("&amp", "&")):
        _ENTITIES = f"replace({_ENTITIES}, {q(_name)}, {q(_value)})"
ORACLES["page_entities"] = f"SELECT page_id, md5(s) AS digest FROM (SELECT page_id, html, {_ENTITIES} AS s FROM pages) WHERE s <> html"
ORACLES["accent_skeletons"] = f"""
  SELECT lang, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS n_chars, CAST(sum(strlen(s)) AS BIGINT) AS n_bytes
  FROM (SELECT lang, text, strip_accents(text) AS s FROM {_HIDDEN}) WHERE s <> text GROUP BY 1"""

# Long tokens come first, then runs in which white space and then also dashes, dots and underscores may stand; a decoder reads whole groups of four.
_CANDIDATES = (r"[^\s]{16,}", r"[A-Za-z0-9+/][A-Za-z0-9+/ \t\r\n]*={0,2}", r"[A-Za-z0-9+/][A-Za-z0-9+/_. \t\r\n-]{14,}={0,4}")
_LONG_RUNS = f"list_filter(regexp_extract_all(text, {q(_CANDIDATES[1])}), lambda x: length(regexp_replace(x, '[^A-Za-z0-9+/]', '', 'g')) >= 16)"
_RUNS = f"regexp_extract_all(text, {q(_CANDIDATES[0])}) || {_LONG_RUNS} || regexp_extract_all(text, {q(_CANDIDATES[2])})"
ORACLES["base64_payloads"] = f"""
  WITH a AS (SELECT doc_id, {_RUNS} AS runs FROM {_HIDDEN}), b AS (SELECT doc_id, unnest(runs) AS run, unnest(range(len(runs))) AS i FROM a),
  c AS (SELECT doc_id, i, regexp_replace(run, '[^A-Za-z0-9+/=]', '', 'g') AS code FROM b),
  d AS (SELECT doc_id, i, CASE WHEN code NOT LIKE '%=%' AND length(code) % 4 = 0 THEN code WHEN regexp_matches(code, '^[^=]+={{1,2}}$') AND length(code) % 4 = 0 THEN code END AS code FROM c),
  e AS (SELECT doc_id, i, TRY(decode(from_base64(code))) AS payload FROM d WHERE code <> ''),
  f AS (SELECT doc_id, payload, min(i) AS i FROM e WHERE regexp_matches(payload, {q(_PRINTABLE)}) AND regexp_matches(payload, '[^ ]') GROUP BY 1, 2)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place, payload FROM f"""

# By place in the list of plants: the reading in which its own encoding is undone, and the stages that changed the text up to there.
_SINGLES = f"translate(text, {q(''.join(fv.LEET_SINGLES))}, {q(''.join(fv.LEET_SINGLES.values()))})"
_LAST = "trim(regexp_extract(text, '[^ ]+ $', 0))"
_LETTERS = f"right(text, {len(plants.HIDDEN[11])})"
_UNHIDDEN = {
    1: f"translate(text, {q(_FROM)}, {q(_TO)})", 2: _SINGLES, 4: f"regexp_replace(text, {q(_ZERO)}, '', 'g')", 5: f"decode(unhex({_LAST}))", 6: _SQUEEZED,
    8: f"decode(from_base64({_LAST}))", 9: "replace(text, '%69', chr(CAST('0x69' AS INTEGER)))", 11: f"replace(replace(replace({_LETTERS}, '   ', '|'), ' ', ''), '|', ' ')",
    12: "replace(text, '&#x69;', chr(CAST('0x69' AS INTEGER)))", 15: f"decode(from_base64({_LAST}))",
}
_ACCENTS = f"CASE WHEN strip_accents(text) <> text THEN {q(fv.STAGE_LABELS[3])} END"
_LEET = f"CASE WHEN {' OR '.join(f'contains(strip_accents(text), {q(mark)})' for mark in (*fv.LEET_SINGLES, *fv.LEET_PAIRS))} THEN {q(fv.STAGE_LABELS[6])} END"
_TRAILS = {
    1: (q(fv.ROT13_LABEL),), 2: (_ACCENTS, q(fv.STAGE_LABELS[6])), 4: (_ACCENTS, q(fv.STAGE_LABELS[4])), 5: (q("hex-decoded payload"),), 6: (_ACCENTS, _LEET, q(fv.STAGE_LABELS[7])),
    8: (q("base64-decoded payload"),), 9: (q(fv.STAGE_LABELS[2]),), 11: (_ACCENTS, q(fv.STAGE_LABELS[5])), 12: (q(fv.STAGE_LABELS[1]),),
}
_READ = f"""(SELECT doc_id, CASE place {' '.join(f'WHEN {n} THEN {sql}' for n, sql in _UNHIDDEN.items())} ELSE '' END AS text,
  CASE place {' '.join(f"WHEN {n} THEN concat_ws(' + ', {', '.join(trail)})" for n, trail in _TRAILS.items())} ELSE '' END AS trail
  FROM (SELECT *, doc_id % {len(plants.HIDDEN)} AS place FROM {_HIDDEN}))"""


def _either(kind: str) -> str:
    """Verdict on the text as written, and where that finds no rule, on the reading that undoes its plant."""
    found = "r.rule IN ('', 'pi_oversize') AND d.rule NOT IN ('', 'pi_oversize')"
    return f"""(SELECT doc_id, {found} AS deep, r.detected OR d.rule NOT IN ('', 'pi_oversize') AS detected, CASE WHEN {found} THEN d.rule ELSE r.rule END AS rule,
      CASE WHEN {found} THEN d.reason || ' [via ' || d.trail || ']' ELSE r.reason END AS reason
      FROM {verdict_sql(_HIDDEN, 'doc_id', kind)} r JOIN {verdict_sql(_READ, 'doc_id, trail', kind)} d USING (doc_id))"""


ORACLES["deobfuscated_scan"] = f"""
  SELECT doc_id, i.rule AS injection_rule, i.reason AS injection_reason, j.rule AS jailbreak_rule
  FROM {_either('pi')} i JOIN {_either('jb')} j USING (doc_id) WHERE i.detected OR j.detected"""
ORACLES["guard_decision_deep"] = f"""
  SELECT doc_id, allowed AND NOT (i.deep OR j.deep) AS allowed,
    CASE WHEN i.deep THEN 'PROMPT_INJECTION' WHEN j.deep AND k.threat_type <> 'PROMPT_INJECTION' THEN 'JAILBREAK' ELSE k.threat_type END AS threat_type,
    CASE WHEN i.deep THEN i.reason WHEN j.deep AND k.threat_type <> 'PROMPT_INJECTION' THEN j.reason ELSE k.reason END AS reason
  FROM {decision_sql(_HIDDEN, 'doc_id')} k JOIN {_either('pi')} i USING (doc_id) JOIN {_either('jb')} j USING (doc_id)"""


# --- chat bodies -----------------------------------------------------------------------------------------------

_CHAT = f"""(SELECT conv_id, CASE WHEN conv_id % 3 = 2 THEN first(text ORDER BY turn) || {q(fv.TURN_SEPARATOR)} || {q(plants.ASIDE)} ELSE string_agg(text, {q(fv.TURN_SEPARATOR)} ORDER BY turn) END AS text
  FROM {turns(plants.PII)} GROUP BY conv_id)"""
ORACLES["extract_prompts"] = f"SELECT conv_id, text AS prompt FROM {_CHAT}"
ORACLES["body_rewrite"] = f"SELECT conv_id, masked AS prompt FROM {masked_sql(_CHAT, 'conv_id')}"


# --- canaries --------------------------------------------------------------------------------------------------

RESPONSES = f"(SELECT conv_id, turn, text FROM {turns(plants.LEAKS)} WHERE role = 'assistant')"


_TOKEN_ROWS = f"(SELECT unnest([{', '.join(q(token) for token in plants.TOKENS)}]) AS token)"
ORACLES["canary_chunks"] = f"""
  WITH r AS (SELECT conv_id, turn, text, token FROM {RESPONSES}, {_TOKEN_ROWS} WHERE contains(text, token)),
  p AS (SELECT *, unnest(range(1, length(text) + 1)) AS position FROM r)
  SELECT conv_id, turn, token, position, (position + length(token) - 2) // (conv_id % 11 + 3) AS chunk_no FROM p WHERE substr(text, position, length(token)) = token"""


def _direct(token: str, sdk: bool) -> str:
    evens, odds = token[::2], token[1::2]
    arms = [(f"contains(text, {q(token)})", 0)]
    if not sdk:
        arms += [
            (f"contains(text, {q(token[::-1])})", 1), (f"contains(text, {q(evens)})", 2), (f"contains(text, {q(odds)})", 3),
            (f"contains(ev, {q(token)})", 4), (f"contains(od, {q(token)})", 5),
        ]
        if len(token) > fv.MIN_PARTIAL_TOKEN:
            arms += [(f"contains(text, {q(token[:12])})", 6), (f"contains(text, {q(token[-12:])})", 7)]
    bare = re.sub(fv.CANARY_SEPARATORS, "", token)
    canonical = bare
    for _ in range(3):
        canonical = canonical.translate(str.maketrans(fv.LEET_SINGLES)) if not any(p in canonical for p in fv.LEET_PAIRS) else canonical
    arms += [(f"contains(bare, {q(bare)}) OR contains(plain, {q(canonical.lower())})", 8)]
    return "CASE " + " ".join(f"WHEN {test} THEN {q(fv.CANARY_KINDS[kind])}" for test, kind in arms) + " END"


def leaks_sql(source: str, keys: str, tokens=plants.TOKENS, sdk: bool = False) -> str:
    """First leaked token and kind per response. Three-digit runs such as 777 have no two-character leet form."""
    separators = q(fv.CANARY_SEPARATORS)
    singles = f"lower(translate(bare, {q(''.join(fv.LEET_SINGLES))}, {q(''.join(fv.LEET_SINGLES.values()))}))"
    listed = ", ".join(f"({_direct(token, sdk)}) AS k{n}" for n, token in enumerate(tokens))
    token = "CASE " + " ".join(f"WHEN k{n} IS NOT NULL THEN {q(t)}" for n, t in enumerate(tokens)) + " END"
    return f"""(
      WITH a AS (SELECT *, regexp_replace(text, {separators}, '', 'g') AS bare, regexp_replace(text, '(?s)(.).?', {q(r'\1')}, 'g') AS ev, regexp_replace(text, '(?s).(.?)', {q(r'\1')}, 'g') AS od FROM {source}),
      b AS (SELECT *, {singles} AS plain FROM a), c AS (SELECT *, {listed} FROM b)
      SELECT {keys}, text, {token} AS leaked_token, coalesce({', '.join(f'k{n}' for n in range(len(tokens)))}) AS kind FROM c)"""


_LEAKS = leaks_sql(RESPONSES, "conv_id, turn")
ORACLES["canary_leaks"] = f"SELECT conv_id, turn, leaked_token, kind FROM {_LEAKS} WHERE kind IS NOT NULL"
ORACLES["canary_by_kind"] = f"SELECT kind, count(*) AS n FROM {_LEAKS} GROUP BY 1"
_NOTED = "regexp_extract(text, ' noted (.*)$', 1)"
_CODES = f"array_to_string(list_transform(regexp_extract_all({_NOTED}, '[0-9]+'), lambda x: chr(CAST(x AS INTEGER))), '')"
_HEX_CODES = f"array_to_string(list_transform(regexp_extract_all({_NOTED}, '&#x([0-9a-f]+);', 1), lambda x: decode(unhex(x))), '')"
# By place in the list of plants: the SQL that undoes the plant's encoding.
_UNDONE = {
    1: f"decode(from_base64({_NOTED}))", 2: f"decode(unhex({_NOTED}))", 4: f"translate({_NOTED}, {q(_FROM)}, {q(_TO)})", 5: _CODES, 6: f"url_decode({_NOTED})",
    8: _CODES, 9: f"decode(from_base64({_NOTED}))", 10: _HEX_CODES,
}
_DEEP = f"(SELECT conv_id, turn, text, (conv_id + turn) % {len(plants.DEEP_LEAKS)} AS place FROM {turns(plants.DEEP_LEAKS)} WHERE role = 'assistant')"
_CLEARED = f"(SELECT conv_id, turn, CASE place {' '.join(f'WHEN {n} THEN {sql}' for n, sql in _UNDONE.items())} ELSE '' END AS text FROM {_DEEP})"
_WHOLE = "CASE " + " ".join(f"WHEN contains(text, {q(token)}) THEN {q(token)}" for token in plants.TOKENS) + " END"
ORACLES["canary_deep"] = f"""
  SELECT conv_id, turn, coalesce(r.leaked_token, d.leaked_token) AS leaked_token, coalesce(r.kind, {q(fv.CANARY_KINDS[8])}) AS kind
  FROM {leaks_sql(_DEEP, 'conv_id, turn')} r JOIN (SELECT conv_id, turn, {_WHOLE} AS leaked_token FROM {_CLEARED}) d USING (conv_id, turn)
  WHERE r.kind IS NOT NULL OR d.leaked_token IS NOT NULL"""
ORACLES["canary_sdk"] = f"SELECT conv_id, turn, leaked_token, kind FROM {leaks_sql(RESPONSES, 'conv_id, turn', sdk=True)} WHERE kind IS NOT NULL"
ORACLES["output_guard"] = f"""SELECT conv_id, turn, kind IS NULL AS allowed, CASE WHEN kind IS NULL THEN text ELSE {q(fv.CANARY_REPLACEMENT)} END AS sanitized_response,
  CASE WHEN kind IS NULL THEN 'NONE' ELSE 'CANARY_LEAK' END AS threat_type, CASE WHEN kind IS NULL THEN 'response clean' ELSE 'Canary token leaked in model output (' || kind || ')' END AS reason FROM {_LEAKS}"""
_ROUTE_OF = planted_sql("conv_id", [route.id for route in ROUTES])
ORACLES["route_canaries"] = f"""
  SELECT route_id, count(*) AS n, count(*) FILTER (WHERE route_id = 'llm-chat' AND kind IS NOT NULL) AS leaks
  FROM (SELECT {_ROUTE_OF} AS route_id, kind FROM {leaks_sql(RESPONSES, 'conv_id, turn', ROUTES[0].canary_tokens)}) GROUP BY 1"""


# --- routing ---------------------------------------------------------------------------------------------------

_CLEAN = {
    "/api//orders/./7": "/api/orders/7", "/v1/../api/items": "/api/items", "/v1/chat/completions/": "/v1/chat/completions", "/api/../../etc": "/etc",
}
LOG = f"""(SELECT event_id, ts, user_id, event_type, value, {planted_sql('event_id', plants.PATHS)} AS path, {planted_sql('event_id', plants.KEYS)} AS key,
  {planted_sql('event_id', plants.REMOTES)} AS remote, {planted_sql('event_id', plants.FORWARDED)} AS forwarded FROM events)"""
_CLEAN_SQL = "(CASE path " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in _CLEAN.items()) + " ELSE path END)"
_ROUTE_SQL = f"""(CASE WHEN {_CLEAN_SQL} = '/v1/chat/completions' THEN 'llm-chat' WHEN {_CLEAN_SQL} = '/api/users/42' THEN 'api-users'
  WHEN {_CLEAN_SQL} = '/api' OR starts_with({_CLEAN_SQL}, '/api/') THEN 'rest-api' WHEN starts_with({_CLEAN_SQL}, '/static') THEN 'static' END)"""
ORACLES["route_match"] = f"SELECT event_id, coalesce({_ROUTE_SQL}, '-') AS route_id FROM {LOG}"
ORACLES["unrouted"] = f"SELECT path, count(*) AS n FROM {LOG} WHERE {_ROUTE_SQL} IS NULL GROUP BY 1"
ORACLES["clean_paths"] = f"SELECT path, {_CLEAN_SQL} AS clean, count(*) AS n FROM {LOG} GROUP BY 1, 2"
_KEY_TABLE = "(VALUES " + ", ".join(f"(sha256({q(k)}), {q(i)}, {q(t)}, {len(r)})" for k, i, t, r, _ in API_KEYS) + ") AS keys(key_hash, id, tenant_id, n_roles)"
ORACLES["identity_join"] = f"""
  SELECT event_id, CASE WHEN id IS NOT NULL THEN id WHEN user_id = 7 THEN 'app-client-1' ELSE '-' END AS subject,
    CASE WHEN id IS NOT NULL THEN tenant_id WHEN user_id = 7 THEN 'client-tenant' ELSE '-' END AS tenant_id
  FROM {LOG} l LEFT JOIN {_KEY_TABLE} ON keys.key_hash = sha256(l.key)"""
ORACLES["role_denials"] = f"""
  SELECT event_id, {_ROUTE_SQL} AS route_id, id AS subject, 'Admin' AS missing FROM {LOG} l JOIN {_KEY_TABLE} ON keys.key_hash = sha256(l.key)
  WHERE {_ROUTE_SQL} = 'api-users' AND id = 'app-client-1'"""


def _number(address: str) -> str:
    part = lambda n: f"CAST(string_split({address}, '.')[{n}] AS BIGINT)"
    number = f"{part(1)} * 16777216 + {part(2)} * 65536 + {part(3)} * 256 + {part(4)}"
    return f"(CASE WHEN regexp_matches({address}, {q(r'^[0-9]{1,3}(\.[0-9]{1,3}){3}$')}) THEN {number} END)"


def _trusted(number: str) -> str:
    return f"(({number} BETWEEN 167772160 AND 184549375) OR ({number} BETWEEN 3232235776 AND 3232236031))"


ORACLES["client_addresses"] = f"""
  WITH a AS (SELECT event_id, remote, regexp_replace(remote, ':[^:]*$', '') AS host, list_reverse(list_transform(string_split(forwarded, ','), lambda x: trim(x))) AS hops FROM {LOG}),
  b AS (SELECT *, list_filter(hops, lambda h: {_number('h')} IS NOT NULL AND NOT {_trusted(_number('h'))})[1] AS hop FROM a)
  SELECT event_id, CASE WHEN {_trusted(_number('host'))} THEN coalesce(hop, remote) ELSE remote END AS client_ip FROM b"""
_PART = "'10.' || n // 256 % 256 || '.' || n % 256"
_NETWORK_OF = {4: "regexp_replace(a, '[.][0-9]+$', '')", 6: "regexp_extract(a, '^fd00:[0-9a-f]+') || '::/32'"}
_TRUSTED_BY_TABLE = f"""(SELECT DISTINCT a FROM all_a WHERE {_NETWORK_OF[4]} || '.0/24' IN (SELECT network FROM networks) OR {_NETWORK_OF[6]} IN (SELECT network FROM networks)
    OR CAST(regexp_extract('0' || a, '[0-9]+$') AS BIGINT) >= 128 AND {_NETWORK_OF[4]} || '.128/25' IN (SELECT network FROM networks))"""
ORACLES["client_addresses_by_table"] = f"""
  WITH networks AS (SELECT CASE n % 3 WHEN 0 THEN {_PART} || '.0/24' WHEN 1 THEN 'fd00:' || format('{{:x}}', n) || '::/32' ELSE {_PART} || '.128/25' END AS network FROM (SELECT c_custkey AS n FROM customer)),
  e AS (SELECT event_id AS e, event_id % 2000 + 1 AS n FROM events),
  p AS (SELECT e, CASE WHEN e % 4 = 3 THEN 'fd00:' || format('{{:x}}', n) || '::5' ELSE {_PART} || '.' || (e % 250 + 1) END AS peer, CASE WHEN e % 4 = 3 THEN ']:443' ELSE ':80' END AS port,
    'fd00:' || format('{{:x}}', n + 1) || '::7' AS h2, {_PART.replace('n ', '(n + 2) ')} || '.' || (e * 7) % 256 AS h3 FROM e),
  all_a AS (SELECT peer AS a FROM p UNION SELECT h2 FROM p UNION SELECT h3 FROM p), t AS {_TRUSTED_BY_TABLE}
  SELECT e AS event_id, CASE WHEN peer NOT IN (SELECT a FROM t) THEN CASE WHEN e % 4 = 3 THEN '[' ELSE '' END || peer || port
    WHEN h3 NOT IN (SELECT a FROM t) THEN h3 WHEN h2 NOT IN (SELECT a FROM t) THEN h2 ELSE '198.51.100.' || e % 200 END AS client_ip FROM p"""
ORACLES["stale_signatures"] = (
    f"SELECT event_id, age_seconds FROM (SELECT event_id, abs(CAST(floor(value * 10) AS BIGINT) - 200) AS age_seconds FROM {LOG}) WHERE age_seconds > {fv.SIGNATURE_MAX_AGE_SECONDS}"
)


def _replay() -> str:
    prompt = f"trim({planted_sql('event_id', plants.PROMPTS)})"
    log = f"""(SELECT event_id, event_type, path, key, {planted_sql('event_id', plants.QUERIES)} AS query, '' AS cookie, '' AS agent, {planted_sql('event_id', plants.BODIES)} AS body,
      {prompt} AS text, {planted_sql('event_id', plants.LEAKS)} AS response, {_ROUTE_SQL} AS route_id FROM {LOG})"""
    uri = f"(SELECT event_id, path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS path, query, cookie, agent, '' AS body FROM log WHERE contains(path || '?' || query, '..'))"
    tokens = ROUTES[0].canary_tokens
    return f"""
    WITH log AS {log},
    early AS (SELECT event_id, rule FROM {scan_sql(uri, 'event_id')} WHERE rule IS NOT NULL), scan AS (SELECT event_id, rule FROM {scan_sql('log', 'event_id')}),
    guard AS (SELECT * FROM {decision_sql('log', 'event_id')}),
    leak AS (SELECT event_id, kind FROM {leaks_sql('(SELECT event_id, response AS text FROM log)', 'event_id', tokens)}),
    j AS (SELECT l.*, e.rule AS early_rule, s.rule AS rule, g.allowed, g.threat_type AS guard_threat, g.risk_level, g.sanitized_prompt, k.kind, keys.id, keys.n_roles
      FROM log l LEFT JOIN early e USING (event_id) JOIN scan s USING (event_id) JOIN guard g USING (event_id) JOIN leak k USING (event_id)
      LEFT JOIN {_KEY_TABLE} ON keys.key_hash = sha256(l.key)),
    o AS (SELECT *, CASE WHEN early_rule IS NOT NULL THEN 1 WHEN route_id IS NULL THEN 2 WHEN route_id <> 'static' AND id IS NULL THEN 4
      WHEN route_id = 'api-users' AND n_roles < 2 THEN 5 WHEN route_id IN ('rest-api', 'api-users') AND rule IS NOT NULL THEN 9
      WHEN route_id = 'llm-chat' AND text <> '' AND NOT allowed THEN 10 WHEN event_type = 'error' THEN 11
      WHEN route_id = 'llm-chat' AND response <> '' AND kind IS NOT NULL THEN 13 WHEN route_id = 'llm-chat' AND text <> '' AND sanitized_prompt <> text THEN 14 ELSE 15 END AS stage FROM j)
    SELECT event_id, coalesce(route_id, '-') AS route_id, coalesce(id, 'anonymous') AS client_id,
      CAST(CASE stage WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 4 THEN 401 WHEN 5 THEN 403 WHEN 9 THEN 403 WHEN 10 THEN 403 WHEN 11 THEN 502 WHEN 13 THEN 502 ELSE 200 END AS BIGINT) AS status,
      CASE stage WHEN 1 THEN 'SECURITY_VIOLATION' WHEN 2 THEN 'ROUTE_NOT_FOUND' WHEN 4 THEN 'UNAUTHORIZED' WHEN 5 THEN 'FORBIDDEN' WHEN 9 THEN 'SECURITY_VIOLATION' WHEN 10 THEN 'AI_SECURITY_VIOLATION'
        WHEN 11 THEN 'UPSTREAM_UNAVAILABLE' WHEN 13 THEN 'CANARY_SECRET_LEAK' ELSE '' END AS error,
      CASE stage WHEN 1 THEN {_of_rule('early_rule', _CATEGORY, 'NONE')} WHEN 9 THEN {_of_rule('rule', _CATEGORY, 'NONE')} WHEN 10 THEN guard_threat WHEN 13 THEN 'CANARY_LEAK' WHEN 14 THEN 'PII_DETECTED' ELSE 'NONE' END AS threat_type,
      CASE stage WHEN 1 THEN {_of_rule('early_rule', _SEVERITY, 'LOW')} WHEN 4 THEN 'HIGH' WHEN 5 THEN 'HIGH' WHEN 9 THEN {_of_rule('rule', _SEVERITY, 'LOW')} WHEN 10 THEN risk_level WHEN 11 THEN 'HIGH' WHEN 13 THEN 'CRITICAL' WHEN 14 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
      CASE WHEN stage = 14 THEN 'MASKED' WHEN stage = 15 THEN 'ALLOWED' ELSE 'BLOCKED' END AS action FROM o"""


ORACLES["decision_replay"] = _replay()


# --- audit -----------------------------------------------------------------------------------------------------

def _audit_ctes(plain: bool = False) -> str:
    """CTE c: built chains. ``plain`` is the stream's variant, in which every event is allowed."""
    pick = lambda error, click, other: q(other) if plain else f"(CASE event_type WHEN 'error' THEN {q(error)} WHEN 'click' THEN {q(click)} ELSE {q(other)} END)"
    tail = f"""'ts:' || ts_ns || '|trace:trace-' || event_id || '|client:user-' || user_id || '|ip:10.0.0.1|route:/api/' || event_type || '|act:' || {pick('BLOCKED', 'MASKED', 'ALLOWED')}
      || '|threat:' || {pick(fv.AUDIT_CATEGORY['SQL_INJECTION'], fv.AUDIT_CATEGORY['PII_DETECTED'], 'NONE')} || '|sev:' || {pick('CRITICAL', 'LOW', 'LOW')} || '|conf:' || {pick('1.0000', '0.9500', '0.0000')}
      || '|reason:' || {pick('blocked by rule', '', '')} || '|rule:' || {pick('sqli_union_select', '', '')} || '|checkpoint_version:1'"""
    return f"""RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) * 1000 AS ts_ns FROM events),
      n AS (SELECT *, (ts_ns // 1000000000) // {ROTATION} || '-' || event_id % {WRITERS} AS chain_id, {tail} AS tail FROM e),
      o AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY ts_ns, event_id) AS record_no FROM n),
      c AS (SELECT event_id, chain_id, record_no, '{fv.GENESIS_HASH}' AS prev_record_hash, sha256('prev:{fv.GENESIS_HASH}|' || tail) AS record_hash FROM o WHERE record_no = 1
        UNION ALL SELECT o.event_id, o.chain_id, o.record_no, c.record_hash, sha256('prev:' || c.record_hash || '|' || o.tail) FROM c JOIN o ON o.chain_id = c.chain_id AND o.record_no = c.record_no + 1)"""


ORACLES["audit_build"] = f"WITH {_audit_ctes()} SELECT event_id, chain_id, record_no, prev_record_hash, record_hash FROM c"
_MARK = "sha256('checkpoint:v1|count:' || record_no || '|tip:' || record_hash)"
_TIPS = "t AS (SELECT chain_id, max(record_no) AS last FROM c GROUP BY 1)"
ORACLES["audit_checkpoints"] = f"""WITH {_audit_ctes()}, {_TIPS}
  SELECT chain_id, record_no AS record_count, record_hash AS tip_hash, {_MARK} AS checkpoint_hash, CAST(0 AS BIGINT) AS closing FROM c WHERE record_no % 16 = 0
  UNION ALL SELECT c.chain_id, record_no, record_hash, {_MARK}, CAST(1 AS BIGINT) FROM c JOIN t ON t.chain_id = c.chain_id AND t.last = c.record_no"""
ORACLES["audit_recover"] = f"WITH {_audit_ctes()}, {_TIPS} SELECT c.chain_id, record_hash AS tip_hash, last AS record_count FROM c JOIN t ON t.chain_id = c.chain_id AND t.last = c.record_no"
ORACLES["audit_verify"] = f"WITH {_audit_ctes()}, {_TIPS} SELECT chain_id, true AS valid, last AS total_records, '' AS reason FROM t"
# A chain breaks at its first changed record, at the first one whose predecessor is gone, or at its closing checkpoint
# when only the last record is gone.
ORACLES["audit_tampered"] = f"""WITH {_audit_ctes()}, {_TIPS},
  k AS (SELECT *, lag(record_no) OVER (PARTITION BY chain_id ORDER BY record_no) AS before_no, row_number() OVER (PARTITION BY chain_id ORDER BY record_no) - 1 AS index_no FROM c WHERE event_id % 89 <> 0),
  b AS (SELECT chain_id, record_no, index_no, CASE WHEN starts_with('trace-' || event_id, 'trace-83') THEN 'corrupted JSON on record' WHEN coalesce(before_no, 0) <> record_no - 1 THEN 'hash link mismatch at record'
    WHEN event_id % 97 = 0 THEN 'payload tampering at record' END AS reason FROM k),
  g AS (SELECT chain_id, record_no, index_no, reason FROM b WHERE reason IS NOT NULL
    UNION ALL SELECT t.chain_id, t.last + 1, count(k.record_no), 'invalid audit checkpoint commitment' FROM t LEFT JOIN k USING (chain_id) GROUP BY t.chain_id, t.last HAVING count(k.record_no) <> t.last),
  f AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY record_no) AS nth FROM g)
  SELECT t.chain_id, f.reason IS NULL AS valid, coalesce(f.index_no, t.last) AS total_records, f.index_no AS broken_at_index, coalesce(f.reason, '') AS reason
  FROM t LEFT JOIN (SELECT * FROM f WHERE nth = 1) f USING (chain_id)"""
ORACLES["audit_file_verify"] = ORACLES["audit_tampered"]
ORACLES["audit_append"] = f"""WITH {_audit_ctes()}, {_TIPS}
  SELECT c.chain_id, true AS valid, last AS total_records, '' AS reason, record_hash AS tip_hash FROM c JOIN t ON t.chain_id = c.chain_id AND t.last = c.record_no"""
ORACLES["audit_truncated"] = f"""WITH {_audit_ctes()}, {_TIPS}, m AS (SELECT unnest(['strict', 'lenient']) AS mode),
  w AS (SELECT chain_id, last, CAST(split_part(chain_id, '-', 2) AS INT) % 2 = 0 AS cut FROM t)
  SELECT chain_id, mode, NOT (cut AND mode = 'strict') AS valid, last - CAST(cut AS INT) AS total_records, CASE WHEN cut AND mode = 'strict' THEN 'missing terminal audit checkpoint' ELSE '' END AS reason
  FROM w, m WHERE NOT (cut AND last = 1)"""


# --- metrics ---------------------------------------------------------------------------------------------------

OUTCOMES = """(SELECT event_id, ts, 'trace-' || event_id AS trace_id, user_id AS client_id, CASE event_type WHEN 'error' THEN 403 WHEN 'signup' THEN 502 ELSE 200 END AS status,
  CASE WHEN event_type IN ('error', 'signup') THEN 'BLOCKED' WHEN event_type = 'click' THEN 'MASKED' ELSE 'ALLOWED' END AS action,
  CASE event_type WHEN 'error' THEN 'SQL_INJECTION' WHEN 'signup' THEN 'CANARY_LEAK' WHEN 'click' THEN 'PII_DETECTED' ELSE 'NONE' END AS threat_category,
  CASE WHEN event_type = 'signup' THEN 'CRITICAL' WHEN event_type = 'error' THEN (CASE WHEN user_id % 2 = 0 THEN 'HIGH' ELSE 'CRITICAL' END) ELSE 'MEDIUM' END AS severity,
  CAST(floor(value * 100) AS BIGINT) AS waf_us, CAST(floor(value * 100) AS BIGINT) * 3 AS guard_us, CAST(floor(value * 100) AS BIGINT) * 7 + 11 AS proxy_us FROM events)"""
_COUNTERS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE action = '{name.upper()}') AS {name}" for name in ("allowed", "blocked", "masked"))
_LATENCY = ", ".join(f"round(sum({name}_us) / count(*) / 1000.0, 9)::DOUBLE AS avg_{name}_ms" for name in ("waf", "guard", "proxy"))
ORACLES["soc_counters"] = f"SELECT {_COUNTERS} FROM {OUTCOMES}"
ORACLES["threat_breakdown"] = f"SELECT threat_category, count(*) AS n FROM {OUTCOMES} WHERE threat_category NOT IN ('', 'NONE') GROUP BY 1"
ORACLES["threat_rollup"] = f"""SELECT coalesce(threat_category, '*') AS threat_category, coalesce(severity, '*') AS severity, CAST(grouping(threat_category) * 2 + grouping(severity) AS BIGINT) AS level, count(*) AS n
  FROM {OUTCOMES} WHERE threat_category NOT IN ('', 'NONE') GROUP BY ROLLUP (threat_category, severity)"""
ORACLES["status_breakdown"] = f"SELECT CAST(status AS BIGINT) AS status, count(*) AS n FROM {OUTCOMES} GROUP BY 1"
ORACLES["latency_avg"] = f"SELECT {_LATENCY} FROM {OUTCOMES}"
_RECENT = f"(SELECT * FROM {OUTCOMES} WHERE action IN ('BLOCKED', 'MASKED') OR threat_category <> 'NONE' ORDER BY ts DESC, trace_id DESC LIMIT 50)"
ORACLES["recent_events"] = f"SELECT trace_id, client_id, action, threat_category, severity FROM {_RECENT}"
ORACLES["metrics_snapshot"] = f"""SELECT {_COUNTERS}, {_LATENCY},
  (SELECT string_agg(threat_category || '=' || n, ';' ORDER BY threat_category) FROM ({ORACLES['threat_breakdown']})) AS threat_breakdown,
  (SELECT string_agg(status || '=' || n, ';' ORDER BY status) FROM ({ORACLES['status_breakdown']})) AS status_breakdown,
  (SELECT string_agg(trace_id, ',' ORDER BY ts, trace_id) FROM {_RECENT}) AS recent_traces FROM {OUTCOMES}"""
_P = "textwarden_"
ORACLES["metrics_export"] = f"""
  WITH o AS (SELECT * FROM {OUTCOMES}), h AS (SELECT * FROM (VALUES
    (0, 'requests_total', 'counter', 'Total number of HTTP requests processed'), (1, 'requests_by_action_total', 'counter', 'Total number of requests categorized by action (ALLOWED, BLOCKED, MASKED)'),
    (2, 'threats_detected_total', 'counter', 'Total number of security threats detected by category'), (3, 'http_responses_total', 'counter', 'Total number of HTTP responses by status code'),
    (4, 'latency_seconds_average', 'gauge', 'Average inspection latency in seconds')) AS x(family, name, kind, help))
  SELECT CAST(family AS BIGINT) AS family, CAST(0 AS BIGINT) AS part, '' AS key, '# HELP {_P}' || name || ' ' || help AS line FROM h
  UNION ALL SELECT family, 1, '', '# TYPE {_P}' || name || ' ' || kind FROM h
  UNION ALL SELECT 0, 2, '', '{_P}requests_total ' || count(*) FROM o
  UNION ALL SELECT 1, 2, a, '{_P}requests_by_action_total{{action="' || a || '"}} ' || (SELECT count(*) FROM o WHERE action = a) FROM (SELECT unnest(['ALLOWED', 'BLOCKED', 'MASKED']) AS a)
  UNION ALL SELECT 2, 2, threat_category, '{_P}threats_detected_total{{threat="' || threat_category || '"}} ' || count(*) FROM o WHERE threat_category <> 'NONE' GROUP BY threat_category
  UNION ALL SELECT 3, 2, CAST(status AS VARCHAR), '{_P}http_responses_total{{code="' || status || '"}} ' || count(*) FROM o GROUP BY status
  UNION ALL SELECT 4, 2, c, '{_P}latency_seconds_average{{component="' || c || '"}} ' || printf('%.6f', v / 1000) FROM (
    SELECT 'waf' AS c, sum(waf_us) / count(*) / 1000.0 AS v FROM o UNION ALL SELECT 'guard', sum(guard_us) / count(*) / 1000.0 FROM o UNION ALL SELECT 'proxy', sum(proxy_us) / count(*) / 1000.0 FROM o)"""
ORACLES["rate_breaches"] = f"""
  SELECT route_key, strftime(minute, '%Y-%m-%d %H:%M') AS minute, n, CAST(CASE WHEN route_key < 2 THEN route_key + 1 ELSE 1 END AS BIGINT) AS allowed
  FROM (SELECT client_id % 3 AS route_key, date_trunc('minute', ts) AS minute, count(*) AS n FROM {OUTCOMES} GROUP BY 1, 2) WHERE n > CASE WHEN route_key < 2 THEN route_key + 1 ELSE 1 END"""


ORACLES["token_buckets"] = f"""
  WITH RECURSIVE l AS (SELECT event_id, ts, coalesce(id, client_ip) AS client, CASE WHEN id = {q(API_KEYS[0][1])} THEN 60 WHEN id IS NULL THEN 20 ELSE 40 END AS rate
    FROM {LOG} l LEFT JOIN {_KEY_TABLE} ON keys.key_hash = sha256(l.key) JOIN ({ORACLES['client_addresses']}) USING (event_id)),
  e AS MATERIALIZED (SELECT event_id, client, epoch_us(ts) * rate // 86400000000 AS tick, row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS rn FROM l),
  w AS (SELECT event_id, client, tick, rn, CAST(5 AS BIGINT) AS level FROM e WHERE rn = 1
    UNION ALL SELECT e.event_id, e.client, e.tick, e.rn, least(5, greatest(w.level - 1, 0) + e.tick - w.tick) FROM w JOIN e ON e.client = w.client AND e.rn = w.rn + 1)
  SELECT event_id, client, level > 0 AS admitted, greatest(level - 1, 0) AS tokens_left FROM w"""


# --- evaluation ------------------------------------------------------------------------------------------------

_CLEAN_NO = plants.WELL_MEANT
_LABELLED = f"(SELECT d.* FROM {docs(plants.PROMPTS)} d JOIN labels USING (doc_id))"
CASES = f"""(SELECT doc_id, i.lang, quality, toxic, doc_id % {len(plants.PROMPTS)} NOT IN ({', '.join(map(str, _CLEAN_NO))}) AS is_attack,
  (i.detected AND i.confidence >= 0.7) OR j.detected AS detected, CASE WHEN i.rule <> '' THEN i.rule ELSE j.rule END AS rule
  FROM {verdict_sql(_LABELLED, 'doc_id, lang', 'pi')} i JOIN {verdict_sql(_LABELLED, 'doc_id, lang', 'jb')} j USING (doc_id) JOIN labels USING (doc_id))"""
_CELLS = """count(*) FILTER (WHERE is_attack AND detected) AS tp, count(*) FILTER (WHERE NOT is_attack AND detected) AS fp,
  count(*) FILTER (WHERE NOT is_attack AND NOT detected) AS tn, count(*) FILTER (WHERE is_attack AND NOT detected) AS fn"""


def scores_sql(group: str, cases: str) -> str:
    by = f"{group}," if group else ""
    grouped = "GROUP BY 1" if group else ""
    name = f"{group.split(' AS ')[-1]}," if group else ""
    return f"""(WITH x AS (SELECT {by} {_CELLS} FROM {cases} {grouped}),
      r AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END * 100.0 AS block_rate, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END * 100.0 AS fp_rate,
        CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS recall FROM x)
      SELECT {name} tp, fp, tn, fn, block_rate, fp_rate, precision, recall, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) * 100 ELSE 0 END AS f1, block_rate - fp_rate AS youden FROM r)"""


def rounded(*names: str) -> str:
    return ", ".join(f"round({name}, 6)::DOUBLE AS {name}" for name in names)


_SIX = ("block_rate", "fp_rate", "precision", "recall", "f1", "youden")
_FOUR = ("block_rate", "fp_rate", "f1", "youden")
_BY_LANG = scores_sql("lang", CASES)
ORACLES["detector_scores"] = f"SELECT lang, tp, fp, tn, fn, {rounded(*_SIX)} FROM {_BY_LANG}"
ORACLES["score_overall"] = f"""SELECT 'micro' AS average, tp + fp + tn + fn AS cases, {rounded(*_FOUR)} FROM {scores_sql('', CASES)}
  UNION ALL SELECT 'macro', CAST(sum(tp + fp + tn + fn) AS BIGINT), {', '.join(f'round(avg({name}), 6)::DOUBLE' for name in _FOUR)} FROM {_BY_LANG}"""
_GROUPED = scores_sql("lang || '-' || quality AS grp", CASES)
ORACLES["gate_violations"] = f"""SELECT grp AS "group", concat_ws('; ', CASE WHEN block_rate < 95 THEN 'block rate below gate' END, CASE WHEN fp_rate > 5 THEN 'false positive rate above gate' END) AS violation
  FROM {_GROUPED} WHERE block_rate < 95 OR fp_rate > 5"""
_BAND = "CASE WHEN {x} >= 98 THEN 'Grade A+' WHEN {x} >= 90 THEN 'Grade A' WHEN {x} >= 80 THEN 'Grade B' ELSE 'Grade C / D' END"
ORACLES["rating_bands"] = f"SELECT lang, {_BAND.format(x='youden')} AS youden_band, {_BAND.format(x='f1')} AS f1_band FROM {_BY_LANG}"
_RATCHET = f"""WITH cases AS (SELECT * FROM {CASES}), cur AS (SELECT DISTINCT lang AS harness, 'case ' || doc_id % 50 AS name FROM cases WHERE is_attack AND NOT detected),
  kno AS (SELECT DISTINCT lang AS harness, 'case ' || doc_id % 50 AS name FROM cases WHERE is_attack AND NOT detected AND lang <> 'es' AND doc_id % 7 <> 0)"""
ORACLES["ratchet_diff"] = f"""{_RATCHET}, lim AS (SELECT harness, count(*) AS allowed FROM kno GROUP BY 1),
  cmp AS (SELECT harness, count(*) FILTER (WHERE c.name IS NOT NULL) AS bypassed, count(*) FILTER (WHERE k.name IS NULL) AS new, count(*) FILTER (WHERE c.name IS NULL) AS fixed
    FROM (SELECT harness, name, 1 AS x FROM cur) c FULL JOIN (SELECT harness, name, 1 AS y FROM kno) k USING (harness, name) GROUP BY 1)
  SELECT harness, CAST((SELECT count(*) FROM cur c WHERE c.harness = cmp.harness) AS BIGINT) AS bypassed,
    (SELECT count(*) FROM (SELECT name FROM cur c WHERE c.harness = cmp.harness EXCEPT SELECT name FROM kno k WHERE k.harness = cmp.harness)) AS new,
    (SELECT count(*) FROM (SELECT name FROM kno k WHERE k.harness = cmp.harness EXCEPT SELECT name FROM cur c WHERE c.harness = cmp.harness)) AS fixed,
    CAST(coalesce(allowed, -1) AS BIGINT) AS allowed,
    CASE WHEN allowed IS NULL THEN 'NO_BASELINE' WHEN (SELECT count(*) FROM cur c WHERE c.harness = cmp.harness) > allowed THEN 'REGRESSED'
      WHEN (SELECT count(*) FROM cur c WHERE c.harness = cmp.harness) < allowed THEN 'IMPROVED'
      WHEN EXISTS (SELECT name FROM cur c WHERE c.harness = cmp.harness EXCEPT SELECT name FROM kno k WHERE k.harness = cmp.harness) THEN 'CHANGED' ELSE 'OK' END AS status
  FROM (SELECT harness FROM cur UNION SELECT harness FROM kno) cmp LEFT JOIN lim USING (harness)"""
ORACLES["ratchet_diff"] = re.sub(r"cmp AS \(SELECT harness, count\(\*\) FILTER.*?GROUP BY 1\)\n", "unused AS (SELECT 1)\n", ORACLES["ratchet_diff"], flags=re.S)
ORACLES["ratchet_cases"] = f"{_RATCHET} SELECT *, 'NEW' AS change FROM (SELECT * FROM cur EXCEPT SELECT * FROM kno) UNION ALL SELECT *, 'FIXED' FROM (SELECT * FROM kno EXCEPT SELECT * FROM cur)"
ORACLES["false_positive_report"] = f"SELECT rule, count(*) AS n FROM {CASES} WHERE toxic <> 1 AND rule <> '' GROUP BY 1"
ORACLES["shielded_comparison"] = f"""
  WITH m AS (SELECT block_rate AS shielded_defense, fp_rate, f1 AS f1_score FROM {scores_sql('', CASES)}),
  n AS (SELECT n_name AS model, ((0.7 + n_nationkey / 100) + (0.6 + n_nationkey / 100)) / 2 * 100 AS native_defense, CAST(n_nationkey * 20 + 100 AS DOUBLE) AS base FROM nation)
  SELECT model, {rounded('native_defense', 'shielded_defense', 'fp_rate', 'f1_score')}, round(shielded_defense - native_defense, 6)::DOUBLE AS uplift,
    round(base + 0.00903, 6)::DOUBLE AS total_latency_ms, round(0.00903 / base * 100, 6)::DOUBLE AS overhead_pct FROM n, m"""


# --- reversible masking ----------------------------------------------------------------------------------------

def _vault_ctes() -> str:
    """CTEs f (turns with one mark per value, and the values) and v (the vault), rule by rule on what earlier rules left."""
    from textwarden.operators.vault import _MARKS, KINDS, PLACEHOLDER

    edge = {"CREDIT_CARD": r"(?:[0-9][ -]?){11,18}[0-9]", "PHONE": r"(?:\+66|0)[-.\s]?[2689][-.\s]?[0-9][-.\s]?[0-9]{3}[-.\s]?[0-9]{4}|(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"}
    rules = [("LITERAL", PLACEHOLDER), *[(label, pattern) for label, pattern, _ in fv.PII_RULES]]
    ctes, lists = [f"s0 AS (SELECT conv_id, turn, text, text AS t FROM {turns(plants.VAULT)})"], []
    hidden = []
    for n, (kind, pattern) in enumerate(rules):
        if kind in edge:
            whole = f"{_EDGE_L}(?:{edge[kind]}){_EDGE_R}"
            values = f"list_transform(regexp_extract_all(t, {q(whole)}), lambda x: regexp_extract(x, {q(edge[kind])}))"
            left = f"regexp_replace(t, {q(whole)}, {q(rf'\1{_MARKS[kind]}\2')}, 'g')"
        else:
            whole = pattern
            values = f"regexp_extract_all(t, {q(pattern)})"
            left = f"regexp_replace(t, {q(pattern)}, {q(_MARKS[kind])}, 'g')"
        if n:
            hidden.append(f"regexp_matches(form, {q(whole)})")
        held = "".join(f", x{i}" for i in range(n))
        ctes.append(f"s{n + 1} AS (SELECT conv_id, turn, text{held}, {values} AS x{n}, {left} AS t FROM s{n})")
        lists.append(f"list_transform(x{n}, lambda x, i: {{'kind': {q(kind)}, 'place': i, 'original': x}})")
    ctes.append(f"h AS (SELECT *, {_form('t', f'[{fv.PII_INVISIBLES}]')} AS form FROM s{len(rules)})")
    whole = "[{'kind': 'TEXT', 'place': 1, 'original': text}]"
    ctes.append(f"f AS (SELECT conv_id, turn, text, CASE WHEN hid THEN {q(_MARKS['TEXT'])} ELSE t END AS t, CASE WHEN hid THEN {whole} ELSE {' || '.join(lists)} END AS xs FROM (SELECT *, {' OR '.join(hidden)} AS hid FROM h))")
    ctes.append("e AS (SELECT conv_id, turn, x.kind AS kind, x.place AS place, x.original AS original FROM (SELECT conv_id, turn, unnest(xs) AS x FROM f))")
    ctes.append("v AS (SELECT conv_id, kind, row_number() OVER (PARTITION BY conv_id, kind ORDER BY first) AS n, original FROM (SELECT conv_id, kind, original, min({'turn': turn, 'place': place}) AS first FROM e GROUP BY ALL))")
    names = ", ".join(f"list('<{kind}_' || n || '>' ORDER BY place) FILTER (kind = {q(kind)}) AS n_{kind}" for kind in KINDS)
    ctes.append(f"g AS (SELECT conv_id, turn, {names} FROM e JOIN v USING (conv_id, kind, original) GROUP BY ALL)")
    filled = "t"
    for kind in KINDS:
        filled = f"array_to_string(list_transform(string_split({filled}, {q(_MARKS[kind])}), lambda part, i: part || coalesce(n_{kind}[i], '')), '')"
    ctes.append(f"m AS (SELECT f.conv_id, f.turn, {filled} AS masked FROM f LEFT JOIN g ON g.conv_id = f.conv_id AND g.turn = f.turn)")
    return ",\n  ".join(ctes)


ORACLES["vault_mask"] = f"WITH {_vault_ctes()} SELECT conv_id, turn, masked FROM m"
ORACLES["vault_entries"] = f"WITH {_vault_ctes()} SELECT conv_id, kind, n, original FROM v"
ORACLES["vault_round_trip"] = f"SELECT conv_id, turn, text AS unmasked FROM {turns(plants.VAULT)}"
_ANSWER = "CASE WHEN count(original) FILTER ({0}) > 0 THEN min(original) FILTER ({0}) ELSE '<{1}>' END"
_NAMED = [_ANSWER.format(f"kind = '{kind}' AND n = {n}", f"{kind}_{n}") for kind, n in (("PHONE", 1), ("PHONE", 2), ("EMAIL", 1), ("LITERAL", 1))]
ORACLES["vault_answers"] = f"""WITH {_vault_ctes()} SELECT c.conv_id, 'Call ' || {_NAMED[0]} || ' or ' || {_NAMED[1]} || ', write ' || {_NAMED[2]} || ', not <EMAIL_77> or <phone_1>; it said ' || {_NAMED[3]} || '.' AS unmasked
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN v USING (conv_id) GROUP BY c.conv_id"""


# --- streams ---------------------------------------------------------------------------------------------------

ORACLES["stream_metrics"] = f"SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start_s, {_COUNTERS}, {_LATENCY} FROM {OUTCOMES} GROUP BY 1"
ORACLES["stream_sliding_metrics"] = f"""
  SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) - shift * 86400 AS start_s, action, count(*) AS total, {_LATENCY}
  FROM {OUTCOMES}, (SELECT unnest([0, 1]) AS shift) GROUP BY 1, 2"""
ORACLES["stream_recent"] = f"SELECT trace_id, action, threat_category FROM {_RECENT}"
ORACLES["stream_audit"] = f"WITH {_audit_ctes(plain=True)} SELECT event_id, chain_id, record_no, record_hash FROM c"
ORACLES["stream_distinct_traces"] = f"SELECT event_id, trace_id || '-x' AS trace_id, action FROM {OUTCOMES}"
ORACLES["stream_guard"] = f"SELECT conv_id, turn, allowed, threat_type, risk_level FROM {decision_sql(_PTURNS, _CT)}"

ORACLES["stream_canary"] = ORACLES["canary_chunks"]
ORACLES["stream_vault"] = ORACLES["vault_mask"]
