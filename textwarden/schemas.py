"""Schemas of the tables that jobs read."""

from __future__ import annotations

ROUTE = (
    "route_no int, id string, path string, upstream string, type string, auth_required boolean, "
    "required_roles array<string>, canary_tokens array<string>, "
    "guardrails struct<fast_waf:boolean,prompt_injection:boolean,jailbreak:boolean,pii_masking:boolean,"
    "output_guard:boolean,agentic_sentinel:boolean>"
)
API_KEY = "key_hash string, id string, tenant_id string, roles array<string>, rate_limit int"
REQUEST = (
    "request_id bigint, path string, query string, headers map<string,array<string>>, body string, prompt string, "
    "response string, upstream_status int"
)
AUDIT_EVENT = (
    "ts_ns bigint, trace_id string, client_id string, client_ip string, route string, action string, "
    "threat_category string, severity string, confidence double, reason string, matched_rule string"
)
OUTCOME = (
    "status int, action string, threat_category string, severity string, waf_us bigint, guard_us bigint, proxy_us bigint"
)
