from textwarden.operators import requests, routing
from textwarden.plans.queries import ROUTES

# For each family: values that hit a rule, encoded or split ones among them, then near misses and everyday controls.
BLOCKED = {
    "ref=7%27+AND+1%3D1+--": "SQL_INJECTION", "sort=%27+UNION+ALL+SELECT+pin,null+FROM+lockers--": "SQL_INJECTION", "u=UNI&v=ON+SEL&w=ECT+pin--": "SQL_INJECTION",
    "q=5'+UNI/**/ON+SEL/**/ECT+pin--": "SQL_INJECTION", "q=5'+AND+(1)=(1)--": "SQL_INJECTION", "x=pg_sleep(3)": "SQL_INJECTION", "t=benchmark(900,1)": "SQL_INJECTION",
    "bio=%3Cscript%3Eprompt(7)%3C/script%3E": "XSS", "n=+ADw-script+AD4-go()+ADw-/script+AD4-": "XSS", "goto=vbscript:msgbox(3)": "XSS", "v=%2525253Cscript%2525253E": "XSS", "e=<embed src=y>": "XSS",
    "ping=10.1.1.1;uname+-a": "CMD_INJECTION", "v=`hostname`": "CMD_INJECTION", "p=nl$IFS/srv": "CMD_INJECTION", "f=/usr/l*b": "CMD_INJECTION", "y=b -execdir c": "CMD_INJECTION",
    "doc=..%5c..%5cvault%5cledger.txt": "PATH_TRAVERSAL", "doc=..%c0%af..%c0%afvault": "PATH_TRAVERSAL",
}
PASSED = [
    "q=evening tide tables", "weight>40&order=age", "at=/depot/v3/crates", "lang=F%23 and C%2B%2B", "rows=7,8,9&leaf=4", "tags=oak&tags=elm", "goto=https://tides.example.net/today",
    "from=kim@tides.example.net", "title=Salt %26 Vinegar", "duo=Flour & Water", "range=2019-03-01..2019-04-30", "hint=select a seat from row two", "q=and or but", "name=D'Arcy",
    "q=does 2=2 hold", "memo=wash first; dry later", "md=row p | row q", "build=4.11.0-rc2", "key=0d6f2c44-1b7e-4c55-9f0e-7a3b52c8d901", "q=out-of-the-box thinking", "team=union&task=select",
]
BODIES = {
    '{"ref":"4; DELETE FROM lockers"}': "SQL_INJECTION", '{"c":"<video poster=y onplay=go(2)>"}': "XSS", '{"t":"tide $(date)"}': "CMD_INJECTION",
    '{"job":"printf x | /bin/dash"}': "CMD_INJECTION", '{"code":"while (p && q) { return p|q; }"}': "NONE", '{"t":"Pour it | stir it; serve"}': "NONE",
    '{"t":"wrap it in &lt;em&gt; for stress"}': "NONE", '{"q":"what does /etc/fstab hold"}': "NONE",
}
HEADERS = [
    ("Referer", "vbscript:open('x')", "XSS"), ("Cookie", "token=' AND 'a'='a", "SQL_INJECTION"), ("Authorization", "Basic y' UNION SELECT pin--", "SQL_INJECTION"),
    ("Accept", "<script>", "NONE"), ("Cookie", "visit=77aa; skin=plain; tour=done", "NONE"), ("X-Forwarded-For", "192.0.2.44, 198.51.100.61", "NONE"),
    ("User-Agent", "TideReader/4.2 (+https://tides.example.net/reader)", "NONE"), ("Cookie", "basket=%7B%22lines%22%3A3%7D", "NONE"),
]


def test_surfaces(spark):
    rows = [("/api/x", q, None, None, t) for q, t in BLOCKED.items()] + [("/api/x", q, None, None, "NONE") for q in PASSED]
    rows += [("/api/x", "", None, b, t) for b, t in BODIES.items()] + [("/api/x", "", {k: [v]}, None, t) for k, v, t in HEADERS]
    rows += [("/api/maps/../../vault/ledger", "", None, None, "PATH_TRAVERSAL"), ("/static/tides.css", "", None, None, "NONE")]
    df = spark.createDataFrame(rows, "path string, query string, headers map<string,array<string>>, body string, expected string").coalesce(1)
    wrong = [(r["query"], r["body"], r["verdict"]) for r in requests.scan_requests(df).collect() if r["verdict"]["threat_type"] != r["expected"]]
    assert wrong == []


def test_switches_and_samples(spark):
    df = spark.createDataFrame([("/a", "x=$(" + "b" * 80 + ")<script>")], "path string, query string")
    full = requests.scan_requests(df, headers=None, body=None).first()["verdict"]
    assert full["matched_rule"] == "cmd_subshell_syntax" and full["matched_sample"].endswith("...") and len(full["matched_sample"]) == 53
    only = requests.scan_requests(df, headers=None, body=None, categories=("XSS",)).first()["verdict"]
    assert only["matched_rule"] == "xss_script_tag" and only["surface"] == "query"


def test_route_match(spark):
    paths = {"/v1/chat/completions": "llm-chat", "/api/users/42": "api-users", "/api": "rest-api", "/apiXYZ": None, "/api//x/./y": "rest-api", "/staticfile": "static", "/v1/../api/1": "rest-api", "/nope": None}
    df = spark.createDataFrame([(p,) for p in [*paths, None]], "path string")
    got = {r["path"]: r["route_id"] for r in routing.match_routes(df, routing.routes_frame(spark, ROUTES)).collect()}
    assert got == paths | {None: None}


def test_client_ip(spark):
    cases = [
        ("192.0.2.9:5100", "4.4.8.8", "192.0.2.9:5100"), ("10.7.0.2:5100", "198.51.100.61", "198.51.100.61"), ("10.7.0.2:5100", "4.4.8.8, 198.51.100.61", "198.51.100.61"), ("10.7.0.2:2", "", "10.7.0.2:2"),
        ("[fd12::7]:9", "2001:DB8::7", "2001:db8::7"), ("10.7.0.2:2", "7.7.7.7, 10.8.8.8, smoke", "7.7.7.7"), ("10.7.0.2:2", "10.8.8.8", "10.7.0.2:2"),
    ]
    df = spark.createDataFrame(cases, "remote string, forwarded string, expected string").coalesce(1)
    rows = routing.client_ip(df, "remote", "forwarded", ["10.0.0.0/8", "fd00::/8", "bad"]).collect()
    assert [r["client_ip"] for r in rows] == [r["expected"] for r in rows]
    assert [r["client_ip"] for r in routing.client_ip(df, "remote", "forwarded", []).collect()] == [c[0] for c in cases]
