import posixpath
import random

from pyspark.sql import functions as F

from textwarden.functions import net
from textwarden.operators import routing
from textwarden.operators.routing import Route


def plain_match(routes, path):
    """Exact path first, else the first declared wildcard that covers the cleaned path."""
    clean = posixpath.normpath("/" + path.lstrip("/")) if path.startswith("/") else posixpath.normpath(path) if path else "."
    targets = [(posixpath.normpath(r.path), r.id) for r in routes]
    for target, name in targets:
        if target == clean:
            return name
    for target, name in targets:
        if target.endswith("/*"):
            if clean == target[:-2] or clean.startswith(target[:-1]):
                return name
        elif target.endswith("*") and clean.startswith(target[:-1]):
            return name
    return None


def test_compiled_routes_equal_the_table_and_a_plain_walk(spark):
    rng = random.Random(3)
    words = ["a", "b", "ab", "users", "ü"]
    some = lambda n: "/" + "/".join(rng.choice(words) for _ in range(n))
    routes = [Route(f"r{i}", some(rng.randint(1, 3)) + rng.choice(["", "/*", "*", "/x*"])) for i in range(120)] + [Route("twice", "/a"), Route("twice2", "/a")]
    paths = [some(rng.randint(1, 5)) + rng.choice(["", "/", "/../b", "//c", "/./a"]) for _ in range(400)] + ["/", "", "/..", "a/b", "/x\ny", "/usersx", "/" + "a/" * 3000]
    log = spark.createDataFrame([(i, p) for i, p in enumerate(paths)] + [(9999, None)], "n long, path string").withColumn("id", F.lit("kept"))
    compiled = routing.match_routes(log, routes)
    got = {r["n"]: r["route_id"] for r in compiled.collect()}
    assert got == {**{i: plain_match(routes, p) for i, p in enumerate(paths)}, 9999: None}
    short = log.where("length(path) < 500 or path is null")
    table = {r["n"]: r["route_id"] for r in routing.match_routes(short, routing.routes_frame(spark, routes)).collect()}
    assert table == {n: name for n, name in got.items() if n in table}
    assert len({v for v in got.values()}) > 20
    assert "Exchange" not in compiled._jdf.queryExecution().executedPlan().toString()


def test_only_wildcards_or_no_routes_at_all(spark):
    log = spark.createDataFrame([("/v/1",), ("/",)], "path string")
    assert [r["route_id"] for r in routing.match_routes(log, []).collect()] == [None, None]
    assert [r["route_id"] for r in routing.match_routes(log, [Route("all", "/*")]).collect()] == ["all", "all"]
    assert routing.unrouted(log, [Route("v", "/v/*")]).collect()[0]["path"] == "/"


def test_configured_paths_are_cleaned_like_requested_ones(spark):
    paths = ["/a/../b", "a/..", "../x/./y", "//", "", "/..", "/a//*", "/s*", "./", "a/../../b"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", net.clean_path(F.col("p")).alias("c")).collect()
    assert {r["p"]: r["c"] for r in rows} == {p: net.cleaned(p) for p in paths}


def test_small_key_tables_are_broadcast_by_their_size(spark):
    keys = routing.sized_frame(spark, [("digest", "me", "t", ["user"], None)], "key_hash string, id string, tenant_id string, roles array<string>, rate_limit int")
    log = spark.range(10).select(F.col("id").cast("string").alias("key"))
    found = routing.identify(log, keys, F.col("key"))
    assert found.count() == 10 and "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_client_ip_by_table_is_that_of_the_literal_networks(spark):
    rng = random.Random(3)
    four = lambda: f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}"
    six = lambda: f"fd00:{rng.randrange(1, 4):x}::{rng.randrange(1, 40):x}"
    address = lambda: rng.choice([four, six])()
    networks = [*[f"{four()}/{rng.choice((22, 24, 25, 27, 30, 32))}" for _ in range(30)], *[f"{six()}/{rng.choice((30, 32, 64, 123, 126, 128))}" for _ in range(30)], "10.0.3.9", "bad", "10.0.0.0/99", "", None]
    rows = [(i, f"[{a}]:80" if ":" in (a := address()) else f"{a}:80", ", ".join([address(), address(), "smoke", address()])) for i in range(400)]
    rows += [(400, None, None), (401, "", ""), (402, "10.0.3.9:1", None), (None, "10.0.3.9:1", "8.8.8.8")]
    log = spark.createDataFrame(rows, "id long, remote string, forwarded string")
    table = spark.createDataFrame([(n,) for n in networks], "network string")
    want = {r["id"]: r["client_ip"] for r in routing.client_ip(log, "remote", "forwarded", [n for n in networks if n]).collect()} | {None: "10.0.3.9:1"}
    found = routing.client_ip_by_table(log, "id", "remote", "forwarded", table)
    got = found.collect()
    assert len(got) == len(rows) and {r["id"]: r["client_ip"] for r in got} == want
    assert len({r["client_ip"] for r in got if r["id"] is not None} & {r[1] for r in rows}) < 400
    assert {r["client_ip"] for r in routing.client_ip_by_table(log, "id", "remote", "forwarded", table.where("false")).collect()} == {r[1] for r in rows}
