"""Article extraction, hard negatives and whitening against plain versions over small hostile tables."""

import math

import numpy as np
import pytest

from textwarden.llm import negatives, webpages, whitening
from textwarden.llm.markup import Page

ARTICLE = [f"Sentence {i} of a story about rivers, hills and towns." for i in range(400)]


def page(i, body="", before="", after=""):
    return f"<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style></head><body>{before}{body}{after}</body></html>"


def test_markup_that_is_no_article_goes():
    html = page(
        1,
        "<main class='with-sidebar'><article><header><h1>A &lt;b&gt;&nbsp; title &amp;amp; more</h1><p>By somebody</p></header><p>One<br>two <b class=ad-link>three<p>Four &#x41;&#66; 5 < 6"
        "<div class=ad-box>Buy</div><ul><li>a<li>b <a class=nav-link href='/x>y'>linked</a></ul><table><tr><td>1<td>2<tr><td>3</table><section id=reader-comments><article class=comment>bad</article></section>"
        "<form><label>mail</label><input></form><script>var t='</p><p>no</p>';</script><!-- <p>no</p> --><div hidden>no</div><p style='display: none'>no</p><pre>x\n  y</pre><footer>f</footer></article></main>",
        "<div id=header><h1>Site</h1></div><nav>menu</nav><div class='cookieNotice'>cookies</div><div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div>",
        "<aside>more</aside><div role=contentinfo>imprint</div>",
    )
    assert Page(html).blocks()[0] == ["A <b> title &amp; more", "One two three", "Four AB 5 < 6", "a", "b linked", "1 2", "3", "x y"]


def test_broken_deep_and_empty_markup():
    assert Page("").blocks()[0] == [] and Page("  \n").blocks()[0] == []
    assert Page("plain <3 text & more").blocks()[0] == ["plain <3 text & more"]
    assert Page("<p>whole</p><p>cut <a hre").blocks()[0] == ["whole", "cut"]
    assert Page("<div>" * 50_000 + "deep").blocks()[0] == ["deep"]
    assert len(Page("<p><i>x" * 20_000).blocks()[0]) == 20_000
    assert Page("<a b=\"" * 30_001).blocks()[0] == []
    assert Page("<p>a<!-- b").blocks()[0] == ["a"] and Page("<p>a<!-->b</p></div></x>c").blocks()[0] == ["ab", "c"]


@pytest.fixture(scope="module")
def site(spark):
    """Hosts whose templates carry no telling names; copies and shared passages stay."""
    notice, shared = "<div class=q1><p>We value you, dear guests.</p><p>Read our rules.</p></div>", "<p>A passage that many stories share, word for word, and that has to stay.</p>"
    rows, want = [], []

    def add(url, html, text):
        rows.append((len(rows), url, html, "r", "s", None))
        want.append(text)

    def story(i, n=4):
        return [ARTICLE[(i * 7 + k) % len(ARTICLE)] + f" Part {i}." for k in range(n)]

    for i in range(40):  # no article element: a box on all pages of the host, in varying places
        parts = story(i)
        body = [f"<p>{p}</p>" for p in parts]
        body.insert(i % 3, notice)
        add(f"https://plain.example/{i}", page(i, f"<div class=k7>{''.join(body)}</div>"), "\n".join(parts))
    for i in range(30):  # articles that share a passage on a third of the pages, and a bare line on all of them
        parts = story(100 + i)
        some = shared if i % 3 == 0 else ""
        text = [*parts, shared[3:-4]] if some else parts
        add(f"http://user@WWW.News.example:80/{i}", page(i, f"<article>{''.join(f'<p>{p}</p>' for p in parts)}{some}<p>Get our app today!</p></article>"), "\n".join(text))
    copied = story(300, 6)
    for i in range(25):  # copies of one article under menus of their own
        add(f"http://copies.example/{i}", page(i, f"<article>{''.join(f'<p>{p}</p>' for p in copied)}</article>", f"<ul><li>menu {i}</li></ul>"), "\n".join(copied))
    for _ in range(6):  # equal pages: one page for the counts
        add("http://copies2.example/", page(0, f"<div>{''.join(f'<div><p>{p}</p></div>' for p in copied)}</div>"), "\n".join(copied))
    for i in range(20):  # the same box without a site
        add(None if i % 2 else "no url", page(i, f"<p>{ARTICLE[i]}</p>{notice}"), f"{ARTICLE[i]}\nWe value you, dear guests.\nRead our rules.")
    for html in (None, "", " \n ", "<p></p>"):
        add("https://plain.example/x", html, "")
    long = " ".join(ARTICLE * 20)
    add("https://plain.example/long", page(9, f"<p>{long}</p>{notice}"), long)
    add("https://plain.example/u", "<p>a&#xD800;b&#x1F600;</p>", "a�b\U0001f600")
    rows[5:5] = [rows[7]]  # a repeated row
    return spark.createDataFrame(rows, "page_id int, url string, html string, row string, site string, template int").repartition(3), want


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_templates_of_a_site_go_and_all_else_stays(spark, site, broadcast, monkeypatch):
    monkeypatch.setattr(webpages, "BROADCAST", broadcast)
    table, want = site
    got = webpages.extract_articles(table).selectExpr("row.*", "text", "n_chars", "n_template").collect()
    assert len(got) == len(want) + 1
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text), (r.page_id, r.url)
        assert r.row == "r" and r.site == "s" and r.template is None
    assert all(r.n_template > 0 for r in got if r.page_id < 70) and not any(r.n_template for r in got if 70 <= r.page_id < 121)
    assert webpages.extract_articles(table.where("false")).count() == 0


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * rng.standard_normal(8)).astype(np.float32).tolist(), int(i % 4)) for i in range(400)]
    rows += [(400 + i, rows[100][1], 0 if i % 2 else 3) for i in range(60)]  # one vector many times
    rows += [(500, [0.0] * 8, 1), (501, [-0.0] * 8, 2), (502, None, 1), (503, [float("nan")] + [1.0] * 7, 1), (504, [1.0, None] * 4, 2), (505, rows[3][1], None), (None, rows[4][1], 1)]
    rows += [(506, [1.0] * 5, 1), (507, [2.0] * 5, 2), (508, [1.5] * 5, 1), (509, [float("inf")] + [1.0] * 7, 1), (510, [-x for x in rows[10][1]], 2), (511, [1e30] * 8, 1), (512, [3e6] * 8, 1), (513, [2.5e6] * 8, 3), (10, rows[10][1], 2), (10, rows[10][1], 2)]
    return rows


def plain_negatives(rows, picked):
    whole = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = tuple(math.floor(256 * float(np.float32(c))) for c in v)
        if sum(c * c for c in x) < 2**63:
            whole[i, label, x] = None
    out = set()
    for i, label, x in whole:
        if not picked(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, other) for j, other, y in whole if j != i and len(y) == len(x))
        for s, j, _ in [r for r in scored if r[2] == label][:5]:
            bad = [(t, k) for t, k, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out |= {(i, j, n, k, -s, -t) for n, (t, k) in enumerate(bad, 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_negatives_are_those_of_brute_force(spark, small, monkeypatch):
    if small:  # many cells, several blocks of a cell, and a second round that matters
        for name, value in (("CELL", 8), ("FIRST", 3), ("MEMBERS", 5), ("REQUESTS", 4)):
            monkeypatch.setattr(negatives, name, value)
    rows = vectors()
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, anchor int, cell string").repartition(3)
    from pyspark.sql import functions as F

    got = negatives.hard_negatives(table, F.col("vec_id") % 10 == 0)
    assert {tuple(r) for r in got.collect()} == plain_negatives(rows, lambda i: i % 10 == 0)
    assert got.count() == len(plain_negatives(rows, lambda i: i % 10 == 0))
    assert negatives.hard_negatives(table, F.lit(None).cast("boolean")).count() == 0
    assert negatives.hard_negatives(table.where("false"), F.lit(True)).count() == 0


def test_anchors_are_not_copied_for_the_cells_they_visit(spark, monkeypatch):
    for name, value in (("CELL", 8), ("FIRST", 3), ("MEMBERS", 64), ("REQUESTS", 16)):
        monkeypatch.setattr(negatives, name, value)
    kept = []

    def kept_rows(df, purpose):
        out = keep(df, purpose)
        kept.append((purpose, out.count()))
        return out

    keep = negatives.keep
    monkeypatch.setattr(negatives, "keep", kept_rows)
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    from pyspark.sql import functions as F

    got = negatives.hard_negatives(table, F.col("vec_id") % 10 == 0)
    assert {tuple(r) for r in got.collect()} == plain_negatives(rows, lambda i: i % 10 == 0)
    anchors = dict(kept)["anchors"]
    assert [n for purpose, n in kept if purpose == "visits" and n > anchors] == []


def test_cells_come_by_falling_bound():
    rng = np.random.default_rng(2)
    a, b = np.r_[rng.standard_normal(7), -np.inf], rng.standard_normal(5)
    got = list(negatives.best_first(a, b))
    want = sorted(((x + y, i, j) for i, x in enumerate(a[:7]) for j, y in enumerate(b)), reverse=True)
    assert [(i, j) for _, i, j in got] == [(i, j) for _, i, j in want] and np.allclose([g[0] for g in got], [w[0] for w in want])


def test_rank_one_updates():
    rng = np.random.default_rng(5)
    for trial in range(120):
        n = int(rng.integers(1, 12))
        values = np.sort(np.round(rng.random(n) * 3, 0 if trial % 3 == 0 else 9))
        q, z = np.linalg.qr(rng.standard_normal((n, n)))[0], rng.standard_normal(n) * 10.0 ** rng.integers(-7, 7)
        z[rng.random(n) < (0.5 if trial % 4 == 0 else 0)] = 0
        whole = q @ np.diag(values) @ q.T + np.outer(z, z)
        got, u = whitening.rank_one(values, q, z)
        assert np.abs(u @ np.diag(got) @ u.T - whole).max() <= 1e-12 * max(1e-300, np.abs(whole).max())
        assert np.abs(u.T @ u - np.eye(n)).max() < 1e-12 and (np.diff(got) >= 0).all()


def test_whitening_is_that_of_the_whole_covariance(spark):
    rows = [r for r in vectors() if r[0] not in (511, 512, 513)]
    spread = np.diag(np.linspace(0.2, 3, 8))
    rows = [(i, v if v is None or len(v) != 8 or None in v else [float(np.float32(c)) for c in np.asarray(v) @ spread], label) for i, v, label in rows if i not in (503, 509)]
    rows += [(503, [float("nan")] + [1.0] * 7, 1), (509, [float("inf")] + [1.0] * 7, 1)]
    table = spark.createDataFrame([(*r, 1, b"x") for r in rows], "vec_id long, embedding array<float>, label int, component int, state binary").repartition(9)
    used = [(i, v) for i, v, _ in rows if v is not None and len(v) == 8 and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in used])
    n, sums = len(x), x.sum(0)
    away = x - sums / n
    values, basis = np.linalg.eigh(away.T @ away / n)
    values, basis = values[::-1], basis[:, ::-1]
    got = whitening.whiten(table, components=5).collect()
    assert len(got) == 5 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    deviation = {}
    for (i, _), row in zip(used, x.tolist(), strict=True):
        deviation.setdefault(i, set()).add(sum((n * a - int(s)) ** 2 for a, s in zip(row, sums, strict=True)))
    for c in range(1, 6):
        mine = [r for r in got if r.component == c]
        assert all(r.deviation in deviation[r.vec_id] for r in mine) and abs(mine[0].explained - values[c - 1] / values.sum()) < 1e-9
        plain = away @ basis[:, c - 1] / np.sqrt(values[c - 1])
        a = sorted((r.vec_id is None, r.vec_id or 0, r.whitened) for r in mine)
        for sign in (1, -1):
            b = sorted((i is None, i or 0, sign * y) for (i, _), y in zip(used, plain, strict=True))
            if np.allclose([t[2] for t in a], [t[2] for t in b], atol=1e-8):
                break
        else:
            raise AssertionError(c)


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(6)], kind)).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    big = whitening.whiten(spark.createDataFrame([(i, [1e13 * (i + 1), -1e13 * i * i]) for i in range(9)], kind)).collect()
    assert len(big) == 18 and all(r.deviation is None for r in big if r.vec_id in (0, 8)) and big[0].identity_error < 1e-9
