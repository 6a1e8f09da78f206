"""Vectors, mixing, shards, classifiers, chats and the pipeline."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from textwarden.llm import chat, language, mixing, multiindex, quality, sharding, tables


def vectors():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 16))
    out = [(i, v.tolist()) for i, v in enumerate(base)]
    out += [(100 + i, (base[i % 9] + rng.normal(scale=0.1, size=16)).tolist()) for i in range(60)]
    out += [(200 + i, base[5].tolist()) for i in range(20)]
    return [*out, (300, None), (301, [0.0] * 16), (302, [1.0] * 15), (303, [float("nan")] * 16), (304, [None] * 16), (305, (2 * base[5]).tolist()), (None, base[5].tolist()), (7, base[7].tolist())]


def test_vector_links_are_those_of_brute_force(spark):
    rows = vectors()
    valid = [(d, np.array(v)) for d, v in rows if d is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in valid])
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    root = {d: d for d, _ in valid}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, j in np.argwhere(linked):
        a, b = find(valid[i][0]), find(valid[j][0])
        root[max(a, b)] = min(a, b)
    links = Counter((d, int(n), find(d), find(d) == d) for (d, _), n in zip(valid, linked.sum(1), strict=True))
    links += Counter((d, 0, d, d is not None) for d in (300, 301, 302, 303, 304, None))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in multiindex.near_vectors(df).collect()) == links
    assert multiindex.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("recall", [None, 0.95])
def test_vectors_of_many_dimensions_and_few_directions_keep_their_links(spark, recall):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 4)) @ rng.normal(size=(4, 768)) + rng.normal(scale=0.02, size=(4000, 768))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in (multiindex.near_vectors(df) if recall is None else multiindex.near_vectors(df, recall=recall)).collect()}
    if recall is None:
        assert [got[i] for i in range(len(x))] == want.tolist()
    else:
        assert all(got[i] <= n for i, n in enumerate(want.tolist())) and sum(got.values()) >= 0.93 * want.sum()


def test_vectors_are_not_copied_for_the_cells_they_visit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(multiindex, "MEMBERS", 200)
    monkeypatch.setattr(multiindex, "HELD", 100)
    monkeypatch.setattr(tables, "shared_folder", lambda _, purpose: f"{tmp_path}/{purpose}-{len(list(tmp_path.iterdir()))}")
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x[2000:2600] = x[1000:1600] + 0.1 * rng.normal(size=(600, 64))
    x[2600:] = x[7]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = multiindex.near_vectors(df).collect()
    assert [(r.n_links, r.component_id) for r in sorted(got)] == [(n - 1, first) for n, first in zip(linked.sum(1).tolist(), linked.argmax(1).tolist(), strict=True)]
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 3 * x.nbytes


def test_pivotal_rounding_keeps_words_and_odds():
    rng = np.random.default_rng(5)
    size, x = rng.integers(1, 50, 30).astype(float), rng.random(30)
    tries = [mixing.pivotal(size, x, rng.random(30)) for _ in range(3000)]
    for t in tries:
        assert abs((size * t).sum() - (size * x).sum()) < 1e-6 and ((t > 1e-9) & (t < 1 - 1e-9)).sum() <= 1
    assert np.abs(np.mean(tries, axis=0) - x).max() < 0.05


def test_mix_meets_targets_and_reruns_agree(spark, docs, rows, no_docs, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    got = mixing.mix_sources(docs).collect()
    sizes, sources = defaultdict(int), defaultdict(lambda: [0, 0.0])
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s))
    total, weight, capped = sum(sizes.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        rate = (1.5 * total - sum(2 * sizes[s] for s in capped)) / max(1e-9, sum(weight[s] for s in names if s not in capped))
        over = {s for s in names if s not in capped and rate * weight[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(2 * sizes[r.source] if r.source in capped else rate * weight[r.source])
        assert r["size"] * r.copies <= 2 * r["size"]
        sources[r.source][0] += r["size"] * r.copies
        sources[r.source][1] = max(sources[r.source][1], r["size"])
    for s, (taken, largest) in sources.items():
        assert abs(taken - (2 * sizes[s] if s in capped else rate * weight[s])) <= largest
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_sources(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


@pytest.mark.parametrize("shards", [1, 5])
def test_shards_are_near_equal_and_gapless(spark, docs, no_docs, shards):
    many = docs.unionByName(spark.range(4000).selectExpr("id + 1000 AS doc_id", "'one hot text' AS text", "'s' AS source", "1 AS n", "'' AS sig", "'' AS rows"))
    got = sharding.shard_documents(many, shards=shards).collect()
    assert len(got) == many.count()
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += len((r.text or "").encode()) + 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(shards))
    largest = max(len((r.text or "").encode()) + 8 for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 3 * largest
    assert sharding.shard_documents(no_docs).count() == 0


def test_classifiers_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from textwarden.llm.queries import op7_quality, op10_language_id

    folder = "/root/testdata/sf0.01"
    scored = op7_quality(spark, folder).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9, auc
    found = op10_language_id(spark, folder).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)


def test_classifiers_on_hostile_rows(spark, docs, rows, no_docs):
    model = quality.fit(docs.selectExpr("text", "cast(doc_id % 2 as int) AS label"))
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    none = quality.fit(no_docs.selectExpr("text", "1 AS label"))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    tongues = language.fit(docs.selectExpr("text", "if(doc_id < 30, 'a', 'b') AS lang"))
    found = {r.row.doc_id: r for r in language.identify(docs, tongues).collect()}
    assert all((found[d].lang_pred, found[d].score, found[d].rejected) == ("und", 0.0, True) for d in (400, 401, 402))
    assert found[0].lang_pred in "ab" and found[405].row.text == dict((r[0], r[1]) for r in rows)[405]
    assert language.identify(no_docs, tongues).count() == 0


def test_chats_read_back(spark):
    said = "</s>[INST] ok [/INST]~<|turn|>x\n<|end|>\n~1"
    turns = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, "assistant", None), (2, None, "us\ner", "é"), (None, 0, None, "x"), (3, 0, "assistant", ""), (1, 1, "assistant", said)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for conv, r in got.items():
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
        text = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in own)
        loss = "".join(text or "" for _, _, role, text in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_turns(df.where("false")).count() == 0
    for piece in chat.format_turns(df).collect():
        body = piece.piece[len(chat.OPEN) : -len(chat.CLOSE) - 1]
        assert not any(c in body for c in ("<|", "</s>", "[INST]", "[/INST]"))


def test_typed_parts_become_placeholders():
    flat = chat.Flatten()
    for part in ({"kind": "text", "text": "a<|b"}, {"kind": "image", "ref": "i.png", "width": 57, "height": 28}, {"kind": "audio", "ref": "s.wav", "seconds": 2.0}, {"kind": "document", "ref": "d.pdf", "pages": 3}, {"kind": "video", "ref": "v"}):
        flat.visit(part)
    assert flat.text == "a~1b<|image:0|><|audio:1|><|document:2|><|other:3|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in flat.attachments] == [("image", "i.png", 3), ("audio", "s.wav", 25), ("document", "d.pdf", 768), ("other", "v", 0)]


def test_pipeline_stages_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, folder)
        if i < 4:
            assert after.columns == docs.columns
        if name == "ngram_jaccard":
            from textwarden.llm.jaccard import jaccard_components

            found = jaccard_components(before)
            assert {r.doc_id for r in after.collect()} == {r.component_id for r in found.collect()}
        if name == "decontamination":
            from textwarden.llm.decontaminate import contamination_report

            bench = spark.read.parquet(f"{folder}/benchmark.parquet")
            hit = {r.doc_id for r in contamination_report(before, bench).where("contaminated").collect()}
            texts = {r.doc_id: r.text for r in after.collect()}
            assert all(texts[r.doc_id] == r.text for r in before.collect() if r.doc_id not in hit)
        before = after
    got = before.collect()
    assert {*docs.columns, "shard", "slot"} == set(before.columns) and {r.shard for r in got} <= set(range(24))


def test_long_junk_is_rejected_and_clean_texts_of_all_lengths_stay(spark):
    import base64

    from textwarden.llm.queries import language_model

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_model(docs)
    rng = np.random.default_rng(3)
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto "
    junk = []
    for n in (512, 2048, 8192):
        junk += ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), n)), base64.b64encode(rng.bytes(n)).decode()[:n], rng.bytes(n).hex()[:n], "a " + " ".join(map(str, rng.integers(0, 9999, n // 4))), ('<div class="a"><p></p></div><br/>' * n)[:n], (finnish * n)[:n]]
    found = language.identify(spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "doc_id long, text string"), model).collect()
    assert [r.row.doc_id for r in found if not r.rejected] == []
    held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 and text rlike '[a-z]'").selectExpr("text", "length(text) AS n")
    got = language.identify(held, model).selectExpr("row.n", "rejected").collect()
    short = [r.rejected for r in got if r.n < 200]
    assert len(short) > 40 and sum(short) <= 0.05 * len(short)
    assert np.mean([r.rejected for r in got]) < 0.01


@pytest.mark.parametrize("letters", ["abcdefghijklmnop", "абвгдежзийклмноп", "天地玄黄宇宙洪荒日月盈昃辰宿列张"])
def test_quality_tells_texts_of_one_shape_apart_by_their_words(spark, letters):
    rng = np.random.default_rng(4)
    good, bad = (["".join(rng.choice(list(letters), 5)) for _ in range(60)] for _ in range(2))
    texts = [(i, " ".join(rng.choice((bad, good)[i % 2], 40)), i % 2) for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string, label int")
    model = quality.fit(df.where("doc_id < 120"))
    got = {r.doc_id: r.score for r in quality.score_quality(df.where("doc_id >= 120"), model).collect()}
    assert len(got) == 80 and all((s > 0.9) if d % 2 else (s < 0.1) for d, s in got.items())
