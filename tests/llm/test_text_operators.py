"""The operators on texts against brute force over small hostile tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textwarden.llm import automaton, decontaminate, jaccard, licences, substrings, wordstream
from textwarden.llm import tables as tables_module


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def removed(words, counts, width):
    gone = [False] * len(words)
    for i in range(len(words) - width + 1):
        if counts[tuple(words[i : i + width])] > 1:
            gone[i : i + width] = [True] * width
    return gone


@pytest.mark.parametrize(("width", "seed"), [(35, 8), (6, 2)])
def test_repeats_are_those_of_brute_force(docs, rows, width, seed):
    words = [blank_words(t) for _, t, _ in rows]
    counts = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    want = Counter()
    for (d, t, _), w in zip(rows, words, strict=True):
        gone = removed(w, counts, width)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if sum(gone) else t] += 1
    got = substrings.remove_repeats(docs, width=width, seed=seed).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == want


def brute_components(rows, percent=75, k=5):
    sets = {}
    for d, t, _ in rows:
        w = blank_words(lower(t or ""))
        sets.setdefault(d, set()).add(frozenset({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    flat = [(d, s) for d, all_ in sets.items() if d is not None for s in all_ if s]
    root = {d: d for d, _ in flat}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(flat):
        for b, t in flat[:i]:
            if 100 * len(s & t) >= percent * len(s | t) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return sets, find, root


@pytest.mark.parametrize("small", [False, True])
def test_components_are_those_of_brute_force(docs, rows, small, monkeypatch):
    if small:  # force hub rounds, hubs in parts and the comparison of all that is left
        for name, value in (("SMALL", 2), ("HUBS", 1), ("FAN", 3)):
            monkeypatch.setattr(jaccard, name, value)
    sets, find, root = brute_components(rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    want = Counter()
    for d, t, _ in rows:
        w = blank_words(lower(t or ""))
        n = len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w))
        want[d, n, find(d) if d in root else d] += 1
    assert got == want
    assert any(find(d) != d for d in root)


def test_hits_and_items_are_those_of_brute_force(spark, docs, rows):
    items = [(1, rows[3][1]), (2, "w005 w016"), (3, None), (4, ""), (5, rows[58][1]), (6, rows[3][1]), (None, rows[4][1]), (7, "cc by")]
    table = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for key, text in items:
        w = plain_words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(key)
    want, share, unhit = Counter(), {}, {}
    for d, t, _ in rows:
        w, named = plain_words(t), set()
        hit = [False] * len(w)
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (keys := windows.get(tuple(w[i : i + size]))):
                    hit[i : i + size] = [True] * size
                    named |= keys
        ids = sorted(str(k) for k in named if k is not None)
        share[d], unhit[d] = sum(hit) / max(1, len(w)), [x for x, h in zip(w, hit, strict=True) if not h]
        want[d, len(w), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), any(hit)] += 1
    for block_words in (100_000, 60):
        got = decontaminate.contamination_report(docs, table, block_words=block_words).collect()
        assert Counter(tuple(r) for r in got) == want
    clean = decontaminate.decontaminate(docs, table)
    assert clean.columns == docs.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    assert set(left) == {d for d, part in share.items() if part <= 0.5} and 3 not in left and left[400] is None
    untouched = {d: t for d, t, _ in rows if not share[d]}
    assert untouched and all(left[d] == t for d, t in untouched.items())
    assert 0 < share[407] <= 0.5 and all(plain_words(t) == unhit[d] for d, t in left.items())


class Shared:
    def __init__(self, value):
        self.value = value


def test_decontamination_cuts_a_large_batch_into_small_ones():
    item = " ".join(f"item{i}" for i in range(12))
    texts = [f"{'lead ' * (i % 7)}{item} {f'own{i} ' * 3000}" if i % 3 == 0 else None if i % 3 == 1 else "plain " * 2500 for i in range(400)]
    empty = pa.array([[]] * len(texts), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), empty, pa.array([[]] * len(texts), pa.list_(pa.string()))], ["c0", "_text", "_spans", "_ids"])
    index = automaton.TextIndex([("a", automaton.plain_words(item))], decontaminate.WIDTH)
    scanned = list(decontaminate._scan(Shared(index), ["c0", "_text"])(iter([batch])))
    cut = list(decontaminate._cut(iter([pa.Table.from_batches(scanned).combine_chunks().to_batches()[0]])))
    for out in (scanned, cut):
        assert sum(b.num_rows for b in out) == len(texts) and max(b.nbytes for b in out) < 2 * wordstream.SLICE
    got = pa.Table.from_batches(cut).to_pylist()
    assert [r["c0"] for r in got] == list(range(len(texts)))
    for r, text in zip(got, texts, strict=True):
        hit = [{"first": r["c0"] % 7, "end": r["c0"] % 7 + 12}] if r["c0"] % 3 == 0 else []
        assert (r["_spans"], r["_ids"], r["_n_words"]) == (hit, ["a"] if hit else [], len(plain_words(text)))
        assert r["_text"] == (text.replace(item, "") if hit else text)


def test_decontamination_sends_a_text_once(spark, docs):
    hits = decontaminate.benchmark_hits(docs, spark.createDataFrame([("a", "one two")], "item_id string, text string"))
    assert hits.columns == [*(f"c{i}" for i, c in enumerate(docs.columns) if c != "text"), "_text", "_n_words", "_spans", "_ids"]


def test_small_pieces_of_text_hold_small_tables(monkeypatch):
    """Hashes are the same whatever was hashed before; what a worker keeps for them follows its pieces."""
    words = lambda text: wordstream.Words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), wordstream.BLANK_WORDS, True)
    small, large = words(b"some words of a text"), words(b"word " * 300_000)
    before = wordstream.Runs(large.hashes()).all(3)[0], small.hashes().tolist(), wordstream.Runs(small.hashes()).all(2).tolist()
    monkeypatch.setattr(wordstream, "_POWERS", {})
    assert (small.hashes().tolist(), wordstream.Runs(small.hashes()).all(2).tolist()) == before[1:]
    assert sum(t.nbytes for held in wordstream._POWERS.values() for t in held) < 4 << 20
    assert wordstream.Runs(large.hashes()).all(3)[0] == before[0]


def test_automaton_finds_longest_matches():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 3, 12).tolist() for _ in range(6)]
    sam = automaton.SuffixAutomaton()
    for t in texts:
        sam.add(t)
    subs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)}
    stream = rng.integers(0, 4, 200).tolist()
    for i, (_, n) in enumerate(sam.statistics(stream), 1):
        assert n == max(m for m in range(i + 1) if tuple(stream[i - m : i]) in subs)


def test_licence_phrases_and_templates(spark, docs, rows):
    mit = licences.TEMPLATES["mit"].replace("hereby granted", "now given")
    more = [(900, f"Header. {mit} tail", None), (901, "CC BY, all RIGHTS reserved! cc by", None), (902, "General Public License", None)]
    table = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"))
    got = {r.doc_id: r for r in licences.scan_licences(table).collect()}
    for d, t, _ in [*rows, *more]:
        w, places, labels = plain_words(t), [], set()
        for phrase, label in licences.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[900].labels == "mit" and got[900].score > 0.8 and got[900].spans[0].first in (1, 2, 3, 4, 5)
    assert got[0].labels == "" and got[0].score == 0


def test_empty_tables_give_empty_results(spark, no_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert substrings.remove_repeats(no_docs).count() == 0
    assert jaccard.jaccard_components(no_docs).count() == 0
    assert decontaminate.contamination_report(no_docs, items).count() == 0
    assert licences.scan_licences(no_docs).count() == 0


def test_components_of_links(spark):
    links = [(1, 2), (2, 3), (9, 3), (20, 21), (30, 30), (22, 21), *((100 + i, 101 + i) for i in range(40))]
    got = {r.node: r.root for r in tables_module.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got.get(n, n) for n in (1, 2, 3, 9)} == {1} and {got.get(n, n) for n in (20, 21, 22)} == {20}
    assert all(got[100 + i] == 100 for i in range(1, 41))


def test_wide_parities_never_differ_in_more_bits_than_sets_in_tokens(spark):
    rng = np.random.default_rng(5)
    sizes = np.array([40, 500, 700, 1100, 1400, 3000, 2300, 0])
    shared = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    tokens = [np.unique(np.r_[shared[: n * 4 // 5], rng.integers(0, 2**63, n - n * 4 // 5, dtype=np.uint64)]) for n in sizes]
    n = np.array([len(t) for t in tokens])
    wide = jaccard.wide_parities(np.repeat(np.arange(len(n)), n), np.concatenate(tokens), n)
    assert [len(w) for w in wide] == [8, 8, 16, 32, 32, 64, 64, 8]
    sets = spark.createDataFrame([(i, int(n[i]), w.as_py()) for i, w in enumerate(wide)], "rep long, n int, wide array<long>")
    together = [(i, j) for i in range(7) for j in range(7) if i != j]
    pairs = spark.createDataFrame(together, "a long, b long")
    left = {tuple(r) for r in jaccard._wide_enough(pairs, sets, 75).collect()}
    for a, b in together:
        apart = len(np.setxor1d(tokens[a], tokens[b]))
        if 100 * (n[a] + n[b] - apart) / 2 >= 75 * (n[a] + n[b] + apart) / 2:
            assert (a, b) in left
    strangers = [np.unique(rng.integers(0, 2**63, 1100, dtype=np.uint64)) for _ in range(2)]
    n = np.array([len(t) for t in strangers])
    wide = jaccard.wide_parities(np.repeat([0, 1], n), np.concatenate(strangers), n)
    sets = spark.createDataFrame([(i, int(n[i]), w.as_py()) for i, w in enumerate(wide)], "rep long, n int, wide array<long>")
    assert jaccard._wide_enough(spark.createDataFrame([(0, 1)], "a long, b long"), sets, 75).count() == 0


def test_pairs_of_many_shared_signatures_are_made_once(spark):
    odd = [0] * jaccard.PARITIES
    held = {1: range(100), 2: range(50, 150), 3: range(149, 300), 4: range(400, 500)}
    table = spark.createDataFrame([(s * 7919 % 1009 - 500, rep, rep, 40, odd) for rep, sigs in held.items() for s in sigs], "sig long, rep long, comp long, n int, odd array<long>")
    got = Counter((r.a, r.b) for r in jaccard._met(table, 75).collect())
    assert set(got) == {(1, 2), (2, 3)} and got[1, 2] == 1  # under 50 signatures, and under one that is not among the first


def test_only_texts_of_pairs_are_fetched(spark):
    sigs = spark.createDataFrame([(1, 10, 40), (1, 11, 40), (2, 12, 40), (2, 13, 400)], "sig long, rep long, n int")
    sets = spark.createDataFrame([(rep, n, [0] * 8, [0] * 8) for rep, n in ((10, 40), (11, 40), (12, 40), (13, 400))], "rep long, n int, odd array<long>, wide array<long>")
    texts, asked = spark.createDataFrame([(rep, "a b c d e f g") for rep in (10, 11, 12, 13)], "rep long, text string"), []

    def texts_of(reps):
        asked.extend(r.rep for r in reps.collect())
        return texts.join(reps, "rep")

    linked = jaccard.link_components(sigs, sets, texts_of)
    assert sorted(asked) == [10, 11] and [tuple(r) for r in linked.collect()] == [(11, 10)]


def test_batch_bytes_are_set_back(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ValueError), tables_module.small_batches(spark, 1 << 20):
        assert spark.conf.get(name) == "1048576b"
        raise ValueError
    assert spark.conf.get(name) == before
