import random
import re

from pyspark.sql import functions as F

from textwarden.operators import chunks, vault

TOKENS = ["TOK_alpha", "aba", "x.\\E(y", ""]


def plain_places(text):
    return {(t, i + 1) for t in TOKENS if t for i in range(len(text)) if text.startswith(t, i)}


def cut(key, text, sizes):
    rows, at, n = [], 0, 0
    while at < len(text):
        size = sizes[n % len(sizes)]
        rows.append((key, n, text[at : at + size]))
        at, n = at + size, n + 1
    return rows


def test_tokens_are_found_once_wherever_chunks_end(spark):
    rng = random.Random(4)
    texts = {f"whole-{i}": f"{'z' * i}TOK_alpha and ababa x.\\E(y{'é😀' * i}TOK_alphaTOK_alpha" for i in range(14)}
    texts["one"] = "TOK_alpha"
    texts["none"] = "nothing to see, TOK_alph"
    rows = []
    for key, text in texts.items():
        for sizes in ([1], [2], [5], [8], [9], [100], [1, 7, 0, 3], [rng.randint(1, 20) for _ in range(9)]):
            rows += cut(f"{key}/{sizes}", text, sizes) if all(sizes) else cut(f"{key}/{sizes}", text, [max(1, s) for s in sizes])
    gaps = [("gap", 3, "TOK_"), ("gap", 10, "al"), ("gap", 2_000_000_000_000, "pha"), ("gap", 11, None), ("gap", 12, "")]
    df = spark.createDataFrame(rows + gaps, "response string, chunk_no long, text string").repartition(3)
    for block_rows in (65_536, 2):  # one chunk or a few in a block
        got = {}
        found = chunks.split_leaks(df, ["response"], "chunk_no", "text", TOKENS, block_rows).collect()
        for r in found:
            got.setdefault(r.response, []).append((r.token, r.position))
            if r.response == "gap":
                assert r.chunk_no == 2_000_000_000_000 and r.position == 1
        assert got.pop("gap") == [("TOK_alpha", 1)]
        whole = {}
        for key, n, text in rows:
            whole[key] = whole.get(key, "") + text
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(plain_places(t)) for k, t in whole.items() if plain_places(t)}
    own = df.withColumn("tokens", F.when(F.col("response").startswith("one"), F.array(F.lit("TOK_alpha"), F.lit(None))))
    assert {r.response.split("/")[0] for r in chunks.split_leaks(own, ["response"], "chunk_no", "text", "tokens").collect()} == {"one"}
    assert chunks.split_leaks(df.where("false"), ["response"], "chunk_no", "text", TOKENS).count() == 0


TURNS = [
    (1, 0, "call 081-234-5678 or 089-123-4567, mail a.b@mail.example.org"), (1, 1, "again 089-123-4567 and <PHONE_1> and <LITERAL_1> and <NOTE_1>"),
    (1, 5, None), (1, 7, ""), (1, 8, "no data"), (2, 0, "089-123-4567"), (2, 1, "zero​8​1-234-5678 0​81-234-5678"), (2, 2, "mark ﷑ and ﷙ 089-123-4567"),
    (2, 3, "card 4532-0150-1234-5678 key sk-aaaaaaaaaaaaaaaa id 1-1002-00345-67-8"), (None, 0, "089-123-4567"),
]


def test_masked_texts_come_back_as_they_were(spark):
    turns = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, text string, kind string").repartition(3)
    masked, entries = vault.mask_reversibly(turns.select("conv_id", "turn", "text", F.col("kind").alias("note")))
    texts = {(r.conv_id, r.turn): r.masked for r in masked.collect()}
    assert texts[1, 0] == "call <PHONE_1> or <PHONE_2>, mail <EMAIL_1>"
    assert texts[1, 1] == "again <PHONE_2> and <LITERAL_1> and <LITERAL_2> and <NOTE_1>"
    assert texts[1, 8] == "no data" and texts[1, 5] == "" and texts[2, 0] == "<PHONE_1>" and texts[2, 1] == "<TEXT_1>"
    assert texts[2, 3] == "card <CREDIT_CARD_1> key <API_KEY_1> id <THAI_ID_1>"
    assert not any(re.search(r"\d{4}", t) for t in texts.values())
    known = {(r.conv_id, r.kind, r.n): r.original for r in entries.collect()}
    assert known[1, "LITERAL", 1] == "<PHONE_1>" and known[1, "PHONE", 2] == "089-123-4567" and known[2, "LITERAL", 1] == "﷑"
    restored = {(r.conv_id, r.turn): r.unmasked for r in vault.unmask(masked, entries, "conv_id", ["turn"], "masked").collect()}
    for conv, turn, text in TURNS:
        if conv is not None:
            assert restored[conv, turn] == (text or "")
    answer = spark.createDataFrame([(1, 0, "<PHONE_2><PHONE_2> <PHONE_9> <EMAIL_1>"), (3, 0, "<PHONE_1>"), (1, 1, None)], "conv_id long, n int, text string")
    assert {(r.conv_id, r.n): r.unmasked for r in vault.unmask(answer, entries, "conv_id", ["n"], "text").collect()} == {
        (1, 0): "089-123-4567089-123-4567 <PHONE_9> a.b@mail.example.org", (3, 0): "<PHONE_1>", (1, 1): None,
    }
    empty, nothing = vault.mask_reversibly(turns.where("false").select("conv_id", "turn", "text"))
    assert empty.count() == 0 and nothing.count() == 0


def test_numbers_go_by_first_occurrence_over_blocks_of_turns(spark, monkeypatch):
    monkeypatch.setattr(vault, "_BLOCK_TURNS", 4)
    rows = [(1, t, f"tel 089-555-{t % 30:04d} and 089-555-{(t * 7) % 50:04d}") for t in range(60)]
    _, entries = vault.mask_reversibly(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(4))
    order = []
    for _, _, text in rows:
        order += re.findall(r"089-555-\d{4}", text)
    assert {r.n: r.original for r in entries.collect()} == dict(enumerate(dict.fromkeys(order), 1))
