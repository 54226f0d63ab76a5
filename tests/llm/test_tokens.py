import random

import pytest

from millweir.llm import tokens as T

TEXTS = {
    1: "Plain words, 12 of them.\r\n\r\n  Indented\tline ", 2: None, 3: "", 4: " ", 5: "<|endoftext|> is text", 6: "漢字とかな 🙂🙂 é é ​", 7: "word " * 9000,
    8: "x" * 40_000, 9: " " * 40_000 + "end", 10: "".join(random.Random(1).choice("ab 1.,'\n é漢") for _ in range(60_000)), 11: "don't " * 8000 + "\n" * 700 + "stop", 12: "🙂" * 17_000,
}


@pytest.fixture(scope="module")
def expected():
    enc = T.encoder(T.TOKENIZER_DIR, "byte_bpe_50k")
    return {k: enc.encode_ordinary(v) if v else [] for k, v in TEXTS.items()}


@pytest.mark.parametrize("spread", [T.SPREAD, 600])
def test_same_as_in_one_go_and_back(spark, expected, spread, monkeypatch):
    """Windows in the task that reads a text, and dealt over tasks."""
    monkeypatch.setattr(T, "SPREAD", spread)
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").selectExpr("doc_id", "text", "'x' as ids", "1 as id")
    out = T.encode(df, "doc_id", "text")
    assert out.columns == ["doc_id", "ids"]
    got = {r.doc_id: list(r.ids) for r in out.collect()}
    assert got == expected
    assert {r.doc_id: r.text for r in T.decode(out, "doc_id", "ids").collect()} == {k: v or "" for k, v in TEXTS.items()}


def test_same_as_the_other_library(expected):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{T.TOKENIZER_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for k, v in TEXTS.items():
        if v and len(v) < 20_000:
            assert other.encode(v, add_special_tokens=False).ids == expected[k]


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, "long text " * 3000), (2, "long text " * 3000), (2, "other " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert T.encode(df, "doc_id", "text").count() == 6
    assert T.encode(df.limit(0), "doc_id", "text").count() == 0
    found = T.sizes(df.selectExpr("*", "'s' as source"), "doc_id", "text", "source")
    assert found.count() == 6 and {(r.doc_id, r.n_tokens) for r in found.collect()} == {(r.doc_id, len(r.ids)) for r in T.encode(df, "doc_id", "text").collect()}
    nothing = T.sizes(spark.createDataFrame([(1, None, None)], "id long, t string, k string"), "id", "t", "k").first()
    assert nothing.sign is None and nothing.n_tokens == 0


def test_pieces_of_random_texts(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(T, "WINDOW", 40)
    monkeypatch.setattr(T, "OVERLAP", 12)
    enc, cuts = T.encoder(T.TOKENIZER_DIR, "byte_bpe_50k"), 0
    for _ in range(1500):
        text = "".join(rng.choice(["a", "bc", "'s", "'re", " ", "  ", "\n\n", "\t", "12", ".", "é", "漢", "\x1c", "\u2028", "\xa0", "🙂"]) for _ in range(rng.randint(0, 120)))
        pieces = T.cut(text, T.TOKENIZER_DIR)
        cuts += len(pieces) - 1
        assert "".join(pieces) == text
        assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text), text
    assert cuts > 1000
