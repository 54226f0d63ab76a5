import random

import pytest

from millweir.llm import truncation as T

PARTS = ["The battery was charged in the yard", "A new tyre was fitted to the left wheel", "We drove the car to the coast", "The buyer asked for a second key", "Our office will send the papers", "It makes a noise in the cold", "The price includes the delivery", "Please call the desk before noon"]


def _text(rng):
    text = " ".join(f"{rng.choice(PARTS)} after {rng.randint(1, 99)} days." for _ in range(rng.randint(2, 7)))
    end = rng.random()
    return text + ("\n\nKind regards\nAnna Weber" if end < 0.15 else "\n- heated seats\n- roof rails" if end < 0.3 else "")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows, cut = [], set()
    for i in range(2400):
        text, channel = _text(rng), "b"
        if i % 12 == 0:
            text = " ".join(_text(rng) for _ in range(3)).replace("\n", " ")[:200]
            channel = "a"
        elif i % 17 == 0:
            at = rng.randint(40, len(text) - 5)
            text = text[:at]
            if "\n" in text or text.rstrip()[-1:] in ".":
                text = _text(rng)
        rows.append((i, text, "s", channel))
        if not text.rstrip().endswith((".", "Weber", "rails")):
            cut.add(i)
    return rows, cut


def test_held_out_accuracy(spark, corpus):
    rows, cut = corpus
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, channel string").selectExpr("*", "1 as score", "2 as id", "3 as grp")
    found = T.find_truncated(df, "doc_id", "text", ["source", "channel"])
    assert found.columns == ["doc_id", "score", "truncated"]
    got = {r.doc_id for r in found.where("truncated").collect()}
    assert len(got & cut) / len(cut) > 0.95 and len(got & cut) / len(got) > 0.95
    share = {r.source: r for r in T.shares(df, found, "doc_id", "source").collect()}
    assert share["s"].n_texts == len(rows) and share["s"].n_truncated == len(got)


def test_limits(spark, corpus):
    df = spark.createDataFrame(corpus[0], "doc_id long, text string, source string, grp string")
    assert T._limits(df, "text", "grp")[("a", "chars")] == {200}


def test_edges(spark):
    rows = [(1, None, None, "x"), (2, "", "s", None), (3, "  \n", "s", "x"), (4, "ok", "s", "x"), (4, "ok", "s", "x"), (5, "word. " * 50_000, "s", "x"), (None, "A whole sentence.", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, channel string")
    found = T.find_truncated(df, "doc_id", "text", ["source", "channel"])
    assert found.count() == 7 and not found.where("doc_id in (1, 2, 3) and truncated").count()
    assert T.find_truncated(df.limit(0), "doc_id", "text", ["source", "channel"]).count() == 0
    assert T.find_truncated(df.where("doc_id < 4"), "doc_id", "text", ["source", "channel"]).where("truncated").count() == 0
