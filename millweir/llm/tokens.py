"""Encoding of a whole corpus with a public tokenizer (problem 6).

A byte-level BPE splits a text into pre-tokens by a pattern and merges bytes within each, so the ids of two pieces cut at a
pre-token boundary are the ids of the whole. Texts are cut into overlapping windows that are pre-tokenised apart from each other. A
window that starts within a pre-token finds its way back after a few characters: from the first boundary that it shares with the
window before, both agree. The pieces between these boundaries are encoded apart and put together in order. A text in which two
windows share no boundary (one run of letters longer than the overlap) is encoded in one go. The windows of a text stay in the task
that reads it; only those of a very long one are dealt over the cluster. Decoding concatenates the raw bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import runpy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
#: Characters of a window and of its overlap with the next one, and of a text whose windows go to several tasks.
WINDOW, OVERLAP, SPREAD = 256, 64, 262_144


@functools.lru_cache(maxsize=4)
def _pattern(folder: str) -> str:
    return runpy.run_path(os.path.join(folder, "__init__.py"))["PATTERN"]


@functools.lru_cache(maxsize=4)
def encoder(folder: str, name: str):  # noqa: ANN201 - tiktoken's type is imported where it is used
    """One for each Python worker. A byte-level BPE given as ranks."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=_pattern(folder), mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _splitter(folder: str):  # noqa: ANN202
    import regex

    # blanks as the encoder's own pattern language has them
    return regex.compile(_pattern(folder).replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def boundaries(text: str, folder: str) -> list[int]:
    """Where pre-tokens start, and the text's end."""
    return [m.start() for m in _splitter(folder).finditer(text)] + [len(text)]


def windows(text: str) -> Iterator[tuple[int, str]]:
    """(start, piece): overlapping windows over a text, each reaching into the next one; the last reaches the end."""
    for start in range(0, max(1, len(text) - OVERLAP), WINDOW):
        yield start, text[start : start + WINDOW + OVERLAP]


def zones(start: int, piece: str, length: int, folder: str) -> tuple[list[int], list[int]]:
    """A window's boundaries, as positions in the whole text, in the zones that it shares with the windows before and after it."""
    end = start + len(piece)
    marks = [start + b for b in boundaries(piece, folder)]
    # the last character before a window's end may still change its pre-token's end, and what follows a blank decides how blanks are parted
    tail = [b for b in marks if start + WINDOW <= b <= end - 2 and not piece[b - start - 1].isspace()] if end < length else []
    return [b for b in marks if b < start + OVERLAP] if start else [], tail


def shared_boundary(before: list[int], after: list[int]) -> int:
    """The first position in both lists, -1 for none."""
    return min(set(before) & set(after), default=-1)


def cut(text: str, folder: str) -> list[str]:
    """A text in pieces whose ids, put together, are those of the text."""
    if len(text) <= WINDOW + OVERLAP:
        return [text]
    points, tail = [0], []
    for start, piece in windows(text):
        head, following = zones(start, piece, len(text), folder)
        if start:
            points.append(shared_boundary(tail, head))
            if points[-1] < 0:
                return [text]
        tail = following
    return [text[a:b] for a, b in zip(points, [*points[1:], len(text)], strict=True)]


def _encode_batches(folder: str, name: str, whole: bool = True):  # noqa: ANN202
    """Replaces the last column of texts by their ids. whole: texts are cut into windows first; else they are pieces already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sizes, flat = np.zeros(part.num_rows + 1, np.int64), []
                for i, text in enumerate(part.column(part.num_columns - 1).to_pylist(), 1):
                    for piece in (cut(text, folder) if whole else [text]) if text else ():
                        ids = enc.encode_ordinary(piece)
                        sizes[i] += len(ids)
                        flat.extend(ids)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], [*part.schema.names[:-1], "ids"])

    return run


def _marked_windows(folder: str, kind: str):  # noqa: ANN202
    """(id, sign, length, k, start, piece) of each text, in one pass over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                text = row.column(3)[0].as_py()
                found = list(windows(text))
                for at in range(0, len(found), 1000):
                    some = found[at : at + 1000]
                    columns = [row.column(c).take(pa.array([0] * len(some), pa.int32())) for c in range(3)]
                    starts = pa.array([s for s, _ in some], pa.int64())
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([s // WINDOW for s, _ in some], pa.int64()), starts, pa.array([p for _, p in some], pa.string())], ["id", "sign", "length", "k", "start", "piece"])

    return run


def _zones(folder: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["start", "piece", "length"]).to_pylist()
            found = [zones(r["start"], r["piece"], r["length"], folder) for r in rows]
            both = [pa.array([x[i] for x in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *both], [*batch.schema.names, "head", "tail"])

    return run


def _encode_long(long: DataFrame, kind: str, folder: str, name: str) -> DataFrame:
    """(id, ids) of texts whose windows are dealt over tasks; rows repeated under one id are encoded once and come out as often as they came in."""
    copies = long.groupBy("id", "sign").agg(F.count(F.lit(1)).alias("copies"))
    once = long.dropDuplicates(["id", "sign"])
    schema = f"id {kind}, sign long, length long, k long, start long, piece string"
    marked = once.select("id", "sign", "length", "text").mapInArrow(_marked_windows(folder, kind), schema).repartition("id", "sign", "k").mapInArrow(_zones(folder), schema + ", head array<long>, tail array<long>")
    before = marked.where(F.size("tail") > 0).select("id", "sign", (F.col("k") + 1).alias("k"), "tail")
    after = marked.where("k > 0").select("id", "sign", "k", "head")
    points = after.join(before, ["id", "sign", "k"], "left").select("id", "sign", "k", F.array_min(F.array_intersect("head", F.coalesce("tail", F.array().cast("array<long>")))).alias("point"))
    unsolved = points.where("point is null").select("id", "sign").distinct()
    starts = points.select("id", "sign", "k", F.col("point").alias("first"))
    ends = points.select("id", "sign", (F.col("k") - 1).alias("k"), F.col("point").alias("last"))
    solved = marked.drop("head", "tail").join(unsolved, ["id", "sign"], "left_anti").join(starts, ["id", "sign", "k"], "left").join(ends, ["id", "sign", "k"], "left")
    first = F.coalesce("first", F.lit(0).cast("long"))
    last = F.coalesce("last", "length")
    pieces = solved.select("id", "sign", "k", F.col("piece").substr((first - F.col("start") + 1).cast("int"), (last - first).cast("int")).alias("text"))
    parts = pieces.mapInArrow(_encode_batches(folder, name, whole=False), f"id {kind}, sign long, k long, ids array<int>")
    whole = parts.groupBy("id", "sign").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts")).select("id", "sign", F.flatten("parts.ids").alias("ids"))
    rest = once.join(unsolved, ["id", "sign"], "left_semi").select("id", "sign", "text").mapInArrow(_encode_batches(folder, name, whole=False), f"id {kind}, sign long, ids array<int>")
    both = whole.unionByName(rest).join(copies, ["id", "sign"])
    return both.select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "ids").drop("copy")


def encode(df: DataFrame, row_id: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(row_id, ids): the ids of every text by a public byte-level BPE, without special tokens; nothing is trimmed.

    An empty and a null text have no ids ([]). The name of a special token in a text is ordinary text. A null row_id is kept.
    Texts up to SPREAD characters are cut and encoded where they are read, without a shuffle. Other columns of df are not read.
    """
    rows = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    short = rows.where(F.col("text").isNull() | (F.length("text") <= SPREAD)).mapInArrow(_encode_batches(folder, name), f"id {kind}, ids array<int>")
    long = rows.where(F.length("text") > SPREAD).select("id", "text", F.length("text").cast("long").alias("length"), F.xxhash64("text").alias("sign"))
    return short.unionByName(_encode_long(long, kind, folder, name)).withColumnRenamed("id", row_id)


def sizes(df: DataFrame, row_id: str, text: str, keep: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(row_id, keep, sign, n_tokens) of each row, from one pass over its text: sign is the text's SHA-256, null for a null text, which has no tokens."""
    rows = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{keep}`").alias("keep"), F.col(f"`{text}`").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            signs = [None if t is None else hashlib.sha256(t.encode()).digest() for t in texts]
            counts = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(signs, pa.binary()), pa.array(counts, pa.int64())], ["id", "keep", "sign", "n_tokens"])

    return rows.mapInArrow(run, f"id {kinds['id']}, keep {kinds['keep']}, sign binary, n_tokens long").toDF(row_id, keep, "sign", "n_tokens")


def decode(df: DataFrame, row_id: str, ids: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(row_id, text): the tokens' raw bytes in a row, read as UTF-8. Null ids give null, no ids the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            texts = [None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{ids}`").alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", row_id)
