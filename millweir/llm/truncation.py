"""Texts cut off by field limits or in transfer (problem 8).

A logistic regression on hashed features is trained on texts of the corpus itself: intact values are cut at random places, within
words and within sentences, to give the positives. Its features are the closing characters and words, punctuation, the form of the
last line, how common the last word is in the whole corpus, and the distance of the length to a limit of the source's channel.
Limits are lengths, in characters or bytes, at the upper end of a channel's texts where far more texts end than just below.
The model is fitted on a bounded sample (TRAIN_ROWS), whose texts are cut and turned into features by the executors; word counts, limits
and scores cover all texts.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millweir.session import materialize

#: Bound of the labelled sample in texts and of each of them in characters, width of the hashed features, width of the hashed word counts
#: (words that share a bucket share its counts: give it some times the number of different words), passes and batches of the training.
TRAIN_ROWS, TRAIN_CHARS, WIDTH, WORD_BUCKETS, PASSES, BATCH = 30_000, 4_000, 1 << 16, 1 << 20, 6, 64
THRESHOLD, DOUBT = 0.5, 0.15

_WORD, _LINE = re.compile(r"\w+", re.UNICODE), re.compile(r"\r\n|\r|\n")
#: Marks that end a sentence, marks that may follow them, and marks that show a cut.
FINAL, CLOSING, CUT_MARKS = ".!?。！？‥؟।", "\"'”’»)]}>*_`“」』）】🙂😀👍", ("...", "…", "[...]", "(...)", "�", "[truncated]", "--more--", "[cut]", "...]")
LONGEST_MARK = max(map(len, CUT_MARKS))
_BULLET = re.compile(r"^\s*(?:[-*•‣·–+]|\d{1,2}[.)])\s+")
_FIELD = re.compile(r"^\s*[\w][\w /.()-]{0,28}[:=]\s*\S")
_MARKUP = re.compile(r"<[^<>]*>\s*$")
#: For counting, in the notation of Arrow's regular expressions: points that end a sentence (within a number one ends nothing), the
#: ends of sentences and of lines, which become words of their own, and what parts words.
_POINT, _STOP, _BREAK, _BETWEEN = r"[.]([^\p{L}\p{N}_]|$)", "[!?。！？‥؟।\x01]", "[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]", r"[^\p{L}\p{N}_\x{01}\x{02}]+"


def word_bucket(word: str) -> int:
    return crc32(word.lower().encode()) % WORD_BUCKETS


def pair_bucket(before: str, word: str) -> int:
    return (crc32(before.lower().encode()) * 31 + crc32(word.lower().encode())) % WORD_BUCKETS


@dataclass
class Context:
    """What the whole corpus says: by bucket, how common a word or pair of words is (in logs), how often a final mark follows it
    (in eighths, 255 where it is too rare to tell) and how many texts end with the word and no final mark, and limits by channel."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(WORD_BUCKETS, np.uint8))
    ends: np.ndarray = field(default_factory=lambda: np.full(WORD_BUCKETS, 255, np.uint8))
    lasts: np.ndarray = field(default_factory=lambda: np.zeros(WORD_BUCKETS, np.int32))
    limits: dict[tuple[str, str], set[int]] = field(default_factory=dict)


def features(text: str, group: str, context: Context, own: int = 1) -> list[int]:
    """Indices of the hashed features that a text has. own: how often the text itself is counted in context.lasts."""
    out: list[str] = []
    body = text.rstrip()
    trailing = len(text) - len(body)
    end = body[-LONGEST_MARK:].lower()
    mark = next((m for m in CUT_MARKS if end.endswith(m)), "") if end.endswith(CUT_MARKS) else ""
    core = body[: len(body) - len(mark)].rstrip() if mark else body
    closed = core.rstrip(CLOSING + " ")
    last = closed[-1:] if not mark else core[-1:]
    final = last in FINAL and last != ""
    lines = [x for x in _LINE.split(core) if x and not x.isspace()]
    line = lines[-1] if lines else ""
    before = lines[-2].strip() if len(lines) > 1 else ""
    words = _WORD.findall(line)
    word = words[-1] if words else ""
    pair = " ".join(words[-2:]).lower()
    count = int(context.words[word_bucket(word)]) if word else 0
    pair_ends = context.ends[pair_bucket(*words[-2:])] if len(words) > 1 else "none"
    ends = f"{context.ends[word_bucket(word)] if word else 'none'}|{pair_ends}"
    # whole words that end texts come back, such as names of writers; words cut short hardly do
    others = int(max(0, context.lasts[word_bucket(word)] - own)).bit_length() if word and not final else 0
    bullet = bool(_BULLET.match(line))
    in_field = bool(_FIELD.match(line)) and len(words) <= 8
    short = len(words) <= 4
    kind = "bullet" if bullet else "field" if in_field else "short" if short else "prose"
    chars, size = len(text), len(text.encode())
    at_limit = chars in context.limits.get((group, "chars"), ()) or size in context.limits.get((group, "bytes"), ())
    near = not at_limit and (any(abs(x - chars) <= 4 for x in context.limits.get((group, "chars"), ())) or any(abs(x - size) <= 4 for x in context.limits.get((group, "bytes"), ())))
    anywhere = any(chars in v if unit == "chars" else size in v for (_, unit), v in context.limits.items())
    open_bracket = any(a in core and core.count(a) > core.count(b) for a, b in ("()", "[]", "“”", "„“", "«»", "「」"))
    last_char = core[-1:] or "none"
    shape = "digit" if last_char.isdigit() else "lower" if last_char.islower() else "upper" if last_char.isupper() else "letter" if last_char.isalpha() else last_char
    end = "final" if final else shape
    out += [
        f"end={end}", f"end={end}|{kind}", f"mark={mark}", f"mark={mark}|{end}|{at_limit or near}", f"kind={kind}", f"limit={at_limit}", f"limit={at_limit or near}|{mark}|{final}|{kind}", f"near={near}|{final}", f"anywhere={anywhere}|{final}", f"trail={min(trailing, 2)}|{final}", f"trail={min(trailing, 2)}|{kind}|{end}",
        f"open={open_bracket}|{final}", f"lines={min(len(lines), 3)}|{kind}|{final}", f"len={min(chars // 40, 20)}|{final}|{kind}", f"words={min(len(words), 12)}|{final}|{kind}", f"upto={'first' if len(lines) < 2 else 'later'}|{final}|{kind}",
    ]
    if mark:
        out += [f"marked={ends}", f"markpair={pair}", f"markend={pair_ends}|{at_limit or near}"]
    if not final:
        out += [
            f"ends={ends}", f"ends={ends}|{kind}", f"endpair={pair_ends}|{kind}|{min(len(words), 5)}",
            f"known={min(count, 12)}|{shape}|{kind}", f"word={word.lower()}", f"word={word.lower()}|{kind}", f"pair={pair}", f"line={' '.join(words).lower()}|{kind}", f"tail={core[-3:].lower()}|{kind}", f"tail4={core[-4:].lower()}",
            f"caps={''.join('A' if w[:1].isupper() else 'a' if w[:1].isalpha() else '9' for w in words[-3:])}|{kind}|{min(len(words), 5)}", f"before={before[-1:] if before[-1:] in FINAL + ',:;-' else 'other'}|{kind}|{bool(_BULLET.match(before))}",
            f"greeting={' '.join(_WORD.findall(before)).lower()}|{kind}|{len(words)}", f"first={' '.join(words[:1]).lower()}|{kind}", f"field={line.split(':')[0].lower() if in_field else ''}|{shape}", f"label={line.split(':')[0].lower() if in_field else ''}|{min(count, 8)}|{len(words)}",
            f"markup={bool(_MARKUP.search(core))}", f"others={min(others, 6)}|{kind}|{min(len(words), 3)}", f"others={min(others, 6)}|{min(count, 12)}|{ends}",
        ]
    else:
        digits = bool(re.search(r"\d[.]$", core))
        out += [f"final={last}", f"finaldigit={digits}|{len(word)}", f"finalword={word.lower()}|{last}" if len(word) <= 3 else f"finalknown={min(count, 12)}"]
    return sorted({crc32(x.encode()) % WIDTH for x in out})


def _limits(df: DataFrame, text: str, group: str) -> dict[tuple[str, str], set[int]]:
    """Lengths at which a channel cuts: many more texts than at the lengths around, and not many more that are longer.

    Lengths are counted over all texts; a channel's limits are few, because each must hold a share of the channel.
    """
    lengths = df.where(F.length(text) > 0).select(F.col(group).alias("g"), F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length(text).alias("n")), F.struct(F.lit("bytes").alias("unit"), F.octet_length(text).alias("n")))).alias("x"))
    counts = materialize(lengths.select("g", "x.unit", "x.n").groupBy("g", "unit", "n").agg(F.count(F.lit(1)).alias("c")), "lengths")
    total = counts.groupBy("g", "unit").agg(F.sum("c").alias("all"))
    around = counts.select("g", "unit", F.explode(F.sequence(F.col("n") - 15, F.col("n") + 15)).alias("n"), "c").groupBy("g", "unit", "n").agg(F.sum("c").alias("near"))
    peaks = counts.join(around, ["g", "unit", "n"]).join(total, ["g", "unit"]).where((F.col("c") >= 5) & (F.col("c") * 200 >= F.col("all")) & (F.col("c") * 3 > F.col("near") - F.col("c"))).select("g", "unit", "n", "c")
    longer = peaks.join(counts.select("g", "unit", F.col("n").alias("other"), F.col("c").alias("m")), ["g", "unit"]).groupBy("g", "unit", "n", "c").agg(F.sum(F.when(F.col("other") > F.col("n"), F.col("m")).otherwise(0)).alias("above"))
    found: dict[tuple[str, str], set[int]] = {}
    for r in longer.where(F.col("above") <= 2 * F.col("c")).collect():
        found.setdefault((r.g, r.unit), set()).add(r.n)
    return found


def count_words(batches: Iterator[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By bucket: how often its words and pairs of words occur but at a line's or text's end, how often before a final mark, and how many
    texts end with the word and no final mark. Texts are parted and their words counted by arrays, in slices that bound their memory."""
    counts, finals, lasts = (np.zeros(WORD_BUCKETS, np.int64) for _ in range(3))
    for batch in batches:
        for start in range(0, len(batch), 2000):
            text = pc.drop_null(batch.slice(start, 2000))
            text = pc.replace_substring_regex(pc.replace_substring_regex(text, "[\x01\x02]", " "), _POINT, "\x01\\1")
            text = pc.replace_substring_regex(pc.replace_substring_regex(text, _STOP, " \x01 "), _BREAK, " \x02 ")
            parts = pc.split_pattern_regex(pc.utf8_lower(text), _BETWEEN)
            tokens, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
            kept = pc.not_equal(tokens, "")
            tokens, owner = tokens.filter(kept).dictionary_encode(), owner.filter(kept).to_numpy()
            if not len(tokens):
                continue
            known = tokens.dictionary.to_pylist()
            signs, at = np.array([crc32(w.encode()) for w in known], np.int64), tokens.indices.to_numpy()
            marks = np.array([1 if w == "\x01" else 2 if w == "\x02" else 0 for w in known], np.int8)[at]
            same = np.append(owner[1:] == owner[:-1], False)
            # what follows a token: another word, a final mark, or neither
            after = np.where(same, np.append(marks[1:], 2), 2)
            word, sign = marks == 0, signs[at]
            whole, final, last = word & (after != 2), word & (after == 1), word & ~same
            first = np.flatnonzero(word[:-1] & word[1:] & same[:-1])
            second = first + 1
            pair = (sign[first] * 31 + sign[second]) % WORD_BUCKETS
            bucket = sign % WORD_BUCKETS
            for into, words, pairs in ((counts, whole, whole[second]), (finals, final, final[second]), (lasts, last, None)):
                into += np.bincount(bucket[words], minlength=WORD_BUCKETS)
                if pairs is not None:
                    into += np.bincount(pair[pairs], minlength=WORD_BUCKETS)
    return counts, finals, lasts


def word_statistics(counts: np.ndarray, finals: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    logs = np.minimum(np.log2(counts + 1.0), 254).astype(np.uint8)
    ends = np.where(counts >= 3, np.minimum(8 * finals / np.maximum(counts, 1) + (finals > 0), 9), 255).astype(np.uint8)
    return logs, ends, np.minimum(lasts, 1 << 30).astype(np.int32)


def _word_counts(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """count_words of all texts; what comes back to the driver is bounded by WORD_BUCKETS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = count_words(batch.column(0) for batch in batches)
        used = np.flatnonzero(found[0] + found[2])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(c[used]) for c in found)], ["bucket", "n", "f", "l"])

    counted = df.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "bucket int, n long, f long, l long")
    rows = counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in "nfl"]).toArrow()
    arrays = []
    for c in "nfl":
        arrays.append(np.zeros(WORD_BUCKETS, np.int64))
        arrays[-1][rows.column("bucket").to_numpy()] = rows.column(c).to_numpy()
    return word_statistics(*arrays)


def _cut(text: str, rng: random.Random) -> str:
    """An intact text cut within a word or a sentence, at any place after its first fifth alike, with or without a mark of the cut."""
    low, high = max(1, len(text) // 5), len(text) - 1
    for _ in range(20):
        at = rng.randint(low, high)
        part = text[:at]
        rest = text[at:].lstrip()
        stripped = part.rstrip()
        # not at the end of a sentence or line: that would leave whole sentences; in a signature or item only within a word
        line = re.split(r"[\r\n]", rest, maxsplit=1)[0].rstrip().rstrip(CLOSING)
        inside = text[at - 1].isalnum() and text[at].isalnum()
        if stripped and rest and (inside or line[-1:] in FINAL) and stripped.rstrip(CLOSING)[-1:] not in FINAL and "\n" not in text[len(stripped) : at + 1] and "\r" not in text[len(stripped) : at + 1]:
            draw = rng.random()
            return part + ("" if draw < 0.75 else "..." if draw < 0.83 else "…" if draw < 0.91 else "�")
    return text[: max(1, len(text) // 2)]


def _cut_at(text: str, unit: str, limit: int, rng: random.Random) -> str:
    """A longer text cut at a limit of characters or bytes, some with a mark that the limit includes; '' if it ends at a sentence."""
    mark = "" if rng.random() < 0.6 else ("...", "…", " [...]")[rng.randrange(3)]
    if unit == "chars":
        part = text[: limit - len(mark)] + mark
    else:
        part = (text.encode()[: limit - len(mark.encode())] + mark.encode()).decode("utf-8", "replace")
    stripped = part[: len(part) - len(mark)].rstrip().rstrip(CLOSING)
    return "" if stripped[-1:] in FINAL or text[len(stripped) :][:1] in "\r\n" else part


@dataclass
class Rows:
    """Rows of indices, none empty, end to end, and where each begins."""

    flat: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(rows: list[list[int]]) -> Rows:
        sizes = [len(r) for r in rows]
        return Rows(np.fromiter((i for r in rows for i in r), np.int64, sum(sizes)), np.cumsum([0, *sizes[:-1]]) if rows else np.zeros(0, np.int64))

    def __len__(self) -> int:
        return len(self.starts)

    def take(self, chosen: np.ndarray) -> Rows:
        sizes = np.append(self.starts[1:], len(self.flat))[chosen] - self.starts[chosen]
        begins = np.cumsum(sizes) - sizes
        # each chosen row's run, shifted to where it lies in flat
        return Rows(self.flat[np.arange(sizes.sum()) + np.repeat(self.starts[chosen] - begins, sizes)], begins)

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.flat)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.add.reduceat(self.weights[rows.flat], rows.starts) + self.bias))) if len(rows) else np.zeros(0)


def fit(rows: Rows, labels: np.ndarray, seed: int = 7) -> Model:
    """Logistic regression by adaptive gradient steps over batches of rows in a seeded order."""
    rng = np.random.default_rng(seed)
    model, squares, bias_square = Model(np.zeros(WIDTH), 0.0), np.full(WIDTH, 1e-3), 1e-3
    for _ in range(PASSES):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            batch = rows.take(chosen)
            gap = model.score(batch) - labels[chosen]
            used, place = np.unique(batch.flat, return_inverse=True)
            step = np.bincount(place, np.repeat(gap, batch.sizes())) + 1e-5 * model.weights[used]
            squares[used] += step * step
            model.weights[used] -= 0.15 * step / np.sqrt(squares[used])
            bias_square += gap.sum() ** 2
            model.bias -= 0.15 * gap.sum() / np.sqrt(bias_square)
    return model


def _looks_cut(text: str, group: str, context: Context) -> bool:
    """Plain signs by which a text of the sample can't count as intact: a limit reached, a mark, or prose without a final mark."""
    body = text.rstrip()
    if body[-LONGEST_MARK:].lower().endswith(CUT_MARKS):
        return True
    closed = body.rstrip(CLOSING + " ")
    if closed[-1:] not in FINAL and (len(text) in context.limits.get((group, "chars"), ()) or len(text.encode()) in context.limits.get((group, "bytes"), ())):
        return True
    line = _LINE.split(body)[-1]
    return closed[-1:] not in FINAL and len(line) > 60 and not _FIELD.match(line)


def examples(text: str, group: str, context: Context, known: list[tuple[str, str, int]]) -> Iterator[tuple[int, list[int]]]:
    """(label, features) of an intact text of the sample and of cuts of it, drawn by the text itself; seeming cuts give none."""
    if not text.strip() or _looks_cut(text, group, context):
        return
    rng = random.Random(crc32(text.encode()))
    yield 0, features(text, group, context)
    if text.rstrip()[-1] in FINAL and rng.random() < 0.15:
        # some writers end whole sentences with dots
        yield 0, features(text.rstrip()[:-1] + ("..." if rng.random() < 0.7 else "…"), group, context, 0)
    if len(text) >= 30:
        yield 1, features(_cut(text, rng), group, context, 0)
    if known:
        where, unit, limit = known[rng.randrange(len(known))]
        long = text
        while len(long) <= limit:
            long += " " + text
        if cut := _cut_at(long, unit, limit, rng):
            yield 1, features(cut, where, context, 0)


def train(rows: Rows, labels: np.ndarray, seed: int = 7) -> Model:
    """From features and labels of which some are wrong: texts of the sample may have been cut themselves."""
    if not len(rows):
        return Model(np.zeros(WIDTH), -20.0)
    # the first model half sees which of the sample were cut: they are left out of the second
    kept = np.flatnonzero((labels > 0) | (fit(rows, labels, seed).score(rows) < DOUBT))
    return fit(rows.take(kept), labels[kept], seed)


def _grouped(df: DataFrame, row_id: str, text: str, group: list[str]) -> DataFrame:
    return df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.concat_ws("/", *[F.coalesce(F.col(f"`{g}`"), F.lit("?")) for g in group]).alias("grp"))


def learn(df: DataFrame, row_id: str, text: str, group: list[str]) -> tuple[Model, Context]:
    """Limits and word counts over all rows, and a model fitted on TRAIN_ROWS texts, those least by a hash of their id."""
    rows = _grouped(df, row_id, text, group)
    context = Context(*_word_counts(rows, "text"), _limits(rows, "text", "grp"))
    known = sorted((g, unit, n) for (g, unit), ns in context.limits.items() for n in ns)
    shared = df.sparkSession.sparkContext.broadcast((context, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        its, limits = shared.value
        for batch in batches:
            made = [(crc32(t.encode()) * 8 + k, *x) for t, g in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, x in enumerate(examples(t, g, its, limits))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], kind) for i, kind in ((0, pa.int64()), (1, pa.int32()), (2, pa.list_(pa.int32())))], ["place", "label", "at"])

    # only texts of a bounded length are in the sample, so that it stays bounded in bytes too
    sample = rows.where(F.length("text").between(1, TRAIN_CHARS)).orderBy(F.xxhash64(F.lit(7), "id", "text"), "id").limit(TRAIN_ROWS).select("text", "grp")
    made = sample.repartition("text").mapInArrow(run, "place long, label int, at array<int>").toArrow()
    lists = pa.concat_arrays(made.column("at").chunks) if made.num_rows else pa.array([], pa.list_(pa.int32()))
    found = Rows(lists.flatten().to_numpy().astype(np.int64), np.cumsum([0, *lists.value_lengths().to_pylist()[:-1]]) if len(lists) else np.zeros(0, np.int64))
    # in an order of their own, whatever the partitions were
    order = np.argsort(made.column("place").to_numpy(), kind="stable")
    return train(found.take(order), made.column("label").to_numpy()[order].astype(np.float64)), context


def score(df: DataFrame, row_id: str, text: str, group: list[str], model: Model, context: Context) -> DataFrame:
    """(row_id, score) of every row: the probability that its text was cut. Null, empty and blank texts have the score 0."""
    shared = df.sparkSession.sparkContext.broadcast((model, context))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, known = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts, groups = part.column(1).to_pylist(), part.column(2).to_pylist()
                filled = [i for i, t in enumerate(texts) if t and t.strip()]
                scores = np.zeros(part.num_rows)
                scores[filled] = fitted.score(Rows.of([features(texts[i], groups[i], known) for i in filled]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], ["id", "score"])

    rows = _grouped(df, row_id, text, group)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", row_id)


def find_truncated(df: DataFrame, row_id: str, text: str, group: list[str]) -> DataFrame:
    """(row_id, score, truncated) of every row; group: the columns that tell a channel. Repeated rows come out as often as they came in.

    Null, empty and blank texts are not truncated. A corpus without usable texts gives a model that calls nothing truncated.
    """
    model, context = learn(df, row_id, text, group)
    return score(df, row_id, text, group, model, context).withColumn("truncated", F.col("score") > THRESHOLD)


def shares(df: DataFrame, found: DataFrame, row_id: str, source: str) -> DataFrame:
    """Per source, null included: texts, truncated ones, and their share. Null and empty texts count as texts that are whole."""
    rows = df.select(F.col(row_id), F.col(source)).join(found.select(row_id, "truncated"), row_id)
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("truncated").cast("long")).alias("n_truncated"), F.avg(F.col("truncated").cast("double")).alias("share"))
