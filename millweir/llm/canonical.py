"""Mapping of freely typed values to a canonical list (problem 4).

One automaton over the canonical names and all aliases finds mentions at word ends in a folded value; the longest mentions that do
not overlap win. What has no mention goes to token-set similarity: each token of an entry takes the token of the value that is spelt
nearest, in any order, and the share of the entry's letters that agree is the similarity; tokens run together or parted count as one.
An index of signatures (metric_join.py) finds the tokens in reach, so no value is compared with the whole list. Values with neither are
reported as none. Rows are mapped where they are read, each distinct value once a worker, without a shuffle. What is sent to the
workers of a canonical list is bounded: a longer one is taken in blocks, and each value keeps the best of what the blocks say.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millweir.llm.editing import fold
from millweir.llm.metric_join import Near
from millweir.session import materialize

#: Entries of the list that a block holds.
MOST_ENTRIES = 200_000
#: An entry among other words needs so many letters, of which so many must agree.
LEAST_LETTERS, LEAST_SIMILARITY = 7, 0.8
NONE = "none"
#: Words around a name that do not change what it names.
FILLERS = {"the", "of", "and", "city", "town", "centre", "center", "central", "greater", "downtown", "metro", "area", "region", "municipality", "district"}


def most_edits(length: int) -> int:
    """How many edits a name of so many letters may differ by."""
    return 0 if length < 5 else 1 if length < 8 else 2 if length < 16 else 3


def short_forms(name: str) -> Iterable[str]:
    """Of a folded name of several words: the first word abbreviated (its initial and up to two later letters), or put last."""
    first, _, rest = name.partition(" ")
    if not rest:
        return
    yield f"{rest} {first}"
    if len(first) > 3:
        for n in range(3):
            for kept in combinations(range(1, len(first)), n):
                yield "".join([first[0], *(first[k] for k in kept)]) + " " + rest


#: How well a value fits an entry: the kind of evidence, then its degrees.
Rank = tuple[float, float, float]
NOTHING: Rank = (0.0, 0.0, 0.0)
EXACT: Rank = (9.0, 0.0, 0.0)


@dataclass
class Lexicon:
    """The aliases of a canonical list. names: key -> names; codes: key -> codes, which count only if nothing else is in the value."""

    names: dict[str, list[str]]
    codes: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        import ahocorasick

        self.keys_of: dict[str, set[str]] = defaultdict(set)
        self.plain: dict[str, set[str]] = defaultdict(set)
        for key, names in self.names.items():
            for name in filter(None, map(fold, names)):
                self.keys_of[name].add(key)
                self.plain[name].add(key)
        for name, keys in list(self.plain.items()):
            for alias in [*short_forms(name), *([name.replace(" ", "")] if " " in name else [])]:
                if alias not in self.plain:
                    self.keys_of[alias] |= keys
        self.code_keys: dict[str, set[str]] = defaultdict(set)
        for key, codes in self.codes.items():
            for code in filter(None, map(fold, codes)):
                for form in {code, " ".join(code)}:
                    self.code_keys[form].add(key)
        self.automaton = ahocorasick.Automaton()
        for alias in self.keys_of.keys() | self.code_keys.keys():
            self.automaton.add_word(f" {alias} ", alias)
        if len(self.automaton):
            self.automaton.make_automaton()
        # forms of whole token sets (run together as typed and sorted), and tokens, by the edits they may take
        self.forms: dict[str, set[str]] = defaultdict(set)
        self.sets: dict[str, set[tuple[str, ...]]] = defaultdict(set)
        for name, keys in self.plain.items():
            words = tuple(sorted(name.split()))
            for form in {name.replace(" ", ""), "".join(words)}:
                self.forms[form] |= keys
            for word in words:
                self.sets[word].add(words)
        self.near_forms = [Near([f for f in self.forms if most_edits(len(f) + r) >= r], r) for r in (1, 2, 3)]
        self.near_words = [Near([w for w in self.sets if most_edits(len(w) + r) >= r], r) for r in (1, 2, 3)]

    def mentions(self, text: str) -> list[tuple[int, int, str]]:
        """Longest mentions that don't overlap, in a folded text: (start, end, alias)."""
        if not len(self.automaton):
            return []
        found = [(end - len(alias) - 1, end, alias) for end, alias in self.automaton.iter(f" {text} ")]
        chosen: list[tuple[int, int, str]] = []
        for start, end, alias in sorted(found, key=lambda m: (-len(m[2]), m[0])):
            if all(end <= s + 1 or start >= e - 1 for s, e, _ in chosen):
                chosen.append((start, end, alias))
        return sorted(chosen)

    def _in_reach(self, word: str, near: list[Near], known: dict) -> list[tuple[int, str]]:
        """(edits, spelling) of the nearest known spellings that a word may stand for; radii grow until one is met."""
        if word in known:
            return [(0, word)]
        for radius, index in enumerate(near, 1):
            if most_edits(len(word) + radius) < radius:
                break
            if found := [(d, w) for d, w in index.of(word) if d <= most_edits(max(len(w), len(word)))]:
                least = min(found)[0]
                return [x for x in found if x[0] == least]
        return []

    def nearest(self, text: str) -> tuple[set[str], Rank]:
        """The keys of the most similar entry as token sets, none if no entry is similar enough."""
        words = [w for w in text.split() if not w.isdigit()]
        whole = {"".join(words), "".join(sorted(words)), "".join(w for w in words if w not in FILLERS)} - {""}
        met = [x for form in whole for x in self._in_reach(form, self.near_forms, self.forms)]
        if met:
            least = min(met)[0]
            return set().union(*(self.forms[f] for d, f in met if d == least)), (2.0, -float(least), 0.0)
        return self.contained(words)

    def contained(self, words: list[str]) -> tuple[set[str], Rank]:
        """The keys of the entries whose tokens all stand among other words, misspelt; the one with the greatest similarity, then the longest."""
        reach = {w: self._in_reach(w, self.near_words, self.sets) for w in set(words)}
        at: dict[str, int] = {}
        for found in reach.values():
            for d, token in found:
                at[token] = min(d, at.get(token, d))
        scored = []
        for entry in {e for token in at for e in self.sets[token]}:
            letters = sum(map(len, entry))
            if letters >= LEAST_LETTERS and all(t in at for t in entry) and len(entry) <= len(words):
                similarity = 1 - sum(at[t] for t in entry) / letters
                if similarity >= LEAST_SIMILARITY:
                    scored.append((round(similarity, 6), letters, entry))
        if not scored:
            return set(), NOTHING
        best = max(scored)[:2]
        meant = {entry for *score, entry in scored if tuple(score) == best}
        return set().union(*(keys for name, keys in self.plain.items() if tuple(sorted(name.split())) in meant)), (1.0, best[0], float(best[1]))

    def resolve(self, value: str) -> tuple[set[str], str, Rank]:
        """The keys that a value may mean, the rest of the folded value without their mentions, and how well it fits."""
        text = fold(value)
        found = self.mentions(text)
        named = [m for m in found if m[2] in self.keys_of]
        if named:
            longest = max(named, key=lambda m: len(m[2]))
            padded = f" {text} "
            rest = padded
            for start, end, alias in reversed(named):
                if self.keys_of[alias] & self.keys_of[longest[2]]:
                    rest = rest[: start + 1] + rest[end:]
            return self.keys_of[longest[2]], " ".join(rest.split()), (4.0, float(len(longest[2])), -float(longest[0]))
        if found:
            covered = sum(len(m[2].replace(" ", "")) for m in found)
            if covered == len(text.replace(" ", "")):
                keys = set.intersection(*(self.code_keys[m[2]] for m in found))
                return keys, "", (3.0, 0.0, 0.0)
        return (x := self.nearest(text))[0], "", x[1]


class PlaceMapper:
    """Countries, and cities in the light of the country that the row or the value itself names."""

    def __init__(self, countries: list[tuple], cities: list[tuple]) -> None:
        self.country_names = {c[2] for c in countries}
        self.city_names = {c[1] for c in cities}
        self.country_of = {c[0]: c[2] for c in cities}
        self.countries = Lexicon({c[0]: [n for n in c[2:] if n] for c in countries}, {c[0]: [n for n in c[:2] if n] for c in countries})
        self.cities = Lexicon({c[0]: [c[1]] for c in cities})
        self.country = functools.lru_cache(maxsize=200_000)(self._country)
        self.city = functools.lru_cache(maxsize=200_000)(self._city)

    def _country(self, value: str) -> str | None:
        keys = self.countries.resolve(value)[0]
        return min(keys) if len(keys) == 1 else None

    def _named_country(self, rest: str) -> str | None:
        """A country mentioned beside the city, by name or code."""
        keys = set.union(set(), *((self.countries.keys_of | self.countries.code_keys)[m[2]] for m in self.countries.mentions(rest)))
        return min(keys) if len(keys) == 1 else None

    def _city(self, value: str) -> tuple[tuple[str, ...], str | None, Rank]:
        keys, rest, rank = self.cities.resolve(value)
        named = self._named_country(rest)
        if not keys:  # a misspelt name beside a country or postal code
            text = fold(value)
            beside = self.countries.mentions(text)
            if beside:
                padded = f" {text} "
                for start, end, _ in reversed(beside):
                    padded = padded[: start + 1] + padded[end:]
                (keys, rank), named = self.cities.nearest(padded.strip()), self._named_country(text)
        return tuple(sorted(keys)), named, rank if keys else NOTHING

    def rows(self, city: str | None, country: str | None) -> Iterator[tuple[str, str | None, Rank, int]]:
        """(field, key, how well it fits, whether the country agrees) of each value; an exact name has no key."""
        where = self.country(country) if country and country.strip() else None
        if country and country.strip():
            yield ("country", None, EXACT, 0) if country in self.country_names else ("country", where or NONE, NOTHING, 0)
        if city and city.strip():
            if city in self.city_names:
                yield "city", None, EXACT, 0
            else:
                keys, named, rank = self.city(city)
                agree = {k: 2 if self.country_of[k] == (named or where) else 1 if self.country_of[k] == where else 0 for k in keys}
                # keys are in order: of those that agree most, the least
                best = max(keys, key=lambda k: agree[k], default=None)
                yield "city", best or NONE, rank, agree.get(best, 0)


def _entries(ref: DataFrame, columns: list[str]) -> list[tuple]:
    return sorted((tuple(r) for r in ref.select(*columns).distinct().collect() if r[0] is not None), key=str)


def map_places(df: DataFrame, row_id: str, city: str, country: str, countries: DataFrame, cities: DataFrame) -> DataFrame:
    """(row_id, field_name, ref_key) of each city and country that is typed otherwise than in its canonical list; none if it means no entry.

    Null and blank values give no row. A name that two entries share goes to the one in the country named beside it or in the row,
    else to the entry with the smaller key. Rows repeated come out as often as they came in. Empty lists map everything to none.
    countries: a list of bounded length, for each of which there may be any number of cities.
    """
    n = cities.select("city_id").distinct().count()
    blocks = max(1, -(-n // MOST_ENTRIES))
    if countries.limit(MOST_ENTRIES + 1).count() > MOST_ENTRIES:
        raise ValueError(f"there are more than {MOST_ENTRIES} countries")
    known = _entries(countries, ["country_code", "iso3", "country_name", "official_name", "local_name"])
    rows = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{city}`").alias("city"), F.col(f"`{country}`").alias("country"))
    if blocks > 1:
        rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()), "typed")
    else:
        rows = rows.withColumn("at", F.lit(0).cast("long"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, at long, field_name string, ref_key string, fit array<double>, agree int"

    def mapped(of_block: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mapper = PlaceMapper(known, of_block)
            for batch in batches:
                typed = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
                found = [(i, *x) for i, (c, k) in enumerate(typed) for x in mapper.rows(c, k) if blocks > 1 or x[1] is not None]
                at = pa.array([x[0] for x in found], pa.int32())
                columns = [pa.array([x[j] for x in found], kind) for j, kind in ((1, pa.string()), (2, pa.string()), (3, pa.list_(pa.float64())), (4, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(3).take(at), *columns], ["id", "at", "field_name", "ref_key", "fit", "agree"])

        return rows.mapInArrow(run, schema)

    columns = ["city_id", "city_name", "country_code"]
    if blocks == 1:
        return mapped(_entries(cities, columns)).select(F.col("id").alias(row_id), "field_name", "ref_key")
    in_block = F.pmod(F.xxhash64("city_name"), F.lit(blocks))
    every = reduce(DataFrame.unionAll, [mapped(_entries(cities.where(in_block == b), columns)) for b in range(blocks)])
    # an exact name has no key and outdoes all; of equal fits the least key
    best = every.groupBy("at", "field_name").agg(F.first("id").alias("id"), F.max(F.struct("fit", "agree")).alias("most"), F.collect_list(F.struct("fit", "agree", "ref_key")).alias("said"))
    key = F.array_min(F.transform(F.filter("said", lambda x: (x["fit"] == F.col("most.fit")) & (x["agree"] == F.col("most.agree"))), lambda x: x["ref_key"]))
    return best.select(F.col("id").alias(row_id), "field_name", key.alias("ref_key")).where("ref_key is not null")
