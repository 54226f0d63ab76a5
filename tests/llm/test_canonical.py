import random
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from millweir.llm import canonical
from millweir.llm.canonical import map_places
from millweir.llm.editing import distance, fold

WORDS = st.text("abc", max_size=6)


def plain_distance(a, b):
    """Damerau-Levenshtein by the definition, without a bound or shortcuts."""
    far, seen = len(a) + len(b), {}
    d = {(i, j): far for i in range(-1, len(a) + 1) for j in range(-1, len(b) + 1)}
    d |= {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        last = 0
        for j in range(1, len(b) + 1):
            k, m = seen.get(b[j - 1], 0), last
            if a[i - 1] == b[j - 1]:
                last = j
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        seen[a[i - 1]] = i
    return d[len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS, WORDS)
def test_distance_is_the_metric(a, b, c):
    assert [distance(a, b, m) for m in range(7)] == [min(plain_distance(a, b), m + 1) for m in range(7)]
    assert distance(a, c, 99) <= distance(a, b, 99) + distance(b, c, 99)


def test_fold():
    assert fold("  Å-B_c ø ß​") == "a b c o ss"


COUNTRIES = [("VM", "VLM", "Velmora", "Republic of Velmora", "Velmória"), ("TQ", "TRQ", "Tarquay", "Tarquay Commonwealth", None)]
CITIES = [("C1", "North Vulmouth", "VM"), ("C2", "Reslund", "VM"), ("C3", "Reslund", "TQ"), ("C4", "Lomféwyck", "TQ")]
ROWS = [
    (1, "North Vulmouth", "Velmora", set()), (2, "N Vulmouth", "V.M.", {("city", "C1"), ("country", "VM")}), (3, "vulmouth north", " ", {("city", "C1")}),
    (4, "reslund", "Tarquai", {("city", "C3"), ("country", "TQ")}), (5, "Reslund (VLM)", None, {("city", "C2")}), (6, "LOMFEWYK*", "The Republic of Vemlora", {("city", "C4"), ("country", "VM")}),
    (7, "to be confirmed", "?", {("city", "none"), ("country", "none")}), (8, None, "vm - velmora", {("country", "VM")}), (9, " \t", "", set()),
    (10, "12345 Greater Lomféwyck", "Grontavia", {("city", "C4"), ("country", "none")}), (11, "z" * 60_000, "Tarquay, TRQ", {("city", "none"), ("country", "TQ")}), (12, "Nortvulmouth, TQ", None, {("city", "C1")}),
]


def _refs(spark, countries=COUNTRIES, cities=CITIES):
    return spark.createDataFrame(countries, "country_code string, iso3 string, country_name string, official_name string, local_name string"), spark.createDataFrame(cities, "city_id string, city_name string, country_code string")


def test_places(spark):
    df = spark.createDataFrame([r[:3] for r in ROWS], "dealer_id long, city string, country string").selectExpr("*", "'x' as field_name", "'y' as id")
    found = map_places(df, "dealer_id", "city", "country", *_refs(spark)).collect()
    by = {r[0]: {(f.field_name, f.ref_key) for f in found if f.dealer_id == r[0]} for r in ROWS}
    assert by == {r[0]: r[3] for r in ROWS}
    twice = df.where("dealer_id = 2").unionByName(df.where("dealer_id = 2"))
    assert map_places(twice, "dealer_id", "city", "country", *_refs(spark)).count() == 4
    assert map_places(df.limit(0), "dealer_id", "city", "country", *_refs(spark)).count() == 0
    none = map_places(df, "dealer_id", "city", "country", *_refs(spark, [], [])).collect()
    assert {r.ref_key for r in none} == {"none"} and len(none) == sum(bool(v and v.strip()) for r, k in product(ROWS, (1, 2)) for v in [r[k]])


def test_misspelt_entries_among_other_words(spark):
    countries = spark.createDataFrame([("DE", "DEU", "Germany", "Federal Republic", "Deutschland")], "country_code string, iso3 string, country_name string, official_name string, local_name string")
    cities = spark.createDataFrame([("1", "Hamburg", "DE"), ("2", "Bad Segeberg", "DE"), ("3", "Ulm", "DE")], "city_id string, city_name string, country_code string")
    values = ["Hamubrg Altona", "Segebreg at Bad Kurpark", "near Ulmm", "Altona Nord"]
    dealers = spark.createDataFrame([(i, v, None) for i, v in enumerate(values)], "dealer_id long, city string, country string")
    got = {r.dealer_id: r.ref_key for r in map_places(dealers, "dealer_id", "city", "country", countries, cities).collect()}
    assert (got[0], got[1], got[2], got[3]) == ("1", "2", "none", "none")


def test_long_lists_are_taken_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).title()
    names = [word() for _ in range(60)]
    countries = spark.createDataFrame([("DE", "DEU", "Germany", None, None), ("FR", "FRA", "France", None, None)], "country_code string, iso3 string, country_name string, official_name string, local_name string")
    cities = spark.createDataFrame([(f"{i:03d}", n, "DE" if i % 2 else "FR") for i, n in enumerate([*names, *names[:5][::-1]])], "city_id string, city_name string, country_code string")
    typed = [n for n in names[:20]] + [n.upper() for n in names] + [n[:-2] + n[-1] for n in names[:30]] + [f"{n}, {c}" for n in names[:6] for c in ("France", "Germany")] + ["nowhere else", "", None]
    dealers = spark.createDataFrame([(i % 40, v, rng.choice(["Germany", "franc", None])) for i, v in enumerate(typed)], "dealer_id long, city string, country string")
    whole = sorted(map(tuple, map_places(dealers, "dealer_id", "city", "country", countries, cities).collect()))
    monkeypatch.setattr(canonical, "MOST_ENTRIES", 17)
    assert sorted(map(tuple, map_places(dealers, "dealer_id", "city", "country", countries, cities).collect())) == whole and len(whole) > 100
