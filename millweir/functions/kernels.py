"""Parsing and normalising of dirty values as Spark columns: numbers, dates, booleans, phones, countries, blanks and shapes.

Every kernel returns null for what it can't read; none raises under ANSI mode.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of valid values.
EMAIL = r"^[A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
URL = r"^https?://[^\s]+$"
SSN = r"^\d{3}-\d{2}-\d{4}$"
IBAN = r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$"
CARD = r"^(?:\d[ -]?){13,19}$"
POSTAL = r"^(\d{5}(-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|[A-Z]\d[A-Z] ?\d[A-Z]\d)$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Words for true and false.
TRUE_WORDS = ["true", "t", "yes", "y", "1", "on"]
FALSE_WORDS = ["false", "f", "no", "n", "0", "off"]

# The date and time formats that are read, in this order, each with the shape a value must have for it.
DATES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"(?i)^\d{1,2} [a-z]{3} \d{4}$", "d MMM yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"(?i)^[a-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), (r"(?i)^[a-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"(?i)^\d{1,2} [a-z]+ \d{4}$", "d MMMM yyyy"),
]
TIMES = [
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"), (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"), (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,9}$", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSSSS][.SSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$", "yyyy-MM-dd'T'HH:mm:ss'Z'"), (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,9}Z$", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSSSS][.SSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]'Z'"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}$", "M/d/yyyy HH:mm"),
]
#: Formats a user may name, in the notation of the pipeline documents.
NAMED = {"%Y-%m-%d": ("yyyy-M-d", "yyyy-MM-dd"), "%m/%d/%Y": ("M/d/yyyy", "MM/dd/yyyy"), "%d/%m/%Y": ("d/M/yyyy", "dd/MM/yyyy"), "%d.%m.%Y": ("d.M.yyyy", "dd.MM.yyyy"), "%d %b %Y": ("d MMM yyyy", "dd MMM yyyy")}

# Reference data of countries (name, iso2, iso3, currency, dial, region, further names).
COUNTRIES = [
    ("United States", "US", "USA", "USD", "1", "North America", ["u.s.a.", "u.s.", "united states of america", "america", "states"]),
    ("United Kingdom", "GB", "GBR", "GBP", "44", "Europe", ["uk", "u.k.", "great britain", "england", "britain", "scotland", "wales"]),
    ("Germany", "DE", "DEU", "EUR", "49", "Europe", ["deutschland", "federal republic of germany"]),
    ("Canada", "CA", "CAN", "CAD", "1", "North America", []),
    ("France", "FR", "FRA", "EUR", "33", "Europe", ["république française"]),
    ("Spain", "ES", "ESP", "EUR", "34", "Europe", ["españa"]),
    ("Italy", "IT", "ITA", "EUR", "39", "Europe", ["italia"]),
    ("Netherlands", "NL", "NLD", "EUR", "31", "Europe", ["holland", "the netherlands"]),
    ("India", "IN", "IND", "INR", "91", "Asia", ["bharat"]),
    ("Japan", "JP", "JPN", "JPY", "81", "Asia", ["nippon"]),
    ("Australia", "AU", "AUS", "AUD", "61", "Oceania", []),
    ("Mexico", "MX", "MEX", "MXN", "52", "North America", ["méxico"]),
    ("Brazil", "BR", "BRA", "BRL", "55", "South America", ["brasil"]),
    ("China", "CN", "CHN", "CNY", "86", "Asia", ["prc"]),
    ("Ireland", "IE", "IRL", "EUR", "353", "Europe", ["eire"]),
    ("Switzerland", "CH", "CHE", "CHF", "41", "Europe", ["schweiz", "suisse"]),
]
COUNTRY_FIELDS = {"name": 0, "iso2": 1, "iso3": 2, "currency": 3, "dial": 4, "region": 5}
# Reference exchange rates to the US dollar.
FX_TO_USD = {"USD": 1.0, "EUR": 1.08, "GBP": 1.27, "CAD": 0.73, "JPY": 0.0067, "INR": 0.012, "AUD": 0.66, "CHF": 1.12, "MXN": 0.055, "BRL": 0.18, "CNY": 0.14}


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text(c: Column) -> Column:
    return c.cast("string")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(text(c), r"(?U)\s+", " ")


def key(c: Column) -> Column:
    """For comparing without case and outer blanks."""
    return F.lower(strip(c))


def blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def quote(pattern: str) -> str:
    """A regular expression for exactly this text, in Java's and RE2's notation alike."""
    return re.sub(r"([\\.+*?\[\](){}^$|&~#\-])", r"\\\1", pattern)


def replacement(value: str) -> str:
    return value.replace("\\", "\\\\").replace("$", "\\$")


def numeric(c: Column) -> Column:
    """The number that a text stands for: currency signs, thousands commas, blanks and percent signs dropped; (1) is -1."""
    s = strip(c)
    bare = F.regexp_replace(s, r"(?U)[$€£¥,\s%()]", "")
    number = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
    return F.when(s.rlike(r"(?s)^\(.*\)$"), -number).otherwise(number)


def as_number(c: Column, kind: T.DataType) -> Column:
    return numeric(c) if isinstance(kind, T.StringType) else c.try_cast("double") if isinstance(kind, (T.NumericType, T.BooleanType)) else numeric(c)


def percent(c: Column) -> Column:
    n = numeric(c)
    return F.when(strip(c).endswith("%") | (n > 1), n / 100).otherwise(n)


def date(c: Column, formats: list[str] | None = None, day_first: bool = False) -> Column:
    """The first format that fits wins; times of day are dropped."""
    s = strip(c)
    known = [(".+", NAMED[f][0]) for f in formats] if formats else list(DATES)
    if day_first and not formats:
        known.insert(1, known.pop([f for _, f in known].index("d/M/yyyy")))
    tries = [F.when(s.rlike(shape), F.try_to_date(s, f)) for shape, f in known]
    return F.coalesce(*tries, *(F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(f)).cast("date")) for shape, f in TIMES))


def date_format(c: Column) -> Column:
    """The format in which a value is written, null if it's no date."""
    s = strip(c)
    dates = [F.when(s.rlike(shape) & F.try_to_date(s, f).isNotNull(), F.lit(f)) for shape, f in DATES]
    return F.coalesce(*dates, *(F.when(s.rlike(shape) & F.try_to_timestamp(s, F.lit(f)).isNotNull(), F.lit(f.split("[")[0])) for shape, f in TIMES))


def timestamp(c: Column) -> Column:
    s = strip(c)
    zoned = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{2}:?\d{2}$"), F.try_to_timestamp(F.left(s, F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    tries = [F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(f))).cast("timestamp_ntz") for shape, f in TIMES]
    return F.coalesce(*tries, zoned.cast("timestamp_ntz"), date(c).cast("timestamp_ntz"))


def as_date(c: Column, kind: T.DataType) -> Column:
    return c.cast("date") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else date(c)


def boolean(c: Column) -> Column:
    k = key(c)
    return F.when(k.isin(TRUE_WORDS), True).when(k.isin(FALSE_WORDS), False)


def email(c: Column) -> Column:
    """Cleaned: lower case, no white space."""
    return F.regexp_replace(F.lower(text(c)), r"(?U)\s+", "")


def country_names() -> dict[str, tuple]:
    return {k: row for row in COUNTRIES for k in [row[0].lower(), row[1].lower(), row[2].lower(), *row[6]]}


def lookup(keys: Column, table: dict) -> Column:
    """table[keys], null where it has no entry."""
    if not table:
        return F.lit(None)
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), keys)


def country(c: Column, field: str = "name") -> Column:
    """A field of the country that a value names, by any of its names and codes."""
    return lookup(F.lower(F.regexp_replace(strip(c), r"(?U)\s+", " ")), {k: row[COUNTRY_FIELDS[field]] for k, row in country_names().items()})


def phone(c: Column, default: str = "US", country_code: Column | None = None) -> Column:
    """E.164, by the dialling code of the default country or of a column of ISO-2 codes."""
    raw = strip(c)
    all_digits = F.regexp_replace(raw, r"\D", "")
    abroad = raw.startswith("+") | raw.startswith("00")
    digits = F.when(raw.startswith("00"), all_digits.substr(F.lit(3), F.length(all_digits))).otherwise(all_digits)
    dials = {row[1]: row[4] for row in COUNTRIES}
    own = dials.get(default.upper(), "1")
    dial = F.coalesce(lookup(F.upper(country_code), dials), F.lit(own)) if country_code is not None else F.lit(own)
    local = F.regexp_replace(all_digits, "^0", "")
    north_american = F.when((F.length(all_digits) == 11) & all_digits.startswith("1"), F.concat(F.lit("+"), all_digits)).when(F.length(all_digits) == 10, F.concat(F.lit("+1"), all_digits))
    elsewhere = F.when(F.length(local).between(6, 12), F.concat(F.lit("+"), dial, local))
    return F.when(raw == "", None).when(abroad, F.when(F.length(digits).between(8, 15), F.concat(F.lit("+"), digits))).when(dial == "1", north_american).otherwise(elsewhere)


def shape(c: Column) -> Column:
    """The value with digits as 9 and letters as A or a."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text(c), r"\p{Nd}", "9"), r"[\p{L}&&[^\p{Lu}]]", "a"), r"\p{Lu}", "A")


#: Accented letters with what remains of them in ASCII, as a rule over Unicode's decompositions of the Latin blocks.
def _folding() -> tuple[str, str]:
    import unicodedata

    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in range(0xC0, 0x250) if unicodedata.normalize("NFKD", chr(i))[0].isascii() and unicodedata.normalize("NFKD", chr(i)) != chr(i)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """ASCII letters for accented Latin ones; combining marks and other letters are dropped."""
    return F.regexp_replace(F.translate(text(c), *_folding()), r"[^\x00-\x7F]", "")


def name_key(c: Column) -> Column:
    """Sorted ASCII words in lower case, for matching names."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(fold(c)), "[^a-z0-9]+"), lambda w: w != "")), " ")


def title(c: Column) -> Column:
    """Words and parts after a hyphen or apostrophe start with a capital."""
    parts = F.split(F.lower(squeeze(strip(c))), r"(?<=[\s\-'’])")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), w.substr(F.lit(2), F.length(w)))), "")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)
