"""Steps that compute columns row by row: cleaning, types, text, dates, formulas, enrichment and protection."""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millweir.functions import kernels as K
from millweir.functions.conditions import StepError, combine, need
from millweir.functions.formulas import compile_formula
from millweir.operators.registry import ROW_ID, Context, step


def texts(df: DataFrame, names: list[str] | None) -> list[str]:
    """The text columns among names, or all."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != ROW_ID and (not names or f.name in names)]


def on_texts(df: DataFrame, p: dict, make) -> DataFrame:  # noqa: ANN001
    return df.withColumns({c: make(K.col(c)) for c in texts(df, p.get("columns"))})


def snake(name: str) -> str:
    import re

    words = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    return re.sub(r"_+", "_", re.sub(r"[^\w]+", "_", words)).strip("_").lower() or "column"


def out(p: dict, default: str) -> str:
    return p.get("output") or default


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


# ---- cleaning
@step("trim_whitespace", "clean", "columns:columns", stream=True)
def trim_whitespace(df, p, ctx):
    return on_texts(df, p, K.strip)


@step("remove_whitespace", "clean", "columns*:columns", stream=True)
def remove_whitespace(df, p, ctx):
    return on_texts(df, p, lambda c: F.regexp_replace(c, r"(?U)\s+", ""))


@step("uppercase", "clean", "columns*:columns", stream=True)
def uppercase(df, p, ctx):
    return on_texts(df, p, F.upper)


@step("lowercase", "clean", "columns*:columns", stream=True)
def lowercase(df, p, ctx):
    return on_texts(df, p, F.lower)


@step("titlecase", "clean", "columns*:columns", stream=True)
def titlecase(df, p, ctx):
    return on_texts(df, p, K.title)


@step("replace_values", "clean", "column*:column mapping*:mapping", stream=True)
def replace_values(df, p, ctx):
    c = K.text(K.col(p["column"]))
    table = {str(k): None if v is None else str(v) for k, v in p["mapping"].items()}
    return df.withColumn(p["column"], F.when(c.isin(list(table)), K.lookup(c, table)).otherwise(c))


@step("find_replace", "clean", "columns*:columns find*:text replace:text match_case:boolean=False whole_word:boolean=False", stream=True)
def find_replace(df, p, ctx):
    new = p.get("replace") or ""
    if p["match_case"] and not p["whole_word"]:
        return on_texts(df, p, lambda c: F.replace(c, F.lit(p["find"]), F.lit(new)))
    bound = r"\b" if p["whole_word"] else ""
    pattern = ("(?U)" if p["match_case"] else "(?iU)") + bound + K.quote(p["find"]) + bound
    return on_texts(df, p, lambda c: F.regexp_replace(c, pattern, K.replacement(new)))


@step("remove_special_characters", "clean", "columns*:columns keep:text", stream=True)
def remove_special_characters(df, p, ctx):
    return on_texts(df, p, lambda c: F.regexp_replace(c, rf"(?U)[^\w\s{K.quote(p.get('keep') or '')}]", ""))


@functools.cache
def _nfkc():  # noqa: ANN202 - made when first used, since it loads pandas in the driver
    from pyspark.sql.pandas.functions import PandasUDFType

    return F.pandas_udf(lambda values: values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore"), T.StringType(), PandasUDFType.SCALAR)


@step("normalize_strings", "clean", "columns:columns", stream=True)
def normalize_strings(df, p, ctx):
    # only values beyond ASCII can change under NFKC; ANDing their mask keeps the rest out of Python's sight as nulls
    wide = lambda c: c.rlike(r"[^\x00-\x7F]")
    return on_texts(df, p, lambda c: K.strip(K.squeeze(F.coalesce(_nfkc()(F.when(wide(c), c)), c))))


@step("clean_punctuation", "clean", "columns*:columns", stream=True)
def clean_punctuation(df, p, ctx):
    return on_texts(df, p, lambda c: F.regexp_replace(F.regexp_replace(c, r"([!?.,;:])\1+", "$1"), r"(?U)^[\p{Punct}\s]+|[\p{Punct}\s]+$", ""))


@step("standardize_codes", "clean", "columns*:columns case:upper|lower|keep=upper pad_length:number", stream=True)
def standardize_codes(df, p, ctx):
    case = {"upper": F.upper, "lower": F.lower, "keep": lambda c: c}[p["case"]]
    n = int(p.get("pad_length") or 0)

    def make(c: Column) -> Column:
        bare = case(F.regexp_replace(c, r"(?U)\s+", ""))
        return F.when(F.length(bare) < n, F.lpad(bare, n, "0")).otherwise(bare) if n else bare

    return on_texts(df, p, make)


@step("standardize_phone", "clean", "column*:column default_country:text=US country_column:column invalid:null|keep=null", stream=True)
def standardize_phone(df, p, ctx):
    c = K.col(p["column"])
    code = K.country(K.col(p["country_column"]), "iso2") if p.get("country_column") else None
    good = K.phone(c, p["default_country"], code)
    return df.withColumn(p["column"], F.coalesce(good, K.text(c)) if p["invalid"] == "keep" else good)


@step("validate_email", "clean", "column*:column invalid:null|flag|keep=null", stream=True)
def validate_email(df, p, ctx):
    clean = K.email(K.col(p["column"]))
    good = F.coalesce(clean.rlike(K.EMAIL), F.lit(False))
    if p["invalid"] == "null":
        return df.withColumn(p["column"], F.when(good, clean))
    new = {p["column"]: clean} | ({f"{p['column']}_is_valid": good} if p["invalid"] == "flag" else {})
    return df.withColumns(new)


@step("standardize_country", "clean", "column*:column output_format:name|iso2|iso3=name unknown:keep|null=keep", stream=True)
def standardize_country(df, p, ctx):
    c = K.col(p["column"])
    known = K.country(c, p["output_format"])
    return df.withColumn(p["column"], F.coalesce(known, K.strip(c)) if p["unknown"] == "keep" else known)


@step("standardize_boolean", "clean", "columns*:columns", stream=True)
def standardize_boolean(df, p, ctx):
    return df.withColumns({c: K.boolean(K.col(c)) for c in p["columns"]})


# ---- types
def cast(c: Column, kind: T.DataType, to: str, formats: list[str] | None = None) -> Column:
    number = K.as_number(c, kind)
    if to == "string":
        return K.text(c)
    if to == "integer":
        return F.round(number).try_cast("long")
    if to in ("decimal", "currency"):
        return F.round(number, 2 if to == "currency" else 6)
    if to == "percentage":
        return K.percent(c) if isinstance(kind, T.StringType) else number
    if to == "boolean":
        return c if isinstance(kind, T.BooleanType) else K.boolean(c)
    if to == "date":
        return c.cast("date") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else K.date(c, formats)
    if to == "timestamp":
        return c if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else K.timestamp(c)
    raise StepError(f"there is no type {to!r}")


@step("convert_types", "types", "conversions*:column_types date_format:text", stream=True)
def convert_types(df, p, ctx):
    formats = [p["date_format"]] if p.get("date_format") else None
    return df.withColumns({x["column"]: cast(need(df, x["column"]), df.schema[x["column"]].dataType, x["to"], formats) for x in p["conversions"]})


# ---- text
@step("split_column", "text", "column*:column delimiter:text into:text keep_original:boolean=True", stream=True)
def split_column(df, p, ctx):
    """Parts into named columns; the last one takes the rest. Without names, one small aggregate finds how many there are, six at most."""
    name, d = p["column"], p.get("delimiter") or " "
    parts = F.split(K.text(K.col(name)), K.quote(d))
    names = [x.strip() for x in (p["into"] if isinstance(p.get("into"), list) else (p.get("into") or "").split(",")) if x.strip()]
    if not names:
        widest = df.agg(F.max(F.size(parts)).alias("n")).first().n or 1
        names = [f"{name}_{i + 1}" for i in range(min(max(widest, 1), 6))]
    last = len(names) - 1
    piece = lambda i: F.get(parts, F.lit(i)) if i < last else F.when(F.size(parts) > i, F.array_join(F.slice(parts, F.lit(i + 1), F.size(parts)), d))
    full = df.withColumns({n: F.nullif(K.strip(piece(i)), F.lit("")) for i, n in enumerate(names)})
    return full if p["keep_original"] or name in names else full.drop(name)


@step("merge_columns", "text", "columns*:columns separator:text output:text=full_name", stream=True)
def merge_columns(df, p, ctx):
    between = " " if p.get("separator") is None else p["separator"]
    return df.withColumn(p["output"], F.concat_ws(between, *(K.strip(K.col(c)) for c in p["columns"])))


@step("extract_substring", "text", "column*:column start:number=1 length:number=3 output:text", stream=True)
def extract_substring(df, p, ctx):
    return df.withColumn(out(p, f"{p['column']}_part"), F.substring(K.text(K.col(p["column"])), max(1, int(p["start"])), int(p["length"])))


@step("extract_before", "text", "column*:column delimiter:text=@ output:text", stream=True)
def extract_before(df, p, ctx):
    return df.withColumn(out(p, f"{p['column']}_before"), F.substring_index(K.text(K.col(p["column"])), p["delimiter"], 1))


@step("extract_after", "text", "column*:column delimiter:text=@ output:text", stream=True)
def extract_after(df, p, ctx):
    c, d = K.text(K.col(p["column"])), p["delimiter"]
    at = F.instr(c, d)
    return df.withColumn(out(p, f"{p['column']}_after"), F.when(at > 0, F.substr(c, at + len(d))))


#: Ready-made patterns of the regex steps.
PATTERNS = {"digits": r"\d+", "letters": r"[A-Za-z]+", "email": r"[A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "whitespace": r"\s+", "non_alphanumeric": r"[^A-Za-z0-9]+"}


@step("regex_replace", "text", "columns*:columns pattern*:text replacement:text", stream=True)
def regex_replace(df, p, ctx):
    pattern = "(?U)" + PATTERNS.get(p["pattern"], p["pattern"])
    return on_texts(df, p, lambda c: F.regexp_replace(c, pattern, K.replacement(p.get("replacement") or "")))


@step("regex_extract", "text", "column*:column pattern*:text output:text", stream=True)
def regex_extract(df, p, ctx):
    import re

    pattern = PATTERNS.get(p["pattern"], p["pattern"])
    if not re.compile(pattern).groups:
        pattern = f"({pattern})"
    c = K.text(K.col(p["column"]))
    return df.withColumn(out(p, f"{p['column']}_match"), F.when(c.rlike("(?U)" + pattern), F.regexp_extract(c, "(?U)" + pattern, 1)))


@step("add_prefix", "text", "columns*:columns value*:text", stream=True)
def add_prefix(df, p, ctx):
    return df.withColumns({c: F.concat(F.lit(p["value"]), K.text(K.col(c))) for c in p["columns"]})


@step("add_suffix", "text", "columns*:columns value*:text", stream=True)
def add_suffix(df, p, ctx):
    return df.withColumns({c: F.concat(K.text(K.col(c)), F.lit(p["value"])) for c in p["columns"]})


@step("text_length", "text", "column*:column output:text", stream=True)
def text_length(df, p, ctx):
    return df.withColumn(out(p, f"{p['column']}_length"), F.char_length(K.text(K.col(p["column"]))).cast("long"))


# ---- dates
def day(df: DataFrame, name: str) -> Column:
    return K.as_date(need(df, name), df.schema[name].dataType)


@step("parse_date", "datetime", "columns*:columns day_first:boolean=False", stream=True)
def parse_date(df, p, ctx):
    return df.withColumns({c: K.date(K.col(c), None, p["day_first"]) if is_text(df, c) else day(df, c) for c in p["columns"]})


@step("standardize_date", "datetime", "column*:column format:text=%Y-%m-%d", stream=True)
def standardize_date(df, p, ctx):
    if p["format"] not in K.NAMED:
        raise StepError(f"there is no format {p['format']!r}")
    return df.withColumn(p["column"], F.date_format(day(df, p["column"]), K.NAMED[p["format"]][1]))


@step("extract_date_part", "datetime", "column*:column part:year|month|quarter|day|day_of_week|week|month_name=year output:text", stream=True)
def extract_date_part(df, p, ctx):
    d = day(df, p["column"])
    part = {"year": F.year, "month": F.month, "quarter": F.quarter, "day": F.dayofmonth, "week": F.weekofyear, "day_of_week": lambda x: F.date_format(x, "EEEE"), "month_name": lambda x: F.date_format(x, "MMMM")}[p["part"]]
    return df.withColumn(out(p, f"{p['column']}_{p['part']}"), part(d))


@step("fiscal_period", "datetime", "column*:column start_month:number=1 part:fiscal_year|fiscal_quarter=fiscal_year output:text", stream=True)
def fiscal_period(df, p, ctx):
    d, start = day(df, p["column"]), int(p["start_month"])
    year = F.year(d) + (F.when(F.month(d) >= start, 1).otherwise(0) if start > 1 else F.lit(0))
    quarter = F.floor(F.pmod(F.month(d) - start, F.lit(12)) / 3) + 1
    value = F.concat(F.lit("FY"), year.cast("string")) if p["part"] == "fiscal_year" else F.concat(F.lit("FQ"), quarter.cast("string"))
    return df.withColumn(out(p, p["part"]), value)


@step("date_difference", "datetime", "start_column*:column end_column:column unit:days|weeks|months|years=days output:text=days_between", stream=True)
def date_difference(df, p, ctx):
    end = day(df, p["end_column"]) if p.get("end_column") else F.lit(ctx.today)
    days = F.datediff(end, day(df, p["start_column"]))
    length = {"days": 1, "weeks": 7, "months": 30.4375, "years": 365.25}[p["unit"]]
    return df.withColumn(p["output"], (days if length == 1 else F.floor(days / length)).cast("long"))


@step("calculate_age", "datetime", "column*:column output:text=age", stream=True)
def calculate_age(df, p, ctx):
    d, t = day(df, p["column"]), F.lit(ctx.today)
    early = F.struct(F.month(d), F.dayofmonth(d)) > F.struct(F.month(t), F.dayofmonth(t))
    return df.withColumn(p["output"], (F.year(t) - F.year(d) - F.when(early, 1).otherwise(0)).cast("long"))


@step("convert_timezone", "datetime", "column*:column from_tz:text=UTC to_tz:text=America/New_York", stream=True)
def convert_timezone(df, p, ctx):
    c = K.col(p["column"])
    local = K.timestamp(c) if is_text(df, p["column"]) else c.cast("timestamp_ntz")
    moved = F.convert_timezone(F.lit(p["from_tz"]), F.lit(p["to_tz"]), local)
    # a local time that the clock skipped does not come back
    utc = F.convert_timezone(F.lit(p["from_tz"]), F.lit("UTC"), local)
    real = F.convert_timezone(F.lit("UTC"), F.lit(p["from_tz"]), utc) == local
    return df.withColumn(p["column"], F.when(real, moved))


@step("to_timestamp", "datetime", "column*:column source:text|epoch_s|epoch_ms=text", stream=True)
def to_timestamp(df, p, ctx):
    c = K.col(p["column"])
    if p["source"] == "text":
        value = K.timestamp(c) if is_text(df, p["column"]) else c.cast("timestamp_ntz")
    else:
        number = K.as_number(c, df.schema[p["column"]].dataType).try_cast("long")
        instant = F.timestamp_seconds(number) if p["source"] == "epoch_s" else F.timestamp_millis(number)
        value = F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
    return df.withColumn(p["column"], value)


# ---- derived
@step("derive_column", "derived", "output*:text expression*:expression", stream=True)
def derive_column(df, p, ctx):
    return df.withColumn(p["output"], compile_formula(p["expression"], df, ctx.today))


@step("conditional_column", "derived", "output*:text rules*:case_rules default:text", stream=True)
def conditional_column(df, p, ctx):
    value = lambda v: F.lit(None).cast("string") if v in (None, "") else F.lit(str(v))
    rules = [(combine(df, r.get("conditions") or [], r.get("logic", "and")), value(r.get("value"))) for r in p["rules"]]
    return df.withColumn(p["output"], reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(rules), value(p.get("default"))))


# ---- enrichment
@step("map_codes", "enrich", "column*:column mapping*:mapping output:text default:text", stream=True)
def map_codes(df, p, ctx):
    c = K.col(p["column"])
    table = {str(k).strip().lower(): str(v) for k, v in p["mapping"].items()}
    rest = F.lit(p["default"]) if p.get("default") not in (None, "") else K.text(c)
    return df.withColumn(out(p, p["column"]), F.coalesce(K.lookup(K.key(c), table), rest))


@step("enrich_country", "enrich", "column*:column attributes:list", stream=True)
def enrich_country(df, p, ctx):
    fields = p.get("attributes") or ["iso2", "region", "currency"]
    return df.withColumns({f"{p['column']}_{f}": K.country(K.col(p["column"]), f) for f in fields})


@step("currency_conversion", "enrich", "amount_column*:column currency_column*:column target:text=USD output:text", stream=True)
def currency_conversion(df, p, ctx):
    amount = K.as_number(K.col(p["amount_column"]), df.schema[p["amount_column"]].dataType)
    rate = K.lookup(F.upper(K.strip(K.col(p["currency_column"]))), K.FX_TO_USD)
    return df.withColumn(out(p, f"{snake(p['amount_column'])}_{p['target'].lower()}"), F.round(amount * rate / K.FX_TO_USD[p["target"]], 2))


@step("classify_ranges", "enrich", "column*:column bins*:bins output:text", stream=True)
def classify_ranges(df, p, ctx):
    v = K.as_number(K.col(p["column"]), df.schema[p["column"]].dataType)
    given = lambda b, k: None if b.get(k) in (None, "") else float(b[k])
    inside = lambda b: K.all_of([v.isNotNull(), *([v >= given(b, "min")] if given(b, "min") is not None else []), *([v < given(b, "max")] if given(b, "max") is not None else [])])
    bands = [(inside(b), F.lit(str(b.get("label")))) for b in p["bins"]]
    return df.withColumn(out(p, f"{p['column']}_band"), reduce(lambda rest, b: F.when(b[0], b[1]).otherwise(rest), reversed(bands), F.lit(None).cast("string")))


# ---- protection
@step("mask", "pii", "columns*:columns style:partial|email|full=partial", stream=True)
def mask(df, p, ctx):
    def make(c: Column) -> Column:
        s, n = K.text(c), F.length(K.text(c))
        if p["style"] == "full":
            return F.when(s.isNotNull(), "•" * 6)
        partial = F.when(n <= 4, F.repeat(F.lit("•"), n)).otherwise(F.concat(F.repeat(F.lit("•"), n - 4), F.right(s, F.lit(4))))
        if p["style"] == "email":
            return F.when(F.instr(s, "@") > 0, F.concat(F.left(s, F.lit(1)), F.lit("•••@"), F.substr(s, F.instr(s, "@") + 1))).otherwise(partial)
        return partial

    return df.withColumns({c: make(K.col(c)) for c in p["columns"]})


@step("hash", "pii", "columns*:columns salted:boolean=True", stream=True)
def hash_(df, p, ctx):
    salt = ctx.key.decode() if p["salted"] else ""
    return df.withColumns({c: F.sha2(F.concat(F.lit(salt), K.text(K.col(c))), 256) for c in p["columns"]})


def hmac(c: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex, of two nested hashes."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    inside = F.sha2(F.concat(F.unhex(F.lit(inner.hex())), K.text(c).cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer.hex())), F.unhex(inside)), 256)


@step("tokenize", "pii", "columns*:columns", stream=True)
def tokenize(df, p, ctx):
    return df.withColumns({c: F.concat(F.lit("tok_"), F.left(hmac(K.col(c), ctx.key), F.lit(16))) for c in p["columns"]})


@step("encrypt", "pii", "columns*:columns", stream=True)
def encrypt(df, p, ctx):
    """Authenticated encryption under a random nonce; decrypt() brings the values back."""
    key = F.lit(hashlib.sha256(ctx.key).digest())
    return df.withColumns({c: F.concat(F.lit("enc:"), F.base64(F.aes_encrypt(K.text(K.col(c)), key, F.lit("GCM")))) for c in p["columns"]})


def decrypt(c: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(c.substr(F.lit(5), F.length(c))), F.lit(hashlib.sha256(key).digest()), F.lit("GCM")).cast("string")


@step("restrict", "pii", "columns*:columns", flags="D", stream=True)
def restrict(df, p, ctx: Context):
    return df.drop(*p["columns"])


# ---- quality, by row
@step("remove_invalid", "quality", "column*:column check:email|phone|date|number|not_null|non_negative|in_reference=email action:remove|flag=remove", flags="DR", stream=True)
def remove_invalid(df, p, ctx):
    c, kind = K.col(p["column"]), df.schema[p["column"]].dataType
    good = {
        "email": lambda: K.email(c).rlike(K.EMAIL),
        "phone": lambda: K.phone(c).isNotNull(),
        "date": lambda: K.as_date(c, kind).isNotNull(),
        "number": lambda: K.as_number(c, kind).isNotNull(),
        "not_null": lambda: ~K.blank(c),
        "non_negative": lambda: K.as_number(c, kind) >= 0,
        "in_reference": lambda: K.country(c).isNotNull(),
    }[p["check"]]()
    valid = F.coalesce(good, F.lit(False))
    if p["check"] != "not_null":
        valid = K.blank(c) | valid
    return df.where(valid) if p["action"] == "remove" else df.withColumn(f"{p['column']}_is_valid", valid)
