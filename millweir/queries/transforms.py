"""A query for each transformation step, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millweir.functions import kernels as K
from millweir.operators.registry import run
from millweir.operators.scalar import PATTERNS, decrypt
from millweir.queries.base import context, steps, view, with_views
from millweir.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:  # noqa: ANN001
    QUERIES[name] = query
    if sql:
        ORACLES[name] = with_views(sql)


def one(name: str, base: str, params: dict, keep: list[str] | None, sql: str | None, key: str | None = None, order: list[str] | None = None) -> None:
    add(key or name, steps(base, (name, params), keep=keep, order=order), sql)


# the kernels in SQL
TRIM = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
BLANK = lambda c: f"coalesce({TRIM(c)} = '', true)"
_BARE = lambda c: rf"regexp_replace({TRIM(c)}, '[$€£¥,\s%()]', '', 'g')"
NUM = lambda c: rf"(case when {TRIM(c)} like '(%)' then -1 else 1 end * try_cast(case when regexp_matches({_BARE(c)}, '^[+-]?(\d+\.?\d*|\.\d+)$') then {_BARE(c)} end as double))"
DATE = lambda c: f"cast(coalesce(try_strptime({TRIM(c)}, '%Y-%m-%d'), try_strptime({TRIM(c)}, '%m/%d/%Y'), try_strptime({TRIM(c)}, '%d.%m.%Y')) as date)"
_COUNTRY = "case lower(trim({c})) when 'usa' then '{0}' when 'u.k.' then '{1}' when 'deutschland' then '{2}' when 'fr' then '{3}' end"
COUNTRY = {"name": ("United States", "United Kingdom", "Germany", "France"), "iso2": ("US", "GB", "DE", "FR"), "iso3": ("USA", "GBR", "DEU", "FRA"), "region": ("North America", "Europe", "Europe", "Europe"), "currency": ("USD", "GBP", "EUR", "EUR"), "dial": ("1", "44", "49", "33")}
country = lambda c, f: _COUNTRY.format(*COUNTRY[f], c=c)
TITLE = lambda c: rf"array_to_string(list_transform(regexp_extract_all(lower(regexp_replace({TRIM(c)}, '\s+', ' ', 'g')), '[^\s''-]*[\s''-]?'), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), '')"

SQUEEZE = r"regexp_replace(name, '\s+', ' ', 'g')"

# ---- clean
one("trim_whitespace", "cust", {}, ["id", "name", "email"], f"select id, {TRIM('name')} as name, {TRIM('email')} as email from cust")
one("remove_whitespace", "cust", {"columns": ["name"]}, ["id", "name"], r"select id, regexp_replace(name, '\s+', '', 'g') as name from cust")
one("uppercase", "cust", {"columns": ["name"]}, ["id", "name"], "select id, upper(name) as name from cust")
one("lowercase", "cust", {"columns": ["name"]}, ["id", "name"], "select id, lower(name) as name from cust")
one("titlecase", "cust", {"columns": ["name"]}, ["id", "name"], f"select id, {TITLE('name')} as name from cust")
one("replace_values", "cust", {"column": "country", "mapping": {"USA": "US", "fr": "FR"}}, ["id", "country"], "select id, case country when 'USA' then 'US' when 'fr' then 'FR' else country end as country from cust")
one("find_replace", "cust", {"columns": ["name"], "find": "CUSTOMER", "replace": "$C"}, ["id", "name"], r"select id, regexp_replace(name, 'customer', '$C', 'gi') as name from cust")
one("find_replace", "cust", {"columns": ["name"], "find": "luc", "replace": "x", "whole_word": True}, ["id", "name"], r"select id, regexp_replace(name, '\bluc\b', 'x', 'gi') as name from cust", "find_replace_word")
one("remove_special_characters", "cust", {"columns": ["name"], "keep": "-"}, ["id", "name"], r"select id, regexp_replace(name, '[^\w\s\-]', '', 'g') as name from cust")
one("normalize_strings", "cust", {"columns": ["name"]}, ["id", "name"], rf"select id, {TRIM(SQUEEZE)} as name from cust")
one("normalize_strings", "odd", {"columns": ["wide"]}, ["id", "wide"], "select id, 'Ab' || cast(id % 9 as varchar) || 'fi 1⁄2' as wide from odd", "normalize_strings_wide")
one("clean_punctuation", "cust", {"columns": ["name"]}, ["id", "name"], r"select id, regexp_replace(replace(name, '!!', '!'), '^[[:punct:]\s]+|[[:punct:]\s]+$', '', 'g') as name from cust")
one("standardize_codes", "cust", {"columns": ["code"], "pad_length": 5}, ["id", "code"], r"with x as (select id, upper(regexp_replace(code, '\s+', '', 'g')) as c from cust) select id, case when length(c) < 5 then lpad(c, 5, '0') else c end as code from x")
PHONE = "case when phone like '(555)%' then '+1' || regexp_replace(phone, '[^0-9]', '', 'g') when phone like '+44%' then '+' || regexp_replace(phone, '[^0-9]', '', 'g') when phone like '1555%' then '+' || phone end"
one("standardize_phone", "cust", {"column": "phone"}, ["id", "phone"], f"select id, {PHONE} as phone from cust")
EMAIL = r"lower(regexp_replace(email, '\s+', '', 'g'))"
GOOD = rf"regexp_matches({EMAIL}, '^[A-Za-z0-9._%+''-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}$')"
one("validate_email", "cust", {"column": "email"}, ["id", "email"], f"select id, case when {GOOD} then {EMAIL} end as email from cust")
one("validate_email", "cust", {"column": "email", "invalid": "flag"}, ["id", "email", "email_is_valid"], f"select id, {EMAIL} as email, coalesce({GOOD}, false) as email_is_valid from cust", "validate_email_flag")
one("standardize_country", "cust", {"column": "country"}, ["id", "country"], f"select id, coalesce({country('country', 'name')}, trim(country)) as country from cust")
one("standardize_country", "cust", {"column": "country", "output_format": "iso3", "unknown": "null"}, ["id", "country"], f"select id, {country('country', 'iso3')} as country from cust", "standardize_country_iso3")
one("standardize_boolean", "cust", {"columns": ["flag"]}, ["id", "flag"], "select id, case when lower(trim(flag)) in ('yes', '1') then true when lower(trim(flag)) = 'no' then false end as flag from cust")
one("standardize_values", "cust", {"column": "code", "case": "most_common"}, ["id", "code"], r"""with v as (select id, trim(code) as v, regexp_replace(lower(trim(code)), '[^\w]', '', 'g') as k from cust),
  c as (select k, v, count(*) as n from v group by k, v), t as (select k, v, row_number() over (partition by k order by n desc, v) as r from c) select v.id, t.v as code from v join t on v.k = t.k and t.r = 1""")
# ---- types
one("convert_types", "cust", {"conversions": [{"column": "amount", "to": "currency"}, {"column": "joined", "to": "date"}, {"column": "flag", "to": "boolean"}, {"column": "nation", "to": "string"}, {"column": "bal", "to": "integer"}]}, ["id", "amount", "joined", "flag", "nation", "bal"],
    f"select id, round({NUM('amount')}, 2) as amount, {DATE('joined')} as joined, case when lower(trim(flag)) in ('yes', '1') then true when lower(trim(flag)) = 'no' then false end as flag, cast(nation as varchar) as nation, cast(round(bal) as bigint) as bal from cust")
# ---- text
one("split_column", "cust", {"column": "email", "delimiter": "@", "into": "user,host"}, ["id", "user", "host"], f"select id, nullif({TRIM('split_part(email, chr(64), 1)')}, '') as \"user\", case when contains(email, '@') then nullif({TRIM('split_part(email, chr(64), 2)')}, '') end as host from cust")
one("split_column", "cust", {"column": "code", "delimiter": " "}, ["id", "code", "code_1", "code_2", "code_3"], "select id, code, nullif(split_part(code, ' ', 1), '') as code_1, nullif(split_part(code, ' ', 2), '') as code_2, nullif(split_part(code, ' ', 3), '') as code_3 from cust", "split_column_auto")
one("merge_columns", "cust", {"columns": ["name", "country"], "separator": "/", "output": "m"}, ["id", "m"], f"select id, concat_ws('/', {TRIM('name')}, {TRIM('country')}) as m from cust")
one("extract_substring", "cust", {"column": "email", "start": 2, "length": 4, "output": "s"}, ["id", "s"], "select id, substr(email, 2, 4) as s from cust")
one("extract_before", "cust", {"column": "email", "output": "s"}, ["id", "s"], "select id, split_part(email, '@', 1) as s from cust")
one("extract_after", "cust", {"column": "email", "output": "s"}, ["id", "s"], "select id, case when strpos(email, '@') > 0 then substr(email, strpos(email, '@') + 1) end as s from cust")
one("regex_replace", "cust", {"columns": ["phone"], "pattern": r"\D", "replacement": ""}, ["id", "phone"], r"select id, regexp_replace(phone, '[^0-9]', '', 'g') as phone from cust")
one("regex_extract", "cust", {"column": "email", "pattern": "digits", "output": "n"}, ["id", "n"], rf"select id, nullif(regexp_extract(email, '({PATTERNS['digits']})', 1), '') as n from cust")
one("add_prefix", "cust", {"columns": ["name"], "value": "Ms "}, ["id", "name"], "select id, 'Ms ' || name as name from cust")
one("add_suffix", "cust", {"columns": ["name"], "value": "/x"}, ["id", "name"], "select id, name || '/x' as name from cust")
one("text_length", "cust", {"column": "name", "output": "n"}, ["id", "n"], "select id, length(name) as n from cust")
# ---- dates
one("convert_types", "odd", {"conversions": [{"column": "share", "to": "percentage"}, {"column": "stamp", "to": "timestamp"}]}, ["id", "share", "stamp"],
    "select id, case when id % 4 = 0 then cast(id % 100 as double) / 100 when id % 4 = 1 then cast(id % 100 as double) / 100 when id % 4 = 2 then cast(id % 100 + 2 as double) / 100 end as share, case when id % 3 < 2 then cast(made as timestamp) + interval '7 hours 8 minutes 9 seconds' end as stamp from odd", "convert_types_typed")
one("convert_types", "cust", {"conversions": [{"column": "amount", "to": "decimal"}]}, ["id", "amount"], f"select id, round({NUM('amount')}, 6) as amount from cust", "convert_types_decimal")
one("parse_date", "odd", {"columns": ["day"]}, ["id", "day"], "select id, case when id % 19 = 6 then make_date(year(made), month(made), 28) when id % 19 < 17 then made end as day from odd", "parse_date_formats")
one("parse_date", "cust", {"columns": ["joined"]}, ["id", "joined"], f"select id, {DATE('joined')} as joined from cust")
one("standardize_date", "cust", {"column": "joined", "format": "%d/%m/%Y"}, ["id", "joined"], f"select id, strftime({DATE('joined')}, '%d/%m/%Y') as joined from cust")
for _part, _sql in {"year": "cast(year({}) as integer)", "month": "cast(month({}) as integer)", "quarter": "cast(quarter({}) as integer)", "day": "cast(day({}) as integer)", "week": "cast(week({}) as integer)", "day_of_week": "dayname({})", "month_name": "monthname({})"}.items():
    one("extract_date_part", "cust", {"column": "joined", "part": _part, "output": "x"}, ["id", "x"], f"select id, {_sql.format(DATE('joined'))} as x from cust", f"extract_date_part_{_part}")
one("fiscal_period", "cust", {"column": "joined", "start_month": 4}, ["id", "fiscal_year"], f"select id, 'FY' || cast(year({DATE('joined')}) + case when month({DATE('joined')}) >= 4 then 1 else 0 end as varchar) as fiscal_year from cust")
one("fiscal_period", "cust", {"column": "joined", "start_month": 4, "part": "fiscal_quarter"}, ["id", "fiscal_quarter"], f"select id, 'FQ' || cast((month({DATE('joined')}) - 4 + 12) % 12 // 3 + 1 as varchar) as fiscal_quarter from cust", "fiscal_quarter")
for _unit, _len in {"days": 1, "weeks": 7, "months": 30.4375, "years": 365.25}.items():
    one("date_difference", "cust", {"start_column": "joined", "unit": _unit, "output": "n"}, ["id", "n"], f"select id, cast(floor(date_diff('day', {DATE('joined')}, date '2024-06-30') / cast({_len} as double)) as bigint) as n from cust", f"date_difference_{_unit}")
one("calculate_age", "cust", {"column": "joined"}, ["id", "age"], f"select id, date_sub('year', {DATE('joined')}, date '2024-06-30') as age from cust")
one("convert_timezone", "cust", {"column": "joined", "to_tz": "Asia/Kolkata"}, ["id", "joined"], f"select id, cast({DATE('joined')} as timestamp) + interval 330 minute as joined from cust")
one("to_timestamp", "cust", {"column": "joined"}, ["id", "joined"], f"select id, cast({DATE('joined')} as timestamp) as joined from cust")
one("to_timestamp", "cust", {"column": "id", "source": "epoch_s"}, ["nation", "id"], "select nation, make_timestamp(id * 1000000) as id from cust", "to_timestamp_epoch")
# ---- missing
one("flag_missing", "cust", {"columns": ["name", "amount"]}, ["id", "name_is_missing", "amount_is_missing"], f"select id, {BLANK('name')} as name_is_missing, {BLANK('amount')} as amount_is_missing from cust")
one("drop_missing", "cust", {"columns": ["name", "amount"]}, ["id"], f"select id from cust where not ({BLANK('name')} or {BLANK('amount')})")
one("drop_missing", "cust", {"columns": ["name", "amount"], "how": "all"}, ["id"], f"select id from cust where not ({BLANK('name')} and {BLANK('amount')})", "drop_missing_all")
one("fill_constant", "cust", {"columns": ["name", "sparse"], "value": "7"}, ["id", "name", "sparse"], f"select id, case when {BLANK('name')} then '7' else name end as name, coalesce(sparse, 7) as sparse from cust")
one("fill_zero", "cust", {"columns": ["amount", "sparse"]}, ["id", "amount", "sparse"], f"select id, case when {BLANK('amount')} then '0' else amount end as amount, coalesce(sparse, 0) as sparse from cust")
one("fill_mean", "cust", {"columns": ["sparse"]}, ["id", "sparse"], "select id, coalesce(sparse, (select round(avg(sparse), 2) from cust)) as sparse from cust")
one("fill_median", "cust", {"columns": ["sparse"]}, ["id", "sparse"], "select id, coalesce(sparse, (select round(median(sparse), 2) from cust)) as sparse from cust")
one("fill_mode", "cust", {"columns": ["country"]}, ["id", "country"], "select id, coalesce(country, (select country from cust where country is not null group by 1 order by count(*) desc, country limit 1)) as country from cust")
one("forward_fill", "cust", {"columns": ["amount", "sparse"]}, ["id", "amount", "sparse"], f"select id, last_value(case when not {BLANK('amount')} then amount end ignore nulls) over w as amount, last_value(sparse ignore nulls) over w as sparse from cust window w as (order by id rows between unbounded preceding and current row)", order=["id"])
one("backward_fill", "cust", {"columns": ["amount", "sparse"]}, ["id", "amount", "sparse"], f"select id, first_value(case when not {BLANK('amount')} then amount end ignore nulls) over w as amount, first_value(sparse ignore nulls) over w as sparse from cust window w as (order by id rows between current row and unbounded following)", order=["id"])
one("smart_impute", "cust", {"column": "sparse", "group_by": ["segment"]}, ["id", "sparse"], "select id, round(coalesce(sparse, median(sparse) over (partition by segment), median(sparse) over ()), 2) as sparse from cust")
one("smart_impute", "cust", {"column": "country", "group_by": ["segment"], "value_kind": "text"}, ["id", "country"], "with m as (select segment, country, row_number() over (partition by segment order by count(*) desc, country) as r from cust where country is not null group by 1, 2) select id, coalesce(cust.country, m.country) as country from cust left join m on cust.segment = m.segment and r = 1", "smart_impute_text")
# ---- duplicates
one("flag_duplicates", "dup", {"columns": ["k", "txt"]}, ["v", "is_duplicate"], "select v, count(*) over (partition by k, txt) > 1 as is_duplicate from dup")
for _keep, _by in {"first": "v", "last": "v desc", "latest": "try_cast(d as date) desc nulls last, v", "highest_quality": "case when txt is null then 0 else 1 end + case when d is null then 0 else 1 end desc, v"}.items():
    one("remove_duplicates", "dup", {"columns": ["k"], "keep": _keep, "order_by": "d" if _keep == "latest" else None}, None, f"select k, v, seg, txt, d from dup qualify row_number() over (partition by k order by {_by}) = 1", f"remove_duplicates_{_keep}", ["v"])
_NEAR = "with o as (select id, id % 40 as k, lower(regexp_replace(near, '[^A-Za-z0-9]', '', 'g')) as t from odd), f as (select k, min(id) as first from o group by k), h as (select f.k, o.t from f join o on o.id = f.first) "
one("fuzzy_duplicates", "odd", {"columns": ["near"], "threshold": 95}, ["id", "similar_group", "has_similar"], _NEAR + "select o.id, substr(h.t, 1, 2) || '-' || substr(sha256(h.t), 1, 12) as similar_group, count(*) over (partition by o.k) > 1 as has_similar from o join h on o.k = h.k", order=["id"])
one("fuzzy_duplicates", "odd", {"columns": ["near"], "threshold": 95, "action": "remove"}, ["id"], _NEAR + "select first as id from f", "fuzzy_duplicates_near_remove", ["id"])
one("fuzzy_duplicates", "dup", {"columns": ["seg"], "action": "remove"}, ["seg", "v"], "select seg, min(v) as v from dup group by seg", "fuzzy_duplicates_remove", ["v"])
one("survivorship", "dup", {"columns": ["k"], "rules": {"v": "max", "seg": "longest", "txt": "most_common"}}, None, """with m as (select k, txt, row_number() over (partition by k order by count(*) desc, txt) as r from dup where txt is not null group by k, txt)
  select dup.k, max(v) as v, first(seg order by length(seg) desc, v) as seg, any_value(m.txt) as txt, first(d order by v) filter (where d is not null) as d from dup left join m on dup.k = m.k and m.r = 1 group by dup.k""", order=["v"])
# ---- filter
one("filter_rows", "cust", {"conditions": [{"column": "amount", "op": "gt", "value": "50"}, {"column": "segment", "op": "equals", "value": "building"}], "logic": "or"}, ["id"], f"select id from cust where coalesce({NUM('amount')} > 50, false) or lower(segment) = 'building'")
one("filter_rows", "cust", {"conditions": [{"column": "country", "op": "not_equals", "value": "usa"}, {"column": "name", "op": "contains", "value": "CUST"}], "mode": "remove"}, ["id"], "select id from cust where not (coalesce(lower(trim(country)), '') <> 'usa' and coalesce(contains(lower(name), 'cust'), false))", "filter_rows_remove")
add("sort_rows_limit_rows", steps("cust", ("sort_rows", {"keys": [{"column": "sparse", "desc": True}, {"column": "id"}]}), ("limit_rows", {"n": 25}), keep=["id", "sparse"]), "select id, sparse from cust order by sparse desc nulls last, id limit 25")
one("sort_rows", "cust", {"keys": [{"column": "amount", "value_kind": "number"}, {"column": "id"}]}, ["id", "amount"], "select id, amount from cust")
one("limit_rows", "cust", {"n": 10}, ["id"], "select id from cust order by id limit 10", order=["id"])
# ---- joins
for _how, _sql in {"inner": "join", "left": "left join"}.items():
    one("join", "ord", {"right_dataset": "cust", "left_on": ["custkey"], "right_on": ["id"], "how": _how, "columns": ["segment"]}, ["okey", "custkey", "segment"], f"select okey, custkey, segment from ord {_sql} cust on custkey = id", f"join_{_how}")
one("join", "ord", {"right_dataset": "cust", "left_on": ["custkey"], "right_on": ["id"], "how": "full", "columns": ["segment"]}, ["okey", "custkey", "segment"], "select okey, cast(coalesce(custkey, id) as varchar) as custkey, segment from ord full join cust on custkey = id", "join_full")
one("join", "ord", {"right_dataset": "cust", "left_on": ["custkey"], "right_on": ["id"], "how": "right", "columns": ["segment"]}, ["okey", "custkey", "segment"], "select okey, cast(coalesce(custkey, id) as varchar) as custkey, segment from ord right join cust on custkey = id", "join_right")
one("join", "ord", {"right_dataset": "cust", "left_on": ["custkey"], "right_on": ["id"], "how": "semi"}, ["okey"], "select okey from ord where custkey in (select id from cust)", "join_semi")
one("join", "ord", {"right_dataset": "cust", "left_on": ["custkey"], "right_on": ["id"], "how": "anti"}, ["okey", "custkey"], "select okey, custkey from ord where custkey not in (select id from cust)", "join_anti")
one("join", "nat", {"right_dataset": "nat", "how": "cross"}, ["nkey", "nkey_right"], "select a.nkey, b.nkey as nkey_right from nat a cross join nat b", "join_cross")
one("lookup", "cust", {"right_dataset": "dup", "left_on": "nation", "right_on": "k", "columns": ["v"]}, ["id", "v"], "select id, v from cust left join (select k, min(v) as v from dup group by k) dup on nation = k", order=["v"])
one("fuzzy_join", "cust", {"right_dataset": "nat", "left_on": "nation", "right_on": "nkey"}, ["id", "nname"], "select id, nname from cust left join nat on nation = nkey")
one("reference_lookup", "ord", {"column": "custkey", "right_dataset": "cust", "right_on": "id", "columns": ["segment"]}, ["okey", "segment", "custkey_in_reference"], "select okey, segment, id is not null as custkey_in_reference from ord left join cust on custkey = id", order=["id"])
one("union", "nat", {"datasets": ["nat"]}, None, "select nkey, nname, region from nat")
one("union_all", "nat", {"datasets": ["dup"]}, ["nkey", "nname", "region", "k", "seg"], "select nkey, nname, region, k, seg from (select nkey, nname, region, null as k, null as seg from nat union all select null, null, null, k, seg from dup)")
one("fuzzy_join", "odd", {"right_dataset": "item", "left_on": "item", "right_on": "label"}, ["id", "nname"], "select id, nname from odd left join item on regexp_extract(odd.item, '[0-9]+') = regexp_extract(label, '[0-9]+')", "fuzzy_join_text")
one("union", "nat", {"datasets": ["half", "nat"]}, None, "select distinct cast(nkey as double) as nkey, nname, cast(region as varchar) as region from nat union select nkey, nname, region from half", "union_widened")
add("sort_rows_numbers_in_text", steps("cust", ("sort_rows", {"keys": [{"column": "amount", "value_kind": "number", "desc": True}, {"column": "id"}]}), ("limit_rows", {"n": 50}), keep=["id", "amount"]), f"select id, amount from cust order by {NUM('amount')} desc nulls last, id limit 50")
# ---- aggregates and windows
_AGGS = {"count": "count(price)", "sum": "round(sum(price), 2)", "mean": "round(avg(price), 4)", "min": "min(price)", "max": "max(price)", "median": "median(price)", "p25": "quantile_cont(price, 0.25)", "p75": "quantile_cont(price, 0.75)", "p90": "quantile_cont(price, 0.9)", "p95": "quantile_cont(price, 0.95)", "std": "round(stddev_samp(price), 4)"}


def _aggregates(spark: SparkSession, d: str) -> DataFrame:
    specs = [{"column": "price", "fn": f, "alias": f} for f in _AGGS] + [{"column": "custkey", "fn": "count_distinct", "alias": "customers"}, {"fn": "count", "alias": "rows"}, {"column": "prio", "fn": "first", "alias": "first"}, {"column": "prio", "fn": "last", "alias": "last"}]
    df = run(view(spark, d, "ord"), "aggregate", {"group_by": ["status"], "aggregations": specs}, context(spark, d, ["okey"]))
    return df.withColumns({"sum": F.round("sum", 2), "mean": F.round("mean", 4), "std": F.round("std", 4)})


add("aggregate", _aggregates, f"select status, {', '.join(f'{e} as {chr(34)}{n}{chr(34)}' for n, e in _AGGS.items())}, count(distinct custkey) as customers, count(*) as \"rows\", first(prio order by okey) as \"first\", last(prio order by okey) as \"last\" from ord group by status")
one("aggregate", "cust", {"aggregations": [{"column": "amount", "fn": "sum", "alias": "total"}, {"column": "country", "fn": "count_distinct", "alias": "countries"}]}, None, f"select sum({NUM('amount')}) as total, count(distinct country) + 1 as countries from cust", "aggregate_global")
_W = "over (partition by custkey order by odate, okey rows between unbounded preceding and current row)"
for _fn, _sql in {"row_number": f"row_number() {_W}", "rank": "rank() over (partition by custkey order by odate)", "dense_rank": "dense_rank() over (partition by custkey order by odate)", "running_sum": f"round(sum(price) {_W}, 4)", "running_avg": f"round(sum(price) {_W} / row_number() {_W}, 4)",
                  "moving_avg": "round(avg(price) over (partition by custkey order by odate, okey rows between 2 preceding and current row), 4)", "lag": "lag(price) over (partition by custkey order by odate, okey)", "lead": "lead(price) over (partition by custkey order by odate, okey)", "pct_of_total": "round(price / sum(price) over (partition by custkey) * 100, 2)"}.items():
    _make = steps("ord", ("window", {"partition_by": ["custkey"], "order_by": "odate", "fn": _fn, "column": "price", "output": "x"}), keep=["okey", "x"], order=["okey"])
    add(f"window_{_fn}", (lambda s, d, m=_make: m(s, d).withColumn("x", F.round("x", 4))) if "running" in _fn or "moving" in _fn else _make, f"select okey, {'cast(' if _fn in ('row_number', 'rank', 'dense_rank') else ''}{_sql}{' as integer)' if _fn in ('row_number', 'rank', 'dense_rank') else ''} as x from ord")
_run = steps("ord", ("window", {"order_by": "odate", "fn": "running_sum", "column": "price", "output": "x"}), keep=["okey", "x"], order=["okey"])
add("window_running_sum_global", lambda s, d: _run(s, d).withColumn("x", F.round("x", 2)), "select okey, round(sum(price) over (order by odate, okey rows between unbounded preceding and current row), 2) as x from ord")
one("window", "ord", {"order_by": "price", "fn": "row_number", "output": "x"}, ["okey", "x"], "select okey, row_number() over (order by price, okey) as x from ord", "window_row_number_global", ["okey"])
for _fn, _sql in {"rank": "cast(rank() over (order by prio) as integer)", "dense_rank": "cast(dense_rank() over (order by prio) as integer)", "lag": "lag(price) over (order by odate, okey)", "lead": "lead(price) over (order by odate, okey)", "moving_avg": "round(avg(price) over (order by odate, okey rows between 4 preceding and current row), 3)"}.items():
    _all = steps("ord", ("window", {"order_by": "prio" if "rank" in _fn else "odate", "fn": _fn, "column": "price", "output": "x", "window_size": 5}), keep=["okey", "x"], order=["okey"])
    add(f"window_{_fn}_global", (lambda s, d, m=_all: m(s, d).withColumn("x", F.round("x", 3))) if _fn == "moving_avg" else _all, f"select okey, {_sql} as x from ord")
# ---- pivots
_piv = steps("ord", ("pivot", {"index": ["prio"], "columns": "status", "values": "price", "column_values": ["F", "O", "P"]}))
add("pivot", lambda s, d: _piv(s, d).withColumns({c: F.round(c, 2) for c in "FOP"}), "select prio, " + ", ".join(f"round(sum(price) filter (where status = '{c}'), 2) as \"{c}\"" for c in "FOP") + " from ord group by prio")
one("unpivot", "nat", {"id_columns": ["nkey"]}, None, "select nkey, 'nname' as attribute, nname as \"value\" from nat union all select nkey, 'region', cast(region as varchar) from nat")
one("melt", "nat", {"id_columns": ["nkey"], "value_columns": ["region"]}, None, "select nkey, 'region' as variable, region as \"value\" from nat")
one("crosstab", "ord", {"row": "prio", "column": "status", "column_values": ["F", "O", "P"]}, None, "select prio, " + ", ".join(f"count(*) filter (where status = '{c}') as \"{c}\"" for c in "FOP") + " from ord group by prio")
# ---- schema
one("rename_columns", "nat", {"mapping": {"nname": "n", "zzz": "y"}}, None, "select nkey, nname as n, region from nat")
one("standardize_column_names", "nat", {}, None, "select nkey, nname, region from nat")
one("drop_columns", "nat", {"columns": ["region"]}, None, "select nkey, nname from nat")
one("select_columns", "nat", {"columns": ["nname"]}, None, "select nname from nat")
one("add_column", "nat", {"output": "c", "value": "5", "value_type": "number"}, None, "select nkey, nname, region, cast(5 as double) as c from nat")
one("reorder_columns", "nat", {"order": ["region"]}, None, "select region, nkey, nname from nat")


def _nested(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "ord").groupBy("custkey").agg(F.struct(F.min("okey").alias("lo"), F.struct(F.max("okey").alias("hi")).alias("in")).alias("s"), F.sort_array(F.collect_list("okey")).alias("keys"), F.sort_array(F.collect_list(F.struct("okey", "status"))).alias("items"))


def _on_nested(name: str, params: dict, keep: list[str]):  # noqa: ANN202
    return lambda spark, d: run(_nested(spark, d), name, params, context(spark, d)).select(*keep)


add("flatten", _on_nested("flatten", {"columns": ["s", "keys"]}, ["custkey", "s_lo", "s_in_hi", "keys"]), "select custkey, min(okey) as s_lo, max(okey) as s_in_hi, string_agg(cast(okey as varchar), ', ' order by okey) as keys from ord group by custkey")
add("explode", _on_nested("explode", {"column": "items"}, ["custkey", "items_okey", "items_status"]), "select custkey, okey as items_okey, status as items_status from ord")
add("extract_field", _on_nested("extract_field", {"column": "s", "path": "in.hi", "output": "hi"}, ["custkey", "hi"]), "select custkey, max(okey) as hi from ord group by custkey")
one("schema_mapping", "cust", {"mappings": [{"source": "amount", "target": "amt", "type": "decimal"}, {"source": "id", "target": "key"}], "drop_unmapped": True}, None, f"select {NUM('amount')} as amt, id as \"key\" from cust")
one("schema_evolution_align", "cust", {"target": "amount", "sources": ["joined", "country"]}, ["id", "amount"], f"select id, case when not {BLANK('amount')} then amount when not {BLANK('joined')} then joined else country end as amount from cust")
# ---- derived and enrichment
_c = lambda n: {"type": "column", "name": n}
_l = lambda v: {"type": "literal", "value": v}
_op = lambda o, a, b: {"type": "op", "op": o, "left": a, "right": b}
_f = lambda n, *a: {"type": "func", "name": n, "args": list(a)}
for _name, (_tree, _sql) in {
    "arithmetic": (_op("+", _op("*", _c("bal"), _l(2)), _op("/", _c("amount"), _l(4))), f"bal * 2 + {NUM('amount')} / 4"),
    "remainder": (_op("%", _c("id"), _l(7)), "id % 7"),
    "if": ({"type": "if", "condition": _op("and", _op(">", _c("bal"), _l(100)), {"type": "not", "arg": _f("is_empty", _c("name"))}), "then": _l("big"), "else": _l("small")}, f"case when bal > 100 and not {BLANK('name')} then 'big' else 'small' end"),
    "text": (_f("concat", _f("upper", _f("trim", _c("country"))), _l("-"), _f("left", _c("segment"), _l(3)), _f("to_text", _f("length", _c("segment")))), f"concat(upper({TRIM('country')}), '-', substr(segment, 1, 3), cast(length(segment) as varchar))"),
    "search": (_op("or", _f("contains", _c("segment"), _l("BUILD")), _op("==", _f("replace", _c("segment"), _l("AUTO"), _l("")), _l("MOBILE"))), "contains(segment, 'BUILD') or replace(segment, 'AUTO', '') = 'MOBILE'"),
    "numbers": (_f("coalesce", _f("round", _f("to_number", _c("amount")), _l(1)), _f("abs", _c("bal"))), f"coalesce(round({NUM('amount')}, 1), abs(bal))"),
    "rounding": (_op("-", _f("ceil", _c("bal")), _f("floor", _c("bal"))), "cast(ceil(bal) - floor(bal) as bigint)"),
    "dates": (_f("days_between", _f("add_days", _f("to_date", _c("joined")), _l(10)), _f("today")), f"date_diff('day', {DATE('joined')} + interval 10 day, date '2024-06-30')"),
    "date_parts": (_op("+", _op("*", _f("year", _c("joined")), _l(100)), _op("+", _f("month", _c("joined")), _op("*", _f("quarter", _c("joined")), _f("day", _c("joined"))))), f"cast(year({DATE('joined')}) * 100 + month({DATE('joined')}) + quarter({DATE('joined')}) * day({DATE('joined')}) as integer)"),
    "comparisons": (_op("and", _op("<", _c("bal"), _l(5000)), _op("or", _op(">=", _c("id"), _l(100)), _op("<=", _c("nation"), _l(5)))), "bal < 5000 and (id >= 100 or nation <= 5)"),
    "years": (_f("years_between", _c("joined"), _f("today")), f"date_sub('year', {DATE('joined')}, date '2024-06-30')"),
    "case": (_op("!=", _f("lower", _c("segment")), _l("building")), "lower(segment) <> 'building'"),
}.items():
    one("derive_column", "cust", {"output": "x", "expression": _tree}, ["id", "x"], f"select id, {_sql} as x from cust", f"derive_column_{_name}")
one("conditional_column", "cust", {"output": "x", "rules": [{"conditions": [{"column": "bal", "op": "lt", "value": 0}], "value": "debt"}, {"conditions": [{"column": "bal", "op": "between", "value": 0, "value2": 5000}], "value": "mid"}], "default": "rich"}, ["id", "x"], "select id, case when bal < 0 then 'debt' when bal between 0 and 5000 then 'mid' else 'rich' end as x from cust")
one("map_codes", "cust", {"column": "cur", "mapping": {"EUR": "euro", "usd": "dollar"}}, ["id", "cur"], "select id, case lower(trim(cur)) when 'eur' then 'euro' when 'usd' then 'dollar' else cur end as cur from cust")
one("enrich_country", "cust", {"column": "country", "attributes": ["iso2", "iso3", "region", "currency", "dial"]}, ["id", *[f"country_{f}" for f in ("iso2", "iso3", "region", "currency", "dial")]], "select id, " + ", ".join(f"{country('country', f)} as country_{f}" for f in ("iso2", "iso3", "region", "currency", "dial")) + " from cust")
one("currency_conversion", "cust", {"amount_column": "id", "currency_column": "cur", "target": "GBP", "output": "x"}, ["id", "x"], "select id, round(id * case upper(trim(cur)) when 'EUR' then 1.08 when 'USD' then 1.0 end / 1.27, 2) as x from cust")
one("classify_ranges", "cust", {"column": "bal", "bins": [{"max": 0, "label": "neg"}, {"min": 0, "max": 1000, "label": "low"}, {"min": 1000, "max": 5000, "label": "mid"}], "output": "x"}, ["id", "x"], "select id, case when bal < 0 then 'neg' when bal < 1000 then 'low' when bal < 5000 then 'mid' end as x from cust")
# ---- quality
_CHECKS = {"email": rf"{BLANK('email')} or {GOOD}", "phone": None, "date": f"{BLANK('joined')} or {DATE('joined')} is not null", "number": f"{BLANK('amount')} or {NUM('amount')} is not null", "not_null": f"not {BLANK('name')}", "non_negative": f"{BLANK('amount')} or coalesce({NUM('amount')} >= 0, false)", "in_reference": f"country is null or {country('country', 'name')} is not null"}
for _check, (_col) in {"email": "email", "date": "joined", "number": "amount", "not_null": "name", "non_negative": "amount", "in_reference": "country"}.items():
    one("remove_invalid", "cust", {"column": _col, "check": _check}, ["id"], f"select id from cust where {_CHECKS[_check]}", f"remove_invalid_{_check}")
one("remove_invalid", "cust", {"column": "phone", "check": "phone", "action": "flag"}, ["id", "phone_is_valid"], f"select id, phone is null or ({PHONE}) is not null as phone_is_valid from cust", "remove_invalid_phone_flag")
one("clip_outliers", "cust", {"column": "bal", "factor": 0.1}, ["id", "bal"], "with q as (select quantile_cont(bal, 0.25) as a, quantile_cont(bal, 0.75) as b from cust) select id, round(least(greatest(bal, a - 0.1 * (b - a)), b + 0.1 * (b - a)), 2) as bal from cust, q")
# ---- protection
one("mask", "cust", {"columns": ["phone", "flag"]}, ["id", "phone", "flag"], "select id, " + ", ".join(f"case when length({c}) <= 4 then repeat('•', length({c})) else repeat('•', length({c}) - 4) || right({c}, 4) end as {c}" for c in ("phone", "flag")) + " from cust")
one("mask", "cust", {"columns": ["email"], "style": "email"}, ["id", "email"], "select id, case when contains(email, '@') then substr(email, 1, 1) || '•••@' || substr(email, strpos(email, '@') + 1) when length(email) <= 4 then repeat('•', length(email)) else repeat('•', length(email) - 4) || right(email, 4) end as email from cust", "mask_email")
one("mask", "cust", {"columns": ["segment"], "style": "full"}, ["id", "segment"], "select id, '••••••' as segment from cust", "mask_full")
one("hash", "cust", {"columns": ["segment"]}, ["id", "segment"], "select id, sha256('secret' || segment) as segment from cust")
_PADS = [bytes(b ^ x for b in b"secret".ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
one("tokenize", "cust", {"columns": ["segment"]}, ["id", "segment"], f"select id, 'tok_' || substr(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(segment)))), 1, 16) as segment from cust")
one("restrict", "nat", {"columns": ["nname"]}, None, "select nkey, region from nat")


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    df = run(view(spark, d, "cust"), "encrypt", {"columns": ["email"]}, context(spark, d))
    return df.select("id", decrypt(K.col("email"), b"secret").alias("email"), F.length("email").cast("long").alias("n")).select("id", "email")


add("encrypt", _round_trip, "select id, email from cust")
# ---- the 16 conditions
_CONDITIONS = {
    "equals": ({"column": "country", "op": "equals", "value": "U.K."}, "coalesce(lower(trim(country)) = 'u.k.', false)"), "not_equals": ({"column": "country", "op": "not_equals", "value": "usa"}, "coalesce(lower(trim(country)), '') <> 'usa'"),
    "gt": ({"column": "joined", "op": "gt", "value": "2010-01-01"}, f"coalesce({DATE('joined')} > date '2010-01-01', false)"), "gte": ({"column": "bal", "op": "gte", "value": 100}, "bal >= 100"), "lt": ({"column": "amount", "op": "lt", "value": "10"}, f"coalesce({NUM('amount')} < 10, false)"), "lte": ({"column": "sparse", "op": "lte", "value": 500}, "coalesce(sparse <= 500, false)"),
    "between": ({"column": "bal", "op": "between", "value": 0, "value2": 100}, "bal between 0 and 100"), "contains": ({"column": "name", "op": "contains", "value": "JEAN"}, "coalesce(contains(lower(name), 'jean'), false)"), "not_contains": ({"column": "name", "op": "not_contains", "value": "jean"}, "not coalesce(contains(lower(name), 'jean'), false)"),
    "starts_with": ({"column": "name", "op": "starts_with", "value": "Cust", "case_sensitive": True}, "coalesce(starts_with(name, 'Cust'), false)"), "ends_with": ({"column": "email", "op": "ends_with", "value": ".ORG"}, "coalesce(suffix(lower(email), '.org'), false)"), "in_list": ({"column": "segment", "op": "in_list", "value": "building, machinery"}, "lower(segment) in ('building', 'machinery')"),
    "not_in_list": ({"column": "country", "op": "not_in_list", "value": ["usa", "fr"]}, "not coalesce(lower(trim(country)) in ('usa', 'fr'), false)"), "is_null": ({"column": "amount", "op": "is_null"}, BLANK("amount")), "is_not_null": ({"column": "amount", "op": "is_not_null"}, f"not {BLANK('amount')}"), "matches": ({"column": "phone", "op": "matches", "value": r"^\+44"}, r"coalesce(regexp_matches(phone, '^\+44'), false)"),
}
for _name, (_spec, _sql) in _CONDITIONS.items():
    one("filter_rows", "cust", {"conditions": [_spec]}, ["id"], f"select id from cust where {_sql}", f"condition_{_name}")


def _flagship(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    joined = items.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ctx = context(spark, d)
    named = run(joined, "extract_date_part", {"column": "o_orderdate", "part": "year", "output": "order_year"}, ctx)
    summed = run(named, "aggregate", {"group_by": ["c_mktsegment", "order_year"], "aggregations": [{"column": "net", "fn": "sum", "alias": "revenue"}, {"fn": "count", "alias": "items"}]}, ctx)
    return run(summed.withColumn("revenue", F.round("revenue", 2)), "sort_rows", {"keys": [{"column": "c_mktsegment"}, {"column": "order_year"}]}, ctx)


add("flagship", _flagship, "select c_mktsegment, cast(year(o_orderdate) as integer) as order_year, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as items from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2")
