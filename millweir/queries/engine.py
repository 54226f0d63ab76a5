"""Queries of the quality engine, profiles, pipelines, gold tables, run statistics and event-time windows, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millweir.plans import lakehouse, monitor, profiling
from millweir.plans.pipeline import Pipeline, changes
from millweir.plans.quality import Rule, dimensions, results, scores, split, stamp
from millweir.queries.base import TODAY, context, view, with_views
from millweir.queries.transforms import BLANK, DATE, EMAIL, GOOD, NUM, TRIM, country
from millweir.session import shared_folder, table
from millweir.sources.readers import read_file
from millweir.sources.writers import Target, merge_files, merged, write
from millweir.streaming.stream import apply_steps, file_stream, for_each_batch, sessions, tumbling

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return keep


RULES = [
    Rule("not_null", "name", severity="high", on_fail="quarantine", dimension="completeness", id="name"), Rule("unique", "code", dimension="uniqueness", id="code"), Rule("email", "email", on_fail="drop", id="email"), Rule("phone", "phone", id="phone"), Rule("date", "joined", id="joined"), Rule("range", "amount", {"min": 0, "max": 5000}, on_fail="quarantine", id="amount"),
    Rule("in_set", "segment", {"values": ["building", "Machinery", "automobile"]}, id="segment"), Rule("in_reference", "country", id="country"), Rule("in_dataset", "nation", {"dataset_id": "nat", "column": "nkey"}, id="nation"), Rule("regex", "code", {"pattern": "^[b ]"}, id="regex"), Rule("min_length", "flag", {"length": 2}, id="flag"),
    Rule("expression", None, {"sql": "bal > 0 or year(to_date(joined)) >= 2010"}, severity="critical", id="expr"), Rule("range", "joined", {"min": "2001-01-01", "max": "today"}, id="recent"),
]
_BARE = r"length(regexp_replace(trim(phone), '[^0-9]', '', 'g')) between 7 and 15"
_GOOD = {
    "name": f"not {BLANK('name')}", "code": "count(*) over (partition by code) = 1", "email": rf"{BLANK('email')} or regexp_matches({TRIM('email')}, '^[A-Za-z0-9._%+''-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}$')", "phone": f"phone is null or {_BARE}", "joined": f"{BLANK('joined')} or {DATE('joined')} is not null", "amount": f"coalesce({NUM('amount')} between 0 and 5000, true)",
    "segment": "lower(segment) in ('building', 'machinery', 'automobile')", "country": f"country is null or {country('country', 'name')} is not null", "nation": "nation in (select n_nationkey from nation)", "regex": f"regexp_matches({TRIM('code')}, '^[b ]')", "flag": "flag is null or length(trim(flag)) >= 2",
    "expr": f"coalesce(bal > 0 or year({DATE('joined')}) >= 2010, true)", "recent": f"coalesce({DATE('joined')} between date '2001-01-01' and date '2024-06-30', true)",
}
_MARKS = "select id, " + ", ".join(f"({g}) as r_{n}" for n, g in _GOOD.items()) + " from cust"
_ACTIONS = {r.id: r.on_fail for r in RULES}
_SEVERITY = {r.id: r.severity for r in RULES}


def _load(spark: SparkSession, d: str):  # noqa: ANN202
    return lambda name: view(spark, d, name)


@add("dq_results", "with m as (" + _MARKS + ") " + " union all ".join(f"select '{n}' as rule_id, count(*) filter (where not r_{n}) as failed, round((1 - count(*) filter (where not r_{n}) / cast(count(*) as double)) * 100, 2) as pass_rate from m" for n in _GOOD))
def dq_results(spark: SparkSession, d: str) -> DataFrame:
    return results(view(spark, d, "cust"), RULES, _load(spark, d), TODAY).select("rule_id", "failed", "pass_rate")


_RATES = "with m as (" + _MARKS + "), r as (" + " union all ".join(f"select '{n}' as rule_id, {dict(critical=4, high=3, medium=2, low=1)[_SEVERITY[n]]} as w, count(*) filter (where not r_{n}) as failed, round((1 - count(*) filter (where not r_{n}) / cast(count(*) as double)) * 100, 2) as pass_rate from m" for n in _GOOD) + ") "


@add("dq_scores", _RATES + "select round(sum(pass_rate * w) / sum(w), 1) as score, cast(sum(failed) as bigint) as issues, count(*) filter (where pass_rate >= 99) as green, count(*) filter (where pass_rate >= 95 and pass_rate < 99) as amber, count(*) filter (where pass_rate < 95) as red from r")
def dq_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores(results(view(spark, d, "cust"), RULES, _load(spark, d), TODAY))


@add("dq_dimensions", _RATES + "select case when rule_id = 'name' then 'completeness' when rule_id = 'code' then 'uniqueness' else 'validity' end as dimension, count(*) as n_rules, round(avg(pass_rate), 1) as pass_rate from r group by 1")
def dq_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return dimensions(results(view(spark, d, "cust"), RULES, _load(spark, d), TODAY))


_ISSUES = " + ".join(f"case when r_{n} then 0 else 1 end" for n in _GOOD)
_STRICT = "case when not r_email then 'drop' when not r_name or not r_amount then 'quarantine' when " + " or ".join(f"not r_{n}" for n in _GOOD if _ACTIONS[n] == "flag") + " then 'flag' end"


@add("dq_stamped", f"with m as ({_MARKS}) select id, cast({_ISSUES} as integer) as issues, {_STRICT} as action from m")
def dq_stamped(spark: SparkSession, d: str) -> DataFrame:
    return stamp(view(spark, d, "cust"), RULES, _load(spark, d), TODAY).select("id", F.size("_dq_issues").alias("issues"), F.col("_dq_action").alias("action"))


@add("dq_loaded", f"with m as ({_MARKS}) select id from m where r_email and r_name and r_amount")
def dq_loaded(spark: SparkSession, d: str) -> DataFrame:
    return split(stamp(view(spark, d, "cust"), RULES, _load(spark, d), TODAY))[0].select("id")


@add("dq_quarantined", f"with m as ({_MARKS}) select id from m where r_email and not (r_name and r_amount)")
def dq_quarantined(spark: SparkSession, d: str) -> DataFrame:
    return split(stamp(view(spark, d, "cust"), RULES, _load(spark, d), TODAY))[1].select("id")


_PROFILED = ["id", "name", "email", "phone", "country", "amount", "joined", "flag", "code", "cur", "segment", "nation", "bal", "sparse"]
_NUMBERS = ("id", "nation", "bal", "sparse")


def _profile_sql() -> str:
    def one(c: str, text: bool) -> str:
        s = TRIM(c) if text else f"cast({c} as varchar)"
        shown = f"nullif({s}, '')"
        v = f"case when {shown} is not null then {NUM(c) if text else c} end"
        return f"""select '{c}' as "column", count(*) as n_rows, count(*) - count({shown}) as null_count, count(distinct {shown}) as distinct_count, {f'max(length({shown}))' if text else 'null'} as max_length,
          round(count({v}) / nullif(cast(count({shown}) as double), 0), 4) as numeric_ratio, min({v}) as "min", max({v}) as "max", round(avg({v}), 3) as "mean", median({v}) as "median", round(stddev_samp({v}) / nullif(abs(avg({v})), 0), 6) as "std",
          quantile_cont({v}, 0.25) as p25, quantile_cont({v}, 0.75) as p75, count(*) filter (where {v} < 0) as negatives from cust"""

    return " union all ".join(one(c, c not in _NUMBERS) for c in _PROFILED)


@add("profile_columns", _profile_sql())
def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    m = profiling.measures(view(spark, d, "cust").select(*_PROFILED))
    return m.select("column", F.col("rows").alias("n_rows"), "null_count", "distinct_count", F.when(~F.col("column").isin(*_NUMBERS), F.col("max_length")).alias("max_length"), F.round("numeric_ratio", 4).alias("numeric_ratio"), "min", "max", F.round("mean", 3).alias("mean"), "median", F.round(F.try_divide("std", F.abs("mean")), 6).alias("std"), "p25", "p75", "negatives")


@add("profile_years", f"with y as (select year({DATE('joined')}) as y from cust) select 'joined' as \"column\", cast(y as integer) as \"year\", count(*) as n from y where y is not null group by 2")
def profile_years(spark: SparkSession, d: str) -> DataFrame:
    return profiling.date_years(view(spark, d, "cust").select("joined"))


@add("profile_date_formats", """with f as (select case when regexp_matches(joined, '^[0-9]{4}-') then 'yyyy-M-d' when regexp_matches(joined, '/') then 'M/d/yyyy' when regexp_matches(joined, '[.]') then 'd.M.yyyy' end as format from cust where joined is not null)
  select 'joined' as "column", format, count(*) as n from f group by 2""")
def profile_date_formats(spark: SparkSession, d: str) -> DataFrame:
    return profiling.date_formats(view(spark, d, "cust").select("joined"))


@add("profile_keys", """with m as (select 'id' as "column", 0 as place, count(*) as n, count(id) as filled, count(distinct id) as k from cust union all select 'phone', 1, count(*), count(phone), count(distinct phone) from cust union all select 'code', 2, count(*), count(code), count(distinct trim(code)) from cust)
  select "column", round(least(0.999, 0.55 * k / n + 0.2 * filled / n + 0.17 * case when "column" in ('id', 'code') then 1 else 0.4 end + 0.08 * case when place = 0 then 1 else 0.6 end), 3) as confidence, filled - k as duplicates
  from m where filled / n >= 0.95 and k / n >= case when "column" in ('id', 'code') then 0.9 else 0.995 end""")
def profile_keys(spark: SparkSession, d: str) -> DataFrame:
    measured = profiling.measures(view(spark, d, "cust").select("id", "phone", "code"))
    return profiling.key_scores(measured.withColumn("place", F.when(F.col("column") == "id", 0).when(F.col("column") == "phone", 1).otherwise(2)))


@add("profile_top_values", "with c as (select 'segment' as \"column\", segment as item, count(*) as n from cust group by 2 union all select 'country', country, count(*) from cust where country is not null group by 2) select \"column\", item, n, cast(row_number() over (partition by \"column\" order by n desc, item) as integer) as place from c qualify place <= 10")
def profile_top_values(spark: SparkSession, d: str) -> DataFrame:
    return profiling.frequent(view(spark, d, "cust").select("segment", "country"))


@add("profile_shapes", r"with c as (select regexp_replace(regexp_replace(regexp_replace(trim(phone), '[0-9]', '9', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g') as item, count(*) as n from cust where phone is not null group by 1) select 'phone' as ""column"", item, n, cast(row_number() over (order by n desc, item) as integer) as place from c qualify place <= 6".replace('""column""', '"column"'))
def profile_shapes(spark: SparkSession, d: str) -> DataFrame:
    return profiling.frequent(view(spark, d, "cust").select("phone"), "shape", 6)


@add("profile_histogram", "with b as (select min(bal) as lo, least(max(bal), quantile_cont(bal, 0.75) + 1.5 * (quantile_cont(bal, 0.75) - quantile_cont(bal, 0.25))) as hi from cust) select cast(least(11, greatest(0, floor((bal - lo) / ((hi - lo) / 12)))) as integer) as bin, count(*) as n from cust, b group by 1")
def profile_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profiling.histogram(view(spark, d, "cust"), "bal").select("bin", "n")


@add("foreign_key", "select count(distinct custkey) as distinct_values, count(distinct case when c_custkey is not null then custkey end) as matched, round(count(distinct case when c_custkey is not null then custkey end) / cast(count(distinct custkey) as double) * 100, 1) as match_pct, count(*) filter (where c_custkey is null) as orphan_rows from ord left join customer on custkey = c_custkey")
def foreign_key(spark: SparkSession, d: str) -> DataFrame:
    return profiling.containment(view(spark, d, "ord"), "custkey", view(spark, d, "cust"), "id")


@add("profile_meanings", "select * from (values ('id', 'identifier'), ('email', 'email'), ('phone', 'phone'), ('country', 'country'), ('segment', 'category'), ('bal', 'decimal'), ('code', 'identifier')) as t(\"column\", meaning)")
def profile_meanings(spark: SparkSession, d: str) -> DataFrame:
    """What the columns of a view mean; a row a column."""
    measured = profiling.measures(view(spark, d, "cust").select("id", "email", "phone", "country", "segment", "bal", "code"))
    return spark.createDataFrame([(r["column"], profiling.meaning(r.asDict())) for r in measured.collect()], "`column` string, meaning string")


@add("foreign_keys_found", "select 'ord' as from_dataset, 'custkey' as from_column, 'cust' as to_dataset, 'id' as to_column, round(count(distinct case when c_custkey is not null then custkey end) / cast(count(distinct custkey) as double) * 100, 1) as match_pct, count(*) filter (where c_custkey is null) as orphan_rows from ord left join customer on custkey = c_custkey")
def foreign_keys_found(spark: SparkSession, d: str) -> DataFrame:
    """custkey is no name of cust's key, so it is found as the parent's name with key at its end."""
    found = profiling.relationships({"cust": view(spark, d, "cust").select("id", "segment"), "ord": view(spark, d, "ord").select("okey", "custkey")}, {"cust": "id"})
    return spark.createDataFrame([tuple(r[c] for c in ("from_dataset", "from_column", "to_dataset", "to_column", "match_pct", "orphan_rows")) for r in found], "from_dataset string, from_column string, to_dataset string, to_column string, match_pct double, orphan_rows long")


_DOCUMENT = {
    "datasets": {"cust": {}, "ord": {}},
    "steps": [
        {"id": "s1", "dataset": "cust", "type": "trim_whitespace", "params": {}}, {"id": "s2", "dataset": "cust", "type": "validate_email", "params": {"column": "email"}}, {"id": "s3", "dataset": "cust", "type": "standardize_country", "params": {"column": "country", "output_format": "iso2", "unknown": "null"}},
        {"id": "s4", "dataset": "cust", "type": "drop_missing", "params": {"columns": ["email"]}}, {"id": "s5", "dataset": "cust", "type": "uppercase", "params": {"columns": ["nope"]}}, {"id": "s6", "dataset": "ord", "type": "join", "params": {"right_dataset": "cust", "left_on": ["custkey"], "right_on": ["id"], "how": "inner", "columns": ["country", "segment"]}},
        {"id": "s7", "dataset": "ord", "type": "filter_rows", "params": {"conditions": [{"column": "price", "op": "gt", "value": 1000}]}},
    ],
}
_CLEAN = f"select id, {country('country', 'iso2')} as country, segment, case when {GOOD} then {EMAIL} end as email from cust where {GOOD}"


def _pipeline(spark: SparkSession, d: str, document: dict | None = None) -> Pipeline:
    return Pipeline(document or _DOCUMENT, _load(spark, d), TODAY, b"secret", order={"cust": ["id"], "ord": ["okey"]})


@add("pipeline", f"with c as ({_CLEAN}) select country, segment, count(*) as n, round(sum(price), 2) as price from ord join c on custkey = c.id where price > 1000 group by 1, 2")
def pipeline(spark: SparkSession, d: str) -> DataFrame:
    return _pipeline(spark, d).result("ord").df.groupBy("country", "segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("price"))


@add("preview_changes", f"select 'name' as \"column\", count(*) filter (where name is distinct from {TRIM('name')}) as changed from cust union all select 'email', count(*) filter (where email is distinct from case when {GOOD} then {EMAIL} end) from cust union all select 'country', count(*) filter (where country is distinct from {country('country', 'iso2')}) from cust union all select c, n from (select 'amount' as c, count(*) filter (where amount is distinct from {TRIM('amount')}) as n from cust union all select 'flag', count(*) filter (where flag is distinct from trim(flag)) from cust union all select 'code', count(*) filter (where code is distinct from trim(code)) from cust union all select 'cur', count(*) filter (where cur is distinct from trim(cur)) from cust) where n > 0")
def preview_changes(spark: SparkSession, d: str) -> DataFrame:
    p = _pipeline(spark, d)
    return changes(view(spark, d, "cust"), p.apply(p.load("cust"), "cust", p.steps("cust")[:3]).df, "id")


@add("gold_entity_360", "select id, segment, (select count(*) from ord where custkey = id) as ord_count from cust")
def gold_entity_360(spark: SparkSession, d: str) -> DataFrame:
    return lakehouse.entity_360(view(spark, d, "cust").select("id", "segment"), "id", {"ord": (view(spark, d, "ord"), "custkey")})


@add("gold_time_summary", "select cast(date_trunc('month', odate) as date) as period, count(*) as records from ord group by 1")
def gold_time_summary(spark: SparkSession, d: str) -> DataFrame:
    return lakehouse.time_summary(view(spark, d, "ord"), "odate")


@add("gold_dimension_summary", "select segment, count(*) as records from cust group by 1")
def gold_dimension_summary(spark: SparkSession, d: str) -> DataFrame:
    return lakehouse.dimension_summary(view(spark, d, "cust"), "segment")


@add("merge_rows", "select nkey, nname from nat where nkey >= 5 union all select nkey, 'new ' || nname from nat where nkey < 5 union all select nkey + 100, nname from nat where nkey < 3")
def merge_rows(spark: SparkSession, d: str) -> DataFrame:
    nat = view(spark, d, "nat").select("nkey", "nname")
    new = nat.where("nkey < 5").select("nkey", F.concat(F.lit("new "), "nname").alias("nname")).unionByName(nat.where("nkey < 3").select((F.col("nkey") + 100).alias("nkey"), "nname"))
    return merged(nat, new, ["nkey"])


@add("merge_table", "select nkey, nname from nat where nkey >= 5 union all select nkey, 'new ' || nname from nat where nkey < 5 union all select nkey + 100, nname from nat where nkey < 3")
def merge_table(spark: SparkSession, d: str) -> DataFrame:
    """merge_rows into a folder that is replaced."""
    target = Target(f"{shared_folder(spark)}/millweir-merge-{uuid.uuid4().hex}", mode="merge", keys=["nkey"])
    nat = view(spark, d, "nat").select("nkey", "nname")
    merge_files(nat, target)
    merge_files(nat.where("nkey < 5").select("nkey", F.concat(F.lit("new "), "nname").alias("nname")).unionByName(nat.where("nkey < 3").select((F.col("nkey") + 100).alias("nkey"), "nname")), target)
    return spark.read.parquet(target.path)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """A run for each day of orders, by priority."""
    o = view(spark, d, "ord").groupBy(F.col("prio").alias("pipeline"), F.col("odate").alias("started_at")).agg(F.count(F.lit(1)).alias("records"), F.avg("price").alias("quality"), F.sum("price").alias("cost"), F.max("okey").alias("run_id"))
    return o.select("*", F.when(F.col("run_id") % 11 == 0, "failed").otherwise("succeeded").alias("status"), F.col("records").cast("double").alias("duration"), F.lit("h").alias("schema_hash"), (F.col("run_id") % 3).alias("failed"))


_RUNS = "select prio as pipeline, odate as started_at, count(*) as records, avg(price) as quality, sum(price) as cost, max(okey) as run_id, case when max(okey) % 11 = 0 then 'failed' else 'succeeded' end as status, max(okey) % 3 as failed from ord group by 1, 2"


@add("run_summary", f"with r as ({_RUNS}) select pipeline, count(*) as runs, round(avg(case when status = 'succeeded' then 100.0 else 0 end), 1) as success_rate, sum(records) as records, sum(failed) as failed, round(avg(case when status = 'succeeded' then quality end), 2) as quality, max(case when status = 'succeeded' then started_at end) as last_success from r group by 1")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return monitor.summary(_runs(spark, d))


@add("run_trends", f"with r as ({_RUNS}) select pipeline, cast(started_at as date) as \"day\", count(*) as runs, sum(records) as records, avg(floor(quality)) as quality from r group by 1, 2")
def run_trends(spark: SparkSession, d: str) -> DataFrame:
    return monitor.trends(_runs(spark, d).withColumn("quality", F.floor("quality")))


def _anomalies_sql() -> str:
    """Each measure against the 14 runs at the same hour before it (all of these runs start at midnight)."""
    unit = "1.4826 * case when mad > 0 then mad when abs(med) > 0 then abs(med) * 0.05 else 1 end"
    checks = " union all ".join(
        f"select pipeline, run_id, '{kind}' as kind, round((value - med) / ({unit}), 3) as z from z where measure = '{m}' and {sign} * (value - med) / ({unit}) > {least} and {sign} * (value - med) > {f'abs(med) * {change}' if change is not None else '3'}"
        for kind, m, least, sign, change in monitor.CHECKS
    )
    measures = " union all ".join(f"select pipeline, run_id, k, '{m}' as measure, cast({m} as double) as value from g" for m in ("records", "quality", "duration", "cost"))
    return f"""with r as ({_RUNS}), g as (select *, cast(records as double) as duration, row_number() over (partition by pipeline order by started_at, run_id) as k from r where status = 'succeeded'), v as ({measures}),
      h as (select a.pipeline, a.run_id, a.measure, a.value, b.value as past from v a join v b on a.pipeline = b.pipeline and a.measure = b.measure and b.k between a.k - case when a.k > 5 then 14 else 48 end and a.k - 1),
      m as (select pipeline, run_id, measure, value, median(past) as med, count(*) as n from h group by all), z as (select m.*, s.mad from m join (select h.pipeline, h.run_id, h.measure, median(abs(past - med)) as mad from h join m on h.pipeline = m.pipeline and h.run_id = m.run_id and h.measure = m.measure group by all) s
        on m.pipeline = s.pipeline and m.run_id = s.run_id and m.measure = s.measure where n >= 5) {checks}"""


@add("run_anomalies", _anomalies_sql())
def run_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return monitor.anomalies(_runs(spark, d)).where("kind <> 'schema'").select("pipeline", "run_id", "kind", "z")


@add("run_rule_anomalies", f"""with r as ({_RUNS}), x as (select pipeline, run_id, case when run_id % 23 = 0 then 60 else records % 17 end as failed, row_number() over (partition by pipeline order by started_at, run_id) as k from r), h as (select a.pipeline, a.run_id, a.failed, b.failed as past from x a join x b on a.pipeline = b.pipeline and b.k between a.k - 48 and a.k - 1 where a.failed > 8),
  m as (select pipeline, run_id, failed, median(past) as med, count(*) as n from h group by all), s as (select h.pipeline, h.run_id, median(abs(past - med)) as mad from h join m on h.pipeline = m.pipeline and h.run_id = m.run_id group by all)
  select m.pipeline, m.run_id, 'r1' as rule_id, cast(failed as double) as failed, med as typical, round((failed - med) / (1.4826 * case when mad > 0 then mad when abs(med) > 0 then abs(med) * 0.05 else 1 end), 3) as z
  from m join s on m.pipeline = s.pipeline and m.run_id = s.run_id where n >= 5 and failed > med * 1.5 and (failed - med) / (1.4826 * case when mad > 0 then mad when abs(med) > 0 then abs(med) * 0.05 else 1 end) > 3""")
def run_rule_anomalies(spark: SparkSession, d: str) -> DataFrame:
    results = _runs(spark, d).select("pipeline", "run_id", "started_at", F.lit("r1").alias("rule_id"), F.when(F.col("run_id") % 23 == 0, 60).otherwise(F.col("records") % 17).alias("failed"))
    return monitor.rule_anomalies(results.withColumn("rag", F.when(F.col("failed") > 8, "red").otherwise("green")))


_KEPT = "select cast(id as varchar) as id, name, code, segment, cast(bal as varchar) as bal from cust where name is not null"


def _round_trip(kind: str, **options):  # noqa: ANN202
    """A view written to the shared folder in a format and read back, all columns as text."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        path = f"{shared_folder(spark)}/millweir-{kind}-{uuid.uuid4().hex}"
        kept = view(spark, d, "cust").where("name is not null").select(F.col("id").cast("string").alias("id"), F.regexp_replace("name", "\t", " ").alias("name"), "code", "segment", F.col("bal").cast("string").alias("bal"))
        write(kept, Target(path, kind, "overwrite", options=options))
        return read_file(spark, path, format=kind, **({"tag": "r"} if kind == "xml" else {})).select("id", "name", "code", "segment", "bal")

    return query


for _kind, _options in {"csv": {}, "json": {}, "xml": {"rowTag": "r", "rootTag": "all"}, "orc": {}, "parquet": {}}.items():
    # XML readers drop outer blanks
    _shown = {c: f"trim(replace({c}, chr(9), ' '))" if _kind == "xml" else f"replace({c}, chr(9), ' ')" for c in ("name", "code")}
    add(f"io_{_kind}", _KEPT.replace("name, code", ", ".join(f"{e} as {c}" for c, e in _shown.items())))(_round_trip("jsonl" if _kind == "jsonl" else _kind, **_options))


@add("io_stream", "select upper(event_type) as event_type, count(*) as n, round(sum(value), 3) as total from events where user_id % 2 = 0 or user_id > 50 group by 1")
def io_stream(spark: SparkSession, d: str) -> DataFrame:
    """A file stream through stream-safe steps into a table of files, batch by batch."""
    schema = table(spark, d, "events").schema
    path = f"{shared_folder(spark)}/millweir-stream-{uuid.uuid4().hex}"
    stream = file_stream(spark, f"{d}/events*.parquet", schema)
    made = apply_steps(stream, [{"type": "uppercase", "params": {"columns": ["event_type"]}}], context(spark, d)).where("user_id % 2 = 0 or user_id > 50")
    for_each_batch(made.select("event_type", "value"), lambda df, n: write(df, Target(f"{path}/table")), f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/table").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@add("event_windows", "select event_type, time_bucket(interval 60 minute, ts) as window_start, time_bucket(interval 60 minute, ts) + interval 60 minute as window_end, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return tumbling(e, "ts", "60 minutes", "10 minutes", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")])


@add("event_sessions", """with e as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 2 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as fresh from events),
  s as (select *, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from e) select user_id, min(ts) as session_start, max(ts) + interval 2 hour as session_end, count(*) as n from s group by user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events"), "ts", "2 hours", "10 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")])


