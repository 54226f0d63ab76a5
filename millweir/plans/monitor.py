"""Statistics of runs: robust z-scores against a run's own history, anomalies of runs and rules, summaries and daily trends.

Runs are rows (pipeline, run_id, started_at, status, records, quality, duration, cost, schema_hash, failed). A pipeline's windows hold its
own last HISTORY runs, or the last SAME_HOUR at its hour of day where there are enough, so their size does not grow with the number of runs or pipelines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY, SAME_HOUR, LEAST = 48, 14, 5


def typical(rows: DataFrame, keys: list[str], past: str) -> DataFrame:
    """rows' keys with the median of an array column and the median distance from it, by two groupings of its elements."""
    long = rows.select(*keys, F.explode(past).alias("_x"))
    middle = long.groupBy(*keys).agg(F.median("_x").alias("typical"), F.count(F.lit(1)).alias("known"), F.collect_list("_x").alias("_all"))
    away = middle.select(*keys, "typical", "known", F.explode("_all").alias("_x"))
    return away.groupBy(*keys, "typical", "known").agg(F.median(F.abs(F.col("_x") - F.col("typical"))).alias("spread"))


def robust_z(value: Column, middle: Column, spread: Column) -> Column:
    """Distance from the median in robust standard deviations; without spread, 5 % of the median counts as one, else 1."""
    unit = F.when(spread > 0, spread).when(F.abs(middle) > 0, F.abs(middle) * 0.05).otherwise(1.0)
    return (value - middle) / (1.4826 * unit)


#: (kind, measure, least z, direction, relative or absolute change)
CHECKS = [("volume_drop", "records", 3.0, -1, 0.2), ("volume_rise", "records", 3.0, 1, 0.2), ("quality", "quality", 3.0, -1, None), ("duration", "duration", 3.5, 1, 0.6), ("cost", "cost", 4.0, 1, 0.8)]


def _past(measure: str) -> Column:
    """The values of a measure in the runs that a run is compared with: volumes follow a daily rhythm."""
    order, value = ("started_at", "run_id"), F.col(measure).cast("double")
    before = F.collect_list(value).over(Window.partitionBy("pipeline").orderBy(*order).rowsBetween(-HISTORY, -1))
    same_hour = F.collect_list(value).over(Window.partitionBy("pipeline", F.hour("started_at")).orderBy(*order).rowsBetween(-SAME_HOUR, -1))
    return F.when(F.size(same_hour) >= LEAST, same_hour).otherwise(before)


def rule_anomalies(results: DataFrame) -> DataFrame:
    """(pipeline, run_id, rule_id, failed, typical, z) of each red rule that fails far more rows than in the runs before.

    results: a row a run and rule: pipeline, run_id, started_at, rule_id, failed, rag.
    """
    past = Window.partitionBy("pipeline", "rule_id").orderBy("started_at", "run_id").rowsBetween(-HISTORY, -1)
    value = F.col("failed").cast("double")
    red = results.select("pipeline", "run_id", "rule_id", "rag", value.alias("failed"), F.collect_list(value).over(past).alias("past")).where((F.col("rag") == "red") & (F.size("past") >= LEAST))
    seen = typical(red, ["pipeline", "run_id", "rule_id", "failed"], "past")
    z = robust_z(F.col("failed"), F.col("typical"), F.col("spread"))
    return seen.where((z > 3.0) & (F.col("failed") > F.col("typical") * 1.5)).select("pipeline", "run_id", "rule_id", "failed", "typical", F.round(z, 3).alias("z"))


def anomalies(runs: DataFrame) -> DataFrame:
    """(pipeline, run_id, kind, value, typical, z) of each succeeded run that departs from the succeeded runs before it, and schema changes."""
    good = runs.where("status = 'succeeded'")
    wide = good.select("pipeline", "run_id", *[F.struct(F.col(m).cast("double").alias("value"), _past(m).alias("past")).alias(m) for m in ("records", "quality", "duration", "cost")])
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}.value").alias("value"), F.col(f"{m}.past").alias("past")) for m in ("records", "quality", "duration", "cost")])
    long = wide.select("pipeline", "run_id", F.inline(each)).where(F.size("past") >= LEAST)
    seen = typical(long, ["pipeline", "run_id", "measure", "value"], "past")
    z = robust_z(F.col("value"), F.col("typical"), F.col("spread"))
    rows = []
    for kind, m, least, sign, change in CHECKS:
        moved = (F.col("value") - F.col("typical")) * sign > (F.abs("typical") * change if change is not None else F.lit(3.0))
        rows.append(F.when((F.col("measure") == m) & (z * sign > least) & moved, F.lit(kind)))
    found = seen.withColumn("kind", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull()))).select("pipeline", "run_id", "kind", "value", "typical", F.round(z, 3).alias("z"))
    order = Window.partitionBy("pipeline").orderBy("started_at", "run_id")
    schema = runs.withColumn("before", F.lag("schema_hash").over(order)).where("before is not null and before <> schema_hash")
    none = F.lit(None).cast("double")
    return found.unionByName(schema.select("pipeline", "run_id", F.lit("schema").alias("kind"), none.alias("value"), none.alias("typical"), none.alias("z")))


def stale(runs: DataFrame, now: Column, hours: float) -> DataFrame:
    """Pipelines whose last success is more than 2.5 intervals old."""
    last = runs.groupBy("pipeline").agg(F.max(F.when(F.col("status") == "succeeded", F.col("started_at"))).alias("last_success"))
    return last.where(F.col("last_success").isNull() | (F.timestamp_diff("SECOND", F.col("last_success"), now) > hours * 2.5 * 3600))


def summary(runs: DataFrame) -> DataFrame:
    """Per pipeline: runs, success rate in per cent, records, failed records, mean quality and last success."""
    good = F.col("status") == "succeeded"
    return runs.groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg(good.cast("double")) * 100, 1).alias("success_rate"), F.sum("records").alias("records"), F.sum("failed").alias("failed"), F.round(F.avg(F.when(good, F.col("quality"))), 2).alias("quality"), F.max(F.when(good, F.col("started_at"))).alias("last_success")
    )


def trends(runs: DataFrame) -> DataFrame:
    """Per pipeline and day: runs, records and mean quality."""
    return runs.groupBy("pipeline", F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("runs"), F.sum("records").alias("records"), F.round(F.avg("quality"), 2).alias("quality"))
