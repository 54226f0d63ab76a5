"""Bronze, silver and gold tables from a pipeline document, with quarantine, rule results and scores beside them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millweir.functions import kernels as K
from millweir.operators.registry import ROW_ID
from millweir.plans.pipeline import Pipeline
from millweir.plans.quality import Rule, enforce, evaluate, results, split, stamp
from millweir.session import materialize
from millweir.skew import spread_join
from millweir.sources.writers import Target, write

#: Columns that bronze adds.
INGESTED, SOURCE_FILE = "_ingested_at", "_source_file"


def bronze(df: DataFrame) -> DataFrame:
    """Rows as they came, with when and from which file."""
    name = F.col("_metadata.file_path") if "file_path" in _metadata(df) else F.lit(None).cast("string")
    return df.select("*", F.current_timestamp().alias(INGESTED), name.alias(SOURCE_FILE))


def _metadata(df: DataFrame) -> list[str]:
    try:
        return df.select("_metadata.*").columns
    except Exception:  # noqa: BLE001 - no file source
        return []


def entity_360(base: DataFrame, key: str, related: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Base rows with the number of rows of each related table by its key; 0 where there are none."""
    for name, (df, fk) in related.items():
        counts = df.groupBy(K.strip(K.col(fk)).alias("_k")).agg(F.count(F.lit(1)).alias(f"{name}_count"))
        base = spread_join(base, counts, [(K.strip(K.col(key)), F.col("_k"))], nulls_match=False).drop("_k").withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)))
    return base


def time_summary(df: DataFrame, column: str, unit: str = "month") -> DataFrame:
    day = K.as_date(K.col(column), df.schema[column].dataType)
    return df.groupBy(F.trunc(day, unit).alias("period") if unit != "day" else day.alias("period")).agg(F.count(F.lit(1)).alias("records"))


def dimension_summary(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(K.col(column)).agg(F.count(F.lit(1)).alias("records"))


@dataclass
class Tables:
    silver: dict[str, DataFrame]
    quarantine: dict[str, DataFrame]
    results: dict[str, DataFrame]
    gold: dict[str, DataFrame]
    reports: dict[str, dict]


def build(pipeline: Pipeline, folder: str | None = None, least_score: float | None = None) -> Tables:
    """All tables of a document as plans; with a folder, silver is written once there and gold reads it back.

    Rules whose action is fail stop the run before anything of their dataset is written.
    """
    doc = pipeline.document
    tables = Tables({}, {}, {}, {}, {})
    for name in doc.get("datasets", {}):
        rules = [Rule(**{k: v for k, v in r.items() if k != "dataset"}) for r in doc.get("rules", []) if r.get("dataset") == name]
        # steps run once: rules, scores, silver and quarantine read what they gave
        df = materialize(pipeline.result(name).df.drop(ROW_ID), "cleaned")
        load = lambda n: pipeline.result(n).df
        report = evaluate(df, rules, load, pipeline.today)
        enforce(report, least_score)
        stamped = stamp(df, rules, load, pipeline.today)
        loaded, quarantined, _ = split(stamped)
        if folder:
            for kind, part in (("silver", loaded), ("quarantine", quarantined)):
                write(part, Target(path=f"{folder}/{kind}/{name}", mode="overwrite"))
            loaded = df.sparkSession.read.schema(loaded.schema).parquet(f"{folder}/silver/{name}")
        tables.silver[name], tables.quarantine[name], tables.reports[name] = loaded, quarantined, report
        tables.results[name] = results(df, rules, load, pipeline.today)
    for g in doc.get("gold", []):
        base = tables.silver[g["dataset"]]
        if g["kind"] == "entity_360":
            made = entity_360(base, g["key"], {t["dataset"]: (tables.silver[t["dataset"]], t["key"]) for t in g.get("related", [])})
        elif g["kind"] == "time_summary":
            made = time_summary(base, g["column"], g.get("unit", "month"))
        else:
            made = dimension_summary(base, g.get("column") or base.columns[0])
        tables.gold[g["name"]] = made
        if folder:
            write(made, Target(path=f"{folder}/gold/{g['name']}", mode="overwrite"))
    return tables


def publish(tables: Tables, targets: list[dict]) -> None:
    """Each target gets the gold tables it names, all by default; passed_only leaves out rows that broke a rule."""
    for t in targets:
        for name in t.get("tables") or tables.gold:
            df = tables.gold[name]
            if t.get("passed_only") and "_dq_status" in df.columns:
                df = df.where("_dq_status = 'PASSED'")
            write(df, Target(path=f"{t['path']}/{name}", format=t.get("format", "parquet"), mode=t.get("mode", "append"), keys=t.get("keys", [])))


def governance_sql(catalog: str, schemas: list[str], grants: dict[str, list[str]], masks: dict[str, list[str]]) -> list[str]:
    """Statements that create schemas, grant reading and mask columns; text only, for a catalog that has them."""
    q = lambda x: "`" + x.replace("`", "``") + "`"
    made = [f"CREATE SCHEMA IF NOT EXISTS {q(catalog)}.{q(s)}" for s in schemas]
    made += [f"GRANT SELECT ON SCHEMA {q(catalog)}.{q(s)} TO {q(who)}" for s, people in grants.items() for who in people]
    return made + [f"ALTER TABLE {t} ALTER COLUMN {q(c)} SET MASK {q(catalog)}.mask_text" for t, cols in masks.items() for c in cols]
