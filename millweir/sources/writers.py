"""Writing tables: append, overwrite and merge into files, JDBC with staged merges, and connector formats passed through."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millweir.functions import kernels as K

#: Connector formats by the name of a target.
FORMATS = {"snowflake": "snowflake", "bigquery": "bigquery", "kafka": "kafka", "mongodb": "mongodb", "cosmos": "cosmos.oltp", "elasticsearch": "org.elasticsearch.spark.sql", "cassandra": "org.apache.spark.sql.cassandra", "delta": "delta"}


@dataclass
class Target:
    path: str
    format: str = "parquet"
    mode: str = "append"
    keys: list[str] = field(default_factory=list)
    partition_by: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)


def write(df: DataFrame, target: Target) -> None:
    """Write df; merge replaces rows of equal keys. Lists become text in CSV; Kafka gets each row as one JSON value."""
    if target.mode == "merge" and target.format in ("parquet", "orc"):
        merge_files(df, target)
        return
    if target.format == "csv":
        df = df.select(*[F.array_join(K.col(c).cast("array<string>"), "; ").alias(c) if t.startswith("array") else K.col(c) for c, t in df.dtypes])
    if target.format == "kafka":
        df = df.select(F.to_json(F.struct("*")).alias("value"))
    writer = df.write.format(FORMATS.get(target.format, target.format)).mode("append" if target.mode == "merge" else target.mode).options(**target.options)
    if target.format == "csv":
        # as read_csv reads it: outer blanks stay, and a quote within quotes is doubled
        writer = writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if target.partition_by:
        writer = writer.partitionBy(*target.partition_by)
    writer.save(target.path)


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and rows of old whose key new doesn't have. Null keys match null keys; of equal new keys any one row remains."""
    fresh = new.dropDuplicates(keys)
    there = fresh.select(*[K.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    kept = old.join(there, K.all_of([K.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def merge_files(df: DataFrame, target: Target) -> None:
    """An upsert into a folder: the merged table is written beside it and put in its place by two renames.

    A reader that comes between the renames finds no table, but never a part of one; if the second fails, the first is undone. Where
    readers may come at any time, use a table format with transactions.
    """
    spark = df.sparkSession
    if not target.keys:
        raise ValueError("a merge needs keys")
    jvm = spark.sparkContext._jvm
    here = jvm.org.apache.hadoop.fs.Path(target.path)
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new = df.dropDuplicates(target.keys)
    if fs.exists(here):
        new = merged(spark.read.format(target.format).load(target.path), df, target.keys)
    beside, old = (jvm.org.apache.hadoop.fs.Path(f"{target.path}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    writer = new.write.format(target.format)
    if target.partition_by:
        writer = writer.partitionBy(*target.partition_by)
    writer.save(beside.toString())
    if fs.exists(here):
        fs.rename(here, old)
    if not fs.rename(beside, here):
        fs.rename(old, here)
        raise OSError(f"{target.path} could not be replaced")
    if fs.exists(old):
        fs.delete(old, True)


def _quoted(name: str, dialect: str) -> str:
    left, right = {"mysql": ("`", "`"), "mariadb": ("`", "`"), "sqlserver": ("[", "]"), "synapse": ("[", "]")}.get(dialect, ('"', '"'))
    return left + name.replace(right, right * 2) + right


def merge_sql(dialect: str, table: str, staging: str, columns: list[str], keys: list[str]) -> str:
    """The statement that merges a staging table into a table, in the database's dialect."""
    q = lambda c: _quoted(c, dialect)
    names, rest = ", ".join(map(q, columns)), [c for c in columns if c not in keys]
    if dialect in ("mysql", "mariadb"):
        sets = ", ".join(f"{q(c)} = VALUES({q(c)})" for c in rest or keys[:1])
        return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging} ON DUPLICATE KEY UPDATE {sets}"
    if dialect in ("postgresql", "redshift_pg", "sqlite", "cockroachdb"):
        action = "DO UPDATE SET " + ", ".join(f"{q(c)} = EXCLUDED.{q(c)}" for c in rest) if rest else "DO NOTHING"
        return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging} WHERE true ON CONFLICT ({', '.join(map(q, keys))}) {action}"
    if dialect == "hana":
        return f"UPSERT {table} ({names}) SELECT {names} FROM {staging}"
    on = " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in keys)
    alias = "" if dialect == "oracle" else "AS "
    update = " WHEN MATCHED THEN UPDATE SET " + ", ".join(f"t.{q(c)} = s.{q(c)}" for c in rest) if rest else ""
    end = ";" if dialect in ("sqlserver", "synapse") else ""
    return f"MERGE INTO {table} {alias}t USING {staging} {alias}s ON {on}{update} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join('s.' + q(c) for c in columns)}){end}"


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def post_batches(df: DataFrame, send, size: int = 500) -> None:  # noqa: ANN001
    """Rows as JSON objects in batches to send(list), called on the executors."""
    import json

    def run(rows) -> None:  # noqa: ANN001
        batch = []
        for r in rows:
            batch.append(json.loads(r.value))
            if len(batch) == size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    df.select(F.to_json(F.struct("*")).alias("value")).foreachPartition(run)
