"""What a database holds: tables, columns, keys and row counts, from its JDBC metadata.

Only metadata and one count a table go through the driver; rows are read by readers.read_table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from millweir.sources.readers import incremental_column


@dataclass
class Found:
    name: str
    columns: list[dict] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    foreign_keys: list[dict] = field(default_factory=list)
    rows: int | None = None

    @property
    def incremental(self) -> str | None:
        return incremental_column([c["name"] for c in self.columns])


@contextmanager
def _connected(spark: SparkSession, url: str, options: dict):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    if "driver" in options:
        jvm.org.apache.spark.util.Utils.classForName(options["driver"], True, False)
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        if k != "driver":
            properties.setProperty(k, str(v))
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        yield connection
    finally:
        connection.close()


def _rows(result, *names: str) -> Iterator[tuple]:  # noqa: ANN001
    while result.next():
        yield tuple(result.getString(n) for n in names)
    result.close()


def discover(spark: SparkSession, url: str, schema: str | None = None, count: bool = True, **options: str) -> list[Found]:
    """Every table of a schema, or of all of the user's, by name. options: JDBC properties such as user, password and driver."""
    with _connected(spark, url, options) as connection:
        meta = connection.getMetaData()
        kinds = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        found = []
        for catalog, owner, name in sorted(_rows(meta.getTables(None, schema, "%", kinds), "TABLE_CAT", "TABLE_SCHEM", "TABLE_NAME"), key=str):
            columns = [{"name": c, "type": t, "nullable": n != "NO"} for c, t, n in _rows(meta.getColumns(catalog, owner, name, "%"), "COLUMN_NAME", "TYPE_NAME", "IS_NULLABLE")]
            key = sorted(_rows(meta.getPrimaryKeys(catalog, owner, name), "KEY_SEQ", "COLUMN_NAME"), key=lambda k: int(k[0]))
            links = [{"column": c, "table": t, "references": r} for c, t, r in _rows(meta.getImportedKeys(catalog, owner, name), "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME")]
            table = Found(name, columns, [c for _, c in key], links)
            if count:
                quote = meta.getIdentifierQuoteString().strip()
                full = ".".join(f"{quote}{part}{quote}" for part in (owner, name) if part)
                statement = connection.createStatement()
                table.rows = int(next(_rows(statement.executeQuery(f"select count(*) as n from {full}"), "N"))[0])
                statement.close()
            found.append(table)
        return found
