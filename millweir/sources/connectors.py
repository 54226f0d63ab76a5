"""Sources behind one set of verbs: test, discover, read, schema, profile and the column that tells what is new.

A connector is made from a name and settings. Names stand for a kind (files, databases, formats of Spark connectors, web APIs) and what
it needs to know; further ones are registered with connector(). Datasets are told by name within a source.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from millweir.plans.profiling import profile
from millweir.sources.discovery import Found, discover
from millweir.sources.readers import _file, incremental_column, read_file, read_table, sniff_format
from millweir.sources.rest import read_pages

# Addresses of databases with their usual ports, schemes of storages, formats of Spark connectors.
DATABASES = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", 5432), "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306), "mariadb": ("jdbc:mariadb://{host}:{port}/{database}", 3306), "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}", 1433),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", 1521), "db2": ("jdbc:db2://{host}:{port}/{database}", 50000), "hana": ("jdbc:sap://{host}:{port}/?databaseName={database}", 30015), "teradata": ("jdbc:teradata://{host}/DATABASE={database},DBS_PORT={port}", 1025),
    "cockroachdb": ("jdbc:postgresql://{host}:{port}/{database}", 26257), "redshift": ("jdbc:redshift://{host}:{port}/{database}", 5439), "jdbc": ("{url}", 0),
}
STORAGES = {"s3": "s3a", "adls": "abfss", "blob": "wasbs", "gcs": "gs", "hdfs": "hdfs", "file": "file"}
FORMATS = {"snowflake": "snowflake", "bigquery": "bigquery", "kafka": "kafka", "kinesis": "kinesis", "pulsar": "pulsar", "mongodb": "mongodb", "cosmos": "cosmos.oltp", "cassandra": "org.apache.spark.sql.cassandra", "elasticsearch": "org.elasticsearch.spark.sql", "delta": "delta"}


class Source(ABC):
    """What every source can do. Only discover and read differ."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    @abstractmethod
    def discover(self) -> list[Found]: ...

    @abstractmethod
    def read(self, name: str, limit: int | None = None) -> DataFrame: ...

    def test(self) -> str | None:
        """None if the source answers, else what went wrong."""
        try:
            self.discover()
        except Exception as e:  # noqa: BLE001 - drivers raise errors of their own
            return str(e).splitlines()[0]
        return None

    def schema(self, name: str) -> list[dict]:
        return [{"name": f.name, "type": f.dataType.simpleString()} for f in self.read(name).schema.fields]

    def profile(self, name: str) -> dict:
        return profile(self.read(name))

    def incremental(self, name: str) -> str | None:
        return incremental_column([f["name"] for f in self.schema(name)])


class Files(Source):
    """The data files of a folder, of any storage that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str, **options) -> None:
        super().__init__(spark)
        self.folder, self.options = folder.rstrip("/"), options

    def discover(self) -> list[Found]:
        fs, at = _file(self.spark, self.folder)
        names = sorted(f.getPath().getName() for f in fs.listStatus(at))
        return [Found(n) for n in names if not n.startswith(("_", "."))]

    def read(self, name: str, limit: int | None = None) -> DataFrame:
        if name.startswith(".") or "/" in name:
            raise ValueError(f"{name!r} is no file of {self.folder}")
        known = {"format": sniff_format(name, b"")} if "." in name else {}
        return read_file(self.spark, f"{self.folder}/{name}", limit, **known | self.options)


class Database(Source):
    """The tables of a database."""

    def __init__(self, spark: SparkSession, url: str, schema: str | None = None, **options) -> None:
        super().__init__(spark)
        self.url, self.owner, self.options = url, schema, options

    def discover(self) -> list[Found]:
        return discover(self.spark, self.url, self.owner, **self.options)

    def read(self, name: str, limit: int | None = None) -> DataFrame:
        df = read_table(self.spark, self.url, f"{self.owner}.{name}" if self.owner else name, **self.options)
        return df.limit(limit) if limit else df


class Passed(Source):
    """Datasets of a Spark connector, whose option says which one; they are named by the settings."""

    def __init__(self, spark: SparkSession, format: str, datasets: list[str], option: str = "dbtable", **options) -> None:  # noqa: A002
        super().__init__(spark)
        self.format, self.datasets, self.option, self.options = format, datasets, option, options

    def discover(self) -> list[Found]:
        return [Found(n) for n in self.datasets]

    def read(self, name: str, limit: int | None = None) -> DataFrame:
        df = self.spark.read.format(self.format).options(**self.options).option(self.option, name).load()
        return df.limit(limit) if limit else df


class Api(Source):
    """The endpoints of a web API; fetch(url, params) gives a decoded document."""

    def __init__(self, spark: SparkSession, fetch: Callable[[str, dict], object], endpoints: dict[str, str], **how) -> None:
        super().__init__(spark)
        self.fetch, self.endpoints, self.how = fetch, endpoints, how

    def discover(self) -> list[Found]:
        return [Found(n) for n in self.endpoints]

    def read(self, name: str, limit: int | None = None) -> DataFrame:
        df = read_pages(self.spark, self.fetch, [self.endpoints[name]], **self.how)
        return df.limit(limit) if limit else df


@dataclass(frozen=True)
class Connector:
    name: str
    category: str
    make: Callable[..., Source] = field(repr=False)


CONNECTORS: dict[str, Connector] = {}


def connector(name: str, category: str, make: Callable[..., Source]) -> None:
    """Register a connector; make(spark, **settings) gives its source."""
    CONNECTORS[name] = Connector(name, category, make)


def _database(pattern: str, port: int) -> Callable[..., Source]:
    def make(spark: SparkSession, url: str = "", host: str = "", database: str = "", port: int = port, schema: str | None = None, **options) -> Source:
        return Database(spark, pattern.format(url=url, host=host, port=port, database=database), schema, **options)

    return make


for _name, (_pattern, _port) in DATABASES.items():
    connector(_name, "database", _database(_pattern, _port))
for _name, _scheme in STORAGES.items():
    connector(_name, "storage", lambda spark, folder, scheme=_scheme, **options: Files(spark, folder if "://" in folder else f"{scheme}://{folder}", **options))
for _name, _format in FORMATS.items():
    connector(_name, "format", lambda spark, datasets, kind=_format, **options: Passed(spark, kind, datasets, **options))
connector("api", "api", lambda spark, fetch, endpoints, **how: Api(spark, fetch, endpoints, **how))


def connect(spark: SparkSession, name: str, **settings) -> Source:
    """The source that a connector makes from its settings."""
    if name not in CONNECTORS:
        raise ValueError(f"there is no connector {name!r}")
    return CONNECTORS[name].make(spark, **settings)
