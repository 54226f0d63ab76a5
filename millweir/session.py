"""Session helpers: a default session, table loading, and materialising a plan in the shared folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "millweir") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", os.environ.get("MILLWEIR_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python workers, once an application, so that it need not be installed on the nodes."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="millweir-")) / "millweir.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset, a temporary one of our own, in a local session only."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: steps write what they read twice there")
        known = "file://" + tempfile.mkdtemp(prefix="millweir-")
        spark.conf.set("spark.checkpoint.dir", known)
        spark.sparkContext.setCheckpointDir(known)
    return known


#: Fixed value: Spark's name for deleting the shuffle files of a query when it ends.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Queries run inside lose their shuffle files when they end; else these stay until the driver happens to collect its garbage."""
    known = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, known) if known is not None else spark.conf.unset(SWEEP)


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    The files go when the driver's process ends, or at release(), because the caller's plan still reads them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millweir-{name}-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> int:
    """Delete what materialize has written so far, of that only what these tables read if any are given, and say how many tables it was.
    For long sessions, once their results are written, and for tables that no later plan reads: plans made before can't run any more."""
    read = {Path(f).parent.name for t in tables for f in t.inputFiles()}
    gone = [x for x in _written if not tables or Path(x[1]).name in read]
    _written[:] = [x for x in _written if x not in gone]
    for spark, path in gone:
        _remove(spark, path)
    return len(gone)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass
