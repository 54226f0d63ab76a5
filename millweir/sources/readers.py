"""Reading files and tables as raw text: detection of formats, encodings and delimiters, ragged records, archives and sheets.

Detection looks at the first bytes on the driver; reading is Spark's.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections import Counter
from functools import reduce
from pathlib import PurePosixPath
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millweir.session import shared_folder

#: Formats by ending.
ENDINGS = {"csv": "csv", "txt": "csv", "tsv": "tsv", "json": "json", "ndjson": "jsonl", "jsonl": "jsonl", "xml": "xml", "parquet": "parquet", "avro": "avro", "orc": "orc", "xlsx": "xlsx", "xlsm": "xlsx", "zip": "zip", "gz": "gz"}
#: Bytes that detection looks at.
HEAD, XML_HEAD = 2048, 4 << 20


def sniff_format(name: str, head: bytes) -> str:
    """By magic bytes first, then by the ending, then by the first letter; csv if nothing fits."""
    ending = ENDINGS.get(name.lower().rsplit(".", 1)[-1], "")
    if head.startswith(b"PAR1"):
        return "parquet"
    if head.startswith(b"Obj\x01"):
        return "avro"
    if head.startswith(b"ORC"):
        return "orc"
    if head.startswith(b"PK"):
        return "xlsx" if ending == "xlsx" else "zip"
    if head.startswith(b"\x1f\x8b"):
        return "gz"
    if ending:
        return ending
    start = head.lstrip(b"\xef\xbb\xbf \r\n\t")[:1]
    return {b"{": "json", b"[": "json", b"<": "xml"}.get(start, "csv")


def is_json_lines(head: bytes) -> bool:
    """Whether the first lines are a JSON object each; one object or list over several lines is a document."""
    lines = [x for x in head.decode("utf-8", "replace").lstrip("\ufeff").splitlines() if x.strip()]
    try:
        return len(lines) > 1 and isinstance(json.loads(lines[0]), dict) and lines[1].lstrip().startswith("{")
    except ValueError:
        return False


def sniff_encoding(head: bytes) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if head.startswith(mark):
            return name
    for cut in range(4):  # the head may end within a character
        try:
            head[: len(head) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "ISO-8859-1"


def sniff_delimiter(line: str) -> str:
    """The most frequent of comma, semicolon, tab and bar outside quotes; comma if none occurs."""
    bare = re.sub(r'"[^"]*"', "", line)
    return max(",;\t|", key=lambda d: (bare.count(d), -",;\t|".index(d))) if any(d in bare for d in ",;\t|") else ","


def _file(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a file anywhere that Spark can read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read_bytes(spark: SparkSession, path: str, most: int | None = None) -> bytes:
    """A file's first bytes, or a file of bounded size whole, on the driver."""
    fs, at = _file(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(most) if most else stream.readAllBytes())
    finally:
        stream.close()


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, or of the first file of a folder or pattern."""
    fs, at = _file(spark, path)
    found = fs.globStatus(at)
    while found:
        first = min((f for f in found if not f.getPath().getName().startswith(("_", "."))), key=lambda f: f.getPath().toString(), default=None)
        if first is None:
            return b""
        if first.isFile():
            return read_bytes(spark, first.getPath().toString(), HEAD)
        found = fs.listStatus(first.getPath())
    raise FileNotFoundError(path)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """All columns as text; lines with too many or too few fields are kept (cut or filled with nulls)."""
    head = _head(spark, path) if "sep" not in options or "encoding" not in options else b""
    encoding = options.pop("encoding", None) or sniff_encoding(head)
    first = head.decode(encoding, "replace").splitlines()[0] if head else ""
    sep = options.pop("sep", None) or ("\t" if path.endswith(".tsv") else sniff_delimiter(first))
    return spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False, mode="PERMISSIVE", multiLine=options.pop("multi_line", False), escape='"', **options)


def read_json(spark: SparkSession, path: str, lines: bool = False, entity: str | None = None) -> DataFrame:
    """Leaves as text; ragged records are merged by Spark's schema. entity: the list of objects within one object that holds the records."""
    df = spark.read.json(path, multiLine=not lines, primitivesAsString=True)
    if entity:
        df = df.select(F.explode_outer(F.col(entity)).alias("_r")).select("_r.*")
    return df


def json_entities(df: DataFrame) -> list[str]:
    """The lists of objects at the top of a JSON document."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]


def xml_record_tag(spark: SparkSession, path: str) -> str:
    """The tag that occurs most often right below the root, in the first megabytes."""
    counts: Counter[str] = Counter()
    depth, parser = 0, ElementTree.XMLPullParser(("start", "end"))
    parser.feed(read_bytes(spark, path, XML_HEAD))
    for event, node in parser.read_events():
        depth += 1 if event == "start" else -1
        if event == "start" and depth == 2:
            counts[node.tag.rsplit("}", 1)[-1]] += 1
    if not counts:
        raise ValueError(f"{path} has no elements below its root")
    return counts.most_common(1)[0][0]


def read_xml(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """Attributes and elements as text columns; the text of an element with attributes is its value."""
    return spark.read.format("xml").option("rowTag", tag or xml_record_tag(spark, path)).option("attributePrefix", "").option("valueTag", "value").option("inferSchema", "false").load(path)


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of a workbook as text: the first row names the columns (repeated names get a number), blank rows are left out.

    A workbook is a zip of XML of bounded size, so it is read on the driver.
    """
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
    with zipfile.ZipFile(io.BytesIO(read_bytes(spark, path))) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): links[s.get(f"{{{ns['r']}}}id")] for s in book.iter(f"{{{ns['m']}}}sheet")}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        target = sheets[sheet] if sheet else next(iter(sheets.values()))
        body = ElementTree.fromstring(z.read("xl/" + target.removeprefix("/xl/")))
    rows = []
    for row in body.iter(f"{{{ns['m']}}}row"):
        cells: dict[int, str | None] = {}
        for c in row.findall("m:c", ns):
            letters = re.match(r"[A-Z]+", c.get("r", "A1"))[0]
            at = 0
            for letter in letters:
                at = at * 26 + ord(letter) - 64
            value = c.find("m:v", ns)
            inline = c.find("m:is", ns)
            text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else value.text if value is not None else None
            cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        if any((v or "").strip() for v in cells.values()):
            rows.append(cells)
    if not rows:
        return spark.createDataFrame([], T.StructType([]))
    width = max(max(r) for r in rows) + 1
    names, seen = [], Counter()
    for i in range(width):
        name = (rows[0].get(i) or f"column_{i + 1}").strip()
        seen[name] += 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return spark.createDataFrame([tuple(r.get(i) for i in range(width)) for r in rows[1:]], T.StructType([T.StructField(n, T.StringType()) for n in names]))


def unzip(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Data files of an archive put in a folder that the executors share; members that would leave it are refused. Bytes stream through
    Spark's file systems, so that neither side need be local."""
    jvm = spark.sparkContext._jvm
    (fs, at), (out_fs, root) = _file(spark, path), _file(spark, folder)
    made, archive = [], jvm.java.util.zip.ZipInputStream(fs.open(at))
    try:
        while (entry := archive.getNextEntry()) is not None:
            name = PurePosixPath(entry.getName().replace("\\", "/"))
            if name.is_absolute() or ".." in name.parts:
                raise ValueError(f"the archive's member {str(name)!r} leaves the folder")
            if not entry.isDirectory() and name.suffix[1:].lower() in ENDINGS:
                target = jvm.org.apache.hadoop.fs.Path(root, str(name))
                sink = out_fs.create(target, True)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(archive, sink, 1 << 20, False)
                sink.close()
                made.append(target.toString())
    finally:
        archive.close()
    return made


def _members(spark: SparkSession, path: str, member: str | None, options: dict) -> DataFrame:
    """The data files of an archive, by column name; a column that a file lacks is null there."""
    files = [f for f in unzip(spark, path, f"{shared_folder(spark)}/millweir-zip-{uuid.uuid4().hex}") if member is None or f.endswith("/" + member)]
    if not files:
        raise ValueError(f"{path} holds no data file{f' {member!r}' if member else ''}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_file(spark, f, **options) for f in files])


def read_file(spark: SparkSession, path: str, limit: int | None = None, **options) -> DataFrame:
    """Any supported file by its format, archives member by member; limit: at most so many rows."""
    kind = options.pop("format", None) or sniff_format(path, _head(spark, path))
    if kind == "gz":
        kind = ENDINGS.get(path.lower().removesuffix(".gz").rsplit(".", 1)[-1], "csv")
        options |= {"sep": options.get("sep", "\t" if kind == "tsv" else ","), "encoding": options.get("encoding", "UTF-8")} if kind in ("csv", "tsv") else {}
    if kind in ("csv", "tsv"):
        df = read_csv(spark, path, **({"sep": "\t"} if kind == "tsv" else {}) | options)
    elif kind in ("json", "jsonl"):
        df = read_json(spark, path, lines=kind == "jsonl" or is_json_lines(_head(spark, path)), entity=options.get("entity"))
    elif kind == "xml":
        df = read_xml(spark, path, options.get("tag"))
    elif kind == "xlsx":
        df = read_sheet(spark, path, options.get("sheet"))
    elif kind in ("parquet", "orc", "avro"):
        df = spark.read.format(kind).load(path)
    elif kind == "zip":
        df = _members(spark, path, options.pop("member", None), options)
    else:
        raise ValueError(f"there is no reader for the format {kind}")
    return df.limit(limit) if limit else df


def read_table(spark: SparkSession, url: str, name: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options) -> DataFrame:
    """A database table through JDBC, all columns as text; split by ranges of a numeric column where one is named."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    df = reader.load()
    return df.select(*[F.col(c).cast("string") for c in df.columns])


#: Names of columns that tell when a row changed, best first.
INCREMENTAL = ["updated_at", "modified_at", "last_modified", "lastmodifieddate", "systemmodstamp", "sys_updated_on", "changed_on", "created_at"]


def incremental_column(columns: list[str]) -> str | None:
    lower = {c.lower(): c for c in columns}
    return next((lower[n] for n in INCREMENTAL if n in lower), None)


def since(df: DataFrame, column: str, high_water: object) -> DataFrame:
    """Rows after the last load's high-water mark; all rows if there is none."""
    return df if high_water is None else df.where(F.col(column) > F.lit(high_water))


