"""Paged web APIs as Spark data: page, offset, cursor and link pagination, and GraphQL.

fetch(url, params) returns a decoded JSON document; it is given by the caller, so that this works with any client and in tests.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from millweir.session import shared_folder


class MorePages(RuntimeError):
    """An endpoint has more pages than the caller allows; what was read so far isn't whole."""


def _at(document: object, path: str | None) -> object:
    for part in (path or "").split("."):
        if part:
            document = document.get(part) if isinstance(document, dict) else None
    return document


def pages(fetch: Callable[[str, dict], dict], url: str, style: str = "none", items: str | None = None, size: int = 50, most: int | None = None, cursor: str = "next_cursor", params: dict | None = None) -> Iterator[dict]:
    """The records of all pages; if there are more than most of them, that is an error. style: none, page, offset, cursor or link; items: the path of the record list."""
    at, query = url, dict(params or {})
    for n in itertools.count():
        if most is not None and n == most:
            raise MorePages(f"{url} has more than {most} pages")
        if style == "page":
            query |= {"page": n + 1, "per_page": size}
        elif style == "offset":
            query |= {"offset": n * size, "limit": size}
        document = fetch(at, query)
        records = document if isinstance(document, list) else _at(document, items)
        records = records if isinstance(records, list) else [records] if isinstance(records, dict) else []
        yield from (r for r in records if isinstance(r, dict))
        following = _at(document, cursor) if isinstance(document, dict) else None
        if style == "cursor" and following:
            query |= {"cursor": following}
        elif style == "link" and following:
            at, query = following, {}
        elif style in ("page", "offset") and len(records) == size:
            continue
        else:
            return


def read_pages(spark: SparkSession, fetch: Callable[[str, dict], dict], urls: list[str], **how) -> DataFrame:
    """A row for each record of each endpoint, leaves as text; endpoints are read in parallel by the executors.

    Each page is fetched once: records are written to the shared folder as they come, and their schema is read from there.
    """

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            for url in batch.column(0).to_pylist():
                chunk: list[str] = []
                for r in pages(fetch, url, **how):
                    chunk.append(json.dumps(r))
                    if len(chunk) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(chunk)], ["value"])
                        chunk = []
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.string())], ["value"])

    raw = spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, len(urls))).mapInArrow(run, "value string")
    kept = f"{shared_folder(spark)}/millweir-pages-{uuid.uuid4().hex}"
    raw.write.text(kept)
    return spark.read.json(kept, primitivesAsString=True)


def graphql(fetch: Callable[[str, dict], dict], url: str, query: str, items: str) -> Iterator[dict]:
    """The records of a GraphQL query at a path of its data."""
    yield from pages(fetch, url, items=f"data.{items}", params={"query": query})
