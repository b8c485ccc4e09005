"""Readers: JSON lines, nested documents, markup, configuration tables, remote pages and lookups."""

from __future__ import annotations

import asyncio
import json
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

AUTHOR = "struct<id:string,name:string,orcid:string,position:string,institutions:array<string>>"
CONCEPT = "struct<name:string,level:int,score:double>"
RECORD = f"openalex_id string, ieee_id string, doi string, title string, year int, date string, venue_slug string, type string, cited_by_count bigint, abstract string, authors array<{AUTHOR}>, concepts array<{CONCEPT}>"


def json_lines(spark: SparkSession, paths: Sequence[str], schema: str = RECORD, source: str | None = None) -> DataFrame:
    """Records of one JSON object a line; lines that don't parse are dropped, and paths that match no file give no rows. With source, a column _source."""
    found = [p for p in paths if _exists(spark, p)]
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(found) if found else spark.createDataFrame([], schema)
    return rows.withColumn("_source", F.lit(source)) if source else rows


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    hits = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return hits is not None and len(hits) > 0


def union_sources(frames: Sequence[DataFrame], drop: Column | None = None) -> DataFrame:
    """All sources by column name, without the rows that meet drop."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.where(~drop) if drop is not None else out


def document_rows(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The elements of an array field of JSON documents. schema: of the whole document."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(field).alias("_e")).select("_e.*")


def config_rows(spark: SparkSession, entries: Sequence[dict], schema: str, enabled: str = "enabled") -> DataFrame:
    """Configuration entries; those switched off go, and a missing switch counts as on."""
    return spark.createDataFrame([{k: v for k, v in e.items() if k != enabled} for e in entries if e.get(enabled, True)], schema)


def load_config(path: str) -> list[dict]:
    """Entries of a JSON file, or of a YAML file where a YAML library is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def full_text(xml: Column, section: str = "section", heading: str = "section-title", paragraph: str = "para", keyword: str = "keyword") -> Column:
    """sections (heading, text), plaintext and keywords of an article in XML. If no section has text, the text is all paragraphs. Tags may carry a namespace prefix."""

    def strip(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))

    def every(x: Column, tag: str) -> Column:
        return F.regexp_extract_all(x, F.lit(rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>"), 1)

    def texts(x: Column, tag: str) -> Column:
        return F.filter(F.transform(every(x, tag), strip), lambda t: t != "")

    sections = F.transform(every(xml, section), lambda s: F.struct(F.coalesce(F.get(texts(s, heading), F.lit(0)), F.lit("")).alias("heading"), F.concat_ws("\n", texts(s, paragraph)).alias("text")))
    sections = F.filter(sections, lambda s: s["text"] != "")
    plain = F.when(F.size(sections) > 0, F.concat_ws("\n\n", F.transform(sections, lambda s: s["text"]))).otherwise(F.concat_ws("\n", texts(xml, paragraph)))
    return F.struct(sections.alias("sections"), plain.alias("plaintext"), texts(xml, keyword).alias("keywords"))


def keys_since(rows: DataFrame, key: str, year: str, least: int) -> DataFrame:
    """Distinct known keys of rows of year least or later; a null year counts as 0."""
    return rows.where(F.col(key).isNotNull() & (F.coalesce(F.col(year), F.lit(0)) >= least)).select(key).distinct()


def point_rows(rows: DataFrame, key: str, wanted: Sequence) -> DataFrame:
    """Rows of given keys, by a filter that reaches the scan."""
    return rows.where(F.col(key).isin(list(wanted)))


class Pace:
    """Calls at least 1 / rate seconds apart in one process, from all its threads."""

    def __init__(self, rate: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep, self.next, self.lock = 1.0 / rate, clock, sleep, None, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            at = now if self.next is None else max(now, self.next)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)


class AsyncPace:
    """The same for the tasks of one event loop."""

    def __init__(self, rate: float):
        self.gap, self.next = 1.0 / rate, None

    async def wait(self) -> None:
        now = asyncio.get_running_loop().time()
        at = now if self.next is None else max(now, self.next)
        self.next = at + self.gap
        if at > now:
            await asyncio.sleep(at - now)


class Busy(Exception):
    """A server asks to come back later; after: seconds, if it says."""

    def __init__(self, after: float | None = None):
        super().__init__(after)
        self.after = after


class Missing(Exception):
    """A server has nothing under this key (404)."""


class Denied(Exception):
    """A server does not give this key's value out (401, 403)."""


def with_retries(call: Callable[[], object], attempts: int = 5, first: float = 2.0, most: float = 60.0, patience: float = 120.0, sleep=time.sleep):
    """call(), again after a growing pause when it is busy or fails; a stated pause is kept up to patience."""
    for i in range(attempts):
        try:
            return call()
        except (Busy, OSError) as e:
            if i + 1 == attempts:
                raise
            after = getattr(e, "after", None)
            sleep(min(after, patience) if after is not None else min(most, first * 2**i))


def _source(source: str, schema: StructType, pages: Callable[[dict, Pace], Iterator[Sequence[tuple]]], queries: Sequence[dict], rate: float) -> type[DataSource]:
    """A data source with a partition for each query, whose rows pages gives; all partitions together keep to rate, whatever runs at once."""
    queries = list(queries)

    class Part(InputPartition):
        def __init__(self, query: dict):
            self.query = query

    class Reader(DataSourceReader):
        def partitions(self):
            return [Part(q) for q in queries]

        def read(self, part) -> Iterator[tuple]:
            for rows in pages(part.query, Pace(rate / max(1, len(queries)))):
                yield from rows

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Paged


def paged_source(name: str, schema: StructType, fetch: Callable[[dict, int], Sequence[tuple]], queries: Sequence[dict], rate: float = 8.0, most_pages: int | None = None) -> type[DataSource]:
    """Pages by number until an empty one: fetch(query, page) gives rows. Register the class and read format(name)."""

    def pages(query: dict, pace: Pace) -> Iterator[Sequence[tuple]]:
        page = 0
        while most_pages is None or page < most_pages:
            pace.wait()
            rows = with_retries(lambda: fetch(query, page))
            if not rows:
                return
            yield rows
            page += 1

    return _source(name, schema, pages, queries, rate)


def cursor_source(name: str, schema: StructType, fetch: Callable[[dict, str, list[str]], tuple[Sequence[tuple], str | None]], queries: Sequence[dict], rate: float = 8.0, first: str = "*") -> type[DataSource]:
    """Pages by cursor: fetch(query, cursor, columns) gives rows and the next cursor, or none at the end. columns are those of schema, for the server to select; a query's own entries are for it to filter by."""
    columns = schema.fieldNames()

    def pages(query: dict, pace: Pace) -> Iterator[Sequence[tuple]]:
        cursor: str | None = first
        while cursor:
            pace.wait()
            rows, cursor = with_retries(lambda at=cursor: fetch(query, at, columns))
            if not rows:
                return
            yield rows

    return _source(name, schema, pages, queries, rate)


def offset_source(name: str, schema: StructType, fetch: Callable[[dict, int, int], tuple[Sequence[tuple], int | None]], queries: Sequence[dict], rate: float = 5.0, size: int = 200, cap: int | None = None) -> type[DataSource]:
    """Pages by offset: fetch(query, offset, size) gives rows and the total, if known. Ends with an empty page, at the total, or after cap rows of a query."""

    def pages(query: dict, pace: Pace) -> Iterator[Sequence[tuple]]:
        got, total = 0, None
        while (total is None or got < total) and (cap is None or got < cap):
            pace.wait()
            want = size if cap is None else min(size, cap - got)
            rows, total = with_retries(lambda at=got, n=want: fetch(query, at, n))
            if not rows:
                return
            yield rows[:want]
            got += len(rows)

    return _source(name, schema, pages, queries, rate)


def looked_up(keys: DataFrame, key: str, fetch: Callable[[str], object], result: str, rate: float = 9.5, tasks: int = 4, in_flight: int = 3) -> DataFrame:
    """keys with value, what fetch gives for each, and status: ok, missing (fetch raised Missing), denied (Denied) or failed (after the retries).

    tasks of them look up at once, each with in_flight calls at a time, and share rate; so the service sees no more than rate
    calls a second, however large the cluster.
    """
    kind = keys.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(rate / tasks)

        def paced(k):
            pace.wait()
            return fetch(k)

        def one(k):
            try:
                return with_retries(lambda: paced(k), attempts=3), "ok"
            except Missing:
                return None, "missing"
            except Denied:
                return None, "denied"
            except (Busy, OSError):
                return None, "failed"

        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                got = list(pool.map(one, b[key]))
                yield pd.DataFrame({key: b[key], "value": pd.Series([v for v, _ in got], dtype=object), "status": [s for _, s in got]})

    return keys.select(key).repartition(tasks).mapInPandas(run, f"{key} {kind}, value {result}, status string")


def first_answer(numbers: Sequence[str], fetch: Callable[[str], str | None], pace: Pace) -> str | None:
    """What fetch gives for the first of a source's numbers that it knows."""
    for n in numbers:
        pace.wait()
        try:
            found = with_retries(lambda n=n: fetch(n))
        except Missing:
            continue
        if found is not None:
            return found
    return None
