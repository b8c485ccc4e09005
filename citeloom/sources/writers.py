"""Writers: column lists, JSON records, strict JSON, versions instead of overwriting inputs, quantised vectors, upserts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.relational import keep_first, todo


def write_columns(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Parquet with those of columns that rows has, in order."""
    rows.select(*[c for c in columns if c in rows.columns]).write.mode("overwrite").parquet(path)


def write_records(rows: DataFrame, path: str) -> None:
    """JSON lines; null fields stay."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_strict(rows: DataFrame, path: str) -> None:
    """JSON lines of rows without NaN or infinity; raises if there is one."""
    numbers = [c for c, t in rows.dtypes if t in ("double", "float")]
    if numbers:
        odd = F.lit(False)
        for c in numbers:
            odd = odd | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        if not rows.where(odd).isEmpty():
            raise ValueError("rows hold NaN or infinity")
    write_records(rows, path)


class Versions:
    """A table as numbered folders; a new version is complete before it counts, and inputs are never overwritten."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        top = path(self.folder)
        return path, top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), top

    def latest(self) -> str | None:
        path, fs, top = self._fs()
        if not fs.exists(top):
            return None
        done = sorted(s.getPath().getName() for s in fs.listStatus(top) if fs.exists(path(s.getPath(), "_SUCCESS")))
        return f"{self.folder}/{done[-1]}" if done else None

    def read(self) -> DataFrame | None:
        at = self.latest()
        return None if at is None else self.spark.read.parquet(at)

    def write(self, rows: DataFrame) -> DataFrame:
        last = self.latest()
        n = int(last.rsplit("/v", 1)[1].split("-")[0]) + 1 if last else 0
        at = f"{self.folder}/v{n:08d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(at)
        return self.spark.read.parquet(at)


def upsert(table: Versions, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """table with new rows; of each key the first in order stays."""
    old = table.read()
    every = new if old is None else old.unionByName(new)
    return table.write(keep_first(every, keys, order))


def remaining(rows: DataFrame, table: Versions, key: str) -> DataFrame:
    """Rows whose key the table does not have yet."""
    done = table.read()
    return rows if done is None else todo(rows, done, key)


def write_once(table: Versions, rows: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table's complete version if it has one; else, or by force, a new one of rows(), which is not called otherwise."""
    done = table.read()
    return done if done is not None and not force else table.write(rows())


#: What a lookup has settled; other keys are asked again.
SETTLED = ("ok", "missing", "denied")


def unsettled(rows: DataFrame, answers: Versions, key: str) -> DataFrame:
    """Rows whose key has no settled answer (key, value, status) yet: neither a value nor a refusal."""
    done = answers.read()
    return rows if done is None else todo(rows, done.where(F.col("status").isin(*SETTLED)), key)


def quantised(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, scale and int8 vector, as a table of bytes instead of a flat file."""
    return rows.select(key, V.scale(F.col(vector)).cast("float").alias("scale"), V.to_int8(F.col(vector)).alias("q"))
