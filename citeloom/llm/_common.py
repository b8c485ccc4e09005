"""What the operators of this subpackage share: the shared folder, shipping of the code, Arrow column maps."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: ASCII white space of the contracts: space and bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_SHIPPED: set[str] = set()
_OWN_SHARED: dict[str, str] = {}
#: Batches between Spark and Python, where the session says nothing about them: small, as whole texts and sets of unknown
#: length pass, which are held several times over on both sides.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 24)}
#: While a table is written, the shuffle files of the write go when it has ended, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it from any folder; and hold the session's Arrow batches small."""
    for key, small in _BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, small)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{package}.zip")  # the driver's file server hands it out as long as the driver runs
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only in local mode (tests), where that is unset, one of this process: on a cluster no executor would see it."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN_SHARED.setdefault(app, tempfile.mkdtemp(prefix="citeloom-"))
    return f"{folder.rstrip('/')}/citeloom/{app}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: it survives lost executors and cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    kept = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if kept is None else spark.conf.set(_CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


_HELD: dict = {}


def enter(owner: str) -> None:
    """A task of owner begins in this worker process: what other operators hold here goes, so that workers that are used again don't add up."""
    if _HELD.get("owner") != owner:
        _HELD.clear()
        _HELD["owner"] = owner
        trim()


def held(key, build: Callable):
    """An object that this worker process keeps for the tasks of one owner."""
    if key not in _HELD:
        _HELD[key] = build()
    return _HELD[key]


def trim() -> None:
    """Give freed memory back to the system; a no-op where the C library can't."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text modulo modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def arrow_stream(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow by run, which leaves no memory behind in a worker that is used again."""
    ship(df.sparkSession)
    owner = run.__module__

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(task, schema)


def pieces_of(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about most bytes, so that what is made of a batch stays small whatever the session's batch size."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def arrow_map(df: DataFrame, inputs: Sequence[str], outputs: str, make: Callable[[], Callable[..., Sequence[Sequence]]], keep: Sequence[str] | None = None) -> DataFrame:
    """Append columns computed from Arrow batches.

    outputs: DDL of the new columns. make() runs once a task and gives a function of the input columns (as Python lists)
    that gives the output columns (lists or Arrow arrays). Rows and the columns of keep (default: all) pass through;
    one that has an output's name gives way to it.
    """
    added: StructType = _parse_datatype_string(outputs)
    new = {f.name.lower() for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    read = list(dict.fromkeys([*kept, *inputs]))
    df = df.select(*[F.col(f"`{c}`") for c in read])
    schema = StructType([df.schema[c] for c in kept] + list(added))
    arrow = to_arrow_schema(schema)
    owner = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)
        work = make()
        for batch in pieces_of(batches):
            made = work(*[batch.column(c).to_pylist() for c in inputs])
            columns = [batch.column(c) for c in kept]
            for field, values in zip(list(arrow)[len(kept) :], made, strict=True):
                columns.append(values if isinstance(values, pa.Array) else pa.array(values, type=field.type))
            yield pa.RecordBatch.from_arrays([c if c.type.equals(f.type) else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], names=arrow.names)

    run.__module__ = owner
    return arrow_stream(df, run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
