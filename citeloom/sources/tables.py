"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this process only in local mode, where that is unset: on a cluster no executor would see it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.setdefault(app, tempfile.mkdtemp(prefix="citeloom-tables-"))
    return f"{folder.rstrip('/')}/citeloom-tables/{app}"


def shuffle_parts(df: DataFrame, megabytes: float = 4.0) -> int:
    """Partitions for an exchange that follows df: the session's number, or more, one for each megabytes MB of the files that df is read from. A task then holds no more when the input grows."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # above: not known
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, int(size / (megabytes * 1e6))))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet and read it back, which cuts its lineage; the write's shuffle files go when it has ended."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    own = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if own is None else spark.conf.set(_CLEANUP, own)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df itself if it only picks rows and columns of files, else materialize(df, name): for tables that are read again and again."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    return df if plan.nodeName() == "LogicalRelation" else materialize(df, name)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df written in buckets of key, so that joins and groups on key, round after round, move only their other side. The catalogue keeps no entry of it."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"citeloom_{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved before the entry goes; the files stay in the application's folder
    spark.sql(f"DROP TABLE {table}")
    return out
