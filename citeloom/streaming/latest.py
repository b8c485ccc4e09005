"""Streams: keep the last row of a key, counts in time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.writers import Versions, upsert


def keep_last(stream: DataFrame, table: Versions, keys: Sequence[str], order: Sequence[Column], checkpoint: str) -> StreamingQuery:
    """Upsert each batch into table until all available data is read. A batch that is run again gives the same table."""
    return stream.writeStream.foreachBatch(lambda batch, _: upsert(table, batch, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(stream: DataFrame, time: str, keys: Sequence[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows of each key and window; windows close once the watermark has passed them."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n")
