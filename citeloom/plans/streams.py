"""Queries of streams, run to the end of the available data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from ..sources.writers import Versions
from ..streaming.latest import keep_last, window_counts
from .base import query, table


def _events(spark, d):
    """The events file as a stream."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("stream_keep_last", "WITH r AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE r = 1")
def stream_keep_last(spark, d):
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = Versions(spark, f"{at}/table")
    keep_last(_events(spark, d), out, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], f"{at}/checkpoint").awaitTermination()
    return out.read().select("user_id", "event_type", "event_id", "value")


@query("stream_window_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    counts = window_counts(_events(spark, d), "ts", ["event_type"])
    name = f"counts_{uuid.uuid4().hex}"
    counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
