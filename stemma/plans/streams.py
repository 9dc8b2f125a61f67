"""Queries that run the event table as a stream, to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.plans.registry import query
from stemma.sources.tables import new_folder
from stemma.streaming import logs as L


def event_stream(t):
    """The table as a stream source, with times that may carry a watermark; a pattern, since the source takes no single file."""
    schema = t("events").schema
    return t.spark.readStream.schema(schema).parquet(t.path("events")[:-1] + "[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@query("r11_stream_decision_metrics", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def r11(t):
    out = new_folder(t.spark, "metrics")
    n = L.run_to_end(L.stream_decision_metrics(event_stream(t), "365 days", "1 day"), out, "complete", L.overwrite_versions(f"{out}/rows"))
    return t.spark.read.parquet(f"{out}/rows/v={n}").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("r12_stream_latest_state", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def r12(t):
    out = new_folder(t.spark, "latest")
    events = event_stream(t)
    n = L.run_to_end(events, out, "append", L.upsert_latest(f"{out}/rows", "user_id", ["ts", "event_id"]))
    return L.read_latest(t.spark, f"{out}/rows", n, events.schema).select("user_id", "event_id", "event_type", "value")
