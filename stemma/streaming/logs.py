"""Decision logs as streams, each with the batch form it agrees with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def event_windows(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per window and event type; for batches and streams alike."""
    w = F.window("ts", size, slide or size)
    out = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Per user runs of events that are less than ``gap`` apart."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_decision_metrics(log: DataFrame, delay: str, size: str) -> DataFrame:
    """Counts per action and window of a stream (event_id, ts, event_type, value); repeated ids count once."""
    return event_windows(log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]), size)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert_latest(table: str, key: str, order: list[str], ttl: str | None = None, buckets: int = 64):
    """For ``foreachBatch``: keep the latest row of every key in a folder, in buckets by hash of the key.

    Batch n rewrites only the buckets that it meets, as ``table/v=n/bucket=b``; ``table/state/v=n`` names the
    version of every bucket and the newest time seen. A batch reads the state before its own number and
    replaces what it wrote before, so one that runs twice gives the same result; what only older states
    name is dropped. With ``ttl`` rows older than that before the newest row do not count: they go when
    their bucket is rewritten, and ``read_latest`` leaves them out until then."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")
        batch = batch.persist()
        known, newest = _state(spark, table, batch_id - 1)
        seen = batch.select(bucket, "ts" if ttl else F.lit(None).alias("ts")).groupBy("bucket").agg(F.max("ts").alias("ts")).collect()  # one row a bucket
        newest = max((x for x in [newest, *(r.ts for r in seen)] if x is not None), default=None)
        paths = [f"{table}/v={known[r.bucket]}/bucket={r.bucket}" for r in seen if r.bucket in known]
        if seen:
            rows = spark.read.schema(batch.schema).parquet(*paths).unionByName(batch) if paths else batch
            rows = _alive(latest(rows, key, order), newest, ttl)
            rows.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v={batch_id}")
        state = {**known, **{r.bucket: batch_id for r in seen}}
        # buckets of which no row is left have no folder
        at = {b: v for b, v in state.items() if v != batch_id or _exists(spark, f"{table}/v={v}/bucket={b}")}
        spark.createDataFrame([(b, v, newest) for b, v in at.items()] + [(-1, -1, newest)], "bucket int, version long, newest timestamp").coalesce(1).write.mode("overwrite").parquet(f"{table}/state/v={batch_id}")
        batch.unpersist()
        for b, v in _state(spark, table, batch_id - 2)[0].items():
            if known.get(b) != v:
                _delete(spark, f"{table}/v={v}/bucket={b}")
        _delete(spark, f"{table}/state/v={batch_id - 2}")

    return write


def read_latest(spark: SparkSession, table: str, version: int, schema, ttl: str | None = None) -> DataFrame:
    """The latest rows as of batch ``version`` of ``upsert_latest``."""
    known, newest = _state(spark, table, version)
    paths = [f"{table}/v={v}/bucket={b}" for b, v in known.items()]
    return _alive(spark.read.schema(schema).parquet(*paths), newest, ttl) if paths else spark.createDataFrame([], schema)


def _alive(rows: DataFrame, newest, ttl: str | None) -> DataFrame:
    return rows if ttl is None or newest is None else rows.where(F.col("ts") >= F.lit(newest) - F.expr(f"INTERVAL {ttl}"))


def _state(spark: SparkSession, table: str, version: int) -> tuple[dict[int, int], object]:
    """Version by bucket, and the newest time, as of a batch; nothing before the first."""
    if version < 0 or not _exists(spark, f"{table}/state/v={version}"):
        return {}, None
    rows = spark.read.schema("bucket int, version long, newest timestamp").parquet(f"{table}/state/v={version}").collect()  # one row a bucket
    return {r.bucket: r.version for r in rows if r.bucket >= 0}, max((r.newest for r in rows if r.newest is not None), default=None)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run_to_end(stream: DataFrame, folder: str, mode: str, write) -> int:
    """Run a stream over what is there, batch by batch, through ``write``; returns the last batch's number."""
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    return q.lastProgress["batchId"]


def overwrite_versions(table: str):
    """For ``foreachBatch`` of complete results: batch n is ``table/v=n``, so a repeated batch replaces itself."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{table}/v={n}")
