"""Reading and writing of tables, and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="stemma-"))
    return _local[0]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.shared_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a table written by ``materialize`` that nothing reads any more."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.shared_path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def read_records(spark: SparkSession, path: str, record_path: str) -> DataFrame:
    """Records under a key of whole-file JSON payloads, one row each."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(record_path).alias("r")).select("r.*")


def read_star(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Named JSON-lines tables without their note rows (those with ``_schemaNote``)."""
    out = {}
    for name, path in paths.items():
        df = spark.read.json(path)
        out[name] = df.where("_schemaNote IS NULL").drop("_schemaNote") if "_schemaNote" in df.columns else df
    return out


def read_graph(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge exports with headers; nodes need ``id``, edges source, target and type."""
    return spark.read.csv(nodes, header=True), spark.read.csv(edges, header=True, schema="source string, target string, type string")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, source_number, text): numbered lines; digits at a line's start are split off."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n", -1)).alias("line", "text"))
    return number_lines(whole)


def number_lines(lines: DataFrame) -> DataFrame:
    number = F.regexp_extract("text", r"^\s*([0-9]+)[ .:]", 1)
    return lines.withColumn("source_number", F.nullif(number, F.lit("")).cast("long")).withColumn("text", F.regexp_replace("text", r"^\s*[0-9]+[ .:]\s*", ""))


def publish(candidate: DataFrame, target: str, reason) -> int:
    """Write a table only if no row has a reason against it; returns its entries.

    The candidate is staged first, so what is checked is what is published, and the last
    step is one rename of a folder."""
    spark = candidate.sparkSession
    staged = f"{target}.staged-{uuid.uuid4().hex}"
    candidate.write.parquet(staged)
    back = spark.read.schema(candidate.schema).parquet(staged)
    bad = back.withColumn("_reason", reason).where("_reason IS NOT NULL")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    first = bad.select("_reason").first()
    if first is not None:
        fs.delete(hadoop.Path(staged), True)
        raise ValueError(f"candidate rejected: {first[0]}")
    n = back.count()
    old = hadoop.Path(f"{target}.old")
    fs.delete(old, True)
    if fs.exists(hadoop.Path(target)):
        fs.rename(hadoop.Path(target), old)
    fs.rename(hadoop.Path(staged), hadoop.Path(target))
    return n


def merge_cached(existing: DataFrame, fresh: DataFrame, key: str, version: int, ttl: float, now: float) -> DataFrame:
    """Keys with the cached value where it is of this version and young enough, else the fresh one."""
    e = existing.select(key, F.col("value").alias("_v"), F.col("version").alias("_version"), F.col("cached_at").alias("_at"))
    valid = F.coalesce((F.col("_version") == version) & (F.lit(now) - F.col("_at") <= ttl), F.lit(False))
    return fresh.join(e, key, "left").select(key, F.when(valid, F.col("_v")).otherwise(F.col("value")).alias("value"), (~valid).alias("refetch"))


def write_postings(pairs: DataFrame, path: str) -> None:
    """Postings by the first character of their token."""
    pairs.withColumn("first", F.substring("token", 1, 1)).write.partitionBy("first").parquet(path)


def numbered_sections(docs: DataFrame, doc: str, text: str, pattern: str = r"^([0-9]+)[.)] ") -> DataFrame:
    """Lines that begin a numbered section, with occurrence numbers for repeated section numbers."""
    from pyspark.sql import Window

    lines = docs.select(doc, F.posexplode(F.split(text, "\n", -1)).alias("line", "content"))
    found = lines.where(F.col("content").rlike(pattern)).withColumn("section", F.regexp_extract("content", pattern, 1).cast("int"))
    w = Window.partitionBy(doc, "section")
    return found.select(doc, "section", "line", F.row_number().over(w.orderBy("line")).alias("occurrence"), F.count("*").over(w).alias("n"))


def pages_to_groups(pages: DataFrame) -> DataFrame:
    """Headings and links of crawled pages as groups with children: (page_id, label, url, parent, pos)."""
    from pyspark.sql import Window

    tags = F.regexp_extract_all("html", F.lit(r"(?s)<(h[1-3]|a)[^>]*>.*?</"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(tags).alias("pos", "tag"))
    rows = rows.select("page_id", "pos", F.col("tag").rlike("^<h").alias("is_parent"), F.trim(F.regexp_replace(F.regexp_replace("tag", "</$", ""), "(?s)<[^>]*>", "")).alias("label"), F.regexp_extract("tag", 'href="([^"]*)"', 1).alias("url"))
    rows = rows.where("label != ''")
    first = Window.partitionBy("page_id", "label", "url").orderBy("pos")
    rows = rows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    above = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("is_parent"), F.col("label")), True).over(above)
    return rows.withColumn("parent", F.when(~F.col("is_parent"), parent))


def page_status(html: Column) -> Column:
    """Kind of a crawled page, by its marks in order."""
    return (
        F.when(F.trim(html) == "", "parse_empty").when(html.rlike("(?i)captcha|log ?in required"), "upstream_login_required_or_rate_limited")
        .when(html.contains("<article>"), "ok").when(html.contains("<li>"), "parser_miss_with_markers").otherwise("upstream_template_without_result_block")
    )
