"""Half-open intervals per document: overlap and containment joins, coverage, segments.

Joins meet intervals in buckets of offsets of their document; both sides are exploded over
the buckets they touch, and a pair counts in the bucket where the later one begins, so no
pair comes twice and none has to be made distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.sources.tables import materialize


def _bucketed(df: DataFrame, side: str, doc: str, bucket: int, *keep: str) -> DataFrame:
    last = F.greatest(F.col("start"), F.col("end") - 1)
    rows = df.select(F.col(doc).alias("doc"), F.col("id").alias(f"{side}_id"), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), *keep, F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(last / bucket))).alias("bucket"))
    return rows


def pairs_where(a: DataFrame, b: DataFrame, doc: str, bucket: int, condition: Column) -> DataFrame:
    """Pairs of intervals of one document that meet ``condition`` and overlap."""
    j = _bucketed(a, "left", doc, bucket).join(_bucketed(b, "right", doc, bucket), ["doc", "bucket"])
    here = F.floor(F.greatest("left_start", "right_start") / bucket) == F.col("bucket")
    return j.where((F.col("left_start") < F.col("right_end")) & (F.col("right_start") < F.col("left_end")) & here & condition).drop("bucket")


def overlapping(a: DataFrame, b: DataFrame, doc: str, bucket: int = 256) -> DataFrame:
    return pairs_where(a, b, doc, bucket, F.lit(True))


def containing(outer: DataFrame, inner: DataFrame, doc: str, bucket: int = 256) -> DataFrame:
    """Pairs in which the left interval strictly contains the right one."""
    inside = (F.col("left_start") <= F.col("right_start")) & (F.col("right_end") <= F.col("left_end")) & (F.col("right_end") - F.col("right_start") < F.col("left_end") - F.col("left_start"))
    return pairs_where(outer, inner, doc, bucket, inside)


def outside(a: DataFrame, b: DataFrame, doc: str, bucket: int = 256) -> DataFrame:
    """Intervals of ``a`` that overlap none of ``b``."""
    hit = overlapping(a, b, doc, bucket).select(F.col("left_id").alias("id"), "doc").distinct()
    return a.join(hit, (a["id"] == hit["id"]) & (a[doc] == hit["doc"]), "left_anti")


def merge(spans: DataFrame, doc: str) -> DataFrame:
    """Maximal covered ranges: islands where the running end is not reached. Spans that begin together share
    their frame, so no order of equal spans matters."""
    w = Window.partitionBy(doc).orderBy("start")
    before = F.max("end").over(w.rangeBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(doc, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def char_coverage(docs: DataFrame, spans: DataFrame, doc: str, length: str) -> DataFrame:
    """Covered characters and ranges, and uncovered ranges, per document."""
    m = merge(spans, doc)
    per = m.groupBy(doc).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("ranges"), F.min("start").alias("first"), F.max("end").alias("last"))
    j = docs.select(doc, length).join(per, doc, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    gaps = F.when(F.col("ranges").isNull(), (F.col(length) > 0).cast("long")).otherwise(F.col("ranges") - 1 + (F.col("first") > 0).cast("long") + (F.col("last") < F.col(length)).cast("long"))
    return j.select(doc, length, z("covered").alias("covered"), z("ranges").alias("ranges"), gaps.alias("gaps"))


def atomic_segments(docs: DataFrame, spans: DataFrame, doc: str, length: str, bucket: int = 256) -> DataFrame:
    """Segments between all neighbouring boundaries of a text, its ends among them, with the ids of the spans over each.

    Spans (doc, id, start, end) that are empty or lie beyond the text do not count."""
    s = spans.join(docs.select(doc, length), doc).where((F.col("start") >= 0) & (F.col("end") <= F.col(length)) & (F.col("start") < F.col("end"))).drop(length)
    bounds = s.select(doc, F.explode(F.array(F.col("start").cast("long"), F.col("end").cast("long"))).alias("at"))
    at = docs.where(F.col(length) > 0).select(doc, F.explode(F.array(F.lit(0).cast("long"), F.col(length).cast("long"))).alias("at")).union(bounds).distinct()
    seg = at.withColumn("end", F.lead("at").over(Window.partitionBy(doc).orderBy("at"))).where("end IS NOT NULL").withColumnRenamed("at", "start")
    seg = materialize(seg.withColumn("id", F.col("start")), "segments")
    over = overlapping(seg, s, doc, bucket).groupBy(F.col("doc").alias("_doc"), F.col("left_id").alias("_at")).agg(F.sort_array(F.collect_list("right_id")).alias("spans"))
    j = seg.join(over, (F.col(doc) == F.col("_doc")) & (F.col("id") == F.col("_at")), "left")
    none = F.array().cast(f"array<{dict(spans.dtypes)['id']}>")
    return j.select(doc, "start", "end", F.coalesce("spans", none).alias("spans"))


def removed_text_accounting(spans: DataFrame, doc: str) -> DataFrame:
    """Characters scheduled and archived per document, and overlaps with the span before."""
    w = Window.partitionBy(doc).orderBy("start", "end", "id")
    o = spans.withColumn("overlap", F.coalesce((F.col("start") < F.lag("end").over(w)).cast("int"), F.lit(0)))
    out = o.groupBy(doc).agg(F.sum(F.col("end") - F.col("start")).alias("scheduled"), F.sum("archived").alias("archived"), F.sum("overlap").alias("overlaps"))
    return out.withColumn("equal", F.col("scheduled") == F.col("archived"))


def interval_membership(points: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """For (key, id, at) the interval of the key's ordered edges (key, edge) that holds it, by one sorted pass."""
    both = edges.select(key, F.col("edge").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id")).union(points.select(key, "at", F.lit(1), "id"))
    w = Window.partitionBy(key).orderBy("at", "kind", F.col("id").asc_nulls_first())
    low = F.last(F.when(F.col("kind") == 0, F.col("at")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(F.when(F.col("kind") == 0, F.col("at")), True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return both.withColumn("low", low).withColumn("high", high).where("kind = 1").select(key, "id", "at", "low", "high", (F.col("low").isNotNull() & F.col("high").isNotNull()).alias("inside"))
