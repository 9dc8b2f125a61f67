"""Ordered operators: gaps, sequences, islands, attachments and order alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_sequence_gaps(df: DataFrame, key: str, pos: str, number: str) -> DataFrame:
    """Fill a run without numbers if the numbers around it are as far apart as their rows."""
    w = Window.partitionBy(key).orderBy(pos)
    known = F.when(F.col(number).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(number).alias("n")))
    before = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    fits = (after["n"] - before["n"]) == (after["p"] - before["p"])
    return df.withColumn("filled", F.coalesce(F.col(number), F.when(fits, before["n"] + F.col(pos) - before["p"])))


def sequence_audit(df: DataFrame, key: str, pos: str, number: str, low: int, high: int) -> DataFrame:
    """Numbers that come twice, are missing in [low, high], fall back, or lie outside."""
    twice = df.groupBy(key, number).agg(F.count("*").alias("n")).where("n > 1").select(key, F.col(number).alias("number"), F.lit("duplicate").alias("issue"))
    wanted = df.select(key).distinct().withColumn(number, F.explode(F.sequence(F.lit(low), F.lit(high))))
    missing = wanted.join(df, [key, number], "left_anti").select(key, F.col(number).alias("number"), F.lit("missing").alias("issue"))
    w = Window.partitionBy(key).orderBy(pos)
    back = df.withColumn("_before", F.lag(number).over(w)).where(F.col(number) < F.col("_before")).select(key, F.col(number).alias("number"), F.lit("falls_back").alias("issue"))
    out = df.where((F.col(number) < low) | (F.col(number) > high)).select(key, F.col(number).alias("number"), F.lit("outside").alias("issue"))
    return twice.union(missing).union(back).union(out)


def context_windows(spans: DataFrame, key: str, max_gap: int = 8) -> DataFrame:
    """Single spans (id, first, last), and adjacent pairs at most ``max_gap`` apart."""
    w = Window.partitionBy(key).orderBy("first", "id")
    nxt = spans.withColumn("_id", F.lead("id").over(w)).withColumn("_first", F.lead("first").over(w)).withColumn("_last", F.lead("last").over(w))
    single = spans.select(key, F.array(F.col("id")).alias("members"), "first", "last")
    pair = nxt.where(F.col("_first") - F.col("last") <= max_gap).select(key, F.array("id", "_id").alias("members"), "first", F.greatest("last", "_last").alias("last"))
    return single.unionByName(pair)


def neighbor_context(df: DataFrame, key: str, order: list[str], *cols: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    for c in cols:
        df = df.withColumn(f"previous_{c}", F.lag(c).over(w)).withColumn(f"next_{c}", F.lead(c).over(w))
    return df


def relative_order(pos: Column, total: Column) -> Column:
    """Place in [0, 1] of row ``pos`` (from 0) among ``total``."""
    return F.when(total > 1, pos / (total - 1)).otherwise(0.0)


def islands(df: DataFrame, key: str, order: list[str], continues: Column) -> DataFrame:
    """Number the runs of rows of which each, after the first, ``continues`` the row before."""
    w = Window.partitionBy(key).orderBy(*order)
    fresh = df.withColumn("_new", F.when((F.row_number().over(w) == 1) | ~F.coalesce(continues, F.lit(False)), 1).otherwise(0))
    return fresh.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def attach_to_previous(df: DataFrame, key: str, order: list[str], kind: str, id_: str) -> DataFrame:
    """Alternatives attach to the nearest procedure before, follow-ups only to one just before."""
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.last(F.when(F.col(kind) == "procedure", F.col(id_)), True).over(before)
    adjacent = F.when(F.lag(kind).over(w) == "procedure", F.lag(id_).over(w))
    target = F.when(F.col(kind) == "alternative", nearest).when(F.col(kind) == "follow_up", adjacent)
    return df.withColumn("attached_to", target).withColumn("review", F.col(kind).isin("alternative", "follow_up") & target.isNull())


def order_alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Clauses (key, pos from 0) of both sides dealt to common buckets in proportion, in order."""
    na, nb = a.groupBy(key).agg(F.count("*").alias("na")), b.groupBy(key).agg(F.count("*").alias("nb"))
    n = na.join(nb, key).withColumn("_k", F.least("na", "nb"))
    left = a.join(n, key).select(key, F.floor(F.col("pos") * F.col("_k") / F.col("na")).alias("bucket"), F.col("pos").alias("left_pos"))
    right = b.join(n, key).select(key, F.floor(F.col("pos") * F.col("_k") / F.col("nb")).alias("bucket"), F.col("pos").alias("right_pos"))
    lefts = left.groupBy(key, "bucket").agg(F.sort_array(F.collect_list("left_pos")).alias("lefts"))
    rights = right.groupBy(key, "bucket").agg(F.sort_array(F.collect_list("right_pos")).alias("rights"))
    return lefts.join(rights, [key, "bucket"])


def scope_lines(df: DataFrame, key: str, order: list[str], line: str, include: str, stop: str) -> DataFrame:
    """Rows from a key's first ``include`` line until the next ``stop`` line."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.max(F.col(line).rlike(include).cast("int")).over(w)
    marked = df.withColumn("_open", opened)
    stopped = F.max(F.when((F.col("_open") == 1) & F.col(line).rlike(stop) & ~F.col(line).rlike(include), 1).otherwise(0)).over(w)
    return marked.withColumn("_stop", stopped).where("_open = 1 AND _stop = 0").drop("_open", "_stop")
