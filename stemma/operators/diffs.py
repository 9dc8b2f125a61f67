"""Set and snapshot differences, hashes of rows and of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: Sequence[str], fields: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Per key and occurrence: added, removed, changed (with the changed fields) or unchanged."""
    w = Window.partitionBy(*key).orderBy(*(order or fields))
    numbered = lambda df, s: df.withColumn("occurrence", F.row_number().over(w)).select(*key, "occurrence", *[F.col(f).alias(f"{s}_{f}") for f in fields], F.lit(True).alias(s))
    j = numbered(before, "b").join(numbered(after, "a"), [*key, "occurrence"], "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b_{f}").eqNullSafe(F.col(f"a_{f}")), F.lit(f)) for f in fields]))
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("unchanged")
    return j.select(*key, "occurrence", status.alias("status"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def canonical_hash(*cols: str) -> Column:
    """SHA-256 of a row's sorted fields as JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def dataset_fingerprint(df: DataFrame, *cols: str) -> DataFrame:
    """Order-free fingerprint: row count and sums over four parts of the rows' hashes.

    Sums combine before the shuffle, so no list of hashes is ever gathered."""
    h = canonical_hash(*cols)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"p{i}") for i in range(4)]
    return df.agg(F.count("*").alias("n"), *parts)


def partition_diff(base: DataFrame, final: DataFrame, doc: str) -> DataFrame:
    """Regions between common boundaries of two partitions (doc, pos, length, type) of one text."""
    def edges(df, s):
        w = Window.partitionBy(doc).orderBy("pos")
        return df.select(doc, F.sum("length").over(w).alias("at"), "type", F.lit(s).alias("side"))

    b, f = edges(base, "base"), edges(final, "final")
    common = b.select(doc, "at").join(f.select(doc, "at"), [doc, "at"])
    every = b.unionByName(f)
    marks = every.select(doc, "at", "type", "side", F.lit(0).alias("is_mark")).union(common.select(doc, "at", F.lit(None).cast("string"), F.lit("mark"), F.lit(1)))
    # a region ends at a common boundary: count the boundaries that lie strictly before
    w = Window.partitionBy(doc).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    region = marks.withColumn("region", F.coalesce(F.sum("is_mark").over(w), F.lit(0))).where("is_mark = 0")
    g = region.groupBy(doc, "region").agg(
        F.count_if(F.col("side") == "base").alias("n_base"), F.count_if(F.col("side") == "final").alias("n_final"),
        F.max(F.when(F.col("side") == "base", F.col("type"))).alias("t_base"), F.max(F.when(F.col("side") == "final", F.col("type"))).alias("t_final"),
    )
    op = F.when((F.col("n_base") == 1) & (F.col("n_final") == 1), F.when(F.col("t_base") != F.col("t_final"), "set_type")).when(F.col("n_base") > F.col("n_final"), "merge").when(F.col("n_base") < F.col("n_final"), "split").otherwise("resegment")
    return g.select(doc, "region", "n_base", "n_final", op.alias("op")).where("op IS NOT NULL")


def migration_plan(old: DataFrame, overlaps: DataFrame, old_id: str, new_id: str) -> DataFrame:
    """Old units that have exactly one new unit over them, with an equal signature, are unchanged."""
    n = overlaps.groupBy(old_id).agg(F.count("*").alias("n"), F.max((F.col("old_signature") == F.col("new_signature")).cast("int")).alias("same"), F.min(new_id).alias(new_id))
    return old.join(n, old_id, "left").select(old_id, F.when((F.col("n") == 1) & (F.col("same") == 1), "unchanged").when(F.col("n").isNull(), "gone").otherwise("review").alias("plan"))


def union_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def merge_preserving(existing: DataFrame, fresh: DataFrame, key: str, human: Sequence[str], machine: Sequence[str]) -> DataFrame:
    """Fresh machine fields, human fields where people set them, and a review status."""
    e = existing.select(key, *[F.col(c).alias(f"e_{c}") for c in (*human, *machine)], F.lit(True).alias("had"))
    j = fresh.join(e, key, "full_outer")
    return j.select(key, *[F.coalesce(c, f"e_{c}").alias(c) for c in machine], *[F.coalesce(f"e_{c}", c).alias(c) for c in human]).withColumn("review_status", F.coalesce("review_status", F.lit("unreviewed")))
