"""Sorting and the k first rows, overall and per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of every key with their rank. Spark limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def top_neighbors(pairs: DataFrame, k: int = 8) -> DataFrame:
    """Best k partners on both sides of pairs (a, b, score)."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").union(pairs.select("b", "a", "score"))
    return top_per_key(both, ["id"], [F.desc("score"), "other"], k)


def stable_lead(scored: DataFrame, key: Sequence[str], score: str, tie: str, least: float, gap: float) -> DataFrame:
    """Best row per key, if good enough and ahead of the second by ``gap``."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), tie)
    ranked = scored.withColumn("_r", F.row_number().over(w)).withColumn("runner_up", F.lead(score).over(w)).where("_r = 1").drop("_r")
    return ranked.where((F.col(score) >= least) & (F.col("runner_up").isNull() | (F.col(score) - F.col("runner_up") >= gap)))


def natural_key(c: str) -> list[Column]:
    """Numbers of a dotted or dashed id as sort keys."""
    return [F.regexp_extract(c, r"([0-9]+)", 1).cast("int"), F.regexp_extract(c, r"[0-9]+[^0-9]+([0-9]+)", 1).cast("int")]


def best_occurrence(df: DataFrame, ids: Column, key: str, score: Column) -> DataFrame:
    """Per id mentioned in a row the best-scored row, the first of equals."""
    rows = df.withColumn("score", score).select(F.explode(F.array_distinct(ids)).alias("id"), key, "score")
    return top_per_key(rows, ["id"], [F.desc("score"), key], 1).drop("rank")
