"""Mixing sources to target weights, with DataFrame functions only.

``mixing_plan`` measures every source in words, shares a budget among the sources by
weight, and gives each document its number of copies: the whole part of its source's
repetition rate, plus one more when a hash of (seed, doc_id) falls below the fraction.
``mix_sources`` emits the copies.

Defined cases: a null text has size 0; null sources form one source, sorted last; a
null doc_id is hashed as an empty string; repeated rows are separate documents that
decide alike; an empty table gives an empty result; other columns pass through
``mix_sources`` except names it adds, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.common import WORD, materialize

#: Source tables up to this many rows (two numbers and a name each) are broadcast.
BROADCAST_SOURCES = 10_000
#: Beyond it, every source's documents are dealt over this many buckets.
SALTS = 64

ADDED = ["size", "source_size", "target", "rate", "copies"]


def source_targets(docs: DataFrame, weights=(5, 2, 1), budget: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """Rows (source, source_size, target): ``budget`` times all words, shared by weight.

    Sources take ``weights`` in turn in order of code points. A target stops at
    ``max_repeat`` times its source's size, and what is over goes to the rest by weight.
    That fixed point is a water level: with sources in order of cap per weight, those
    whose cap lies below the level keep the cap, the rest get level times weight. The
    windows run over one row per source, after the sizes are summed."""
    sized = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    w = sized.withColumn("weight", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    every = Window.partitionBy(F.lit(0))
    by_cap = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    w = (
        w.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(budget)))
        .withColumn("below", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("below")) / F.col("open"))
        # the level is that of the first source whose cap reaches it; without one, every cap is met
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.coalesce(F.min(F.when(F.col("fits"), F.struct(F.row_number().over(by_cap), "level"))).over(every)["level"], F.lit(float("inf"))))
    )
    return w.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _uniform(seed: str, key):
    """A number in [0, 1) from the first 32 bits of md5(seed:key)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixing_plan(docs: DataFrame, weights=(5, 2, 1), budget: float = 1.5, max_repeat: float = 2.0, seed: str = "mix") -> DataFrame:
    """Documents with size, source_size, target, rate and copies."""
    docs = docs.drop(*ADDED).withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))
    rates = materialize(
        source_targets(docs.select("source", "size"), weights, budget, max_repeat).withColumn(
            "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        ),
        "rates",
    ).withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if rates.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn("_deal", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, same & (F.col("_deal") == F.col("_salt"))).drop("_salt", "_deal")
    whole = F.floor("rate")
    # rows without an id are told apart by their texts
    extra = (_uniform(seed, F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))) < F.col("rate") - whole).cast("long")
    return joined.drop("_source").withColumn("copies", (whole + extra).cast("long"))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), budget: float = 1.5, max_repeat: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mixture: every document as often as the plan says, with ``copy`` counting from 0."""
    plan = mixing_plan(docs, weights, budget, max_repeat, seed).where("copies > 0").drop("copy")
    return plan.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1))).drop(*ADDED)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    from stemma.llm.common import table

    p = mixing_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


#: The same arithmetic in the same order, for DuckDB.
MIX_CTES = r"""
sized AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
                   source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM per_source),
ranked AS (SELECT *, row_number() OVER o AS rn,
                  coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS below,
                  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened
           FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
levels AS (SELECT *, (total - below) / opened AS level FROM ranked),
levelled AS (SELECT source, source_size, cap, weight,
                    coalesce((SELECT level FROM levels WHERE level * weight <= cap ORDER BY rn LIMIT 1), 'inf'::DOUBLE) AS level FROM levels),
rates AS (SELECT source, source_size, least(cap, level * weight) AS target,
                 CASE WHEN source_size > 0 THEN least(cap, level * weight) / source_size ELSE 0.0 END AS rate FROM levelled),
planned AS (SELECT s.doc_id, s.text, s.source, s.size, r.source_size, r.target, r.rate,
                   (floor(r.rate) + (('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, md5(coalesce(s.text, '')))), 1, 8))::BIGINT / 4294967296.0::DOUBLE < r.rate - floor(r.rate))::INT)::BIGINT AS copies
            FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
"""

ORACLE = "WITH " + MIX_CTES.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, copies * size AS taken, rate, copies FROM planned"
