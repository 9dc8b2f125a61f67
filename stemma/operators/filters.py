"""Projections, filters and predicates over tables of texts, nodes and records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions import text as T


def search_entities(nodes: DataFrame, edges: DataFrame, keyword: str, fields: Sequence[str], category: str | None = None, relation: str | None = None) -> DataFrame:
    """Nodes (id, label, name, note, …) with ``keyword`` in a field or in a neighbour's name.

    Ranked by where it stands: name 3, another field 2, a neighbour's name 1. A blank keyword
    matches every node that has one of the fields."""
    k = keyword.lower()
    has = lambda c: F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")).contains(k) & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    near = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).union(edges.select("target", "source"))
    hits = near.join(nodes.where(F.lower("name").contains(k)).select(F.col("id").alias("other")), "other", "left_semi").select(F.col("id").alias("near_id")).distinct()
    found = nodes if category is None else nodes.where(F.col("label") == category)
    if relation is not None:
        e = edges.where(F.col("type") == relation)
        found = found.join(e.select(F.col("source").alias("id")).union(e.select("target")).distinct(), "id", "left_semi")
    rest = [has(f) for f in fields if f != "name"]
    inside = F.lit(False)
    for r in rest:
        inside = inside | r
    joined = found.join(hits, F.col("id") == F.col("near_id"), "left")
    score = F.when(has("name") & F.lit("name" in fields), 3).when(inside, 2).when(F.col("near_id").isNotNull() & F.lit(bool(k)), 1).otherwise(0)
    return joined.withColumn("score", score).where("score > 0").drop("near_id")


def display_rows(df: DataFrame, key: str, labels: dict[str, str]) -> DataFrame:
    """Properties as rows (key, property, label, value, place), without blank ones."""
    rows = [F.struct(F.lit(p).alias("property"), F.lit(label).alias("label"), F.col(p).cast("string").alias("value"), F.lit(i).alias("place")) for i, (p, label) in enumerate(labels.items())]
    return df.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*").where("trim(coalesce(value, '')) != ''")


def filter_all(df: DataFrame, **conditions) -> DataFrame:
    """Conjunction of optional conditions: None passes, a list asks for membership."""
    for name, wanted in conditions.items():
        if wanted is not None:
            df = df.where(F.col(name).isin(*wanted) if isinstance(wanted, (list, tuple, set)) else F.col(name) == wanted)
    return df


def classify_status(status: Column, source_types: Column) -> Column:
    says = lambda x: (status == x) | F.coalesce(F.array_contains(source_types, x), F.lit(False))
    return F.when(says("hypothetical"), "hypothetical").when(says("reference"), "reference").otherwise("measured")


def filter_pairs(pairs: DataFrame, sides: DataFrame, axis: str | None = None) -> DataFrame:
    """Pairs (a, b, axes) of which a side is in ``sides`` (id) and that match on an axis."""
    ids = sides.select(F.col("id").alias("side")).distinct()
    keep = pairs.join(ids, (F.col("a") == F.col("side")), "left_semi").union(pairs.join(ids, F.col("b") == F.col("side"), "left_semi")).distinct()
    return keep if axis is None else keep.where(F.exists("axes", lambda x: (x["axis"] == axis) & (x["matched_count"] > 0)))


def in_page_scope(chunks: DataFrame, scopes: DataFrame, width: int = 1000) -> DataFrame:
    """Chunks (first, last) that lie inside a scope (scope, low, high): they meet in buckets of pages, by an equi-join."""
    each = scopes.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    met = chunks.withColumn("_bucket", F.floor(F.col("first") / width)).join(each, "_bucket")
    return met.where((F.col("first") >= F.col("low")) & (F.col("last") <= F.col("high"))).drop("_bucket")


@lru_cache(maxsize=4)
def _automaton(lexicon: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term in lexicon:
        a.add_word(term, term)
    a.make_automaton()
    return a


def lexicon_hits(docs: DataFrame, doc: str, text: str, lexicon: Sequence[str]) -> DataFrame:
    """(doc, term, first) of the terms of a lexicon that a text holds; one automaton a worker reads a text once."""
    terms = tuple(sorted({x for x in lexicon if x}))

    @F.pandas_udf("array<struct<term:string,first:int>>")
    def hits(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found: dict[str, int] = {}
            for end, term in _automaton(terms).iter(t) if t and terms else ():
                found.setdefault(term, end - len(term) + 1)
            out.append([{"term": k, "first": v} for k, v in found.items()])
        return pd.Series(out)

    return docs.select(doc, F.explode(hits(text)).alias("hit")).select(doc, "hit.term", "hit.first")


def literal_units(units: DataFrame, text: str, literal: str) -> DataFrame:
    return units.where(F.col(text).contains(literal))


def suspicious_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row and reason for every rule that a row meets."""
    reasons = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in rules.items()]))
    return df.withColumn("reason", F.explode(reasons))


def reason(rules: dict[str, Column]) -> Column:
    """First rule that is broken; null for a good row."""
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()], F.lit(None).cast("string"))


#: Fixed pattern: characters of the Han script.
HAN = r"\p{IsHan}"


def line_quality(line: Column) -> Column:
    """Whether a line is a source line, a short continuation, or other, by shares of scripts."""
    n = F.length(F.regexp_replace(line, r"\s", ""))
    cjk = F.length(F.regexp_replace(line, f"[^{HAN}]", ""))
    latin = F.length(F.regexp_replace(line, "[^A-Za-z]", ""))
    digit = F.length(F.regexp_replace(line, "[^0-9]", ""))
    share = F.when(n > 0, cjk / n).otherwise(0.0)
    source = (cjk >= 3) & (share >= 0.35) & (latin <= F.greatest(F.lit(2.0), cjk / 3))
    short = (latin == 0) & (digit == 0) & (share >= 0.6) & (n <= 24)
    return F.when(source, "source").when(short, "continuation").otherwise("other")


def text_quality(text: Column) -> Column:
    return F.when(text.contains("�"), "garbled").when(text.rlike(HAN), "good").otherwise("mixed")


def drop_artifacts(lines: DataFrame, line: str, header: str, artifact: str) -> tuple[DataFrame, DataFrame]:
    """(kept lines, warnings): headers go silently, page artifacts with a warning row."""
    bad = F.col(line).rlike(artifact)
    return lines.where(~F.col(line).rlike(header) & ~bad), lines.where(bad).withColumn("code", F.lit("page_artifact"))


def classify_units(text: Column, rules: Sequence[tuple[str, float, str]]) -> Column:
    """Struct (type, confidence, rule) of the first matching rule (type, confidence, pattern)."""
    out = F.struct(F.lit("text").alias("type"), F.lit(0.3).alias("confidence"), F.lit("fallback").alias("rule"))
    for kind, confidence, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(pattern).alias("rule"))).otherwise(out)
    return out


def pattern_seeds(df: DataFrame, key: str, left: str, right: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Per rule (name, left pattern, right pattern): rows that match both, and the first ten ids."""
    hits = [F.when(F.col(left).rlike(a) & F.col(right).rlike(b), F.lit(name)) for name, a, b in rules]
    rows = df.select(key, F.explode(F.array_compact(F.array(*hits))).alias("rule"))
    from stemma.operators.topk import top_per_key

    first = top_per_key(rows, ["rule"], [key], 10).groupBy("rule").agg(F.sort_array(F.collect_list(key)).alias("examples"))
    return rows.groupBy("rule").agg(F.count("*").alias("n")).join(first, "rule")


def marker_audit(df: DataFrame, key: str, payload: str, markers: Sequence[str]) -> DataFrame:
    """Rows whose payload holds a forbidden marker as a word."""
    hit = [F.when(F.col(payload).rlike(rf"\b{m}\b"), F.lit(m)) for m in markers]
    return df.select(key, F.explode(F.array_compact(F.array(*hit))).alias("marker"))


def unified_label(zh: str, en: str) -> Column:
    return F.concat_ws(" / ", T.best_name(zh), T.best_name(en))
