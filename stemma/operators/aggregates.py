"""Counts, summaries and first-or-best choices; every choice ends in a unique key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.sources.tables import materialize


def count_by(df: DataFrame, key: str) -> DataFrame:
    """Rows per non-blank key."""
    return df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("n"))


def top_terms(tokens: DataFrame, term: str, example: str, k: int, examples: int = 5) -> DataFrame:
    """The k most frequent terms (ties by term) with their smallest distinct example ids.

    The tokens are read once, into counts of (term, example); ids are gathered for k terms only,
    and of those only the first ``examples`` by rank."""
    counts = materialize(tokens.groupBy(term, example).agg(F.count("*").alias("n")), "term-counts")
    top = counts.groupBy(term).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), term).limit(k)
    pairs = counts.select(term, example).join(F.broadcast(top.select(term)), term)
    ranked = first_rows(pairs, term, example, examples)
    return top.join(ranked.groupBy(term).agg(F.sort_array(F.collect_list(example)).alias("examples")), term)


def first_rows(df: DataFrame, key: str, order: str, n: int, salts: int = 64) -> DataFrame:
    """The first n rows of every key: first of parts of a key, so a hot key is ranked by many tasks, then of those."""
    for by in ([key, F.pmod(F.xxhash64(order), F.lit(salts))], [key]):
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_r") <= n).drop("_r")
    return df


def postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(token, doc) pairs of an inverted index, one row per pair: a list may not fit a row."""
    return docs.select(F.explode(F.array_distinct(T.tokens(text))).alias("token"), F.col(doc).alias("doc"))


def posting_lists(pairs: DataFrame, block: int = 10_000) -> DataFrame:
    """Postings in blocks of ids, so that the list of a frequent token spreads over rows."""
    keyed = pairs.withColumn("block", F.floor(F.col("doc") / block))
    return keyed.groupBy("token", "block").agg(F.sort_array(F.collect_list("doc")).alias("docs"), F.count("*").alias("n"))


def length_stats(df: DataFrame, text: str, *by: str) -> DataFrame:
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return df.groupBy(*by).agg(F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 2).alias("mean"), F.count_if(n == 0).alias("empty"))


def conditional_counts(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Many filtered counts in one pass."""
    return df.agg(*[F.count_if(p).alias(name) for name, p in predicates.items()])


def template_aggregate(clauses: DataFrame, examples: int = 10) -> DataFrame:
    """Per template of (template, chunk): counts, specificity, whether it says too little, and examples."""
    once = materialize(clauses.groupBy("template", "chunk").agg(F.count("*").alias("n")), "template-chunks")
    first = first_rows(once.select("template", "chunk"), "template", "chunk", examples).groupBy(F.col("template").alias("_template")).agg(F.sort_array(F.collect_list("chunk")).alias("examples"))
    counts = once.groupBy("template").agg(F.sum("n").alias("n"), F.count("*").alias("n_chunks"))
    out = counts.join(first, F.col("template").eqNullSafe(F.col("_template"))).drop("_template")
    return out.withColumn("specificity", T.specificity("template")).withColumn("overgeneral", F.col("specificity") < 2)


#: Strengths of a pair, best first, and what each adds to a pair's priority.
STRENGTHS = ("single", "ordinal", "near", "preset", "one_to_many", "cooccurrence")


def pair_aggregate(pairs: DataFrame) -> DataFrame:
    """Per (left, right): counts, chunks, counts per strength, best strength and priority."""
    counts = [F.count_if(F.col("strength") == s).alias(s) for s in STRENGTHS]
    out = pairs.groupBy("left", "right").agg(F.count("*").alias("n"), F.count_distinct("chunk").alias("n_chunks"), *counts)
    best = F.coalesce(*[F.when(F.col(s) > 0, F.lit(s)) for s in STRENGTHS])
    priority = 3 * F.col("n_chunks") + 8 * F.col("single") + 6 * F.col("ordinal") + 3 * F.col("near") + T.specificity("left")
    return out.withColumn("best", best).withColumn("priority", priority.cast("double"))


def rank_in(value: Column, order: Sequence[str]) -> Column:
    """Place of a value in a list from 0; values outside come last."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(order))).cast("int")


def strongest(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Per key the value that stands first in ``order``."""
    best = df.groupBy(*key).agg(F.min(rank_in(F.col(value), order)).alias("r"))
    return best.withColumn(value, F.get(F.array(*map(F.lit, order)), F.col("r"))).drop("r")


def first_by_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Per key the first row in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def lexicon(manual: DataFrame, derived: DataFrame) -> DataFrame:
    """Union of (text, evidence): manual entries name a text first; evidence ids merge; longest first."""
    every = manual.withColumn("source", F.lit("manual")).unionByName(derived.withColumn("source", F.lit("derived"))).where(F.length(F.trim("text")) >= 2)
    out = every.groupBy(F.trim("text").alias("text")).agg(F.max("source").alias("source"), F.count_distinct("evidence").alias("n_evidence"), F.min("evidence").alias("first_evidence"))
    return out.withColumn("length", F.length("text"))


def decision_metrics(log: DataFrame) -> DataFrame:
    """Per action and actor: decisions, and human seconds, null without human rows."""
    human = F.when(F.col("actor") == "human", F.col("seconds"))
    return log.groupBy("action", "actor").agg(F.count("*").alias("n"), F.sum(human).alias("human_seconds"))


def precision_recall(df: DataFrame, gold: Column, predicted: Column, *by: str) -> DataFrame:
    """TP, FP, FN with precision and recall, null for a zero denominator."""
    tp, fp, fn = F.count_if(gold & predicted), F.count_if(~gold & predicted), F.count_if(gold & ~predicted)
    out = df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def macro_average(scores: DataFrame, by: str) -> DataFrame:
    """Mean of the precision and recall that exist, and summed counts, per layer."""
    return scores.groupBy(by).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def benchmark_verdict(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Failure reasons of each row: none is a pass, one or two are partial, more fail."""
    reasons = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks.items()]))
    return df.withColumn("reasons", reasons).withColumn("verdict", F.when(F.size("reasons") == 0, "pass").when(F.size("reasons") <= 2, "partial").otherwise("fail"))


def coverage_rate(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, 4))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def relation_stats(df: DataFrame, subject: str, objects: str) -> DataFrame:
    """Counts per object of an array column, and how many subjects have it."""
    return df.select(subject, F.explode(objects).alias("object")).groupBy("object").agg(F.count("*").alias("n"), F.count_distinct(subject).alias("subjects"))


def tag_groups(df: DataFrame, tags: Column, allowed: Sequence[str]) -> DataFrame:
    """Rows per allowed tag; a row without one counts as ``untagged``."""
    kept = F.filter(tags, lambda x: x.isin(*allowed))
    return df.select(F.explode(F.when(F.size(kept) == 0, F.array(F.lit("untagged"))).otherwise(kept)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def operation_cue_counts(df: DataFrame, text: str, cues: dict[str, Sequence[str]], *keep: str) -> DataFrame:
    """Non-overlapping counts per pattern; of alternatives at a place the longest counts."""
    cols = []
    for name, words in cues.items():
        pattern = "|".join(sorted(words, key=lambda w: (-len(w), w)))
        cols.append(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(pattern)).cast("long").alias(name))
    return df.select(*keep, *cols)


def merge_entries(entries: DataFrame) -> DataFrame:
    """Per id its first position and its first title that is not blank, of (id, pos, title)."""
    filled = F.when(F.coalesce(F.trim("title"), F.lit("")) != "", F.col("pos"))
    return entries.groupBy("id").agg(F.min("pos").alias("pos"), F.min_by("title", filled).alias("title"))


def page_range(lines: DataFrame, key: str) -> DataFrame:
    """Least and largest page, first and last numeric book page in order of position."""
    numeric = F.when(F.col("book").rlike("^[0-9]+$"), F.col("pos"))
    return lines.groupBy(key).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min_by("book", numeric).alias("first_book"), F.max_by("book", numeric).alias("last_book"))


def parameter_index(params: DataFrame) -> DataFrame:
    """Declarations (name, scope, unit) under their name and, with a scope, under scope::name."""
    named = params.select(F.col("name").alias("key"), "unit")
    scoped = params.where("scope IS NOT NULL").select(F.concat_ws("::", "scope", "name").alias("key"), "unit")
    return named.unionByName(scoped).groupBy("key").agg(F.count("*").alias("n"), F.min("unit").alias("first_unit"))


def review_status_counts(units: DataFrame) -> DataFrame:
    """Status of the last review of each unit (unit, seq, status), else unreviewed."""
    last = units.groupBy("unit").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"))
    return last.groupBy(F.coalesce("status", F.lit("unreviewed")).alias("status")).agg(F.count("*").alias("n"))


def cardinality_audit(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: left ids with several rights, rights with several lefts, and ids without a partner."""
    l2r, r2l = links.groupBy("l").agg(F.count_distinct("r").alias("n")), links.groupBy("r").agg(F.count_distinct("l").alias("n"))
    several, alone, none = (F.col("n") > 1).cast("int"), F.col("n").isNull().cast("int"), F.lit(0)
    a = left.join(l2r, "l", "left").select(several.alias("one_to_many"), alone.alias("left_alone"), none.alias("many_to_one"), none.alias("right_alone"))
    b = right.join(r2l, "r", "left").select(none, none, several, alone)
    return a.union(b).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in a.columns])


def quality_verdict(missing: Column, total: Column, untranslated: Column) -> Column:
    return F.when((missing > 0.12 * total) | (untranslated > 0), "usable_but_needs_review").otherwise("usable")


def term_index(occurrences: DataFrame, parents: DataFrame) -> DataFrame:
    """Per surface of (id, surface, level): counts, its classification, direct parents and the number of
    occurrences, near or far, that it is part of.

    ``parents`` has (id, parent), both ids of occurrences; parents that do not occur are no parents."""
    from stemma.operators.graphs import closure

    counts = occurrences.groupBy("surface").agg(
        F.count("*").alias("n"), F.count_if(F.col("level") == "maximal").alias("n_maximal"), F.count_if(F.col("level") == "component").alias("n_component")
    )
    kind = F.when((F.col("n_maximal") > 0) & (F.col("n_component") > 0), "both").when(F.col("n_maximal") > 0, "maximal").otherwise("component")
    known = parents.join(occurrences.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")
    direct = occurrences.join(known, "id").groupBy("surface").agg(F.count_distinct("parent").alias("n_parents"), F.min("parent").alias("first_parent"))
    above = closure(known.select(F.col("id").alias("child"), "parent"))
    whole = occurrences.join(above, F.col("id") == F.col("node")).groupBy("surface").agg(F.count_distinct("ancestor").alias("appears_in_compounds"))
    counts = counts.join(whole, "surface", "left").withColumn("appears_in_compounds", F.coalesce("appears_in_compounds", F.lit(0)))
    return counts.withColumn("kind", kind).join(direct, "surface", "left").withColumn("n_parents", F.coalesce("n_parents", F.lit(0)))
