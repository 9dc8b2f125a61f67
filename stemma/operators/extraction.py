"""Claims and steps by rule tables, sections and notes, derived facts, refined inventories."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators.topk import top_per_key
from stemma.sources.tables import materialize


def extract_claims(docs: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Per sentence the first rule (type, pattern with two groups) that matches, else a contextual claim if it has a number."""
    s = docs.select(key, F.posexplode(T.split_sentences(text)).alias("seq", "sentence"))
    hit = F.coalesce(*[F.when(F.col("sentence").rlike(p), F.struct(F.lit(k).alias("type"), F.regexp_extract("sentence", p, 1).alias("input"), F.regexp_extract("sentence", p, 2).alias("output"))) for k, p in rules])
    none = F.lit(None).cast("string")
    context = F.when(F.col("sentence").rlike("[0-9]"), F.struct(F.lit("contextual").alias("type"), none.alias("input"), none.alias("output")))
    return s.withColumn("claim", F.coalesce(hit, context)).where("claim IS NOT NULL").select(key, "seq", "claim.type", "claim.input", "claim.output")


def extract_steps(spans: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Steps (op, expression) of the first matching rule per sentence, each expression once, numbered from 1."""
    s = spans.select(key, F.posexplode(T.split_sentences(text)).alias("seq", "sentence"))
    step = F.coalesce(*[F.when(F.col("sentence").rlike(p), F.struct(F.lit(op).alias("op"), F.regexp_extract("sentence", p, 0).alias("expression"))) for op, p in rules])
    found = s.withColumn("s", step).where("s IS NOT NULL").select(key, "seq", "s.op", "s.expression")
    first = top_per_key(found, [key, "op", "expression"], ["seq"], 1).drop("rank")
    return first.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy("seq", "op"))).drop("seq")


def search_cache_build(results: DataFrame) -> DataFrame:
    """Per term of (term, variant, hits, reason): publishable searches, pruned ones, and whether the term fails."""
    ok = F.col("reason").isNull()
    return results.groupBy("term").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("pruned"), F.sum(F.when(ok, F.col("hits"))).alias("hits"), (F.count_if(ok) == 0).alias("failed"))


def refine_inventory(baseline: DataFrame, spans: DataFrame, max_gap: int = 6) -> DataFrame:
    """Baseline spans, and scanned ones (doc, id, first, last, title, score) not in it, with what follows as body."""
    w = Window.partitionBy("doc").orderBy("first", "id")
    s = spans.withColumn("next_id", F.lead("id").over(w)).withColumn("next_first", F.lead("first").over(w))
    known = baseline.select("doc", F.col("id").alias("known_id")).distinct()
    new = s.join(known, (s["doc"] == known["doc"]) & (F.col("id") == F.col("known_id")), "left_anti").where("title IS NOT NULL OR score > 0")
    confidence = F.when(F.col("title").isNotNull(), "high").when(F.col("score") >= 4, "medium").otherwise("low")
    following = new.where(F.col("next_first") - F.col("last") <= max_gap).join(known.withColumnRenamed("doc", "known_doc"), (F.col("doc") == F.col("known_doc")) & (F.col("next_id") == F.col("known_id")), "left_anti").select(F.col("id").alias("with_body"), F.col("next_id").alias("body"))
    out = new.join(following, F.col("id") == F.col("with_body"), "left").select("doc", "id", confidence.alias("confidence"), "body")
    return baseline.select("doc", "id", F.lit("baseline").alias("confidence"), F.lit(None).cast(dict(spans.dtypes)["id"]).alias("body")).unionByName(out)


def primary_and_context(candidates: DataFrame) -> DataFrame:
    """Per quote of (quote, candidate, single, score): its primary, and what each other candidate is to it.

    Primary is the best single span; windows are context; others compete with a score of at
    least the larger of p - 15 and three quarters of p, and are noise below."""
    best = top_per_key(candidates.where("single"), ["quote"], [F.desc("score"), "candidate"], 1).select("quote", F.col("candidate").alias("primary"), F.col("score").alias("p"))
    j = candidates.join(best, "quote", "left")
    role = F.when(F.col("candidate") == F.col("primary"), "primary").when(~F.col("single"), "context").when(F.col("score") >= F.greatest(F.col("p") - 15, F.floor(0.75 * F.col("p"))), "competing").otherwise("noise")
    return j.select("quote", "candidate", "score", role.alias("role"))


def replace_spans(docs: DataFrame, spans: DataFrame, doc: str, text: str, placeholder: str) -> DataFrame:
    """Texts with the given disjoint spans (doc, start, end) cut for a placeholder, and what was cut, in order."""
    s = spans.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    j = docs.select(doc, F.coalesce(text, F.lit("")).alias("text")).join(s, doc, "left")
    # characters as an array, so that a slice does not count from the text's beginning
    chars = F.filter(F.split("text", ""), lambda ch: ch != "")
    part = lambda a, start, n: F.array_join(F.slice(a, start + 1, n), "")

    def pieces(a):
        kept = F.transform("spans", lambda x, i: part(a, F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["end"]).cast("int"), (x["start"] - F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["end"])).cast("int")))
        last = F.element_at("spans", -1)["end"].cast("int")
        tail = part(a, last, F.size(a) - last)
        cut = F.transform("spans", lambda x: part(a, x["start"].cast("int"), (x["end"] - x["start"]).cast("int")))
        return F.struct(F.array_join(F.concat(kept, F.array(tail)), placeholder).alias("whole"), cut.alias("archived"))

    both = T.let(chars, pieces)
    whole, archived = both["whole"], both["archived"]
    none = F.array().cast("array<string>")
    return j.select(doc, F.when(F.col("spans").isNull(), F.col("text")).otherwise(whole).alias("text"), F.coalesce(archived, none).alias("archived"))


def derive_facts(assertions: DataFrame, rules: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Facts (target, facet, value, authority) saturated over Horn rules, with their proofs' number and least depth.

    ``assertions``: target, facet, value, authority, reviewed. ``rules`` has a row per premise:
    rule, target, facet, to_target, to_facet; a rule fires for each value and authority that all its
    premises have. Without ``rule`` and ``authority`` every row is a rule and all have one authority. Reviewed assertions have depth 0. Where a target and facet get two values all of
    them are blocked, and so are ``rejected`` facts (target, facet, value); blocked facts support
    nothing. A fact without a proof from unblocked reviewed facts is ungrounded, so a cycle cannot
    support itself. Both loops run until a round adds nothing. Rules and facts pack well in files, so Spark takes
    them for small: they are joined by merging, as a broadcast in every round would pass them through the driver."""
    key = ["target", "facet", "value", "authority"]
    if "authority" not in assertions.columns:
        assertions = assertions.withColumn("authority", F.lit(""))
    if "rule" not in rules.columns:  # every row is a rule of one premise
        rules = rules.withColumn("rule", F.xxhash64(*rules.columns))
    rules = materialize(rules.distinct(), "rules")
    sizes = rules.groupBy("rule").agg(F.count("*").alias("needed"))
    heads = materialize(rules.select("rule", "to_target", "to_facet").distinct().join(sizes.hint("merge"), "rule"), "heads").hint("merge")
    rules = rules.hint("merge")

    def fired(frontier, facts):
        """Heads of the rules that have a premise in the frontier and all of them among the facts."""
        hit = frontier.join(rules, ["target", "facet"]).select("rule", "value", "authority").distinct()
        met = hit.join(rules, "rule").join(facts.select(*key).hint("merge"), key).groupBy("rule", "value", "authority").agg(F.count("*").alias("met"))
        return met.join(heads, "rule").where("met = needed").select("rule", F.col("to_target").alias("target"), F.col("to_facet").alias("facet"), "value", "authority")

    facts = frontier = materialize(assertions.select(*key).distinct(), "facts")
    while not frontier.isEmpty():  # a round writes what it found, never what was found before
        frontier = materialize(fired(frontier, facts).select(*key).distinct().join(facts.hint("merge"), key, "left_anti"), "new-facts")
        facts = facts.union(frontier)
    clash = facts.groupBy("target", "facet").agg((F.min("value") != F.max("value")).alias("clash"))
    facts = facts.join(clash.hint("merge"), ["target", "facet"])
    if rejected is not None:
        facts = facts.join(rejected.select("target", "facet", "value").distinct().withColumn("rejected", F.lit(True)).hint("merge"), ["target", "facet", "value"], "left")
    else:
        facts = facts.withColumn("rejected", F.lit(None).cast("boolean"))
    facts = materialize(facts, "facts")
    usable = materialize(facts.where("NOT clash AND rejected IS NULL").select(*key), "usable")
    proofs = fired(usable, usable).groupBy(*key).agg(F.count_distinct("rule").alias("n_proofs"))
    depth = materialize(assertions.where("reviewed").select(*key).distinct().join(usable.hint("merge"), key, "left_semi").withColumn("depth", F.lit(0)), "depth")
    frontier, n = depth, 0
    while not frontier.isEmpty():
        n += 1
        new = fired(frontier.drop("depth"), depth).select(*key).distinct().join(usable.hint("merge"), key, "left_semi").join(depth.hint("merge"), key, "left_anti")
        frontier = materialize(new.withColumn("depth", F.lit(n)), "new-depth")
        depth = depth.union(frontier)
    out = facts.join(depth.hint("merge"), key, "left").join(proofs.hint("merge"), key, "left")
    status = F.when(F.col("clash"), "conflict").when(F.col("rejected"), "rejected").when(F.col("depth").isNull(), "ungrounded").otherwise("grounded")
    return out.select(*key, status.alias("status"), "depth", F.coalesce("n_proofs", F.lit(0)).alias("n_proofs"))


class Sections:
    """Groups of the lines of one part, line by line.

    A group has a source part and then a translation part, in which a mark may stand. A
    heading always begins one; a source line begins one after a translation; a mark begins
    one while only translation lines are held; a procedure begins one after a marked translation."""

    def __init__(self):
        self.group = -1
        self.source = self.translation = self.marked = False

    def next(self, kind: str) -> tuple[int, str]:
        """(group, why it began) of the next line, by its kind: heading, source, translation, mark or procedure."""
        why = "continues"
        if self.group < 0:
            why = "first"
        elif kind == "heading":
            why = "heading"
        elif kind == "source" and self.translation:
            why = "source_after_translation"
        elif kind == "mark" and self.translation and not self.source:
            why = "mark_before_source"
        elif kind == "procedure" and self.translation and self.marked:
            why = "procedure_after_mark"
        if why != "continues":
            self.group += 1
            self.source = self.translation = self.marked = False
        self.source |= kind == "source"
        self.translation |= kind in ("translation", "mark")
        self.marked |= kind == "mark"
        return self.group, why


def sections_of(kinds: Sequence[str]) -> list[tuple[int, str]]:
    state = Sections()
    return [state.next(kind) for kind in kinds]


def sectionize(lines: DataFrame, doc: str, order: str, kind: str) -> DataFrame:
    """Number the groups of each document's lines; headings cut a document into parts that are numbered apart.

    Lines stream through their task in order, and only three flags and the numbers are carried from
    one to the next, so a document of any length passes in bounded memory."""
    def walk(batches):
        current, state, part = None, None, 0
        for batch in batches:
            docs, kinds = batch.column(batch.schema.names.index(doc)).to_pylist(), batch.column(batch.schema.names.index(kind)).to_pylist()
            found = []
            for d, k in zip(docs, kinds, strict=True):
                if state is None or d != current:
                    current, state, part = d, Sections(), int(k == "heading")
                elif k == "heading":
                    state, part = Sections(), part + 1
                found.append((part, *state.next(k)))
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)] if found else []
            if columns:
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "part", "section", "why"])

    schema = ", ".join(f"`{c}` {t}" for c, t in lines.dtypes) + ", part bigint, section int, why string"
    return lines.repartition(doc).sortWithinPartitions(doc, order).mapInArrow(walk, schema)


def _accepted_pages(batches):
    """From which number on each page's closing run (low, high) is accepted, where it continues the notes of the pages before.

    Pages come by document and in order; only the document and the number expected next are carried."""
    current, expected, begun = None, 1, False
    for batch in batches:
        docs, lows, highs = (batch.column(i).to_pylist() for i in (0, 2, 3))
        starts = []
        for d, low, high in zip(docs, lows, highs, strict=True):
            if not begun or d != current:
                current, expected, begun = d, 1, True
            fits = low <= expected <= high
            starts.append(expected if fits else None)
            expected = high + 1 if fits else expected
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.int64())], names=["_doc", "_page", "_from"])


def expected_suffix(notes: DataFrame, doc: str, page: str, order: str, number: str, highest: int = 10_000) -> DataFrame:
    """Note candidates (doc, page, order, number) with whether they are accepted.

    On a page only its closing run counts, numbers that rise by one up to the page's end; of it
    those are notes that go on from the last note of the pages before. Windows find the runs; the
    walk over a document's pages sees two numbers a page and streams, so no document is collected."""
    back = Window.partitionBy(doc, page).orderBy(F.desc(order))
    place = F.row_number().over(back)
    last = F.first(number).over(back)
    n = notes.withColumn("_last", last).withColumn("_off", (F.col(number) + place - 1 != F.col("_last")) | F.col(number).isNull() | (F.col("_last") > highest))
    n = n.withColumn("_run", F.max("_off").over(back) == F.lit(False))
    pages = n.where("_run").groupBy(doc, page).agg(F.min(number).alias("low"), F.max(number).alias("high"))
    pages = pages.select(doc, page, F.col("low").cast("long"), F.col("high").cast("long"))
    kinds = dict(pages.dtypes)
    good = pages.repartition(doc).sortWithinPartitions(doc, page).mapInArrow(_accepted_pages, f"_doc {kinds[doc]}, _page {kinds[page]}, _from bigint").where("_from IS NOT NULL")
    j = n.join(good, (F.col(doc) == F.col("_doc")) & (F.col(page) == F.col("_page")), "left")
    return j.select(*notes.columns, F.coalesce(F.col("_run") & (F.col(number) >= F.col("_from")), F.lit(False)).alias("accepted"))


def span_text(text: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text, by code points."""
    return F.substring(text, start + 1, end - start)
