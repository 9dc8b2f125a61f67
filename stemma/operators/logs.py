"""Decision logs: replay to a status per decision, effective state, management state, overlays."""

from __future__ import annotations

import bisect
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.operators.graphs import closure, on_cycles, propagate_inactive
from stemma.sources.tables import materialize


#: How the decisions of a kind make up the state of their slot: the last one counts, each distinct payload
#: once, every decision in order, or the last value of every facet.
FOLDS = {"select": "last", "bind": "last", "scope": "last", "reject": "set", "note": "list", "facets": "facets"}

#: Kinds that chose among what was known then: a later context makes them stale.
CHOICES = ("select", "bind")


def visible(log: DataFrame, branches: DataFrame, branch: str) -> DataFrame:
    """Decisions of a branch and its ancestors; ``branches``: child, parent."""
    above = closure(branches).where(F.col("node") == branch).select(F.col("ancestor").alias("branch"))
    here = log.sparkSession.createDataFrame([(branch,)], f"branch {dict(log.dtypes)['branch']}")
    return log.join(above.union(here).distinct(), "branch", "left_semi")


def active_history(history: DataFrame, key: str) -> DataFrame:
    """Entries (key, id, reverts) that no later entry, itself not reverted, points back to.

    An undo counts only if it stands. An entry with an undo that stands does not; one whose undos all
    fell does. One that waits for a single undo stands exactly if that does not, so it is linked to it,
    and links double their reach each round: a chain of n undos settles in about log n rounds. Settled
    entries are written once."""
    known = materialize(history.select(key, "id", "reverts"), "history")
    back = materialize(known.where("reverts IS NOT NULL AND reverts < id").select(key, F.col("reverts").alias("id"), F.col("id").alias("by")).join(known.select(key, "id"), [key, "id"], "left_semi"), "undos")
    settled = [materialize(known.select(key, "id").join(back.select(key, "id"), [key, "id"], "left_anti").withColumn("stands", F.lit(True)), "settled")]
    undos, links, n = back, None, back.count()
    while n:
        done = reduce(DataFrame.union, settled)
        # entries that wait for several undos: those that fell no longer count, one that stands decides
        open_ = undos.join(done.select(key, F.col("id").alias("by"), "stands"), [key, "by"], "left")
        left = open_.groupBy(key, "id").agg(F.coalesce(F.bool_or("stands"), F.lit(False)).alias("undone"), F.count_if(F.col("stands").isNull()).alias("n"), F.max(F.when(F.col("stands").isNull(), F.col("by"))).alias("to"))
        left = materialize(left, "waiting")
        new = [left.where("undone OR n = 0").select(key, "id", (~F.col("undone")).alias("stands"))]
        fresh = left.where("NOT undone AND n = 1").select(key, "id", "to", F.lit(True).alias("flip"))
        every = fresh if links is None else links.union(fresh)
        ahead = every.select(key, F.col("id").alias("to"), F.col("to").alias("next"), F.col("flip").alias("_flip"))
        every = every.join(ahead, [key, "to"], "left").select(key, "id", F.coalesce("next", "to").alias("to"), (F.col("flip") != F.coalesce("_flip", F.lit(False))).alias("flip"))
        met = materialize(every.join(done.select(key, F.col("id").alias("to"), "stands"), [key, "to"], "left"), "links")
        new.append(met.where("stands IS NOT NULL").select(key, "id", (F.col("stands") != F.col("flip")).alias("stands")))
        links = met.where("stands IS NULL").select(key, "id", "to", "flip")
        undos = materialize(open_.where("stands IS NULL").join(left.where("NOT undone AND n > 1").select(key, "id"), [key, "id"], "left_semi").select(key, "id", "by"), "undos")
        settled.append(materialize(reduce(DataFrame.union, new), "settled"))
        n = undos.count() + links.count()
    return reduce(DataFrame.union, settled)



def replay_decisions(log: DataFrame, depends: DataFrame, branches: DataFrame | None = None, branch: str | None = None) -> DataFrame:
    """Status of every decision that ``branch`` sees, pass by pass.

    ``log``: session, decision, revision, action (decide, retract, resegment, attach_context), target, doc,
    start, end, slot, payload; maybe branch, kind (of ``FOLDS``, else scope) and facets (a map).
    ``depends``: child, parent (decisions); ``branches``: child, parent. Passes: cycles and missing
    dependencies, and what hangs on them; retractions from the newest; dependents; staleness by a later
    resegment over the same text; staleness of choices by a later context of the session; slots whose
    decisions contradict each other; dependents again. A retraction, resegment or context that took
    effect but is not active in the end is invalid, and all is replayed without it."""
    if branches is not None:
        log = visible(log, branches, branch)
    kind = F.col("kind") if "kind" in log.columns else F.lit("scope")
    facets = F.col("facets") if "facets" in log.columns else F.lit(None).cast("map<string,string>")
    log = materialize(log.withColumn("kind", kind).withColumn("facets", facets), "visible")
    depends = materialize(depends, "depends")
    cyclic = on_cycles(depends).select(F.col("node").alias("decision"))
    lost = depends.join(log.select(F.col("decision").alias("parent")), "parent", "left_anti").select(F.col("child").alias("decision"))
    invalid = materialize(cyclic.union(lost).distinct(), "unfounded")
    while True:
        done = materialize(_replay_pass(log, depends, invalid), "replayed")
        fresh = materialize(done.where("applied AND status != 'active'").select("decision").join(invalid, "decision", "left_anti"), "invalid")
        if fresh.isEmpty():
            return done.select("session", "decision", "revision", "action", "slot", "kind", "payload", "facets", "status")
        invalid = materialize(invalid.union(fresh), "invalid")


def _replay_pass(log: DataFrame, depends: DataFrame, invalid: DataFrame) -> DataFrame:
    flag = lambda df, name: df.select("decision", F.lit(True).alias(name)).distinct()
    set_ = lambda df, where, status: df.withColumn("status", F.when(where, status).otherwise(F.col("status")))
    base = log.withColumn("status", F.lit("active")).join(flag(invalid, "bad"), "decision", "left")
    base = materialize(_fall(set_(base, F.col("bad"), "needs_revalidation").drop("bad"), depends), "replay")
    undo = F.when((F.col("action") == "retract") & (F.col("status") == "active"), F.col("target"))
    stands = active_history(base.select("session", F.col("decision").alias("id"), undo.alias("reverts")), "session")
    base = base.join(stands.select("session", F.col("id").alias("decision"), "stands"), ["session", "decision"], "left")
    base = base.join(log.select("session", F.col("decision").alias("target"), F.lit(True).alias("known")), ["session", "target"], "left")
    base = set_(base, ~F.col("stands"), "retracted")
    undoes = (F.col("action") == "retract") & (F.col("status") == "active")
    base = set_(base.withColumn("applied", undoes & F.col("known").isNotNull()), undoes & F.col("known").isNull(), "needs_revalidation").drop("stands", "known")
    base = materialize(_fall(base, depends), "replay")
    # a later resegment over the text of a decision makes it stale: intervals meet in buckets of 64 characters
    cut = lambda df, s: df.select("session", "doc", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor((F.col("end") - 1) / 64))).alias("bucket"), *[F.col(c).alias(f"{s}_{c}") for c in ("decision", "start", "end", "revision")])
    live = base.where("status = 'active' AND start < end")
    hit = cut(live.where("action != 'resegment'"), "d").join(cut(live.where("action = 'resegment'"), "r"), ["session", "doc", "bucket"]).where("d_start < r_end AND r_start < d_end AND r_revision > d_revision")
    base = base.join(flag(hit.select(F.col("d_decision").alias("decision")), "stale"), "decision", "left")
    base = base.withColumn("applied", F.col("applied") | ((F.col("action") == "resegment") & (F.col("status") == "active")))
    base = materialize(set_(base, F.col("stale"), "stale").drop("stale"), "replay")
    context = (F.col("action") == "attach_context") & (F.col("status") == "active")
    base = base.withColumn("applied", F.col("applied") | context)
    last = base.where(context).groupBy("session").agg(F.max("revision").alias("context"))
    decides = (F.col("action") == "decide") & (F.col("status") == "active")
    base = base.join(last, "session", "left")
    base = materialize(set_(base, decides & F.col("kind").isin(*CHOICES) & (F.col("revision") < F.col("context")), "stale").drop("context"), "replay")
    by_fold = lambda *folds: F.col("kind").isin(*[k for k, f in FOLDS.items() if f in folds])
    slots = base.where(decides & by_fold("last")).groupBy("session", "slot", "kind").agg((F.min("payload") != F.max("payload")).alias("clash")).where("clash")
    base = base.join(slots, ["session", "slot", "kind"], "left")
    each = base.where(decides & by_fold("facets")).select("session", "slot", "decision", F.explode("facets").alias("name", "value"))
    apart = each.groupBy("session", "slot", "name").agg((F.min("value") != F.max("value")).alias("differ")).where("differ")
    base = base.join(flag(each.join(apart, ["session", "slot", "name"], "left_semi"), "contrary"), "decision", "left")
    base = set_(base, decides & (F.col("clash") | F.col("contrary")), "conflicted").drop("clash", "contrary")
    return _fall(materialize(base, "replay"), depends)


def _fall(base: DataFrame, depends: DataFrame) -> DataFrame:
    """Active decisions with an inactive dependency need revalidation, and so on."""
    status = propagate_inactive(materialize(base.select(F.col("decision").alias("id"), (F.col("status") == "active").alias("active")), "nodes"), depends)
    fell = status.where("status = 'needs_revalidation'").select(F.col("id").alias("decision"), F.lit(True).alias("fell"))
    return base.join(fell, "decision", "left").withColumn("status", F.when(F.col("fell") & (F.col("status") == "active"), "needs_revalidation").otherwise(F.col("status"))).drop("fell")


def effective_state(replayed: DataFrame) -> DataFrame:
    """State (session, slot, kind, pos, name, value, decision) that the active decisions make up, by ``FOLDS``.

    One row for a slot of which the last payload counts, and a row for each member of a set (at its first
    decision), entry of a list, or facet (its last value), numbered by pos: no slot is collected."""
    live = replayed.where("status = 'active' AND action = 'decide'")
    fold = F.create_map(*[F.lit(x) for pair in FOLDS.items() for x in pair])[F.col("kind")]
    live = live.withColumn("fold", fold).withColumn("f", F.when(F.col("fold") == "facets", F.map_entries("facets")).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("payload").cast("string").alias("value")))))
    each = live.select("session", "slot", "kind", "fold", "revision", "decision", F.explode("f").alias("f")).select("*", "f.key", "f.value").drop("f")
    slot = ["session", "slot", "kind", "fold"]
    order = F.struct("revision", "decision")
    same = F.when(F.col("fold") == "set", F.col("value")).when(F.col("fold") == "facets", F.col("key")).when(F.col("fold") == "list", F.col("decision").cast("string"))
    g = each.withColumn("_same", same).groupBy(*slot, "_same").agg(F.min(order).alias("low"), F.max(order).alias("high"), F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last"), F.first("key").alias("name"))
    at = F.when(F.col("fold") == "set", F.col("low")).otherwise(F.col("high"))
    g = g.select("session", "slot", "kind", "name", at.alias("at"), F.when(F.col("fold") == "set", F.col("first")).otherwise(F.col("last")).alias("value"), F.when(F.col("fold") == "facets", F.col("name")).alias("_name"))
    pos = F.row_number().over(Window.partitionBy("session", "slot", "kind").orderBy("_name", "at"))
    return g.select("session", "slot", "kind", pos.alias("pos"), "name", "value", F.col("at.decision").alias("decision"))


def management_state(events: DataFrame, lineage: DataFrame) -> DataFrame:
    """Per key the last event of the nearest branch (depth 0 is the branch itself)."""
    e = events.join(lineage, "branch")
    return e.groupBy("key").agg(F.max_by("value", F.struct(-F.col("depth"), F.col("seq"))).alias("value"), F.count("*").alias("n"))


class SpanWalk:
    """Greedy choice among spans (start, end, priority, id) that come by their start, in few of them at a time.

    The best of the spans that overlap is taken: by priority (nulls last), length, start and id. A span
    is settled as soon as no better one that it overlaps is open, so only open spans wait, and of those
    taken only the ones that reach beyond. ``most``: how many wait before they are looked through."""

    def __init__(self, most: int = 50_000):
        self.most = self.limit = most
        self.waiting: list[tuple] = []
        self.taken: list[tuple] = []
        self.far = None

    def add(self, span: tuple) -> list[tuple]:
        """The spans that are taken now that the next one has come."""
        found = []
        if self.waiting and (span[0] >= self.far or len(self.waiting) >= self.limit):
            found = self.settle(span[0])
            self.limit = max(self.most, 2 * len(self.waiting))
        self.far = span[1] if self.far is None else max(self.far, span[1])
        self.waiting.append(span)
        return found

    def settle(self, coming=None) -> list[tuple]:
        """Take what can be taken if all spans to come start at ``coming`` or later, or none comes."""
        found, open_, covered = [], [], []
        for r in sorted(self.waiting, key=lambda r: (r[2] is None, -(r[2] or 0), r[0] - r[1], r[0], r[3] is None, r[3])):
            i = bisect.bisect_left(self.taken, r[:2])
            if (i and self.taken[i - 1][1] > r[0]) or (i < len(self.taken) and self.taken[i][0] < r[1]):
                continue
            i = bisect.bisect_left(covered, r[:2])
            if (coming is not None and r[1] > coming) or (i and covered[i - 1][1] > r[0]) or (i < len(covered) and covered[i][0] < r[1]):
                open_.append(r)
                low, high = r[:2]
                i -= bool(i and covered[i - 1][1] >= low)
                k = i
                while k < len(covered) and covered[k][0] <= high:
                    low, high, k = min(low, covered[k][0]), max(high, covered[k][1]), k + 1
                covered[i:k] = [(low, high)]
            else:
                bisect.insort(self.taken, r[:2])
                found.append(r)
        self.waiting = open_
        first = min([r[0] for r in open_] + ([] if coming is None else [coming]), default=None)
        self.taken = [] if first is None else [x for x in self.taken if x[1] > first]
        return found


def greedy_spans(rows: list[tuple]) -> list[tuple]:
    """Of (start, end, priority, id) those that fit in order of priority, length, start and id."""
    walk = SpanWalk()
    walk.waiting = list(rows)
    return walk.settle()


def resolve_spans(spans: DataFrame, doc: str, most: int = 50_000) -> DataFrame:
    """Non-overlapping spans per document, greedily; spans without letters or with null ends drop out.

    Spans stream through their task by document and start, and only those that are still open are held:
    a chain of overlapping spans passes piece by piece, however long it is."""
    cols = [doc, "start", "end", "priority", "id"]

    def walk(batches):
        current, state = None, None
        schema = None
        for batch in batches:
            schema = batch.schema
            out = []
            for d, *span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or d != current:
                    out += [(current, *r) for r in state.settle()] if state else []
                    current, state = d, SpanWalk(most)
                out += [(d, *r) for r in state.add(tuple(span))]
            yield _batch(out, schema)
        if state:
            yield _batch([(current, *r) for r in state.settle()], schema)

    s = spans.where("start < end").select(*cols)
    return s.repartition(doc).sortWithinPartitions(doc, "start", "end", "id").mapInArrow(walk, s.schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _split_points(value: Column, text: Column) -> Column:
    """Ends of the parts of a text by a list of boundaries like ``3,7``; null if they do not cut it into parts."""
    points = F.array_sort(F.transform(F.split(value, ","), lambda x: x.try_cast("int")))
    good = value.rlike("^[0-9]+(,[0-9]+)*$") & (F.size(F.array_distinct(points)) == F.size(points)) & (F.get(points, F.lit(0)) > 0) & (F.element_at(points, -1) < F.length(text))
    return F.when(good, F.concat(points, F.array(F.length(text))))


def apply_overlay(units: DataFrame, ops: DataFrame) -> DataFrame:
    """Units (doc, id, pos, text, type, and maybe relations) after operations (doc, target, seq, op, value).

    set_type and set_relations: the last one per unit holds. split: the last one cuts a unit at its
    boundaries; parts keep the type, and relations of the whole are none of theirs. merge: a unit joins
    what stands before it, so runs of merged units become one with the first one's id, type and
    relations; a merge of a first unit is rejected. ``overlay_rejections`` says which and why."""
    if "relations" not in units.columns:
        units = units.withColumn("relations", F.lit(None).cast("string"))
    last = lambda op, name: ops.where(F.col("op") == op).groupBy("doc", F.col("target").alias("id")).agg(F.max_by("value", "seq").alias(name))
    merges = ops.where("op = 'merge'").select("doc", F.col("target").alias("id"), F.lit(True).alias("joins")).distinct()
    u = units
    for part in (last("set_type", "new_type"), last("set_relations", "new_relations"), last("split", "cuts"), merges):
        u = u.join(part, ["doc", "id"], "left")
    u = u.withColumn("type", F.coalesce("new_type", "type")).withColumn("relations", F.coalesce("new_relations", "relations")).withColumn("ends", _split_points(F.col("cuts"), F.col("text")))
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("ends", i - 1))
    parts = F.transform("ends", lambda e, i: F.struct(i.alias("part"), F.substring(F.col("text"), begin(i) + 1, e - begin(i)).alias("text")))
    u = u.withColumn("p", F.explode(F.coalesce(parts, F.array(F.struct(F.lit(0).alias("part"), F.col("text").alias("text"))))))
    u = u.select("doc", "id", "pos", "p.part", "p.text", "type", F.when(F.col("ends").isNull(), F.col("relations")).alias("relations"), (F.coalesce("joins", F.lit(False)) & (F.col("p.part") == 0)).alias("joins"))
    w = Window.partitionBy("doc").orderBy("pos", "part")
    u = u.withColumn("_new", F.when(F.col("joins") & (F.row_number().over(w) > 1), 0).otherwise(1)).withColumn("unit", F.sum("_new").over(w))
    run = F.sort_array(F.collect_list(F.struct("pos", "part", "id", "type", "relations", "text")))
    first = lambda c: F.get("p", F.lit(0))[c].alias(c)
    return u.groupBy("doc", "unit").agg(run.alias("p")).select("doc", first("id"), first("part"), first("type"), first("relations"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), F.size("p").alias("n"))


def overlay_rejections(units: DataFrame, ops: DataFrame) -> DataFrame:
    """Operations (doc, target, seq, op) that do nothing, with the reason."""
    first = units.groupBy("doc").agg(F.min_by("id", "pos").alias("first"))
    j = ops.join(units.select("doc", F.col("id").alias("target"), "text", F.lit(True).alias("known")), ["doc", "target"], "left").join(first, "doc", "left")
    reason = (
        F.when(~F.col("op").isin("set_type", "set_relations", "merge", "split"), "unsupported_op").when(F.col("known").isNull(), "target_not_found")
        .when((F.col("op") == "merge") & (F.col("target") == F.col("first")), "merge_requires_adjacent_units").when((F.col("op") == "split") & _split_points(F.col("value"), F.col("text")).isNull(), "invalid_split_boundaries")
    )
    return j.select("doc", "target", "seq", "op", reason.alias("reason")).where("reason IS NOT NULL")
