"""Graphs and fixpoints: closure, cycles, propagation, freshness, audits, regions.

Every loop joins only what is new and writes each round to a shared table; it ends when a
round adds nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.operators.intervals import overlapping
from stemma.sources.tables import materialize

#: Hops that one round of a propagation takes.
HOPS = 2


def closure(edges: DataFrame) -> DataFrame:
    """All (node, ancestor) reachable by (child, parent) edges; cycles are no trouble.

    Paths double in length each round: pairs new in the last round are joined to all before and after."""
    found = new = materialize(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("node IS NOT NULL AND ancestor IS NOT NULL").distinct(), "closure")
    while not new.isEmpty():  # a round writes what it found, never what was found before
        chain = lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor")
        step = chain(new, found).union(chain(found, new)).distinct()
        new = materialize(step.join(found, ["node", "ancestor"], "left_anti"), "closure")
        found = found.union(new)
    return found


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: every node on some cycle, each once; null ends are no edges.

    Nodes without an edge in or out go, and of nodes with one edge in and one out those that come first
    among their neighbours by a hash are taken out and bridged, round by round: long chains and cycles
    shrink by a constant share each time. What is left falls into strong components by colours. A node
    taken out lies on a cycle exactly if its bridge does. A round writes the edges that are left and the
    nodes that it took out. Every cycle leads up and down in the order of nodes: edges of one direction have none."""
    e = materialize(edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct(), "edges")
    if e.where("child <= parent").isEmpty() or e.where("child >= parent").isEmpty():
        return e.where("false").select(F.col("child").alias("node"))
    within = [e.where("child = parent")]
    e = e.where("child != parent")
    taken, n, salt = [], e.count(), 0
    while n:
        none = F.lit(None).cast(dict(e.dtypes)["child"])
        ends = e.select(F.col("child").alias("node"), none.alias("before"), F.col("parent").alias("after")).union(e.select("parent", "child", none))
        nodes = materialize(ends.groupBy("node").agg(F.count("before").alias("n_in"), F.count("after").alias("n_out"), F.max("before").alias("before"), F.max("after").alias("after")), "nodes")
        bare = nodes.where("n_in = 0 OR n_out = 0").select("node")
        inner = nodes.where("n_in = 1 AND n_out = 1").select("node", "before", "after", F.struct(F.xxhash64(F.lit(salt), "node"), "node").alias("order"))
        later = inner.select("node", "order", "after").join(inner.select(F.col("node").alias("after"), F.col("order").alias("next")), "after")
        beaten = later.select(F.when(F.col("order") < F.col("next"), F.col("after")).otherwise(F.col("node")).alias("node"))
        out = materialize(inner.join(beaten, "node", "left_anti").select("node", "before", "after"), "taken")
        gone = bare.union(out.select("node"))
        lacks = lambda df, c, x: df.join(x.select(F.col("node").alias(c)), c, "left_anti")
        kept = lacks(lacks(e, "child", gone), "parent", gone).select("child", "parent")
        bridges = lacks(lacks(out.select(F.col("before").alias("child"), F.col("after").alias("parent")), "child", bare), "parent", bare).select("child", "parent")
        left = materialize(kept.union(bridges).distinct(), "edges")
        taken.append(out)
        within.append(left.where("child = parent"))
        e = left.where("child != parent")
        before, n, salt = n, e.count(), salt + 1
        if n == before:
            break
    if n:
        within += _component_edges(e)
    known = within[0]
    for w in within[1:]:
        known = known.union(w.select("child", "parent"))
    for out in reversed(taken):
        hit = materialize(out.join(known.select(F.col("child").alias("before"), F.col("parent").alias("after")), ["before", "after"], "left_semi"), "on-cycles")
        known = known.union(hit.select("before", "node")).union(hit.select("node", "after"))
    return known.select(F.col("child").alias("node")).union(known.select("parent")).distinct()


def _component_edges(e: DataFrame) -> list[DataFrame]:
    """The edges (child, parent) inside strong components.

    Every node takes the greatest node that reaches it as its colour. What reaches that node within
    the colour is its component; edges between colours lie in none. The rest is coloured again. Rounds
    join and write only what changed in the last one."""
    found = []
    while not e.isEmpty():
        frontier = materialize(e.select(F.col("child").alias("node")).union(e.select("parent")).distinct().withColumn("colour", F.col("node")), "colours")
        all_ = frontier
        while True:
            now = all_.groupBy("node").agg(F.max("colour").alias("colour"))
            reach = e.join(frontier.withColumnRenamed("node", "child"), "child").groupBy(F.col("parent").alias("node")).agg(F.max("colour").alias("new"))
            frontier = materialize(reach.join(now, "node").where("new > colour").select("node", F.col("new").alias("colour")), "colours")
            if frontier.isEmpty():
                break
            all_ = all_.union(frontier)
        of = lambda c: now.select(F.col("node").alias(c), "colour")
        e = materialize(e.join(of("child"), "child").join(of("parent"), ["parent", "colour"]).select("child", "parent", "colour"), "edges")
        part = new = now.where("node = colour").select("node", "colour")
        while True:
            new = materialize(e.join(new.withColumnRenamed("node", "parent"), ["parent", "colour"]).select(F.col("child").alias("node"), "colour").distinct().join(part, ["node", "colour"], "left_anti"), "component")
            if new.isEmpty():
                break
            part = part.union(new)
        at = lambda c, how: (lambda df: df.join(part.select(F.col("node").alias(c)), c, how))
        found.append(materialize(at("parent", "left_semi")(at("child", "left_semi")(e)).select("child", "parent"), "component-edges"))
        e = materialize(at("parent", "left_anti")(at("child", "left_anti")(e)).select("child", "parent"), "edges")
    return found


def propagate_inactive(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id, active) and edges (child, parent): active nodes below an inactive one need review,
    and so do those with a parent that does not exist.

    The frontier holds only nodes that fell in the last round, and a round takes HOPS steps along edges of
    nodes that are still open, until a round adds nothing. Open nodes with a single open parent fall exactly if
    that does, so edges to them lead on to it: chains halve each round. Edges to nodes that can't fall go."""
    known = materialize(nodes.select("id", "active"), "nodes")
    inner = materialize(edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct().join(known.where("active").select(F.col("id").alias("child")), "child", "left_semi"), "dependencies")
    lost = inner.join(known.select(F.col("id").alias("parent")), "parent", "left_anti").select(F.col("child").alias("id")).distinct()
    hit = materialize(lost, "fallen")
    found, frontier = [hit], hit.union(known.where("NOT active").select("id"))
    open_ = inner
    while True:
        open_ = open_.join(hit.withColumnRenamed("id", "child"), "child", "left_anti")
        reach = below = frontier
        for _ in range(HOPS):
            below = open_.join(below.withColumnRenamed("id", "parent"), "parent", "left_semi").select(F.col("child").alias("id")).distinct()
            reach = below if reach is frontier else reach.union(below)
        hit = frontier = materialize(reach.distinct(), "fallen")
        if hit.isEmpty():
            break
        found.append(hit)
        if len(found) > 16:
            found = [materialize(reduce(DataFrame.union, found), "seen")]
        left = open_.join(hit.withColumnRenamed("id", "child"), "child", "left_anti")
        left = left.join(left.select(F.col("child").alias("parent")).union(hit), "parent", "left_semi").select("child", "parent")
        ahead = left.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("next")).where("n = 1").select(F.col("child").alias("parent"), "next")
        open_ = materialize(left.join(ahead, "parent", "left").select("child", F.coalesce("next", "parent").alias("parent")).distinct(), "dependencies")
    seen = reduce(DataFrame.union, found).distinct()
    f = seen.select(F.col("id").alias("fallen_id"))
    status = F.when(~F.col("active"), "inactive").when(F.col("fallen_id").isNotNull(), "needs_revalidation").otherwise("active")
    return known.join(f, F.col("id") == F.col("fallen_id"), "left").select("id", status.alias("status"))


def artifact_freshness(artifacts: DataFrame, parents: DataFrame, units: DataFrame, current: DataFrame) -> DataFrame:
    """Artifacts (id) are stale if a unit (id, unit, hash) changed or went, a parent is stale, missing, or they lie on a cycle."""
    leaf = units.join(current.select("unit", F.col("hash").alias("now")), "unit", "left").where("now IS NULL OR now != hash").select("id")
    lost = parents.join(artifacts.select(F.col("id").alias("parent")), "parent", "left_anti").select(F.col("child").alias("id"))
    own = leaf.union(lost).union(on_cycles(parents).select(F.col("node").alias("id"))).distinct().withColumn("bad", F.lit(True))
    nodes = artifacts.select("id").join(own, "id", "left").select("id", F.col("bad").isNull().alias("active"))
    status = propagate_inactive(nodes, parents)
    return status.select("id", F.when(F.col("status") == "active", "fresh").otherwise("stale").alias("freshness"))


def graph_audit(events: DataFrame, ports: DataFrame, values: DataFrame, required: DataFrame) -> DataFrame:
    """Defect rows (defect, id, detail): dangling reads, missing producers, wrong ports, missing sources and ports.

    ``events``: event_id, kind, n_sources; ``ports``: event_id, direction, port, value_id;
    ``values``: value_id, producer, output_port; ``required``: kind, port."""
    d = lambda df, name, i, x: df.select(F.lit(name).alias("defect"), F.col(i).cast("string").alias("id"), F.col(x).cast("string").alias("detail"))
    dangling = ports.where("direction = 'read'").join(values, "value_id", "left_anti")
    orphan = values.where("producer IS NOT NULL").join(events, F.col("producer") == F.col("event_id"), "left_anti")
    writes = ports.where("direction = 'write'").select("event_id", "value_id", F.col("port").alias("written"))
    wrong = values.join(writes, (F.col("producer") == F.col("event_id")) & (values["value_id"] == writes["value_id"])).where("written != output_port").select(values["value_id"], "written")
    bare = events.where("n_sources = 0")
    wanted = events.join(required, "kind").select("event_id", "port")
    missing = wanted.join(ports.select("event_id", "port"), ["event_id", "port"], "left_anti")
    parts = [d(dangling, "dangling_read", "event_id", "value_id"), d(orphan, "missing_producer", "value_id", "producer"), d(wrong, "wrong_output_port", "value_id", "written"), d(bare, "missing_source", "event_id", "kind"), d(missing, "missing_port", "event_id", "port")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def fixpoint_region(seeds: DataFrame, spans: DataFrame, doc: str, bucket: int = 256) -> DataFrame:
    """Spans (doc, id, start, end) reached from seed spans by overlaps.

    Spans that hang together by overlaps are the islands of one sorted pass; those of the islands in
    which a seed overlaps a span are the answer, without rounds."""
    w = Window.partitionBy(doc).orderBy("start", "end", "id")
    s = spans.where("start < end").withColumn("_before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("_island", F.sum(F.when(F.col("_before").isNull() | (F.col("start") >= F.col("_before")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = materialize(s.select(F.col(doc).alias("doc"), "id", "_island"), "islands")
    hit = overlapping(spans.where("start < end"), seeds, doc, bucket).select("doc", F.col("left_id").alias("id")).distinct()
    return s.join(s.join(hit, ["doc", "id"], "left_semi").select("doc", "_island").distinct(), ["doc", "_island"], "left_semi").select("doc", "id")
