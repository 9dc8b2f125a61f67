"""N-gram Jaccard join: exact, over count vectors of hashed token groups.

A document is the set of its distinct word shingles. Two documents link when
``100 * |A & B| >= percent * |A | B|``. The join works on distinct sets (copies share one
set and add no work) and loses no link:

1. *Groups.* Sets fall into levels of size, each so narrow that linked sets lie in one
   level or in neighbours. In a level at most d shingles can differ between linked sets,
   so shingles are hashed into d + 1 + spare groups: ``spare + 1`` groups at least are
   then equal in both. A set leaves out the ``spare`` weakest of its groups, by an order
   that hangs on a group's content alone (few shingles that are not common ones, then the
   hash); the strongest of the equal groups is left out by neither. The hash of (level,
   group, its shingles) is a key. Which shingles are common is learned from a bounded
   sample; any list gives the same links, a good one keeps boilerplate from routing.
2. *Routing.* Every key links its sets to the smallest of them (one row per set and key,
   never pairs), and the components of these links are clusters: every linked pair lies
   in one cluster.
3. *R-tree.* In a cluster the counts of shingles in GROUPS groups are the points. Points
   are sorted by cluster, size and coordinates over all partitions and packed into leaves
   with bounding boxes, and leaves into inner nodes with theirs, so a large cluster spreads
   over many leaves and tasks. Two nodes, and then two of their leaves, are compared only
   if the summed minima of their upper corners can reach the overlap that their smallest
   sets need; in a pair of leaves the summed minima of coordinates bound the overlap of two
   points.
4. *Verification* counts the shingles that the surviving pairs share. A pair of leaves
   returns a spanning forest of its links and each set's number of links.
5. Components of the forests are the classes.

Sets and shingles are known by 64-bit hashes. Defined cases: null, empty or blank texts
are empty sets, linked with nothing; equal texts and repeated rows are copies and share
a class; a null doc_id never names a class unless all its ids are null; an empty table
gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import HASHES, begin_task, connected_components, materialize, mix, shingle_hashes, signed, table, text_key, text_slices, words

K = 3
PERCENT = 90
#: Share of d that is left out as the weakest groups.
SPARE = 0.3
#: Common shingles: in so large a share of a sample of at most so many texts, and at most so many of them.
COMMON_SHARE, SAMPLE_TEXTS, MOST_COMMON = 0.001, 20_000, 100_000
GROUPS = 32
FAN = 32
#: A leaf closes at this many points or bytes of shingles.
LEAF_POINTS, LEAF_BYTES = 128, 1_500_000
#: Columns of the matrices in which two leaves are compared.
WIDE = 8_192
#: Cluster members up to this many (three numbers each) are broadcast to fetch their texts.
BROADCAST_MEMBERS = 300_000
#: Places of the filter that keeps keys which no other set has from a second shuffle.
FILTER_BITS = 26

SETS = "doc_id long, text_key long, n_shingles long, node long, keys array<long>"
MEMBERS = "cluster long, node long, copies long, n long, point array<int>, shingles binary"
LEAVES = "cluster long, inner long, leaf long, low long, high long, corner array<int>, nodes binary, copies binary, sizes binary, points binary, vocabulary binary, codes binary"
LINKS = "u long, v long, links long"


NONE = np.empty(0, np.uint64)


class Levels:
    """Size levels for one threshold: bounds, and groups and spare groups of each level."""

    def __init__(self, percent: int, top: int = 1 << 33):
        self.percent = percent
        bounds = [1]
        while bounds[-1] < top:
            bounds.append(100 * bounds[-1] // percent + 1)
        self.bounds = np.array(bounds, np.int64)
        most = self.bounds[1:] - 1
        d = (most + 100 * most // percent) * (100 - percent) // (100 + percent)
        self.spare = 1 + (SPARE * d).astype(np.int64)
        self.groups = np.where(d > 0, d + 1 + self.spare, 0)  # with d = 0 only equal sets link

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n, side="right") - 1

    def needed(self, total: np.ndarray) -> np.ndarray:
        """Least overlap of linked sets of this total size."""
        return -(-self.percent * total // (100 + self.percent))


def _sums(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Order-free hashes of what falls into each place: halves are summed exactly."""
    low = np.bincount(at, (x & np.uint64(0xFFFFFFFF)).astype(np.float64), size).astype(np.uint64)
    high = np.bincount(at, (x >> np.uint64(32)).astype(np.float64), size).astype(np.uint64)
    return mix(low + mix(high))


def group_keys(sets: list[np.ndarray], levels: Levels, common: np.ndarray = NONE) -> list[np.ndarray]:
    """Routing keys of every set, for its own level and the one below; ``common`` is sorted."""
    n = np.array([len(s) for s in sets], np.int64)
    own = levels.of(n)
    flat = np.concatenate(sets) if sets else NONE
    owner = np.repeat(np.arange(len(sets)), n)
    mixed = mix(flat + np.uint64(0x5851F42D4C957F2D))
    rare = np.ones(len(flat), bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, flat), len(common) - 1)] != flat
    found, of = [], []
    for step in (0, 1):
        level = own - step
        groups = np.where(level >= 0, levels.groups[level], 0)
        base = np.cumsum(groups) - groups
        live = groups[owner] > 0
        if not live.any():
            continue
        who, x = owner[live], mixed[live]
        at = base[who] + (flat[live] % groups[who].astype(np.uint64)).astype(np.int64)
        size = int(groups.sum())
        doc = np.repeat(np.arange(len(sets)), groups)
        group = np.arange(size) - base[doc]
        strength = np.bincount(at, rare[live], size).astype(np.int64)
        content = _sums(at, x, size)
        order = np.lexsort((content, -strength, doc))
        use = order[group < (groups - levels.spare[level])[doc]]  # ``group`` also counts the places within a set
        found.append(mix(content[use] + mix((level[doc[use]] * 1_000_003 + group[use]).astype(np.uint64))))
        of.append(doc[use])
    if not found:
        return [NONE] * len(sets)
    keys, of = np.concatenate(found), np.concatenate(of)
    keys = keys[np.argsort(of, kind="stable")]
    ends = np.cumsum(np.bincount(of, minlength=len(sets)))
    return np.split(keys, ends[:-1])


def shingle_set(text: str | None, k: int = K) -> np.ndarray:
    w = words(text, lower=True)
    return np.unique(shingle_hashes(HASHES.of(w), k))


def _long_lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(parts) if parts else np.empty(0, np.uint64))))


def _sets(k: int, percent: int, common: np.ndarray):
    def run(batches):
        begin_task("sets")
        levels = Levels(percent)
        for batch in batches:
            ids, text_keys = batch.column(0), batch.column(2)
            for lo, texts in text_slices(batch.column(1)):
                sets = [shingle_set(t, k) for t in texts]
                n = np.array([len(s) for s in sets], np.int64)
                owner = np.repeat(np.arange(len(sets)), n)
                node = _sums(owner, mix(np.concatenate(sets)), len(sets)) + mix(n.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(sets)), text_keys.slice(lo, len(sets)), pa.array(n), pa.array(signed(node), mask=n == 0), _long_lists(group_keys(sets, levels, common))],
                    names=["doc_id", "text_key", "n_shingles", "node", "keys"],
                )

    return run


def _shingles(k: int):
    def run(batches):
        begin_task("shingles")
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                flat = np.concatenate([shingle_set(t, k) for t in texts])
                yield pa.RecordBatch.from_arrays([pa.array(signed(flat))], names=["shingle"])

    return run


def common_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts of the sample have; the sample is cut by the texts' hashes."""
    span = 1 << 40
    place = span if (n := texts.count()) <= SAMPLE_TEXTS else span * SAMPLE_TEXTS // n
    sample = texts.where(F.pmod(text_key("text"), F.lit(span)) < place).select("text").distinct()
    counts = sample.mapInArrow(_shingles(k), "shingle long").groupBy("shingle").count()
    least = max(3, int(COMMON_SHARE * min(n, SAMPLE_TEXTS)))
    rows = counts.where(F.col("count") >= least).orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).select("shingle").collect()
    return np.sort(np.array([r.shingle for r in rows], np.int64).view(np.uint64))


def _members(k: int):
    def run(batches):
        begin_task("members")
        for batch in batches:
            for lo, texts in text_slices(batch.column(3)):
                yield members_batch(*[c.slice(lo, len(texts)) for c in batch.columns[:3]], [shingle_set(t, k) for t in texts])

    return run


def _pack(batches):
    """Consecutive points of a cluster become leaves."""
    names = [f.split()[0] for f in LEAVES.split(", ")]

    def leaf(rows):
        cluster, nodes, copies, n, points, sets = zip(*rows, strict=True)
        p = np.array(points, np.int32)
        # sets of a leaf are alike, so their shingles are told by numbers in a list of their own
        vocabulary, codes = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
        codes = codes.astype(np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32)
        b = lambda x: np.array(x, np.int64).tobytes()
        return [cluster[0], nodes[0], min(n), max(n), p.max(axis=0).tolist(), b(nodes), b(copies), b(n), p.astype(np.uint32).tobytes(), vocabulary.tobytes(), codes.tobytes()]

    def batch_of(leaves):
        types = [pa.int64()] * 5 + [pa.list_(pa.int32())] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*leaves, strict=True), types, strict=True)], names=names)

    begin_task("leaves")
    rows, held, done = [], 0, []
    inner, cluster, of = None, None, 0

    def close(rows):
        """A leaf, under the inner node of its FAN neighbours."""
        nonlocal inner, cluster, of
        x = leaf(rows)
        if x[0] != cluster or of == FAN:
            inner, cluster, of = x[1], x[0], 0
        of += 1
        done.append([x[0], inner, *x[1:]])

    for batch in batches:
        for row in (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
            if rows and row[:2] == rows[-1][:2]:
                continue  # a repeated row
            if rows and (row[0] != rows[0][0] or len(rows) >= LEAF_POINTS or held + len(row[5]) > LEAF_BYTES):
                close(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[5])
            if len(done) >= 20:
                yield batch_of(done)
                done.clear()
    if rows:
        close(rows)
    if done:
        yield batch_of(done)


def _unpack(nodes, copies, sizes, points, vocabulary, codes):
    n = np.frombuffer(sizes, np.int64)
    codes = np.frombuffer(codes, np.uint16 if len(codes) == 2 * int(n.sum()) else np.uint32)
    flat = np.frombuffer(vocabulary, np.uint64)[codes]
    return np.frombuffer(nodes, np.int64), np.frombuffer(copies, np.int64), n, np.frombuffer(points, np.uint32).reshape(len(n), GROUPS), flat, np.cumsum(n) - n


def compare_leaves(a, b, same: bool, levels: Levels):
    """Linked index pairs of two unpacked leaves: bound by counts, then verified."""
    _, _, na, pa_, sa, _ = a
    _, _, nb, pb, sb, _ = b
    ok = (100 * np.minimum.outer(na, nb) >= levels.percent * np.maximum.outer(na, nb))
    if same:
        ok = np.triu(ok, 1)
    need = levels.needed(np.add.outer(na, nb))
    for i in np.flatnonzero(ok.any(axis=1)).tolist():
        js = np.flatnonzero(ok[i])
        ok[i, js] = np.minimum(pa_[i], pb[js]).sum(axis=1) >= need[i, js]
    rows, cols = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
    if not len(rows):
        return rows, cols
    if same:
        vocabulary, code = np.unique(sa, return_inverse=True)
        if len(vocabulary) <= WIDE:
            x = np.zeros((len(na), len(vocabulary)), np.float32)
            x[np.repeat(np.arange(len(na)), na), code] = 1
            shared = (x @ x.T).astype(np.int64)
            return np.nonzero(ok & (100 * shared >= levels.percent * (np.add.outer(na, nb) - shared)))
    # shingles of the sets still in question, as 0 and 1 in a matrix over those that both sides have
    fa, fb = np.isin(np.repeat(np.arange(len(na)), na), rows), np.isin(np.repeat(np.arange(len(nb)), nb), cols)
    both = np.intersect1d(sa[fa], sb[fb])
    shared = np.zeros((len(na), len(nb)), np.float32)
    oa, ob = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    for lo in range(0, len(both), WIDE):
        part = both[lo : lo + WIDE]
        m = []
        for s, f, o, n in ((sa, fa, oa, na), (sb, fb, ob, nb)):
            at = np.minimum(np.searchsorted(part, s), len(part) - 1)
            hit = f & (part[at] == s)
            x = np.zeros((len(n), len(part)), np.float32)
            x[o[hit], at[hit]] = 1
            m.append(x)
        shared += m[0] @ m[1].T
    shared = shared.astype(np.int64)
    return np.nonzero(ok & (100 * shared >= levels.percent * (np.add.outer(na, nb) - shared)))


def spanning_forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges of (u, v) that join two trees, in order."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def _compare(percent: int):
    def run(batches):
        begin_task("links")
        levels = Levels(percent)
        for batch in batches:
            u, v, links = [], [], []
            for row in (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
                same = row[0]
                a = _unpack(*row[1:7])
                b = a if same else _unpack(*row[7:13])
                i, j = compare_leaves(a, b, same, levels)
                if not len(i):
                    continue
                x, y = a[0][i], b[0][j]
                for p, q in spanning_forest(x, y):
                    u.append(p)
                    v.append(q)
                    links.append(0)
                ends, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                total = np.bincount(at, np.concatenate([b[1][j], a[1][i]]).astype(np.float64)).astype(np.int64)
                u += ends.tolist()
                v += [None] * len(ends)
                links += total.tolist()
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(links, pa.int64())], names=["u", "v", "links"])

    return run


def leaf_pairs(leaves: DataFrame, percent: int) -> DataFrame:
    """Pairs of leaves of one cluster whose boxes leave room for a link: pairs of inner nodes
    first, and then the leaves of those, which are dealt over tasks by their nodes."""

    def fits(a, b):
        bound = F.aggregate(F.zip_with(f"{a}.corner", f"{b}.corner", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
        near = (100 * F.col(f"{a}.high") >= percent * F.col(f"{b}.low")) & (100 * F.col(f"{b}.high") >= percent * F.col(f"{a}.low"))
        return near & (bound * (100 + percent) >= percent * (F.col(f"{a}.low") + F.col(f"{b}.low")))

    side = leaves.select("cluster", "inner", "leaf", "low", "high", "corner")
    upper = F.array(*[F.max(F.col("corner")[i]) for i in range(GROUPS)])
    inner = materialize(side.groupBy("cluster", "inner").agg(F.min("low").alias("low"), F.max("high").alias("high"), upper.alias("corner")), "inner-nodes")
    a, b = inner.alias("a"), inner.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.inner") <= F.col("b.inner")) & fits("a", "b"))
    pairs = pairs.select(F.col("a.inner").alias("x"), F.col("b.inner").alias("y"))
    a, b = side.alias("a"), side.alias("b")
    both = pairs.join(a, F.col("x") == F.col("a.inner")).join(b, F.col("y") == F.col("b.inner"))
    both = both.where(((F.col("x") != F.col("y")) | (F.col("a.leaf") <= F.col("b.leaf"))) & fits("a", "b"))
    return both.select(F.col("a.leaf").alias("leaf_a"), F.col("b.leaf").alias("leaf_b"))


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits of FILTER_BITS places that the keys (key) fall on, gathered as words: of one size however many keys."""
    place = f"(key & {(1 << FILTER_BITS) - 1})"
    words = keys.select(F.expr(f"shiftright({place}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({place} & 63 AS int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[np.asarray(found.column(0))] = np.asarray(found.column(1))
    return out.view(np.uint64)


def _passing(bits: np.ndarray):
    def run(batches):
        begin_task("keys")
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            lists = batch.column(1)
            key = lists.flatten().to_numpy(zero_copy_only=False)
            node = np.repeat(np.asarray(batch.column(0)), np.asarray(lists.value_lengths()))
            place = key.view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
            ok = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            yield pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array(key[ok])], names=["node", "key"])

    return run


def rows_with(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (node, key) of sets (node, list of keys) that ``keys`` may hold: those it holds, and a few more.

    A filter of fixed size goes to the tasks, so most keys are never shuffled again."""
    return materialize(sets.mapInArrow(_passing(key_filter(keys)), "node long, key long"), "met-keys")


def shared_cells(keys: DataFrame) -> DataFrame:
    """(key, low) of the keys that several nodes have, from rows (node, key); low is the least of them."""
    return keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")


def route(keys: DataFrame) -> DataFrame:
    """Clusters (node, cluster) of the nodes that share a key, from rows (node, key)."""
    routes = keys.join(shared_cells(keys), "key").where("node != low").select(F.col("low").alias("src"), F.col("node").alias("dst")).distinct()
    return connected_components(routes).select("node", F.col("component").alias("cluster"))


def verified_links(members: DataFrame, percent: int) -> DataFrame:
    """Links within clusters: forest edges (u, v), and each linked set's count (u, null, links)."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["cluster", "n", *[F.col("point")[i] for i in range(4)], "node"]
    leaves = materialize(members.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_pack, LEAVES), "leaves")
    body = ["nodes", "copies", "sizes", "points", "vocabulary", "codes"]
    side = lambda s: leaves.select(F.col("leaf").alias(f"leaf_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in body])
    rows = leaf_pairs(leaves, percent).join(side("a"), "leaf_a").join(side("b"), "leaf_b")
    found = rows.select((F.col("leaf_a") == F.col("leaf_b")).alias("same"), *[f"{c}_a" for c in body], *[f"{c}_b" for c in body])
    return materialize(found.mapInArrow(_compare(percent), LINKS), "links")


def point_of(s: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles in GROUPS groups."""
    return np.bincount((s >> np.uint64(32)).astype(np.int64) % GROUPS, minlength=GROUPS).astype(np.int32)


def members_batch(cluster, node, copies, sets: list[np.ndarray]) -> pa.RecordBatch:
    ends = (np.arange(len(sets) + 1) * GROUPS).astype(np.int32)
    points = np.concatenate([point_of(s) for s in sets]) if sets else np.empty(0, np.int32)
    return pa.RecordBatch.from_arrays(
        [cluster, node, copies, pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(points)), pa.array([s.tobytes() for s in sets], pa.binary())],
        names=["cluster", "node", "copies", "n", "point", "shingles"],
    )


def _fetch(texts: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """Shingles and points of the chosen sets, from the text of one document of each.

    ``chosen`` has a row per set: it is broadcast up to BROADCAST_MEMBERS rows, else the
    texts are shuffled to it."""
    pick = chosen.select("cluster", F.col("node").alias("_node"), "copies", F.col("text_key").alias("_text"), F.col("pick").alias("_pick"))
    if chosen.count() <= BROADCAST_MEMBERS:
        pick = F.broadcast(pick)
    keyed = texts.withColumn("text_key", text_key("text"))
    same = (F.col("text_key") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_pick"))
    return keyed.join(pick, same).select("cluster", F.col("_node").alias("node"), "copies", "text").mapInArrow(_members(k), MEMBERS)


def _classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of ``jaccard_classes`` with their class, the least set of it; empty sets have none."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = materialize(texts.withColumn("text_key", text_key("text")).mapInArrow(_sets(k, percent, common_shingles(texts, k)), SETS), "sets")
    filled = sets.where("node IS NOT NULL")
    nodes = materialize(filled.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("text_key").alias("text_key"), F.count("*").alias("copies")), "nodes")

    cells = materialize(shared_cells(sets.select("node", F.explode("keys").alias("key"))).select("key"), "cells")
    clusters = route(rows_with(filled.select("node", "keys"), cells))

    inside = clusters.join(nodes, "node").select("cluster", "node", "copies", "text_key")
    picks = filled.select("node", "text_key", "doc_id").join(inside, ["node", "text_key"]).groupBy("cluster", "node", "copies", "text_key").agg(F.min("doc_id").alias("pick"))
    members = materialize(_fetch(texts, materialize(picks, "picks"), k), "members")
    links = verified_links(members, percent)
    classes = connected_components(links.where("v IS NOT NULL"), "u", "v")
    first = classes.join(nodes, "node").groupBy("component").agg(F.min("first").alias("class_first"))
    counts = links.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.join(first, "component").join(counts, "node", "left").select("node", "component", "class_first", "links")
    final = nodes.join(named, "node", "left").select(
        "node", F.coalesce("class_first", "first").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("class")
    )
    # written first, so that Spark may split a set with very many copies in the join
    return sets.join(materialize(final, "set-classes"), "node", "left").select(
        "doc_id", "text_key", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "class"
    )


def jaccard_classes(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, text_key, n_shingles, component_id, n_links), one per row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable by links; n_links counts the other
    documents that a document links with, copies included."""
    return _classes(docs, k, percent).drop("class")


def keep_one(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each class: that of the smallest doc_id, columns unchanged.

    Among texts of one doc_id the one of the smallest key stays, rows without a doc_id come
    last, and empty texts stay once for each doc_id and key."""
    classes = materialize(_classes(docs, k, percent).select("doc_id", "text_key", "class"), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    stay = classes.where("class IS NOT NULL").groupBy("class").agg(first).select("first.doc_id", "first.text_key")
    stay = stay.union(classes.where("class IS NULL").select("doc_id", "text_key").distinct())
    stay = stay.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"))
    keyed = docs.withColumn("_key", text_key("text"))
    kept = keyed.join(stay, (F.col("_key") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    if not classes.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():  # repeated rows
        kept = kept.dropDuplicates(["doc_id", "_key"])
    return kept.drop("_key")


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("text_key")


PAIRS = r"""
j_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
j_sets AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM j_words),
j_sizes AS (SELECT doc_id, count(*) AS n FROM j_sets GROUP BY doc_id),
j_rare AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS r FROM j_sets JOIN (SELECT g, count(*) AS df FROM j_sets GROUP BY g) USING (g)),
j_front AS (SELECT doc_id, g FROM j_rare JOIN j_sizes USING (doc_id) WHERE r <= n - ceil(0.9 * n) + 1),
j_maybe AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM j_front a JOIN j_front b ON a.g = b.g AND a.doc_id < b.doc_id),
j_common AS (SELECT x, y, count(*) AS c FROM j_maybe JOIN j_sets a ON a.doc_id = x JOIN j_sets b ON b.doc_id = y AND a.g = b.g GROUP BY x, y),
j_links AS (SELECT x, y FROM j_common JOIN j_sizes a ON a.doc_id = x JOIN j_sizes b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
j_both AS (SELECT x, y FROM j_links UNION ALL SELECT y, x FROM j_links),
j_reach AS (SELECT x, y FROM j_both UNION SELECT r.x, b.y FROM j_reach r JOIN j_both b ON r.y = b.x),
j_classes AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, coalesce(k, 0)::BIGINT AS n_links
              FROM {docs} d LEFT JOIN j_sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM j_reach GROUP BY x) USING (doc_id)
              LEFT JOIN (SELECT x AS doc_id, count(*) AS k FROM j_both GROUP BY x) USING (doc_id))
"""

#: Candidates by rare shingles (exact for this threshold), links, and their closure.
ORACLE = "WITH RECURSIVE " + PAIRS.replace("{docs}", "documents") + "SELECT doc_id, n_shingles, component_id, n_links FROM j_classes"
