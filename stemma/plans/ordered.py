"""Queries of windows, differences, spans and membership (sections 2.5, 2.7 and parts of 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.operators import diffs as D
from stemma.operators import intervals as I
from stemma.operators import windows as W
from stemma.plans.registry import query

c = F.col


@query("w1_fill_sequence_gaps", """
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, event_id FROM events), n AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 11 = 0 THEN pos + 5 ELSE pos END AS number FROM e),
x AS (SELECT *, last_value(CASE WHEN number IS NOT NULL THEN {'p': pos, 'n': number} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos) AS b,
  first_value(CASE WHEN number IS NOT NULL THEN {'p': pos, 'n': number} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM n)
SELECT user_id, pos, number, coalesce(number, CASE WHEN a.n - b.n = a.p - b.p THEN b.n + pos - b.p END) AS filled FROM x""")
def w1(t):
    from pyspark.sql import Window

    e = t("events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    e = e.withColumn("number", F.when(c("event_id") % 3 == 0, None).when(c("event_id") % 11 == 0, c("pos") + 5).otherwise(c("pos")))
    return W.fill_sequence_gaps(e.select("user_id", "pos", "number"), "user_id", "pos", "number")


@query("w2_sequence_audit", """
WITH m AS (SELECT o_custkey AS k, o_orderkey AS pos, (o_orderkey % 12)::INT AS number FROM orders)
SELECT k, number, 'duplicate' AS issue FROM m GROUP BY k, number HAVING count(*) > 1
UNION ALL SELECT k, n, 'missing' FROM (SELECT DISTINCT k FROM m), (SELECT unnest(range(1, 11))::INT AS n) WHERE (k, n) NOT IN (SELECT (k, number) FROM m)
UNION ALL SELECT k, number, 'falls_back' FROM (SELECT *, lag(number) OVER (PARTITION BY k ORDER BY pos) AS b FROM m) WHERE number < b
UNION ALL SELECT k, number, 'outside' FROM m WHERE number < 1 OR number > 10""")
def w2(t):
    m = t("orders").select(c("o_custkey").alias("k"), c("o_orderkey").alias("pos"), (c("o_orderkey") % 12).cast("int").alias("number"))
    return W.sequence_audit(m, "k", "pos", "number", 1, 10)


@query("w3_context_windows", """
WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderkey AS first, o_orderkey + 10 AS last FROM orders),
n AS (SELECT *, lead(id) OVER w AS i2, lead(first) OVER w AS f2, lead(last) OVER w AS l2 FROM s WINDOW w AS (PARTITION BY k ORDER BY first, id))
SELECT k, [id] AS members, first, last FROM s UNION ALL SELECT k, [id, i2], first, greatest(last, l2) FROM n WHERE f2 - last <= 500""")
def w3(t):
    k = c("o_orderkey")
    return W.context_windows(t("orders").select(c("o_custkey").alias("k"), k.alias("id"), k.alias("first"), (k + 10).alias("last")), "k", 500)


@query("w4_neighbor_context", """
SELECT conv_id, turn, lag(role) OVER w AS previous_role, lead(role) OVER w AS next_role, lag(text) OVER w AS previous_text, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def w4(t):
    return W.neighbor_context(t("conversations"), "conv_id", ["turn"], "role", "text").drop("role", "text")


@query("w5_relative_order", """
SELECT conv_id, turn, CASE WHEN n > 1 THEN p / (n - 1) ELSE 0.0 END AS place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
def w5(t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    return t("conversations").select("conv_id", "turn", W.relative_order(F.row_number().over(w.orderBy("turn")) - 1, F.count("*").over(w)).alias("place"))


@query("w6_join_continuations", """
WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e)
SELECT user_id, island::BIGINT AS island, min(event_id) AS first, max(event_id) AS last, count(*) AS n, min(event_type) AS event_type FROM i GROUP BY user_id, island""")
def w6(t):
    from pyspark.sql import Window

    same = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")) == c("event_type")
    i = W.islands(t("events"), "user_id", ["event_id"], same)
    return i.groupBy("user_id", "island").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("n"), F.min("event_type").alias("event_type"))


@query("w7_attach_to_previous", """
WITH u AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'procedure' WHEN 'click' THEN 'alternative' WHEN 'error' THEN 'follow_up' ELSE 'text' END AS kind FROM events),
x AS (SELECT *, last_value(CASE WHEN kind = 'procedure' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near,
  CASE WHEN lag(kind) OVER w = 'procedure' THEN lag(event_id) OVER w END AS adj FROM u WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
y AS (SELECT *, CASE kind WHEN 'alternative' THEN near WHEN 'follow_up' THEN adj END AS attached_to FROM x)
SELECT user_id, event_id, kind, attached_to, kind IN ('alternative', 'follow_up') AND attached_to IS NULL AS review FROM y""")
def w7(t):
    kind = F.when(c("event_type") == "purchase", "procedure").when(c("event_type") == "click", "alternative").when(c("event_type") == "error", "follow_up").otherwise("text")
    return W.attach_to_previous(t("events").select("user_id", "event_id", kind.alias("kind")), "user_id", ["event_id"], "kind", "event_id")


@query("w10_order_alignment", """
WITH a AS (SELECT conv_id AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role <> 'user'),
n AS (SELECT k, least(any_value(a.n), any_value(b.n)) AS m FROM a JOIN b USING (k) GROUP BY k),
l AS (SELECT k, (pos * m) // n AS bucket, list_sort(list(pos)) AS lefts FROM a JOIN n USING (k) GROUP BY ALL), r AS (SELECT k, (pos * m) // n AS bucket, list_sort(list(pos)) AS rights FROM b JOIN n USING (k) GROUP BY ALL)
SELECT k, bucket, lefts, rights FROM l JOIN r USING (k, bucket)""")
def w10(t):
    from pyspark.sql import Window

    m = t("conversations").withColumn("user", c("role") == "user")
    m = m.select(c("conv_id").alias("k"), "user", (F.row_number().over(Window.partitionBy("conv_id", "user").orderBy("turn")) - 1).cast("long").alias("pos"))
    return W.order_alignment(m.where("user").drop("user"), m.where("NOT user").drop("user"), "k")


@query("s6_scope_lines", """
WITH e AS (SELECT *, max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS op FROM events),
s AS (SELECT *, max((op = 1 AND event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS st FROM e) SELECT user_id, event_id FROM s WHERE op = 1 AND st = 0""")
def s6(t):
    return W.scope_lines(t("events"), "user_id", ["event_id"], "event_type", "^purchase$", "^error$").select("user_id", "event_id")


@query("w12_stable_lead", """
WITH s AS (SELECT user_id, event_type, sum(value::DECIMAL(28,10)) AS score FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS runner_up FROM s WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, event_type))
SELECT user_id, event_type, score::DOUBLE AS score, runner_up::DOUBLE AS runner_up FROM r WHERE r = 1 AND score >= 100 AND (runner_up IS NULL OR score - runner_up >= 50)""")
def w12(t):
    """Users' leading kinds of events; sums are exact, as sums of doubles hang on the order of rows and decide ties and gaps."""
    from stemma.operators.topk import stable_lead

    sums = t("events").groupBy("user_id", "event_type").agg(F.sum(c("value").cast("decimal(28,10)")).alias("score"))
    lead = stable_lead(sums, ["user_id"], "score", "event_type", 100, 50)
    return lead.withColumns({x: c(x).cast("double") for x in ("score", "runner_up")})


@query("d2_snapshot_diff", """
WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_discount) AS occurrence FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_orderkey % 5 <> 0 OR l_orderkey % 7 = 0)),
a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_discount) AS occurrence FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_discount FROM lineitem WHERE l_orderkey % 7 <> 0 OR l_orderkey % 5 = 0)),
j AS (SELECT l_orderkey, l_linenumber, occurrence, b.l_quantity AS bq, a.l_quantity AS aq, b.l_discount AS bd, a.l_discount AS ad FROM b FULL JOIN a USING (l_orderkey, l_linenumber, occurrence)),
x AS (SELECT *, CASE WHEN bq IS NULL OR aq IS NULL THEN []::VARCHAR[] ELSE list_filter([CASE WHEN bq <> aq THEN 'l_quantity' END, CASE WHEN bd <> ad THEN 'l_discount' END], lambda v: v IS NOT NULL) END AS changed FROM j)
SELECT l_orderkey, l_linenumber, occurrence, CASE WHEN bq IS NULL THEN 'added' WHEN aq IS NULL THEN 'removed' WHEN len(changed) > 0 THEN 'changed' ELSE 'unchanged' END AS status, changed FROM x""")
def d2(t):
    i = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_partkey")
    after = i.where("l_orderkey % 7 != 0 OR l_orderkey % 5 = 0").withColumn("l_quantity", F.when(c("l_partkey") % 9 == 0, c("l_quantity") + 1).otherwise(c("l_quantity")))
    return D.snapshot_diff(i.where("l_orderkey % 5 != 0 OR l_orderkey % 7 = 0"), after, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"])


@query("d1_overlap_ratio", """
SELECT p_partkey, len(list_intersect(list_distinct(string_split(p_name, ' ')), list_distinct(string_split(lower(p_type), ' ')))) / greatest(len(list_distinct(string_split(p_name, ' ') || string_split(lower(p_type), ' '))), 1) AS ratio FROM part""")
def d1(t):
    from stemma.functions.text import overlap_ratio

    return t("part").select("p_partkey", overlap_ratio(F.split("p_name", " "), F.split(F.lower("p_type"), " ")).alias("ratio"))


@query("d3_canonical_hash", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS hash FROM orders""")
def d3(t):
    return t("orders").select("o_orderkey", D.canonical_hash("o_orderkey", "o_custkey", "o_orderstatus").alias("hash"))


@query("d4_partition_diff", """
WITH i AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS pos, floor(l_quantity)::BIGINT AS length, l_returnflag AS type FROM lineitem),
h AS (SELECT doc, CASE WHEN pos = 3 THEN 2 ELSE pos END AS pos, sum(length)::BIGINT AS length, min(type) AS type FROM i GROUP BY ALL),
f AS (SELECT doc, CASE WHEN (pos = 4 AND doc % 2 = 0) OR pos = 6 THEN pos - 1 ELSE pos END AS pos, sum(length)::BIGINT AS length, min(CASE WHEN pos = 1 AND doc % 3 = 0 THEN 'Z' ELSE type END) AS type FROM i GROUP BY ALL),
b AS (SELECT doc, sum(length) OVER (PARTITION BY doc ORDER BY pos) AS pt, type, 'base' AS side FROM h), g AS (SELECT doc, sum(length) OVER (PARTITION BY doc ORDER BY pos) AS pt, type, 'final' AS side FROM f),
m AS (SELECT doc, pt FROM b JOIN g USING (doc, pt)), e AS (SELECT x.doc, x.pt, x.type, x.side, count(m.pt) AS region FROM (SELECT * FROM b UNION ALL SELECT * FROM g) x LEFT JOIN m ON m.doc = x.doc AND m.pt < x.pt GROUP BY ALL),
r AS (SELECT doc, region, count(*) FILTER (WHERE side = 'base') AS n_base, count(*) FILTER (WHERE side = 'final') AS n_final, max(type) FILTER (WHERE side = 'base') AS tb, max(type) FILTER (WHERE side = 'final') AS tf FROM e GROUP BY ALL),
z AS (SELECT doc, region, n_base, n_final, CASE WHEN n_base = 1 AND n_final = 1 THEN CASE WHEN tb <> tf THEN 'set_type' END WHEN n_base > n_final THEN 'merge' WHEN n_base < n_final THEN 'split' ELSE 'resegment' END AS op FROM r) SELECT * FROM z WHERE op IS NOT NULL""")
def d4(t):
    """Orders as texts, cut by lines: the base joins lines two and three, the final partition three and
    four or none, and five and six, and retypes the first line of some."""
    from pyspark.sql import Window

    p, d = c("pos"), c("doc")
    i = t("lineitem").select(c("l_orderkey").alias("doc"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")).alias("pos"), F.floor("l_quantity").alias("length"), c("l_returnflag").alias("type"))
    cut = lambda at, kind: i.groupBy("doc", at.alias("p")).agg(F.sum("length").alias("length"), F.min(kind).alias("type")).withColumnRenamed("p", "pos")
    base = cut(F.when(p == 3, 2).otherwise(p), c("type"))
    final = cut(F.when(((p == 4) & (d % 2 == 0)) | (p == 6), p - 1).otherwise(p), F.when((p == 1) & (d % 3 == 0), "Z").otherwise(c("type")))
    return D.partition_diff(base, final, "doc")


SPANS_OF = "SELECT o_custkey AS doc, o_orderkey AS id, o_orderkey % 300 AS s, o_orderkey % 300 + 5 + o_orderkey % 40 AS e FROM orders"


def order_spans(t):
    k = c("o_orderkey")
    return t("orders").select(c("o_custkey").alias("doc"), k.alias("id"), (k % 300).alias("start"), (k % 300 + 5 + k % 40).alias("end"))


@query("d5_migration_plan", f"""
WITH s AS ({SPANS_OF}), n AS (SELECT doc, id, s + CASE WHEN id % 10 = 0 THEN 400 ELSE 0 END AS s, e + CASE WHEN id % 10 = 0 THEN 400 ELSE 0 END AS e FROM s),
o AS (SELECT a.id, count(*) AS n, max((a.e - a.s = b.e - b.s)::INT) AS same FROM s a JOIN n b ON a.doc = b.doc AND a.s < b.e AND b.s < a.e GROUP BY a.id)
SELECT id, CASE WHEN n = 1 AND same = 1 THEN 'unchanged' WHEN n IS NULL THEN 'gone' ELSE 'review' END AS plan FROM s LEFT JOIN o USING (id)""")
def d5(t):
    s = order_spans(t)
    shift = F.when(c("id") % 10 == 0, 400).otherwise(0)
    n = s.select("doc", "id", (c("start") + shift).alias("start"), (c("end") + shift).alias("end"))
    o = I.overlapping(s, n, "doc", 64).withColumns({"old_signature": c("left_end") - c("left_start"), "new_signature": c("right_end") - c("right_start")})
    return D.migration_plan(s.withColumnRenamed("id", "left_id"), o, "left_id", "right_id").withColumnRenamed("left_id", "id")


@query("d6_union_ids", "SELECT c_custkey AS id FROM customer UNION SELECT o_custkey FROM orders")
def d6(t):
    return D.union_ids(t("customer").select(c("c_custkey").alias("id")), t("orders").select(c("o_custkey").alias("id")), "id")


@query("d7_merge_preserving", """
WITH e AS (SELECT p_partkey AS id, p_brand AS machine, CASE WHEN p_partkey % 3 = 0 THEN 'note ' || p_partkey END AS note, CASE WHEN p_partkey % 4 = 0 THEN 'accepted' END AS review_status FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 = 0),
f AS (SELECT p_partkey AS id, p_type AS machine, NULL::VARCHAR AS note, NULL::VARCHAR AS review_status FROM part WHERE p_partkey % 5 <> 0)
SELECT id, coalesce(f.machine, e.machine) AS machine, coalesce(e.note, f.note) AS note, coalesce(e.review_status, f.review_status, 'unreviewed') AS review_status FROM f FULL JOIN e USING (id)""")
def d7(t):
    p, k = t("part"), c("p_partkey")
    e = p.where((k % 2 == 0) | (k % 5 == 0)).select(k.alias("id"), c("p_brand").alias("machine"), F.when(k % 3 == 0, F.concat(F.lit("note "), k)).alias("note"), F.when(k % 4 == 0, "accepted").alias("review_status"))
    f = p.where(k % 5 != 0).select(k.alias("id"), c("p_type").alias("machine"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("review_status"))
    return D.merge_preserving(e, f, "id", ["note", "review_status"], ["machine"])


@query("d8_dataset_fingerprint", """
WITH h AS (SELECT sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}') AS h FROM nation JOIN customer ON c_nationkey = n_nationkey)
SELECT count(*) AS n, sum(('0x' || h[1:8])::BIGINT)::DECIMAL(38,0) AS p0, sum(('0x' || h[9:16])::BIGINT)::DECIMAL(38,0) AS p1, sum(('0x' || h[17:24])::BIGINT)::DECIMAL(38,0) AS p2, sum(('0x' || h[25:32])::BIGINT)::DECIMAL(38,0) AS p3 FROM h""")
def d8(t):
    return D.dataset_fingerprint(t("nation").join(t("customer"), c("c_nationkey") == c("n_nationkey")), "n_nationkey", "n_name")


ISLANDS = f"""s AS ({SPANS_OF}), m AS (SELECT *, max(e) OVER (PARTITION BY doc ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
i AS (SELECT *, sum((b IS NULL OR s > b)::INT) OVER (PARTITION BY doc ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS isl FROM m), r AS (SELECT doc, min(s) AS s, max(e) AS e FROM i GROUP BY doc, isl)"""


@query("c16_char_coverage", f"""
WITH {ISLANDS}, p AS (SELECT doc, sum(e - s)::BIGINT AS covered, count(*) AS ranges, min(s) AS f, max(e) AS l FROM r GROUP BY doc)
SELECT c_custkey AS doc, 340 AS length, coalesce(covered, 0) AS covered, coalesce(ranges, 0) AS ranges, CASE WHEN ranges IS NULL THEN 1 ELSE ranges - 1 + (f > 0)::INT + (l < 340)::INT END AS gaps FROM customer LEFT JOIN p ON doc = c_custkey""")
def c16(t):
    return I.char_coverage(t("customer").select(c("c_custkey").alias("doc"), F.lit(340).alias("length")), order_spans(t), "doc", "length")


@query("c19_atomic_segments", f"""
WITH s AS (SELECT * FROM ({SPANS_OF}) WHERE e <= 300 AND s < e), b AS (SELECT doc, s AS p FROM s UNION SELECT doc, e FROM s UNION SELECT c_custkey, unnest([0, 300]) FROM customer),
x AS (SELECT doc, p AS "start", lead(p) OVER (PARTITION BY doc ORDER BY p) AS "end" FROM b)
SELECT x.doc, x."start", x."end", coalesce(list(s.id ORDER BY s.id) FILTER (WHERE s.id IS NOT NULL), []) AS spans FROM x LEFT JOIN s ON s.doc = x.doc AND s.s < x."end" AND s.e > x."start" WHERE x."end" IS NOT NULL GROUP BY ALL""")
def c19(t):
    return I.atomic_segments(t("customer").select(c("c_custkey").alias("doc"), F.lit(300).alias("length")), order_spans(t), "doc", "length")


@query("c20_removed_text_accounting", f"""
WITH s AS (SELECT *, e - s - (id % 17 = 0)::INT AS archived FROM ({SPANS_OF})), o AS (SELECT *, coalesce((s < lag(e) OVER (PARTITION BY doc ORDER BY s, e, id))::INT, 0) AS ov FROM s)
SELECT doc, sum(e - s)::BIGINT AS scheduled, sum(archived)::BIGINT AS archived, sum(ov)::BIGINT AS overlaps, sum(e - s) = sum(archived) AS equal FROM o GROUP BY doc""")
def c20(t):
    s = order_spans(t)
    return I.removed_text_accounting(s.withColumn("archived", c("end") - c("start") - (c("id") % 17 == 0).cast("int")), "doc")


@query("f23_interval_membership", """
WITH g AS (SELECT DISTINCT user_id AS k, event_id AS edge FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id AS k, event_id AS id, event_id AS pt FROM events WHERE event_type = 'click')
SELECT k, id, pt AS "at", (SELECT max(edge) FROM g WHERE g.k = p.k AND edge <= pt) AS low, (SELECT min(edge) FROM g WHERE g.k = p.k AND edge > pt) AS high,
       (SELECT max(edge) FROM g WHERE g.k = p.k AND edge <= pt) IS NOT NULL AND (SELECT min(edge) FROM g WHERE g.k = p.k AND edge > pt) IS NOT NULL AS inside FROM p""")
def f23(t):
    e = t("events").select(c("user_id").alias("k"), "event_id", "event_type")
    return I.interval_membership(e.where("event_type = 'click'").select("k", c("event_id").alias("id"), c("event_id").alias("at")), e.where("event_type = 'purchase'").select("k", c("event_id").alias("edge")).distinct(), "k")
