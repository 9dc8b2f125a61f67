"""Queries of the joins (section 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import intervals as I
from stemma.operators import joins as J
from stemma.operators import topk as K
from stemma.plans.filters import NODES, graph
from stemma.plans.registry import query

c = F.col


@query("j1_observation_records", """
WITH o AS (SELECT o_orderkey AS obs_id, c_name, n_name, [o_orderkey % 30, o_custkey % 27] AS ids FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT obs_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM o), s AS (SELECT obs_id, list(n_name ORDER BY pos) AS source_names FROM e JOIN nation ON id = n_nationkey GROUP BY obs_id)
SELECT o.obs_id, c_name, n_name, coalesce(source_names, []) AS source_names FROM o LEFT JOIN s USING (obs_id)""")
def j1(t):
    o = t("orders").select(c("o_orderkey").alias("obs_id"), c("o_custkey").alias("site_id"), F.array(c("o_orderkey") % 30, c("o_custkey") % 27).alias("source_ids"))
    sites = t("customer").select(c("c_custkey").alias("site_id"), "c_name", c("c_nationkey").alias("calendar_id"))
    n = t("nation")
    o = o.join(sites.select("site_id", "calendar_id"), "site_id")
    out = J.observation_records(o, sites.drop("calendar_id"), n.select(c("n_nationkey").alias("calendar_id"), "n_name"), n.select(c("n_nationkey").cast("long").alias("source_id"), c("n_name").alias("source_name")))
    return out.select("obs_id", "c_name", "n_name", "source_names")


@query("j2_name_as_of", """
WITH k AS (SELECT DISTINCT c_custkey AS key, 1992 + c_custkey % 8 AS year, 'p' || c_custkey % 3 AS period FROM customer),
n AS (SELECT o_custkey AS key, 'name ' || o_orderkey AS name, 'p' || o_orderkey % 5 AS period, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE year(o_orderdate) END AS start, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE year(o_orderdate) + 1 END AS fin, o_orderkey AS pos FROM orders),
j AS (SELECT k.key, year, name, pos, CASE WHEN year BETWEEN coalesce(start, -9999) AND coalesce(fin, 9999) AND (start IS NOT NULL OR fin IS NOT NULL) THEN 0 WHEN n.period = k.period THEN 1 WHEN n.period = 'modern' THEN 2 ELSE 3 END AS tier FROM k JOIN n USING (key))
SELECT key, year, name, tier FROM (SELECT *, row_number() OVER (PARTITION BY key, year ORDER BY tier, pos) AS r FROM j) WHERE r = 1""")
def j2(t):
    keys = t("customer").select(c("c_custkey").alias("key"), (1992 + c("c_custkey") % 8).alias("year"), F.concat(F.lit("p"), c("c_custkey") % 3).alias("period"))
    k, y = c("o_orderkey"), F.year("o_orderdate")
    names = t("orders").select(c("o_custkey").alias("key"), F.concat(F.lit("name "), k).alias("name"), F.concat(F.lit("p"), k % 5).alias("period"), F.when(k % 3 != 0, y).alias("start"), F.when(k % 4 != 0, y + 1).alias("end"), k.alias("pos"))
    return J.name_as_of(keys, names)


@query("j3_neighbors", f"""
WITH {NODES} SELECT x.id, direction, type, other, n.name AS other_name FROM (SELECT source AS id, 'out' AS direction, type, target AS other FROM e UNION ALL SELECT target, 'in', type, source FROM e) x JOIN n ON n.id = other""")
def j3(t):
    return J.neighbors(*graph(t))


ITEMS = "'s' || user_id % 10 AS system, date_trunc('day', ts) AS chapter"


@query("j4_align_scored", """
WITH i AS (SELECT p_partkey AS id, p_brand AS system, p_size AS chapter, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_type ELSE p_name END AS title, string_split(p_name, ' ') || [p_type] AS terms, [floor(p_retailprice)::INT % 11] AS constants, ['op' || p_partkey % 5, 'op' || p_size % 3] AS ops, p_partkey % 100 AS place, [p_partkey - 1 - p_partkey % 12] AS linked FROM part),
j AS (SELECT a.id AS l_id, b.id AS r_id, list_contains(b.linked, a.id) AS link, contains(a.title, b.title) OR contains(b.title, a.title) AS titled, list_filter(list_intersect(a.terms, b.terms), lambda x: x NOT IN ('red', 'PROMO', 'STANDARD')) AS t, list_intersect(a.terms, b.terms) AS u,
  len(list_intersect(a.constants, b.constants)) AS nc, len(list_filter(list_intersect(a.ops, b.ops), lambda x: x <> 'op0')) AS no, abs(a.place - b.place) AS gap FROM i a JOIN i b USING (system, chapter) WHERE a.id % 2 = 0 AND b.id % 2 = 1),
s AS (SELECT *, len(t) AS nt, len(u) - len(t) AS ng, greatest(0, 5 - gap) AS near FROM j), z AS (SELECT *, 20 * link::INT + 16 * titled::INT + 6 * nt + 4 * nc + 2 * no + near AS score FROM s),
y AS (SELECT *, CASE WHEN link OR (titled AND (nt > 0 OR nc > 0 OR near >= 2)) THEN 'high' WHEN titled OR (nt > 0 AND (nc > 0 OR near >= 2)) OR (nt >= 2 AND near >= 1) THEN 'medium' WHEN NOT link AND NOT titled AND nt + nc + no = 0 AND ng > 0 THEN 'generic_only' WHEN score >= 5 THEN 'review' END AS tier FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, gap, r_id) AS rank FROM y WHERE tier IS NOT NULL)
SELECT l_id, r_id, score, tier, rank FROM r WHERE rank <= 3""")
def j4(t):
    k = c("p_partkey")
    i = t("part").select(k.alias("id"), c("p_brand").alias("system"), c("p_size").alias("chapter"), F.when(k % 3 == 0, F.concat_ws(" ", "p_name", "p_type")).otherwise(c("p_name")).alias("title"), F.concat(F.split("p_name", " "), F.array("p_type")).alias("terms"),
        F.array(F.floor("p_retailprice").cast("int") % 11).alias("constants"), F.array(F.concat(F.lit("op"), k % 5), F.concat(F.lit("op"), c("p_size") % 3)).alias("ops"), (k % 100).alias("place"), F.array(k - 1 - k % 12).alias("linked"))
    return J.align_scored(i.where("id % 2 = 0").drop("linked"), i.where("id % 2 = 1"), ["red", "PROMO", "STANDARD"], ["op0"])


def _grams(table, key):
    w = "regexp_split_to_array(lower(text), '[^a-z0-9]+')"
    parts = " UNION ALL ".join(f"SELECT {key} AS id, {n} AS n, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM (SELECT {key}, list_filter({w}, lambda x: length(x) >= 3) AS w FROM {table}))" for n in (18, 14, 12, 10, 8, 6, 4, 3))
    return f"SELECT DISTINCT * FROM ({parts})"


#: Operation phrases that quotes and sources may share.
PHRASES = ["the and", "of the", "in the", "la la", "und der"]
_Q_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3)"
_Q_CLAUSES = "list_filter(list_transform(string_split(text, '.'), lambda s: array_to_string(list_filter(regexp_split_to_array(lower(s), '[^a-z0-9]+'), lambda x: length(x) >= 3), ' ')), lambda s: s <> '')"


@query("j5_quote_to_source", f"""
WITH q AS ({_grams('benchmark', 'item_id')}), s AS ({_grams('documents', 'doc_id')}),
z AS (SELECT q.id AS quote, s.id AS source, max(n) AS longest, count(*) AS n_shared FROM q JOIN s USING (n, g) GROUP BY ALL),
qt AS (SELECT item_id AS quote, ' ' || array_to_string({_Q_WORDS}, ' ') || ' ' AS q_text, array_to_string(list_slice({_Q_WORDS}, 1, 2), ' ') AS title, {_Q_CLAUSES} AS cl, [item_id % 7] AS qc, item_id / (SELECT max(item_id) FROM benchmark) AS qp FROM benchmark),
st AS (SELECT doc_id AS source, ' ' || array_to_string({_Q_WORDS}, ' ') || ' ' AS s_text, [doc_id % 7] AS sc, doc_id / (SELECT max(doc_id) FROM documents) AS sp FROM documents),
m AS (SELECT quote, source, coalesce(longest, 0) AS longest, coalesce(n_shared, 0) AS n_shared FROM qt CROSS JOIN st LEFT JOIN z USING (quote, source) WHERE longest IS NOT NULL OR (length(title) > 0 AND contains(s_text, ' ' || title || ' ')) OR len(list_filter(cl, lambda x: length(x) >= 8 AND contains(s_text, ' ' || x || ' '))) > 0),
f AS (SELECT quote, source, longest, n_shared, length(title) > 0 AND contains(s_text, ' ' || title || ' ') AS titled, list_filter(list_distinct(cl), lambda x: length(x) >= 8 AND contains(s_text, ' ' || x || ' ')) AS met, len(list_filter(cl, lambda x: length(x) < 8 AND contains(s_text, ' ' || x || ' '))) AS ng, len(list_intersect(qc, sc)) AS nc,
  {" + ".join(f"(contains(q_text, ' {p} ') AND contains(s_text, ' {p} '))::INT" for p in PHRASES)} AS no, greatest(0, 10 - round(abs(qp - sp) * 20))::INT AS place FROM m JOIN qt USING (quote) JOIN st USING (source)),
x AS (SELECT *, coalesce(list_max(list_transform(met, lambda x: length(x))), 0) AS lc, len(met) AS n_clauses FROM f),
y AS (SELECT *, 35 * titled::INT + CASE WHEN lc >= 10 THEN 35 WHEN n_clauses > 0 THEN 20 ELSE 0 END + 10 * n_clauses + CASE WHEN longest >= 12 THEN 30 WHEN longest >= 8 THEN 18 WHEN longest >= 6 THEN 10 ELSE 0 END + 6 * nc + 5 * no + place AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY quote ORDER BY score DESC, n_shared DESC, source) AS rank FROM y)
SELECT quote, source, longest, n_shared, n_clauses, score, CASE WHEN NOT titled AND n_clauses = 0 AND nc + no = 0 AND longest < 6 AND ng > 0 THEN 'generic_only_rejected' WHEN (titled AND (n_clauses > 0 OR longest >= 8)) OR n_clauses >= 2 OR longest >= 12 THEN 'high' WHEN n_clauses > 0 OR longest >= 8 OR (titled AND longest >= 6) THEN 'medium' WHEN ng > 0 OR longest >= 4 THEN 'review' ELSE 'insufficient' END AS confidence, rank FROM r WHERE rank <= 3""")
def j5(t):
    place = lambda df, k: c(k) / df.agg(F.max(k)).first()[0]
    b, d = t("benchmark"), t("documents")
    clauses = F.filter(F.transform(F.split("text", r"[.]", -1), lambda x: F.array_join(T.tokens(x), " ")), lambda x: x != "")
    q = b.select(c("item_id").alias("id"), T.tokens("text").alias("words"), place(b, "item_id").alias("place"), F.array(c("item_id") % 7).alias("constants"), clauses.alias("clauses"))
    q = q.withColumn("title", F.array_join(F.slice("words", 1, 2), " ")).withColumn("generic", F.filter("clauses", lambda x: F.length(x) < 8))
    s = d.select(c("doc_id").alias("id"), T.tokens("text").alias("words"), place(d, "doc_id").alias("place"), F.array(c("doc_id") % 7).alias("constants"))
    return J.quote_to_source(q, s, PHRASES, (18, 14, 12, 10, 8, 6, 4, 3))


@query("j6_claims_to_steps", """
WITH i AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey * 10 + l_linenumber AS id, l_linenumber AS ln, l_returnflag || l_partkey % 300 AS op, l_linestatus AS system, list_sort([l_suppkey % 5, l_partkey % 5]) AS inputs, ['t' || l_orderkey % 6, 'u' || l_linenumber % 3] AS terms, l_partkey % 7 AS modulus FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice),
s AS (SELECT DISTINCT op, system, inputs, terms, modulus FROM i WHERE ln % 2 = 1),
k AS (SELECT op, system, inputs, terms, modulus, id FROM (SELECT *, row_number() OVER (PARTITION BY op, system, inputs, terms, modulus ORDER BY id) AS r FROM i WHERE ln % 2 = 0) WHERE r <= 5),
j AS (SELECT s.*, k.id AS claim_id, 4 + CASE WHEN s.system = k.system THEN 2 ELSE -2 END + CASE WHEN s.modulus = k.modulus THEN 2 ELSE 0 END + 2 * len(list_intersect(s.terms, k.terms))
   + 2 * CASE WHEN s.inputs = k.inputs THEN 2 WHEN s.inputs[1] IN (k.inputs[1], k.inputs[2]) OR s.inputs[2] IN (k.inputs[1], k.inputs[2]) THEN 1 ELSE 0 END AS score FROM s JOIN k USING (op)),
r AS (SELECT *, row_number() OVER (PARTITION BY op, system, inputs, terms, modulus ORDER BY score DESC, claim_id) AS rank FROM j WHERE score > 0)
SELECT i.id AS step_id, claim_id, score, rank, CASE WHEN score >= 10 THEN 'direct' WHEN score >= 6 THEN 'partial' ELSE 'weak' END AS grade FROM i JOIN r USING (op, system, inputs, terms, modulus) WHERE ln % 2 = 1 AND rank <= 5""")
def j6(t):
    from stemma.operators.aggregates import first_by_key

    i = first_by_key(t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    terms = F.array(F.concat(F.lit("t"), c("l_orderkey") % 6), F.concat(F.lit("u"), c("l_linenumber") % 3))
    i = i.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), "l_linenumber", F.concat("l_returnflag", c("l_partkey") % 300).alias("op"), c("l_linestatus").alias("system"), F.array(c("l_suppkey") % 5, c("l_partkey") % 5).alias("inputs"), terms.alias("terms"), (c("l_partkey") % 7).alias("modulus"))
    return J.claims_to_steps(i.where("l_linenumber % 2 = 1").withColumnRenamed("id", "step_id"), i.where("l_linenumber % 2 = 0").withColumnRenamed("id", "claim_id"))


@query("j7_bind_claims", """
WITH a AS (SELECT o_orderkey AS anchor, o_orderstatus AS system, 'Proc. ' || o_orderkey % 1000 AS mention, CASE WHEN o_orderkey % 3 = 0 THEN 'Title ' || o_orderkey % 50 ELSE '' END AS title, CASE WHEN o_orderkey % 7 = 0 THEN 'H' || o_orderkey % 20 END AS heading,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS family, ['d' || o_orderkey % 13, 'e' || o_orderkey % 11] AS own, o_orderkey % 3 AS n_mentions, o_orderkey % 17 = 0 AS table_like, [o_custkey, o_custkey + 1] AS chunks FROM orders),
k AS (SELECT o_orderkey * 3 AS claim_id, o_custkey AS chunk, o_orderstatus AS system, o_orderpriority AS family, ['d' || o_orderkey % 13] AS dis, o_orderkey % 6 <> 5 AS strict,
  CASE o_orderkey % 4 WHEN 0 THEN 'see Proc. ' || o_orderkey % 1000 || '.' WHEN 1 THEN 'the  TITLE ' || o_orderkey % 50 || ' of' WHEN 2 THEN 'in H' || o_orderkey % 20 ELSE 'Proc. ' || o_orderkey % 1000 || '7' END AS text FROM orders),
j AS (SELECT anchor, claim_id, strict AND (regexp_matches(text, regexp_escape(mention) || '([^0-9]|$)') OR (title <> '' AND contains(regexp_replace(lower(text), ' +', ' ', 'g'), lower(title))) OR coalesce(contains(text, heading), false)) AS d,
  strict AND coalesce(a.family = k.family, false) AND n_mentions <= 1 AND list_has_any(own, dis) AS f FROM (SELECT *, unnest(chunks) AS chunk FROM a) a JOIN k USING (system, chunk)),
g AS (SELECT anchor, coalesce(list(DISTINCT claim_id ORDER BY claim_id) FILTER (WHERE d), []) AS d, coalesce(list(DISTINCT claim_id ORDER BY claim_id) FILTER (WHERE f), []) AS f FROM j GROUP BY anchor),
r AS (SELECT anchor, d, f, CASE WHEN len(d) > 0 THEN 'direct_proc_binding' WHEN len(f) > 0 THEN 'family_distinctive_fallback' WHEN table_like THEN 'commentary_only' WHEN d IS NOT NULL THEN 'claim_exists_but_not_bound' ELSE 'no_claim_extracted' END AS reason FROM a LEFT JOIN g USING (anchor))
SELECT anchor, CASE WHEN len(d) > 0 THEN d ELSE coalesce(f, []) END AS claim_ids, CASE WHEN len(d) > 0 THEN 'bound' WHEN len(f) > 0 THEN 'needs_review' ELSE reason END AS status, reason FROM r""")
def j7(t):
    """Orders as anchors and as claims of their customers' chunks."""
    o, k = t("orders"), c("o_orderkey")
    tag = lambda x, n: F.concat(F.lit(x), k % n)
    anchors = o.select(
        k.alias("anchor"), c("o_orderstatus").alias("system"), tag("Proc. ", 1000).alias("mention"), F.when(k % 3 == 0, tag("Title ", 50)).otherwise("").alias("title"), F.when(k % 7 == 0, tag("H", 20)).alias("heading"),
        F.when(k % 5 != 0, c("o_orderpriority")).alias("family"), F.array(tag("d", 13), tag("e", 11)).alias("distinctive"), (k % 3).alias("n_mentions"), (k % 17 == 0).alias("table_like"), F.array("o_custkey", c("o_custkey") + 1).alias("chunks"),
    )
    text = F.when(k % 4 == 0, F.concat(tag("see Proc. ", 1000), F.lit("."))).when(k % 4 == 1, F.concat(tag("the  TITLE ", 50), F.lit(" of"))).when(k % 4 == 2, tag("in H", 20)).otherwise(F.concat(tag("Proc. ", 1000), F.lit("7")))
    claims = o.select((k * 3).alias("claim_id"), c("o_custkey").alias("chunk"), c("o_orderstatus").alias("system"), c("o_orderpriority").alias("family"), F.array(tag("d", 13)).alias("distinctive"), (k % 6 != 5).alias("strict"), text.alias("text"))
    return J.bind_claims(anchors, claims)


@query("j8_source_alignment", """
WITH a AS (SELECT o_orderkey AS anchor, o_custkey % 50 AS system, CASE o_orderkey % 40 WHEN 0 THEN 'blue ring' WHEN 1 THEN 'ring' WHEN 2 THEN 'lue ri' WHEN 3 THEN 'Another method' WHEN 4 THEN 'redring' WHEN 5 THEN '' ELSE 'method ' || o_orderkey END AS title, CASE WHEN o_orderkey % 5 <> 0 THEN 'f' || o_orderkey % 4 END AS family, ['t' || o_orderkey % 97, 'u' || o_orderkey % 89] AS terms, ['o' || o_orderkey % 3, o_orderstatus] AS ops, CASE WHEN o_orderkey % 50 = 0 THEN [o_orderkey % 2000] ELSE [] END AS hints, [o_orderkey % 2000] AS linked FROM orders),
s AS (SELECT p_partkey AS span, p_size - 1 AS system, CASE WHEN p_partkey % 9 = 0 THEN 'ring' ELSE p_name END AS title, CASE WHEN p_partkey % 11 <> 0 THEN 'f' || p_partkey % 4 END AS family, ['t' || p_partkey % 97, 'u' || p_partkey % 89] AS terms, ['o' || p_partkey % 3, 'F'] AS ops FROM part),
j AS (SELECT anchor, span, a.title, a.title <> '' AND s.title <> '' AND (contains(a.title, s.title) OR contains(s.title, a.title)) AS titled, coalesce(a.family = s.family, false) AS same, len(list_filter(list_intersect(a.terms, s.terms), lambda x: x NOT IN ('t0', 'u0', 't1', 't2'))) AS nt, len(list_intersect(a.ops, s.ops)) AS no, list_contains(linked, span) AS link FROM a JOIN s USING (system) WHERE len(hints) = 0),
k AS (SELECT *, 8 * same::INT + 10 * titled::INT + 4 * nt + 2 * no + 6 * link::INT AS score FROM j WHERE titled OR nt > 0 OR (same AND no > 0)),
r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nx, bool_or(titled) OVER (PARTITION BY anchor) AS any_t FROM k WINDOW w AS (PARTITION BY anchor ORDER BY score DESC, span)),
f AS (SELECT anchor, unnest(hints) AS span, 100 AS score, 'manual' AS status FROM a UNION ALL SELECT anchor, span, score, 'inferred' FROM r WHERE titled OR (NOT any_t AND r = 1 AND same AND nt > 0 AND no > 0 AND score >= 16 AND lower(title) <> 'another method' AND (nx IS NULL OR score - nx >= 4)))
SELECT anchor, span, score, status FROM f UNION ALL SELECT anchor, NULL, NULL, CASE WHEN anchor IN (SELECT anchor FROM r) THEN 'needs_review' ELSE 'no_candidate' END FROM a WHERE anchor NOT IN (SELECT anchor FROM f)""")
def j8(t):
    """Orders as anchors and parts as spans; titles without spaces may hold one another."""
    k = c("o_orderkey")
    tag = lambda x, col, n: F.concat(F.lit(x), col % n)
    title = F.concat(F.lit("method "), k)
    for i, name in enumerate(["blue ring", "ring", "lue ri", "Another method", "redring", ""]):
        title = F.when(k % 40 == i, name).otherwise(title)
    anchors = t("orders").select(k.alias("anchor"), (c("o_custkey") % 50).cast("int").alias("system"), title.alias("title"), F.when(k % 5 != 0, tag("f", k, 4)).alias("family"), F.array(tag("t", k, 97), tag("u", k, 89)).alias("terms"), F.array(tag("o", k, 3), "o_orderstatus").alias("ops"), F.when(k % 50 == 0, F.array(k % 2000)).otherwise(F.array().cast("array<bigint>")).alias("hints"), F.array(k % 2000).alias("linked"))
    p = c("p_partkey")
    spans = t("part").select(p.alias("span"), (c("p_size") - 1).cast("int").alias("system"), F.when(p % 9 == 0, "ring").otherwise(c("p_name")).alias("title"), F.when(p % 11 != 0, tag("f", p, 4)).alias("family"), F.array(tag("t", p, 97), tag("u", p, 89)).alias("terms"), F.array(tag("o", p, 3), F.lit("F")).alias("ops"))
    return J.source_alignment(anchors, spans, ["t0", "u0", "t1", "t2"])


@query("j8_contained_titles", """
WITH a AS (SELECT o_orderkey AS text_id, o_orderpriority || '-' || o_orderkey % 300 AS text FROM orders), b AS (SELECT s_suppkey AS needle_id, CASE s_suppkey % 4 WHEN 0 THEN 'H-' || s_suppkey % 40 WHEN 1 THEN (s_suppkey % 9)::VARCHAR WHEN 2 THEN 'NOT SPECIFIED-' || s_suppkey ELSE 'zz' END AS needle FROM supplier)
SELECT text_id, needle_id FROM a JOIN b ON contains(text, needle)""")
def j8_contained(t):
    """Which texts hold which needles, of one letter and more."""
    s = c("s_suppkey")
    needle = F.when(s % 4 == 0, F.concat(F.lit("H-"), s % 40)).when(s % 4 == 1, (s % 9).cast("string")).when(s % 4 == 2, F.concat(F.lit("NOT SPECIFIED-"), s)).otherwise("zz")
    return J.contained_in(t("orders").select(c("o_orderkey").alias("text_id"), F.concat("o_orderpriority", F.lit("-"), c("o_orderkey") % 300).alias("text")), t("supplier").select(s.alias("needle_id"), needle.alias("needle")), [])


@query("j9_strongest_claim_for_term", """
WITH t AS (SELECT p_partkey AS term_id, p_brand AS text, p_size AS value FROM part), k AS (SELECT s_suppkey AS claim_id, 'brand#' || (s_suppkey % 30) AS text, s_suppkey % 60 AS value, s_suppkey % 3 AS level, s_suppkey % 4 = 0 AS strong FROM supplier),
b AS (SELECT term_id, claim_id, level FROM t JOIN k ON lower(t.text) = lower(k.text) UNION SELECT term_id, claim_id, level FROM t JOIN k ON t.value = k.value AND strong)
SELECT term_id, claim_id, level FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY level, claim_id) AS r FROM b) WHERE r = 1""")
def j9(t):
    s = c("s_suppkey")
    claims = t("supplier").select(s.alias("claim_id"), F.concat(F.lit("brand#"), s % 30).alias("text"), (s % 60).alias("value"), (s % 3).alias("level"), (s % 4 == 0).alias("strong"))
    return J.strongest_claim_for_term(t("part").select(c("p_partkey").alias("term_id"), c("p_brand").alias("text"), c("p_size").cast("long").alias("value")), claims)


@query("j10_constant_for_name", """
WITH p AS (SELECT p_partkey AS id, p_brand AS source, CASE p_partkey % 8 WHEN 0 THEN 'old ' || p_name WHEN 1 THEN 'lue ring' ELSE p_name END AS name, string_split(p_name, ' ') || CASE WHEN p_partkey % 5 < 2 THEN [p_type] ELSE [] END AS terms, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 50 END AS line FROM part),
r AS (SELECT id AS ref_id, * EXCLUDE id FROM p WHERE id % 2 = 0), k AS (SELECT id AS const_id, * EXCLUDE id FROM p WHERE id % 2 = 1),
e AS (SELECT ref_id, const_id, 100 AS score FROM r JOIN k ON r.name = k.name AND r.source = k.source),
s AS (SELECT ref_id, const_id, 60 * (ends_with(r.name, k.name) OR ends_with(k.name, r.name))::INT + 20 * len(list_intersect(r.terms, k.terms)) AS points, abs(r.line - k.line) AS d FROM r JOIN k ON r.source = k.source WHERE ref_id NOT IN (SELECT ref_id FROM e)),
z AS (SELECT ref_id, const_id, points + CASE WHEN d IS NULL THEN 0 ELSE CASE WHEN d = 0 THEN 10 WHEN d <= 3 THEN 6 WHEN d <= 8 THEN 3 ELSE 0 END - least(d, 40) END AS score FROM s WHERE points > 0),
a AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, const_id) AS n FROM (SELECT * FROM e UNION ALL SELECT * FROM z WHERE score > 0)) SELECT ref_id, const_id, score FROM a WHERE n = 1""")
def j10(t):
    k = c("p_partkey")
    terms = F.concat(F.split("p_name", " "), F.when(k % 5 < 2, F.array("p_type")).otherwise(F.array().cast("array<string>")))
    name = F.when(k % 8 == 0, F.concat(F.lit("old "), "p_name")).when(k % 8 == 1, "lue ring").otherwise(c("p_name"))
    p = t("part").select(k.alias("id"), c("p_brand").alias("source"), name.alias("name"), terms.alias("terms"), F.when(k % 9 != 0, k % 50).alias("line"))
    return J.constant_for_name(p.where("id % 2 = 0").withColumnRenamed("id", "ref_id"), p.where("id % 2 = 1").withColumnRenamed("id", "const_id"))


@query("j11_bilingual_number_pairs", """
WITH m AS (SELECT conv_id AS chunk, turn, role, unnest(regexp_extract_all(text, '[a-z]{9,}')) AS value, generate_subscripts(regexp_extract_all(text, '[a-z]{9,}'), 1) AS i FROM conversations),
l AS (SELECT chunk, turn * 10000 + i AS left_pos, value FROM m WHERE role = 'user'), r AS (SELECT chunk, value, min(turn * 10000 + i) AS right_pos FROM m WHERE role = 'assistant' GROUP BY ALL)
SELECT chunk, value, left_pos, right_pos FROM l JOIN r USING (chunk, value)""")
def j11(t):
    m = t("conversations").select(c("conv_id").alias("chunk"), "turn", "role", F.posexplode(F.regexp_extract_all("text", F.lit("[a-z]{9,}"), F.lit(0))).alias("i", "value"))
    m = m.select("chunk", "role", (c("turn") * 10000 + c("i") + 1).alias("pos"), "value")
    return J.bilingual_number_pairs(m.where("role = 'user'").drop("role"), m.where("role = 'assistant'").drop("role"))


SPANS = """a AS (SELECT l_partkey AS doc, l_orderkey * 10 + l_linenumber AS id, l_orderkey % 1000 AS s, l_orderkey % 1000 + l_quantity::INT AS e FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT l_partkey AS doc, l_orderkey * 10 + l_linenumber AS id, l_orderkey % 1000 AS s, l_orderkey % 1000 + l_quantity::INT AS e FROM lineitem WHERE l_returnflag <> 'R')"""


def spans(t):
    k, q = c("l_orderkey"), c("l_quantity").cast("int")
    x = t("lineitem").select(c("l_partkey").alias("doc"), (k * 10 + c("l_linenumber")).alias("id"), (k % 1000).alias("start"), (k % 1000 + q).alias("end"), c("l_returnflag").alias("flag"))
    return x.where("flag = 'R'").drop("flag"), x.where("flag != 'R'").drop("flag")


@query("j12_interval_overlap", f"WITH {SPANS} SELECT a.doc, a.id AS left_id, b.id AS right_id FROM a JOIN b ON a.doc = b.doc AND a.s < b.e AND b.s < a.e")
def j12(t):
    return I.overlapping(*spans(t), "doc", bucket=64).select("doc", "left_id", "right_id")


@query("j13_interval_contains", f"WITH {SPANS} SELECT a.doc, a.id AS left_id, b.id AS right_id FROM a JOIN b ON a.doc = b.doc AND a.s <= b.s AND b.e <= a.e AND b.e - b.s < a.e - a.s")
def j13(t):
    return I.containing(*spans(t), "doc", bucket=64).select("doc", "left_id", "right_id")


@query("j14_anti_missing", """
SELECT DISTINCT c_custkey + 3 AS key, 'only_left' AS side FROM customer WHERE c_custkey + 3 NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'only_right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey + 3 FROM customer)""")
def j14(t):
    return J.missing_both_ways(t("customer").select((c("c_custkey") + 3).alias("key")), t("orders").select(c("o_custkey").alias("key")), "key")


@query("j15_semi_existing", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j15(t):
    return t("orders").join(t("customer").where("c_mktsegment = 'BUILDING'"), c("o_custkey") == c("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("j16_producer_consumer", """
WITH p AS (SELECT event_id, 'p' || event_id % 2 AS port, user_id * 100 + event_id % 37 AS value_id, CASE WHEN event_type IN ('click', 'view') THEN 'read' ELSE 'write' END AS direction FROM events),
w AS (SELECT value_id, min(event_id) AS producer FROM p WHERE direction = 'write' GROUP BY value_id) SELECT event_id, port, value_id, producer, producer IS NULL AS gap FROM p LEFT JOIN w USING (value_id) WHERE direction = 'read'""")
def j16(t):
    e = c("event_id")
    p = t("events").select("event_id", F.concat(F.lit("p"), e % 2).alias("port"), (c("user_id") * 100 + e % 37).alias("value_id"), F.when(c("event_type").isin("click", "view"), "read").otherwise("write").alias("direction"))
    return J.producer_consumer(p)


@query("j17_relocate_anchor", """
WITH w AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{6,}'))) AS anchor FROM documents), p AS (SELECT *, string_split(text, anchor) AS parts FROM w)
SELECT doc_id, anchor, len(parts)::INT - 1 AS n_places, CASE WHEN len(parts) = 2 THEN length(parts[1]) ELSE length(parts[1]) + length(anchor) + length(parts[2]) END::INT AS start, CASE WHEN len(parts) = 2 THEN 'unique' ELSE 'ordinal' END AS status FROM p"""
)
def j17(t):
    """Capital words of seven letters and more of each document, sought again in it; held to brute force in the tests."""
    d = t("documents").select("doc_id", "text")
    words = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{6,}"), F.lit(0)))).alias("anchor"))
    m = words.select(F.xxhash64("doc_id", "anchor").alias("mention_id"), "doc_id", "anchor", F.lit(2).alias("ordinal"))
    return J.relocate_anchor(m, d).join(m.select("mention_id", "anchor"), "mention_id").select("doc_id", "anchor", "n_places", "start", "status")


@query("j18_find_by_terms", """
WITH i AS (SELECT n_nationkey AS item, 'src' || n_nationkey % 20 AS source, ['the', 'and', 'tion' ] AS terms FROM nation),
w AS (SELECT DISTINCT source, doc_id AS row, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents),
h AS (SELECT item, row, count(*) AS n FROM w JOIN (SELECT item, source, unnest(terms) AS term FROM i) USING (source, term) GROUP BY ALL HAVING count(*) = 3) SELECT item, min(row) AS row FROM h GROUP BY item""")
def j18(t):
    k = c("n_nationkey")
    items = t("nation").select(k.alias("item"), F.concat(F.lit("src"), k % 20).alias("source"), F.array(F.lit("the"), F.lit("and"), F.lit("tion")).alias("terms"))
    return J.find_by_terms(items, t("documents").select("source", c("doc_id").alias("row"), "text"))


@query("j19_select_units", """
WITH m AS (SELECT doc_id * 2 AS id, n_chars AS locked FROM documents) SELECT id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN d.n_chars <> locked THEN 'source_changed' ELSE 'ok' END AS status FROM m LEFT JOIN documents d ON d.doc_id = id""")
def j19(t):
    d = t("documents")
    return J.select_units(d.select((c("doc_id") * 2).alias("id"), c("n_chars").alias("locked_hash")), d.select(c("doc_id").alias("id"), c("n_chars").alias("hash")))


@query("j20_declaration_evidence", f"WITH {SPANS} SELECT b.doc, b.id FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc = b.doc AND a.s < b.e AND b.s < a.e)")
def j20(t):
    a, b = spans(t)
    return I.outside(b, a, "doc", bucket=64).select("doc", "id")
