"""Queries of extraction, refinement and derivation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.operators import extraction as E
from stemma.plans.registry import query

c = F.col

CLAIM_RULES = [("license", "(Licensed|Released|licensed) under (.+)"), ("relation", "([a-z]+) is ([a-z]+)")]
SENTENCES = "SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS seq FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)"


@query("c26_extract_claims", f"""
WITH s AS ({SENTENCES}), t AS (SELECT *, CASE WHEN regexp_matches(sentence, '(Licensed|Released|licensed) under (.+)') THEN 'license' WHEN regexp_matches(sentence, '([a-z]+) is ([a-z]+)') THEN 'relation' WHEN regexp_matches(sentence, '[0-9]') THEN 'contextual' END AS type FROM s)
SELECT doc_id, seq::INT AS seq, type, CASE type WHEN 'license' THEN regexp_extract(sentence, '(Licensed|Released|licensed) under (.+)', 1) WHEN 'relation' THEN regexp_extract(sentence, '([a-z]+) is ([a-z]+)', 1) END AS input,
       CASE type WHEN 'license' THEN regexp_extract(sentence, '(Licensed|Released|licensed) under (.+)', 2) WHEN 'relation' THEN regexp_extract(sentence, '([a-z]+) is ([a-z]+)', 2) END AS output FROM t WHERE type IS NOT NULL""")
def c26(t):
    return E.extract_claims(t("documents"), "doc_id", "text", CLAIM_RULES)


@query("c27_extract_steps", f"""
WITH s AS ({SENTENCES}), t AS (SELECT *, CASE WHEN regexp_matches(sentence, '[a-z]+ with [a-z]+') THEN 'add' WHEN regexp_matches(sentence, '[a-z]+ by [a-z]+') THEN 'multiply' END AS op FROM s),
x AS (SELECT doc_id, seq, op, CASE op WHEN 'add' THEN regexp_extract(sentence, '[a-z]+ with [a-z]+') ELSE regexp_extract(sentence, '[a-z]+ by [a-z]+') END AS expression FROM t WHERE op IS NOT NULL),
f AS (SELECT doc_id, op, expression, min(seq) AS seq FROM x GROUP BY ALL) SELECT doc_id, op, expression, row_number() OVER (PARTITION BY doc_id ORDER BY seq, op) AS step FROM f""")
def c27(t):
    return E.extract_steps(t("documents"), "doc_id", "text", [("add", "[a-z]+ with [a-z]+"), ("multiply", "[a-z]+ by [a-z]+")])


@query("c24_search_cache_build", """
WITH r AS (SELECT event_type || user_id % 7 AS term, value, CASE WHEN event_id % 3 = 0 THEN 'gated' WHEN value < 2 THEN 'no_groups' END AS reason FROM events)
SELECT term, count(*) FILTER (WHERE reason IS NULL) AS kept, count(*) FILTER (WHERE reason IS NOT NULL) AS pruned, sum(CASE WHEN reason IS NULL THEN value END) AS hits, count(*) FILTER (WHERE reason IS NULL) = 0 AS failed FROM r GROUP BY term""")
def c24(t):
    e = t("events").select(F.concat("event_type", c("user_id") % 7).alias("term"), c("event_id").alias("variant"), c("value").alias("hits"), F.when(c("event_id") % 3 == 0, "gated").when(c("value") < 2, "no_groups").alias("reason"))
    return E.search_cache_build(e)


@query("c25_refine_inventory", """
WITH s AS (SELECT o_custkey AS doc, o_orderkey AS id, o_orderkey AS first, o_orderkey + 5 AS last, CASE WHEN o_orderstatus = 'O' THEN 'title' END AS title, o_orderkey % 7 AS score FROM orders),
n AS (SELECT *, lead(id) OVER w AS next_id, lead(first) OVER w AS next_first FROM s WINDOW w AS (PARTITION BY doc ORDER BY first, id))
SELECT doc, id, 'baseline' AS confidence, NULL::BIGINT AS body FROM s WHERE id % 5 = 0 UNION ALL
SELECT doc, id, CASE WHEN title IS NOT NULL THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END, CASE WHEN next_first - last <= 600 AND next_id % 5 <> 0 THEN next_id END FROM n WHERE id % 5 <> 0 AND (title IS NOT NULL OR score > 0)""")
def c25(t):
    k = c("o_orderkey")
    s = t("orders").select(c("o_custkey").alias("doc"), k.alias("id"), k.alias("first"), (k + 5).alias("last"), F.when(c("o_orderstatus") == "O", "title").alias("title"), (k % 7).alias("score"))
    return E.refine_inventory(s.where("id % 5 = 0"), s, 600)


@query("c29_primary_and_context", """
WITH k AS (SELECT DISTINCT l_orderkey AS quote, l_partkey AS candidate, (l_partkey % 4 <> 0) AS single, (l_partkey % 97)::BIGINT AS score FROM lineitem), p AS (SELECT quote, candidate AS pr, score AS p FROM (SELECT *, row_number() OVER (PARTITION BY quote ORDER BY score DESC, candidate) AS r FROM k WHERE single) WHERE r = 1)
SELECT quote, candidate, score, CASE WHEN candidate = pr THEN 'primary' WHEN NOT single THEN 'context' WHEN score >= greatest(p - 15, floor(0.75 * p)) THEN 'competing' ELSE 'noise' END AS role FROM k LEFT JOIN p USING (quote)""")
def c29(t):
    p = c("l_partkey")
    return E.primary_and_context(t("lineitem").select(c("l_orderkey").alias("quote"), p.alias("candidate"), (p % 4 != 0).alias("single"), (p % 97).alias("score")).distinct())


@query("f25_replace_spans", """
SELECT doc_id, regexp_replace(text, 'tion', '[CUT]', 'g') AS text, list_transform(range((length(text) - length(replace(text, 'tion', '')))::INT // 4), lambda x: 'tion') AS archived FROM documents""")
def f25(t):
    from stemma.functions import text as T

    d = t("documents")
    spans = d.select("doc_id", F.explode(T.all_occurrences("text", F.lit("tion"))).alias("start")).withColumn("end", c("start") + 4)
    return E.replace_spans(d, spans, "doc_id", "text", "[CUT]")


@query("r10_derive_facts", """
WITH RECURSIVE n AS (SELECT c_custkey AS k FROM customer),
r AS (SELECT k AS one, k AS two, k // 2 AS head FROM n WHERE k > 1 AND k % 7 <> 0 AND k % 11 <> 0 UNION ALL SELECT k, k + 1, k // 3 FROM n WHERE k % 11 = 0 AND k > 0),
a AS (SELECT c_custkey AS t, CASE WHEN c_custkey % 4 = 0 THEN 'LARGE' ELSE 'SMALL' END AS v, 'a' || (c_custkey % 2)::VARCHAR AS w, c_custkey % 3 = 0 AS reviewed FROM customer WHERE c_custkey % 5 < 2),
-- all facts so far are one list, so that both premises of a rule can be sought among them
f AS (SELECT 0 AS i, (SELECT list(DISTINCT {'t': t, 'v': v, 'w': w}) FROM a) AS s UNION ALL
  SELECT i + 1, (SELECT list(DISTINCT z) FROM (SELECT unnest(f.s) AS z UNION ALL SELECT {'t': head, 'v': x.v, 'w': x.w} FROM (SELECT unnest(f.s, recursive := true)) x JOIN r ON x.t = r.one JOIN (SELECT unnest(f.s, recursive := true)) y ON y.t = r.two AND y.v = x.v AND y.w = x.w)) FROM f WHERE i < 20),
facts AS (SELECT unnest(s, recursive := true) FROM f WHERE i = 20), b AS (SELECT t, min(v) <> max(v) AS clash FROM facts GROUP BY t), x AS (SELECT c_custkey AS t, 'SMALL' AS v FROM customer WHERE c_custkey % 13 = 0),
z AS (SELECT facts.*, clash, x.t IS NOT NULL AS rejected FROM facts JOIN b USING (t) LEFT JOIN x ON x.t = facts.t AND x.v = facts.v), u AS (SELECT t, v, w FROM z WHERE NOT clash AND NOT rejected),
q AS (SELECT head AS t, x.v, x.w, count(*) AS n FROM r JOIN u x ON x.t = r.one JOIN u y ON y.t = r.two AND y.v = x.v AND y.w = x.w GROUP BY ALL),
g AS (SELECT 0 AS i, (SELECT list(DISTINCT {'t': t, 'v': v, 'w': w, 'd': 0}) FROM a SEMI JOIN u USING (t, v, w) WHERE reviewed) AS s UNION ALL
  SELECT i + 1, (SELECT list({'t': t, 'v': v, 'w': w, 'd': d}) FROM (SELECT t, v, w, min(d) AS d FROM (SELECT unnest(g.s, recursive := true) UNION ALL SELECT u.t, u.v, u.w, i + 1 FROM (SELECT unnest(g.s, recursive := true)) x JOIN r ON x.t = r.one JOIN (SELECT unnest(g.s, recursive := true)) y ON y.t = r.two AND y.v = x.v AND y.w = x.w JOIN u ON u.t = head AND u.v = x.v AND u.w = x.w) GROUP BY ALL)) FROM g WHERE i < 20),
depth AS (SELECT unnest(s, recursive := true) FROM g WHERE i = 20)
SELECT z.t AS target, 'kind' AS facet, z.v AS value, z.w AS authority, CASE WHEN clash THEN 'conflict' WHEN rejected THEN 'rejected' WHEN d IS NULL THEN 'ungrounded' ELSE 'grounded' END AS status, d AS depth, coalesce(n, 0) AS n_proofs
FROM z LEFT JOIN q USING (t, v, w) LEFT JOIN depth USING (t, v, w)""")
def r10(t):
    """Facts of customers by rules of one and of two premises, with the least depth of their proofs."""
    k, cust = c("c_custkey"), t("customer")
    kind = F.lit("kind")
    rule = lambda df, name, target, to: df.select(F.concat(F.lit(name), k).alias("rule"), target.alias("target"), kind.alias("facet"), F.floor(to).alias("to_target"), kind.alias("to_facet"))
    single = rule(cust.where("c_custkey > 1 AND c_custkey % 7 != 0 AND c_custkey % 11 != 0"), "s", k, k / 2)
    pairs = cust.where("c_custkey % 11 = 0 AND c_custkey > 0")
    rules = single.union(rule(pairs, "p", k, k / 3)).union(rule(pairs, "p", k + 1, k / 3))
    facts = cust.where("c_custkey % 5 < 2").select(k.alias("target"), kind.alias("facet"), F.when(k % 4 == 0, "LARGE").otherwise("SMALL").alias("value"), F.concat(F.lit("a"), k % 2).alias("authority"), (k % 3 == 0).alias("reviewed"))
    rejected = cust.where("c_custkey % 13 = 0").select(k.alias("target"), kind.alias("facet"), F.lit("SMALL").alias("value"))
    return E.derive_facts(facts, rules, rejected)


@query("r10_grounding", """
WITH RECURSIVE n AS (SELECT c_custkey AS k FROM customer), r AS (SELECT k AS target, k // 2 AS to_target FROM n WHERE k > 1 AND k % 7 <> 0), a AS (SELECT c_custkey AS target, c_mktsegment AS value, c_custkey % 3 = 0 AS reviewed FROM customer WHERE c_custkey % 5 = 0),
f AS (SELECT target, value FROM a UNION SELECT r.to_target, f.value FROM f JOIN r USING (target)), b AS (SELECT target, min(value) <> max(value) AS blocked FROM f GROUP BY target),
u AS (SELECT f.target, f.value FROM f JOIN b USING (target) WHERE NOT blocked), g AS (SELECT target, value, 0 AS depth FROM a SEMI JOIN u USING (target, value) WHERE reviewed UNION SELECT r.to_target, g.value, depth + 1 FROM g JOIN r USING (target) JOIN u ON u.target = r.to_target AND u.value = g.value),
q AS (SELECT r.to_target AS target, u.value, count(*) AS n FROM u JOIN r USING (target) GROUP BY ALL)
SELECT f.target, 'kind' AS facet, f.value, 'a' AS authority, CASE WHEN blocked THEN 'conflict' WHEN d.depth IS NULL THEN 'ungrounded' ELSE 'grounded' END AS status, d.depth, coalesce(q.n, 0) AS n_proofs
FROM f JOIN b USING (target) LEFT JOIN (SELECT target, value, min(depth) AS depth FROM g GROUP BY ALL) d ON d.target = f.target AND d.value = f.value LEFT JOIN q ON q.target = f.target AND q.value = f.value""")
def r10_grounding(t):
    """Grounded facts with the least depth of their proofs."""
    k, cust = c("c_custkey"), t("customer")
    rules = cust.where("c_custkey > 1 AND c_custkey % 7 != 0").select(k.alias("rule"), k.alias("target"), F.lit("kind").alias("facet"), F.floor(k / 2).alias("to_target"), F.lit("kind").alias("to_facet"))
    return E.derive_facts(cust.where("c_custkey % 5 = 0").select(k.alias("target"), F.lit("kind").alias("facet"), c("c_mktsegment").alias("value"), F.lit("a").alias("authority"), (k % 3 == 0).alias("reviewed")), rules)


@query("w8_sectionize", """
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
k AS (SELECT doc_id, line::INT AS line, CASE WHEN length(content) < 40 THEN 'heading' WHEN length(content) % 5 = 0 THEN 'mark' WHEN length(content) % 5 = 1 THEN 'procedure' WHEN length(content) % 2 = 0 THEN 'source' ELSE 'translation' END AS kind FROM l),
g AS (SELECT doc_id, line, kind, (kind = 'heading')::BIGINT AS part, 0 AS section, 'first' AS why, kind = 'source' AS s, kind IN ('translation', 'mark') AS t, kind = 'mark' AS m FROM k WHERE line = 0
  UNION ALL SELECT doc_id, line, kind, part + (kind = 'heading')::INT, CASE WHEN kind = 'heading' THEN 0 WHEN why <> 'continues' THEN section + 1 ELSE section END, why, kind = 'source' OR (why = 'continues' AND s), kind IN ('translation', 'mark') OR (why = 'continues' AND t), kind = 'mark' OR (why = 'continues' AND m)
  FROM (SELECT k.doc_id, k.line, k.kind, part, section, s, t, m, CASE WHEN k.kind = 'heading' THEN 'first' WHEN k.kind = 'source' AND t THEN 'source_after_translation' WHEN k.kind = 'mark' AND t AND NOT s THEN 'mark_before_source' WHEN k.kind = 'procedure' AND t AND m THEN 'procedure_after_mark' ELSE 'continues' END AS why FROM g JOIN k ON k.doc_id = g.doc_id AND k.line = g.line + 1))
SELECT doc_id, line, kind, part, section, why FROM g""")
def w8(t):
    """Lines of every document by kind, in groups."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    n = F.length("content")
    kind = F.when(n < 40, "heading").when(n % 5 == 0, "mark").when(n % 5 == 1, "procedure").when(n % 2 == 0, "source").otherwise("translation")
    return E.sectionize(lines.select("doc_id", "line", kind.alias("kind")), "doc_id", "line", "kind")


@query("w9_expected_suffix", """
WITH RECURSIVE n AS (SELECT DISTINCT l_suppkey AS doc, l_orderkey AS page, l_partkey AS place FROM lineitem ),
m AS (SELECT *, 1 + (page // 200 + row_number() OVER (PARTITION BY doc, page ORDER BY place) - 1 - (place % 5 = 0)::INT) % 60 AS number FROM n),
o AS (SELECT *, row_number() OVER w AS k, first(number) OVER w AS l FROM m WINDOW w AS (PARTITION BY doc, page ORDER BY place DESC)),
g AS (SELECT *, NOT bool_or(number + k - 1 <> l) OVER (PARTITION BY doc, page ORDER BY place DESC) AS run FROM o),
p AS (SELECT doc, page, min(number) AS lo, max(number) AS hi, row_number() OVER (PARTITION BY doc ORDER BY page) AS i FROM g WHERE run GROUP BY doc, page),
e AS (SELECT doc, 0::BIGINT AS i, 1::BIGINT AS want, 0::BIGINT AS from_, -1::BIGINT AS page FROM p WHERE i = 1 UNION ALL SELECT p.doc, p.i, CASE WHEN want BETWEEN lo AND hi THEN hi + 1 ELSE want END, CASE WHEN want BETWEEN lo AND hi THEN want END, p.page FROM e JOIN p ON p.doc = e.doc AND p.i = e.i + 1)
SELECT g.doc, g.page, place, number, coalesce(run AND number >= from_, false) AS accepted FROM g LEFT JOIN e ON e.doc = g.doc AND e.page = g.page AND e.i > 0""")
def w9(t):
    """Note candidates on the pages (orders) of documents (suppliers)."""
    from pyspark.sql import Window

    n = t("lineitem").select(c("l_suppkey").alias("doc"), c("l_orderkey").alias("page"), c("l_partkey").alias("place")).distinct()
    nth = F.row_number().over(Window.partitionBy("doc", "page").orderBy("place"))
    number = 1 + (F.floor(c("page") / 200) + nth - 1 - (c("place") % 5 == 0).cast("int")) % 60
    return E.expected_suffix(n.withColumn("number", number), "doc", "page", "place", "number")
