"""Queries of projections, filters, predicates, sorting and top-k (sections 2.2 and 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import aggregates as A
from stemma.operators import filters as P
from stemma.operators import topk as K
from stemma.plans.registry import query

c = F.col

NODES = """n AS (SELECT 'N' || n_nationkey AS id, 'nation' AS label, n_name AS name, 'region ' || n_regionkey AS note FROM nation UNION ALL SELECT 'R' || r_regionkey, 'region', r_name, 'top' FROM region),
e AS (SELECT 'N' || n_nationkey AS source, 'R' || n_regionkey AS target, 'in' AS type FROM nation)"""


def graph(t):
    n, r = t("nation"), t("region")
    nodes = n.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.lit("nation").alias("label"), c("n_name").alias("name"), F.concat(F.lit("region "), "n_regionkey").alias("note"))
    nodes = nodes.union(r.select(F.concat(F.lit("R"), "r_regionkey"), F.lit("region"), "r_name", F.lit("top")))
    return nodes, n.select(F.concat(F.lit("N"), "n_nationkey").alias("source"), F.concat(F.lit("R"), "n_regionkey").alias("target"), F.lit("in").alias("type"))


@query("p1_search_entities", f"""
WITH {NODES}, near AS (SELECT source AS id, target AS o FROM e UNION SELECT target, source FROM e),
h AS (SELECT DISTINCT near.id FROM near JOIN n ON n.id = o WHERE contains(lower(name), 'a'))
SELECT n.*, CASE WHEN contains(lower(name), 'a') THEN 3 WHEN contains(lower(note), 'a') THEN 2 WHEN id IN (SELECT id FROM h) THEN 1 ELSE 0 END AS score FROM n
WHERE contains(lower(name), 'a') OR contains(lower(note), 'a') OR id IN (SELECT id FROM h)""")
def p1(t):
    nodes, edges = graph(t)
    return P.search_entities(nodes, edges, "A", ["name", "note"])


@query("p2_best_name", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END), ''), source) AS name FROM documents")
def p2(t):
    return t("documents").withColumn("short", F.when(c("doc_id") % 3 == 0, " ").otherwise(c("lang"))).select("doc_id", T.best_name("short", "source").alias("name"))


@query("p3_display_rows", """
SELECT p_partkey, property, label, value, place FROM (SELECT p_partkey, unnest([{'property': 'p_name', 'label': 'Name', 'value': p_name, 'place': 0}, {'property': 'p_brand', 'label': 'Brand', 'value': p_brand, 'place': 1}, {'property': 'p_size', 'label': 'Size', 'value': p_size::VARCHAR, 'place': 2}], recursive := true) FROM part) WHERE trim(coalesce(value, '')) <> ''""")
def p3(t):
    return P.display_rows(t("part"), "p_partkey", {"p_name": "Name", "p_brand": "Brand", "p_size": "Size"})


@query("p4_filter_observations", "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O'")
def p4(t):
    return P.filter_all(t("orders"), o_orderpriority=["1-URGENT", "2-HIGH"], o_orderstatus="O", o_custkey=None).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("p5_classify_status", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 7 = 0 THEN 'hypothetical' WHEN o_orderstatus = 'F' THEN 'reference' ELSE 'measured' END AS status FROM orders""")
def p5(t):
    s = F.when(c("o_orderstatus") == "P", "hypothetical").when(c("o_orderstatus") == "F", "reference").otherwise("measured")
    return t("orders").select("o_orderkey", P.classify_status(s, F.when(c("o_orderkey") % 7 == 0, F.array(F.lit("hypothetical")))).alias("status"))


@query("p6_filter_pairs", """
SELECT l_orderkey AS a, l_partkey AS b, count(*) AS n FROM lineitem WHERE (l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)) AND l_quantity > 25 GROUP BY ALL""")
def p6(t):
    pairs = t("lineitem").select(c("l_orderkey").alias("a"), c("l_partkey").alias("b"), F.array(F.struct(F.lit("quantity").alias("axis"), F.when(c("l_quantity") > 25, 1).otherwise(0).alias("matched_count"))).alias("axes"), "l_linenumber")
    o, p = t("orders").where("o_orderpriority = '1-URGENT'"), t("part").where("p_size < 10")
    left = pairs.join(o, c("a") == c("o_orderkey"), "left_semi").select("a", "b", "axes", "l_linenumber")
    right = pairs.join(p, c("b") == c("p_partkey"), "left_semi").select("a", "b", "axes", "l_linenumber").join(o, c("a") == c("o_orderkey"), "left_anti")
    return left.union(right).where(F.exists("axes", lambda x: (x["axis"] == "quantity") & (x["matched_count"] > 0))).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("p7_in_page_scope", """
SELECT doc_id, scope FROM documents, (VALUES ('short', 0, 999), ('middle', 1000, 4999), ('whole', 0, 1000000)) s(scope, low, high) WHERE n_chars >= low AND n_chars <= high""")
def p7(t):
    d = t("documents").select("doc_id", c("n_chars").alias("first"), c("n_chars").alias("last"))
    scopes = d.sparkSession.createDataFrame([("short", 0, 999), ("middle", 1000, 4999), ("whole", 0, 1_000_000)], "scope string, low long, high long")
    return P.in_page_scope(d, scopes).select("doc_id", "scope")


@query("p8_literal_units", "SELECT doc_id, lang FROM documents WHERE contains(text, 'License')")
def p8(t):
    return P.literal_units(t("documents"), "text", "License").select("doc_id", "lang")


@query("p9_page_lookup", "SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY o_custkey HAVING 5000 BETWEEN min(o_orderkey) AND max(o_orderkey)")
def p9(t):
    from stemma.operators.joins import page_lookup

    return page_lookup(t("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")), 5000)


@query("p10_publishable", """
SELECT page_id, CASE WHEN html LIKE '%login%' THEN 'gated' WHEN html NOT LIKE '%<article>%' THEN 'parse_not_ok' WHEN html LIKE '%<li>%' AND html NOT LIKE '%<a href%' THEN 'hits_without_groups' WHEN html LIKE '%<title></title>%' THEN 'group_without_label' END AS reason FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN html || 'login' WHEN 1 THEN replace(html, '<article>', '<div>') WHEN 2 THEN replace(html, '<a href', '<b href') WHEN 3 THEN html || '<title></title>' ELSE html END AS html FROM pages)""")
def p10(t):
    k, h = c("page_id"), c("html")
    pages = t("pages").withColumn("html", F.when(k % 6 == 0, F.concat(h, F.lit("login"))).when(k % 6 == 1, F.replace(h, F.lit("<article>"), F.lit("<div>"))).when(k % 6 == 2, F.replace(h, F.lit("<a href"), F.lit("<b href"))).when(k % 6 == 3, F.concat(h, F.lit("<title></title>"))).otherwise(h))
    return pages.select("page_id", P.reason({"gated": h.contains("login"), "parse_not_ok": ~h.contains("<article>"), "hits_without_groups": h.contains("<li>") & ~h.contains("<a href"), "group_without_label": h.contains("<title></title>")}).alias("reason"))


@query("p11_suspicious_rows", """
SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN contains(text, '###') THEN 'symbols' END], lambda x: x IS NOT NULL)) AS reason FROM documents
UNION ALL SELECT doc_id, 'longest' FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5)""")
def p11(t):
    d = t("documents")
    s = P.suspicious_rows(d, {"short": c("n_chars") < 200, "symbols": c("text").contains("###")}).select("doc_id", "reason")
    return s.union(K.top(d.select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 5).select("doc_id", F.lit("longest")))


@query("p12_text_quality", """
SELECT doc_id, CASE WHEN contains(text, chr(65533)) THEN 'garbled' WHEN regexp_matches(text, '\\p{Han}') THEN 'good' ELSE 'mixed' END AS quality FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, 'a', '章') WHEN 1 THEN replace(text, 'e', chr(65533)) ELSE text END AS text FROM documents)""")
def p12(t):
    text = F.when(c("doc_id") % 4 == 0, F.replace("text", F.lit("a"), F.lit("章"))).when(c("doc_id") % 4 == 1, F.replace("text", F.lit("e"), F.lit("\ufffd"))).otherwise(c("text"))
    return t("documents").select("doc_id", P.text_quality(text).alias("quality"))


@query("p13_drop_artifacts", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) FILTER (WHERE NOT regexp_matches(line, '^(All rights reserved|Licensed under)') AND NOT regexp_matches(line, '###|&&&')) AS kept, count(*) FILTER (WHERE regexp_matches(line, '###|&&&')) AS warnings FROM l GROUP BY doc_id""")
def p13(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    kept, warned = P.drop_artifacts(lines, "line", "^(All rights reserved|Licensed under)", "###|&&&")
    each = kept.select("doc_id", F.lit(1).alias("k"), F.lit(0).alias("w")).union(warned.select("doc_id", F.lit(0), F.lit(1)))
    silent = lines.select("doc_id", F.lit(0).alias("k"), F.lit(0).alias("w"))
    return each.union(silent).groupBy("doc_id").agg(F.sum("k").alias("kept"), F.sum("w").alias("warnings"))


UNIT_RULES = [("table", 0.9, "(\\*\\*\\*|&&&)"), ("license", 0.8, "[Ll]icense"), ("heading", 0.6, "^[^.]{1,60}$")]


@query("p14_classify_units", """
SELECT doc_id, CASE WHEN regexp_matches(text, '(\\*\\*\\*|&&&)') THEN 'table' WHEN regexp_matches(text, '[Ll]icense') THEN 'license' WHEN regexp_matches(text, '^[^.]{1,60}$') THEN 'heading' ELSE 'text' END AS type,
       CASE WHEN regexp_matches(text, '(\\*\\*\\*|&&&)') THEN 0.9 WHEN regexp_matches(text, '[Ll]icense') THEN 0.8 WHEN regexp_matches(text, '^[^.]{1,60}$') THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence FROM documents""")
def p14(t):
    return t("documents").select("doc_id", P.classify_units(c("text"), UNIT_RULES).alias("u")).select("doc_id", "u.type", "u.confidence")


@query("p15_pattern_seeds", """
WITH h AS (SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(text, 'tion') AND regexp_matches(source, '^src1') THEN 'tion-1' END, CASE WHEN regexp_matches(text, 'keit') AND regexp_matches(lang, 'de') THEN 'keit-de' END], lambda x: x IS NOT NULL)) AS rule FROM documents)
SELECT rule, count(*) AS n, list_slice(list_sort(list(doc_id)), 1, 10) AS examples FROM h GROUP BY rule""")
def p15(t):
    d = t("documents").withColumn("meta", F.concat_ws("|", "source", "lang"))
    return P.pattern_seeds(d, "doc_id", "text", "meta", [("tion-1", "tion", "^src1"), ("keit-de", "keit", "de")])


@query("p16_low_frequency", """
WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, count(*) AS n FROM w GROUP BY line HAVING count(*) BETWEEN 2 AND 3 AND length(line) >= 20""")
def p16(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).distinct()
    return lines.groupBy("line").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 3 AND length(line) >= 20")


@query("p17_marker_audit", """
SELECT event_id, unnest(list_filter([CASE WHEN regexp_matches(props, '\\b13\\b') THEN '13' END, CASE WHEN regexp_matches(props, '\\b42\\b') THEN '42' END], lambda x: x IS NOT NULL)) AS marker FROM events""")
def p17(t):
    return P.marker_audit(t("events"), "event_id", "props", ["13", "42"])


@query("k1_top_pairs", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 250")
def k1(t):
    return K.top(t("lineitem"), [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 250).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("k2_top_neighbors", """
WITH p AS (SELECT l_partkey AS a, 100000000 + l_suppkey AS b, sum(l_quantity) AS score FROM lineitem GROUP BY ALL), x AS (SELECT a AS id, b AS other, score FROM p UNION ALL SELECT b, a, score FROM p)
SELECT id, other, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM x) WHERE rank <= 8""")
def k2(t):
    return K.top_neighbors(t("lineitem").groupBy(c("l_partkey").alias("a"), (c("l_suppkey") + 100000000).alias("b")).agg(F.sum("l_quantity").alias("score")))


@query("k3_top_claims_per_span", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity - 20 AS score, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS pre FROM lineitem WHERE l_quantity > 20),
x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pre) AS rank FROM r WHERE pre <= 12 AND l_returnflag <> 'R') SELECT l_orderkey, l_linenumber, score, rank FROM x WHERE rank <= 3""")
def k3(t):
    s = t("lineitem").withColumn("score", c("l_quantity") - 20).where("score > 0")
    pre = K.top_per_key(s, ["l_orderkey"], [F.desc("score"), "l_linenumber", "l_partkey"], 12).withColumnRenamed("rank", "pre")
    return K.top_per_key(pre.where("l_returnflag != 'R'"), ["l_orderkey"], ["pre"], 3).select("l_orderkey", "l_linenumber", "score", "rank")


@query("k4_review_priority", """
SELECT l_orderkey, 5 * count(*) FILTER (WHERE l_returnflag = 'N') + 2 * count(*) FILTER (WHERE l_discount > 0.05) + abs(count(*) FILTER (WHERE l_linestatus = 'O') - count(*) FILTER (WHERE l_linestatus = 'F')) AS priority FROM lineitem GROUP BY l_orderkey ORDER BY priority DESC, l_orderkey LIMIT 20""")
def k4(t):
    n = lambda x: F.count_if(x)
    p = 5 * n(c("l_returnflag") == "N") + 2 * n(c("l_discount") > 0.05) + F.abs(n(c("l_linestatus") == "O") - n(c("l_linestatus") == "F"))
    return K.top(t("lineitem").groupBy("l_orderkey").agg(p.alias("priority")), [F.desc("priority"), "l_orderkey"], 20)


@query("k5_natural_sort", """
WITH s AS (SELECT DISTINCT o_custkey % 12 || '.' || o_orderkey % 30 AS id FROM orders) SELECT id, row_number() OVER (ORDER BY regexp_extract(id, '([0-9]+)', 1)::INT, regexp_extract(id, '[0-9]+[^0-9]+([0-9]+)', 1)::INT) AS place FROM s""")
def k5(t):
    from pyspark.sql import Window

    ids = t("orders").select(F.concat_ws(".", c("o_custkey") % 12, c("o_orderkey") % 30).alias("id")).distinct()
    return ids.withColumn("place", F.row_number().over(Window.orderBy(*K.natural_key("id"))))


@query("k6_strength_sort", """
WITH s AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS r FROM events) SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r, event_id) AS rank FROM s) WHERE rank <= 5""")
def k6(t):
    return K.top_per_key(t("events"), ["user_id"], [A.rank_in(c("event_type"), ["error", "purchase"]), "event_id"], 5).select("user_id", "event_id", "rank")


@query("k7_best_occurrence", """
WITH m AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 2 ELSE 0 END + CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS score, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS id FROM documents)
SELECT id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS r FROM m) WHERE r = 1""")
def k7(t):
    ids = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    return K.best_occurrence(t("documents"), ids, "doc_id", F.when(c("lang") == "en", 2).otherwise(0) + F.when(c("n_chars") > 2000, 1).otherwise(0))
