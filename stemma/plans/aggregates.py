"""Queries of the aggregate operators (section 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import aggregates as A
from stemma.plans.registry import query

TOKENS = "SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS token FROM documents"


def tokens_of(docs):
    return docs.select("doc_id", F.explode(T.tokens("text")).alias("token"))


@query("a1_count_by", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> '' GROUP BY event_type")
def a1(t):
    return A.count_by(t("events"), "event_type")


@query("a2_top_terms", f"""
WITH t AS ({TOKENS}), top AS (SELECT token, count(*) AS n FROM t GROUP BY token ORDER BY n DESC, token LIMIT 50)
SELECT top.token, top.n, (SELECT list_slice(list_sort(list(DISTINCT doc_id)), 1, 5) FROM t WHERE t.token = top.token) AS examples FROM top""")
def a2(t):
    return A.top_terms(tokens_of(t("documents")), "token", "doc_id", 50)


@query("a3_postings", f"""
SELECT token, block, list_sort(list(doc_id)) AS docs, count(*) AS n FROM (SELECT DISTINCT token, doc_id, doc_id // 10000 AS block FROM ({TOKENS})) GROUP BY token, block""")
def a3(t):
    return A.posting_lists(A.postings(t("documents"), "doc_id", "text"))


@query("a4_length_stats", """
SELECT lang, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 2) AS mean, count(*) FILTER (WHERE length(text) = 0) AS empty FROM documents GROUP BY lang""")
def a4(t):
    return A.length_stats(t("documents"), "text", "lang")


@query("a5_conditional_counts", """
SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount > 0.05) AS discounted,
       count(*) FILTER (WHERE l_quantity >= 25 AND l_linestatus = 'O') AS large_open, count(*) FILTER (WHERE l_tax = 0) AS untaxed FROM lineitem""")
def a5(t):
    c = F.col
    return A.conditional_counts(t("lineitem"), {"returned": c("l_returnflag") == "R", "discounted": c("l_discount") > 0.05, "large_open": (c("l_quantity") >= 25) & (c("l_linestatus") == "O"), "untaxed": c("l_tax") == 0})


CLAUSES = "SELECT doc_id AS chunk, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.,;:!?。，；：！？\\n]+'), lambda x: trim(x)), lambda x: x <> '')) AS clause FROM documents"
RULES = [(" [ART] ", " (the|an|a) "), (" [CONJ] ", " (and|or) ")]
TEMPLATES = f"SELECT chunk, regexp_replace(regexp_replace(regexp_replace(clause, '[0-9]+', '[NUM]', 'g'), ' (the|an|a) ', ' [ART] ', 'g'), ' (and|or) ', ' [CONJ] ', 'g') AS template FROM ({CLAUSES})"
SPECIFICITY = "length(regexp_replace(regexp_replace({0}, '\\[[A-Z]+\\]', '', 'g'), '[^a-z]', '', 'g')) - 0.5 * len(regexp_extract_all({0}, '\\[[A-Z]+\\]'))"


def clauses_of(docs):
    return docs.select(F.col("doc_id").alias("chunk"), F.posexplode(T.split_clauses("text")).alias("at", "clause"))


@query("a6_template_aggregate", f"""
SELECT template, sum(n)::BIGINT AS n, count(*) AS n_chunks, list_slice(list_sort(list(chunk)), 1, 10) AS examples, {SPECIFICITY.format('template')} AS specificity,
       {SPECIFICITY.format('template')} < 2 AS overgeneral FROM (SELECT template, chunk, count(*) AS n FROM ({TEMPLATES}) GROUP BY ALL) GROUP BY template""")
def a6(t):
    c = clauses_of(t("documents"))
    return A.template_aggregate(c.select("chunk", T.template("clause", RULES).alias("template")))


PAIRS = """
SELECT l_returnflag || '-' || l_linestatus || '-' || l_partkey % 600 AS "left", o_orderpriority AS "right", o_orderkey AS chunk,
       ['single', 'ordinal', 'near', 'preset', 'one_to_many', 'cooccurrence'][6 - l_linenumber % (l_partkey % 6 + 1)] AS strength FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query("a7_pair_aggregate", f"""
WITH p AS ({PAIRS}), g AS (SELECT "left", "right", count(*) AS n, count(DISTINCT chunk) AS n_chunks, count(*) FILTER (WHERE strength = 'single') AS single, count(*) FILTER (WHERE strength = 'ordinal') AS ordinal,
   count(*) FILTER (WHERE strength = 'near') AS near, count(*) FILTER (WHERE strength = 'preset') AS preset, count(*) FILTER (WHERE strength = 'one_to_many') AS one_to_many, count(*) FILTER (WHERE strength = 'cooccurrence') AS cooccurrence FROM p GROUP BY ALL)
SELECT *, CASE WHEN single > 0 THEN 'single' WHEN ordinal > 0 THEN 'ordinal' WHEN near > 0 THEN 'near' WHEN preset > 0 THEN 'preset' WHEN one_to_many > 0 THEN 'one_to_many' ELSE 'cooccurrence' END AS best,
       (3 * n_chunks + 8 * single + 6 * ordinal + 3 * near + {SPECIFICITY.format('"left"')})::DOUBLE AS priority FROM g""")
def a7(t):
    p = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = F.get(F.array(*map(F.lit, A.STRENGTHS)), (5 - F.col("l_linenumber") % (F.col("l_partkey") % 6 + 1)).cast("int"))
    return A.pair_aggregate(p.select(F.concat_ws("-", "l_returnflag", "l_linestatus", F.col("l_partkey") % 600).alias("left"), F.col("o_orderpriority").alias("right"), F.col("o_orderkey").alias("chunk"), s.alias("strength")))


@query("a8_strongest", """
SELECT user_id, ['error', 'purchase', 'signup', 'click', 'view'][min(CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 5 END) + 1] AS event_type FROM events GROUP BY user_id""")
def a8(t):
    return A.strongest(t("events"), ["user_id"], "event_type", ["error", "purchase", "signup", "click", "view"])


@query("a9_first_by_key", """
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def a9(t):
    return A.first_by_key(t("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("a10_lexicon", """
WITH e AS (SELECT lower(p_brand) AS text, p_partkey AS evidence, 'manual' AS source FROM part UNION ALL SELECT lower(unnest(string_split(p_name, ' '))), p_partkey, 'derived' FROM part)
SELECT trim(text) AS text, max(source) AS source, count(DISTINCT evidence) AS n_evidence, min(evidence) AS first_evidence, length(trim(text)) AS length FROM e WHERE length(trim(text)) >= 2 GROUP BY trim(text)""")
def a10(t):
    p = t("part")
    return A.lexicon(p.select(F.lower("p_brand").alias("text"), F.col("p_partkey").alias("evidence")), p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("text"), F.col("p_partkey").alias("evidence")))


@query("a14_decision_metrics", """
SELECT event_type AS action, actor, count(*) AS n, sum(CASE WHEN actor = 'human' THEN value END) AS human_seconds
FROM (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'human' ELSE 'script' END AS actor FROM events) GROUP BY ALL""")
def a14(t):
    e = t("events").select(F.col("event_type").alias("action"), F.when(F.col("user_id") % 3 == 0, "human").otherwise("script").alias("actor"), F.col("value").alias("seconds"))
    return A.decision_metrics(e)


SCORED = "SELECT source, lang, quality = 1 AS gold, n_chars >= 1000 AS guess FROM labels JOIN documents USING (doc_id)"
PR = "count(*) FILTER (WHERE gold AND guess) AS tp, count(*) FILTER (WHERE NOT gold AND guess) AS fp, count(*) FILTER (WHERE gold AND NOT guess) AS fn"
RATES = "tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall"


def scored(t, *by):
    return A.precision_recall(t("labels").join(t("documents"), "doc_id"), F.col("quality") == 1, F.col("n_chars") >= 1000, *by)


@query("a15_precision_recall", f"SELECT *, {RATES} FROM (SELECT source, {PR} FROM ({SCORED}) GROUP BY source)")
def a15(t):
    return scored(t, "source")


@query("a16_macro_average", f"""
SELECT lang, avg(precision) AS precision, avg(recall) AS recall, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn
FROM (SELECT *, {RATES} FROM (SELECT lang, source, {PR} FROM ({SCORED}) GROUP BY ALL)) GROUP BY lang""")
def a16(t):
    return A.macro_average(scored(t, "lang", "source"), "lang")


@query("a17_benchmark_verdict", """
WITH r AS (SELECT o_orderkey, list_filter([CASE WHEN o_totalprice > 200000 THEN 'price' END, CASE WHEN o_orderstatus = 'F' THEN 'status' END, CASE WHEN o_custkey % 2 = 1 THEN 'customer' END], lambda x: x IS NOT NULL) AS reasons FROM orders)
SELECT *, CASE WHEN len(reasons) = 0 THEN 'pass' WHEN len(reasons) <= 2 THEN 'partial' ELSE 'fail' END AS verdict FROM r""")
def a17(t):
    c = F.col
    return A.benchmark_verdict(t("orders"), {"price": c("o_totalprice") > 200000, "status": c("o_orderstatus") == "F", "customer": c("o_custkey") % 2 == 1}).select("o_orderkey", "reasons", "verdict")


@query("a18_coverage_rate", """
SELECT source, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(l.doc_id) / count(*), 4) END AS rate FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def a18(t):
    d = t("documents").join(t("labels").select(F.col("doc_id").alias("labelled")), F.col("doc_id") == F.col("labelled"), "left")
    return d.groupBy("source").agg(A.coverage_rate(F.count("labelled"), F.count("*")).alias("rate"))


@query("a19_duplicates", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a19(t):
    return A.duplicates(t("lineitem"), "l_orderkey", "l_suppkey")


@query("a20_relation_stats", """
SELECT object, count(*) AS n, count(DISTINCT p_partkey) AS subjects FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS object FROM part) GROUP BY object""")
def a20(t):
    return A.relation_stats(t("part").withColumn("o", F.split("p_name", " ")), "p_partkey", "o")


@query("a21_group_observations", "SELECT o_orderpriority, year(o_orderdate) AS period, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY ALL")
def a21(t):
    return t("orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("period")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


WARNINGS = """SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN text LIKE '%###%' OR text LIKE '%***%' THEN 'symbols' END, CASE WHEN lower(text) LIKE '%license%' THEN 'license' END], lambda x: x IS NOT NULL)) AS code FROM documents"""


@query("a22_warning_summary", f"""
SELECT code, CASE WHEN code = 'symbols' THEN 'error' ELSE 'warning' END AS severity, count(*) AS n, count(DISTINCT doc_id) AS chunks FROM ({WARNINGS}) GROUP BY code""")
def a22(t):
    from stemma.operators.filters import suspicious_rows

    c = F.col
    w = suspicious_rows(t("documents"), {"short": c("n_chars") < 200, "symbols": c("text").contains("###") | c("text").contains("***"), "license": F.lower("text").contains("license")})
    return w.groupBy(c("reason").alias("code")).agg(F.max(F.when(c("reason") == "symbols", "error").otherwise("warning")).alias("severity"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("chunks"))


@query("a23_tag_groups", """
SELECT tag, count(*) AS n FROM (SELECT unnest(CASE WHEN event_type IN ('click', 'view', 'error') THEN [event_type] ELSE ['untagged'] END) AS tag FROM events) GROUP BY tag""")
def a23(t):
    return A.tag_groups(t("events"), F.array("event_type"), ["click", "view", "error"])


@query("a24_operation_cue_counts", """
SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), 'tion|ing'))::BIGINT AS suffixes, len(regexp_extract_all(coalesce(text, ''), 'ther|the'))::BIGINT AS articles, len(regexp_extract_all(coalesce(text, ''), 'and|or'))::BIGINT AS joins FROM documents""")
def a24(t):
    return A.operation_cue_counts(t("documents"), "text", {"suffixes": ["ing", "tion"], "articles": ["the", "ther"], "joins": ["or", "and"]}, "doc_id")


@query("a25_review_status_counts", """
WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS status FROM events WHERE event_type <> 'view' GROUP BY user_id)
SELECT coalesce(l.status, 'unreviewed') AS status, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN last l USING (user_id) GROUP BY ALL""")
def a25(t):
    return A.review_status_counts(t("events").select(F.col("user_id").alias("unit"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("status")))


@query("a26_rejected_families", """
SELECT event_type AS family, event_id // 10000 AS part, list_sort(list(event_id)) AS ids FROM events WHERE value > 40 GROUP BY ALL""")
def a26(t):
    """Ids of rejected rows by family, in blocks of ids, so that a list has a bound however frequent its family."""
    return t("events").where("value > 40").groupBy(F.col("event_type").alias("family"), F.floor(F.col("event_id") / 10_000).alias("part")).agg(F.sort_array(F.collect_list("event_id")).alias("ids"))


@query("a27_cardinality_audit", """
WITH k AS (SELECT DISTINCT l_partkey AS l, l_suppkey AS r FROM lineitem WHERE l_quantity > 49)
SELECT (SELECT count(*) FROM (SELECT l FROM k GROUP BY l HAVING count(*) > 1)) AS one_to_many, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l FROM k)) AS left_alone,
       (SELECT count(*) FROM (SELECT r FROM k GROUP BY r HAVING count(*) > 1)) AS many_to_one, (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT r FROM k)) AS right_alone""")
def a27(t):
    links = t("lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("l"), F.col("l_suppkey").alias("r"))
    return A.cardinality_audit(links, t("part").select(F.col("p_partkey").alias("l")), t("supplier").select(F.col("s_suppkey").alias("r")))


@query("a28_quality_verdict", """
SELECT source, CASE WHEN count(*) FILTER (WHERE n_chars < 500) > 0.12 * count(*) OR count(*) FILTER (WHERE n_chars < 20) > 0 THEN 'usable_but_needs_review' ELSE 'usable' END AS verdict FROM documents GROUP BY source""")
def a28(t):
    n = F.col("n_chars")
    return t("documents").groupBy("source").agg(A.quality_verdict(F.count_if(n < 500), F.count("*"), F.count_if(n < 20)).alias("verdict"))


@query("a29_page_range", """
WITH l AS (SELECT o_custkey, o_orderkey AS pos, o_orderkey // 100 AS page, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE (o_orderkey % 50)::VARCHAR END AS book FROM orders)
SELECT o_custkey, min(page) AS first_page, max(page) AS last_page, arg_min(book, CASE WHEN book <> 'x' THEN pos END) AS first_book, arg_max(book, CASE WHEN book <> 'x' THEN pos END) AS last_book FROM l GROUP BY o_custkey""")
def a29(t):
    k = F.col("o_orderkey")
    lines = t("orders").select("o_custkey", k.alias("pos"), F.floor(k / 100).alias("page"), F.when(k % 3 == 0, "x").otherwise((k % 50).cast("string")).alias("book"))
    return A.page_range(lines, "o_custkey")


@query("a30_merge_entries", """
WITH e AS (SELECT user_id AS id, event_id AS pos, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS title FROM events)
SELECT id, min(pos) AS pos, arg_min(title, CASE WHEN title <> '' THEN pos END) AS title FROM e GROUP BY id""")
def a30(t):
    return A.merge_entries(t("events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")).alias("title")))


@query("a31_parameter_index", """
WITH p AS (SELECT p_brand AS name, CASE WHEN p_size % 2 = 0 THEN p_type END AS scope, p_partkey AS unit FROM part)
SELECT key, count(*) AS n, min(unit) AS first_unit FROM (SELECT name AS key, unit FROM p UNION ALL SELECT scope || '::' || name, unit FROM p WHERE scope IS NOT NULL) GROUP BY key""")
def a31(t):
    return A.parameter_index(t("part").select(F.col("p_brand").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("scope"), F.col("p_partkey").alias("unit")))


@query("a32_target_span_audit", """
WITH b AS (SELECT l_orderkey, min(CASE WHEN l_discount <= 0.02 THEN 0 WHEN l_discount <= 0.05 THEN 1 ELSE 2 END) AS r FROM lineitem GROUP BY l_orderkey)
SELECT ['direct', 'partial', 'context'][r + 1] AS quality, count(*) AS n FROM b GROUP BY r""")
def a32(t):
    q = F.when(F.col("l_discount") <= 0.02, "direct").when(F.col("l_discount") <= 0.05, "partial").otherwise("context")
    return A.count_by(A.strongest(t("lineitem").withColumn("quality", q), ["l_orderkey"], "quality", ["direct", "partial", "context"]), "quality")


@query("a13_term_index", """
WITH RECURSIVE o AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id, l_partkey AS surface, CASE WHEN l_linenumber = 1 THEN 'maximal' ELSE 'component' END AS level, l_linenumber AS line FROM lineitem),
p AS (SELECT DISTINCT a.id, a.id - a.line + a.line // 2 AS parent FROM o a WHERE line > 1 AND a.id - a.line + a.line // 2 IN (SELECT id FROM o)),
r AS (SELECT id AS node, parent AS ancestor FROM p UNION SELECT r.node, p.parent FROM r JOIN p ON p.id = r.ancestor),
d AS (SELECT surface, count(DISTINCT parent) AS n_parents, min(parent) AS first_parent FROM o JOIN p USING (id) GROUP BY surface), w AS (SELECT surface, count(DISTINCT ancestor) AS appears_in_compounds FROM o JOIN r ON id = node GROUP BY surface),
c AS (SELECT surface, count(*) AS n, count(*) FILTER (WHERE level = 'maximal') AS n_maximal, count(*) FILTER (WHERE level = 'component') AS n_component FROM o GROUP BY surface)
SELECT c.*, coalesce(appears_in_compounds, 0) AS appears_in_compounds, CASE WHEN n_maximal > 0 AND n_component > 0 THEN 'both' WHEN n_maximal > 0 THEN 'maximal' ELSE 'component' END AS kind, coalesce(n_parents, 0) AS n_parents, first_parent FROM c LEFT JOIN d USING (surface) LEFT JOIN w USING (surface)""")
def a13(t):
    """Lines of an order as a tree of occurrences: line n stands in line n / 2."""
    k, n = F.col("l_orderkey") * 8, F.col("l_linenumber")
    o = t("lineitem").select((k + n).alias("id"), F.col("l_partkey").alias("surface"), F.when(n == 1, "maximal").otherwise("component").alias("level")).distinct()
    parents = t("lineitem").where("l_linenumber > 1").select((k + n).alias("id"), (k + F.floor(n / 2)).alias("parent")).distinct()
    return A.term_index(o, parents)


@query("a11_procedure_bank", """
WITH c AS (SELECT c_mktsegment AS profile, o_orderkey, o_orderpriority, l_shipdate, l_returnflag, l_linestatus, CASE WHEN l_discount <= 0.02 THEN 0 WHEN l_discount <= 0.05 THEN 1 ELSE 2 END AS r
  FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey)
SELECT profile, count(DISTINCT o_orderkey) AS n_chunks, count(*) AS n_claims, list_sort(list(DISTINCT o_orderpriority)) AS operations, list_sort(list(DISTINCT l_returnflag)) AS inputs, list_sort(list(DISTINCT l_linestatus)) AS outputs, ['A', 'B', 'C'][min(r) + 1] AS strongest
FROM c GROUP BY profile""")
def a11(t):
    from stemma.operators.banks import procedure_bank

    c = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    level = F.when(F.col("l_discount") <= 0.02, "A").when(F.col("l_discount") <= 0.05, "B").otherwise("C")
    return procedure_bank(c.select(F.col("c_mktsegment").alias("profile"), F.col("o_orderkey").alias("chunk"), F.col("o_orderpriority").alias("operation"), F.col("l_returnflag").alias("input"), F.col("l_linestatus").alias("output"), level.alias("level")))


@query("a12_procedure_vector", """
SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS operations, bool_or(l_discount > 0.09) AS has_check, list_sort(list(DISTINCT l_suppkey % 7)) AS moduli, count(*) FILTER (WHERE l_linestatus = 'O') AS open_steps FROM lineitem GROUP BY l_orderkey""")
def a12(t):
    return t("lineitem").groupBy("l_orderkey").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda s: s["l_returnflag"]).alias("operations"), F.bool_or(F.col("l_discount") > 0.09).alias("has_check"),
        F.sort_array(F.collect_set(F.col("l_suppkey") % 7)).alias("moduli"), F.count_if(F.col("l_linestatus") == "O").alias("open_steps"),
    )
