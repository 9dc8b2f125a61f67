"""Queries of the text, array and number functions (section 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import numerals, text as T
from stemma.operators import filters as P
from stemma.plans.registry import query

c = F.col
SOFT = "replace(text, chr(173), '')"


@query("f1_normalize_ws", f"SELECT doc_id, trim(regexp_replace({SOFT}, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text FROM documents")
def f1(t):
    return t("documents").select("doc_id", T.normalize_ws("text").alias("text"))


VARIANTS = {"é": "e", "è": "e", "ü": "u", "ö": "o", "ç": "c"}


@query("f2_normalize_key", "SELECT doc_id, regexp_replace(translate(text, 'éèüöç', 'eeuoc'), '[\\x20\\x09-\\x0D.,;:!?]+', '', 'g') AS key FROM documents")
def f2(t):
    return t("documents").select("doc_id", T.normalize_key("text", VARIANTS).alias("key"))


@query("f3_query_terms", """
SELECT p_partkey, list_sort(list_distinct(list_filter(w || list_transform(w, lambda x: x[1:2]) || list_transform(w, lambda x: x[1:3]), lambda x: length(x) >= 2))) AS terms FROM (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[^a-z]+'), lambda x: length(x) >= 3) AS w FROM part)""")
def f3(t):
    words = F.filter(F.split(F.lower("p_name"), "[^a-z]+", -1), lambda x: F.length(x) >= 3)
    every = F.concat(words, F.transform(words, lambda x: F.substring(x, 1, 2)), F.transform(words, lambda x: F.substring(x, 1, 3)))
    return t("part").select("p_partkey", F.array_sort(F.array_distinct(F.filter(every, lambda x: F.length(x) >= 2))).alias("terms"))


@query("f4_variants", """
WITH g AS (SELECT DISTINCT p_brand, unnest([p_brand] || list_transform(range(1, length(p_brand)), lambda i: p_brand[i:i + 1])) AS v FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(v) DESC, v) AS n FROM g)
SELECT p_brand, list(v ORDER BY n) AS variants FROM r WHERE n <= 12 GROUP BY p_brand""")
def f4(t):
    return t("part").select("p_brand").distinct().select("p_brand", T.variants("p_brand").alias("variants"))


@query("f5_char_ngrams", "SELECT g AS gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(p_name) - 1), lambda i: p_name[i:i + 2])) AS g FROM part) GROUP BY g")
def f5(t):
    return t("part").select(F.explode(T.char_ngrams("p_name", 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("f6_suffix_phrases", """
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') || [p_type, p_brand] AS w FROM part), g AS (SELECT p_partkey, unnest(range(2, 7)) AS n, w FROM w), h AS (SELECT p_partkey, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM g WHERE len(w) >= n)
SELECT phrase, count(*) AS n FROM (SELECT array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase, w[i + n - 1] AS last FROM h) WHERE last IN ('PROMO', 'ring') GROUP BY phrase""")
def f6(t):
    words = F.concat(F.split("p_name", " "), F.array("p_type", "p_brand"))
    return t("part").select(F.explode(T.suffix_phrases(words, ["PROMO", "ring"])).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


@query("f7_split_sentences", "SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？\\n]+'), lambda x: trim(x)), lambda x: x <> ''))::INT AS sentences, len(list_filter(list_transform(regexp_split_to_array(text, '[.,;:!?。，；：！？\\n]+'), lambda x: trim(x)), lambda x: x <> ''))::INT AS clauses FROM documents")
def f7(t):
    return t("documents").select("doc_id", F.size(T.split_sentences("text")).alias("sentences"), F.size(T.split_clauses("text")).alias("clauses"))


@query("f8_extract_numbers", "SELECT event_id, list_transform(regexp_extract_all(props, '[0-9]+'), lambda x: x::BIGINT) AS numbers FROM events")
def f8(t):
    return t("events").select("event_id", T.extract_numbers("props").cast("array<bigint>").alias("numbers"))


@query("f9_numerals", "SELECT o_orderkey, translate(o_orderkey::VARCHAR, '0123456789', '〇一二三四五六七八九') AS numeral, o_orderkey AS value FROM orders")
def f9_numerals(t):
    """Written numerals from order keys, read back by the vectorised function."""
    digits = "〇一二三四五六七八九"
    return t("orders").select("o_orderkey", F.translate(c("o_orderkey").cast("string"), "0123456789", digits).alias("numeral")).withColumn("value", numerals.numeral_value_udf("numeral"))


@query("f9_extract_constants", """
WITH d AS (SELECT o_orderkey, o_custkey % 300 AS source, 'const' || o_orderkey % 9 AS name, o_orderkey::VARCHAR AS v FROM orders), f AS (SELECT source, name, min(o_orderkey) AS span FROM d WHERE o_orderkey % 4 <> 3 AND o_orderkey % 5 <> 4 GROUP BY ALL)
SELECT source, name, span, translate(span::VARCHAR, '0123456789', '〇一二三四五六七八九') AS numeral, span AS value FROM f""".replace("'const' || o_orderkey % 9", "'const ' || ['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i'][1 + o_orderkey % 9]"))
def f9(t):
    """First constants of (source, name) in sentences that some order keys write out, and other sentences."""
    k = c("o_orderkey")
    numeral = F.translate(k.cast("string"), "0123456789", "〇一二三四五六七八九")
    name = F.concat(F.lit("const "), F.get(F.array(*map(F.lit, "abcdefghi")), (k % 9).cast("int")))
    text = F.when(k % 5 == 4, F.concat(name, F.lit("，"), numeral)).otherwise(F.concat(name, numeral, F.lit("。")))
    spans = t("orders").select((c("o_custkey") % 300).alias("source"), k.alias("id"), F.when(k % 4 == 3, "other").otherwise("constant").alias("kind"), text.alias("text"))
    return numerals.extract_constants(spans)


@query("f9_numeral_values", """
SELECT p_partkey, p_partkey * 10000 + p_size * 100 + p_partkey % 10 AS value FROM part""")
def f9_values(t):
    """Written numbers with units, read back."""
    k, digit = c("p_partkey"), lambda x: F.translate(x.cast("string"), "0123456789", "〇一二三四五六七八九")
    numeral = F.concat(F.when(k > 0, F.concat(digit(k), F.when(k % 2 == 0, "万").otherwise("萬"))).otherwise(""), digit(c("p_size")), F.lit("百"), digit(k % 10))
    return t("part").select("p_partkey", numerals.numeral_value_udf(numeral).alias("value"))


@query("f10_template", "SELECT l_comment, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(event_type || ' ' || user_id || ' ' || props, '[0-9]+', '[NUM]', 'g'), 'k', '[KEY]', 'g') AS l_comment FROM events) GROUP BY l_comment")
def f10(t):
    return t("events").select(T.template(F.concat_ws(" ", "event_type", "user_id", "props"), [("[KEY]", "k")]).alias("l_comment")).groupBy("l_comment").agg(F.count("*").alias("n"))


@query("f11_specificity", "SELECT p_name, length(regexp_replace(p_name, '[^a-z]', '', 'g')) - 0.0 AS specificity FROM (SELECT DISTINCT p_name FROM part)")
def f11(t):
    return t("part").select("p_name").distinct().withColumn("specificity", T.specificity("p_name"))


@query("f12_pattern_matches", """
WITH p AS (SELECT doc_id, string_split(text, 'tion') AS parts FROM documents), e AS (SELECT doc_id, parts, unnest(range(1, len(parts))) AS i FROM p)
SELECT doc_id, count(*) AS n, min(p)::INT AS first, max(p)::INT AS last FROM (SELECT doc_id, list_sum(list_transform(list_slice(parts, 1, i), lambda x: length(x))) + 4 * (i - 1) AS p FROM e) GROUP BY doc_id""")
def f12(t):
    each = t("documents").select("doc_id", F.explode(T.all_occurrences("text", F.lit("tion"))).alias("at"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


LABELS = {"metal": ["STEEL", "TIN", "COPPER"], "finish": ["PLATED", "POLISHED"], "size": ["SMALL", "LARGE"]}


@query("f13_detect_labels", """
SELECT p_type, list_filter([CASE WHEN contains(p_type, 'STEEL') OR contains(p_type, 'TIN') OR contains(p_type, 'COPPER') THEN 'metal' END, CASE WHEN contains(p_type, 'PLATED') OR contains(p_type, 'POLISHED') THEN 'finish' END, CASE WHEN contains(p_type, 'SMALL') OR contains(p_type, 'LARGE') THEN 'size' END], lambda x: x IS NOT NULL) AS labels FROM (SELECT DISTINCT p_type FROM part)""")
def f13(t):
    return t("part").select("p_type").distinct().withColumn("labels", T.detect_labels("p_type", LABELS))


@query("f14_ordered_subsequence", """
WITH e AS (SELECT user_id, event_id // 500 AS part, string_agg(CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'purchase' THEN 'p' ELSE 'x' END, '' ORDER BY event_id) AS s FROM events GROUP BY ALL) SELECT user_id, part, s LIKE '%v%c%p%v%' AS found FROM e""")
def f14(t):
    seq = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"])
    return t("events").groupBy("user_id", F.floor(c("event_id") / 500).alias("part")).agg(seq.alias("seq")).select("user_id", "part", T.ordered_subsequence("seq", ["view", "click", "purchase", "view"]).alias("found"))


def letters(text):
    return F.filter(F.split(text, ""), lambda x: x != "")


@query("f15_lcs_length", """
WITH RECURSIVE k AS (SELECT DISTINCT lower(p_type) AS a, p_name AS b FROM part),
g AS (SELECT a, b, 1 AS i, 0 AS j, list_transform(range(length(b) + 1), lambda x: 0) AS above, [0] AS here FROM k
  UNION ALL SELECT a, b, CASE WHEN j < length(b) THEN i ELSE i + 1 END, CASE WHEN j < length(b) THEN j + 1 ELSE 0 END, CASE WHEN j < length(b) THEN above ELSE here END,
    CASE WHEN j < length(b) THEN list_append(here, CASE WHEN a[i:i] = b[j + 1:j + 1] THEN above[j + 1] + 1 ELSE greatest(above[j + 2], here[j + 1]) END) ELSE [0] END FROM g WHERE NOT (i = length(a) AND j = length(b)))
SELECT p_partkey, here[length(b) + 1]::INT AS lcs FROM part JOIN g ON lower(p_type) = a AND p_name = b WHERE i = length(a) AND j = length(b)""")
def f15(t):
    """Longest common subsequence of the letters of part type and name."""
    return t("part").select("p_partkey", T.lcs_length(letters(F.lower("p_type")), letters("p_name")).alias("lcs"))


@query("f15_lcs_pairs")
def f15_pairs(t):
    """Places of a longest common subsequence of part type and name letters; tests hold it to the table's length."""
    return t("part").select("p_partkey", T.lcs_pairs(letters(F.lower("p_type")), letters("p_name")).alias("pairs"))


@query("f16_clean_role", "SELECT DISTINCT p_type, regexp_replace(regexp_replace(lower(trim('the ' || p_type || '.')), '^(the|a|an) +', ''), '^[.,;:]+|[.,;:]+$', '', 'g') AS role FROM part")
def f16(t):
    return t("part").select("p_type", T.clean_role(F.concat(F.lit("the "), "p_type", F.lit("."))).alias("role")).distinct()


@query("f17_lexicon_hits", """
SELECT doc_id, term, instr(text, term) - 1 AS first FROM documents, (VALUES ('tion'), ('keit'), ('eau'), ('License')) l(term) WHERE contains(text, term)""")
def f17(t):
    return P.lexicon_hits(t("documents"), "doc_id", "text", ["tion", "keit", "eau", "License"])


@query("f18_all_occurrences", """
SELECT doc_id, (length(text) - length(replace(text, 'anan', '')))::INT // 4 AS apart FROM documents""")
def f18(t):
    return t("documents").select("doc_id", F.size(T.apart(T.all_occurrences("text", F.lit("anan")), 4)).alias("apart"))


@query("f19_year_in_range", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1994 END, -9999) <= year(o_orderdate) AND year(o_orderdate) <= coalesce(CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1996 END, 9999) AS inside FROM orders")
def f19(t):
    return t("orders").select("o_orderkey", T.year_in_range(F.year("o_orderdate"), F.when(c("o_orderkey") % 3 != 0, 1994), F.when(c("o_orderkey") % 2 != 0, 1996)).alias("inside"))


@query("f20_axis_level", """
WITH s AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS m, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN m / n >= 0.67 THEN 'strong' WHEN m / n >= 0.34 THEN 'partial' WHEN m > 0 THEN 'weak' ELSE 'none' END AS level, least(greatest(m / n, 0.2), 0.8) AS clamped FROM s""")
def f20(t):
    s = t("lineitem").groupBy("l_orderkey").agg(F.count_if(c("l_returnflag") == "R").alias("m"), F.count("*").alias("n"))
    return s.select("l_orderkey", T.axis_level("m", "n").alias("level"), T.clamp(c("m") / c("n"), 0.2, 0.8).alias("clamped"))


@query("f21_operation_signature", "SELECT DISTINCT event_type || '(' || lower('User') || ',' || (user_id % 5) || ')->' || CASE WHEN value > 25 THEN 'high' ELSE '?' END AS signature FROM events")
def f21(t):
    return t("events").select(T.operation_signature("event_type", F.array(F.lit(" User "), (c("user_id") % 5).cast("string")), F.when(c("value") > 25, "high")).alias("signature")).distinct()


@query("f22_floor_divmod", """
SELECT l_orderkey, l_linenumber, l_partkey - 1000 AS a, floor((l_partkey - 1000) / 7)::BIGINT AS q, (l_partkey - 1000) - 7 * floor((l_partkey - 1000) / 7)::BIGINT AS r, sign((l_partkey - 1000) * 9 - (l_suppkey - 50) * 7)::INT AS cmp, floor((l_partkey - 1000) * 60 / 7)::BIGINT AS sixtieths FROM lineitem""")
def f22(t):
    i = t("lineitem").select("l_orderkey", "l_linenumber", (c("l_partkey") - 1000).alias("a"), (c("l_suppkey") - 50).alias("b"))
    seven, nine = F.lit(7), F.lit(9)
    return i.select("l_orderkey", "l_linenumber", "a", T.floor_div("a", seven).alias("q"), T.floor_mod("a", seven).alias("r"), T.ratio_compare("a", seven, "b", nine).alias("cmp"), T.ratio_rescale("a", seven, F.lit(60)).alias("sixtieths"))


@query("f24_json_field", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def f24(t):
    return t("events").select("event_id", T.json_field("props", "$.k").cast("int").alias("k"))


@query("f26_mark_refs", "SELECT p_partkey, regexp_replace(p_name || p_size % 9, '([A-Za-z])([0-9]+)$', '\\1[^\\2]') AS text FROM part")
def f26(t):
    """Numbers after words in part names become references; compared to hand-made cases in the tests."""
    return t("part").select("p_partkey", T.mark_refs(F.concat("p_name", (c("p_size") % 9).cast("string")), F.array((c("p_size") % 9).cast("string"))).alias("text"))


@query("f27_parameter_fields", "SELECT event_id, regexp_extract_all(replace(props, '\"', ''), '([a-z_]+)[:=] ?([0-9]+)', 1) AS names, regexp_extract_all(replace(props, '\"', ''), '([a-z_]+)[:=] ?([0-9]+)', 2) AS vals FROM events")
def f27(t):
    p = t("events").select("event_id", T.parameter_fields(F.replace("props", F.lit('"'), F.lit(""))).alias("p"))
    return p.select("event_id", c("p.name").alias("names"), c("p.value").alias("vals"))
