"""Filter of URLs by host and path rules, and by character models where no rule fits; DataFrame functions only.

A rule names a host, which stands for its subdomains too, and the beginning of a path; the
longest rule that fits decides. URLs that rules accept or reject train two Markov models of
variable order over the characters of host and path: counts of every context of up to
``ORDER`` characters, each smoothed by the next shorter one. A context met fewer than
``MIN_SEEN`` times counts as not met, so the order used follows what the corpus holds. URLs
without a rule are judged by the difference of the two log-likelihoods for each character,
against a threshold calibrated on the fifth of the ruled URLs that training leaves out.

All ruled URLs train, so the counts grow with the input. They are kept by distinct windows of
``ORDER`` + 1 characters: windows are counted before they are shuffled, every distinct one is
scored once, and the scores are joined back. Scores are whole millionths of a nat and sums of
them exact, so reruns and other partitionings agree.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule, and is
judged as an empty text; without ruled URLs of a kind the models are equal, or the threshold
0, and equal means allow; repeated rows are judged alike, each with its own row; ``page_id``
may be null; an empty table gives an empty result; URLs may have any length; columns other
than ``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import materialize, table

#: (host, path, verdict); a list that a user writes, one expression each.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Longest context in characters; weight of the shorter context; occurrences that make a context count.
ORDER, WEIGHT, MIN_SEEN = 4, 4.0, 2
#: Characters that a model without any counts expects alike.
ALPHABET = 256
#: One ruled URL in so many calibrates instead of training.
FOLDS = 5
#: Width of the calibration's bins, in millionths of a nat for each character.
BIN = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without ``://``."""
    c = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.translate(F.regexp_extract(c, _URL, 1), _UPPER, _LOWER), F.regexp_extract(c, _URL, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as (rule, verdict), ties by the longer host; null if none does."""
    found = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def windows(text: Column, order: int = ORDER) -> Column:
    """Every character of a text, and its end, behind the ``order`` characters before it."""
    marks = F.array(*[F.lit("\x01")] * order)
    chars = F.concat(marks, F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.array(F.lit("\x02")))
    places = F.sequence(F.lit(0), F.size(chars) - (order + 1))
    return F.transform(places, lambda i: F.concat(*[F.get(chars, i + k) for k in range(order + 1)]))


def _held_out(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % FOLDS == 0


def window_scores(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, score): log-likelihood ratio of the last character behind the others, in millionths of a nat.

    ``urls`` has text and, where known, verdict; grams of all of them are scored. Each level
    sums the counts of the level above by their suffixes and is smoothed by the level below."""
    trains = ~_held_out(F.col("text"))
    kind = F.when(trains & (F.col("verdict") == "allow"), 1).when(trains & (F.col("verdict") == "block"), -1).otherwise(0)
    grams = urls.select(kind.alias("kind"), F.explode(windows(F.col("text"), order)).alias("gram"))
    grams = grams.groupBy("gram").agg(F.sum((F.col("kind") == 1).cast("long")).alias("a"), F.sum((F.col("kind") == -1).cast("long")).alias("r"))
    grams = materialize(grams, "grams")
    total = grams.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("r"), F.lit(0)).alias("r")).first()
    below = None
    for k in range(order + 1):
        level = grams.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")) if k < order else grams
        if k == 0:
            level = level.withColumns({"ta": F.lit(total.a), "tr": F.lit(total.r), "pa": F.lit(1.0 / ALPHABET), "pr": F.lit(1.0 / ALPHABET)})
        else:
            level = level.withColumn("context", F.left("gram", F.lit(k))).withColumn("_short", F.right("gram", F.lit(k)))
            seen = level.groupBy("context").agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
            level = level.join(seen, "context").join(below.select(F.col("gram").alias("_short"), "pa", "pr"), "_short")
        p = {c: F.when(F.col("t" + c) < MIN_SEEN, F.col("p" + c)).otherwise((F.col(c) + F.lit(WEIGHT) * F.col("p" + c)) / (F.col("t" + c) + F.lit(WEIGHT))) for c in "ar"}
        below = level.select("gram", p["a"].alias("pa"), p["r"].alias("pr"))
    return materialize(below.select("gram", F.round(F.lit(1e6) * F.log(F.col("pa") / F.col("pr"))).cast("long").alias("score")), "gram-scores")


def threshold(scored: DataFrame) -> int:
    """The bin from which on URLs are allowed: that of the greatest difference between the shares of
    rejected and of accepted URLs below it, the least on ties, and moved half way down to the next
    bin that has any; 0 if either kind is missing.

    ``scored`` has verdict and bin of the URLs left out of training. Bins are few whatever the
    number of URLs, as smoothing bounds the score of a character."""
    from pyspark.sql import Window

    bins = scored.groupBy("bin").agg(F.sum((F.col("verdict") == "allow").cast("decimal(20,0)")).alias("a"), F.sum((F.col("verdict") == "block").cast("decimal(20,0)")).alias("r"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    bins = bins.select("bin", F.lag("bin").over(Window.orderBy("bin")).alias("before"), *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in "ar"], *[F.sum(c).over(every).alias("t" + c) for c in "ar"])
    found = bins.where("ta > 0 AND tr > 0").orderBy(F.desc(F.col("r") * F.col("ta") - F.col("a") * F.col("tr")), "bin").first()
    return -((-found.bin - (found.bin if found.before is None else found.before)) // 2) if found else 0


def judge_urls(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, bin): bin is the calibrated scale's score where no rule decides."""
    host, path = host_and_path("url")
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = rule_for(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("_rule", found).select("page_id", "host", "path", "_rule.rule", "_rule.verdict", F.concat("host", "path").alias("text"))
    scores = window_scores(urls.select("text", "verdict"), order)

    def score(part: DataFrame, *keys: str) -> DataFrame:
        rows = part.withColumn("_row", F.monotonically_increasing_id()).select("_row", *keys, F.explode(windows(F.col("text"), order)).alias("gram"))
        summed = rows.join(scores, "gram").groupBy("_row", *keys).agg(F.sum("score").alias("score"), F.count("*").alias("n"))
        return summed.select(*keys, F.floor(F.col("score") / (F.lit(float(BIN)) * F.col("n"))).cast("long").alias("bin"))

    limit = threshold(score(urls.where("verdict IS NOT NULL").where(_held_out(F.col("text"))), "verdict"))
    judged = score(urls.where("verdict IS NULL"), "page_id", "host", "path")
    judged = judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("bin") >= limit, "allow").otherwise("block").alias("verdict"), "bin")
    ruled = urls.where("verdict IS NOT NULL").select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("long").alias("bin"))
    return judged.union(ruled)


def op12_urls(spark, sf_dir: str) -> DataFrame:
    """The verdict on the URL of every page."""
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle(rules=RULES, order: int = ORDER) -> str:
    chain = "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (h, p, _) in enumerate(sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]))))
    ) + " END"
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    rule = chain.format(*[h + p for h, p, _ in ordered])
    verdict = chain.format(*[v for _, _, v in ordered])
    smooth = "CASE WHEN t{c} < %d THEN p{c} ELSE ({c} + %s * p{c}) / (t{c} + %s) END" % (MIN_SEEN, WEIGHT, WEIGHT)
    levels = []
    for k in range(order + 1):
        levels.append(f"g{k} AS (SELECT right(gram, {k + 1}) AS gram, sum(a)::BIGINT AS a, sum(r)::BIGINT AS r FROM grams GROUP BY ALL)")
        if k == 0:
            source = f"(SELECT gram, a, r, sum(a) OVER () AS ta, sum(r) OVER () AS tr, 1::DOUBLE / {ALPHABET} AS pa, 1::DOUBLE / {ALPHABET} AS pr FROM g0)"
        else:
            source = f"(SELECT g.gram, a, r, sum(a) OVER w AS ta, sum(r) OVER w AS tr, pa, pr FROM g{k} g JOIN p{k - 1} s ON s.gram = right(g.gram, {k}) WINDOW w AS (PARTITION BY left(g.gram, {k})))"
        levels.append(f"p{k} AS (SELECT gram, {smooth.format(c='a')} AS pa, {smooth.format(c='r')} AS pr FROM {source})")
    return rf"""
WITH split AS (
  SELECT row_number() OVER () AS n_row, page_id,
         translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path
  FROM pages),
urls AS (
  SELECT *, {rule} AS rule, {verdict} AS verdict, host || path AS text, ('0x' || left(md5(host || path), 8))::BIGINT % {FOLDS} = 0 AS held_out FROM split),
padded AS (SELECT *, repeat(chr(1), {order}) || text || chr(2) AS padded FROM urls),
places AS (SELECT n_row, verdict, held_out, padded, unnest(range(1, length(text) + 2)) AS pos FROM padded),
places_g AS (SELECT n_row, verdict, held_out, substr(padded, pos, {order + 1}) AS gram FROM places),
grams AS (
  SELECT gram, count(*) FILTER (WHERE verdict = 'allow' AND NOT held_out) AS a, count(*) FILTER (WHERE verdict = 'block' AND NOT held_out) AS r
  FROM places_g GROUP BY gram),
{", ".join(levels)},
scores AS (SELECT gram, CAST(round(1e6 * ln(pa / pr)) AS BIGINT) AS score FROM p{order}),
bins AS (
  SELECT n_row, CAST(floor(sum(score)::DOUBLE / ({float(BIN)} * count(*))) AS BIGINT) AS bin FROM places_g JOIN scores USING (gram) GROUP BY n_row),
by_bin AS (
  SELECT bin, count(*) FILTER (WHERE verdict = 'allow') AS a, count(*) FILTER (WHERE verdict = 'block') AS r
  FROM urls JOIN bins USING (n_row) WHERE verdict IS NOT NULL AND held_out GROUP BY bin),
below AS (
  SELECT bin, lag(bin) OVER (ORDER BY bin) AS before, coalesce(sum(a) OVER w, 0) AS a, coalesce(sum(r) OVER w, 0) AS r, sum(a) OVER () AS ta, sum(r) OVER () AS tr
  FROM by_bin WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lim AS (SELECT coalesce((SELECT CAST(ceil((bin + coalesce(before, bin)) / 2.0) AS BIGINT) FROM below WHERE ta > 0 AND tr > 0 ORDER BY r * ta - a * tr DESC, bin LIMIT 1), 0) AS bin)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN b.bin >= (SELECT bin FROM lim) THEN 'allow' ELSE 'block' END) AS verdict
FROM urls JOIN bins b USING (n_row)
"""


ORACLE = _oracle()
