r"""Line dedup by a log-template tree of fixed depth.

Lines of MIN_TOKENS words and more are parsed into a tree: the first level is the number
of tokens, the next DEPTH levels are the leading tokens, where a token with a digit is
the wildcard ``<*>``. In a leaf a token is constant at its position if lines of at least
MIN_DOCS documents have it there, and a wildcard otherwise; a line's template is its row
of constants and wildcards, and counts if at least MIN_SIMILARITY of it is constant.
Templates that lines of MIN_DOCS documents share are recurring, and their lines are
dropped from all documents.

Documents are told apart by their texts, so exact copies count as one. Equal lines are
counted once and carry their number of documents, so neither a frequent line nor a
frequent leaf has to be held by one task. Defined cases: null and empty texts have no
lines; repeated rows are copies; null doc_ids are carried; an empty table gives an empty
result; ``drop_template_lines`` keeps all columns of ``docs``.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import begin_task, materialize, table, text_key, text_slices

MIN_TOKENS = 3
DEPTH = 2
MIN_DOCS = 10
MIN_SIMILARITY = 0.5
WILDCARD = "<*>"
#: Texts to fetch lines from are broadcast up to this many lines (four numbers each).
BROADCAST_LINES = 500_000

LINES = "text_key long, number int, n_tokens int, leaf long, line long"
TOKENS = "leaf long, line long, n_docs long, tokens array<string>"
_DIGITS = bytes.maketrans(b"0123456789", b"0000000000")


def masked(line: bytes) -> list[bytes]:
    """Tokens of a line, those with a digit as the wildcard."""
    return [b"<*>" if b"0" in t else t for t in line.translate(_DIGITS).split()] if any(48 <= c <= 57 for c in line) else line.split()


def _sign(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def leaf_of(tokens: list[bytes], depth: int) -> int:
    return _sign(xxhash.xxh3_64_intdigest(b"%d " % len(tokens) + b" ".join(tokens[:depth])))


def _lines(min_tokens: int, depth: int):
    def run(batches):
        begin_task("lines")
        for batch, lo, texts in ((b, lo, texts) for b in batches for lo, texts in text_slices(b.column(1))):
            out = [[], [], [], [], []]
            for key, text in zip(batch.column(0).slice(lo, len(texts)).to_pylist(), texts, strict=True):
                for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    t = masked(line)
                    if len(t) >= min_tokens:
                        for c, x in zip(out, (key, i, len(t), leaf_of(t, depth), _sign(xxhash.xxh3_64_intdigest(b" ".join(t)))), strict=True):
                            c.append(x)
            if out[0]:
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[f.split()[0] for f in LINES.split(", ")])

    return run


def _tokens(batches):
    begin_task("line tokens")
    for batch, lo, texts in ((b, lo, texts) for b in batches for lo, texts in text_slices(b.column(0))):
        rows = []
        for text, wanted in zip(texts, batch.column(1).slice(lo, len(texts)).to_pylist(), strict=True):
            lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
            for w in wanted:
                rows.append((w["leaf"], w["line"], w["n_docs"], [t.decode("utf-8", "replace") for t in masked(lines[w["number"]])]))
        if rows:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["leaf", "line", "n_docs", "tokens"])


def parsed_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS, depth: int = DEPTH) -> DataFrame:
    """Rows LINES of every distinct text of ``docs``; numbers count lines from 0."""
    texts = docs.select(text_key("text").alias("text_key"), F.col("text").cast("string"))
    return materialize(texts.mapInArrow(_lines(min_tokens, depth), LINES), "lines")


def line_templates(docs: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Rows (line, template, n_docs): the recurring template of each line that has one."""
    once = lines.select("leaf", "line", "text_key").distinct()
    leaves = once.select("leaf", "text_key").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf")
    place = lines.groupBy("line").agg(F.min(F.struct("text_key", "number")).alias("place"))
    known = once.join(leaves, "leaf").groupBy("leaf", "line").agg(F.count("*").alias("n_docs")).join(place, "line")
    wanted = known.groupBy(F.col("place.text_key").alias("_key")).agg(F.collect_list(F.struct("leaf", "line", "n_docs", F.col("place.number").alias("number"))).alias("wanted"))
    wanted = materialize(wanted, "wanted-lines")  # lines of one text
    if wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0] <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    texts = docs.select(text_key("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    fetched = texts.join(wanted, F.col("text_key") == F.col("_key")).select("text", "wanted").mapInArrow(_tokens, TOKENS)
    tokens = materialize(fetched.dropDuplicates(["line"]), "line-tokens")  # copies of a text give its lines again

    each = tokens.select("leaf", "line", "n_docs", F.posexplode("tokens").alias("at", "token"))
    constant = each.groupBy("leaf", "at", "token").agg(F.sum("n_docs").alias("n")).where((F.col("n") >= min_docs) & (F.col("token") != WILDCARD)).select("leaf", "at", "token", F.lit(True).alias("stays"))
    marked = each.join(constant, ["leaf", "at", "token"], "left")
    shape = marked.groupBy("leaf", "line").agg(
        F.sort_array(F.collect_list(F.struct("at", F.when(F.col("stays"), F.col("token")).otherwise(WILDCARD).alias("token")))).alias("row"), F.avg(F.when(F.col("stays"), 1.0).otherwise(0.0)).alias("share")
    )
    shape = shape.where(F.col("share") >= min_similarity).select("line", F.array_join(F.col("row.token"), " ").alias("template"))
    shape = materialize(shape, "line-shapes")
    counts = once.join(shape, "line").select("template", "text_key").distinct().groupBy("template").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    return shape.join(counts, "template").select("line", "template", "n_docs")


def dropped_lines(docs: DataFrame, **how) -> DataFrame:
    """Rows (text_key, number, n_tokens, template) of the lines to drop, of distinct texts."""
    lines = parsed_lines(docs)
    return lines.distinct().join(line_templates(docs, lines, **how), "line").select("text_key", "number", "n_tokens", "template")


def _by_text(docs: DataFrame, **how) -> DataFrame:
    by = dropped_lines(docs, **how).groupBy(F.col("text_key").alias("_text")).agg(F.sort_array(F.collect_list("number")).alias("dropped"), F.sum("n_tokens").alias("dropped_words"))
    return materialize(by, "dropped-lines")  # written first, so that Spark may split a text with very many copies in the join


def drop_template_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the lines of recurring templates cut out of ``text``."""
    joined = docs.withColumn("_key", text_key("text")).join(_by_text(docs, **how), F.col("_key") == F.col("_text"), "left")
    left = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(~F.array_contains("dropped", i), x)), lambda x: x.isNotNull())
    return joined.withColumn("text", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).select(*docs.columns)


def op10_line_templates(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text_key("text").alias("_key"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"))
    joined = rows.join(_by_text(docs), F.col("_key") == F.col("_text"), "left")
    return joined.select(
        "doc_id", "n_lines", F.coalesce(F.size(F.coalesce("dropped", F.array().cast("array<int>"))), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("dropped_words", F.lit(0)).cast("long").alias("dropped_words"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )


ORACLE = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS number FROM documents),
m AS (SELECT doc_id, text, number, list_transform(regexp_extract_all(raw, '[^\x20\x09-\x0D]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS w FROM l),
t AS (SELECT *, len(w)::VARCHAR || ' ' || w[1] || ' ' || coalesce(w[2], '') AS leaf, array_to_string(w, ' ') AS line FROM m WHERE len(w) >= 3),
leaves AS (SELECT leaf FROM t GROUP BY leaf HAVING count(DISTINCT text) >= 10),
known AS (SELECT leaf, line, any_value(w) AS w, count(DISTINCT text) AS n FROM t JOIN leaves USING (leaf) GROUP BY leaf, line),
apiece AS (SELECT leaf, line, n, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM known),
constants AS (SELECT leaf, pos, token FROM apiece WHERE token <> '<*>' GROUP BY ALL HAVING sum(n) >= 10),
shape AS (SELECT leaf, line, string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY pos) AS template, avg(CASE WHEN c.token IS NULL THEN 0.0 ELSE 1.0 END) AS share
          FROM apiece LEFT JOIN constants c USING (leaf, pos, token) GROUP BY leaf, line HAVING avg(CASE WHEN c.token IS NULL THEN 0.0 ELSE 1.0 END) >= 0.5),
recurring AS (SELECT template FROM t JOIN shape USING (leaf, line) GROUP BY template HAVING count(DISTINCT text) >= 10),
dropped AS (SELECT doc_id, count(*)::BIGINT AS n_dropped, sum(len(w))::BIGINT AS dropped_words, list(number::INT ORDER BY number) AS dropped
            FROM t JOIN shape USING (leaf, line) SEMI JOIN recurring USING (template) GROUP BY doc_id)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped_words, 0) AS dropped_words, coalesce(dropped, []) AS dropped
FROM documents d LEFT JOIN dropped USING (doc_id)
"""
