"""Quality rules: cross-document line frequency per host, over base rules of one text.

Lines are normalised (ASCII case folded, ASCII spaces collapsed) and hashed. A line
stands in as many documents of a host as distinct texts of that host have it, so exact
copies of one text count once. Lines in more documents than the host's limit are
removed, and a document that keeps too few of its words is rejected as depleted.

Defined cases: null or empty texts have no words and fail the base rules; null hosts
form one host; a null doc_id counts like any other; repeated rows get equal verdicts, one
row each; an empty table gives an empty result; other columns are not carried by
``quality_verdicts`` and pass through ``quality_filter``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import HASHES, begin_task, materialize, shingle_hashes, signed, table, text_key, text_slices

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: A host's limit: this share of its distinct texts, and never under MIN_DOCS documents.
MAX_SHARE = 0.1
MIN_DOCS = 20
#: A document is depleted when it keeps less than this share of its words.
MIN_KEPT_SHARE = 0.5

FACTS = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<int>"


def text_facts(text: str | None):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes, line words) of one text.

    A line occurs once in the hashes, with the words of all its repeats."""
    if not text:
        return 0, 0, 0, 0, 0, [], []
    b = text.encode("utf-8", "surrogatepass")
    n_symbols = len(b) - len(b.translate(None, SYMBOLS))
    w = b.split()
    bare = b"".join(w)
    word_chars = len(bare.translate(None, CONTINUATION))  # every code point but its continuation bytes
    seen: set[bytes] = set()
    dup, lines = 0, {}
    for line in b.split(b"\n"):
        words = line.split()
        if not words:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        h = xxhash.xxh3_64_intdigest(b" ".join(words).lower())
        lines[h] = lines.get(h, 0) + len(words)
    repeat = 0
    if len(w) > 3:
        s = shingle_hashes(HASHES.of(w), 3)
        _, back, n = np.unique(s, return_inverse=True, return_counts=True)
        twice = n[back] > 1
        if twice.any():
            covered = np.zeros(len(w), bool)
            for i in range(3):
                covered[i : i + len(twice)] |= twice
            repeat = int(covered.sum())
    return len(w), word_chars, n_symbols, dup, repeat, list(lines), list(lines.values())


def _facts(batches):
    begin_task("facts")
    for whole, lo, texts in ((b, lo, texts) for b in batches for lo, texts in text_slices(b.column(3))):
        ids, hosts, text_hash = (c.slice(lo, len(texts)) for c in whole.columns[:3])
        out = [text_facts(t) for t in texts]
        cols = [pa.array([x[i] for x in out], pa.int64()) for i in range(5)]
        hashes = np.array([h for x in out for h in x[5]], np.uint64)
        ends = np.cumsum([0, *(len(x[5]) for x in out)]).astype(np.int32)
        line_hash = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(hashes)))
        line_words = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array([n for x in out for n in x[6]], np.int32)))
        yield pa.RecordBatch.from_arrays([ids, hosts, text_hash, *cols, line_hash, line_words], names=[f.split()[0] for f in FACTS.split(", ")])


def _verdicts(docs: DataFrame, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): base figures, verdicts, and the hashes of the lines over the limit."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text_key("text"), F.col("text").cast("string"))
    facts = materialize(rows.mapInArrow(_facts, FACTS), "facts")
    hosts = facts.groupBy("host").agg(F.count_distinct("text_hash").alias("host_docs"))
    limits = hosts.select("host", F.greatest(F.lit(float(min_docs)), F.col("host_docs") * max_share).alias("limit"))
    lines = facts.select("host", "text_hash", F.explode("line_hash").alias("line"))
    counts = lines.distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    frequent = (
        counts.where(F.col("n_docs") > min_docs).join(limits, counts.host.eqNullSafe(limits.host)).where("n_docs > limit").select(counts.host.alias("_host"), F.col("line").alias("_line"))
    )
    # one row per distinct text and line, so neither copies nor rows of a document multiply the join
    texts = facts.select("host", "text_hash", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l")).select("host", "text_hash", F.col("l.line_hash").alias("line"), F.col("l.line_words").alias("n")).distinct()
    removed = (
        texts.join(frequent, (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host")))
        .groupBy("host", "text_hash").agg(F.count("*").alias("lines"), F.sum("n").alias("words"), F.collect_list("line").alias("removed"))
        .select(F.col("host").alias("_h"), F.col("text_hash").alias("_t"), "lines", "words", "removed")
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        facts.join(removed, (F.col("text_hash") == F.col("_t")) & F.col("host").eqNullSafe(F.col("_h")), "left")
        .withColumn("n_removed_lines", F.coalesce("lines", F.lit(0)).cast("long"))
        .withColumn("n_removed_words", F.coalesce("words", F.lit(0)).cast("long"))
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & (F.col("n_words") - F.col("n_removed_words") >= min_kept_share * F.col("n_words")))
        .drop("_h", "_t", "lines", "words", "line_hash", "line_words")
    )


def quality_verdicts(docs: DataFrame, **limits) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): base figures and verdicts."""
    return _verdicts(docs, **limits).drop("removed")


def cut_lines(text: str, removed: list[int]) -> str:
    """``text`` without the lines of these (signed) hashes."""
    gone = {h % (1 << 64) for h in removed}
    lines = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if not (w := x.split()) or xxhash.xxh3_64_intdigest(b" ".join(w).lower()) not in gone]
    return b"\n".join(lines).decode("utf-8", "surrogatepass")


def _cut(texts: pa.Array, removed: pa.Array) -> pa.Array:
    return pa.array([None if r is None else cut_lines(t, r) for t, r in zip(texts.to_pylist(), removed.to_pylist(), strict=True)], pa.string())


def quality_filter(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` whose text and host the verdicts keep, without the lines over their host's limit.

    ``text``, and ``n_chars`` where there is one, change with the cut. Verdicts hang on
    (host, text) alone, and so are joined by their hashes; a document with no kept verdict
    goes."""
    verdicts = _verdicts(docs, **limits).where("kept")
    kept = verdicts.groupBy(F.col("text_hash").alias("_t"), F.col("host").alias("_h")).agg(F.first("removed").alias("_removed"))
    keyed = docs.withColumn("_key", text_key("text"))
    joined = keyed.join(kept, (F.col("_key") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_h")))
    cut = F.arrow_udf(_cut, "string")(F.when(F.col("_removed").isNotNull(), F.col("text")), F.col("_removed"))
    joined = joined.withColumn("_cut", cut)
    new = {"text": F.coalesce("_cut", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_cut").isNull(), F.col("n_chars")).otherwise(F.length("_cut")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op3_quality(spark, sf_dir: str) -> DataFrame:
    v = quality_verdicts(table(spark, sf_dir, "documents"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words")


ORACLE_CTES = r"""
q_lines AS (SELECT doc_id, source, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM {docs}),
q_normal AS (SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
                    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM q_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
q_dup AS (SELECT doc_id, sum(c - 1)::BIGINT AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS c FROM q_normal GROUP BY ALL) GROUP BY doc_id),
q_limits AS (SELECT source, greatest(20.0, count(DISTINCT coalesce(text, '')) * 0.1) AS lim FROM {docs} GROUP BY source),
q_frequent AS (SELECT c.source, norm FROM (SELECT source, norm, count(DISTINCT text) AS n_docs FROM q_normal GROUP BY ALL) c JOIN q_limits l ON c.source IS NOT DISTINCT FROM l.source WHERE n_docs > lim),
q_removed AS (SELECT doc_id, count(DISTINCT q.norm)::BIGINT AS n_removed_lines, sum(n)::BIGINT AS n_removed_words FROM q_normal q JOIN q_frequent f ON q.norm = f.norm AND q.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
q_words AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
q_windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM q_words)),
q_twice AS (SELECT doc_id, i FROM q_windows SEMI JOIN (SELECT doc_id, g FROM q_windows GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
q_repeat AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM q_twice) GROUP BY doc_id),
q_base AS (SELECT q.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                  length(regexp_replace(coalesce(q.text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                  coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_removed_words, 0) AS n_removed_words
           FROM q_words q LEFT JOIN q_dup USING (doc_id) LEFT JOIN q_repeat USING (doc_id) LEFT JOIN q_removed USING (doc_id)),
q_verdicts AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                      NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept FROM q_base)
"""

ORACLE = "WITH " + ORACLE_CTES.replace("{docs}", "documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_lines, n_removed_words FROM q_verdicts"
