"""How far the sources of a language diverge in their terms, by chunk factorization.

Texts are counted as chunks between white space. Every distinct chunk of the whole corpus
is split into terms once, and its counts are carried to its terms by a join, so the work of
splitting follows the vocabulary, not the corpus. A task counts many documents before it
hands anything on, with one row for a chunk and the counts of all its sources beside it; the
same is done again for terms. So no key has more rows in a shuffle than tasks hand over.

Occurrences add up over chunks. Documents do not, as one document may hold a term in several
chunks: the most frequent chunk of a term bounds its documents from below, the sum over its
chunks from above. Only where these two leave the limit open are documents told apart, and
there every chunk has fewer documents than the limit, so that the document numbers kept with
rare chunks give the exact count.

Kept terms are numbered in UTF-8 order. Blocks of them meet the sources of their language in
matrices, tile by tile; a task gives one sum for each pair of sources, and the best terms.

Shares are integers: p = 1 + floor(1e9 * (count + 2) / (N + 2 V)), divided digit by digit so
that 64 bits hold at any corpus size. The difference of two shares is floor((p-q)^2 / (p+q)).

Defined cases: null text, lang and source count as ''; documents are rows, so a repeated row
or doc_id counts again; texts without terms still make their source a group; ties go by the
UTF-8 order of terms or sources; an empty table gives an empty result; texts may have any
length (chunks of over ``LONG`` bytes are cut where no term goes through them); other
columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.common import begin_task, drop_folders, materialize, table, text_slices

#: A term: a run of letters A-Z, a-z and of anything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms that fewer documents of a language have are left out.
MIN_DOCS = 10
#: Terms listed for each source.
TOP = 10
#: Chunks of more bytes are cut at characters that no term has.
LONG = 64
#: A task hands on its counts when it holds so many of them, or so many distinct chunks.
HELD, HELD_CHUNKS = 2_000_000, 400_000
#: Languages that a task tells apart at a time.
MOST_LANGS = 1 << 20
#: Sources compared in one matrix, and terms in one block.
TILE, BLOCK = 256, 4_096

_TERM_BYTES = re.compile(rb"[A-Za-z\x80-\xff]+")
_COUNTS = "lang string, chunk string, docs long, groups array<long>, counts array<int>, part int, rows array<int>"


def chunks_of(text: str | None) -> list[bytes]:
    """The chunks of a text, A-Z lower-cased."""
    chunks = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if chunks and len(max(chunks, key=len)) > LONG:
        chunks = [c for w in chunks for c in ((w,) if len(w) <= LONG else _TERM_BYTES.findall(w))]
    return chunks


class _Numbers(dict):
    """Numbers in order of first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _runs(keys: np.ndarray) -> np.ndarray:
    """Begins of the runs of equal keys."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _lists(values: pa.Array, begins: np.ndarray, mask=None) -> pa.Array:
    offsets = np.append(begins, len(values)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=None if mask is None else pa.array(mask))


class _Held:
    """Counts of a task's documents by language, chunk and source, not yet handed on."""

    def __init__(self, part: int, few: int):
        self.part, self.few, self.row = part, few, 0
        self.clear()

    def clear(self) -> None:
        self.chunk_numbers, self.langs, self.groups = _Numbers(), _Numbers(), _Numbers()
        self.chunk, self.count, self.sizes, self.where = array("i"), array("i"), [], []

    def add(self, lang: str, group: int, text: str | None) -> None:
        found = Counter(chunks_of(text))
        self.chunk.extend(map(self.chunk_numbers.__getitem__, found))
        self.count.extend(found.values())
        self.sizes.append(len(found))
        self.where.append((self.langs[lang], self.groups[group], self.row))
        self.row += 1

    def full(self) -> bool:
        return len(self.chunk) > HELD or len(self.chunk_numbers) > HELD_CHUNKS

    def flush(self):
        if len(self.chunk):
            lang, group, row = (np.repeat(np.array(x, np.int64), self.sizes) for x in zip(*self.where))
            chunk, count = np.frombuffer(self.chunk, np.int32).astype(np.int64), np.frombuffer(self.count, np.int32)
            name = lang * len(self.chunk_numbers) + chunk
            order = np.argsort(name * len(self.groups) + group, kind="stable")
            name, group, row, count = name[order], group[order], row[order], count[order]
            each = _runs(name * len(self.groups) + group)
            counts, groups, names = np.add.reduceat(count, each), np.array(list(self.groups))[group[each]], name[each]
            first = _runs(name)
            docs = np.diff(np.append(first, len(name)))
            rare = docs <= self.few
            kept = np.repeat(rare, docs)
            texts, langs = list(self.chunk_numbers), list(self.langs)
            lang_of, chunk_of = np.divmod(name[first], len(texts))
            strings = pa.array(texts, pa.binary()).take(pa.array(chunk_of)).cast(pa.string())
            begins = np.concatenate([[0], np.cumsum(np.where(rare, docs, 0))[:-1]])
            out = pa.RecordBatch.from_arrays([
                pa.array(langs).take(pa.array(lang_of)), strings, pa.array(docs), _lists(pa.array(groups), _runs(names)), _lists(pa.array(counts.astype(np.int32)), _runs(names)),
                pa.array(np.full(len(first), self.part, np.int32)), _lists(pa.array(row[kept].astype(np.int32)), begins, ~rare),
            ], names=["lang", "chunk", "docs", "groups", "counts", "part", "rows"])
            for at in range(0, out.num_rows, 10_000):
                yield out.slice(at, 10_000)
        self.clear()


def _counter(few: int):
    def count(batches):
        from pyspark import TaskContext

        begin_task("divergence")
        held = _Held(TaskContext.get().partitionId(), few)
        for batch in batches:
            langs, groups = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, texts in text_slices(batch.column(2)):
                for i, text in enumerate(texts, begin):
                    held.add(langs[i], groups[i], text)
                    if held.full():
                        yield from held.flush()
        yield from held.flush()

    return count


def _named(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def source_groups(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, source, group): sources with a 64-bit hash, and the hash's seed, by which no two agree."""
    found = materialize(_named(docs, "lang", "source").distinct(), "sources")
    n = found.count()
    for seed in range(100):
        numbered = found.withColumn("group", F.xxhash64(F.lit(seed), "lang", "source"))
        if numbered.select("group").distinct().count() == n:
            return numbered, seed
    raise RuntimeError("no seed tells the sources apart")


def chunk_counts(docs: DataFrame, seed: int = 0, few: int = MIN_DOCS - 1) -> DataFrame:
    """(lang, chunk, docs, groups, counts, part, rows): a row for each chunk that a task hands on, with
    its occurrences by source, and the numbers of its documents where these are ``few``."""
    named = _named(docs, "lang", "source", "text").select("lang", F.xxhash64(F.lit(seed), "lang", "source"), "text")
    return materialize(named.mapInArrow(_counter(few), _COUNTS), "chunks")


def chunk_terms(counts: DataFrame) -> DataFrame:
    """(lang, chunk, docs, term, k): every language's chunks with their documents and terms.

    Each distinct chunk is split once; k tells how often it has the term."""
    total = materialize(counts.groupBy("lang", "chunk").agg(F.sum("docs").alias("docs")), "chunk-docs")
    split = total.select("chunk").distinct().withColumn("terms", F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0)))
    each = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("k")))
    back = total.join(split.select("chunk", each.alias("terms")).hint("shuffle_hash"), "chunk").select("lang", "chunk", "docs", F.explode("terms").alias("t"))
    out = materialize(back.select("lang", "chunk", "docs", "t.term", "t.k"), "chunk-terms")
    drop_folders(counts.sparkSession, [total.shared_path])
    return out


def kept_terms(counts: DataFrame, terms: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, number) of the terms that enough documents of their language have; numbers go
    from 0 in each language, in the order of terms."""
    bounds = terms.groupBy("lang", "term").agg(F.max("docs").alias("least"), F.sum("docs").alias("most"))
    bounds = materialize(bounds.where(F.col("most") >= min_docs), "term-bounds")
    sure = bounds.where(F.col("least") >= min_docs).select("lang", "term")
    chunks = bounds.where(F.col("least") < min_docs).select("lang", "term").join(terms.select("lang", "chunk", "term"), ["lang", "term"])
    rare = counts.where("rows IS NOT NULL").select("lang", "chunk", "part", "rows")
    told = rare.join(chunks.hint("shuffle_hash"), ["lang", "chunk"]).select("lang", "term", "part", F.explode("rows").alias("row")).distinct()
    settled = told.groupBy("lang", "term").agg(F.count("*").alias("d")).where(F.col("d") >= min_docs).select("lang", "term")
    ordered = materialize(sure.union(settled).orderBy("lang", "term").withColumn("at", F.monotonically_increasing_id()), "kept-terms")
    part = F.shiftright("at", 33)
    begins = ordered.groupBy("lang", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = begins.select("lang", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    numbered = ordered.withColumn("part", part).join(begins, ["lang", "part"]).select("lang", "term", (F.col("at") + F.col("shift")).alias("number"))
    out = materialize(numbered, "numbered-terms")
    drop_folders(counts.sparkSession, [bounds.shared_path, ordered.shared_path])
    return out


def _flat(batch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and lengths."""
    c = batch.column(i)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64)


def _spread(lengths: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of the given lengths, each repeated ``times``: places in the flat values, and number of the repetition."""
    begins = np.cumsum(lengths) - lengths
    size = np.repeat(lengths, times)
    copy = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(copy)) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(np.repeat(begins, times), size) + inner, copy


def _carry(batches):
    """Counts of chunks become counts of their terms, summed as far as a task holds them."""
    begin_task("divergence")
    held, size, langs = [], 0, _Numbers()

    def flush():
        term, group, n = (np.concatenate(h) for h in zip(*held))
        groups, group = np.unique(group, return_inverse=True)
        key = term * len(groups) + group
        order = np.argsort(key, kind="stable")
        each = _runs(key[order])
        n, (term, group) = np.add.reduceat(n[order], each), np.divmod(key[order][each], len(groups))
        first = _runs(term)
        number, lang = np.divmod(term[first], MOST_LANGS)
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(langs), pa.string()).take(pa.array(lang)), pa.array(number), _lists(pa.array(groups[group]), first), _lists(pa.array(n), first)], names=["lang", "number", "groups", "counts"]
        )
        for at in range(0, out.num_rows, 10_000):
            yield out.slice(at, 10_000)

    for batch in batches:
        (groups, lengths), (counts, _) = _flat(batch, 1), _flat(batch, 2)
        (numbers, times), (k, _) = _flat(batch, 3), _flat(batch, 4)
        place, copy = _spread(lengths, times)
        if len(place):
            lang = np.repeat(np.array([langs[x] for x in batch.column(0).to_pylist()], np.int64), times)
            held.append(((numbers * MOST_LANGS + lang)[copy], groups[place], counts[place].astype(np.int64) * k[copy]))
            size += len(place)
        if size > HELD or len(langs) > MOST_LANGS - 10_000:
            if held:
                yield from flush()
            held, size, langs = [], 0, _Numbers()
    if held:
        yield from flush()


def term_counts(counts: DataFrame, terms: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, number, groups, counts): kept terms with occurrences by source, a row for each hand-over."""
    of_chunk = terms.select("lang", "chunk", "term", "k").join(kept, ["lang", "term"]).groupBy("lang", "chunk").agg(F.collect_list(F.struct("number", "k")).alias("t"))
    joined = counts.select("lang", "chunk", "groups", "counts").join(of_chunk.hint("shuffle_hash"), ["lang", "chunk"])  # one row a chunk
    return materialize(joined.select("lang", "groups", "counts", "t.number", "t.k").mapInArrow(_carry, "lang string, number long, groups array<long>, counts array<long>"), "term-counts")


def _share(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 (n + 2) / m), three digits at a time; n + 2 <= m, and 1000 m fits in 64 bits."""
    whole, rest = np.divmod(n + 2, m)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, m)
        whole = whole * 1000 + digit
    return whole + 1


def _difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compare(tile: int, top: int):
    """One block of terms against the sources of one or two tiles: sums for the pairs (a, b) of
    sources, and each source's best terms as (a, number of the term)."""

    def work(block: pa.Table) -> pa.Table:
        head = block.filter(pc.is_null(block["number"])).sort_by("i").combine_chunks()
        rows = block.filter(pc.is_valid(block["number"]))
        i, m = head["i"].to_numpy(), head["m"].to_numpy()
        ti, tj, m_lang = head["ti"][0].as_py(), head["tj"][0].as_py(), head["m_lang"][0].as_py()
        group = head["group"].to_numpy()
        by_group = np.argsort(group)
        (groups, lengths), (counts, _) = _flat(rows.select(["groups"]), 0), _flat(rows.select(["counts"]), 0)
        numbers, code = np.unique(rows["number"].to_numpy(), return_inverse=True)
        code = np.repeat(code, lengths)
        total = np.zeros(len(numbers), np.int64)
        np.add.at(total, code, counts)
        place = np.minimum(np.searchsorted(group, groups, sorter=by_group), len(group) - 1)
        known = group[by_group[place]] == groups
        n = np.zeros((len(numbers), len(i)), np.int64)
        np.add.at(n, (code[known], by_group[place[known]]), counts[known])
        out = []
        if len(numbers):
            p = _share(n, m)
            sums = np.stack([_difference(p, p[:, [a]]).sum(0) for a in range(len(i))])
        else:
            sums = np.zeros((len(i), len(i)), np.int64)
        a, b = np.triu_indices(len(i), 1)
        mine = (i[a] // tile == ti) & (i[b] // tile == tj)
        out.append((np.zeros(mine.sum(), np.int64), i[a[mine]], i[b[mine]], sums[a[mine], b[mine]]))
        if ti == tj and len(numbers):
            q = _share(total, np.int64(m_lang))
            for s in range(len(i)):
                over = np.flatnonzero((n[:, s] > 0) & (p[:, s] > q))
                value = _difference(p[over, s], q[over])
                best = np.lexsort((over, -value))[:top]
                out.append((np.ones(len(best), np.int64), np.full(len(best), i[s]), numbers[over[best]], value[best]))
        columns = [pa.array(np.concatenate([o[c] for o in out]), pa.int64()) for c in range(4)]
        return pa.table([pa.array([head["lang"][0].as_py()] * len(columns[0]), pa.string()), *columns], names=["lang", "kind", "a", "b", "value"])

    return work


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for every source its distance to each other source of
    its language (part ``pair``), and the terms that it has beyond the language's share (part ``term``)."""
    spark = docs.sparkSession
    groups, seed = source_groups(docs)
    counts = chunk_counts(docs, seed, min_docs - 1)
    terms = chunk_terms(counts)
    kept = kept_terms(counts, terms, min_docs)
    rows = term_counts(counts, terms, kept)
    drop_folders(spark, [counts.shared_path, terms.shared_path])

    size = rows.select(F.explode(F.arrays_zip("groups", "counts")).alias("x")).groupBy(F.col("x.groups").alias("group")).agg(F.sum("x.counts").alias("total"))
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    by = Window.partitionBy("lang")
    groups = groups.join(size, "group", "left").join(v, "lang", "left").na.fill(0, ["total", "v"]).select(
        "lang", "source", "group", (F.col("total") + 2 * F.col("v")).alias("m"), (F.sum("total").over(by) + 2 * F.col("v")).alias("m_lang"), (F.row_number().over(by.orderBy("source")) - 1).cast("long").alias("i"),
        F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK)).alias("blocks"), F.ceil(F.count("*").over(by) / TILE).alias("tiles"),
    )
    groups = materialize(groups, "groups")

    tiles = F.explode(F.expr("sequence(0L, tiles - 1)"))
    head = groups.withColumn("other", tiles).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("t", F.expr(f"i div {TILE}"))
    keys = ["lang", "block", "ti", "tj"]
    head = head.select("lang", "block", F.least("t", "other").alias("ti"), F.greatest("t", "other").alias("tj"), "group", "i", "m", "m_lang", *[F.lit(None).cast(c).alias(n) for n, c in (("number", "long"), ("groups", "array<long>"), ("counts", "array<long>"))])
    per_lang = groups.groupBy("lang").agg(F.max("tiles").alias("tiles"))
    pairs = rows.join(per_lang, "lang").withColumn("ti", tiles).withColumn("tj", F.explode(F.expr("sequence(ti, tiles - 1)"))).withColumn("block", F.expr(f"number div {BLOCK}"))
    pairs = pairs.select(*keys, *[F.lit(None).cast("long").alias(c) for c in ("group", "i", "m", "m_lang")], "number", "groups", "counts")
    met = materialize(head.union(pairs).groupBy(*keys).applyInArrow(_compare(TILE, top), "lang string, kind long, a long, b long, value long"), "compared")

    sums = met.where("kind = 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select("lang", "b", "a", "value"))
    names = groups.select("lang", F.col("i").alias("b"), F.col("source").alias("item"))
    pair = both.join(names, ["lang", "b"]).select("lang", "a", F.lit("pair").alias("part"), "item", "value")
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "a").orderBy(F.desc("value"), "item")).cast("int"))
    term = met.where("kind = 1").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b")).cast("int")).where(F.col("rank") <= top)
    term = term.join(kept.withColumnRenamed("number", "b"), ["lang", "b"]).select("lang", "a", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pair.union(term).join(groups.select("lang", F.col("i").alias("a"), "source"), ["lang", "a"]).select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return divergence_audit(table(spark, sf_dir, "documents"))


_P = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({m})"

ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCS}),
grp AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
full_ AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang, v.v, v.total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS size
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, {_P.format(n="n", m="size + 2 * v")} AS p, {_P.format(n="n_lang", m="total + 2 * v")} AS q FROM full_),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
