"""Hard negatives: for an anchor and each of its nearest vectors of the same label, the nearest
vectors of other labels whose score lies within a share of the positive's.

Components are scaled and rounded down to integers, and a score is an inner product, so results
are exact. Every vector is stored with the mean and the deviation of its segments. The product
of two segments lies within ``length * (mean * mean -+ deviation * deviation)``; summed over
segments this bounds the score. Pairs are tried on the whole vectors, then on 4 segments, then
on 16; those that the bounds leave are scored exactly. What is sought of an anchor grows tighter
while vectors stream by: its worst kept score, or the ranges of its positives.

Anchors form blocks of bounded size and vectors stripes; each task joins one block with one
stripe, holds the block and reads the stripe batch by batch. The best of each stripe are
ranked together at the end, so neither a frequent label nor a frequent vector gathers anywhere.

Defined cases: rows without a label or vector, or with a component that is null or not finite,
take no part; repeated rows are rows of their own, so an anchor's copy may be its positive; a
null id is never an anchor by a test on ids, may be found, and comes last on ties; vectors of
different lengths are compared as if zeros followed the shorter; negative positives have no
range, so no negatives; an empty table gives an empty result; scores beyond 2^53 raise an
error; columns other than id, label and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.common import begin_task, materialize, table

#: Components are multiplied by this before they are rounded down.
SCALE = 256.0
#: Nearest rows of the same label, and rows of others kept for each of these.
POSITIVES, NEGATIVES = 5, 10
#: A negative has at least and at most so many hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Segments of a vector at each level of refinement.
LEVELS = (1, 4, 16)
#: Anchors that one task holds; anchors and vectors compared in one matrix.
BLOCK, ROWS, COLUMNS = 16_384, 256, 4_096
#: Pairs are scored one by one, not as a matrix, when the bounds leave less than this share.
SPARSE = 0.05

_NO_ID = np.iinfo(np.int64).max
_EXACT = float(2**53)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as scaled integers in doubles, padded with zeros to ``dim``."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim))
    out[np.arange(dim) < n[:, None]] = flat
    return out


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _summarize(dim: int):
    """Adds the means and deviations of the finest segments."""

    def work(batches):
        begin_task("hard_negatives")
        for batch in batches:
            x = _matrix(batch.column("embedding"), dim).reshape(batch.num_rows, LEVELS[-1], -1)
            means = x.mean(2)
            devs = np.sqrt(np.square(x - means[:, :, None]).mean(2))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.reshape(-1)), LEVELS[-1]).cast(pa.list_(pa.float64())) for a in (means, devs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "means", "devs"])

    return work


class _Bounds:
    """Means and deviations of a set of vectors at every level, as factors of the score's bounds."""

    def __init__(self, means: np.ndarray, devs: np.ndarray, dim: int):
        self.levels, squares = [], devs**2 + means**2
        for n in LEVELS:
            m = means.reshape(len(means), n, -1).mean(2)
            d = np.sqrt(np.maximum(squares.reshape(len(means), n, -1).mean(2) - m * m, 0))
            root = np.sqrt(dim / n)
            self.levels.append((m * root, d * root))

    def take(self, rows):
        out = object.__new__(_Bounds)
        out.levels = [(m[rows], d[rows]) for m, d in self.levels]
        return out


class _Best:
    """The best ``k`` entries of every slot, by (score descending, id, row)."""

    def __init__(self, slots: int, k: int):
        self.k, self.floor = k, np.full(slots, -np.inf)
        self.slot, self.score, self.id, self.row = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, slot, score, ids, row) -> None:
        touched = np.zeros(len(self.floor), bool)
        touched[slot] = True
        old = touched[self.slot]
        s, v, i, r = (np.concatenate([a[old], b]) for a, b in ((self.slot, slot), (self.score, score), (self.id, ids), (self.row, row)))
        order = np.lexsort((r, i, -v, s))
        s, v, i, r = s[order], v[order], i[order], r[order]
        rank = np.arange(len(s)) - np.searchsorted(s, s)
        last = rank == self.k - 1
        self.floor[s[last]] = v[last]
        best = rank < self.k
        self.slot, self.score, self.id, self.row = (np.concatenate([a[~old], b[best]]) for a, b in ((self.slot, s), (self.score, v), (self.id, i), (self.row, r)))


class _Block:
    """Anchors of one task, and what was found for them. Without ranges the best rows of the same
    label are sought, else for each range the best of other labels within it."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int, k: int, ranges: int):
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        self.x, self.label, self.row = _matrix(t.column("embedding"), dim), t.column("label").to_numpy(), t.column("row").to_numpy()
        self.bounds = _Bounds(_fixed(t.column("means"), LEVELS[-1]), _fixed(t.column("devs"), LEVELS[-1]), dim)
        self.most, self.ranges, self.slots = np.abs(self.x).max(initial=0), ranges, max(ranges, 1)
        self.best = _Best(len(self.row) * self.slots, k)
        self.low, self.high = np.full((len(self.row), self.slots), -np.inf), np.full((len(self.row), self.slots), np.inf)
        if ranges:
            self.low[:], self.high[:] = np.inf, -np.inf
            for i, scores in enumerate(t.column("positive_scores").to_pylist()):
                for j, s in enumerate(scores):
                    self.low[i, j], self.high[i, j] = -((-LOW * s) // 100), HIGH * s // 100

    def meet(self, batch: pa.RecordBatch, dim: int) -> None:
        ids = batch.column("id").fill_null(_NO_ID).to_numpy()
        row = batch.column("row").to_numpy()
        order = np.lexsort((row, ids))
        ids, row, label, x = ids[order], row[order], batch.column("label").to_numpy()[order], _matrix(batch.column("embedding"), dim)[order]
        if self.most * np.abs(x).max(initial=0) * dim >= _EXACT:
            raise ValueError("scores beyond 2^53 are not exact")
        bounds = _Bounds(_fixed(batch.column("means"), LEVELS[-1])[order], _fixed(batch.column("devs"), LEVELS[-1])[order], dim)
        for c in range(0, len(row), COLUMNS):
            part = slice(c, c + COLUMNS)
            for a in range(0, len(self.row), ROWS):
                self._pairs(slice(a, a + ROWS), x[part], bounds.take(part), ids[part], row[part], label[part])

    def _pairs(self, at: slice, x, bounds: _Bounds, ids, row, label) -> None:
        floor = self.best.floor.reshape(-1, self.slots)[at]
        need = np.maximum(self.low[at], floor)
        least, most = need.min(1)[:, None], self.high[at].max(1)[:, None]
        alive = (self.label[at, None] == label) & (self.row[at, None] != row) if not self.ranges else self.label[at, None] != label
        mine = self.bounds.take(at)
        for (m, d), (mb, db) in zip(mine.levels, bounds.levels):
            middle, spread = m @ mb.T, d @ db.T
            spread += 1 + 1e-9 * (np.abs(middle) + spread)  # room for rounding
            alive &= (middle + spread >= least) & (middle - spread <= most)
        if not alive.any():
            return
        if alive.mean() < SPARSE:
            i, j = np.nonzero(alive)
            self._keep(at.start, i, j, np.einsum("ij,ij->i", self.x[at][i], x[j]), need, ids, row)
        else:
            scores = self.x[at] @ x.T
            for s in range(self.slots):
                fits = alive & (scores >= need[:, s, None]) & (scores <= self.high[at][:, s, None])
                if fits.sum() > 16 * self.best.k * len(fits):  # only what may rank among the best of these columns
                    k = min(self.best.k, scores.shape[1])
                    fits &= scores >= np.partition(np.where(fits, scores, -np.inf), -k, axis=1)[:, -k, None]
                i, j = np.nonzero(fits)
                self._add(at.start, i, j, scores[i, j], s, ids, row)

    def _keep(self, start, i, j, scores, need, ids, row) -> None:
        for s in range(self.slots):
            fits = (scores >= need[i, s]) & (scores <= self.high[start + i, s])
            self._add(start, i[fits], j[fits], scores[fits], s, ids, row)

    def _add(self, start, i, j, scores, s, ids, row) -> None:
        if len(i):
            self.best.add((start + i) * self.slots + s, scores, ids[j], row[j])

    def found(self) -> pa.RecordBatch:
        b = self.best
        ids = pa.array(b.id, mask=b.id == _NO_ID)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.row[b.slot // self.slots]), pa.array((b.slot % self.slots).astype(np.int32)), pa.array(b.score.astype(np.int64)), ids, pa.array(b.row)],
            names=["anchor", "slot", "score", "id", "row"],
        )


def _search(dim: int, k: int, ranges: int):
    """Partitions hold groups in order, each with its anchors before its vectors."""

    def work(batches):
        begin_task("hard_negatives")
        group, parts, block = None, [], None
        for batch in batches:
            groups, kinds = batch.column("group").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(groups) != 0) | (np.diff(kinds) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(groups)]):
                if high == low:
                    continue
                part = batch.slice(low, high - low)
                if groups[low] != group:
                    if block is not None:
                        yield block.found()
                    group, parts, block = groups[low], [], None
                if kinds[low] == 0:
                    parts.append(part)
                elif parts or block is not None:
                    if block is None:
                        block, parts = _Block(parts, dim, k, ranges), []
                    block.meet(part, dim)
        if block is not None:
            yield block.found()

    return work


def _joined(rows: DataFrame, anchors: DataFrame, n_anchors: int, dim: int, k: int, ranges: int) -> DataFrame:
    """(anchor, slot, score, id, row): the best of every stripe for every anchor."""
    spark = rows.sparkSession
    blocks = max(1, -(-n_anchors // BLOCK))
    stripes = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    columns = ["row", "id", "label", "embedding", "means", "devs"]
    dealt = F.xxhash64("row")
    a = anchors.withColumn("group", F.explode(F.transform(F.sequence(F.lit(0), F.lit(stripes - 1)), lambda s: F.pmod(dealt, F.lit(blocks)).cast("int") * stripes + s)))
    r = rows.withColumn("group", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * stripes + F.pmod(dealt, F.lit(stripes)).cast("int"))))
    both = a.select("group", F.lit(0).alias("kind"), *columns, "positive_scores").union(r.select("group", F.lit(1), *columns, F.lit(None).cast("array<bigint>")))
    grouped = both.repartitionById(blocks * stripes, F.col("group")).sortWithinPartitions("group", "kind")
    return grouped.mapInArrow(_search(dim, k, ranges), "anchor long, slot int, score long, id long, row long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, id: str = "vec_id", label: str | Column = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    label = F.col(label) if isinstance(label, str) else label
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(label.isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.col(vector).alias("embedding")
    )
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    dim = max(1, -(-longest // LEVELS[-1])) * LEVELS[-1]
    summed = T.StructType([*rows.schema.fields, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("means", "devs")]])
    rows = materialize(rows.mapInArrow(_summarize(dim), summed), "vectors")
    anchors = rows.where("is_anchor")
    n = anchors.count()
    near = _joined(rows, anchors.withColumn("positive_scores", F.lit(None).cast("array<bigint>")), n, dim, POSITIVES, 0)
    best = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))
    positives = materialize(near.withColumn("rank", best).where(F.col("rank") <= POSITIVES).select("anchor", (F.col("rank") - 1).alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
    scores = positives.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"]).alias("positive_scores"))
    far = _joined(rows, anchors.join(scores, anchors.row == scores.anchor).drop("anchor"), n, dim, NEGATIVES, POSITIVES)
    far = far.withColumn("rank", best).where(F.col("rank") <= NEGATIVES).select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return far.join(positives, ["anchor", "slot"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, a seventh of the labels shifted."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


ORACLE = f"""
WITH rows_ AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.n, a.vec_id AS anchor_id, b.n AS m, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.n <> b.n WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT n, anchor_id, m, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id, m) <= {POSITIVES}),
negatives AS (
  SELECT p.n, p.m, p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.n, p.m ORDER BY s.score DESC, s.vec_id, s.m) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.n = p.n AND NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= {NEGATIVES}
"""
