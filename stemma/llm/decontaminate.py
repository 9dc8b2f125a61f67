r"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

An item leaks into a document when some passage lies within MAX_EDIT_PERCENT of the
item's length in edits (of characters, after folding A-Z and joining words by one space).

1. *Windows.* Items are indexed by pairs of neighbouring letter runs (two runs of four
   letters, shorter ones for short items) that touch or have one letter between them, so a
   letter changed, left out or put in does not hide a pair. Where pairs of one item gather
   in a band of diagonals as wide as its edits, a window of the item's size is cut out. All
   texts are searched whole; random edits in a fifth of the letters leave four times the
   pairs that a band must hold (MIN_PAIRS of the letters).
2. *Embedding.* WALKS random walks (Chakraborty, Goldenberg, Koucky) read a window: at
   every step the letter at hand is put out and a hash of (walk, step, letter) decides
   whether to move on. Edit distance becomes Hamming distance.
3. *LSH.* Every walk is sampled SAMPLES times at BITS of its steps, the same for all
   windows of about one size; equal samples join windows and items in Spark. ``recall``
   says how likely a pair with a given share of differing steps is found.
4. *Verification.* The least edit distance between the item and any part of the window
   with its surroundings, by a bit-parallel scan. The place of a leak is the word in which
   the nearest part begins.

Items with equal texts are searched once. Items of over ITEM_WORDS words (or ITEM_LETTERS
letters) are searched by equal parts, but verified whole. Parts are taken in blocks of about
BLOCK, by hash, so what the driver and the tasks hold of them is bounded; verification joins
the items' texts by shuffle. Defined cases: null or blank items and texts match
nothing; items too short for an edit match whole words; equal items each match; repeated
rows give equal rows once; null ids are carried; empty tables give an empty result; other
columns pass through ``decontaminate`` and are not carried by ``find_leaks``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import CACHES, begin_task, materialize, mix, signed, table, text_key, text_slices, words

MAX_EDIT_PERCENT = 20
WALKS, SAMPLES, BITS = 8, 24, 4
#: The bits of one sample lie within this many steps: walks that differ run together again for stretches.
SPREAD = 40
#: Parts of items that are searched at once.
BLOCK = 2_000
ITEM_WORDS, ITEM_LETTERS = 400, 4_000

#: Share of an item's letters that must begin a kept pair in one band of diagonals.
MIN_PAIRS = 0.08
#: (least letters, letters of a run, letters between the runs of a pair, share that must be kept).
#: Items under 20 letters have pairs of single letters, of which any edits within the limit leave some.
KINDS = [(60, 4, (0, 1), MIN_PAIRS), (20, 3, (0, 1), MIN_PAIRS), (0, 1, (0,), None)]
#: Buckets of diagonals that one part of a text may span; longer runs of them are looked at in parts.
LONGEST_RUN = 8
#: Letters of texts that are searched at once, if the items are few; hits grow with their letters.
STEP, HITS = 500_000, 40_000_000_000

WINDOWS = "doc_id long, text_key long, item long, part long, size int, start int, window string, around string"
PARTS = "item long, part long, at int, whole int, size int, text string"
FOUND = "doc_id long, text_key long, item long, start int, n_words int, distance int, length int"
KEYS = "id long, part long, key long"
LEAKS = "doc_id long, text_key long, item_id long, start int, n_words int, distance int, length int"

_INDEXES = CACHES.setdefault("leak indexes", {})


def recall(differing: float) -> float:
    """Chance that a pair with this share of differing steps meets in some sample."""
    return 1 - (1 - (1 - differing) ** BITS) ** (WALKS * SAMPLES)


# --- windows -----------------------------------------------------------------


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def pair_hashes(codes: np.ndarray, half: int, gap: int) -> np.ndarray:
    """A hash of two runs of ``half`` letters with ``gap`` letters between, for every place."""
    n = len(codes) - 2 * half - gap + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    run = codes[: len(codes) - half + 1] * np.uint32(0x9E3779B1)
    for i in range(1, half):
        run = (run + codes[i : len(codes) - half + 1 + i]) * np.uint32(0x9E3779B1)
    run ^= run >> np.uint32(15)
    h = run[:n] * np.uint32(0x85EBCA6B) + run[half + gap : half + gap + n]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0xC2B2AE35)
    return h


class ItemGroup:
    """Places of the pairs of letter runs of items that share a run length.

    A pair is two neighbouring runs of ``half`` letters that touch or have one letter between
    them, in the item or in the text: so one letter changed, left out or put in is passed over."""

    BITS = 22

    def __init__(self, texts: dict[int, str], half: int, gaps: tuple, share: float | None, percent: int):
        self.half, self.gaps, self.ids = half, gaps, np.array(list(texts))
        self.size = np.array([len(t) for t in texts.values()], np.int64)
        self.edits = self.size * percent // 100
        # the least of the runs of two letters that any such edits leave, or a share of the letters
        self.need = self.size - 1 - 2 * self.edits if share is None else np.maximum(2, (share * self.size).astype(np.int64))
        self.shift = np.array([max(2, int(e).bit_length()) for e in self.edits], np.int64)
        self.pad = int(self.size.max())
        self.overlap = 2 * int((self.size + self.edits).max())  # of the pieces of a long text
        rows = [(k, i, np.arange(len(k))) for i, t in enumerate(texts.values()) for g in gaps for k in [pair_hashes(codes_of(t), half, g)]]
        key = np.concatenate([k for k, _, _ in rows])
        order = np.argsort(key, kind="stable")
        self.key, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.item = np.concatenate([np.full(len(k), i) for k, i, _ in rows])[order]
        self.offset = np.concatenate([o for _, _, o in rows])[order]
        self.known = np.zeros(1 << self.BITS, bool)
        self.known[self.key >> np.uint32(32 - self.BITS)] = True

    def places(self, codes: np.ndarray):
        """(item, diagonals, offsets) of bands of diagonals that hold enough pairs of an item."""
        low, wide = int(self.pad).bit_length(), int(self.shift.max())
        width = ((len(codes) + self.pad) >> int(self.shift.min())) + 3
        hits = []
        for g in self.gaps:
            h = pair_hashes(codes, self.half, g)
            at = np.flatnonzero(self.known[h >> np.uint32(32 - self.BITS)])
            row = np.searchsorted(self.key, h[at])
            row[row == len(self.key)] = 0
            same = self.key[row] == h[at]
            at, row = at[same], row[same]
            n = self.count[row]
            which = np.repeat(self.first[row] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            item = self.item[which]
            diagonal = np.repeat(at, n) - self.offset[which] + self.pad
            bucket, rest = diagonal >> self.shift[item], diagonal & ((1 << self.shift[item]) - 1)
            hits.append((((item * width + bucket) << low | self.offset[which]) << wide) | rest)
        hit = np.sort(np.concatenate(hits))
        if not len(hit):
            return
        cell = hit >> (low + wide)
        head = np.flatnonzero(np.diff(cell, prepend=-1))
        cells, n = cell[head], np.diff(head, append=len(cell))
        both = n.copy()  # with the next bucket: a band is two buckets wide
        next_ = np.flatnonzero(np.diff(cells) == 1)
        both[next_] += n[next_ + 1]
        good = np.flatnonzero(both >= self.need[cells // width])
        if not len(good):
            return
        new = np.flatnonzero((np.diff(good, prepend=-9) != 1) | (np.diff(cells[good], prepend=-9) != 1))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(good)], strict=True):
            for c in range(a, b, LONGEST_RUN):
                lo, hi = good[c], good[min(b, c + LONGEST_RUN) - 1]
                hi = hi + 1 if hi + 1 < len(cells) and cells[hi + 1] == cells[hi] + 1 else hi
                mine = hit[head[lo] : head[hi] + n[hi]]
                i, bucket = np.divmod(mine >> (low + wide), width)
                i = int(i[0])
                yield i, (bucket << self.shift[i]) + (mine & ((1 << wide) - 1)) - self.pad, (mine >> wide) & ((1 << low) - 1)


class ItemIndex:
    """The pairs of letter runs of a block of items, in groups by the length of the runs."""

    def __init__(self, texts: list[str], percent: int = MAX_EDIT_PERCENT):
        self.exact: dict[str, list[int]] = {}  # too short for an edit
        kinds: dict[tuple, dict[int, str]] = {}
        for i, t in enumerate(texts):
            if not len(t) * percent // 100:
                self.exact.setdefault(t, []).append(i)
            else:
                kinds.setdefault(next(k[1:] for k in KINDS if len(t) >= k[0]), {})[i] = t
        self.groups = [ItemGroup(mine, *kind, percent) for kind, mine in kinds.items()]
        self.exact_words = sorted({t.count(" ") + 1 for t in self.exact})
        self.step = min(STEP, max(20_000, HITS // (1 + sum(map(len, texts)))))


def index_of(block: str, texts: list[str], percent: int) -> ItemIndex:
    """The worker's index of a block, kept from task to task."""
    if block not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[block] = ItemIndex(texts, percent)
    return _INDEXES[block]


def find_windows(texts: list[str], index: ItemIndex):
    """(text, item, first word, begin, end, start) of the parts of folded texts worth a look.

    ``begin`` and ``end`` bound the letters in which the passage lies whole. Long texts are searched
    in pieces; a passage belongs to the piece in which it starts, and every piece is read with so much
    before and after it that such a passage is seen as in an uncut text."""
    for d, t in enumerate(texts) if index.exact else ():
        w = t.split(" ")
        starts = np.cumsum([0, *(len(x) + 1 for x in w)])
        for n in index.exact_words:
            for k in range(len(w) - n + 1):
                part = " ".join(w[k : k + n])
                for i in index.exact.get(part, ()):
                    yield d, i, k, int(starts[k]), int(starts[k]) + len(part), int(starts[k])
    codes = codes_of("\n".join(texts))  # folded texts hold no other line ends, and items none
    stop = np.cumsum([len(t) + 1 for t in texts])
    for g, lo, last in ((g, lo, lo + index.step >= len(codes) - g.overlap) for g in index.groups for lo in range(0, max(1, len(codes) - g.overlap), index.step)):
        seen = max(0, lo - g.overlap) >> int(g.shift.max()) << int(g.shift.max())  # buckets of diagonals lie alike in all pieces
        for i, diagonal, offset in g.places(codes[seen : lo + index.step + g.overlap]):
            diagonal += seen
            size, edits, need = int(g.size[i]), int(g.edits[i]), int(g.need[i])
            owner = np.searchsorted(stop, diagonal + offset, side="right")
            for d in np.unique(owner).tolist():
                mine = owner == d
                x, o = diagonal[mine], offset[mine]
                if len(x) < need or len(np.unique(o)) < need:
                    continue
                base, end = int(stop[d]) - len(texts[d]) - 1, int(stop[d]) - 1
                begin, over = max(base, int(x.min()) - edits), min(end, int(x.max()) + size + edits)
                least = int(x.min())
                best = {least + int(np.argmax(np.bincount(x - least)))}
                for third in (o < max(1, size // 3), o > size * 2 // 3):  # letters put in or left out shift the ends
                    if third.any():
                        best.add(least + int(np.argmax(np.bincount(x[third] - least))))
                for s in sorted(best):
                    at = min(max(s, base), end)
                    if (not lo or at >= lo) and (last or at < lo + index.step):
                        yield d, int(g.ids[i]), texts[d].count(" ", 0, at - base), begin - base, over - base, at - base


def fold(text: str | None) -> str:
    return b" ".join(words(text, lower=True)).decode("utf-8", "replace")


def _windows(items: list[tuple[int, int, int, int, str]], percent: int, block: str):
    """Windows of rows (item, part, offset in the whole, letters of the whole, text of the part)."""

    def run(batches):
        begin_task("leak windows")
        index = index_of(block, [x[4] for x in items], percent)
        types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.string()] * 2
        for batch in batches:
            for lo, texts in text_slices(batch.column(2), index.step):
                part, rows = [fold(t) for t in texts], []
                ids, keys = (batch.column(i).slice(lo, len(texts)).to_pylist() for i in (0, 1))
                for d, i, _, begin, end, at in find_windows(part, index):
                    item, key, offset, whole, text = items[i]
                    slack = 0 if whole == len(text) else whole * percent // 100
                    first = max(0, begin - offset - slack)
                    around = part[d][first : end + whole - offset - len(text) + slack]
                    rows.append((ids[d], keys[d], item, key, len(text), part[d].count(" ", 0, first), part[d][at : at + len(text)], around))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in WINDOWS.split(", ")])

    return run


# --- embedding and LSH ---------------------------------------------------------


def size_class(size: np.ndarray) -> np.ndarray:
    """Greatest step of a ladder (a tenth each) up to so many letters: windows of a class share their steps."""
    ladder = np.unique((1.1 ** np.arange(250)).astype(np.int64))
    return ladder[np.searchsorted(ladder, np.maximum(size, 1), side="right") - 1]


def sample_keys(texts: list[str], size: int) -> np.ndarray:
    """Keys (text, walk * SAMPLES + sample) of windows of ``size`` letters or up to a tenth more.

    A walk moves on at every other step, so two steps a letter read a window to its end."""
    rng = np.random.default_rng([size, WALKS, SAMPLES, BITS])
    reach = max(4, 2 * size)
    spread = min(SPREAD, reach)
    steps = rng.integers(0, reach - spread + 1, (WALKS, SAMPLES, 1)) + rng.integers(0, spread, (WALKS, SAMPLES, BITS))
    longest = max(map(len, texts), default=0) + 1
    chars = np.zeros((len(texts), longest), np.uint32)
    for i, t in enumerate(texts):
        chars[i, : len(t)] = codes_of(t) + 1  # 0 is the end
    out = np.empty((len(texts), WALKS * SAMPLES), np.uint64)
    rows = np.arange(len(texts))
    put = np.zeros((int(steps.max()) + 1, WALKS, len(texts)), np.uint32)
    at = np.zeros((WALKS, len(texts)), np.int64)
    walks = np.arange(WALKS, dtype=np.uint64)[:, None] << np.uint64(40)
    for step in range(len(put)):
        put[step] = letter = chars[rows, at]
        coin = mix(letter.astype(np.uint64) + (walks | np.uint64(step << 24)))
        at = np.minimum(at + ((coin >> np.uint64(17)) & np.uint64(1)).astype(np.int64), longest - 1)
    for walk in range(WALKS):
        for s in range(SAMPLES):
            key = np.full(len(texts), (size << 16) | (walk << 8) | s, np.uint64)
            for b in range(BITS):
                key = mix(key) + put[steps[walk, s, b], walk].astype(np.uint64)
            out[:, walk * SAMPLES + s] = mix(key)
    return out


def _keys(batches):
    """(id, part, key) of rows (id, part, size, window)."""
    begin_task("leak keys")
    for batch in batches:
        ids, parts, size = (np.asarray(batch.column(i)) for i in range(3))
        size, text = size_class(size), batch.column(3).to_pylist()
        for w in np.unique(size):
            which = np.flatnonzero(size == w)
            for lo in range(0, len(which), 500):
                part = which[lo : lo + 500]
                keys = sample_keys([text[i] for i in part], int(w))
                cols = [pa.array(np.repeat(ids[part], keys.shape[1])), pa.array(np.repeat(parts[part], keys.shape[1])), pa.array(signed(keys.ravel()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "part", "key"])


# --- verification --------------------------------------------------------------


def best_edit_distance(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``text``, and where that part ends."""
    m = len(item)
    if not m:
        return 0, 0
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a part may begin anywhere, so nothing comes in at the top
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def place_of(item: str, text: str, end: int) -> int:
    """Where the part of ``text`` begins that ends at ``end`` and is nearest to the item: so the windows that
    see one passage name one place, however they were cut."""
    return end - best_edit_distance(item[::-1], text[:end][::-1])[1]


def _verify(percent: int):
    def run(batches):
        begin_task("leak verification")
        names = [f.split()[0] for f in FOUND.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4]
        for batch in batches:
            rows = []
            for doc_id, key, number, item, start, around in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d, end = best_edit_distance(item, around)
                if 100 * d <= percent * len(item):
                    rows.append((doc_id, key, number, start + around.count(" ", 0, place_of(item, around, end)), item.count(" ") + 1, d, len(item)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


# --- the operator ----------------------------------------------------------------


def whole_parts(rows) -> list[tuple]:
    """(item_id, folded part, its first letter, folded item): long items give equal parts.

    If an item is within the limit, so is one of its parts."""
    out = []
    for item_id, text in rows:
        w = words(text, lower=True)
        n = -(-len(w) // ITEM_WORDS)
        ends = [len(w) * i // n for i in range(n + 1)] if n else []
        whole, at = fold(text), 0
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            part = b" ".join(w[lo:hi]).decode("utf-8", "replace")
            cuts = -(-len(part) // ITEM_LETTERS)  # more than one only where words are very long
            for c in range(cuts):
                a, b = len(part) * c // cuts, len(part) * (c + 1) // cuts
                out.append((item_id, part[a:b], at + a, whole))
            at += len(part) + 1
    return out


def item_parts(rows) -> list[tuple]:
    """(item_id, folded text) of items; long ones give their parts."""
    return [(i, part) for i, part, _, _ in whole_parts(rows)]


def _folded(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fold(t) for t in batch.column(1).to_pylist()], pa.string())], names=["item", "folded"])


def _parts(batches):
    names = [f.split()[0] for f in PARTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        rows = []
        for item, part, at, whole in whole_parts(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            key = xxhash.xxh3_64_intdigest(f"{item}:{at}".encode()) >> 1
            rows.append((item, key, at, len(whole), len(part), part))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def find_leaks(docs: DataFrame, items: DataFrame, percent: int = MAX_EDIT_PERCENT, block: int = BLOCK) -> DataFrame:
    """Rows LEAKS: passages of ``docs`` (doc_id, text) within the limit of an item (item_id, text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), text_key("text").alias("text_key"), F.col("text").cast("string"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("item", text_key("text"))
    once = asked.select("item", "text").distinct()
    known = materialize(once.mapInArrow(_folded, "item long, folded string"), "leak-items")
    parts = materialize(once.mapInArrow(_parts, PARTS), "leak-parts")
    blocks = -(-parts.count() // block)
    out = None
    for b in range(blocks):
        mine = parts.where(F.pmod(F.xxhash64("part"), F.lit(blocks)) == b) if blocks > 1 else parts
        rows = sorted((r.item, r.part, r["at"], r.whole, r.text) for r in mine.toLocalIterator())
        if not rows:
            continue
        windows = materialize(texts.mapInArrow(_windows(rows, percent, uuid.uuid4().hex), WINDOWS), "windows").distinct()
        windows = windows.withColumn("id", F.xxhash64("doc_id", "text_key", "part", "start", "window"))
        item_keys = mine.select(F.col("part").alias("id"), "part", "size", F.col("text").alias("window")).mapInArrow(_keys, KEYS).select("part", "key")
        met = windows.select("id", "part", "size", "window").mapInArrow(_keys, KEYS).join(F.broadcast(item_keys), ["part", "key"]).select("id", "part").distinct()
        around = windows.select("id", "doc_id", "text_key", "item", "part", "start", "around").distinct()
        checked = around.join(met, ["id", "part"]).join(known, "item")
        found = checked.select("doc_id", "text_key", "item", "folded", "start", "around").mapInArrow(_verify(percent), FOUND)
        found = materialize(found.distinct(), "found-leaks")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], LEAKS)
    return out.distinct().join(asked.select("item", "item_id"), "item").select("doc_id", "text_key", "item_id", "start", "n_words", "distance", "length")


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = MAX_EDIT_PERCENT) -> DataFrame:
    """The rows of ``docs`` without a leak."""
    bad = find_leaks(docs, items, percent).select(F.col("text_key").alias("_key")).distinct()
    keyed = docs.withColumn("_text", text_key("text"))
    return keyed.join(bad, F.col("_text") == F.col("_key"), "left_anti").drop("_text")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.groupBy("doc_id", "item_id").agg(F.min("distance").cast("long").alias("distance"), F.min("length").cast("long").alias("length"), F.count_distinct("start").alias("n_places"), F.min("start").cast("long").alias("first_word"))
