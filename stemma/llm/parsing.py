r"""Suffix-array dedup by prefix-free parsing: removes repeated byte strings exactly.

Every byte of a text that lies in a WINDOW-byte string which also starts earlier in the
corpus (smaller doc_id, or the same document further left) is removed. Matches never
cross documents and are judged on the input.

*Parse.* A rolling hash over TRIGGER bytes is taken at every byte; each window's least
hash is its trigger. Windows that follow one another with one trigger form a phrase:
the bytes that they cover. So every window lies in one phrase, at a place relative to its
trigger that only its own bytes decide, and equal windows have equal triggers. The parse
is one narrow row per phrase: trigger hash, phrase hash, place.
*Dictionary.* Phrases that repeat within a batch of texts are settled where they are
parsed, so that a phrase however frequent sends one row a batch. Spark sorts the rest by
trigger, phrase and place. Equal phrases become
neighbours in corpus order; all but the first are repeats with all their windows. The
first ones are the dictionary. A dictionary phrase that shares its trigger with no other
is new throughout.
*Suffixes.* Of dictionary phrases that share a trigger, the windows (the phrases' suffixes
cut at WINDOW bytes) are ordered by place relative to the trigger, hash and corpus order;
again all but the first of equals are repeats. This is the part of the suffix array of
dictionary and parse that the task needs, and it is computed trigger by trigger, so no
suffix array is ever held whole.

Strings are compared by 64-bit hashes among those with equal trigger. Defined cases: null
texts are empty; texts of under WINDOW bytes lose nothing; rows with equal doc_id and
text are one document and get the same result; several texts under one doc_id follow one
another in order of their hashes; a null doc_id sorts first; an empty table gives an
empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.common import begin_task, materialize, mix, signed, table, text_key, text_or_empty, text_slices

WINDOW = 100
TRIGGER = 32
#: Bytes parsed at once; longer texts are parsed in pieces that overlap by a window.
PIECE = 2_000_000
_POSITION = np.uint64((1 << 22) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
NULL_ID = -(1 << 63)

PARSE = "trigger long, phrase long, doc long, place long, copy boolean"
SORTED = "trigger long, doc long, place long, copy boolean"
REPEATS = "doc long, place long, n int"
#: place = number of the text under its doc_id (24 bits), first byte (32 bits), windows (7 bits)


def pack(number, start, count):
    return (number << 39) | (start << 7) | count


class Powers:
    """Powers of the base and of its inverse, up to the largest piece seen."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int):
        if len(cls.up) < n + 1:
            cls.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE, np.uint64))])
            cls.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _INVERSE, np.uint64))])
        return cls.up, cls.down


class Rolling:
    """Hashes of any substring of one byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = Powers.of(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n] if n > 0 else np.empty(0, np.uint64)


def sliding_min(x: np.ndarray, u: int) -> np.ndarray:
    """Minimum of every u neighbours, from minima towards both ends of blocks of u."""
    n = len(x)
    whole = -(-n // u) * u
    b = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    b[:n] = x
    b = b.reshape(-1, u)
    before = np.minimum.accumulate(b, axis=1).ravel()
    after = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - u + 1], before[u - 1 : n])


def parse(data: np.ndarray, limits: np.ndarray, window: int = WINDOW, trigger: int = TRIGGER):
    """Phrases of the texts that lie one after another in ``data``; ``limits`` are their ends.

    Returns (first byte, windows, trigger hash, phrase hash) per phrase."""
    none = np.empty(0, np.int64)
    if len(data) < window:
        return none, none, np.empty(0, np.uint64), np.empty(0, np.uint64)
    roll = Rolling(data)
    h = mix(roll.every(trigger))
    place = np.arange(len(h), dtype=np.uint64)
    low = sliding_min((h & ~_POSITION) | (_POSITION - place), window - trigger + 1)
    at = (_POSITION - (low & _POSITION)).astype(np.int64)  # each window's trigger, the last of equals
    end_of = np.repeat(limits, np.diff(limits, prepend=0))[: len(at)]
    inside = np.arange(len(at)) + window <= end_of
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none, np.empty(0, np.uint64), np.empty(0, np.uint64)
    t = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (t[1:] != t[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(head, append=len(starts))
    first, t = starts[head], t[head]
    shape = ((t - first) * 128 + count).astype(np.uint64)
    phrase = mix(roll.of(first, first + count + window - 1) + mix(shape))
    return first, count, h[t], phrase


def pieces(texts: list[bytes]):
    """Lists of (index, offset, bytes) that are parsed together."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), PIECE):
            part = t[at : at + PIECE + WINDOW - 1] if len(t) > PIECE else t
            if held and size + len(part) > PIECE + WINDOW:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


def _parse(batches):
    begin_task("parse")
    for batch, lo, texts in ((b, lo, texts) for b in batches for lo, texts in text_slices(b.column(2), 8 * PIECE)):
        docs, numbers = (np.asarray(batch.column(i).slice(lo, len(texts))) for i in (0, 1))
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        for part in pieces(texts):
            sizes = np.array([len(p) for _, _, p in part], np.int64)
            limits = np.cumsum(sizes)
            data = np.frombuffer(b"".join(p for _, _, p in part), np.uint8)
            first, count, trigger, phrase = parse(data, limits)
            which = np.searchsorted(limits, first, side="right")
            index = np.array([i for i, _, _ in part], np.int64)
            offset = np.array([at for _, at, _ in part], np.int64)
            start = first - (limits - sizes)[which] + offset[which]
            owner = index[which]
            doc, place = docs[owner], pack(numbers[owner].astype(np.int64), start, count)
            copy = copies_here(trigger, phrase, doc, place)
            # a copy is settled: its row travels under a hash of its place, not with its trigger
            deal = np.where(copy, mix(doc.view(np.uint64) + mix(place.view(np.uint64))), trigger)
            yield pa.RecordBatch.from_arrays([pa.array(signed(deal)), pa.array(signed(phrase)), pa.array(doc), pa.array(place), pa.array(copy)], names=[f.split()[0] for f in PARSE.split(", ")])


def copies_here(trigger, phrase, doc, place) -> np.ndarray:
    """Rows that repeat an earlier phrase of the same batch of texts."""
    key = mix(trigger + mix(phrase))
    order = np.lexsort((place, doc, key))
    k, d, p = key[order], doc[order], place[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    copy = np.zeros(len(k), bool)
    copy[order] = (d != d[first]) | (p != p[first])
    return copy


def _neighbours(batches):
    """Over rows sorted by trigger, phrase, doc and place: copies of an earlier phrase, and
    first phrases whose trigger leads other phrases too. Keeps one row between batches."""
    begin_task("neighbours")
    last = None  # the phrase at hand: trigger, phrase, first doc and place, whether its trigger led the phrase before

    def out(trigger, doc, place, copy):
        return pa.RecordBatch.from_arrays([pa.array(trigger), pa.array(doc), pa.array(place), pa.array(copy)], names=["trigger", "doc", "place", "copy"])

    for batch in batches:
        settled = batch.column(4).to_numpy(zero_copy_only=False)
        t, q, d, p = (np.asarray(c) for c in batch.columns[:4])
        if settled.any():
            yield out(t[settled], d[settled], p[settled], np.ones(int(settled.sum()), bool))
            t, q, d, p = (x[~settled] for x in (t, q, d, p))
        if not len(t):
            continue
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (q[1:] != q[:-1])
        if last is None:
            held = [np.empty(0, np.int64)] * 3
            left0 = False
        else:
            new[0] = (t[0], q[0]) != last[:2]
            held = [np.array([last[i]], np.int64) for i in (0, 2, 3)]
            left0 = last[4]
        ft, fd, fp = (np.concatenate([a, b[new]]) for a, b in zip(held, (t, d, p), strict=True))
        of = np.cumsum(new) - (last is None)
        copy = ~new & ((d != fd[of]) | (p != fp[of]))
        left = np.zeros(len(ft), bool)
        left[1:] = ft[1:] == ft[:-1]
        left[0] = left0
        shared = left[:-1] | (ft[:-1] == ft[1:])
        done = np.flatnonzero(shared)
        n = int(copy.sum()) + len(done)
        if n:
            yield out(np.concatenate([t[copy], ft[done]]), np.concatenate([d[copy], fd[done]]), np.concatenate([p[copy], fp[done]]), np.arange(n) < copy.sum())
        last = (int(t[-1]), int(q[-1]), int(fd[-1]), int(fp[-1]), bool(left[-1]))
    if last and last[4]:
        yield out([last[0]], [last[2]], [last[3]], [False])


def _phrases(batches):
    """The bytes of the wanted phrases of each text, as (trigger, doc, place, data)."""
    names = ["trigger", "doc", "place", "data"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    begin_task("phrases")
    for batch in batches:
        rows, size = [], 0
        for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            b = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                start, count = (w["place"] >> 7) & 0xFFFFFFFF, w["place"] & 127
                rows.append((w["trigger"], doc, w["place"], b[start : start + count + WINDOW - 1]))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def windows_of(data: list[bytes], place: np.ndarray):
    """(row, offset, key) of every window; key hashes its bytes and its place by its trigger.

    A phrase's trigger is the last least hash of its first window."""
    sizes = np.array([len(x) for x in data], np.int64)
    count = place & 127
    flat = np.frombuffer(b"".join(data), np.uint8)
    roll = Rolling(flat)
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(data)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    h = mix(roll.every(TRIGGER))
    low = sliding_min((h & ~_POSITION) | (_POSITION - np.arange(len(h), dtype=np.uint64)), WINDOW - TRIGGER + 1)
    at = (_POSITION - (low[begin] & _POSITION)).astype(np.int64) - begin
    start = begin[row] + offset
    return row, offset, mix(roll.of(start, start + WINDOW) + mix((at[row] - offset).astype(np.uint64)))


def _runs(doc, place, row, offset):
    """Repeated windows (row, offset), in order, as packed runs."""
    if not len(row):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
    head = np.flatnonzero(new)
    n = np.diff(head, append=len(row))
    return doc[row[head]], ((place[row[head]] >> 7) + offset[head]) << 7 | n


def _suffixes(batches):
    """Repeated windows among phrases of one trigger, from rows sorted by trigger, doc and place.

    Between batches only the keys of the windows seen of the trigger at hand are kept."""
    begin_task("suffixes")
    current, seen = None, np.empty(0, np.uint64)
    for batch in batches:
        trigger, doc, place = (np.asarray(batch.column(i)) for i in range(3))
        data = batch.column(3).to_pylist()
        for lo in range(0, len(data), 10_000):  # under 2 MB, so positions fit their bits
            t, d, p = trigger[lo : lo + 10_000], doc[lo : lo + 10_000], place[lo : lo + 10_000]
            row, offset, key = windows_of(data[lo : lo + 10_000], p)
            key = mix(key + t[row].view(np.uint64))
            _, first = np.unique(key, return_index=True)  # the first of equals, as rows are in order
            repeat = np.ones(len(key), bool)
            repeat[first] = False
            if current is not None and t[0] == current:
                mine = t[row] == current
                repeat[mine] |= np.isin(key[mine], seen)
            tail = key[t[row] == t[-1]]
            seen = np.unique(np.concatenate([seen, tail])) if current == t[-1] else np.unique(tail)
            current = t[-1]
            where = np.flatnonzero(repeat)
            out = _runs(d, p, row[where], offset[where])
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["doc", "place"])


def _loose_windows(batches):
    """Every window of a phrase as a row (key, doc, place): for triggers with very many phrases."""
    for batch in batches:
        trigger, doc, place = (np.asarray(batch.column(i)) for i in range(3))
        data = batch.column(3).to_pylist()
        for lo in range(0, len(data), 10_000):
            t, d, p = trigger[lo : lo + 10_000], doc[lo : lo + 10_000], place[lo : lo + 10_000]
            row, offset, key = windows_of(data[lo : lo + 10_000], p)
            key = mix(key + t[row].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(d[row]), pa.array(((p[row] >> 7) + offset) << 7 | 1)], names=["key", "doc", "place"])


def _later(batches):
    """Rows sorted by key, doc and place, without the first of each key."""
    last = None
    for batch in batches:
        key = np.asarray(batch.column(0))
        if not len(key):
            continue
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        again[0] = last is not None and key[0] == last
        last = key[-1]
        if again.any():
            mask = pa.array(again)
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(mask), batch.column(2).filter(mask)], names=["doc", "place"])


def spans_of(places, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs (start, end) of the repeated windows of one text."""
    p = np.array(places, np.int64)
    start, count = (p >> 7) & 0xFFFFFFFF, p & 127
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count + WINDOW - 1, -1)
    covered = np.cumsum(edge[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return turn[::2], turn[1::2]


RESULT = "doc_id long, number long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary"


def _cut(digest: bool):
    def run(batches):
        begin_task("cut")
        for batch in batches:
            rows = []
            for doc, number, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = text.encode("utf-8", "surrogatepass")
                starts, ends = spans_of(places, len(b)) if places else (np.empty(0, np.int64),) * 2
                keep = [b[i:j] for i, j in zip([0, *ends.tolist()], [*starts.tolist(), len(b)], strict=True)]
                kept = hashlib.sha256(b"".join(keep)).digest() if digest else b"".join(keep)
                rows.append((None if doc == NULL_ID else doc, number, len(b), int((ends - starts).sum()), starts.tolist(), ends.tolist(), kept))
            if rows:
                types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """(doc, number, text): number tells the texts of one doc_id apart, and is 0 if there is one."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), text_or_empty("text").cast("string").alias("text"))
    several = texts.select("doc", text_key("text").alias("key")).groupBy("doc").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("doc")
    several = materialize(several, "shared-ids")
    if several.isEmpty():
        return texts.select("doc", F.lit(0).cast("long").alias("number"), "text")
    keys = texts.select("doc", text_key("text").alias("key")).join(several, "doc").distinct()
    order = keys.select(F.col("doc").alias("_doc"), F.col("key").alias("_key"), (F.row_number().over(Window.partitionBy("doc").orderBy("key")) - 1).cast("long").alias("n"))
    found = texts.join(order, (F.col("doc") == F.col("_doc")) & (text_key("text") == F.col("_key")), "left")
    return found.select("doc", F.coalesce("n", F.lit(0)).cast("long").alias("number"), "text")


#: Triggers that lead more phrases than this have their windows dealt one by one.
HOT_PHRASES = 200_000


def repeated_strings(docs: DataFrame, digest: bool = False, hot_phrases: int = HOT_PHRASES) -> DataFrame:
    """Rows RESULT, one per row of ``docs`` (doc_id, text): the removed spans and what is kept.

    ``kept`` holds the remaining bytes, or with ``digest`` their SHA-256."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = numbered(docs)
    # the texts are dealt by document once; both joins below read this exchange
    by_doc = texts.repartition(n, "doc")
    parsed = texts.select("doc", "number", "text").mapInArrow(_parse, PARSE)
    order = ["trigger", "phrase", "doc", "place"]
    found = materialize(parsed.repartition(n, "trigger").sortWithinPartitions(*order).mapInArrow(_neighbours, SORTED), "parse")
    number = F.shiftright("place", 39).cast("long")

    def phrases(rows):
        wanted = rows.groupBy("doc", number.alias("number")).agg(F.collect_list(F.struct("trigger", "place")).alias("wanted"))
        return by_doc.join(wanted, ["doc", "number"]).select("doc", "text", "wanted").mapInArrow(_phrases, "trigger long, doc long, place long, data binary")

    shared = found.where("NOT copy").select("trigger", "doc", "place")
    hot = materialize(shared.groupBy("trigger").count().where(F.col("count") > hot_phrases).select("trigger"), "hot-triggers")
    repeats = found.where("copy").select("doc", "place")
    few = shared
    if not hot.isEmpty():
        few = shared.join(hot, "trigger", "left_anti")
        loose = phrases(shared.join(hot, "trigger", "left_semi").select("trigger", "doc", "place")).mapInArrow(_loose_windows, "key long, doc long, place long")
        repeats = repeats.union(loose.repartition(n, "key").sortWithinPartitions("key", "doc", "place").mapInArrow(_later, "doc long, place long"))
    suffixes = phrases(few).repartition(n, "trigger").sortWithinPartitions("trigger", "doc", "place").mapInArrow(_suffixes, "doc long, place long")
    repeats = repeats.union(suffixes).groupBy("doc", number.alias("number")).agg(F.collect_list("place").alias("places"))
    return by_doc.join(repeats, ["doc", "number"], "left").select("doc", "number", "text", "places").mapInArrow(_cut(digest), RESULT)


def op8_parsing(spark, sf_dir: str) -> DataFrame:
    r = repeated_strings(table(spark, sf_dir, "documents"), digest=True)
    return r.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256"))
