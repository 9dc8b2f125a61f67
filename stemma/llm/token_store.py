"""Token ids in binary files: one shared Zstandard dictionary, a frame per document, an
offset index, so that one short document can be read without its neighbours.

File layout (little-endian): magic ``TOKZ0001``; sha256 of the dictionary (32 bytes);
dictionary length (u32) and bytes; one frame per document over its ids as u32; then the
index, a frame over rows of (doc_id i64, flags u8, offset u64, bytes u32, ids u32); a
trailer of index offset (u64), index bytes (u32), documents (u32), magic again.

Files hold documents in ascending doc_id order, each file a range of ids, equal ids in
order of the text's hash. A task writes under a name of its own attempt and returns what
it wrote, so a task that runs twice does no harm. The dictionary comes from a bounded
sample: at most SAMPLE_DOCS documents of at most SAMPLE_CHARS characters, those with the
smallest hashes.

Defined cases: a null or empty text gives the end id alone; null doc_ids come first;
repeated rows are documents of their own; an empty table writes no file and reads back
as an empty result; other columns are not written.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.llm.common import CACHES, begin_task, filesystem, materialize, new_folder, table, text_or_empty

MAGIC = b"TOKZ0001"
END_ID = 0
SAMPLE_DOCS = 400
SAMPLE_CHARS = 8_000
DICT_BYTES = 32_768
LEVEL = 3

INDEX_ROW = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4")])
FILES = "path string, part int, documents long, ids long"
ROWS = "path string, part int, seq long, doc_id long, before long, n_tokens long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- encoding ----------------------------------------------------------------


#: White space by the Unicode property White_Space: a space beside the first kind, or any of the second, keeps a text whole.
_NARROW = "\t\x0b\x0c\r"
_WIDE = "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def splits(text: str) -> bool:
    """Whether the ids of a text are those of its space-led chunks."""
    if "\0" in text or "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in _NARROW):
        return False
    if "\n" in text and any(x[:1] == " " or x[-1:] == " " for x in text.split("\n")):  # also at the text's ends, where it does no harm
        return False
    return text.isascii() or not any(c in text for c in _WIDE)


class ChunkEncoder:
    """The library's ids of whole texts, with the ids of every space-led chunk kept.

    This tokenizer cuts a text before each single space between other signs, so a text in
    which no space stands beside white space has the ids of its chunks one after another.
    All other texts (and those with a NUL) go to the library whole. Beyond ``limit`` kept chunks the first
    four sevenths remain: those seen first are the frequent ones."""

    LIMIT = 1_000_000
    #: Chunks in one text given to the library, and texts in one call.
    JOIN, CALL = 100, 500

    def __init__(self, path: str, limit: int = LIMIT):
        from tokenizers import Tokenizer

        self.limit, self.stay = limit, limit * 4 // 7
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.at: dict[str, int] = {}  # a chunk is kept without its space, a text's head after a NUL
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _text(key: str) -> str:
        return key[1:] if key.startswith("\0") else " " + key

    def _learn(self, keys: list[str]) -> None:
        """Encode many chunks at once, with the special token between them.

        The library takes special tokens out before anything else, so what lies between
        two of them is encoded as if it stood alone."""
        odd = [k for k in keys if self.mark in k]
        keys = [k for k in keys if self.mark not in k] if odd else keys
        for i in range(0, len(keys), self.JOIN * self.CALL):
            part = keys[i : i + self.JOIN * self.CALL]
            texts = [(k[1:] if k[:1] == "\0" else " " + k) + self.mark for k in part]
            rows = self._library(["".join(texts[j : j + self.JOIN]) for j in range(0, len(texts), self.JOIN)])
            ids = np.fromiter(chain.from_iterable(rows), np.uint32, sum(map(len, rows)))
            cuts = np.flatnonzero(ids == self.mark_id)
            self._keep(part, ids[ids != self.mark_id], np.diff(cuts, prepend=-1) - 1)
        for k in odd:
            ids = self._library([self._text(k)])[0]
            self._keep([k], np.array(ids, np.uint32), np.array([len(ids)]))

    def _keep(self, keys: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        first, total = len(self.at), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(keys) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.flat[self.used : self.used + total] = ids
        self.starts[first : first + len(keys)] = self.used + np.cumsum(n) - n
        self.sizes[first : first + len(keys)] = n
        self.used += total
        self.at.update(zip(keys, range(first, first + len(keys)), strict=True))

    def _trim(self) -> None:
        if len(self.at) > self.limit:
            self.at = {k: i for k, i in self.at.items() if i < self.stay}
            self.used = int(self.starts[self.stay - 1] + self.sizes[self.stay - 1])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        self._trim()
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and splits(t)]
        whole = [i for i, t in enumerate(texts) if t and not splits(t)]
        chunks, ends = [], []
        for i in plain:
            pieces = texts[i].split(" ")
            pieces[0] = "\0" + pieces[0]
            chunks += pieces
            ends.append(len(chunks))
        which = np.fromiter(map(self.at.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(which < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys([chunks[i] for i in missing])))
            which[missing] = [self.at[chunks[i]] for i in missing]
        n, starts = self.sizes[which], self.starts[which]
        stop = np.cumsum(n)
        ids = self.flat[np.arange(int(n.sum())) + np.repeat(starts - (stop - n), n)]
        bounds = np.concatenate([[0], stop])
        begin = 0
        for i, e in zip(plain, ends, strict=True):
            out[i] = ids[bounds[begin] : bounds[e]]
            begin = e
        for i, x in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = np.array(x, np.uint32)
        end = np.array([END_ID], np.uint32)
        return [end if x is None else np.concatenate([x, end]) for x in out]


_ENCODERS: dict[str, ChunkEncoder] = CACHES.setdefault("encoders", {})


def encoder(path: str, limit: int = ChunkEncoder.LIMIT) -> ChunkEncoder:
    """The worker's encoder for a tokenizer, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path, limit)
    _ENCODERS[path].limit, _ENCODERS[path].stay = limit, limit * 4 // 7
    return _ENCODERS[path]


# --- files ---------------------------------------------------------------------


def _slices(texts: pa.Array, most: int = 1_500_000):
    """Parts of an array of texts of about ``most`` bytes, one text at least."""
    begin, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if len(texts):
        yield begin, len(texts)


def _writer(folder: str, tokenizer: str, dictionary: bytes, keep: int):
    def write(batches):
        import zstandard as zstd
        from pyspark import TaskContext

        begin_task("tokens")
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tokz"
        d = zstd.ZstdCompressionDict(dictionary)
        packer = zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True)
        out, at, index, total = None, 0, [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in _slices(texts):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}")
                    head = MAGIC + hashlib.sha256(dictionary).digest() + struct.pack("<I", len(dictionary)) + dictionary
                    out.write(head)
                    at = len(head)
                for doc_id, x in zip(ids[lo:hi], encoder(tokenizer, keep).encode(texts.slice(lo, hi - lo).to_pylist()), strict=True):
                    frame = packer.compress(x.astype("<u4").tobytes())
                    out.write(frame)
                    index.append((doc_id or 0, doc_id is None, at, len(frame), len(x)))
                    at += len(frame)
                    total += len(x)
        if out is None:
            return
        packed = zstd.ZstdCompressor(level=LEVEL).compress(np.array(index, INDEX_ROW).tobytes())
        out.write(packed + struct.pack("<QII", at, len(packed), len(index)) + MAGIC)
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{name}"]), pa.array([task.partitionId()], pa.int32()), pa.array([len(index)], pa.int64()), pa.array([total], pa.int64())],
            names=["path", "part", "documents", "ids"],
        )

    return write


class TokenFile:
    """Random access to one file: its index, and the ids of any document in it."""

    def __init__(self, path: str):
        import zstandard as zstd

        fs, p = filesystem(path)
        self.data = fs.open_input_file(p)
        head = self.data.read(44)
        self.dictionary_hash = head[8:40].hex()
        dictionary = self.data.read(struct.unpack("<I", head[40:])[0])
        if head[:8] != MAGIC or hashlib.sha256(dictionary).digest() != head[8:40]:
            raise ValueError(f"{path}: no token file, or its dictionary is damaged")
        self.unpacker = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(dictionary))
        self.data.seek(self.data.size() - 24)
        at, n, _, magic = struct.unpack("<QII8s", self.data.read(24))
        if magic != MAGIC:
            raise ValueError(f"{path}: the file has no end")
        self.data.seek(at)
        self.index = np.frombuffer(zstd.ZstdDecompressor().decompress(self.data.read(n)), INDEX_ROW)

    def ids(self, i: int) -> np.ndarray:
        row = self.index[i]
        self.data.seek(int(row["offset"]))
        return np.frombuffer(self.unpacker.decompress(self.data.read(int(row["bytes"]))), "<u4")

    def close(self):
        self.data.close()


def shared_dictionary(docs: DataFrame, tokenizer: str, size: int = DICT_BYTES) -> bytes:
    """A dictionary trained on the id arrays of the bounded sample (see the module's head)."""
    import zstandard as zstd

    short = docs.select("doc_id", "text").where((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS))
    # a cut of the hash leaves about twice the sample, so that no task sends many texts
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    cut = min(1 << 40, 2 * SAMPLE_DOCS * (1 << 40) // max(1, docs.count()))
    sample = short.where(place < cut).orderBy(place, "doc_id").limit(SAMPLE_DOCS).select("text").collect()
    arrays = [x.astype("<u4").tobytes() for x in encoder(tokenizer).encode([r.text for r in sample])]
    try:
        return zstd.train_dictionary(size, arrays).as_bytes()
    except zstd.ZstdError:  # too few documents to train on: their bytes serve as they are
        return b"".join(arrays)[-size:] or b"\0" * 8


def write_tokens(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, keep: int = ChunkEncoder.LIMIT) -> DataFrame:
    """Encode and write ``docs`` (doc_id, text); one row per file (path, part, documents, ids).

    ``keep`` bounds the chunks whose ids a worker keeps (about 400 bytes each)."""
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    d = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    dictionary = shared_dictionary(d, tokenizer)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    dealt = d.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie")
    return materialize(dealt.mapInArrow(_writer(folder, tokenizer, dictionary, keep), FILES), "token-files")


def _reader(batches):
    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for path, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            f = TokenFile(path)
            n = len(f.index)
            crc = np.fromiter((zlib.crc32(f.ids(i)) for i in range(n)), np.int64, n)
            size = f.index["ids"].astype(np.int64)
            ids = pa.array(f.index["doc_id"].astype(np.int64), mask=f.index["null_id"].astype(bool))
            f.close()
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([part] * n, pa.int32()), pa.array(np.arange(n)), ids, pa.array(np.cumsum(size) - size), pa.array(size), pa.array(crc)], schema=schema)


def read_tokens(files: DataFrame) -> DataFrame:
    """Documents of the files with start, the ids of all documents before them.

    The running sum over files, and what is broadcast, have one row per file."""
    w = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", F.coalesce(F.sum("ids").over(w), F.lit(0)).alias("base"))
    rows = files.select("path", "part").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(_reader, ROWS)
    return rows.join(F.broadcast(bases), "part").select("path", "part", "seq", "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"))).select("doc_id", "start", "n_tokens", "ids_crc32")
