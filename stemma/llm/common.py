"""Helpers shared by the training-data operators: the shared folder, tables that
cut lineage, connected components, and small numpy kernels used inside tasks."""

from __future__ import annotations

import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the shared folder -----------------------------------------------------


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where it is unset and the session runs in one process (tests), a local
    folder takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="stemma-"))
        return _local[0]
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def new_folder(spark: SparkSession, name: str) -> str:
    MADE.append(path := f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path


class Folders(threading.local):
    """Folders made by this thread, oldest first; runs in other threads have their own."""

    def __init__(self):
        self.paths: list[str] = []

    def __iter__(self):
        return iter(self.paths)

    def append(self, path: str) -> None:
        self.paths.append(path)

    def remove(self, path: str) -> None:
        self.paths.remove(path)


#: ``drop_folders`` removes those no longer read.
MADE = Folders()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.shared_path = path
    return back


def drop_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared folder that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in MADE:
            MADE.remove(path)


def filesystem(uri: str):
    """A pyarrow filesystem and the path in it, for files that are not tables."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# --- components --------------------------------------------------------------


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: rows (node, component = smallest node).

    Alternates large-star and small-star steps. Each step keeps at most the number
    of edges that it had; minima are combined before the shuffle, and every step is
    a written table, so a lost executor costs one step. Nulls and self-links drop."""
    e = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = materialize(e, "cc")
    before = _checksum(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old, e = e, materialize(small.where("u != v").distinct(), "cc")
        drop_folders(e.sparkSession, [old.shared_path])
        after = _checksum(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _checksum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


# --- kernels -----------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit finaliser, on whole arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for reuse within a worker up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()


#: What tasks of this worker keep for one another, by name: dictionaries that may be emptied.
CACHES: dict[str, dict] = {"words": HASHES}
_last = ""


def begin_task(work: str) -> None:
    """First call of every task: workers serve many operators in turn, so what tasks of other
    work have kept is dropped, and freed memory goes back to the machine."""
    import ctypes
    import gc

    global _last
    if work != _last:
        for kept in CACHES.values():
            kept.clear()
        gc.collect()
        _last = work
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a text in UTF-8; ``lower`` folds A-Z only."""
    if not text:
        return []
    b = text.encode("utf-8", "surrogatepass")
    return (b.lower() if lower else b).split()  # bytes split at exactly the six ASCII spaces


def text_slices(texts: pa.Array, most: int = 1_000_000):
    """(begin, texts) of the parts of an array with about ``most`` bytes, one text at least.

    Tasks hold the words and hashes of one part at a time, not of a whole batch."""
    begin, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        n = n or 0
        if i > begin and held + n > most:
            yield begin, texts.slice(begin, i - begin).to_pylist()
            begin, held = i, 0
        held += n
    if len(texts):
        yield begin, texts.slice(begin).to_pylist()


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text's word hashes, in order, with repeats.

    A text of fewer words gives its whole sequence as one shingle, none gives none."""
    n = len(w)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(k, n)
    h = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        h = mix(h * _STEP + w[i : n - k + 1 + i])
    return h


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def text_key(c: str | Column) -> Column:
    """64-bit key of a text; null counts as empty."""
    return F.xxhash64(text_or_empty(c))
