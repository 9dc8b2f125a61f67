"""WARC archives compressed record by record with a dictionary inside each file.

A file starts with a skippable Zstandard frame that holds a dictionary, and every record
is a frame of its own that needs this dictionary; so any record can be read from its
offset. The dictionary is built from the first records of the file, up to SAMPLE_BYTES.

``plan_records`` decides which pages are responses and which revisit an equal payload,
``write_warc`` writes one archive per partition into the shared folder and returns the
index of records, ``read_warc`` reads archives back. A task writes under a name of its
own attempt and the index names what it wrote, so a task that runs twice does no harm.

Defined cases: a null html is an empty payload; of rows with the same largest page_id
and equal payload all are responses; a null page_id sorts below all others, and if no
page of a payload has an id, all are responses; a null url is written as an empty one;
an empty table writes no archive; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import begin_task, filesystem, materialize, new_folder, table

MIN_REVISIT_BYTES = 1000
SAMPLE_BYTES = 2_000_000
DICT_BYTES = 65_536
LEVEL = 3
#: Pages carry no time of capture; the mandatory date of their records is this unless one is given.
DATE = "1970-01-01T00:00:00Z"
#: Payloads with copies up to this many (a digest, an id and a url each) are broadcast to the pages.
BROADCAST_PAYLOADS = 300_000

#: Fixed values of the formats: Zstandard skippable frame and dictionary magic numbers.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"

INDEX = "path string, offset long, bytes long, page_id long"
RECORDS = "path string, offset long, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def plan_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages with payload_bytes, payload_digest, record_type and refers_to."""
    html = F.coalesce("html", F.lit(""))
    p = pages.select(
        F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"),
    )
    big = F.col("payload_bytes") >= min_revisit_bytes
    last = (
        p.where(big).groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("payload_digest").alias("_digest"), F.col("last.page_id").alias("response_id"), F.col("last.url").alias("response_url"))
    )
    last = materialize(last, "copied-payloads")
    if last.count() <= BROADCAST_PAYLOADS:  # so the pages' html stays where it is
        last = F.broadcast(last)
    joined = p.join(last, F.col("payload_digest") == F.col("_digest"), "left")  # equal payloads are equally long
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response_id")).alias("refers_to"),
        F.when(revisit, F.col("response_url")).alias("refers_to_url"),
    )


def record_id(place: str) -> str:
    """A record's id, from its archive and its number there: pages may share their ids."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"


def one_line(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def encode_record(page_id, url, payload: bytes, digest_hex: str, kind: str, refers_to, total: int, refers_to_url: str | None = None, place: str = "", date: str = DATE) -> bytes:
    """One WARC/1.1 record: HTTP head, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {total}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(place)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest_hex)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To-Target-URI: {one_line(refers_to_url)}",
            f"WARC-Refers-To-Date: {date}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "payload": payload if fields["WARC-Type"] == "response" else None, "payload_bytes": length,
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
        "refers_to": number("X-Refers-To-Page-ID"),
    }


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES):
    """A trained dictionary; with too few records to train on, their own bytes serve."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(size, samples)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(samples)[-size:] or b"WARC/1.1\r\n", dict_type=zstd.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes records to one open file; holds back records only until it has a dictionary."""

    def __init__(self, out):
        self.out, self.at, self.held, self.held_bytes, self.packer = out, 0, [], 0, None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _begin(self) -> list:
        import zstandard as zstd

        d = build_dictionary([raw for _, raw in self.held])
        body = d.as_bytes()
        self._put(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.packer = zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True)
        held, self.held = self.held, []
        return [self._frame(page_id, raw) for page_id, raw in held]

    def _frame(self, page_id, raw: bytes) -> tuple:
        at = self.at
        self._put(self.packer.compress(raw))
        return at, self.at - at, page_id

    def add(self, page_id, raw: bytes) -> list:
        if self.packer:
            return [self._frame(page_id, raw)]
        self.held.append((page_id, raw))
        self.held_bytes += len(raw)
        return self._begin() if self.held_bytes >= SAMPLE_BYTES else []

    def close(self) -> list:
        return [] if self.packer else self._begin()


def _writer(folder: str, date: str):
    def write(batches):
        from pyspark import TaskContext

        begin_task("archives")

        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        archive = out = None
        number = 0

        def rows(found):
            cols = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"] * len(found)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                names=["path", "offset", "bytes", "page_id"],
            )

        for batch in batches:
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}")
                archive = Archive(out)
            found = []
            for i in range(batch.num_rows):
                page_id, url, html, size, digest, kind, refers_to, refers_to_url = (c[i].as_py() for c in batch.columns)
                payload = html.encode("utf-8", "surrogatepass") if kind == "response" else b""
                found += archive.add(page_id, encode_record(page_id, url, payload, digest, kind, refers_to, size, refers_to_url, f"{folder}/{name}:{number}", date))
                number += 1
            if found:
                yield rows(found)
        if out is not None:
            found = archive.close()
            out.close()
            if found:
                yield rows(found)

    return write


def write_warc(records: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Archive planned records; returns the index (path, offset, bytes, page_id)."""
    return materialize(records.mapInArrow(_writer(folder, date), INDEX), "warc-index")


def read_archive(data, start: int = 0):
    """Records of one seekable archive, as (offset, fields), one in memory at a time."""
    import zstandard as zstd

    magic, size = struct.unpack("<II", data.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame at the start")
    body = data.read(size)
    trained = body[:4] == struct.pack("<I", 0xEC30A437)
    d = zstd.ZstdCompressionDict(body, dict_type=zstd.DICT_TYPE_FULLDICT if trained else zstd.DICT_TYPE_RAWCONTENT)
    opener = zstd.ZstdDecompressor(dict_data=d)
    at, kept = 8 + size, b""
    frame, raw, begin = opener.decompressobj(), [], at
    while True:
        chunk = kept or data.read(1 << 20)
        kept = b""
        if not chunk:
            break
        raw.append(frame.decompress(chunk))
        at += len(chunk)
        if frame.eof:
            kept = frame.unused_data
            at -= len(kept)
            yield begin, decode_record(b"".join(raw))
            frame, raw, begin = opener.decompressobj(), [], at
    if any(raw):
        raise ValueError("the archive ends inside a record")


def _reader(batches):
    names = [f.split()[0] for f in RECORDS.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in RECORDS.split(", ")])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, p = filesystem(path)
            rows, held = [], 0
            with fs.open_input_stream(p) as data:
                for offset, r in read_archive(data):
                    rows.append(r | {"path": path, "offset": offset})
                    held += r["payload_bytes"]
                    if held > 8_000_000 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist([{n: x[n] for n in names} for x in rows], schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([{n: x[n] for n in names} for x in rows], schema)


def read_warc(archives: DataFrame) -> DataFrame:
    """Records of the archives in column ``path``; a revisit has no payload of its own."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = archives.select("path").distinct().repartition(n, F.xxhash64("path"))  # a dealing of its own, so few paths still go to many tasks
    return paths.mapInArrow(_reader, RECORDS)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Plan and write; returns the index of records."""
    return write_warc(plan_records(pages), folder or new_folder(pages.sparkSession, "warc"))


def verify(payload: bytes, digest: str) -> bool:
    return hashlib.sha1(payload).hexdigest() == digest


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_pages(table(spark, sf_dir, "pages"))
    return read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last_id IS NOT NULL AND page_id IS DISTINCT FROM last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to
FROM m
"""
