"""WARC 1.1 writer and sequential reader.

Writing: one gzip member per record. Of records with equal payloads of at least `revisit_from` bytes
the one with the largest id is a response and the others are revisits of it; smaller ones are all
responses. An archive is a run of bytes; it is kept as ordered chunks (archive, seq, data) in a table
that Spark writes, so it works in any store Spark reaches and a lost executor's part is redone;
`export_archive` writes one as a .warc.gz file.

Reading: chunks are fed one after another to an incremental zlib decompressor; a member's end is a
record's end. In a record the head ends at the first empty line, Content-Length frames the block, and
the digests named in the head are verified against what was read. Memory holds one record at a time.

What equal payloads refer to is summed up by digest without them; digests of more than HOT rows are then
joined as a broadcast of checked size, the others by a shuffle of the payloads that are large enough to
have a revisit at all. Small and null payloads, of which many are equal, are never dealt out by digest.

`read_files` reads .warc.gz files themselves, from any store pyarrow opens, a piece at a time.

Edge cases: null html is an empty payload, null url an empty target; rows whose id is null or repeated
are records of their own (a revisit refers to the largest id of its payload; of rows that share that
id, all are responses). A record that others refer to has the id <urn:page:PAGE:DIGEST>; every other
one's ends in its place in the archive too, so ids are unique but for rows that repeat page and payload.
No rows give no archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquill.llm.shared import bound_batches, materialise, new_path, partitions

ARCHIVE_BYTES, CHUNK_BYTES = 64 << 20, 1 << 20
HOT, MOST_HOT = 1_000, 500_000  # rows of a digest joined by broadcast; how many such digests may be (about 32 MB)
MOST_RECORD = 1 << 30  # bytes of a record once decompressed: beyond, the archive is refused
STAMP = "2024-01-01T00:00:00Z"
CHUNKS = "archive string, seq int, data binary"
CRLF = b"\r\n"


def _urn(page_id, digest: str, place: str = "") -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}{place and ':' + place}>"


def record(kind: str, page_id, url: str, payload: bytes, digest: str, refers_to=None, level: int = 6, place: str = "") -> bytes:
    """One gzip member. A revisit has the head of the response it stands for, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": _urn(page_id, digest, place), "WARC-Date": STAMP, "WARC-Target-URI": "".join(url.split()),
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}",
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _urn(refers_to, digest)}
    head["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + CRLF + CRLF) + z.flush()


def members(data: Iterable[bytes]) -> Iterator[bytes]:
    """The gzip members in a run of bytes given in pieces of any size."""
    z, out, size = None, [], 0
    for piece in data:
        while piece:
            if z is None:
                z, out, size = zlib.decompressobj(31), [], 0
            out.append(z.decompress(piece, MOST_RECORD + 1 - size))
            size += len(out[-1])
            if size > MOST_RECORD:
                raise ValueError(f"a record of more than {MOST_RECORD} bytes")
            piece = z.unused_data if z.eof else z.unconsumed_tail
            if z.eof:
                yield b"".join(out)
                z = None
    if z is not None:
        raise ValueError("the archive ends within a record")


def parse(member: bytes) -> dict:
    """Head fields and payload of a record, framed by its lengths and verified by its digests."""
    at = member.find(CRLF + CRLF)
    lines = member[:at].decode().split("\r\n") if at >= 0 else [""]
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record here")
    head = dict(line.split(": ", 1) for line in lines[1:])
    n = int(head["Content-Length"])
    block = member[at + 4 : at + 4 + n]
    if len(block) != n or member[at + 4 + n :] != CRLF + CRLF:
        raise ValueError(f"{head['WARC-Record-ID']}: its length is wrong")
    if "WARC-Block-Digest" in head and hashlib.sha1(block).hexdigest() != _hex(head["WARC-Block-Digest"]):
        raise ValueError(f"{head['WARC-Record-ID']}: its block's digest is wrong")
    split = block.find(CRLF + CRLF) + 4
    http = dict(x.split(": ", 1) for x in block[: split - 4].decode().split("\r\n")[1:])
    payload = block[split:]
    own = hashlib.sha1(payload).hexdigest() if head["WARC-Type"] == "response" else None
    digest = _hex(head["WARC-Payload-Digest"]) if "WARC-Payload-Digest" in head else own
    size = int(http.get("Content-Length", len(payload)))
    if own is not None and (own != digest or len(payload) != size):
        raise ValueError(f"{head['WARC-Record-ID']}: its payload's digest or length is wrong")
    return {"head": head, "payload": payload, "payload_bytes": size, "payload_digest": digest}


def _hex(named: str) -> str:
    """A sha1: digest in lower-case hex; some writers have it in base 32."""
    value = named.removeprefix("sha1:")
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


def _id(urn: str | None) -> int | None:
    """The page of a record id; null for those of other writers."""
    part = urn[len("<urn:page:") : -1].split(":")[0] if urn and urn.startswith("<urn:page:") else "none"
    return None if part == "none" else int(part)


def _write(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, seq, size, held, length, n = TaskContext.get().partitionId(), 0, 0, 0, [], 0, 0

        def chunk():
            return pa.record_batch([pa.array([f"{part:08d}-{number:05d}"]), pa.array([seq], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["archive", "seq", "data"])

        for batch in batches:
            for page_id, url, html, digest, last in zip(*(batch.column(i).to_pylist() for i in range(5))):
                payload = (html or "").encode()
                response, referred = last is None or last == page_id, last is not None and last == page_id
                data = record("response" if response else "revisit", page_id, url or "", payload, digest, None if response else last, level, "" if referred else f"{part}-{n}")
                held.append(data)
                length, n = length + len(data), n + 1
                if length >= CHUNK_BYTES:
                    yield chunk()
                    size, seq, held, length = size + length, seq + 1, [], 0
                    if size >= ARCHIVE_BYTES:
                        number, seq, size = number + 1, 0, 0
        if held:
            yield chunk()

    return run


def write_warc(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", revisit_from: int = 1000, level: int = 6) -> str:
    """Write a record per row; returns the folder with the archives' chunks."""
    spark = pages.sparkSession
    bound_batches(spark)
    path = path or new_path(spark, "warc")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{url_col}`").cast("string").alias("__url"), F.col(f"`{text_col}`").cast("string").alias("__html"))
    rows = rows.withColumn("__digest", F.sha1(F.encode(F.coalesce("__html", F.lit("")), "utf-8")))
    big = F.octet_length("__html") >= revisit_from
    # what equal payloads refer to: summed up by digest before it is dealt out, without the payloads
    equal = materialise(rows.filter(big).groupBy("__digest").agg(F.max("__id").alias("__last"), F.count("*").alias("n")).filter("n > 1 AND __last IS NOT NULL"), "equal-payloads")
    hot = equal.filter(F.col("n") > HOT).select("__digest", "__last")
    few = hot.count() <= MOST_HOT
    large, small = rows.filter(big), rows.filter(big.isNull() | ~big).withColumn("__last", F.lit(None).cast("long"))
    rest = equal.filter(F.col("n") <= HOT).select("__digest", "__last") if few else equal.select("__digest", "__last")
    if few:
        large = large.join(F.broadcast(hot.withColumnRenamed("__last", "__hot")), "__digest", "left")
        known = large.filter("__hot IS NOT NULL").withColumnRenamed("__hot", "__last")
        small = small.unionByName(known)
        large = large.filter("__hot IS NULL").drop("__hot")
    found = large.join(rest, "__digest", "left").unionByName(small)
    found.select("__id", "__url", "__html", "__digest", "__last").mapInArrow(_write(level), CHUNKS).write.option("compression", "none").parquet(path)
    return path


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def records(data: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """The responses and revisits of one archive, some megabytes at a time; other kinds of record are passed over."""
    out, size = [], 0
    for member in members(data):
        size += len(member)
        if _kind(member) in ("response", "revisit"):
            x = parse(member)
            h = x["head"]
            out.append((_id(h["WARC-Record-ID"]), h["WARC-Target-URI"], x["payload_bytes"], x["payload_digest"], h["WARC-Type"], _id(h.get("WARC-Refers-To")), x["payload"]))
        if size > CHUNK_BYTES * 4 and out:
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), _KINDS)], _NAMES)
            out, size = [], 0
    if out:
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), _KINDS)], _NAMES)


def _kind(member: bytes) -> str:
    """The record's type; one without a head is left to parse(), which refuses it."""
    head = member[: member.find(CRLF + CRLF)].decode("utf-8", "replace")
    found = [x.split(":", 1)[1].strip() for x in head.split("\r\n") if x.lower().startswith("warc-type:")]
    return found[0] if found else "response"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks come sorted by archive and seq; an archive is read to its end before the next."""
    rows = (pair for batch in batches for pair in zip(batch.column("archive").to_pylist(), batch.column("data")))
    pending = next(rows, None)
    while pending is not None:
        archive = pending[0]

        def data():
            nonlocal pending
            while pending is not None and pending[0] == archive:
                piece = pending[1].as_py()
                pending = next(rows, None)
                yield piece

        yield from records(data())


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    bound_batches(spark)
    chunks = spark.read.schema(CHUNKS).parquet(path)
    n = max(partitions(spark), chunks.select("archive").distinct().count())  # tasks of an archive or so each, at every size
    return chunks.repartition(n, "archive").sortWithinPartitions("archive", "seq").mapInArrow(_read, RECORDS)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    def pieces(uri: str) -> Iterator[bytes]:
        store, name = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(name, compression=None) as stream:
            while piece := stream.read(CHUNK_BYTES):
                yield piece

    for batch in batches:
        for uri in batch.column("path").to_pylist():
            yield from records(pieces(uri))


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows as of read_warc, from .warc.gz files (a gzip member per record). Spark lists the files, and only
    that; a task reads its files one after another. Digests must be SHA-1, in hex or base 32."""
    names = spark.read.format("binaryFile").load(paths).select("path")
    return names.repartition(max(partitions(spark), names.count()), "path").mapInArrow(_read_files, RECORDS)


def export_archive(spark: SparkSession, path: str, archive: str, to: str) -> None:
    """Write one archive as a .warc.gz file, chunk by chunk, through the driver."""
    with open(to, "wb") as out:
        for r in spark.read.schema(CHUNKS).parquet(path).filter(F.col("archive") == archive).orderBy("seq").toLocalIterator():
            out.write(r.data)
