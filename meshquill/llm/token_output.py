"""Token-id output: frequency-ranked ids in byte-aligned variable-length code, control bytes apart.

File format (a folder; every part is written by Spark, so a lost executor's part is simply redone):
  vocab/   one row per id: rank, id. Rank 0 is the id that is commonest over all documents.
  shards/  one row per shard: part, seq (their order is the order of documents), before (ids of its
           part before it), doc_ids and n_tokens of its documents, n_ids, control, data. Four ranks share a control byte, two bits each
           (bytes less one, lowest bits first); data holds the ranks' low bytes, little-endian.
           The last control byte is filled with zero ranks.
Reading looks the four lengths of every control byte up in a table of 256 rows.

Edge cases: a null or empty text gives only the end id; documents are in ascending doc_id order,
null first, repeated rows next to each other by their text's hash; no rows give no shards.

Texts are encoded word by word (ASCII white space never lies within a token of the tokenizer used,
and it is dropped; a tokenizer for which that fails is refused), each distinct word of a chunk once.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquill.llm.shared import materialise, new_path, partitions, text_rows
from meshquill.llm.words import bytes_of, chunks, equal_ranges, gather, hash_strings, trim

SHARD_IDS = 2_000_000
CHUNK = 4 << 20  # the larger, the fewer words are looked up twice; a worker holds some 20 times as much
SLICE = 20_000  # words encoded at a time
CACHE_WORDS = 1_500_000  # about 60 MB a worker
_SHIFT = np.arange(4, dtype=np.uint8) * 2
LENGTHS = (((np.arange(256)[:, None] >> _SHIFT) & 3) + 1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.zeros(-(-len(values) // 4) * 4, np.uint32)
    v[: len(values)] = values
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    control = ((n - 1).reshape(-1, 4) << _SHIFT).sum(axis=1, dtype=np.uint8)
    at = np.cumsum(n, dtype=np.int64) - n
    data = np.zeros(int(n.sum()), np.uint8)
    for k in range(4):
        some = n > k
        data[at[some] + k] = (v[some] >> np.uint32(8 * k)) & np.uint32(255)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    body = np.frombuffer(data, np.uint8)
    at = np.cumsum(length, dtype=np.int64) - length
    out = body[at].astype(np.uint32)
    for k in range(1, 4):
        some = length > k
        out[some] |= body[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out[:n]


def tokenizer_path(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(name))
    one, two, both = (tok.encode(x, add_special_tokens=False).ids for x in ("word", "x-2", "word \n x-2"))
    if one + two != both:
        raise ValueError(f"{name}: its tokens reach over white space; this operator encodes word by word")
    return tok


class Known:
    """Encoded words a Python worker keeps from task to task: a table sorted by hash, at most CACHE_WORDS long."""

    def __init__(self):
        self.hash, self.text, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.at = self.size = self.ids_at = self.n = np.zeros(0, np.int64)

    def find(self, h: np.ndarray, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each word's row, or -1; bytes decide, not hashes."""
        out = np.full(len(h), -1, np.int64)
        if len(self.hash):
            row = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            size = np.diff(at)
            hit = np.flatnonzero((self.hash[row] == h) & (self.size[row] == size))
            hit = hit[equal_ranges(self.text, body, self.at[row[hit]], at[hit], size[hit])]
            out[hit] = row[hit]
        return out

    def add(self, h: np.ndarray, body: np.ndarray, size: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        if len(self.hash) >= CACHE_WORDS:
            return
        at, ids_at = np.cumsum(size) - size + len(self.text), np.cumsum(n) - n + len(self.ids)
        self.text, self.ids = np.concatenate((self.text, body)), np.concatenate((self.ids, ids))
        h, first = np.unique(np.concatenate((self.hash, h)), return_index=True)
        self.hash = h
        for name, new in (("at", at), ("size", size), ("ids_at", ids_at), ("n", n)):
            setattr(self, name, np.concatenate((getattr(self, name), new))[first])


_known: dict[str, Known] = {}


def word_ids(words: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of words, and where each distinct word's ids begin and how many there are."""
    known = _known.setdefault(name, Known())
    body, at = bytes_of(words)
    h = hash_strings(body, np.diff(at))
    row = known.find(h, body, at)
    fresh = np.flatnonzero(row < 0)
    tok, ids, n = _tokenizer(name), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    new = words.take(pa.array(fresh))
    for lo in range(0, len(fresh), SLICE):
        got = [e.ids for e in tok.encode_batch_fast(new.slice(lo, SLICE).cast(pa.string()).to_pylist(), add_special_tokens=False)]
        n.append(np.fromiter(map(len, got), np.int64, len(got)))
        ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(n[-1].sum())))
    ids, n = np.concatenate(ids), np.concatenate(n)
    begin, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    old = np.flatnonzero(row >= 0)
    begin[old], count[old] = known.ids_at[row[old]], known.n[row[old]]
    begin[fresh], count[fresh] = np.cumsum(n) - n + len(known.ids), n
    all_ids = np.concatenate((known.ids, ids))
    size = np.diff(at)[fresh]
    known.add(h[fresh], gather(body, at[:-1][fresh], size), size, ids, n)
    return all_ids, begin, count


def encoded(w, name: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a chunk, one after another, and how many each text has."""
    if not w.n:
        per = np.zeros(len(w.word_at) - 1, np.int64)
        flat = np.zeros(0, np.uint32)
    else:
        # where the tokenizer lower-cases anyway; its special tokens, which begin so, are told by case
        lower = "Lowercase" in str(_tokenizer(name).normalizer) and b"<|" not in w.buf.tobytes()
        d = w.array(lower=lower).dictionary_encode()
        body, begin, size = word_ids(d.dictionary, name)
        code = d.indices.to_numpy()
        flat = gather(body, begin[code], size[code])
        per = np.diff(np.append(0, np.cumsum(size[code]))[w.word_at])
    if end_id is None:
        return flat, per
    out = np.empty(len(flat) + len(per), np.uint32)
    last = np.zeros(len(out), bool)
    last[np.cumsum(per + 1) - 1] = True
    out[last], out[~last] = end_id, flat
    return out, per + 1


def id_type(name: str, end_id: int | None) -> str:
    """Two bytes an id on the way to the files, where the vocabulary allows it."""
    return "<u2" if max(_tokenizer(name).get_vocab_size(), end_id or 0) < 1 << 16 else "<u4"


def _encode(name: str, end_id: int | None, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in chunks(batches, "__text", CHUNK):
            ids, per = encoded(w, name, end_id)
            ids = ids.astype(kind)
            at = np.append(0, np.cumsum(per) * ids.itemsize).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer(at), pa.py_buffer(ids)])
            yield pa.record_batch([batch.column("__id"), batch.column("__key"), pa.array(per, pa.int64()), blob], ["doc_id", "key", "n_tokens", "ids"])

    return run


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            n = np.bincount(bytes_of(batch.column("ids"))[0].view(kind), minlength=len(total))
            n[: len(total)] += total
            total = n
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    return run


def _shards(rank: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, docs, counts, held = TaskContext.get().partitionId(), 0, 0, [], [], []

        def shard():
            n = np.concatenate(counts)
            ids = np.concatenate(held)
            control, data = pack(rank[ids])
            doc = pa.concat_arrays(docs)
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.array(n, pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                ["part", "seq", "before", "doc_ids", "n_tokens", "n_ids", "control", "data"],
            )

        for batch in batches:
            per = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            blob = batch.column("ids")
            lo = 0
            while lo < batch.num_rows:
                room = SHARD_IDS - sum(map(len, held))
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(per[lo:]), room, "right")))
                docs.append(batch.column("doc_id").slice(lo, hi - lo))
                counts.append(per[lo:hi])
                held.append(bytes_of(blob.slice(lo, hi - lo))[0].view(kind).copy())
                lo = hi
                if sum(map(len, held)) >= SHARD_IDS or lo < batch.num_rows:
                    yield shard()
                    before += sum(map(len, held))
                    seq, docs, counts, held = seq + 1, [], [], []
        if docs:
            yield shard()

    return run


SHARD = "part int, seq int, before long, doc_ids array<long>, n_tokens array<long>, n_ids long, control binary, data binary"


def write_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int | None = 2) -> str:
    """Encode every whole text and write the files; returns their folder."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    rows = text_rows(docs, id_col, text_col).withColumn("__key", F.xxhash64("__text"))
    kind = id_type(tokenizer, end_id)
    ids = materialise(rows.mapInArrow(_encode(tokenizer, end_id, kind), "doc_id long, key long, n_tokens long, ids binary"), "ids")
    found = ids.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row per id of the vocabulary at most
    order = [r.id for r in sorted(found, key=lambda r: (-r.n, r.id))]
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order))
    del found
    spark.createDataFrame([(i, x) for i, x in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(f"{path}/vocab")
    ids.repartitionByRange(partitions(spark), "doc_id", "key").sortWithinPartitions("doc_id", "key").mapInArrow(_shards(rank, kind), SHARD).write.option("compression", "none").parquet(f"{path}/shards")
    trim()
    return path


def _documents(ids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n_tokens")[i].values.to_numpy(zero_copy_only=False)
                ranks = unpack(batch.column("control")[i].as_py(), batch.column("data")[i].as_py(), batch.column("n_ids")[i].as_py())
                flat = ids[ranks].astype("<u4") if len(ranks) else np.zeros(0, "<u4")
                at = np.append(0, np.cumsum(n))
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(flat)])
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.record_batch([batch.column("doc_ids")[i].values, pa.array(at[:-1] + batch.column("begin")[i].as_py(), pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), raw], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a written folder: doc_id, start, n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit)."""
    vocab = spark.read.parquet(f"{path}/vocab").orderBy("rank").collect()  # bounded by the vocabulary
    shards = spark.read.schema(SHARD).parquet(f"{path}/shards")
    sizes = sorted(shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row per part: as many as shuffle partitions
    begin, starts = 0, []
    for part, n in sizes:
        starts.append((part, begin))
        begin += n
    starts = spark.createDataFrame(starts, "part int, start long")
    return shards.join(F.broadcast(starts), "part").withColumn("begin", F.col("start") + F.col("before")).drop("start").mapInArrow(_documents(np.array([r.id for r in vocab], np.uint32)), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
