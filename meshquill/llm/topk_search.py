"""Exact top-k inner products by a bit-sliced index.

Components become integers floor(scale * x). A block of up to BLOCK_ROWS vectors is indexed as bitmaps:
for every attribute, one bitmap per bit of its offset from the block's least value, the SLICES highest
of them only. A query's weights are made positive (a negative weight turns an attribute's bitmaps over,
which changes the score by a constant), and its weighted sum of attributes is added up by bitmap
arithmetic: each set bit of a weight adds the attribute's slices at that place, three bitmaps of one
place becoming one there and a carry. From the highest sum slice down the standard two-set walk finds
the k-th largest coarse sum. Dropped low bits can add at most the sum of the weights, so rows within
that of the k-th are the boundary; they are resolved by exact integer inner products on stored values.

A task gets the index of a block of vectors once, then the blocks of queries one after another; few
blocks are each sent to several tasks, which share the queries. Every row is indexed and the answer is
exact, so recall is 1. The best k of each block are merged by a ranked window.

Edge cases: null vectors, null ids and vectors with null or non-finite components take no part;
shorter vectors count as padded with zeros; a query's own rows (equal id) are not its candidates; ties
go to the smaller id; with fewer candidates all are returned; no rows or no queries give no rows.
Scores that might not fit in 64 bits are refused (ValueError), before any search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshquill.llm.shared import bound_batches, materialise, partitions

BLOCK_ROWS, QUERY_ROWS, SLICES = 32_768, 256, 6
BLOCK_BYTES = 32 << 20  # of a block's integers: wide vectors make shorter blocks
MOST_SCORE = 2.0**62


def _integers(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat = v.flatten()
            n = v.value_lengths().fill_null(0).to_numpy()
            of = np.repeat(np.arange(len(v)), n)
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.isin(np.arange(len(v)), of[~np.isfinite(x)]) | np.asarray(v.is_null()) | np.asarray(batch.column("id").is_null())
            with np.errstate(invalid="ignore"):
                whole = np.where(np.isfinite(x), np.floor(scale * x), 0)
                y = np.clip(whole, -(2.0**62), 2.0**62).astype("<i8")
            most = np.zeros(len(v))
            np.maximum.at(most, of, np.abs(whole))
            at = np.append(0, np.cumsum(n) * 8).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(at), pa.py_buffer(y)])
            keep = pa.array(~bad)
            yield pa.record_batch([batch.column("id").filter(keep), blob.filter(keep), pa.array(most).filter(keep)], ["id", "v", "most"])

    return run


def _matrix(blobs: list[bytes]) -> np.ndarray:
    width = max((len(b) // 8 for b in blobs), default=0)
    out = np.zeros((len(blobs), width), np.int64)
    for i, b in enumerate(blobs):
        out[i, : len(b) // 8] = np.frombuffer(b, "<i8")
    return out


class Index:
    """The bit-sliced index of one block."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.rows, self.width = values.shape
        self.least = values.min(axis=0) if self.rows else np.zeros(self.width, np.int64)
        offset = values - self.least
        self.bits = max(1, int(offset.max(initial=0)).bit_length())
        self.low = max(0, self.bits - SLICES)  # bits dropped
        self.words = -(-self.rows // 64)
        self.slices = np.zeros((self.width, self.bits - self.low, self.words), np.uint64)
        for j in range(self.bits - self.low):
            bit = ((offset >> (self.low + j)) & 1).astype(np.uint8)
            full = np.zeros((self.words * 64, self.width), np.uint8)
            full[: self.rows] = bit
            self.slices[:, j] = np.packbits(full, axis=0, bitorder="little").T.copy().view(np.uint64)
        live = np.zeros(self.words * 64, np.uint8)
        live[: self.rows] = 1
        self.live = np.packbits(live, bitorder="little").view(np.uint64)

    def sums(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices of the coarse weighted sum of every row, lowest first."""
        places: list[list[np.ndarray]] = [[] for _ in range(64)]
        for d in np.flatnonzero(q[: self.width]):
            weight = abs(int(q[d]))
            part = self.slices[d] if q[d] > 0 else ~self.slices[d]
            for i in range(weight.bit_length()):
                if weight >> i & 1:
                    for j in range(len(part)):
                        places[i + j].append(part[j])
        out = []
        for i in range(63):
            held = places[i]
            while len(held) >= 3:
                a, b, c = held.pop(), held.pop(), held.pop()
                half = a ^ b
                places[i + 1].append((a & b) | (half & c))
                held.insert(0, half ^ c)
            if len(held) == 2:
                a, b = held
                places[i + 1].append(a & b)
                held = [a ^ b]
            out.append(held[0] if held else np.zeros(self.words, np.uint64))
            if not any(places[i + 1 :]):
                break
        return out

    def top(self, q: np.ndarray, k: int, skip: np.ndarray) -> np.ndarray:
        """Rows that can be among the k best of those not in skip (row numbers)."""
        live = self.live.copy()
        for r in skip:
            live[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        if int(np.bitwise_count(live).sum()) > k:
            sums = self.sums(q)
            sure, tied, kth = np.zeros_like(live), live, 0
            for i in range(len(sums) - 1, -1, -1):  # from the most significant slice down
                ones = tied & sums[i]
                if int(np.bitwise_count(sure | ones).sum()) >= k:
                    tied, kth = ones, kth | 1 << i
                else:
                    sure, tied = sure | ones, tied & ~sums[i]
            least = max(0, kth - int(np.abs(q[: self.width]).sum()))
            above, equal = np.zeros_like(live), live
            for i in range(max(len(sums), least.bit_length()) - 1, -1, -1):
                s = sums[i] if i < len(sums) else np.zeros_like(live)
                if least >> i & 1:
                    equal = equal & s
                else:
                    above, equal = above | (equal & s), equal & ~s
            live = above | equal
        return np.flatnonzero(np.unpackbits(live.view(np.uint8), bitorder="little"))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block become one row a block."""
    now, ids, held = None, [], []

    def block():
        values = _matrix(held)
        return pa.record_batch([pa.array([now], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([values.shape[1]], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["block", "ids", "width", "data"])

    for batch in batches:
        for b, i, v in zip(batch.column("block").to_pylist(), batch.column("id").to_pylist(), batch.column("v").to_pylist()):
            if b != now and held:
                yield block()
                ids, held = [], []
            now = b
            ids.append(i)
            held.append(v)
    if held:
        yield block()


def _search(k: int):
    """Rows by (block, part, seq): a block's index, seq -1, then the queries that meet it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r]  # noqa: B023, E731
                own = np.frombuffer(get("ids").as_buffer(), "<i8")
                values = np.frombuffer(get("data").as_buffer(), "<i8").reshape(len(own), get("width").as_py())
                if get("seq").as_py() < 0:
                    ids, index = own.copy(), Index(values.copy())
                    continue
                width = min(index.width, values.shape[1])
                found = []
                for q_id, q in zip(own, values):
                    rows = index.top(q, k, np.flatnonzero(ids == q_id))
                    score = index.values[rows, :width] @ q[:width]
                    best = np.lexsort((ids[rows], -score))[:k]
                    found.append((np.full(len(best), q_id), ids[rows[best]], score[best]))
                yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], ["query_id", "vec_id", "score"])

    return run


def _blocks(rows: DataFrame, count: int) -> DataFrame:
    block = F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    return rows.withColumn("block", block).repartition(max(1, min(count, 4 * partitions(rows.sparkSession))), "block").sortWithinPartitions("block", "id").mapInArrow(_build, "block int, ids binary, width int, data binary")


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: float = 1024.0) -> DataFrame:
    """Each query's k best: query_id, rank, vec_id, score. is_query picks the queries among the rows, by their id named `id`."""
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = materialise(rows.mapInArrow(_integers(scale), "id long, v binary, most double"), "integers")
    n, q, most, size = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.coalesce(F.max("most"), F.lit(0.0)), F.coalesce(F.max(F.length("v")), F.lit(0))).first()
    if most * most * (size // 8) >= MOST_SCORE:
        raise ValueError(f"scores of up to {most * most * (size // 8):.3g} might not fit in 64 bits: take a smaller scale")
    per = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(8, size)))
    index_blocks, query_blocks = max(1, -(-n // per)), max(1, -(-q // min(QUERY_ROWS, per)))
    parts = max(1, min(query_blocks, -(-4 * partitions(vectors.sparkSession) // index_blocks)))
    rows = rows.drop("most")
    index = materialise(_blocks(rows, index_blocks), "index").withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "seq": F.lit(-1)})
    asked = materialise(_blocks(rows.filter(is_query), query_blocks), "queries").withColumnRenamed("block", "seq").withColumn("part", F.col("seq") % parts)
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1))))
    tasks = max(1, min(index_blocks * parts, 8 * partitions(vectors.sparkSession)))
    met = index.unionByName(asked).repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "seq").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
