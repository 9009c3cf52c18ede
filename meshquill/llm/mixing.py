"""Mixing sources to target weights, by fixed-length blocks.

The words of each source, its documents one after another, are packed into blocks of `block` words.
Targets share the wanted total by weight and stop at `most` times their source's size; the excess is
shared again by weight until none is above. The counts of slots per source in every output shard are a
multinomial draw from what the sources still owe, so each source's total is met exactly; shards are
drawn by halving the range of shards with a seed per half, so any task draws any shard by itself, and
neither the driver nor the number of shards limits them. A source's k-th slot is block
`permutation(k mod blocks)` of pass `k div blocks`; the permutation is a seeded four-round Feistel
network, walked until it falls inside. Slots find their blocks by a join on (source, block index). The
last slot of a source takes only the words still wanted.

Skew: a source's documents are laid out in LANES lanes by a hash of their id, each placed on its own,
so a source with a third of all rows is many groups; blocks of a source are spread by their index. What
the driver holds, and tasks are sent, is a row per source.

Edge cases: null or empty texts have size 0 and are taken 0 times; a null source is a source like
others, last in order; repeated rows are documents of their own, numbered apart; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshquill.llm.shared import materialise, partitions
from meshquill.llm.words import C, chunks, mix

WORD = r"[^\x20\x09-\x0D]+"
LANES = 1024
BLOCK = 64
SHARD_SLOTS = 65_536
BATCH_SLOTS = 1 << 18
BROADCAST_LANES = 1 << 19  # rows: about 32 MB


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of total by weight, none above most * size; the excess is shared again by weight."""
    out, free, left = np.zeros(len(sizes)), sizes > 0, float(total)
    while free.any() and left > 0:
        share = left * weights / weights[free].sum()
        over = free & (share >= most * sizes)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = most * sizes[over]
        left -= float(out[over].sum())
        free &= ~over
    return out


def permuted(k: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), at k."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    x = k.astype(np.uint64)
    out = np.arange(len(x))
    while len(out):
        y = x[out]
        left, right = y >> half, y & low
        for r in range(4):
            left, right = right, left ^ (mix(right * C, seed * 4 + r + 1) & low)
        y = (left << half) | right
        x[out] = y
        out = out[y >= n]
    return x.astype(np.int64)


def place_of(x: int, n: int, seed: int) -> int:
    """Where the permutation puts x: its inverse."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    y = np.array([x], np.uint64)
    while True:
        left, right = y >> half, y & low
        for r in reversed(range(4)):
            left, right = right ^ (mix(left * C, seed * 4 + r + 1) & low), left
        y = (left << half) | right
        if y[0] < n:
            return int(y[0])


def _taken(rng: np.random.Generator, owed: np.ndarray, room: int) -> np.ndarray:
    """room slots by a multinomial draw from what is owed, none beyond that."""
    take = np.zeros(len(owed), np.int64)
    while room > 0:
        left = owed - take
        more = np.minimum(rng.multinomial(room, left / left.sum()), left)
        take += more
        room -= int(more.sum())
    return take


class Shards:
    """The counts of slots per source in every shard: a range of shards takes its slots, its first half draws its
    own from those, the second half has the rest."""

    def __init__(self, slots: np.ndarray, seed: int, shard_slots: int):
        self.slots, self.seed, self.size, self.total = slots, seed, shard_slots, int(slots.sum())
        self.count = -(-self.total // shard_slots)
        self.known: dict[tuple[int, int], np.ndarray] = {}

    def of(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots per source in the shard, and in those before it."""
        lo, hi, own, before = 0, self.count, self.slots, np.zeros(len(self.slots), np.int64)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if (first := self.known.get((lo, hi))) is None:
                first = _taken(np.random.Generator(np.random.PCG64([self.seed, lo, hi])), own, (mid - lo) * self.size)
                if len(self.known) > 4096:
                    self.known.clear()
                self.known[lo, hi] = first
            if shard < mid:
                hi, own = mid, first
            else:
                lo, own, before = mid, own - first, before + first
        return own, before


def _slots(size: np.ndarray, owed: list[tuple[int, int]], block: int, seed: int, shards: Shards):
    """Rows of every drawn slot: shard, slot, source, block, pass and how many words it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (x for batch in batches for x in batch.column("shard").to_pylist()):
            counts, before = shards.of(shard)
            for s in np.flatnonzero(counts):
                n, first = int(counts[s]), int(before[s])
                blocks, last = -(-int(size[s]) // block), owed[s]
                for lo in range(0, n, BATCH_SLOTS):
                    slot = np.arange(lo, min(n, lo + BATCH_SLOTS))
                    k = first + slot
                    at = permuted(k % blocks, blocks, seed * 1_000_003 + int(s))
                    words = np.minimum(block, size[s] - at * block)
                    words[k == last[0]] = last[1]
                    yield pa.record_batch([pa.array(np.full(len(k), shard), pa.int64()), pa.array(slot, pa.int32()), pa.array(np.full(len(k), s), pa.int32()), pa.array(at), pa.array(k // blocks, pa.int32()), pa.array(words, pa.int32())], ["shard", "slot", "source_id", "block", "turn", "words"])

    return run


def _owed(size: int, want: int, block: int, seed: int) -> tuple[int, int]:
    """The last slot a source fills, and the words it takes there. Only its last block can be short."""
    blocks = -(-size // block)
    turns, rest = divmod(want, size)
    if not rest:
        return turns * blocks - 1, int(min(block, size - int(permuted(np.array([blocks - 1]), blocks, seed)[0]) * block))
    short = size - (blocks - 1) * block  # words of the short block
    k = -(-rest // block)  # slots, were all full
    if short < block:
        where = place_of(blocks - 1, blocks, seed)
        if where < k:
            if short + (k - 1) * block < rest:
                k += 1
            before = short + (k - 2) * block if where < k - 1 else (k - 1) * block
            return turns * blocks + k - 1, rest - before
    return turns * blocks + k - 1, rest - (k - 1) * block


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 11, shard_slots: int = SHARD_SLOTS
) -> tuple[DataFrame, DataFrame]:
    """(documents, picks). documents: a row per row of docs with doc_id, size, source_size, target, taken.
    picks: what the mix is made of, in order of shard and slot: shard, slot, turn, doc_id, first, n
    (n words of the document from word first on), with __key and __copy, which tell repeated rows apart."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("__key"), size_of(F.col(f"`{text_col}`").cast("string")).alias("size"))
    lane = F.pmod(F.xxhash64("doc_id", "__key"), F.lit(LANES)).cast("int")
    rows = materialise(rows.withColumn("lane", lane).withColumn("__copy", _copy()), "sizes")
    lanes = rows.groupBy("source", "lane").agg(F.sum("size").alias("n"))
    found = sorted(lanes.groupBy("source").agg(F.sum("n").alias("n")).collect(), key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))  # a row per source
    size = np.array([r.n for r in found], np.int64)
    cycle = np.array([weights[i % len(weights)] for i in range(len(found))], float)
    target = targets(size, cycle, total * size.sum() if len(size) else 0, most)
    want = np.floor(target + 1e-9).astype(np.int64)
    owed = [_owed(int(a), int(b), block, seed * 1_000_003 + s) if b else (-1, 0) for s, (a, b) in enumerate(zip(size, want))]
    slots = np.array([last + 1 for last, _ in owed], np.int64)
    sources = spark.createDataFrame([(s, r.source, int(r.n), float(target[s])) for s, r in enumerate(found)], "source_id int, source string, source_size long, target double")
    # where each lane, then each document, begins in its source
    w = Window.partitionBy("source").orderBy("lane")
    lanes = lanes.withColumn("begin", F.sum("n").over(w) - F.col("n"))
    w = Window.partitionBy("source", "lane").orderBy("doc_id", "__key", "__copy").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("size").over(w), F.lit(0)).alias("at")
    placed = rows.select("doc_id", "__key", "__copy", "size", "source", "lane", begin)
    few = len(found) * LANES <= BROADCAST_LANES  # LANES rows a source at most; more are joined by a shuffle
    small = F.broadcast if few else lambda x: x
    placed = placed.join(small(lanes.select(F.col("source").alias("s2"), F.col("lane").alias("l2"), "begin")), placed.source.eqNullSafe(F.col("s2")) & (placed.lane == F.col("l2")))
    placed = placed.join(small(sources.withColumnRenamed("source", "s3")), placed.source.eqNullSafe(F.col("s3")))
    placed = materialise(placed.select("doc_id", "__key", "__copy", "size", "source_id", "source_size", "target", (F.col("begin") + F.col("at")).alias("at")), "placed")
    pieces = placed.filter("size > 0").select("doc_id", "__key", "__copy", "source_id", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    lo = F.greatest("at", F.col("block") * block)
    pieces = pieces.select("doc_id", "__key", "__copy", "source_id", "block", (lo - F.col("at")).alias("first"), (lo - F.col("block") * block).cast("int").alias("skip"), (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - lo).cast("int").alias("n"))
    shards = Shards(slots, seed, shard_slots)
    drawn = spark.range(0, shards.count, 1, max(1, min(shards.count, 4 * partitions(spark)))).select(F.col("id").alias("shard"))
    drawn = drawn.mapInArrow(_slots(size, owed, block, seed, shards), "shard long, slot int, source_id int, block long, turn int, words int")
    # without the hint the few drawn rows pass for a small side, though each becomes thousands of slots
    picks = drawn.hint("shuffle_merge").join(pieces, ["source_id", "block"]).filter(F.col("words") > F.col("skip"))
    picks = picks.select("shard", "source_id", "slot", "turn", "doc_id", "__key", "__copy", "first", F.least(F.col("n"), F.col("words") - F.col("skip")).alias("n"))
    taken = picks.groupBy("doc_id", "__key", "__copy").agg(F.sum("n").alias("taken"))
    out = _with(placed, taken, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out, picks


def _copy() -> Column:
    """Numbers rows with equal doc_id and text."""
    return F.row_number().over(Window.partitionBy("doc_id", "__key").orderBy("source"))


def _with(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """a joined to b (doc_id, __key, __copy and more) by document, a null doc_id included."""
    b = b.withColumnsRenamed({"doc_id": "__d", "__key": "__k", "__copy": "__c"})
    return a.join(b, F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__copy") == F.col("__c")), how).drop("__d", "__k", "__c")


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, w in chunks(batches, "text"):
        texts, counts = [], w.counts()
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            lo, parts = w.word_at[i], []
            whole = w.buf[w.text_at[i] : w.text_at[i + 1]].tobytes()
            turns: dict[int, list[tuple[int, int]]] = {}
            for x in spans:
                turns.setdefault(x["turn"], []).append((x["first"], x["n"]))
            for _, own in sorted(turns.items()):
                if sum(n for _, n in own) == counts[i]:
                    parts.append(whole)  # a whole pass leaves the text as it is
                else:
                    parts.append(b" ".join(w.buf[w.start[k] : w.end[k]].tobytes() for a, n in sorted(own) for k in range(lo + a, lo + a + n)))
            texts.append(b"\n".join(parts).decode())
        yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def mixed_documents(docs: DataFrame, picks: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: a row per document with words taken, its text made of them, pass
    after pass (a whole pass is the text unchanged; else the taken words, single spaces); n_chars,
    where docs has it, follows."""
    spans = picks.groupBy("doc_id", "__key", "__copy").agg(F.collect_list(F.struct("turn", "first", "n")).alias("spans"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("__key"), F.col(f"`{text_col}`").cast("string").alias("text"), whole)
    rows = rows.withColumn("__copy", _copy()).withColumn("row", F.col("row").dropFields(text_col))
    kind = rows.schema["row"].dataType.simpleString()
    made = _with(rows, spans, "inner").select("row", "text", "spans").mapInArrow(_compose, f"row {kind}, text string")
    value = {text_col: F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return made.select(*(value.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
