"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words of one text. The minimiser of a window is the smallest hash
of its `m`-word pieces; consecutive windows that share it travel as one packed string (a super-k-mer)
to the bucket of that minimiser, so equal windows meet without sending every window. In a bucket the
windows are sorted by hash and neighbours are compared byte by byte, so counts are exact.

Skew: a chunk of texts sends each distinct super-k-mer once, for its smallest doc_id (the other
holders are known repeats there and then). Minimisers are counted first, over all texts, in bins whose
number follows the input's size; windows of a bin that would fill a good part of a bucket go one by one
to the bucket of their own hash instead. That part is a fixed number of windows up to some terabytes of
text; beyond, where bins are as many as a task can count, it is three bins' mean (10 million windows at
100 TB), which a task still holds.

Edge cases: null text or no words gives no windows, and 0 words; a null doc_id neither counts as a
source of repeats nor loses words; repeated rows with one doc_id don't remove each other's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshquill.llm.shared import materialise, partitions, text_rows
from meshquill.llm.words import C, chunks, equal_ranges, gather, mix, ngram_hash, sliding_min, trim, words_of

BIN_BITS, BIN_BYTES = (13, 22), 128 << 10  # bins: one per so many bytes of input, 2**13 to 2**22 of them
BUCKET_WINDOWS = 1_500_000  # aimed at; a bucket is worked through in PARTS, so this bounds packed bytes only
PARTS = 16
MOST_TASKS = 20_000  # beyond, a task works through several buckets, one at a time: a shuffle of more parts costs more than it saves
HOT_LEAST, HOT_SHARE = 2_000, 0.25  # a bin is hot beyond so many windows and that part of a bucket
CHUNK = 4 << 20
LEVEL = 6
PACKED = "bucket int, blob binary"


def _windows(w, window: int, m: int):
    """Hashes of all window starts in the chunk, their minimisers, and which starts lie within one text."""
    h = w.hashes()
    if w.n < window:
        z = np.zeros(0, np.uint64)
        return h, z, z, np.zeros(0, bool)
    small = sliding_min(ngram_hash(h, m), window - m + 1)
    last = np.repeat(w.word_at[1:], w.counts())[: len(small)]
    return h, ngram_hash(h, window), small, np.arange(len(small)) + window <= last


def _bin(minimiser: np.ndarray, bits: int) -> np.ndarray:
    return (mix(minimiser, 7) >> np.uint64(64 - bits)).astype(np.int64)


def _bits(rows: DataFrame) -> int:
    """How many bins to count minimisers in, as a power of two: more of a larger input."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(BIN_BITS[1], max(BIN_BITS[0], (size // BIN_BYTES).bit_length()))


def _count(window: int, m: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.int64)
        for batch, w in chunks(batches, "__text"):
            _, _, small, valid = _windows(w, window, m)
            np.add.at(seen, *np.unique(_bin(small[valid], bits), return_counts=True))
        some = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], ["bin", "n"])

    return run


_HEAD = (np.int64, np.int64, np.int32, np.int32, np.int32, np.uint8)  # doc, key, first word, words, bytes, part of the bucket


def _pack(*columns, text: bytes = b"") -> bytes:
    n = len(columns[0])
    columns += (np.zeros(n, np.int32),) * (len(_HEAD) - len(columns))
    body = np.array([n], np.int64).tobytes() + b"".join(x.astype(kind).tobytes() for x, kind in zip(columns, _HEAD)) + text
    return np.array([len(body)], np.int64).tobytes() + pa.Codec("zstd", LEVEL).compress(body, asbytes=True)


def _unpack(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    body = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n, at, out = int.from_bytes(body[:8], "little"), 8, []
    for kind in _HEAD:
        out.append(np.frombuffer(body, kind, n, at))
        at += n * out[-1].itemsize
    return out, np.frombuffer(body, np.uint8, offset=at)


def _send(window: int, m: int, hot: np.ndarray, buckets: int, bits: int):
    """Map side: the chunk's distinct super-k-mers by bucket, and what is known to repeat already."""
    is_hot = np.zeros(1 << bits, bool)
    is_hot[hot] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in chunks(batches, "__text", CHUNK):
            _, own, small, valid = _windows(w, window, m)
            if not valid.any():
                continue
            text = w.text_of()
            ids = batch.column("__id").to_numpy(zero_copy_only=False)
            keys = batch.column("__key").to_numpy(zero_copy_only=False)
            alone = is_hot[_bin(small, bits)]
            cut = np.ones(len(small), bool)  # a super-k-mer begins here
            cut[1:] = (small[1:] != small[:-1]) | (text[1 : len(small)] != text[: len(small) - 1]) | alone[1:]
            first = np.flatnonzero(cut & valid)
            stop = np.append(np.flatnonzero(cut | ~valid), len(small))
            n = stop[np.searchsorted(stop, first, "right")] - first  # windows in it
            buf, at = w.spaced()
            words = n + window - 1
            doc = ids[text[first]]
            lo, size = at[first], at[first + words] - at[first]
            pos = np.arange(len(small)) - np.maximum.accumulate(np.where(cut | ~valid, np.arange(len(small)), 0))
            whole = run_sums(mix(own + pos.astype(np.uint64) * C), first, n)
            order = np.lexsort((doc, n, whole))
            o_whole, o_n = whole[order], n[order]
            new = np.ones(len(order), bool)
            new[1:] = (o_whole[1:] != o_whole[:-1]) | (o_n[1:] != o_n[:-1])
            head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            again = ~new & (doc[order] > doc[head])
            a, b = order[again], head[again]
            same = (size[a] == size[b])
            same[same] = equal_ranges(buf, buf, lo[a[same]], lo[b[same]], size[a[same]])
            known = a[same]
            keep = np.ones(len(first), bool)
            keep[known] = False
            if len(known):  # neighbours become one range
                known.sort()
                joined = np.zeros(len(known), bool)
                joined[1:] = (first[known[1:]] <= first[known[:-1]] + n[known[:-1]]) & (text[first[known[1:]]] == text[first[known[:-1]]])
                head = np.flatnonzero(~joined)
                tail = np.append(head[1:], len(known)) - 1
                s, e = first[known[head]], first[known[tail]] + words[known[tail]]
                t = text[s]
                yield pa.record_batch([pa.array([int(ids[t[0]]) % buckets], pa.int32()), pa.array([b"R" + _pack(ids[t], keys[t], s - w.word_at[t], e - s)], pa.binary())], ["bucket", "blob"])
            sent = np.flatnonzero(keep)
            to = np.where(alone[first[sent]], mix(own[first[sent]], 3), mix(small[first[sent]], 5))
            part = (to >> np.uint64(48)).astype(np.uint8) % PARTS
            to %= np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            sent, to, part = sent[order], to[order], part[order]
            edge = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            edge = np.append(edge, len(to))
            t = text[first[sent]]
            doc, key, at_word = ids[t], keys[t], first[sent] - w.word_at[t]
            blobs = []
            for i in range(len(edge) - 1):
                p = slice(edge[i], edge[i + 1])
                g = sent[p]
                blobs.append(b"S" + _pack(doc[p], key[p], at_word[p], words[g], size[g], part[p], text=gather(buf, lo[g], size[g]).tobytes()))
            yield pa.record_batch([pa.array(to[edge[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def run_sums(value: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of value over first[i] : first[i] + n[i], modulo 2**64."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return total[first + n] - total[first]


def _later(doc, win, buf, at, lo, window):
    """Which windows are also in a smaller doc_id. win: hashes; lo: first words; all by rising doc."""
    order = np.argsort(win, kind="stable")
    h = win[order]
    same = h[1:] == h[:-1]
    late = np.zeros(len(win), bool)
    if not same.any():
        return late
    x, y = order[:-1][same], order[1:][same]
    a, b = at[lo[x]], at[lo[y]]
    size, other = at[lo[x] + window] - a, at[lo[y] + window] - b
    good = size == other
    good[good] = equal_ranges(buf, buf, a[good], b[good], size[good])
    new = np.append(True, ~same)
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    late[order] = doc[order] > doc[order[head]]
    if not good.all():  # two different windows with one hash: told apart by their bytes
        for g in np.unique(head[1:][same][~good]):
            n = int(np.searchsorted(h[g:], h[g], "right"))
            least: dict[bytes, int] = {}
            for i in order[g : g + n]:
                least.setdefault(buf[at[lo[i]] : at[lo[i] + window]].tobytes(), int(doc[i]))
            for i in order[g : g + n]:
                late[i] = doc[i] > least[buf[at[lo[i]] : at[lo[i] + window]].tobytes()]
    return late


def _bucket(rows: list[bytes], window: int):
    heads, texts = [], []
    for blob in rows:
        head, text = _unpack(blob[1:])
        heads.append(head), texts.append(text)
    docs, keys, start, words, size, part = (np.concatenate(x) for x in zip(*heads))
    buf = np.concatenate(texts)
    del heads, texts
    at = np.cumsum(size, dtype=np.int64) - size
    for k in range(PARTS):
        g = np.flatnonzero(part == k)
        if len(g) and (got := _part(docs[g], keys[g], start[g], words[g], gather(buf, at[g], size[g]), window)) is not None:
            yield got


def _part(docs, keys, start, words, buf, window: int):
    w = words_of(buf, np.array([0, len(buf)]))
    at = np.append(w.start, len(buf))
    begin = np.cumsum(words) - words
    win = ngram_hash(w.hashes(), window)
    n = words - window + 1
    order = np.argsort(docs, kind="stable")
    of = np.repeat(order, n[order])
    first = np.cumsum(n[order]) - n[order]
    lo = np.arange(len(of)) - np.repeat(first, n[order]) + begin[of]
    late = _later(docs[of], win[lo], buf, at, lo, window)
    if not late.any():
        return None
    other = of[1:] != of[:-1]
    s = np.flatnonzero(late & np.append(True, ~late[:-1] | other))
    e = np.flatnonzero(late & np.append(~late[1:] | other, True))
    g = of[s]
    off = start[g] - begin[g]
    return docs[g], keys[g], lo[s] + off, lo[e] + off + window


def _receive(window: int):
    def out(doc, key, s, e):
        return pa.record_batch([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["__id", "__key", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                blob = blob.as_py()
                if blob[:1] == b"R":
                    doc, key, s, n = _unpack(blob[1:])[0][:4]
                    yield out(doc, key, s, s + n)
                    continue
                if bucket != now and held:
                    for got in _bucket(held, window):
                        yield out(*got)
                    held = []
                    trim()
                now = bucket
                held.append(blob)
        if held:
            for got in _bucket(held, window):
                yield out(*got)
        del held
        trim()

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, w in chunks(batches, "__text"):
        spans = batch.column("spans")
        n = w.counts()
        gone = np.zeros(w.n + 1, np.int32)
        flat = spans.flatten()
        if len(flat):
            of = np.repeat(np.arange(batch.num_rows), spans.value_lengths().fill_null(0).to_numpy())
            np.add.at(gone, w.word_at[of] + flat.field("s").to_numpy(), 1)
            np.add.at(gone, w.word_at[of] + flat.field("e").to_numpy(), -1)
        stay = np.cumsum(gone)[:-1] == 0
        buf, at = w.spaced()
        body = np.repeat(stay, np.diff(at))
        kept = buf[body]
        size = np.zeros(w.n, np.int64)
        size[stay] = np.diff(at)[stay]
        total = np.append(0, np.cumsum(size))[w.word_at]
        drop = total[1:][np.diff(total) > 0] - 1  # the space after a text's last word
        mask = np.ones(len(kept), bool)
        mask[drop] = False
        length = np.diff(total) - (np.diff(total) > 0)
        offsets = np.append(0, np.cumsum(length)).astype(np.int32)
        text = pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept[mask]))])
        left = np.append(0, np.cumsum(stay))[w.word_at]
        removed = n - np.diff(left)
        yield pa.record_batch([batch.column("__id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), text, spans], ["doc_id", "n_words", "n_removed", "kept_text", "spans"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, m: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (kept words, single spaces) and
    spans, the word ranges [s, e) removed because a window there also starts in a smaller doc_id."""
    spark = docs.sparkSession
    rows = text_rows(docs, id_col, text_col).withColumn("__key", F.xxhash64("__text"))
    source = rows.filter("__id IS NOT NULL AND __text IS NOT NULL")
    bits = _bits(docs)
    seen = materialise(source.select("__text").mapInArrow(_count(window, m, bits), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")), "minimisers")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(2 * partitions(spark), -(-total // BUCKET_WINDOWS))
    most = max(HOT_LEAST, HOT_SHARE * total / buckets, 12 * HOT_SHARE * total / (1 << bits))
    hot = np.array([r.bin for r in seen.filter(F.col("n") > most).collect()], np.int64)  # a third of the bins at most, a few in fact
    tasks = max(partitions(spark), min(buckets, MOST_TASKS))
    spans = (
        source.mapInArrow(_send(window, m, hot, buckets, bits), PACKED)
        .repartition(tasks, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_receive(window), "__id long, __key long, s int, e int")
        .groupBy("__id", "__key")
        .agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    )
    out = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<s:int,e:int>>"
    return rows.join(spans, ["__id", "__key"], "left").select("__id", "__text", "spans").mapInArrow(_apply, out)
