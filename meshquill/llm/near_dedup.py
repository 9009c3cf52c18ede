"""Near-duplicate documents by b-bit MinHash.

1. One pass gives each document the set of its distinct `shingle`-word shingles (64-bit hashes; ASCII
   capitals lowered), a 128-bit print of that set, its MinHash minima, BANDS keys over ROWS minima
   each, and the packed signature: the low BITS bits of every minimum, 16 lanes to a long.
2. Documents with equal prints are one class; its smallest doc_id stands for it from here on.
3. In every band bucket each member is paired with the bucket's smallest doc_id (a star, not all
   pairs). Similarity is estimated from the packed signatures: equal lanes by bit counts, corrected
   for lanes that agree by chance. Pairs that can't reach the threshold go; of each document's others
   the best is confirmed on the full sets first, then those that still join different components.
4. Buckets whose members are still in several components are searched whole, across components only,
   so no confirmed link between candidates is lost. Documents there get a second signature, one bit of
   FINE minima each, whose estimate leaves few pairs to confirm.
5. Components: every node hooks on its smallest neighbour, pointers are followed to their roots, and
   links are drawn between roots, until none is left. Every step is a written table.

Links are 100 * intersection >= 100 * similarity * union on the full sets. With 28 bands of 4 a pair
at 0.75 is a candidate but for 3 in 100,000 cases.

Skew: prints and bucket keys are summed up before they are dealt out, and the sums are written before
they are joined, so Spark splits a hot key's side of the join. Edge cases: a text of fewer words than
a shingle is one shingle; one without words (or null) links with nothing; a null doc_id is kept and
links with nothing; rows that share a doc_id are one node, linked with
whatever any of their texts is linked with; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshquill.llm.shared import materialise, text_rows
from meshquill.llm.words import C, bytes_of, chunks, long, mix, ngram_hash

BANDS, ROWS, BITS = 28, 4, 4
HASHES = BANDS * ROWS
LANES = 64 // BITS
LONGS = HASHES // LANES
FINE = 2048  # one-bit minima of the second signature
FINE_SLACK = 0.07  # close to five standard errors
SLACK = 0.25  # an estimate this far below the threshold is six standard errors away
CHUNK = 2 << 20
_rng = np.random.Generator(np.random.PCG64(97))
_A = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingle_sets(w, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets of distinct shingle hashes, sorted, one after another, and where each begins."""
    h, n = w.hashes(lower=True), w.counts()
    count = len(n)
    grams = ngram_hash(h, shingle)
    at = np.flatnonzero(np.arange(len(grams)) + shingle <= np.repeat(w.word_at[1:], n)[: len(grams)])
    text = np.repeat(np.arange(count), n)
    short = np.flatnonzero((n > 0) & (n < shingle))
    whole = np.zeros(len(short), np.uint64)
    for i, t in enumerate(short):
        whole[i] = mix(ngram_hash(h[w.word_at[t] : w.word_at[t + 1]], int(n[t])), int(n[t]))[0]
    text, value = np.concatenate((text[at], short)), np.concatenate((grams[at], whole))
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(text[order].astype(np.int32), kind="stable")]
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[new], value[new]
    return value, np.searchsorted(text, np.arange(count + 1))


def _signatures(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in chunks(batches, "__text", CHUNK):
            value, at = shingle_sets(w, shingle)
            n = np.diff(at)
            some = np.flatnonzero(n > 0)
            first = at[:-1][some]
            prints = np.zeros((2, len(n)), np.uint64)
            minima = np.zeros((HASHES, len(n)), np.uint32)
            if len(some):
                for k in range(2):
                    prints[k, some] = np.add.reduceat(mix(value, 11 + k), first)
                x = (mix(value, 5) >> np.uint64(32)).astype(np.uint32)
                y = np.empty_like(x)
                for j in range(HASHES):
                    np.multiply(x, _A[j], out=y)
                    y += _B[j]
                    minima[j, some] = np.minimum.reduceat(y, first)
            lanes = minima.astype(np.uint64) & np.uint64((1 << BITS) - 1)
            packed = np.zeros((LONGS, len(n)), np.uint64)
            for j in range(HASHES):
                packed[j // LANES] |= lanes[j] << np.uint64(BITS * (j % LANES))
            keys = np.zeros((BANDS, len(n)), np.uint64)
            for j in range(HASHES):
                keys[j // ROWS] = mix(keys[j // ROWS] * C + minima[j].astype(np.uint64), j)
            flat = pa.array(long(keys.T.ravel()))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.record_batch(
                [batch.column("__id"), pa.array(n, pa.int64()), pa.array(long(prints[0])), pa.array(long(prints[1])), *(pa.array(long(p)) for p in packed), bands],
                ["doc_id", "n_shingles", "p0", "p1", *(f"s{k}" for k in range(LONGS)), "bands"],
            )

    return run


SIGNATURES = "doc_id long, n_shingles long, p0 long, p1 long, " + ", ".join(f"s{k} long" for k in range(LONGS)) + ", bands array<long>"


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in chunks(batches, "__text", CHUNK):
            value, at = shingle_sets(w, shingle)
            blob = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(value)])
            yield pa.record_batch([batch.column("__id"), blob], ["id", "shingles"])

    return run


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng = np.random.Generator(np.random.PCG64(98))
    a, b = rng.integers(0, 2**31, FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, FINE, dtype=np.uint32)
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            buf, at = bytes_of(part.column("shingles"))
            x = (mix(buf.view(np.uint64).copy(), 6) >> np.uint64(32)).astype(np.uint32)
            first = at[:-1] // 8
            y, packed = np.empty_like(x), np.zeros((FINE // 64, part.num_rows), np.uint64)
            for j in range(FINE):
                np.multiply(x, a[j], out=y)
                y += b[j]
                bit = (np.minimum.reduceat(y, first) >> np.uint32(7)) & np.uint32(1)  # not the lowest: that is the parity of x for every j
                packed[j // 64] |= bit.astype(np.uint64) << np.uint64(j % 64)
            yield pa.record_batch([part.column("id"), *(pa.array(long(p)) for p in packed)], ["doc_id", *(f"f{k}" for k in range(FINE // 64))])


def fine_estimate(x: str, y: str) -> Column:
    """Similarity from two one-bit signatures: twice the share of equal bits, less one."""
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))) for k in range(FINE // 64)))
    return 1 - 2.0 * differ / float(FINE)


def _confirm(similarity: float):
    per_cent = round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * shared >= per_cent * (len(x) + len(y) - shared)
            mask = pa.array(good)
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def estimate(x, y) -> Column:
    """Similarity from two packed signatures: the share of equal lanes, less what agrees by chance."""
    lane = int("1" * LANES, 16)  # the lowest bit of every lane
    differ = []
    for k in range(LONGS):
        z = x(f"s{k}").bitwiseXOR(y(f"s{k}"))
        for step in (1, 2):
            z = z.bitwiseOR(F.shiftrightunsigned(z, step))
        differ.append(F.bit_count(z.bitwiseAND(F.lit(lane))))
    equal = 1 - reduce(lambda a, b: a + b, differ) / float(HASHES)
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the smallest node reachable."""
    links = materialise(links.select("a", "b"), "links")
    label = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "hooks")
        while True:
            up = root.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
            new = materialise(root.join(up, F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root"), (F.coalesce("r2", "root") != F.col("root")).alias("moved")), "hooks")
            root = new.select("node", "root")
            if new.filter("moved").isEmpty():
                break
        label = root.withColumnRenamed("root", "label") if label is None else _follow(label, root)
        links = materialise(_between(links, root), "links")
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return materialise(label, "labels")


def _follow(label: DataFrame, root: DataFrame) -> DataFrame:
    """Labels replaced by their roots; nodes known to root alone are added."""
    old = label.join(root.select(F.col("node").alias("n2"), "root"), F.col("label") == F.col("n2"), "left").select("node", F.coalesce("root", "label").alias("label"))
    return old.unionByName(root.join(label.select("node"), "node", "left_anti").withColumnRenamed("root", "label"))


def _between(links: DataFrame, root: DataFrame) -> DataFrame:
    """Links between different roots, each once, the smaller first."""
    for end in ("a", "b"):
        links = links.join(root.select(F.col("node").alias("n2"), "root"), F.col(end) == F.col("n2"), "left").select(*(F.coalesce("root", end).alias(end) if c == end else c for c in links.columns if c in ("a", "b")))
    return links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id linked), kept."""
    rows = text_rows(docs, id_col, text_col)
    signed = materialise(rows.mapInArrow(_signatures(shingle), SIGNATURES), "signatures")
    able = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    copies = materialise(able.groupBy("p0", "p1").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"), "copies")
    to = F.broadcast(copies) if copies.count() < 1 else copies
    classes = materialise(able.join(to, ["p0", "p1"], "left").withColumn("rep", F.coalesce("least", "doc_id")).select("doc_id", "rep", *(f"s{k}" for k in range(LONGS)), "bands"), "classes")
    # a doc_id that stands for its class; the star of every band bucket with two or more
    reps = classes.filter("doc_id = rep").drop("rep")
    banded = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    hubs = materialise(banded.groupBy("band", "key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("most")).filter("hub != most").drop("most"), "hubs")
    held = materialise(banded.join(hubs, ["band", "key"]).select("band", "key", "hub", "doc_id"), "buckets")
    some = materialise(held.select("doc_id").distinct(), "candidates")
    sign = materialise(reps.drop("bands").join(some, "doc_id", "left_semi"), "held")
    sets = materialise(rows.join(some.select(F.col("doc_id").alias("__id")), "__id", "left_semi").mapInArrow(_sets(shingle), "id long, shingles binary"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        return materialise(both.select("a", "b", "x", "y").mapInArrow(_confirm(similarity), "a long, b long").distinct(), "links")

    def with_estimate(pairs: DataFrame) -> DataFrame:
        x = sign.select(F.col("doc_id").alias("a"), *(F.col(f"s{k}").alias(f"x{k}") for k in range(LONGS)))
        y = sign.select(F.col("doc_id").alias("b"), *(F.col(f"s{k}").alias(f"y{k}") for k in range(LONGS)))
        both = pairs.join(x, "a").join(y, "b")
        return both.withColumn("like", estimate(lambda c: F.col("x" + c[1:]), lambda c: F.col("y" + c[1:]))).filter(F.col("like") >= similarity - SLACK).select("a", "b", "like")

    star = materialise(with_estimate(held.filter("hub != doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()), "star")
    best = star.groupBy("b").agg(F.max(F.struct("like", (-F.col("a")).alias("m"))).alias("best")).select((-F.col("best.m")).alias("a"), "b")
    # a doc_id with several prints is one node: it is linked with what stands for each of them
    standing = materialise(classes.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("most")).filter("doc_id != rep OR rep != most"), "standing")
    several = standing.filter("rep != most").select(F.col("doc_id").alias("b"))
    links = confirmed(best)
    if not several.isEmpty():
        links = links.unionByName(classes.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).filter("a != b").join(several, "b", "left_semi").select("a", "b").distinct())
    label = components(links)
    more = star.select("a", "b").join(best, ["a", "b"], "left_anti")
    label = _joined(label, confirmed(materialise(_apart(more, label), "open")))
    # buckets whose members are still apart, across components
    now = label.select(F.col("node").alias("doc_id"), "label")
    marked = materialise(held.select("band", "key", "doc_id").join(now, "doc_id", "left").select("band", "key", "doc_id", F.coalesce("label", "doc_id").alias("label")), "marked")
    split = materialise(marked.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("band", "key"), "split")
    left = materialise(marked.join(split, ["band", "key"]), "apart")
    if not left.isEmpty():
        fine = sets.join(left.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").select("id", "shingles")
        fine = materialise(fine.mapInArrow(_fine, "doc_id long, " + ", ".join(f"f{k} long" for k in range(FINE // 64))), "fine")
        left = left.join(reps.select("doc_id", "bands"), "doc_id").join(fine, "doc_id")
        x = left.select("band", "key", F.col("doc_id").alias("a"), F.col("label").alias("la"), F.col("bands").alias("xb"), *(F.col(f"f{k}").alias(f"x{k}") for k in range(FINE // 64)))
        y = left.select("band", "key", F.col("doc_id").alias("b"), F.col("label").alias("lb"), F.col("bands").alias("yb"), *(F.col(f"f{k}").alias(f"y{k}") for k in range(FINE // 64)))
        near = fine_estimate("x", "y") >= similarity - FINE_SLACK
        # a pair counts in the first bucket it shares
        first = F.when(near, ~F.exists(F.sequence(F.lit(0), x["band"]), lambda k: (k < x["band"]) & (F.col("xb")[k] == F.col("yb")[k]))).otherwise(False)
        found = x.join(y, (x["band"] == y["band"]) & (x["key"] == y["key"]) & (F.col("la") != F.col("lb")) & (F.col("a") < F.col("b")) & first).select("a", "b").distinct()
        label = _joined(label, confirmed(materialise(found.join(star.select("a", "b"), ["a", "b"], "left_anti"), "open")))
    rep = standing.select("doc_id", "rep")
    known = signed.select("doc_id", "n_shingles").join(rep, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    known = known.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left")
    component = F.coalesce("label", "rep")
    return known.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends have different labels (none: their own)."""
    la, lb = label.select(F.col("node").alias("a"), F.col("label").alias("la")), label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links."""
    if links.isEmpty():
        return label
    return materialise(_follow(label, components(_between(links, label.withColumnRenamed("label", "root"))).withColumnRenamed("label", "root")), "labels")
