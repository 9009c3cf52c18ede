"""Quality by importance resampling.

Two generative models of hashed word n-grams (one and two words, BUCKETS buckets, add-one smoothing)
are counted: one over target texts, one over all raw texts. A document's log importance weight is the
sum, over its n-grams, of log p_target - log p_raw. Gumbel top-k draws without replacement: with noise
seeded by the document, those with the highest weight plus noise are taken, as if drawn one after
another in proportion to their weights. The k-th highest key is found from a histogram of all keys and
an exact ranking of the few rows of the one bin it falls in, so nothing is sorted as a whole.

A sum grows with length: so does the evidence, and long documents are drawn, or left, more surely than
short ones; a `temperature` above 1 divides all weights. The quality reported beside it is the logistic
of the weight per n-gram, times `sharpness`, and plays no part in the draw.

Edge cases: null and empty texts have no n-gram, weight 0 and quality 0.5, and are drawn last; ties
(repeated rows) go to the smaller doc_id, then to the smaller text hash, then to the first row in the
table written on the way; a k of all rows or more takes all; no target texts leave every weight 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshquill.llm.shared import materialise, text_rows
from meshquill.llm.words import chunks, mix, ngram_hash

BUCKETS = 1 << 16
BINS = 4096
EDGE_ROWS = 10_000  # ranked one by one
BROADCAST_IDS = 2_000_000  # of target texts: about 32 MB; more are joined by a shuffle


def _features(w) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' words and word pairs, and their texts."""
    h = w.hashes()
    text = w.text_of()
    if not w.n:
        return np.zeros(0, np.int64), text
    two = ngram_hash(h, 2)
    same = text[1:] == text[:-1]
    size = np.uint64(64 - 16)
    code = np.concatenate((mix(h, 21) >> size, mix(two[same], 22) >> size)).astype(np.int64)
    return code, np.concatenate((text, text[1:][same]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw = np.zeros(BUCKETS, np.int64)
    target = np.zeros(BUCKETS, np.int64)
    for batch, w in chunks(batches, "__text"):
        code, text = _features(w)
        raw += np.bincount(code, minlength=BUCKETS)
        chosen = np.asarray(batch.column("__target"), bool)
        target += np.bincount(code[chosen[text]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.record_batch([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def _weigh(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in chunks(batches, "__text"):
            code, text = _features(w)
            count = len(w.word_at) - 1
            n = np.bincount(text, minlength=count)
            total = np.bincount(text, weights=ratio[code], minlength=count)
            yield pa.record_batch([batch.column("__id"), batch.column("__key"), pa.array(n, pa.int64()), pa.array(total, pa.float64())], ["doc_id", "key", "n_grams", "log_weight"])

    return run


def resample(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.8, temperature: float = 1.0, sharpness: float = 24.0, seed: int = 5
) -> DataFrame:
    """One row per row of docs: doc_id, n_grams, log_weight, quality (0 to 1), resample_key, kept (drawn:
    round(share * rows) of them). targets: ids of target texts. Both models are counted over all their texts."""
    wanted = targets.select(F.col(f"`{id_col}`").cast("long").alias("__id")).filter("__id IS NOT NULL").distinct().withColumn("__target", F.lit(True))
    rows = text_rows(docs, id_col, text_col).withColumn("__key", F.xxhash64("__text"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    named = rows.filter("__id IS NOT NULL").select("__id", "__text").join(wanted, "__id", "left").select("__text", F.coalesce("__target", F.lit(False)).alias("__target"))
    marked = named.unionByName(rows.filter("__id IS NULL").select("__text", F.lit(False).alias("__target")))
    counts = marked.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counts:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    if not sum(r.target for r in counts):
        ratio[:] = 0
    mean = F.when(F.col("n_grams") > 0, F.col("log_weight") / F.col("n_grams")).otherwise(F.lit(0.0))
    uniform = (F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    gumbel = -F.log(-F.log(uniform))
    weighed = rows.mapInArrow(_weigh(ratio), "doc_id long, key long, n_grams long, log_weight double")
    weighed = weighed.withColumn("quality", 1 / (1 + F.exp(-F.lit(sharpness) * mean)))
    # without n-grams: below every weight there can be
    key = F.when(F.col("n_grams") > 0, F.col("log_weight") / F.lit(float(temperature)) + gumbel).otherwise(gumbel - 1e15)
    weighed = materialise(weighed.withColumns({"resample_key": key, "row": F.monotonically_increasing_id()}), "weights")
    n = weighed.count()
    return _top(weighed, round(share * n), n)


def _top(rows: DataFrame, k: int, n: int) -> DataFrame:
    """rows with kept: the k highest resample_keys; row tells all rows apart."""
    out = ["doc_id", "n_grams", "log_weight", "quality", "resample_key"]
    if k >= n:
        return rows.select(*out, F.lit(True).alias("kept"))
    if k <= 0:
        return rows.select(*out, F.lit(False).alias("kept"))
    lo, top, above, left = _edge(rows, "resample_key", k)
    key = F.col("resample_key")
    edge, kept = (key >= lo) & (key <= top), key > top
    if left > EDGE_ROWS:  # so many rows with one key are copies of a row: the first of them, again by a histogram
        first, last, ahead, _ = _edge(rows.filter(edge).withColumn("turn", -F.col("row").cast("double")), "turn", k - above)
        turn = -F.col("row").cast("double")
        kept = kept | (edge & (turn > last))
        edge = edge & (turn >= first) & (turn <= last)
        above += ahead
    w = Window.orderBy(F.desc("resample_key"), F.asc_nulls_last("doc_id"), "key", "row")
    tail = rows.filter(edge).withColumn("kept", F.row_number().over(w) <= k - above)
    return rows.filter(~edge).withColumn("kept", kept).select(*out, "kept").unionByName(tail.select(*out, "kept"))


def _edge(rows: DataFrame, column: str, k: int) -> tuple[float, float, int, int]:
    """(lo, hi, above, n): the k-th highest is among the n rows from lo to hi, `above` are higher. n is at most
    EDGE_ROWS, unless all n are equal."""
    x = F.col(column)
    lo, hi = rows.agg(F.min(x), F.max(x)).first()
    above, left = 0, EDGE_ROWS + 1
    while lo < hi and left > EDGE_ROWS:  # a histogram of the range that holds it
        step = (hi - lo) / BINS
        found = rows.filter((x >= lo) & (x <= hi)).groupBy(F.least(F.lit(BINS - 1), F.floor((x - lo) / step)).alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()  # BINS rows at most
        for r in sorted(found, key=lambda r: -r.bin):
            if above + r.n >= k:
                break
            above += r.n
        lo, hi, left = r.lo, r.hi, r.n
    return lo, hi, above, left
