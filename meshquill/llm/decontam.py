"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

A short item inside a long document has a small Jaccard similarity to it, the smaller the longer the
document; a fixed number of minima would miss it. So documents are partitioned by size: class c holds
those of up to 2**c shingles, and its signatures have 2**(c + 1) bins (one-permutation MinHash: a
shingle's hash names its bin by its top bits, and the smallest hash of a bin is kept). With bins in
proportion to size, a shingle shared with an item is its bin's minimum with a chance of at least 0.79
in any class. Each item has a signature for every class and is a candidate for a document that agrees
with it in as many bins as an eighth of its shingles (in one, below 16 shingles), so a stock phrase
that many documents share with an item doesn't make candidates of them all: of an item with 11
shingles, three quarters of which are in a document, 5 in 100,000 would be missed, of longer ones
fewer. Items of fewer than FEW distinct shingles are compared by all shingles of the documents
instead, so none of them is missed. Candidates are verified by exact containment: the share of the
item's distinct shingles, as strings, that the document has.

Words are `[^\\x20\\x09-\\x0D]+` of the lower-cased text. Edge cases: a text of fewer words than a
shingle is one shingle, the whole text: such an item is found in documents of just its words (repeated
spaces and capitals aside), never inside a longer one, as in the registered SQL; null texts and texts
without words match nothing; rows are told apart by their text, so rows with a null id are judged as
others are and reported with a null id; rows that share an id (null too) are reported once an item,
with the best containment of any of them; equal items are reported each; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshquill.llm.shared import materialise, text_rows

SPACES = "[\\x20\\x09-\\x0D]+"
BROADCAST_ROWS = 2_000_000  # of item signatures: about 64 MB; above, the join shuffles
BROADCAST_BYTES = 32 << 20  # of item texts
CLASSES = 32
FEW = 11  # items of fewer distinct shingles might have none that is its bin's minimum
SPREAD = 0x1E3779B97F4A7C15 % (1 << 58)
ALL_KEYS = f"transform(array_distinct(h), x -> x ^ {(CLASSES + 1) * SPREAD}L)"


def words(text: Column) -> Column:
    """Lower-cased words; an empty array for null or blank texts."""
    bare = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def _shingles(w: str, n: int, join: str, short: str) -> Column:
    """join of each n consecutive words of the array column w; short, of w, for 1 to n - 1 words."""
    args = ", ".join(f"{w}[i + {k}]" for k in range(n))
    many = f"transform(sequence(0, size({w}) - {n}), i -> {join.format(args)})"
    return F.expr(f"CASE WHEN size({w}) >= {n} THEN {many} WHEN size({w}) > 0 THEN array({short.format(w)}) ELSE slice(array({short.format(w)}), 1, 0) END")


def hashes(w: str, n: int) -> Column:
    return _shingles(w, n, "xxhash64({0})", "xxhash64(size({0}), concat_ws(' ', {0}))")


def strings(w: str, n: int) -> Column:
    return _shingles(w, n, "concat_ws(' ', {0})", "concat_ws(' ', {0})")


def _signed(rows: DataFrame, shingle: int) -> DataFrame:
    """id, size class and sorted hashes."""
    a = rows.select("__row", words(F.col("__text")).alias("w")).filter(F.size("w") > 0)
    b = a.select("__row", F.sort_array(hashes("w", shingle)).alias("h"))
    return b.withColumn("class", F.ceil(F.log2(F.size("h"))).cast("int"))


def _keys(all_too: bool = False) -> list[Column]:
    """A row per bin minimum m: h is sorted and a bin is the top class + 1 bits, so minima follow a change of
    bin. all_too: also one per shingle, under a class of their own."""
    shift = "63 - class"
    minima = f"filter(h, (x, i) -> i = 0 OR shiftright(x, {shift}) <> shiftright(h[greatest(i - 1, 0)], {shift}))"
    keys = f"transform({minima}, x -> x ^ (class * {SPREAD}L))"
    return [F.col("__row"), F.expr(f"explode(concat({keys}, {ALL_KEYS}))" if all_too else f"explode({keys})").alias("key")]


def _contaminated(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, shingle: int, containment: float) -> DataFrame:
    """Verified pairs of rows and items: __id, __row and __mark (hashes of the row's text), item, item_id, n_item, n_shared."""
    per_cent = round(100 * containment)
    named = items.select(F.col(f"`{item_id_col}`").alias("item_id"), F.monotonically_increasing_id().alias("__row"), F.col(f"`{item_text_col}`").cast("string").alias("__text"))
    named = materialise(named, "items")
    listed = materialise(_signed(named, shingle).select("__row", "h", F.size(F.array_distinct("h")).alias("n")), "item-hashes")
    short = F.col("n") < FEW
    every = listed.filter(~short).withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(CLASSES))))
    whole = listed.filter(short).select("__row", F.expr(f"explode({ALL_KEYS})").alias("key"))
    # agreements asked for: of short items all that containment needs, of others an eighth, one at least
    least = F.when(short, F.ceil(F.col("n") * per_cent / 100)).otherwise(F.greatest(F.lit(1), F.floor(F.col("n") / 8))).cast("long")
    signatures = every.select(*_keys()).unionByName(whole).distinct().join(listed.select("__row", least.alias("least")), "__row").select(F.col("__row").alias("item"), "key", "least")
    signatures = materialise(signatures, "item-signatures")
    few = signatures.count() <= BROADCAST_ROWS
    signatures = F.broadcast(signatures) if few else signatures
    rows = text_rows(docs, id_col, text_col).withColumn("__row", F.xxhash64("__text"))
    bins = _signed(rows, shingle).select(*_keys(all_too=not listed.filter(short).isEmpty()))
    agreed = bins.join(signatures, "key").groupBy("__row", "item").agg(F.count("*").alias("n"), F.max("least").alias("least"))
    candidates = materialise(agreed.filter("n >= least").select("__row", "item"), "candidates")
    texts = named.select(F.col("__row").alias("item"), "item_id", words(F.col("__text")).alias("w")).select("item", "item_id", F.array_distinct(strings("w", shingle)).alias("wanted"))
    texts = materialise(texts, "item-shingles")
    small = (texts.agg(F.sum(F.expr("aggregate(wanted, 0L, (a, x) -> a + octet_length(x) + 16)"))).first()[0] or 0) <= BROADCAST_BYTES
    pairs = candidates.join(F.broadcast(texts) if small else texts, "item")
    own = materialise(rows.join(candidates.select("__row").distinct(), "__row", "left_semi").select("__id", "__row", F.md5("__text").alias("__mark"), words(F.col("__text")).alias("w")).select("__id", "__row", "__mark", strings("w", shingle).alias("has")), "suspects")
    shared = F.size(F.array_intersect("wanted", "has"))
    met = pairs.join(own, "__row").select("__id", "__row", "__mark", "item", "item_id", F.size("wanted").cast("long").alias("n_item"), shared.cast("long").alias("n_shared"))
    return met.filter(F.col("n_shared") * 100 >= F.col("n_item") * per_cent)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, containment: float = 0.75) -> DataFrame:
    """Pairs with at least that containment: doc_id, item_id, n_item, n_shared, containment."""
    met = _contaminated(docs, items, id_col, text_col, item_id_col, item_text_col, shingle, containment)
    best = met.groupBy(F.col("__id").alias("doc_id"), "item", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    return best.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, containment: float = 0.75) -> DataFrame:
    """docs without the rows whose own text (as its 128-bit hash) holds an item; all columns as they are. Null
    texts stay; a null id is no reason to stay or go."""
    met = _contaminated(docs, items, id_col, text_col, item_id_col, item_text_col, shingle, containment)
    text = F.col(f"`{text_col}`").cast("string")
    found = materialise(met.select("__row", "__mark").distinct(), "contaminated")
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(text).alias("__row"), F.md5(text).alias("__mark"))
    return marked.join(found, ["__row", "__mark"], "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
