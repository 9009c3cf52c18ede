"""Language identification by prediction by partial matching (PPM).

Per language a variable-order byte context tree is grown from labelled texts and then frozen. The
exact code length of a text under each language's tree decides. A word is coded byte by byte, with a
closing space, in the context of up to `order` bytes back to the space before it; a byte unknown in
its context costs that context's escape (method C: distinct / (total + distinct)) and is tried one
byte shorter, down to 8 bits flat. Contexts never reach over a word's start, so code lengths of
distinct words are computed once per chunk and summed per text.

Edge cases: null texts and texts without a letter get `und` and score 0; ties go to the language
first in code-point order; with nothing to learn from everything is `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshquill.llm.shared import text_rows
from meshquill.llm.words import LOWER, bytes_of, chunks, words_of

ORDER = 5
CHUNK = 16 << 20  # the larger, the fewer times a word is coded
SLICE = 40_000  # words coded at a time
_LETTER = re.compile(r"[^\W\d_]")
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_MARK = np.zeros(256, np.uint8)
_MARK[:] = 1  # may belong to a letter
_MARK[:128] = _ASCII[:128]


def _keys(body: np.ndarray, at: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each context length k, longest first: the places with that much context in their word,
    and the keys of context and of context with symbol. A place is a byte of a word or its end."""
    n = len(at) - 1
    size = np.diff(at) + 2  # with a space before and after
    line = np.full(int(size.sum()), 0x20, np.uint8)
    first = np.cumsum(size) - size
    inner = np.ones(len(line), bool)
    inner[first] = inner[first + size - 1] = False
    line[inner] = body
    depth = np.arange(len(line)) - np.repeat(first, size)
    wide = line.astype(np.uint64)
    for k in range(order, -1, -1):
        # a place may not look past the space before its word: fewer bytes there are an exact shorter context
        place = np.flatnonzero(depth >= max(k, 1))
        key = np.full(len(place), k + 1, np.uint64)
        for j in range(k, 0, -1):
            key = (key << np.uint64(8)) | wide[place - j]
        yield place - np.repeat(np.arange(n), size)[place] - 1, key, (key << np.uint64(8)) | wide[place]


class Trees:
    """Counts of every language's contexts and symbols, in two sorted tables, for all languages."""

    def __init__(self, langs: list[str], order: int = ORDER):
        self.langs, self.order = langs, order

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Trees:
        """texts: words of each language in turn, as one byte array with offsets."""
        seen: dict[int, list] = {}
        for i, (body, at) in enumerate(texts):
            for _, _, key in _keys(body, at, self.order):
                for k, n in zip(*np.unique(key, return_counts=True)):
                    seen.setdefault(int(k), [0] * len(self.langs))[i] = int(n)
        self.key = np.array(sorted(seen), np.uint64)
        self.n = np.array([seen[int(k)] for k in self.key], np.float32).reshape(-1, len(self.langs))
        context = self.key >> np.uint64(8)
        self.context, row = np.unique(context, return_inverse=True)
        self.total = np.zeros((len(self.context), len(self.langs)), np.float32)
        self.kinds = np.zeros_like(self.total)
        np.add.at(self.total, row, self.n)
        np.add.at(self.kinds, row, self.n > 0)
        self.row = row.astype(np.int32)
        return self

    def bits(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each word (with its closing space) in each language."""
        words, langs = len(at) - 1, len(self.langs)
        places = int(at[-1]) + words
        out, done = np.zeros((places, langs), np.float32), np.zeros((places, langs), bool)
        for place, context, key in _keys(body, at, self.order):
            open_ = ~done[place].all(axis=1)
            place, context, key = place[open_], context[open_], key[open_]
            r = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            found = self.key[r] == key
            c = self.row[r]
            lost = np.flatnonzero(~found)  # no language has the symbol here; the context may be known
            c[lost] = np.minimum(np.searchsorted(self.context, context[lost]), len(self.context) - 1)
            known = found.copy()
            known[lost] = self.context[c[lost]] == context[lost]
            place, c, r, found = place[known], c[known], r[known], found[known]
            n = self.n[r]
            n[~found] = 0
            total, kinds = self.total[c], self.kinds[c]
            live = ~done[place] & (total > 0)
            hit = live & (n > 0)
            cost = np.log2((total + kinds) / np.maximum(np.where(hit, n, kinds), 1), where=live, out=np.zeros(n.shape, np.float32))
            out[place] += cost
            done[place] |= hit
        out[~done] += 8
        size = np.diff(at) + 1
        return np.add.reduceat(out, np.cumsum(size) - size, axis=0, dtype=np.float64) if words else np.zeros((0, langs))


def _words(w) -> tuple[pa.Array, np.ndarray]:
    """The chunk's distinct words in lower case, and each word's place among them."""
    d = w.array(lower=True).dictionary_encode()
    return d.dictionary, d.indices.to_numpy()


def _predict(trees: Trees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in chunks(batches, "__text", CHUNK):
            count = len(w.word_at) - 1
            total = np.zeros((count + 1, len(trees.langs) if trees else 1))
            if w.n and trees:
                words, code = _words(w)
                body, at = bytes_of(words)
                marked = np.add.reduceat(_MARK[body], at[:-1]) > 0
                cost = np.concatenate([trees.bits(body[at[lo] : at[min(lo + SLICE, len(words))]], at[lo : lo + SLICE + 1] - at[lo]) for lo in range(0, len(words), SLICE)])
                cost[~marked] = 0  # numbers and punctuation tell nothing
                run_up = np.zeros((w.n + 1, cost.shape[1]))
                np.cumsum(cost[code], axis=0, out=run_up[1:])
                total = run_up[w.word_at[1:]] - run_up[w.word_at[:-1]]
            plain = np.append(0, np.cumsum(_ASCII[w.buf]))[w.text_at]
            letters = np.diff(plain) > 0
            high = np.append(0, np.cumsum(w.buf >= 128))[w.text_at]
            for i in np.flatnonzero(~letters & (np.diff(high) > 0)):
                letters[i] = _LETTER.search(w.buf[w.text_at[i] : w.text_at[i + 1]].tobytes().decode("utf-8", "ignore")) is not None
            best = total[:count].argmin(axis=1)
            gap = total[:count] - total[np.arange(count), best][:, None]
            share = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
            langs = [trees.langs[b] if ok and trees else "und" for b, ok in zip(best, letters)]
            score = np.where(letters, share, 0.0) if trees else np.zeros(count)
            yield pa.record_batch([batch.column("__id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def fit_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, order: int = ORDER) -> Trees | None:
    """Trees from about `per_language` texts of each language (all, where there are fewer), drawn by a
    hash of their id: the documented bound of the sample that reaches the driver."""
    rows = text_rows(labelled, id_col, text_col, F.col(f"`{lang_col}`").cast("string").alias("__lang")).filter("__lang IS NOT NULL AND __text IS NOT NULL")
    count = {r["__lang"]: r.n for r in rows.groupBy("__lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    langs = sorted(count)
    if not langs:
        return None
    unit = F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("__lang") == x, F.lit(min(1.0, per_language / count[x]))) for x in langs])
    texts: dict[str, list[str]] = {x: [] for x in langs}
    for r in rows.filter(unit < share).select("__lang", "__text").orderBy(F.xxhash64("__text")).collect():
        texts[r["__lang"]].append(r["__text"])
    found = []
    for x in langs:
        w = words_of(*bytes_of(pa.array(texts[x], pa.string())))
        a = w.array(lower=True)
        body, at = bytes_of(a)
        some = np.add.reduceat(_MARK[body], at[:-1]) > 0 if w.n else np.zeros(0, bool)
        found.append(bytes_of(a.filter(pa.array(some))))
    return Trees(langs, order).fit(found)


def identify_languages(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (the posterior share of the best language)."""
    return text_rows(docs, id_col, text_col).mapInArrow(_predict(trees), "doc_id long, lang_pred string, score double")


def crc_of_id(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
