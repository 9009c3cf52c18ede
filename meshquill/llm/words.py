"""Words of many texts at once, as numpy arrays over one byte buffer.

A word is a run of bytes other than ASCII white space, `[^\\x20\\x09-\\x0D]+`. In UTF-8 those six
byte values occur only as themselves, so splitting bytes and splitting characters agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = _rng.integers(1, 2**63, 1024, dtype=np.uint64) | np.uint64(1)
C = np.uint64(0x9E3779B97F4A7C15)
BLOCK_WORDS = 1 << 16


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hash_strings(body: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of non-empty byte strings laid end to end; a block of them at a time, for memory."""
    out = np.empty(len(length), np.uint64)
    first = np.cumsum(length) - length
    for lo in range(0, len(length), BLOCK_WORDS):
        n = length[lo : lo + BLOCK_WORDS]
        begin = first[lo : lo + BLOCK_WORDS] - first[lo]
        part = body[first[lo] : first[lo] + begin[-1] + n[-1]]
        at = np.arange(len(part), dtype=np.int32) - np.repeat(begin.astype(np.int32), n)
        at &= 1023
        value = _BYTE[part]
        value *= _POWER[at]
        out[lo : lo + BLOCK_WORDS] = np.add.reduceat(value, begin)
        out[lo : lo + BLOCK_WORDS] += n.astype(np.uint64)
    return mix(out)


def equal_ranges(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which ranges of a and of b, of that length, hold the same bytes."""
    out = np.ones(len(length), bool)
    for lo in range(0, len(length), 20_000):
        part = slice(lo, lo + 20_000)
        n = length[part]
        same = gather(a, a_at[part], n) == gather(b, b_at[part], n)
        out[part] = np.logical_and.reduceat(same, np.cumsum(n) - n)
    return out


@dataclass
class Words:
    buf: np.ndarray  # bytes of all texts
    text_at: np.ndarray  # first byte of each text, and the end
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # past its last
    word_at: np.ndarray  # first word of each text, and the end

    @property
    def n(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def text_of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.word_at) - 1), np.diff(self.word_at))

    def hashes(self, lower: bool = False) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint64)
        body = self.bytes()
        if lower:
            body = LOWER[body]
        return hash_strings(body, self.end - self.start)

    def bytes(self) -> np.ndarray:
        """All words without what parts them."""
        return self.buf[self.inside]

    @property
    def inside(self) -> np.ndarray:
        return ~SPACE[self.buf]

    def array(self, lower: bool = False) -> pa.Array:
        body = self.bytes()
        if lower:
            body = LOWER[body]
        at = np.zeros(self.n + 1, np.int32)
        np.cumsum(self.end - self.start, out=at[1:])
        return pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body))])

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """The words with one space after each, and each word's first byte there (and the end)."""
        at = np.zeros(self.n + 1, np.int64)
        np.cumsum(self.end - self.start + 1, out=at[1:])
        out = np.full(at[-1], 0x20, np.uint8)
        body = np.ones(at[-1], bool)
        body[at[1:] - 1] = False
        out[body] = self.bytes()
        return out, at


def words_of(buf: np.ndarray, text_at: np.ndarray) -> Words:
    gap = SPACE[buf]
    n = len(buf)
    first = np.ones(n + 1, bool)
    first[1:n] = gap[:-1] if n else True
    first[text_at] = True
    start = np.flatnonzero(first[:n] & ~gap)
    last = np.ones(n + 1, bool)
    last[:n] = gap
    last[text_at] = True
    end = np.flatnonzero(last[1:] & ~gap) + 1 if n else np.zeros(0, np.int64)
    return Words(buf, text_at, start, end, np.searchsorted(start, text_at))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array, and where each value begins (and the end). Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def trim() -> None:
    """Hand freed memory back, so that a Python worker between tasks is small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of batches with about `most` bytes of text at a time (a longer text comes alone, whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, at = bytes_of(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            hi = min(hi, batch.num_rows)
            yield batch.slice(lo, hi - lo), words_of(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            lo = hi
        del buf
        trim()


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words from their hashes; shorter by n - 1. Texts are not told apart."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, done, factor = None, 0, np.uint64(1)
    power, width, weight = h, 1, C
    rest = n
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                part = power[done : done + len(h) - n + 1] * factor
                out = part if out is None else out + part
                factor = factor * weight
                done += width
            rest >>= 1
            if rest:
                power = power[:-width] + power[width:] * weight
                weight = weight * weight
                width *= 2
    return mix(out)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while width * 2 <= w:
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    if width < w:
        a = np.minimum(a[: len(a) - (w - width)], a[w - width :])
    return a


def gather(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """buf[start[i] : start[i] + length[i]] one after another."""
    length = length.astype(np.int64)
    total = int(length.sum())
    kind = np.int32 if len(buf) < 2**31 and total < 2**31 else np.int64
    step = (start - (np.cumsum(length) - length)).astype(kind)
    at = np.repeat(step, length)
    at += np.arange(total, dtype=kind)
    return buf[at]


def long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
