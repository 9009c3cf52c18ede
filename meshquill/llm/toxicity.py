"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel, with Nystroem landmarks.

What is judged are units: the letters of the words of a text (pieces of long ones, overlapping) and of
runs of words with at most one letter, taken together, so that spelled-out insults count. What is no
letter (signs, digits, format characters, of any number of bytes) has no place in a unit, so any number
of them between an insult's letters changes nothing. The kernel compares all subsequences of LENGTH
letters within SPAN of them, each weighing DECAY ** span, divided by a norm that depends on a unit's
length alone; inserted letters only lower a weight.
A unit's Nystroem features against m landmarks are K_mm^(-1/2) k_m(unit); a linear hinge-loss machine
on them is trained on the units of labelled sentences, multiple-instance style: every unit of a clean
text is a negative, and the units typical of toxic texts (then each toxic text's best-scoring unit)
are the positives, each also with one, two and three meaningless letters inserted. Typical is a unit with a
stem that toxic texts hold and clean ones hardly do, once or several times over (a stem made of common
syllables turns up by chance, but not thrice in a text). A text's score is a logistic function, fitted on
texts, of its highest units.

The trained machine is a weighted sum of kernels, and the kernel is an inner product of finite
feature vectors, so it folds into one table of weights by subsequence; scoring looks subsequences up
in that table and gives the same value as the sum over landmarks would.

Edge cases: null and empty texts have no unit and get the lowest score the model gives; with no
labelled text of either class every score is 0; repeated rows and ties score alike, each in its row; very
long texts are scored whole, in chunks by bytes; no rows give no rows; other columns play no part.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshquill.llm.shared import bound_batches, materialise, text_rows
from meshquill.llm.words import LOWER, bytes_of, chunks, gather, mix, trim, words_of

LENGTH, SPAN, DECAY = 4, 7, 0.7
LONGEST = 24  # characters of a unit; longer words come in pieces that overlap by half
CHUNK = 2 << 20
BITS = 5
STEMS = (5, 8)  # signs of a stem
STEM_CLEAN = 0.1  # clean texts that may hold a telling stem, for each toxic one
TIMES = (1, 2, 3)  # so many units of a text with a stem, for it to hold it
TOP, HEAT = 8, 0.7  # a text's value: HEAT times the log of the summed exponentials of its TOP highest units over HEAT
CHANCES = (1e7, 1e5, 1e3, 30, 2)  # how unlikely chance must be for a stem to tell: lowered until half of the toxic texts hold one
# 1..26 letters, 27..30 other letters by their code point, 31 a unit's start, 0 no letter (or a byte of one before its last)
_SIGN = np.zeros(256, np.uint8)
_SIGN[97:123] = np.arange(1, 27)
_INSERTED = (1, 2, 3)  # letters, in the altered positives
_PLACES = [(0, *rest) for rest in combinations(range(1, SPAN), LENGTH - 1)]


@cache
def _letters() -> np.ndarray:
    """The sign of every code point: a to z, also in styled and full-width forms, as the plain letter; other letters
    (those with accents too: they tell words apart), and marks that scripts of Asia spell with, one of four by their
    code point; 0 for all else. Accents set apart are none."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for x in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(x))
        if kind[0] == "L" or (kind in ("Mn", "Mc") and 0x900 <= x < 0x1A00):
            plain = unicodedata.normalize("NFKD", chr(x)).lower()
            out[x] = ord(plain) - 96 if len(plain) == 1 and "a" <= plain <= "z" else 27 + x % 4
    return out


def letter_signs(body: np.ndarray) -> np.ndarray:
    """For every byte of lower-cased UTF-8 its sign; a letter of several bytes has it at its last."""
    sign = _SIGN[body]
    lead = np.flatnonzero(body >= 0xC0)
    if len(lead):
        b = body[lead].astype(np.int32)
        more = 1 + (b >= 0xE0) + (b >= 0xF0)
        point = b & np.array([0, 0x1F, 0x0F, 0x07])[more]
        for k in (1, 2, 3):
            at = np.minimum(lead + k, len(body) - 1)
            point = np.where(more >= k, point << 6 | (body[at] & 0x3F), point)
        last = lead + more
        ok = (last < len(body)) & (point <= sys.maxunicode)
        sign[last[ok]] = _letters()[point[ok]]
    return sign


def units(w) -> tuple[np.ndarray, np.ndarray]:
    """Units of the chunk as rows of signs, a start mark and LONGEST more, and the text of each. Rows are
    distinct within the chunk; texts repeat."""
    if not w.n:
        return np.zeros((0, LONGEST + 1), np.uint8), np.zeros((0, 2), np.int64)
    text = w.text_of()
    size = w.end - w.start
    body = LOWER[w.bytes()]
    first = np.cumsum(size) - size
    # runs of single letters, spelled-out words, and of what has none: neighbours in body already
    one = np.add.reduceat(letter_signs(body) > 0, first, dtype=np.int64) <= 1
    edge = np.diff(np.concatenate(([0], one.astype(np.int8), [0])))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(begin):
        runs = [(a, b) for a, b in zip(begin, stop) if b - a >= 4]
        split = []
        for a, b in runs:  # a run ends with its text
            cuts = [a, *(np.flatnonzero(np.diff(text[a:b])) + a + 1), b]
            split += [(x, y) for x, y in zip(cuts[:-1], cuts[1:]) if y - x >= 4]
        ra = np.array([x for x, _ in split], np.int64)
        rb = np.array([y for _, y in split], np.int64)
    else:
        ra = rb = np.zeros(0, np.int64)
    d = w.array(lower=True).dictionary_encode()
    b2, a2 = bytes_of(d.dictionary)
    run_size = first[rb - 1] + size[rb - 1] - first[ra] if len(ra) else np.zeros(0, np.int64)
    all_body = np.concatenate((b2, gather(body, first[ra], run_size))) if len(ra) else b2
    all_size = np.concatenate((np.diff(a2), run_size))
    owner = np.concatenate((d.indices.to_numpy().astype(np.int64), len(d.dictionary) + np.arange(len(ra))))
    rows, of = signs(all_body, all_size)
    same = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LONGEST + 1), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).dictionary_encode()
    row = same.indices.to_numpy().astype(np.int64)
    distinct = np.frombuffer(same.dictionary.buffers()[1], np.uint8)[: len(same.dictionary) * (LONGEST + 1)].reshape(-1, LONGEST + 1)
    # every (text, unit) pair: texts point to words, words to their pieces
    where = np.concatenate((text, text[ra])) if len(ra) else text
    pairs = np.unique(where * (len(all_size) + 1) + owner)
    pair = np.stack((pairs // (len(all_size) + 1), pairs % (len(all_size) + 1)), 1)
    piece_at = np.searchsorted(of, np.arange(len(all_size) + 1))
    n = np.diff(piece_at)[pair[:, 1]]
    flat = np.repeat(piece_at[pair[:, 1]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    flat = np.unique(np.repeat(pair[:, 0], n) * len(distinct) + row[flat])
    return distinct, np.stack((flat // len(distinct), flat % len(distinct)), 1)


def signs(body: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of signs for byte strings laid end to end; pieces of long ones; and each row's string."""
    sign = letter_signs(body)
    own = np.repeat(np.arange(len(size)), size)
    real = sign > 0
    sign, own = sign[real], own[real]
    n = np.bincount(own, minlength=len(size)) if len(own) else np.zeros(len(size), np.int64)
    step = LONGEST // 2
    pieces = np.maximum(1, -(-(n - step) // step))
    of = np.repeat(np.arange(len(size)), pieces)
    k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (np.cumsum(n) - n)[of] + k * step
    left = np.minimum(n[of] - k * step, LONGEST)
    rows = np.zeros((len(of), LONGEST), np.uint8)
    flat = np.repeat(begin - (np.cumsum(left) - left), left) + np.arange(int(left.sum()))
    mask = np.arange(LONGEST) < left[:, None]
    rows[mask] = sign[flat]
    marked = np.zeros((len(of), LONGEST + 1), np.uint8)
    marked[:, 1:] = rows
    marked[k == 0, 0] = 31
    return marked, of


def subsequences(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(which rows, their subsequence's code, its weight) for every set of places."""
    wide = np.ascontiguousarray(rows.astype(np.int32).T)
    has = wide > 0
    for i in range(rows.shape[1] - LENGTH + 1):
        for places in _PLACES:
            if i + places[-1] >= rows.shape[1]:
                continue
            ok = has[i] & has[i + places[1]] & has[i + places[2]] & has[i + places[3]]
            some = np.flatnonzero(ok)
            if len(some):
                code = wide[i][some]
                for p in places[1:]:
                    code = (code << BITS) | wide[i + p][some]
                yield some, code, DECAY ** (places[-1] + 1 - LENGTH)


def norms(rows: np.ndarray) -> np.ndarray:
    """By the number of letters: the root of the summed squared weights of an unbroken word so long."""
    n = (rows > 0).sum(axis=1)
    table = np.ones(LONGEST + 2)
    for m in range(LENGTH, LONGEST + 2):
        table[m] = np.sqrt(sum((m - p[-1]) * DECAY ** (2 * (p[-1] + 1 - LENGTH)) for p in _PLACES if p[-1] < m))
    return table[n]


def score_units(rows: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros(len(rows))
    for lo in range(0, len(rows), 4096):
        part = rows[lo : lo + 4096]
        total = np.zeros(len(part))
        for some, code, scale in subsequences(part):
            total[some] += scale * weight[code]
        out[lo : lo + 4096] = total / norms(part)
    return out + bias


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel values, rows by landmarks, over the landmarks' own subsequences."""
    slot = np.full(1 << (BITS * LENGTH), -1, np.int32)
    parts = [(some, code, scale) for some, code, scale in subsequences(landmarks)]
    codes = np.unique(np.concatenate([c for _, c, _ in parts]))
    slot[codes] = np.arange(len(codes))
    phi = np.zeros((len(codes), len(landmarks)), np.float32)
    for some, code, scale in parts:
        np.add.at(phi, (slot[code], some), scale)
    phi /= norms(landmarks).astype(np.float32)
    out = np.zeros((len(rows), len(landmarks)), np.float32)
    for some, code, scale in subsequences(rows):
        at = slot[code]
        hit = at >= 0
        out[some[hit]] += np.float32(scale) * phi[at[hit]]
    return out / norms(rows)[:, None].astype(np.float32)


def fold(alpha: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    weight = np.zeros(1 << (BITS * LENGTH), np.float64)
    scaled = alpha / norms(landmarks)
    for some, code, scale in subsequences(landmarks):
        np.add.at(weight, code, scale * scaled[some])
    return weight


def hinge(x: np.ndarray, y: np.ndarray, share: np.ndarray, strength: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated full gradient steps. y: -1 or 1."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    v = z = np.zeros(a.shape[1])
    step = 1 / (2 * np.linalg.norm(a * np.sqrt(share)[:, None], 2) ** 2 + strength)
    t = 1.0
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (a @ z))
        new = z - step * (strength * np.append(z[:-1], 0) - 2 * a.T @ (share * y * gap))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, v, t = new + (t - 1) / t2 * (new - v), new, t2
    return v[:-1], float(v[-1])


class Machine:
    """weight by subsequence, bias, and the logistic that turns a text's highest unit into its score."""

    def __init__(self, weight=None, bias=0.0, slope=0.0, shift=0.0, landmarks=None, alpha=None):
        self.weight, self.bias, self.slope, self.shift, self.landmarks, self.alpha = weight, bias, slope, shift, landmarks, alpha

    def logistic(self, best: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return np.zeros(len(best))
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -500, 500)))

    def texts(self, w) -> np.ndarray:
        count = len(w.word_at) - 1
        if self.weight is None or not w.n:
            return pooled(np.zeros((0, 2), np.int64), np.zeros(0), count, self.bias - 1.0)
        rows, pairs = units(w)
        return pooled(pairs, score_units(rows, self.weight, self.bias), count, self.bias - 1.0)


def pooled(pairs: np.ndarray, value: np.ndarray, count: int, least: float) -> np.ndarray:
    """One value per text from its highest units: several telling ones say more than one does."""
    order = np.lexsort((-value[pairs[:, 1]], pairs[:, 0]))
    text, v = pairs[order, 0], value[pairs[order, 1]]
    first = np.searchsorted(text, np.arange(count))
    out = np.zeros(count)
    for k in range(TOP):
        at = np.minimum(first + k, max(len(text) - 1, 0))
        ok = (first + k < len(text)) & (text[at] == np.arange(count)) if len(text) else np.zeros(count, bool)
        out += np.exp(np.where(ok, v[at] if len(text) else least, least) / HEAT)
    return HEAT * np.log(out)


def _witnesses(pairs: np.ndarray, toxic: np.ndarray, value: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit of highest value in each toxic text, and of how many texts each is that."""
    own = pairs[toxic[pairs[:, 0]] & may[pairs[:, 1]]]
    order = np.lexsort((value[own[:, 1]], own[:, 0]))
    last = np.append(np.diff(own[order, 0]) > 0, True) if len(order) else np.zeros(0, bool)
    found, n = np.unique(own[order[last], 1], return_counts=True)
    return found, n.astype(np.float64)


def _all_units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct units of many texts, and which text has which; a few texts at a time, for memory."""
    number: dict[bytes, int] = {}
    pairs = []
    for lo in range(0, len(texts), 200):
        rows, own = units(words_of(*bytes_of(pa.array(texts[lo : lo + 200], pa.string()))))
        at = np.array([number.setdefault(r.tobytes(), len(number)) for r in rows], np.int64)
        both = np.unique((own[:, 0] + lo) << 32 | at[own[:, 1]]) if len(own) else np.zeros(0, np.int64)
        pairs.append(both)
    rows = np.frombuffer(b"".join(number), np.uint8).reshape(-1, LONGEST + 1)
    flat = np.concatenate(pairs)
    return rows, np.stack((flat >> 32, flat & 0xFFFFFFFF), 1)


def _distinct(pairs: np.ndarray, count: int) -> np.ndarray:
    """Which texts to learn from: of near copies (by three pairs of minima over their units) the first."""
    minima = np.full((6, count), np.iinfo(np.uint64).max, np.uint64)
    for k in range(6):
        np.minimum.at(minima[k], pairs[:, 0], mix(pairs[:, 1].astype(np.uint64), 100 + k))
    keep, seen = np.ones(count, bool), set()
    for i in range(count):
        keys = [(k, minima[k, i], minima[k + 1, i]) for k in (0, 2, 4)]
        keep[i] = not any(key in seen for key in keys)
        seen.update(keys)
    return keep


def _stems(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which rows, their stem's code) for every place."""
    for stem in STEMS:
        for i in range(rows.shape[1] - stem + 1):
            some = np.flatnonzero((rows[:, i : i + stem] > 0).all(axis=1))
            code = np.full(len(some), stem, np.int64)
            for k in range(stem):
                code = code << BITS | rows[some, i + k]
            yield some, code


def _stem_odds(rows: np.ndarray, pairs: np.ndarray, toxic: np.ndarray, n_toxic: int, n_clean: int, chance: float) -> np.ndarray:
    """For every unit how telling its best stem is (some signs in a row; stems, as units of one family are
    few each): the share of toxic texts that hold it, 0 where that may be chance. A stem tells if the
    toxic texts that hold it could be drawn so by chance less than once in `chance`, and hardly a clean one does."""
    bad = toxic[pairs[:, 0]]
    a = np.bincount(pairs[bad, 1], minlength=len(rows))
    need = np.log(chance) / np.log((n_toxic + n_clean) / max(1, n_toxic))  # toxic texts in a row
    # first stems of units of toxic texts; no text is counted more often than its units are, so what fails on those can't pass on texts
    mine = np.flatnonzero(a > 0)
    found = [(code, a[mine[some]]) for some, code in _stems(rows[mine])]
    stems, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    stems = stems[np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(stems)) >= need]
    del found, at
    out = np.zeros(len(rows))
    if not len(stems):
        return out
    ats, owners = [], []
    for some, code in _stems(rows):  # then those stems wherever they are
        at = np.minimum(np.searchsorted(stems, code), len(stems) - 1)
        hit = stems[at] == code
        ats.append(at[hit]), owners.append(some[hit])
    at, owner = np.concatenate(ats), np.concatenate(owners)
    order = np.argsort(pairs[:, 1], kind="stable")
    begin = np.searchsorted(pairs[order, 1], np.arange(len(rows) + 1))
    n = np.diff(begin)[owner]
    flat = np.repeat(begin[owner] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    held, units_held = np.unique(np.repeat(at, n) * len(toxic) + pairs[order[flat], 0], return_counts=True)
    share = np.zeros(len(stems))
    for least in TIMES:  # a stem that clean texts hold by chance may still tell where a text has several units of it
        often = units_held >= least
        which, text = held[often] // len(toxic), held[often] % len(toxic)
        a, b = np.bincount(which[toxic[text]], minlength=len(stems)), np.bincount(which[~toxic[text]], minlength=len(stems))
        share = np.maximum(share, np.where((a >= need) & (b <= STEM_CLEAN * a), a / max(1, n_toxic), 0))
    np.maximum.at(out, owner, share[at])
    return out


def _gapped(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows with one letter that means nothing inserted somewhere between theirs."""
    n = np.minimum((rows > 0).sum(axis=1), rows.shape[1] - 1)
    at = 2 + (rng.random(len(rows)) * np.maximum(n - 2, 1)).astype(int)
    place = np.arange(rows.shape[1])
    out = np.where(place < at[:, None], rows, np.roll(rows, 1, axis=1))
    out[place == at[:, None]] = rng.integers(1, 27, len(rows))
    return out


def _merged(found: tuple[np.ndarray, np.ndarray], typical: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Witnesses and typical units; a typical one weighs at least the number of toxic texts it is in."""
    both = np.union1d(found[0], typical)
    weight = np.zeros(len(both))
    weight[np.searchsorted(both, found[0])] = found[1]
    at = np.searchsorted(both, typical)
    weight[at] = np.maximum(weight[at], a[typical])
    return both, weight


def train(texts: list[str], toxic: np.ndarray, landmarks: int = 160, rounds: int = 3, most_typical: int = 600, most_negative: int = 2000, most_worst: int = 1500) -> Machine:
    """Bounds on units, beside that on texts: most_typical positives that stand for all texts with their stem,
    most_negative clean units to begin with (drawn at random), most_worst clean ones added a round."""
    if not len(texts) or toxic.all() or not toxic.any():
        return Machine()
    rows, pairs = _all_units(texts)
    if not len(rows):
        return Machine()
    long_enough = (rows > 0).sum(axis=1) >= LENGTH
    pairs = pairs[long_enough[pairs[:, 1]]]
    alone = _distinct(pairs, len(texts))
    pairs = pairs[alone[pairs[:, 0]]]
    bad = toxic[pairs[:, 0]]
    a = np.bincount(pairs[bad, 1], minlength=len(rows))
    b = np.bincount(pairs[~bad, 1], minlength=len(rows))
    for chance in CHANCES:
        share = _stem_odds(rows, pairs, toxic, int(toxic[alone].sum()), int((~toxic)[alone].sum()), chance)
        telling = (b == 0) & (share > 0)
        if len(np.unique(pairs[bad & telling[pairs[:, 1]], 0])) >= 0.5 * toxic[alone].sum():
            break
    typical = np.flatnonzero(telling)
    typical = typical[np.argsort(-share[typical], kind="stable")][:most_typical]
    # each toxic text's most telling unit stands for it, as often as it does so
    positive, weight = _merged(_witnesses(pairs, toxic, share, telling), typical, a)
    if not len(positive):
        return Machine()
    clean = np.flatnonzero(b > 0)
    rng = np.random.Generator(np.random.PCG64(7))
    negative = rng.permutation(clean)[:most_negative]
    machine = Machine()
    for turn in range(rounds):
        half = landmarks // 2
        top = positive[np.argsort(-weight, kind="stable")[:half]]
        marks = rows[np.concatenate((top, negative[:half]))]
        k = kernel(marks, marks).astype(np.float64)
        val, vec = np.linalg.eigh((k + k.T) / 2 + 1e-6 * np.eye(len(k)))
        root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-4))) @ vec.T
        gapped = [rows[positive]]
        for _ in _INSERTED:
            gapped.append(_gapped(gapped[-1], rng))
        x = kernel(np.concatenate((*gapped, rows[negative])), marks) @ root
        y = np.concatenate((np.ones(len(gapped) * len(positive)), -np.ones(len(negative))))
        altered = np.tile(0.2 / len(_INSERTED) * weight / weight.sum(), len(_INSERTED))
        part = np.concatenate((0.3 * weight / weight.sum(), altered, np.full(len(negative), 0.5 / len(negative))))
        v, bias = hinge(x, y, part)
        alpha = root @ v
        machine = Machine(fold(alpha, marks), bias, landmarks=marks, alpha=alpha)
        value = score_units(rows, machine.weight, bias)
        # the clean units that look worst become negatives, each toxic text's worst unit a positive
        worst = clean[np.argsort(-value[clean], kind="stable")][:1500]
        negative = np.unique(np.concatenate((worst, negative)))
        negative = rng.permutation(negative)
        positive, weight = _merged(_witnesses(pairs, toxic, value, telling), typical, a)
    best = pooled(pairs, value, len(texts), machine.bias - 1.0)
    best, toxic = best[alone], toxic[alone]
    if toxic.all() or not toxic.any():
        return Machine()
    p, q = np.median(best[toxic]), np.quantile(best[~toxic], 0.995)
    # logistic by Newton steps; clean texts weigh three times as much as toxic ones
    z = np.stack((best, np.ones(len(best))), 1)
    share = np.where(toxic, 0.25 / toxic.sum(), 0.75 / (~toxic).sum())
    c = np.array([1.0, -(p + q) / 2])
    for _ in range(60):
        pr = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        g = z.T @ (share * (pr - toxic)) + 1e-3 * np.array([c[0], 0])
        h = (z * (share * pr * (1 - pr))[:, None]).T @ z + np.diag([1e-3, 1e-9])
        c = c - np.linalg.solve(h, g)
    machine.slope, machine.shift = float(c[0]), float(c[1])
    low, high = np.quantile(best[toxic], 0.02), best[~toxic].max()
    if low > high:  # the classes are apart: 0.7 lies between them, so that altered insults still pass it
        at = high + 0.2 * (low - high)
        logit = lambda x: float(np.log(x / (1 - x)))
        machine.slope = (logit(0.985) - logit(0.7)) / (low - at)
        machine.shift = logit(0.7) - machine.slope * at
    return machine


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1000, most_bytes: int = 256 << 20, **bounds: int) -> Machine:
    """Train on about `per_class` labelled toxic texts and twice as many clean ones (all, where there are
    fewer), drawn by a hash of their id, and of those on as many as most_bytes of text hold, again by that hash:
    the documented bounds of the sample that reaches the driver. bounds: those of train()."""
    seen = labels.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__label")).filter("__id IS NOT NULL AND __label IN (0, 1)").groupBy("__id").agg(F.max("__label").alias("__label"))
    count = {r["__label"]: r.n for r in seen.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    unit = F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("__label") == 1, F.lit(min(1.0, per_class / count.get(1, 1)))).otherwise(F.lit(min(1.0, 2 * per_class / count.get(0, 1))))
    chosen = seen.filter(unit < share)  # about 3 * per_class rows
    rows = materialise(text_rows(docs, id_col, text_col).join(F.broadcast(chosen), "__id").select("__id", "__text", "__label", unit.alias("__unit")), "labelled")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    if size > most_bytes:  # in order of the hash, while they fit: a window over about 3 * per_class rows
        fits = F.sum(F.octet_length("__text")).over(Window.orderBy("__unit", "__id", F.xxhash64("__text"))) <= most_bytes
        rows = rows.withColumn("__fits", fits).filter("__fits")
    rows = rows.orderBy("__id", F.xxhash64("__text")).collect()
    machine = train([r["__text"] for r in rows], np.array([r["__label"] == 1 for r in rows], bool), **bounds)
    del rows
    trim()
    return machine


def _score(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in chunks(batches, "__text", CHUNK):
            score = machine.logistic(machine.texts(w))
            yield pa.record_batch([batch.column("__id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted."""
    out = text_rows(docs, id_col, text_col).mapInArrow(_score(machine), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the rows that score at least threshold; all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in chunks(batches, text_col, CHUNK):
            yield batch.filter(pa.array(machine.logistic(machine.texts(w)) < threshold))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
