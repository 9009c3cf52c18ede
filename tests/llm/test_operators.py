import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshquill.llm import decontam, langid, mixing, near_dedup, quality, shared, substring_dedup, token_output, topk_search, toxicity, warc
from meshquill.llm.words import C, bytes_of, gather, mix, ngram_hash, sliding_min, words_of
from tests.llm.conftest import BASE, OTHER, ROWS, frame, words

key = lambda r: tuple((x is not None, x) for x in r)


# Words ------------------------------------------------------------------------


def test_words_match_a_plain_split():
    texts = [t for _, t in ROWS] + ["a\x0bb\x0cc", "\x1fnot a space\x00"]
    w = words_of(*bytes_of(pa.array(texts, pa.string())))
    assert list(w.counts()) == [len(words(t)) for t in texts]
    assert [w.buf[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == [x for t in texts for x in words(t)]
    h = w.hashes()
    same = defaultdict(set)
    for x, y in zip([x for t in texts for x in words(t)], h):
        same[x].add(int(y))
    assert all(len(v) == 1 for v in same.values()) and len({min(v) for v in same.values()}) == len(same)


def test_hash_helpers():
    x = mix(np.arange(50, dtype=np.uint64))
    for n in (1, 2, 5, 13):
        want = sum((x[k : 51 - n + k] * C ** np.uint64(k) for k in range(1, n)), x[: 51 - n].copy())
        assert (ngram_hash(x, n) == mix(want)).all()
        assert (sliding_min(x, n) == [x[i : i + n].min() for i in range(51 - n)]).all()
    assert gather(np.arange(9), np.array([7, 0]), np.array([2, 3])).tolist() == [7, 8, 0, 1, 2]


def test_tables_written_on_the_way_can_be_deleted(spark, tmp_path, monkeypatch):
    assert spark.sparkContext.applicationId in shared.folder(spark)
    monkeypatch.setattr(shared, "folder", lambda spark: f"file://{tmp_path}/own")
    assert shared.materialise(spark.range(5), "numbers").count() == 5
    assert list((tmp_path / "own").iterdir())
    shared.clean(spark)
    assert not (tmp_path / "own").exists()
    shared.clean(spark)


# 1 ------------------------------------------------------------------------------


def brute_windows(rows, k=13):
    least = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - k + 1) if i is not None else ():
            g = tuple(w[a : a + k])
            least[g] = min(least.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for a in range(len(w) - k + 1) if i is not None and least[tuple(w[a : a + k])] < i for p in range(a, a + k)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=key)


@pytest.mark.parametrize("least", [None, 0])
def test_substring_dedup(docs, least, monkeypatch):
    if least is not None:  # every minimiser counts as hot: windows go by their own hash
        monkeypatch.setattr(substring_dedup, "HOT_LEAST", -1)
        monkeypatch.setattr(substring_dedup, "HOT_SHARE", 0)
    got = [tuple(r)[:4] for r in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(got, key=key) == brute_windows(ROWS)


@pytest.mark.parametrize("bits", [13, 20])
def test_boilerplate_in_every_row(spark, monkeypatch, bits):
    """One long passage in all rows: its windows are hot and go one by one."""
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", 20)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 0.001)
    monkeypatch.setattr(substring_dedup, "_bits", lambda rows: bits)
    monkeypatch.setattr(substring_dedup, "CHUNK", 4000)
    rng = np.random.default_rng(8)
    own = lambda n: " ".join(f"r{x}" for x in rng.integers(0, 300, n))
    licence = own(60)
    rows = [(int(i), f"{own(int(rng.integers(0, 40)))} {licence} {own(5)}") for i in rng.permutation(300)]
    got = [tuple(r)[:4] for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=key) == brute_windows(rows)


def test_substring_dedup_empty(none):
    assert substring_dedup.substring_dedup(none).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    """With one hash for all windows the bytes still decide."""
    text = "a b c a b d a b c".split()
    buf = np.frombuffer(" ".join(text).encode() + b" ", np.uint8)
    at = np.array([0, 2, 4, 6, 8, 10, 12, 14, 16, 18])
    doc = np.array([1, 2, 3])
    late = substring_dedup._later(doc, np.zeros(3, np.uint64), buf, at, np.array([0, 3, 6]), 3)
    assert late.tolist() == [False, False, True]


# 2 ------------------------------------------------------------------------------


def test_codec_roundtrip():
    rng = np.random.default_rng(0)
    for v in ([], [0], [1, 256, 65536, 2**32 - 1], list(range(1001)), rng.integers(0, 2**32, 999)):
        v = np.array(v, np.uint32)
        control, data = token_output.pack(v)
        assert len(control) == -(-len(v) // 4) and (token_output.unpack(control, data, len(v)) == v).all()


def test_tokens(spark, docs, monkeypatch):
    monkeypatch.setattr(token_output, "SHARD_IDS", 50)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_output.tokenizer_path("word_bpe_49k.json"))
    rows = [*ROWS, (16, "a <|endoftext|> B <|ENDOFTEXT|>")]
    got = sorted((tuple(r)[:4] for r in token_output.read_tokens(spark, token_output.write_tokens(frame(spark, rows))).collect()), key=lambda r: r[1])
    want = {}
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    start = 0
    for i, s, n, crc in got:
        assert s == start and (n, crc) == want[i]
        start += n


def test_tokens_empty(spark, none):
    assert token_output.read_tokens(spark, token_output.write_tokens(none)).count() == 0


# 3 ------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 5, 64, 65, 1000])
def test_permutation(n):
    p = mixing.permuted(np.arange(n), n, 3)
    assert sorted(p) == list(range(n)) and all(mixing.place_of(int(x), n, 3) == i for i, x in enumerate(p))


def test_targets():
    t = mixing.targets(np.array([100, 10, 50, 0]), np.array([3.0, 1, 2, 3]), 240, 2.0)
    assert t.sum() == pytest.approx(240) and (t <= 2 * np.array([100, 10, 50, 0]) + 1e-9).all() and t[1] == 20


@pytest.mark.parametrize("size", [1, 63, 64, 65, 1000, 6405])
def test_last_slot_meets_the_total(size):
    for want in {1, size // 2 or 1, size, size * 3 // 2, 2 * size}:
        k, words_ = mixing._owed(size, want, 64, 9)
        blocks = -(-size // 64)
        at = mixing.permuted(np.arange(k + 1) % blocks, blocks, 9)
        n = np.minimum(64, size - at * 64)
        assert 0 < words_ <= n[-1]
        n[-1] = words_
        assert n.sum() == want


def test_mixing(spark, docs):
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("source")))
    out, picks = mixing.mix_sources(docs)
    rows = [tuple(r) for r in out.collect()]
    assert sorted((r[0], r[1]) for r in rows if r[0] is not None) == sorted((i, len(words(t))) for i, t in ROWS if i is not None)
    assert all(r[4] <= 2 * r[1] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r[2], r[3]].append(r[4])
    assert all(abs(sum(v) - t) <= 1 for (_, t), v in by.items())
    assert sorted(rows, key=key) == sorted((tuple(r) for r in mixing.mix_sources(docs.repartition(7))[0].collect()), key=key)
    made = mixing.mixed_documents(docs, picks)
    assert made.columns == docs.columns
    total = Counter(w for _, t in ROWS for w in words(t))
    taken = Counter(w for r in made.collect() for w in words(r.text))
    assert sum(taken.values()) == sum(r[4] for r in rows) and set(taken) <= set(total)


def test_shards_are_drawn_alike_anywhere():
    slots = np.array([700, 0, 1, 5000, 333])
    every = mixing.Shards(slots, 3, 100)
    got = [every.of(i) for i in range(every.count)]
    assert (sum(c for c, _ in got) == slots).all()
    assert [int(c.sum()) for c, _ in got] == [100] * 60 + [34]
    assert all((b == sum((c for c, _ in got[:i]), np.zeros(5, int))).all() for i, (_, b) in enumerate(got))
    for i in (60, 7, 0, 31):
        own, before = mixing.Shards(slots, 3, 100).of(i)
        assert (own == got[i][0]).all() and (before == got[i][1]).all()


@pytest.mark.parametrize("shard_slots", [7, 65_536])
def test_mixing_against_a_plain_one(spark, docs, shard_slots):
    """taken of every document, from a plain walk over the permuted blocks of its source's words."""
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("source")))
    out, picks = mixing.mix_sources(docs, shard_slots=shard_slots)
    assert picks.agg(F.countDistinct("shard", "slot", "source_id")).first()[0] == picks.select("shard", "slot", "source_id").distinct().count()
    keyed = docs.select("doc_id", "source", F.xxhash64("text").alias("k"), F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(mixing.LANES)).alias("lane"), "text").collect()
    by = defaultdict(list)
    for r in keyed:
        by[r.source].append(((r.lane, r.doc_id is not None, r.doc_id or 0, r.k), len(words(r.text)), r.doc_id, r.text))
    names = sorted(by, key=lambda x: (x is None, x or ""))
    size = np.array([sum(n for _, n, _, _ in by[s]) for s in names])
    target = mixing.targets(size, np.array([(3, 1, 2)[i % 3] for i in range(len(names))], float), 1.5 * size.sum(), 2.0)
    want = Counter()
    for s, name in enumerate(names):
        line = [(i, t) for _, n, i, t in sorted(by[name], key=lambda x: x[0]) for _ in range(n)]
        left, blocks, turn = int(target[s] + 1e-9), -(-len(line) // 64), 0
        while left > 0:
            order = mixing.permuted(np.arange(blocks), blocks, 11 * 1_000_003 + s)
            for b in order:
                take = line[b * 64 : (b + 1) * 64][:left]
                want.update(take)
                left -= len(take)
    texts = Counter((i, len(words(t))) for i, t in ROWS)
    plain = defaultdict(int)
    for (i, t), n in want.items():
        plain[i, len(words(t))] += n
    have = defaultdict(int)
    for r in out.collect():
        have[r.doc_id, r["size"]] += r.taken
    assert set(have) == set(texts) and all(have[x] == plain[x] for x in have)


def test_mixing_repeated_rows_without_an_id(spark):
    docs = frame(spark, [(None, "a b c")] * 5 + [(1, "d e")] * 3 + [(None, None)] * 2)
    out, picks = mixing.mix_sources(docs)
    rows = out.collect()
    assert len(rows) == 10 and sum(r.taken for r in rows) == 31 and all(r.taken <= 2 * r["size"] for r in rows)
    assert sum(len(words(r.text)) for r in mixing.mixed_documents(docs, picks).collect()) == 31


def test_mixing_empty(none):
    out, picks = mixing.mix_sources(none)
    assert out.count() == 0 and mixing.mixed_documents(none, picks).count() == 0


# 4 ------------------------------------------------------------------------------


def test_quality(spark, docs, none):
    rng = np.random.default_rng(0)
    good, bad = [f"g{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad, 80))) for i in range(200)] + [(200, None), (201, ""), (202, " ")]
    d = frame(spark, rows)
    ids = d.filter("doc_id % 2 = 1 AND doc_id < 100")
    out = {r.doc_id: r for r in quality.resample(d, ids, share=0.45).collect()}
    assert len(out) == len(rows) and sum(r.kept for r in out.values()) == round(0.45 * len(rows))
    assert np.mean([out[i].kept for i in range(101, 200, 2)]) > 0.8 and np.mean([out[i].kept for i in range(100, 200, 2)]) < 0.05
    assert not out[200].kept and out[201].n_grams == 0
    assert quality.resample(docs, docs.filter("doc_id < 5")).count() == len(ROWS)
    assert quality.resample(none, none).count() == 0
    flat = quality.resample(docs, none, share=1.0).collect()
    assert all(r.kept and r.log_weight == 0 for r in flat)


def test_weights_and_draw_against_plain_ones(spark):
    """log_weight is the sum of log ratios of both counted models; the draw is by it plus the noise."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice([f"w{n}" for n in range(30)], int(rng.integers(1, 40))))) for i in range(60)] + [(60, None), (None, "w1 w2")]
    out = quality.resample(frame(spark, rows), frame(spark, rows).filter("doc_id < 20"), share=0.5).collect()

    def grams(t):
        w = words_of(*bytes_of(pa.array([t or ""])))
        return quality._features(w)[0].tolist()

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i is not None and i < 20:
            target.update(grams(t))
    total = quality.BUCKETS + sum(raw.values()), quality.BUCKETS + sum(target.values())
    weight = lambda t: sum(math.log((1 + target[g]) / total[1]) - math.log((1 + raw[g]) / total[0]) for g in grams(t))
    want = {(i, len(grams(t))): weight(t) for i, t in rows}
    assert all(r.log_weight == pytest.approx(want[r.doc_id, r.n_grams], abs=1e-9) for r in out) and len(out) == len(rows)
    noise = [r.resample_key - r.log_weight for r in out if r.n_grams]
    assert -3 < min(noise) and abs(np.mean(noise) - 0.5772) < 0.6
    best = sorted(out, key=lambda r: -r.resample_key)[:31]
    assert {(r.doc_id, r.n_grams) for r in out if r.kept} == {(r.doc_id, r.n_grams) for r in best}


def test_many_equal_rows_at_the_edge(spark, monkeypatch):
    monkeypatch.setattr(quality, "EDGE_ROWS", 5)
    docs = frame(spark, [(None, "")] * 200 + [(i, "some words here") for i in range(10)])
    got = quality.resample(docs, docs.filter("doc_id < 3"), share=0.5).collect()
    assert len(got) == 210 and sum(r.kept for r in got) == 105 and all(r.kept for r in got if r.doc_id is not None)


def test_top_is_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "EDGE_ROWS", 3)
    monkeypatch.setattr(quality, "BINS", 4)
    rows = spark.range(200).selectExpr("id as doc_id", "1L as key", "1L as n_grams", "0d as log_weight", "0d as quality", "id as row", "cast(id * 37 % 50 as double) as resample_key")
    got = {r.doc_id for r in quality._top(rows, 61, 200).filter("kept").collect()}
    want = {i for i, _ in sorted(((i, i * 37 % 50) for i in range(200)), key=lambda x: (-x[1], x[0]))[:61]}
    assert got == want


# 5 ------------------------------------------------------------------------------


def sets_of(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[a : a + 5]) for a in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(rows):
    s = {}
    for i, t in rows:
        s[i] = sets_of(t)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in s if i is not None)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return s, find


def test_near_dedup(docs, none):
    s, find = brute_components(ROWS)
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(docs).collect()), key=key)
    assert got == sorted(((i, len(s[i]), find(i) if i is not None else None, i is None or find(i) == i) for i, _ in ROWS), key=key)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_chains_and_borders(spark):
    """Chains of near copies, where ends don't resemble each other, and similarities about the threshold."""
    rng = np.random.default_rng(5)
    rows, base = [], [f"v{i}" for i in range(60)]
    for c in range(6):
        w = [f"c{c}{x}" for x in base]
        for n in range(8):
            rows.append((len(rows), " ".join(w)))
            for _ in range(int(rng.integers(1, 3))):
                w[int(rng.integers(60))] = f"n{len(rows)}x{int(rng.integers(9))}"
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), t) for i, t in rows]
    s, find = brute_components(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: find(i) for i in s}


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 9), (5, 6), (7, 6), (10, 4), (4, 3)]
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 1, 4: 1, 5: 5, 6: 5, 7: 5}


def test_near_dedup_texts_that_share_a_doc_id(spark):
    from corpus_pipeline import near_dedup as stage

    long = lambda c, **other: " ".join(other.get(f"w{n}", f"{c}{n}") for n in range(60))
    a, b, c, d = (long(x) for x in "abcd")
    rows = [(1, a), (2, b), (5, a), (5, b)]  # copies of two others
    rows += [(11, c), (15, c), (15, d), (17, long("d", w59="other"))]  # a copy of one, near another
    rows += [(20, long("e")), (20, long("e")), (20, long("f")), (21, long("e")), (30, None), (30, None), (None, a), (None, a)]
    docs = frame(spark, rows)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id not in (None, 30)} == {(1, 1), (2, 1), (5, 1), (11, 11), (15, 11), (17, 11), (20, 20), (21, 20)}
    assert all(r.kept == (r.doc_id in (None, 1, 11, 20, 30)) for r in got)
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns
    want = [(1, a), (11, c), (20, long("e")), (20, long("f")), (30, None), (None, a), (None, a)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key)


# 6 ------------------------------------------------------------------------------


def test_topk(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.2, (400, 16)).astype(np.float32)
    v[50:80] = v[50]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(400, None), (401, [float("nan")] * 16), (402, [1.0, None] + [0.0] * 14), (None, [1.0] * 16), (500, [0.1] * 8), (501, [])]
    d = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, id int, block int")
    got = defaultdict(list)
    for r in topk_search.search(d, F.col("id") % 50 == 0, k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    ok = {i: np.pad(np.floor(1024 * np.array(x, np.float64)), (0, 16 - len(x))).astype(int) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()}
    assert set(got) == {i for i in ok if i % 50 == 0}
    for q, have in got.items():
        want = sorted(((int(ok[q] @ ok[i]), i) for i in ok if i != q), key=lambda x: (-x[0], x[1]))[:7]
        assert have == want


def test_topk_few_rows(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, -1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.search(d, F.col("id") == 0).collect()] == [(0, 1, 1, 1024 * 512)]
    assert topk_search.search(d.limit(0), F.col("id") == 0).count() == 0


def test_topk_refuses_what_could_overflow(spark):
    d = spark.createDataFrame([(0, [1e15, 1.0]), (1, [2e15, 0.5])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk_search.search(d, F.col("id") == 0)


def test_topk_repeated_ids_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 4)
    rng = np.random.default_rng(5)
    v = [(int(i) // 2, [float(x) for x in rng.normal(size=5)]) for i in range(200)]  # every id twice
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    whole = [(i, np.floor(1024 * np.array(x)).astype(int)) for i, x in v]
    got = defaultdict(list)
    for r in topk_search.search(d, F.col("id") % 10 == 0, k=3).collect():
        got[r.query_id].append((r.score, r.vec_id))
    for q in range(0, 100, 10):
        every = [(int(a @ b), j) for i, a in whole if i == q for j, b in whole if j != q]
        assert sorted(got[q], key=lambda x: (-x[0], x[1])) == sorted(every, key=lambda x: (-x[0], x[1]))[:3]


# 7 ------------------------------------------------------------------------------


def test_folded_machine_equals_the_kernel_sum():
    texts = ["you idiot", "total moron here", "such a nice day", "what a fine morning", "an idiot again", "the weather is fine"] * 2
    toxic = np.array([True, True, False, False, True, False] * 2)
    m = toxicity.train(texts, toxic, landmarks=8, rounds=2)
    w = words_of(*bytes_of(pa.array(["some idiotic words", "ü x " + "long" * 20])))
    rows, _ = toxicity.units(w)
    want = toxicity.kernel(rows, m.landmarks).astype(float) @ m.alpha + m.bias
    assert toxicity.score_units(rows, m.weight, m.bias) == pytest.approx(want, abs=1e-4)


def test_kernel_against_a_plain_one():
    from itertools import combinations

    w = words_of(*bytes_of(pa.array(["banana", "ban-ana", "bandana", "xyz"])))
    rows, pairs = toxicity.units(w)

    def phi(r):
        out = Counter()
        for at in combinations(range(len(r)), toxicity.LENGTH):
            if at[-1] - at[0] < toxicity.SPAN and all(r[p] for p in at):
                out[tuple(int(r[p]) for p in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1 - toxicity.LENGTH)
        return out

    n = toxicity.norms(rows)
    want = [[sum(v * phi(b)[k] for k, v in phi(a).items()) / n[i] / n[j] for j, b in enumerate(rows)] for i, a in enumerate(rows)]
    assert toxicity.kernel(rows, rows) == pytest.approx(np.array(want), rel=1e-4)


def test_insertions_into_an_insult():
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeiourstnlm"), 6)) for _ in range(300)]
    insults = ["idiot", "scumbag", "moron"]
    texts = [" ".join([*rng.choice(plain, 30), *([insults[i // 4 % 3]] if i % 4 == 0 else [])]) for i in range(240)]
    m = toxicity.train(texts, np.arange(240) % 4 == 0)

    def found(altered):
        w = words_of(*bytes_of(pa.array([" ".join([*rng.choice(plain, 30), x]) for x in altered])))
        return (m.logistic(m.texts(w)) >= 0.7).mean()

    for x in ("-", ".", "7", "\u2022", "\u2019", "\u200b", "\u0301", "\U0001f600"):  # one to four bytes
        assert found([w[:2] + x + w[2:] for w in insults]) == found([w[:2] + x + w[2] + x + w[3:] for w in insults]) == 1
        assert found([x.join(w) for w in insults]) == found([(x + x).join(w) for w in insults]) == found([f" {x} ".join(w) for w in insults]) == 1
    assert found([w[:k] + "x" + w[k:] for w in insults for k in range(1, len(w))]) >= 0.8
    assert found([x.join(w) for w in ("garden", "winter", "b\u00fccher") for x in ("-", "\u2022")]) == 0
    # letters of several bytes count once each, and rows are distinct
    rows, pairs = toxicity.units(words_of(*bytes_of(pa.array(["\u00e4\u4e2d\u0915x", "idiot, id\u2022iot! Idiot", "\u2022 -- 12"]))))
    assert sorted((rows > 0).sum(axis=1)) == [1, 5, 6] and sorted(pairs[:, 0]) == [0, 1, 2]


def test_toxicity(spark, none):
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeiourstnlm"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(240):
        t = list(rng.choice(plain, 40))
        if i % 4 == 0:
            t[int(rng.integers(40))] = ["idiot", "scumbag", "Moron!"][i // 4 % 3]
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(300, None), (301, ""), (302, "w i t h  l i n e"), (303, "an i d i o t here")]
    d, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.fit_toxicity(d, lab.filter("doc_id < 160"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, m).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].predicted, y) for i, y in labels if i >= 160]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert got[300].score == got[301].score == min(r.score for r in got.values())
    assert got[303].predicted == 1 and got[302].predicted == 0
    kept = toxicity.drop_toxic(d, m)
    assert kept.columns == d.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if not r.predicted}
    # a very long text, repeated rows, null ids
    long = " ".join(rng.choice(plain, 60_000))
    odd = frame(spark, [(1, long), (2, long + " idiot"), (3, "an idiot"), (3, "an idiot"), (None, "an idiot"), (None, None)])
    have = [(r.doc_id, r.score, r.predicted) for r in toxicity.score_toxicity(odd, m).collect()]
    assert len(have) == 6 and len({s for i, s, _ in have if i == 3}) == 1 and all(p == 1 for i, _, p in have if i == 3)
    assert [s for i, s, _ in have if i == 2] > [s for i, s, _ in have if i == 1]
    small = toxicity.fit_toxicity(d, lab.filter("doc_id < 160"), per_class=20, most_bytes=6000, most_typical=10, most_negative=50, most_worst=20)
    assert toxicity.score_toxicity(d, small).count() == len(rows)
    nothing = toxicity.fit_toxicity(d, lab.limit(0))
    assert {r.score for r in toxicity.score_toxicity(d, nothing).collect()} == {0.0}
    assert toxicity.score_toxicity(none, m).count() == 0


# 8 ------------------------------------------------------------------------------


def test_code_lengths_are_exact():
    w = words_of(*bytes_of(pa.array(["the cat sat on the mat", "der hund"])))
    t = langid.Trees(["a", "b"], 3).fit([bytes_of(pa.array([b"the", b"cat", b"then"], pa.binary())), bytes_of(pa.array([b"der", b"hund"], pa.binary()))])
    known = [{int(k): c[i] for k, c in zip(t.key, t.n) if c[i]} for i in range(2)]

    def code(word, counts):
        s, total = b" " + word + b" ", 0.0
        for i in range(1, len(s)):
            for k in range(min(i, 3), -1, -1):
                c = k + 1
                for x in s[i - k : i]:
                    c = c << 8 | x
                here = {key & 255: n for key, n in counts.items() if key >> 8 == c}
                if not here:
                    continue
                n, d = sum(here.values()), len(here)
                if s[i] in here:
                    total += np.log2((n + d) / here[s[i]])
                    break
                total += np.log2((n + d) / d)
            else:
                total += 8
        return total

    a = w.array()
    got = t.bits(*bytes_of(a))
    assert got == pytest.approx(np.array([[code(x, k) for k in known] for x in a.to_pylist()]), rel=1e-5)


def test_languages(spark, none):
    en, de = "the weather in this town is very fine and warm today".split(), "das wetter in dieser stadt ist heute sehr schön und warm".split()
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(en if i % 2 else de, 12)), "en" if i % 2 else "de") for i in range(100)]
    rows += [(200, None, None), (201, "123 456 ...", "en"), (202, "…", None), (203, "schönes wetter", None), (204, "日本", None), (205, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    t = langid.fit_languages(d.filter("doc_id < 60"))
    got = {r.doc_id: r for r in langid.identify_languages(d, t).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[60:100])
    assert [got[i].lang_pred for i in (200, 201, 202, 205)] == ["und"] * 4 and got[203].lang_pred == "de" and got[204].lang_pred in ("de", "en")
    assert all(0 <= r.score <= 1 for r in got.values())
    # repeated rows, null ids, a very long text, ties: one text, one answer
    odd = frame(spark, [(1, rows[60][1]), (1, rows[60][1]), (None, rows[60][1]), (2, rows[61][1] * 2000), (3, "zz"), (4, "zz")])
    have = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify_languages(odd, t).collect()]
    assert len(have) == 6 and len({x[1:] for x in have if x[0] in (1, None)}) == 1 and len({x[1:] for x in have if x[0] in (3, 4)}) == 1
    assert [x[1] for x in have if x[0] == 2] == [rows[61][2]]
    assert langid.fit_languages(d.limit(0)) is None
    assert {r.lang_pred for r in langid.identify_languages(d, None).collect()} == {"und"}
    assert langid.identify_languages(none, t).count() == 0


# 9 ------------------------------------------------------------------------------


def test_contamination(spark, docs, none):
    items = [(1, OTHER), (2, BASE), (3, "short text"), (4, None), (5, "not to be found anywhere in there at all"), (6, BASE), (7, " ".join(BASE.split()[:12] + ["x", "y", "z"])), (8, "")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, class int")
    low = lambda t: sets_of((t or "").lower())
    want = set()
    for i, t in ROWS:
        for j, q in items:
            a, b = low(q), low(t)
            if a and 100 * len(a & b) >= 75 * len(a):
                want.add((i, j, len(a), len(a & b)))
    got = [tuple(r)[:4] for r in decontam.find_contamination(docs, bench).collect()]
    assert set(got) == want and len(got) == len(want) and any(g[0] is None for g in got)
    kept = decontam.drop_contaminated(docs, bench)
    hit = {t for i, t in ROWS for _, q in items if low(q) and 100 * len(low(q) & low(t)) >= 75 * len(low(q))}
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(((i, t) for i, t in ROWS if t not in hit), key=key)
    assert decontam.find_contamination(none, bench).count() == 0 and decontam.find_contamination(docs, bench.limit(0)).count() == 0


def test_short_items_in_long_documents(spark):
    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"q{i}_{n}" for n in range(15))) for i in range(40)]
    docs = []
    for i, t in items:
        for long in (20, 300, 9000):
            w = [f"r{x}" for x in rng.integers(0, 5000, long)]
            at = int(rng.integers(long))
            docs.append((len(docs), " ".join([*w[:at], *t.upper().split(), *w[at:]])))
    got = {(r.doc_id, r.item_id) for r in decontam.find_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(3 * i + n, i) for i in range(40) for n in range(3)}


def test_contaminated_rows_without_an_id(spark):
    """A null id is judged by its own text: two contaminated rows, a clean one."""
    item = " ".join(f"q{n}" for n in range(30))
    docs = frame(spark, [(None, item), (1, item), (None, "nothing of the kind is in here at all"), (1, "clean words of one with the same id")])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(((r.doc_id, r.item_id) for r in decontam.find_contamination(docs, bench).collect()), key=key) == [(None, 7), (1, 7)]
    assert sorted(r.text.split()[0] for r in decontam.drop_contaminated(docs, bench).collect()) == ["clean", "nothing"]


def test_a_stock_phrase_makes_no_candidates(spark):
    """Items that share five words with every document are not candidates for all of them, and none that counts is lost."""
    stock = "all rights reserved by the"
    items = [(i, " ".join([*(f"q{i}_{n}" for n in range(20)), stock])) for i in range(30)]
    docs = [(i, " ".join([*(f"r{i}_{n}" for n in range(60)), stock, *(items[i][1].split() if i < 5 else [])])) for i in range(300)]
    got = {(r.doc_id, r.item_id) for r in decontam.find_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(5)}


def test_items_of_few_shingles(spark):
    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"q{i}_{n}" for n in range(3 + i % 12))) for i in range(240)]  # 3 to 14 words
    docs = []
    for i, t in items:
        w = [f"r{x}" for x in rng.integers(0, 5000, 400)]
        docs.append((i, " ".join([*w[:200], *t.split(), *w[200:]])))
    docs += [(1000 + i, f" {t.upper()} ") for i, t in items]
    got = {(r.doc_id, r.item_id) for r in decontam.find_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i, t in items if len(t.split()) >= 5} | {(1000 + i, i) for i, _ in items}


# 10 -----------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    big, other = "<p>é" * 400, "y" * 1000
    rows = [(1, "http://a/ b", big), (7, "http://a", big), (7, "http://b", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (8, "u", other), (None, "u", other), (9, "u", "z" * 999), (10, "u", "z" * 999), (11, "u", "\r\n\r\n" * 600)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, data int")
    path = warc.write_warc(d)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows)
    seen = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert seen == Counter([(1, "revisit", 7), (7, "response", None), (7, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (8, "response", None), (None, "revisit", 8), (9, "response", None), (10, "response", None), (11, "response", None)])
    want = Counter((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    assert warc.read_warc(spark, warc.write_warc(d.limit(0))).count() == 0
    archive = spark.read.parquet(path).select("archive").first()[0]
    warc.export_archive(spark, path, archive, str(tmp_path / "a.warc.gz"))
    import gzip

    assert gzip.open(tmp_path / "a.warc.gz").read().startswith(b"WARC/1.1\r\n")


def test_warc_hot_payloads_files_and_ids(spark, tmp_path, monkeypatch):
    """One payload in most rows, null ids, repeated rows; archives that roll over, read back as files."""
    monkeypatch.setattr(warc, "HOT", 5)
    rows = [(i if i % 7 else None, "u", "h" * 1500) for i in range(60)] + [(100 + i, "u", f"p{i // 2} " * 500) for i in range(10)] + [(200, "v", "a" * (3 << 20)), (300, None, None), (300, None, None)]
    rows += [(400 + i, "w", hashlib.sha256(bytes([i])).hexdigest() * 20) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_warc(pages.repartition(3), level=0)
    order = lambda x: sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in x.collect()), key=key)
    want = []
    for i, _, t in rows:
        n, last = len(t or ""), max((j for j, _, u in rows if u == t and j is not None), default=None)
        again = n >= 1000 and last is not None and i != last
        want.append((i, n, "revisit" if again else "response", last if again else None))
    assert order(warc.read_warc(spark, path)) == sorted(want, key=key)
    names = sorted({r.archive for r in spark.read.parquet(path).select("archive").collect()})
    (tmp_path / "w").mkdir()
    ids = []
    for name in names:
        to = str(tmp_path / "w" / f"{name}.warc.gz")
        warc.export_archive(spark, path, name, to)
        ids += [warc.parse(m)["head"]["WARC-Record-ID"] for m in warc.members([open(to, "rb").read()])]
    assert order(warc.read_files(spark, str(tmp_path / "w"))) == sorted(want, key=key)
    assert len(set(ids)) == len(ids) == len(rows)


def test_warc_archives_roll_over(spark, monkeypatch):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 200).alias("html"))
    out, number = [], warc._write(0)
    monkeypatch.setattr(warc, "CHUNK_BYTES", 100_000)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 400_000)
    monkeypatch.setattr(warc, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    rows = pages.select("page_id", "url", "html", F.sha1("html").alias("d"), F.lit(None).cast("long").alias("last")).toArrow()
    for b in number(iter(rows.to_batches())):
        out += list(zip(b.column("archive").to_pylist(), b.column("seq").to_pylist(), b.column("data").to_pylist()))
    assert len({a for a, _, _ in out}) > 3 and [s for a, s, _ in out if a == out[0][0]] == list(range(4))
    got = [r for b in warc._read(iter([pa.record_batch([pa.array([a for a, _, _ in out]), pa.array([d for _, _, d in out], pa.binary())], ["archive", "data"])])) for r in b.column("page_id").to_pylist()]
    assert got == list(range(300))


def test_warc_refuses_a_record_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(warc, "MOST_RECORD", 1000)
    with pytest.raises(ValueError, match="more than 1000 bytes"):
        list(warc.members([warc.record("response", 1, "u", b"x" * 5000, "d")]))


def test_warc_reader_refuses_damage():
    payload = b"body " * 50
    good = warc.record("response", 1, "http://x", payload, hashlib.sha1(payload).hexdigest())
    pieces = [good[i : i + 7] for i in range(0, len(good), 7)] + [good]
    assert [warc.parse(m)["payload"] for m in warc.members(pieces)] == [payload, payload]
    member = next(iter(warc.members([good])))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(member.replace(b"body", b"BODY", 1))
    with pytest.raises(ValueError, match="length"):
        warc.parse(member[:-5])
    with pytest.raises(ValueError, match="ends within"):
        list(warc.members([good[:-9]]))
    with pytest.raises(ValueError, match="no WARC"):
        warc.parse(b"something else")
