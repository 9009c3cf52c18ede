import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from meshquill.llm import queries, token_output, toxicity
from meshquill.llm.langid import crc_of_id
from meshquill.llm.shared import materialise
from meshquill.llm.words import bytes_of, words_of
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage kept, read back."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialise(stage(spark, docs, SF), name)
    return {k: {r.doc_id: r for r in v.collect()} for k, v in out.items()}


def test_columns_stay(stages):
    first = list(stages["documents"].values())[0].asDict()
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert all(r.asDict().keys() == first.keys() for r in stages[name].values())


def test_toxic_documents_go(spark, stages):
    insults = r"\b(idiot|moron|stupid|scum|loser|pathetic|worthless|disgusting)\b"
    kept, gone = stages["toxicity"], set(stages["documents"]) - set(stages["toxicity"])
    # what goes is what the operator, fitted on the same rows, rejects
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    machine = toxicity.fit_toxicity(docs, labels.filter(crc_of_id() % 3 != 1))
    bad = {r.doc_id for r in stages["documents"].values() if machine.logistic(machine.texts(words_of(*bytes_of(pa.array([r.text], pa.string())))))[0] >= 0.7}
    assert gone == bad and kept.keys().isdisjoint(bad)
    assert sum(bool(re.search(insults, stages["documents"][i].text, re.I)) for i in gone) >= len(gone) / 3


def test_one_of_each_group_stays(stages):
    before = stages["toxicity"]
    s, find = brute_components([(i, r.text) for i, r in before.items()])
    assert set(stages["near_dedup"]) == {i for i in before if find(i) == i}


def test_benchmark_items_go(stages):
    items = [t for _, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()]
    low = lambda t: {tuple(w[a : a + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())] for a in range(max(0, len(w) - 4))}
    sets = [low(t) for t in items]
    want = {i for i, r in stages["near_dedup"].items() if not any(q and 100 * len(q & low(r.text)) >= 75 * len(q) for q in sets)}
    assert set(stages["decontamination"]) == want


def test_the_mix_takes_words_of_its_documents(stages):
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = stages["decontamination"], stages["mixing"]
    assert set(after) <= set(before)
    assert all(0 < n(r.text) <= 2 * n(before[i].text) and r.n_chars == len(r.text) for i, r in after.items())
    assert sum(n(r.text) for r in after.values()) == pytest.approx(1.5 * sum(n(r.text) for r in before.values()), rel=0.02)


def test_tokens_are_those_of_the_mix(stages):
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(token_output.tokenizer_path("word_bpe_49k.json")), 0
    for i in sorted(stages["mixing"]):
        ids = np.array([*tok.encode(stages["mixing"][i].text, add_special_tokens=False).ids, 2], "<u4")
        r = stages["tokens"][i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda rows: sorted(map(repr, rows))
    got = plain(tuple(r[c] for c in cols) for r in df.collect())
    want = plain(con.execute(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)} from ({queries.SQL[name]})").fetchall())
    assert got == want


def test_held_out_toxicity(spark):
    """Labelled texts that the fit may not see."""
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, sf).collect()}
    labels = duckdb.sql(f"select doc_id, toxic, lang from '{sf}/labels.parquet' join '{sf}/documents.parquet' using (doc_id)").fetchall()
    held = [(got[i].predicted, t, lang) for i, t, lang in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, *_ in labels if zlib.crc32(str(i).encode()) % 3 == 1)
    # few toxic texts, made of common syllables but in English: thousands of labels separate all of them (README)
    assert np.mean([p for p, t, _ in held if t]) >= 0.8 and np.mean([p for p, t, _ in held if not t]) <= 0.015
    for lang, least in (("en", 0.85), ("fr", 0.75), ("es", 0.75), ("de", 0.5)):
        assert np.mean([p for p, t, own in held if t and own == lang]) >= least


def test_altered_insults(spark):
    """Insults kept from training, altered and put into clean texts: signs between letters, spelled out, a letter inserted."""
    sf = "/root/testdata/sf0.1"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    machine = toxicity.fit_toxicity(docs, labels.filter(crc_of_id() % 3 != 1))
    clean = [r[0] for r in duckdb.sql(f"select text from '{sf}/documents.parquet' join '{sf}/labels.parquet' using (doc_id) where toxic = 0 and lang = 'en' and length(text) between 400 and 3000 order by doc_id limit 40").fetchall()]
    ways = {"plain": str, "one sign": lambda w: f"{w[:2]}.{w[2:]}", "every gap": "-".join, "two in every gap": "--".join, "bullets": "\u2022".join, "unseen": "\u200b".join, "spaced": " ".join, "one letter": lambda w: f"{w[:3]}x{w[3:]}"}
    found = {}
    for name, alter in ways.items():
        texts = [f"{t[: t.index(' ')]} {alter(w)} {t[t.index(' ') + 1 :]}" for t in clean for w in ("idiot", "worthless", "pathetic", "disgusting")]
        score = machine.logistic(machine.texts(words_of(*bytes_of(pa.array(texts)))))
        found[name] = float(np.mean(score >= 0.7))
    assert all(found[n] >= 0.95 for n in ways if n != "one letter"), found
    # a letter can't be told from the word's own; with these few labels one word in four is still found, with thousands most (README)
    assert found["one letter"] >= 0.2, found


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op8_language_id(spark, sf).collect()}
    docs = duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall()
    held = [got[i].lang_pred == x for i, x in docs if zlib.crc32(str(i).encode()) % 5 == 0 and got[i].held_out]
    assert np.mean(held) >= 0.99


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op4_quality(spark, sf).collect()}
    labels = [(i, q) for i, q in duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall() if zlib.crc32(str(i).encode()) % 3 == 1]
    good, bad = (np.array([got[i].quality for i, q in labels if q == k]) for k in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() >= 0.99
    assert np.mean([got[i].kept for i, q in labels if q == 0]) < 0.1 and np.mean([got[i].kept for i, q in labels if q]) > 0.8


# Edge cases of the stages ---------------------------------------------------------

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, row int, __text string, __row string"


def edge_docs(spark, item):
    long = " ".join(f"v{i % 1999}" for i in range(40_000))
    clean = [" ".join(f"c{i}_{n}" for n in range(40)) for i in range(6)]
    rows = [(1, clean[0]), (1, clean[0]), (2, clean[0]), (None, clean[1]), (None, clean[1]), (None, None), (3, None), (4, ""), (5, " \n\t"), (6, long), (7, f"{clean[2]} {item} {clean[3]}"), (None, item), (8, clean[4]), (9, clean[4] + " more"), (10, "one two")]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i in (4, 8) else f"s{(i or 0) % 2}", None if t is None else len(t), 1, 2, "x", None) for i, t in rows], EDGE_SCHEMA)


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    """A folder with labels and a benchmark of its own; one item, a null and an empty one."""
    path, item = str(tmp_path_factory.mktemp("edge")), " ".join(f"bench{n}" for n in range(30))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, item


def told(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None) for r in df.collect()))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_on_edge_cases(spark, edge_dir, name, stage):
    path, item = edge_dir
    docs = edge_docs(spark, item)
    got = stage(spark, docs, path)
    assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes)
    before, after = told(docs), told(got)
    if name == "toxicity":  # one class only is labelled: nothing is judged toxic
        assert after == before
    if name == "near_dedup":  # (1) once, (2) and (9) are copies; rows without an id or words all stay
        assert len(after) == len(before) - 3 and {x[1] for x in after} == {0, 1, 3, 4, 5, 6, 7, 8, 10}
        assert sum(x[0] for x in after) == 4
    if name == "decontamination":
        assert after == [x for x in before if item not in x[2]]
    if name == "mixing":  # only words of the documents, and at most twice as many
        texts = {}
        for x in before:
            texts[x[:2]] = texts.get(x[:2], 0) + 2 * len(x[2].split())
        assert {x[:2] for x in after} <= set(texts) and sum(len(x[2].split()) for x in after) <= sum(texts.values())
        assert all(r.text and (r.n_chars == len(r.text)) for r in got.collect())
    assert stage(spark, docs.limit(0), path).count() == 0


def test_last_stage_on_edge_cases(spark, edge_dir):
    path, item = edge_dir
    docs = edge_docs(spark, item)
    stage = dict(corpus_pipeline.STAGES)["tokens"]
    got = stage(spark, docs, path)
    assert got.count() == docs.count() and got.filter("n_tokens = 1").count() == docs.filter("text IS NULL OR btrim(text, ' \n\t') = ''").count()
    assert stage(spark, docs.limit(0), path).count() == 0
