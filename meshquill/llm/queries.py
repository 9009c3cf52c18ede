"""The opN_ queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquill.llm.decontam import find_contamination
from meshquill.llm.langid import crc_of_id, fit_languages, identify_languages
from meshquill.llm.mixing import mix_sources
from meshquill.llm.near_dedup import near_duplicates
from meshquill.llm.quality import resample
from meshquill.llm.substring_dedup import substring_dedup
from meshquill.llm.token_output import read_tokens, write_tokens
from meshquill.llm.topk_search import search
from meshquill.llm.toxicity import fit_toxicity, score_toxicity
from meshquill.llm.warc import read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(table(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json", end_id=2)
    return read_tokens(spark, path).drop("ids")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), total=1.5, most=2.0)[0]


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return resample(docs, labels.filter("quality = 1").filter(crc_of_id() % 3 != 1), share=0.8)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=5, similarity=0.75)


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10, scale=1024.0)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle=5, containment=0.75)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_warc(table(spark, sf_dir, "pages"), revisit_from=1000)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = fit_toxicity(docs, labels.filter(crc_of_id() % 3 != 1))
    scored = score_toxicity(docs, machine, threshold=0.7)
    return scored.select("doc_id", F.coalesce(crc_of_id() % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = fit_languages(docs.filter(crc_of_id() % 5 != 0))
    found = identify_languages(docs, trees)
    return found.select("doc_id", F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_output": op2_token_output,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_near_dedup": op5_near_dedup,
    "op6_topk_search": op6_topk_search,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
}

WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op1_substring_dedup": rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)),
least as (select g, min(doc_id) as m from win group by g),
gone as (select distinct doc_id, i + k as p from (select doc_id, i from win join least using (g) where m < doc_id) as h, range(13) as r(k)),
tok as (select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as word from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as txt, count(*) as n from tok anti join gone using (doc_id, p) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(txt, '')) as kept_sha256
from w left join kept using (doc_id)""",
    "op5_near_dedup": rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws from documents),
sh as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) as i from w)),
n as (select doc_id, count(*) as n from sh group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh as a join sh as b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as (select x, y from c join n as p on p.doc_id = x join n as q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)),
l as (select x, y from e union all select y, x from e),
r(node, reach) as (select doc_id, doc_id from documents union select r.node, l.y from r join l on l.x = r.reach),
m as (select node, min(reach) as component_id from r group by node)
select w.doc_id, coalesce(n.n, 0) as n_shingles, component_id, w.doc_id = component_id as kept from w left join n using (doc_id) join m on m.node = w.doc_id""",
    "op6_topk_search": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v as q join v as c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10""",
    "op9_decontamination": rf"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') as ws from documents),
b as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') as ws from benchmark),
ds as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) as i from d)),
bs as (select distinct item_id, array_to_string(ws[i:i + 4], ' ') as g from (select item_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) as i from b)),
n as (select item_id, count(*) as n_item from bs group by item_id),
s as (select doc_id, item_id, count(*) as n_shared from ds join bs using (g) group by doc_id, item_id)
select doc_id, item_id, n_item, n_shared, cast(n_shared as double) / n_item as containment from s join n using (item_id) where n_shared * 100 >= n_item * 75""",
    "op10_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as payload_bytes, sha1(b) as payload_digest, max(page_id) over (partition by b) as last, octet_length(b) >= 1000 as large from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when large and page_id <> last then 'revisit' else 'response' end as record_type,
  case when large and page_id <> last then last end as refers_to
from d""",
}
