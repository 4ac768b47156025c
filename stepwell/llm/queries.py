"""The queries opN_<name> and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stepwell.llm import ann, bpe, license_scan, packing, quality, simhash, substring, token_counts, topk, url_filter

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge_urls(pages, URL_RULES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.as_query(simhash.near_duplicates(documents(spark, sf_dir)))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, vectors.where("id % 100 = 0"), 10)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.as_query(license_scan.scan(documents(spark, sf_dir)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judged(quality.score(docs, model))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.drop_repeats(documents(spark, sf_dir)))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return ann.nearest(vectors, vectors.where("id % 50 = 0"), 5)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_exact_topk": op3_exact_topk,
    "op4_license_scan": op4_license_scan,
    "op5_packing": op5_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL = {
    "op2_url_filter": """
with rules(rh, rp, rv) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p as (select page_id,
        coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
      from pages),
m as (select p.page_id, p.host, p.path, rh || rp as rule, rv,
        row_number() over (partition by p.page_id order by length(rh || rp) desc nulls last) as k
      from p left join rules on (p.host = rh or ends_with(p.host, '.' || rh)) and starts_with(p.path, rp))
select page_id, host, path, rule, coalesce(rv, 'allow') as verdict from m where k = 1
""",
    "op3_exact_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as a from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(case when len(q.a) = 0 or len(c.a) = 0 then 0 else list_dot_product(q.a, c.a) end as bigint) as score
      from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
""",
    "op8_substring_dedup": r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
starts as (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w),
windows as (select doc_id, i, count(*) over (partition by array_to_string(ws[i : i + 34], ' ')) > 1 as repeated from starts),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w),
marked as (select words.doc_id, words.i, word, max(coalesce(repeated, false)) over (partition by words.doc_id order by words.i rows between 34 preceding and current row) as gone
           from words left join windows on words.doc_id = windows.doc_id and words.i = windows.i)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(count(*) filter (gone) as bigint) as n_removed,
       sha256(coalesce(string_agg(word, ' ' order by i) filter (not gone), '')) as kept_sha256
from w left join marked using (doc_id) group by w.doc_id, len(ws)
""",
}
