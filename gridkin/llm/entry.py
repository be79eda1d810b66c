"""Queries of the corpus operators and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridkin.llm import langid, toxicity
from gridkin.llm._common import documents
from gridkin.llm.bpe import encode
from gridkin.llm.exact_dedup import exact_dedup
from gridkin.llm.minhash import near_duplicates
from gridkin.llm.mixing import mix
from gridkin.llm.secret_scan import KINDS, scan_secrets
from gridkin.llm.sharding import shard
from gridkin.llm.topk import top_k
from gridkin.llm.url_filter import url_filter


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_text", 256).alias("base_sha256"), "spans", "n_copied", "n_live")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = documents(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), width=2, percent=80)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return shard(docs, n_shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(documents(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)


def language_model(spark: SparkSession, sf_dir: str) -> langid.LanguageModel:
    return langid.fit(documents(spark, sf_dir).where(~held_out(F.col("doc_id"), 3, 1)).select("text", "lang"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    said = langid.identify(docs, language_model(spark, sf_dir))
    return said.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_secret_scan": op2_secret_scan,
        "op3_toxicity": op3_toxicity,
        "op4_minhash": op4_minhash,
        "op5_sharding": op5_sharding,
        "op6_exact_top_k": op6_exact_top_k,
        "op7_mixing": op7_mixing,
        "op8_url_filter": op8_url_filter,
        "op9_language_id": op9_language_id,
        "op10_byte_bpe": op10_byte_bpe,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return {
        "op1_exact_dedup": f"""
            WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{upper}', '{lower}')) AS s FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, s AS text_sha256
            FROM d WINDOW w AS (PARTITION BY s)""",
        "op6_exact_top_k": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id,
                       CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
            )
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s QUALIFY rank <= 5""",
        "op8_url_filter": """
            WITH RECURSIVE rules(host, path, action) AS (
                VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                       ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
            ), own AS (
                SELECT page_id, url, html, regexp_replace(url, '(?s)#.*$', '') AS bare,
                       regexp_extract(regexp_replace(url, '(?s)#.*$', ''), '(?s)^.*?://[^/?#]*') AS start FROM pages
            ), nodes AS (
                SELECT *, translate(start, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(bare, length(start) + 1) AS node FROM own
            ), tags AS (
                SELECT url, node, unnest(list_concat(
                    list_transform(regexp_extract_all(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'),
                                   lambda t: regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)),
                    list_transform(regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'),
                                   lambda t: regexp_extract(t, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1))
                )) AS tag FROM nodes WHERE html IS NOT NULL AND url IS NOT NULL
            ), parts AS (
                SELECT node, regexp_replace(regexp_replace(tag, '(?i)&(amp|#38|#x26);', '&', 'g'), '(?s)#.*$', '') AS b,
                       regexp_extract(url, '^([^:/?#]+:)//[^/?#]*', 1) AS scheme, regexp_extract(url, '^[^:/?#]+://[^/?#]*') AS site,
                       regexp_extract(url, '(?s)^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path
                FROM tags
            ), paths AS (
                SELECT *, regexp_extract(b, '(?s)\\?.*$') AS query, string_split(CASE WHEN b LIKE '/%' THEN '' ELSE '/' || regexp_extract(path, '(?s)^/(.*/)?', 1) END
                       || regexp_extract(b, '(?s)^[^?]*'), '/') AS segments
                FROM parts WHERE b <> ''
            ), reduced AS (
                SELECT *, list_reduce(list_prepend('', segments[2:]), lambda acc, x:
                       CASE x WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN '.' THEN acc ELSE acc || '/' || x END) AS short
                FROM paths
            ), links AS (
                SELECT node, CASE WHEN regexp_matches(b, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN b WHEN site = '' THEN NULL
                    WHEN b LIKE '//%' THEN scheme || b WHEN b LIKE '?%' THEN site || path || b
                    ELSE site || short || CASE WHEN segments[-1] IN ('.', '..') OR short = '' THEN '/' ELSE '' END || query END AS b
                FROM reduced
            ), ends AS (
                SELECT node, b, regexp_extract(b, '(?s)^.*?://[^/?#]*') AS start FROM links WHERE b IS NOT NULL
            ), edges AS (
                SELECT node AS a, translate(start, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(b, length(start) + 1) AS b FROM ends
            ), pairs AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges
            ), reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
            ), urls AS (
                SELECT DISTINCT url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                       regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
                FROM (SELECT url FROM pages UNION SELECT a FROM pairs)
            ), judged AS (
                SELECT url, u.host, u.path, r.host || r.path AS rule, action
                FROM urls u LEFT JOIN rules r ON (u.host = r.host OR u.host LIKE '%.' || r.host) AND starts_with(u.path, r.path)
                QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(r.host || r.path) DESC) = 1
            ), passed AS (
                SELECT a AS url, min(action) AS passed FROM reach JOIN judged j ON reach.b = j.url GROUP BY a
            )
            SELECT page_id, host, path, rule, coalesce(action, passed, 'allow') AS verdict
            FROM nodes JOIN judged j ON nodes.url IS NOT DISTINCT FROM j.url LEFT JOIN passed p ON p.url = nodes.node""",
    }
