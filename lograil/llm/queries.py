"""The dealt operators as queries with production parameters over their whole tables."""
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.llm import (
    conversations,
    exact,
    licenses,
    packing,
    pieces,
    pitman_yor,
    quality,
    simhash,
    spelling,
    toxicity,
    urls,
    vectors,
    warc,
)
from lograil.llm.common import table
from lograil.session import shared_folder

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(spark, pages, f"{shared_folder(spark)}/warc-{uuid4().hex}")


ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, strlen(html) >= 1000 AND page_id IS DISTINCT FROM max(page_id) OVER (PARTITION BY html) AS again,
      max(page_id) OVER (PARTITION BY html) AS last_id FROM p)
SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last_id END AS refers_to,
       replace(url, ' ', '%20') AS target_uri
FROM r"""


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = toxicity.fitted(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.classify(docs, net)


@query
def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.language_model_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


# The list of the query: hosts with one of these words between dots or dashes.
LISTED = r"(^|[.-])(spam|casino|pills|bets|adult|ads)([.-]|$)"


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), F.col("host").rlike(LISTED))


ORACLES["op7_url_filter"] = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
      regexp_matches(host, '{LISTED}') AS listed FROM p)
SELECT page_id, host, path, rule, listed,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM r"""


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op8_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM d"""


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                  public_tokenizers.path("word_bpe_49k.json")).drop("ids")


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "fingerprint", "component_id")


@query
def op11_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                  table(spark, sf_dir, "labels").select("doc_id", "quality"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
