"""The corpus pipeline: toxic documents go, copies and near copies go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; `run` writes
every stage's result as Parquet under the shared folder and reads it again for the next.
"""
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lograil.llm import exact, packing, simhash, toxicity
from lograil.llm.common import prepare, table
from lograil.session import shared_folder

# No SQL: scores of a trained network, 64-bit shingle hashes and tokenizer ids have none.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows, does not reject."""
    prepare(spark)
    net = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, net)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id."""
    prepare(spark)
    return exact.keep_decided(docs, exact.exact_duplicates(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document with the smallest doc_id."""
    prepare(spark)
    return exact.keep_decided(docs, simhash.one_of_each(simhash.near_duplicates(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
