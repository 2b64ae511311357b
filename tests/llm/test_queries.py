"""Registered queries against DuckDB where SQL can say it, and the pipeline against its parts."""
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lograil.llm import queries
from lograil.session import durable
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.oracle_check import compare, connection

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    count, problem = compare(spark, FOLDER, entry.queries()[name], entry.oracle_sql()[name], connection(FOLDER))
    assert problem is None and count > 0


def test_one_query_for_each_operator():
    assert [n for n in range(1, 14) if sum(q.startswith(f"op{n}_") for q in queries.QUERIES) == 1] == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, FOLDER)
        assert left.columns == docs.columns
        left = durable(left)
        ids = sorted(r.doc_id for r in left.select("doc_id").collect())
        if name == "toxicity":
            assert len(ids) > 0.85 * len(held)
        if name == "exact_dedup":
            last = {}
            for i in kept:
                last[held[i]] = max(last.get(held[i], i), i)
            assert ids == sorted(last.values())
        if name == "simhash_near_dedup":
            prints = {i: plain_fingerprint(held[i]) for i in kept}
            found = plain_components(kept, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
            assert ids == sorted(set(found.values()))
        docs, kept = left, ids
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in pieces} == set(kept)
