import hashlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import cases
from vitrine.llm import queries


def test_stages_hand_on_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == names, name
        assert docs.count() <= rows
        rows = docs.count()
    assert 0 < rows < 200


def test_planted_rows(spark, sf_dir, tmp_path):
    """Each stage does its work, and rows without cause stay."""
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    fresh = lambda tag, n: " ".join(f"{tag}{k}x" for k in range(n))
    passage = fresh("p", 60)
    rows = [
        (1, fresh("a", 120)), (2, fresh("a", 120)), (3, fresh("b", 30) + " " + passage), (4, fresh("c", 30) + " " + passage + " " + fresh("d", 20)),
        (5, fresh("e", 20) + " " + item + " " + fresh("f", 20)), (6, fresh("g", 40)), (7, None), (8, ""),
    ]
    docs = cases.documents(spark, rows).select(*known.columns)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(texts) == {1, 3, 4, 6, 7}
    assert texts[4].split() == (fresh("c", 30) + " " + fresh("d", 20)).split()
    assert texts[3] == rows[2][1]
    tokens = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert {(r["doc_id"], r["decoded_sha256"]) for r in tokens.collect()} == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts.items()}


def test_run_is_registered(spark, sf_dir):
    assert {*queries.queries(), "pipeline"} <= set(entry.queries())
    assert entry.queries()["pipeline"](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0
