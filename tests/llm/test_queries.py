"""Queries of this folder that SQL can express, against DuckDB; the pipeline's rows against its stages."""

import os

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import edit_counts, queries

from ..test_queries import rows

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    ours, theirs = queries.queries()[name](spark, DATA).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 14))


def test_counts_of_documents_are_those_of_whole_texts(spark):
    """op10 against encoding each whole text, and the text after its edits, anew."""
    encoding = edit_counts.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    count, right = (lambda s: len(encoding.encode_ordinary(s))), []
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        text = r["text"] or ""
        edits = edit_counts.private_edits(text)
        after = text
        for a, b, new in reversed(edits):
            after = after[:a] + new + after[b:]
        right.append((r["doc_id"], count(text), count(after), len(edits), len(text)))
    found = queries.queries()["op10_edit_counts"](spark, DATA).select("doc_id", "n_tokens", "n_tokens_after", "n_edits", "n_chars").collect()
    assert sorted(map(tuple, found)) == sorted(right)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        n, before = docs.count(), n
        assert 0 < n <= before and (name != "line dedup" or n == before)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, whole.collect())) and docs.where(F.col("doc_id").isNull()).count() == 0
