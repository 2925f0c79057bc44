"""Detection on a stream of documents. No decision reaches beyond a document, so that each batch is worked on alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..operators.detect import detect_citations, detect_styles


def stream_documents(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    """Documents of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def stream_citations(docs: DataFrame, sink: Callable[[DataFrame, int], None], family: str = "comma", key: str = "doc_id", text: str = "text") -> DataStreamWriter:
    """A writer that gives the citations of each batch of documents, and its number, to a sink; start it with a trigger.

    A batch may come again after a failure, with the same number.
    """
    return docs.writeStream.foreachBatch(lambda batch, number: sink(detect_citations(batch, family, key, text), number))


def stream_styles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return detect_styles(docs, key, text)
