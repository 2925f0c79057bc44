"""The corpus pipeline: STAGES applied one after the other to documents.

Each stage takes all that the one before kept, and its decisions take effect: toxic documents go, repeated passages of
lines leave the texts, of each group of near copies one document stays, contaminated documents go, and what is left is
encoded. A stage's output is to be written and read again before the next one; run() does so in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bag_minhash, bpe_codec, decontaminate, line_chunks, toxic_spans
from marginalia.llm.common import read
from marginalia.sources.tables import Tables


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold; each is judged by its own text."""
    return toxic_spans.clean(docs, toxic_spans.train(docs, read(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of several lines that stand elsewhere before; n_chars follows."""
    cleaned = line_chunks.clean(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are the first of their group of near copies, repeated rows once; those with a null id or without words stay."""
    return bag_minhash.clean(docs)


def without_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth is benchmark text; each is judged by its own text."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    return bpe_codec.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("MinHash near-dedup", one_of_near_copies),
    ("benchmark decontamination", without_contaminated),
    ("BPE encoding and decoding", encoded),
]

#: SQL can't express the classifier, the signatures or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage before is a table in the shared folder, which goes when the next one is there."""
    docs, tables, last = read(spark, sf_dir, "documents"), Tables(spark), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = tables.keep(docs)
            if last is not None:
                tables.drop(last)
            last = docs
    return docs
