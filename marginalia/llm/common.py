"""What the operators of this folder share: reading, numbers of tasks, Arrow maps over texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators.batches import map_batches, slices
from ..sources.tables import Tables, shared_folder

__all__ = ["Tables", "map_texts", "read", "schema_of", "shared_folder", "tasks_of"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_of(df: DataFrame, each: int) -> int:
    """Tasks for stages over df: those of the session, or more if its estimated bytes give more than `each` for one."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size >= 1 << 60 else max(least, -(-size // each))  # as much as that means unknown


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def map_texts(df: DataFrame, kernel, ddl: str, key: str, text: str) -> DataFrame:
    """One row for each row of df: the key, then what kernel makes of the text (null: empty).

    kernel takes a list of str, of bounded bytes in all, and returns a list of columns in the order of ddl.
    """
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in schema_of(ddl)]

    def run(batches):
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            columns = kernel(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True))],
                names=[key, *(n for n, _ in kinds)],
            )

    key_type = df.schema[key].dataType.simpleString()
    return map_batches(df.select(F.col(key), F.col(text).cast("string").alias(text)), run, f"`{key}` {key_type}, {ddl}")
