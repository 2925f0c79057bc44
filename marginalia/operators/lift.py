"""Functions of one text, lifted to DataFrames by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .batches import map_batches, slices

#: Rows in a batch that leaves Python.
OUT_ROWS = 2000


def flat_map(df: DataFrame, key: str, inputs: list[str], make: Callable[..., list[dict]], ddl: str, only: Sequence[str] | None = None) -> DataFrame:
    """The key and each of the records that make gives for the inputs of a row (null texts: empty); of its fields only some, if these are named."""
    fields = [f for f in _parse_datatype_string(ddl) if only is None or f.name in only]
    schema = StructType([StructField(key, df.schema[key].dataType), *fields])
    arrow = to_arrow_schema(schema)
    strings = [df.schema[c].dataType.simpleString() == "string" for c in inputs]
    widest = strings.index(True) + 1 if any(strings) else None

    def run(batches):
        rows = []
        for b in slices(batches, widest) if widest else batches:
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for k, *values in zip(*columns, strict=True):
                values = [v or "" if s else v for v, s in zip(values, strings, strict=True)]
                rows += [{key: k, **r} for r in make(*values)]
                if len(rows) >= OUT_ROWS:
                    yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()
                    rows = []
        if rows:
            yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    return map_batches(df.select(F.col(key), *inputs), run, schema)
