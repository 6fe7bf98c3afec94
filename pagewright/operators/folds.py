"""Folds in Python over the rows of one group after another, as they stream in.

A group costs its rows only: no table is made for each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def _values(column: pa.Array) -> list:
    """Python values; a null in a column of floats is NaN."""
    plain = pa.types.is_floating(column.type) or column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_boolean(column.type))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def folded(df: DataFrame, keys: list[str], order: list[str | Column], one: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """What ``one`` makes of the rows of each group of equal ``keys``, in ``order``; null keys are equal.

    ``df`` begins with ``keys``. Rows are tuples in the order of its columns.
    """
    n, kind = len(keys), to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kind)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            out = []
            for row in zip(*map(_values, batch.columns), strict=True):
                if row[:n] != key:
                    if rows:
                        out += one(rows)
                    key, rows = row[:n], []
                rows.append(row)
            yield made(out)
        if rows:
            yield made(one(rows))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
