"""Arrow functions over columns of whole texts.

Spark bounds the bytes of an Arrow batch (``spark.sql.execution.arrow.maxBytesPerBatch``,
64 MB unless set); here a batch becomes Python objects in slices of ROWS, so that what a
worker holds follows a slice and neither the batch's rows nor any setting of the session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Values that are Python objects at once.
ROWS = 500


def sliced(arrays: Iterator[pa.Array], rows: int = ROWS) -> Iterator[list]:
    """The values of all arrays, in order, ``rows`` at most at a time."""
    for array in arrays:
        for at in range(0, len(array), rows):
            yield array.slice(at, rows).to_pylist()


def udf_of_lists(kind: DataType, work: Callable[[Iterator[list]], Iterator[list]]):
    """A column function of one argument; ``work`` gives a list of results for each list of values.

    Results of a struct are dicts. What ``work`` sets up before its loop is set up once a task.
    """
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for results in work(sliced(arrays)):
            yield pa.array(results, arrow)

    return run
