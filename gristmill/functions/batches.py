"""Column functions in Python that hold a slice of an Arrow batch as Python objects at a time, however large the table is.

A batch has as many as 10,000 rows, 64 MB of Arrow buffers. As objects, with what is made of them, it takes several times that; so it is taken by slices, and a slice's results leave before the
next is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

ROWS, BYTES = 500, 2**20


def slices(batch, rows: int = ROWS, most: int = BYTES) -> Iterator:
    """A batch or array in order, in slices of at most `rows` rows and about `most` bytes, a row at least."""
    at, n = 0, rows
    while at < len(batch):
        part = batch.slice(at, n)
        while len(part) > 1 and part.nbytes > most:
            part = part.slice(0, len(part) // 2)
        yield part
        at += len(part)
        n = min(rows, 2 * len(part))


def sliced(f: Callable[..., list], returns: str):
    """The column function of f, from lists of the arguments' values, an equal number of each, to the list of the results' values (dicts for a struct)."""
    kind = to_arrow_type(DataType.fromDDL(returns))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for one in batches:
            arrays = one if isinstance(one, tuple) else (one,)
            whole = pa.RecordBatch.from_arrays(list(arrays), [str(k) for k in range(len(arrays))])
            for part in slices(whole):
                yield pa.array(f(*[c.to_pylist() for c in part.columns]), kind)

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from run(batches)

    one, several = arrow_udf(run, returns), arrow_udf(many, returns)
    return lambda *columns: (one if len(columns) == 1 else several)(*columns)
