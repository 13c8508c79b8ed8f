"""Folds over the rows of a key in order, with a small state and nothing gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 10_000


def folded(
    rows: DataFrame, key: str, order: list[str], start: object, step: Callable, schema: str, each: Callable | None = None, last: Callable | None = None
) -> DataFrame:
    """Rows (``schema``, the key first) that a fold over the rows of each key gives.

    ``step(state, row)`` gives the next state, for ``row`` the values of all columns but the key; ``each(before, after, row)``
    may give the rest of an output row for each row, ``last(state)`` for each key. Rows meet by key and are sorted there by
    ``order``, on disk where they don't fit in memory; a task reads them as a stream and holds one key's state, whatever their number. Null is a
    key of its own.
    """
    names = [key, *[c for c in rows.columns if c != key]]
    into = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, state = False, None
        now: object = None
        for batch in batches:
            for own, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if not held or own != now:
                    if held and last:
                        out.append((now, *last(state)))
                    held, now, state = True, own, start
                before, state = state, step(state, row)
                found = each(before, state, row) if each else None
                if found is not None:
                    out.append((own, *found))
            while len(out) >= ROWS:
                yield packed(out[:ROWS])
                out = out[ROWS:]
        if held and last:
            out.append((now, *last(state)))
        yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else [[] for _ in into]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, into)], schema=into)

    return rows.select(*names).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
