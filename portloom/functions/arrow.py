"""Row kernels in Arrow batches: plain Python over each row, for what no relational plan says."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows worked at a time, so that results of any size leave a task in small batches.
ROWS = 256


def mapped(rows: DataFrame, keep: Sequence[str], inputs: Sequence[str], kernel: Callable[..., Iterable[tuple]], fields: str) -> DataFrame:
    """``keep`` and ``fields`` for each tuple that ``kernel`` gives for a row's ``inputs``; a row may give none, one or many."""
    src = rows.select(*keep, *[c for c in inputs if c not in keep])
    new = to_arrow_schema(StructType.fromDDL(fields))
    schema = StructType([src.schema[c] for c in keep] + StructType.fromDDL(fields).fields)
    at = [src.columns.index(c) for c in inputs]
    n, names = len(keep), schema.names

    def out(part: pa.RecordBatch, source: list[int], found: list[tuple]) -> pa.RecordBatch:
        taken = part.take(pa.array(source, pa.int64()))
        return pa.RecordBatch.from_arrays([*taken.columns[:n], *[pa.array([f[i] for f in found], t.type) for i, t in enumerate(new)]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                source, found = [], []
                for k, values in enumerate(zip(*[part.column(i).to_pylist() for i in at], strict=True)):
                    for result in kernel(*values):
                        source.append(k)
                        found.append(result)
                        if len(found) >= 16 * ROWS:
                            yield out(part, source, found)
                            source, found = [], []
                yield out(part, source, found)

    return src.mapInArrow(run, schema)
