"""Arrow batches in, Python rows through, Arrow batches out: the one way by which operators of this subpackage run Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import kept

__all__ = ["kept", "map_rows"]
OUT_ROWS = 4096
OUT_CHARS = 16_000_000


def _size(row: tuple) -> int:
    return sum(len(v) for v in row if isinstance(v, (str, bytes, list)))


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str | T.StructType) -> DataFrame:
    """Run one(*columns) -> output tuples on every row of df.

    make() builds `one` once in each Python task, so models and tables are loaded there and not shipped by row.
    Output batches are closed by rows or by size, whichever comes first, so a few very long texts stay small.
    """
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, out = make(), to_arrow_schema(struct)
        rows, chars = [], 0
        for b in batches:
            for cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for r in one(*cells):
                    rows.append(r)
                    chars += _size(r)
                    if len(rows) >= OUT_ROWS or chars >= OUT_CHARS:
                        yield _batch(rows, out)
                        rows, chars = [], 0
        if rows:
            yield _batch(rows, out)

    return df.mapInArrow(run, struct)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
