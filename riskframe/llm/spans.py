"""Small helpers for operators that find spans in whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from riskframe.llm.tables import in_batches

#: Rows that a task holds as Python strings at once.
ROWS = 256

Span = tuple[int, int, int]  # start, place of the kind in the operator's list, end (exclusive), in code points


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return ",".join([f"{kinds[k]}:{start}:{end}" for start, k, end in spans])


def scan(docs: DataFrame, columns: tuple[str, ...], schema: str, rows_of: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """Runs a function of column lists over the rows of docs, ROWS at a time: as many rows out as in.

    rows_of() is called once in each task and returns that function.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = rows_of()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                out = f([c.to_pylist() for c in whole.slice(at, ROWS).columns])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_schema

    selected = docs.select(*columns)
    arrow = to_arrow_schema(selected.sparkSession.createDataFrame([], schema).schema)
    types, names = arrow.types, arrow.names
    return in_batches(selected).mapInArrow(scanned, schema)


def kept(docs: DataFrame, column: str, keep_of: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of docs that a function of their values in a column keeps, as they are.

    Only the places of columns are used, so their names may clash with anything. keep_of() is called once in each task.
    """
    place = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = keep_of()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield batch.filter(pa.array(f(batch.column(place).to_pylist()), pa.bool_()))

    return in_batches(docs).mapInArrow(run, docs.schema)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
