"""State machines over ordered streams, with the memory of one batch however long a stream is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType


def changes(values: pd.Series) -> np.ndarray:
    """True where a value differs from the one before; nulls are equal."""
    codes = pd.factorize(values, use_na_sentinel=False)[0]
    return codes[1:] != codes[:-1]


def run_ordered(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], object], schema: StructType | str) -> DataFrame:
    """Rows of each key in order through a machine of its own: ``machine.take(pdf)`` gets the key's rows batch by batch
    and ``machine.end()`` comes after the last; both give rows of ``schema`` (a frame or a list of tuples) or None.

    Partitions are sorted by key and order, by Spark's sort that spills, and streamed: no key is gathered. Null keys
    are a key."""
    names = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).names

    def gathered(out: list) -> Iterator[pd.DataFrame]:
        out = [x for x in out if x is not None and len(x)]
        rows = [r for x in out if isinstance(x, list) for r in x]
        if rows:
            yield pd.DataFrame(rows, columns=names)
        if frames := [x for x in out if not isinstance(x, list)]:
            yield pd.concat(frames, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            out, new = [], np.zeros(len(pdf) - 1, dtype=bool)
            for k in keys:
                new |= changes(pdf[k])
            starts = [0, *(np.flatnonzero(new) + 1).tolist(), len(pdf)]
            for own, a, z in zip(zip(*[pdf[k].iloc[starts[:-1]] for k in keys]), starts, starts[1:]):
                own = tuple(None if pd.isna(x) else x for x in own)
                if machine is None or own != key:
                    if machine is not None:
                        out.append(machine.end())
                    key, machine = own, make()
                out.append(machine.take(pdf.iloc[a:z]))
            yield from gathered(out)
        if machine is not None:
            yield from gathered([machine.end()])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _stretches(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Rows of one key that follow each other: key, first row, row after the last."""
    new = np.zeros(batch.num_rows - 1, dtype=bool)
    for k in keys:
        new |= changes(batch.column(k).to_pandas())
    starts = [0, *(np.flatnonzero(new) + 1).tolist()]
    own = [[None if x != x else x for x in batch.column(k).take(pa.array(starts)).to_pylist()] for k in keys]
    return zip(zip(*own), starts, [*starts[1:], batch.num_rows])


def run_rows(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], make: Callable[[], object], schema: StructType) -> DataFrame:
    """:func:`run_ordered` for small machines and keys of few rows: ``machine.row(*values)`` gets the columns ``inputs`` of a row,
    ``machine.end()`` comes after the last; both give a row of ``schema`` as a tuple, or None. No frame is made for a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
        key, machine = None, None
        for batch in (b for b in batches if b.num_rows):
            values, out = list(zip(*[batch.column(c).to_pylist() for c in inputs])), []
            for own, a, z in _stretches(batch, keys):
                if machine is None or own != key:
                    if machine is not None:
                        out.append(machine.end())
                    key, machine = own, make()
                out += [machine.row(*v) for v in values[a:z]]
            if out := [x for x in out if x is not None]:
                yield table(out)
        if machine is not None and (last := machine.end()) is not None:
            yield table([last])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def add_ordered(df: DataFrame, keys: list[str], order: list[str], column: str, make: Callable[[], Callable], name: str) -> DataFrame:
    """``df`` with a long column ``name``: ``make()`` gives for each key a function that is called with ``column`` of its rows, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = None, None
        for batch in (b for b in batches if b.num_rows):
            given, out = batch.column(column).to_pylist(), []
            for own, a, z in _stretches(batch, keys):
                if value is None or own != key:
                    key, value = own, make()
                out += [value(x) for x in given[a:z]]
            yield batch.append_column(name, pa.array(out, pa.int64()))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, StructType([*df.schema.fields, StructField(name, LongType())]))
