"""Arrow helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Arrow batches through Python: ``make()`` is called once per task and returns a function of the batch's columns
    (as lists) that yields output tuples, or whole tables of the schema. One Python call per batch, not per row."""
    names = columns_of(schema)
    types = [_ARROW[x.strip().split(" ", 1)[1].strip()] for x in schema.split(",")]
    out = pa.schema([(n, t) for n, t in zip(names, types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            rows = []
            for x in work(*(c.to_pylist() for c in batch.columns)):
                if isinstance(x, pa.Table):
                    yield from x.to_batches()
                else:
                    rows.append(x)
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], schema=out)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def count_rows(df: DataFrame, make: Callable[[], Callable[..., dict]], keys: str) -> DataFrame:
    """Like a grouped count whose keys come from Python: ``make()`` returns a function of the batch's columns that
    returns ``{key tuple: n}``. Counts are added up per task before the shuffle."""
    names = [x.strip().split(" ", 1)[0] for x in keys.split(",")]
    types = [_ARROW[x.strip().split(" ", 1)[1].strip()] for x in keys.split(",")] + [pa.int64()]
    schema = f"{keys}, n bigint"
    out = pa.schema([(n, t) for n, t in zip([*names, "n"], types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, total = make(), {}
        for batch in batches:
            for k, n in work(*(c.to_pylist() for c in batch.columns)).items():
                total[k] = total.get(k, 0) + n
            if len(total) > 400_000:  # hand on partial sums, so that memory stays bounded
                yield flush(total)
                total = {}
        if total:
            yield flush(total)

    def flush(total: dict) -> pa.RecordBatch:
        cols = [*zip(*total.keys()), list(total.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], schema=out)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def columns_of(schema: str) -> list[str]:
    return [x.strip().split(" ", 1)[0] for x in schema.split(",")]


def arrow_table(rows: Iterable[tuple | pa.Table], schema: str) -> pa.Table:
    """Rows, or tables, as one table of the schema, also if there are none."""
    names, rows = columns_of(schema), list(rows)
    tables = [x for x in rows if isinstance(x, pa.Table)]
    cols = list(zip(*(x for x in rows if not isinstance(x, pa.Table)))) or [()] * len(names)
    return pa.concat_tables([pa.table([pa.array(c, _ARROW[x.strip().split(" ", 1)[1].strip()]) for c, x in zip(cols, schema.split(","))], names=names), *tables])


def int_lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists, without a Python number each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
