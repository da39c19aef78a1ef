"""Small helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Rows turned into Python objects at a time, so that one Arrow batch of long texts is never held twice.
STEP = 256


_KEPT: dict = {}


def worker_cache(key, make):
    """What a Python worker keeps from task to task: one thing at a time.

    Workers live on and serve one operator after the other; asking for another key drops what the
    operator before left, so that memory is bounded by the largest cache, not by their sum.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batch: pa.RecordBatch, step: int = STEP) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into slices of ``step`` rows."""
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """Values of a text column; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def raw_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    values = batch.column(column)
    wide = pa.types.is_large_string(values.type)
    return [x or b"" for x in values.cast(pa.large_binary() if wide else pa.binary()).to_pylist()]


def with_columns(df: DataFrame, columns: list[tuple[str, T.DataType]]) -> T.StructType:
    """Schema of ``df`` with further columns; a column of the same name is an error."""
    clash = {c.lower() for c in df.columns} & {n.lower() for n, _ in columns}
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    return T.StructType(df.schema.fields + [T.StructField(n, t) for n, t in columns])


def append(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], names=[*batch.schema.names, *columns]
    )


def replacing(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns an operator is about to write, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, label: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, f"__{label}"
    while name in taken:
        name += "_"
    return name


def aside(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but ``used`` under names that no operator writes, and what puts the names back.

    The columns of ``df`` must come first, in order, in what is put back; others are left out.
    """
    names = [c if c in used else f"column {i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), lambda out: out.select(*[F.col(f"`{n}`") for n in names]).toDF(*df.columns)
