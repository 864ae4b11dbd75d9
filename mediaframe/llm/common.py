"""What the operators of this package share: tables, checkpoints, bounded batches of rows in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.session import cut_lineage

SLICE_BYTES = 4 << 20
SLICE_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so later steps start from files that outlive an executor."""
    return cut_lineage(df)


def slices(batch: pa.RecordBatch, text: int, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """``batch`` cut so that a slice holds about ``most_bytes`` of column ``text``, one row at least."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = size = 0
    for i, length in enumerate(lengths):
        if i > start and (size + length > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += length
    yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: int) -> list[str | None]:
    return batch.column(text).to_pylist()


def bytes_of(batch: pa.RecordBatch, text: int) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [b or b"" for b in batch.column(text).cast(pa.large_binary() if pa.types.is_large_string(batch.column(text).type) else pa.binary()).to_pylist()]


def map_texts(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]], fields: list[T.StructField]) -> DataFrame:
    """One row per row of ``df``: the id and the columns that ``make()(slice)`` returns for a slice of
    (id, text) rows. ``make`` runs once per task, so it can hold a task's own tables and caches. Only the
    id and the text leave the scan, so other columns and their names don't matter."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *fields])
    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, 1):
                found = work(part)
                arrays = [part.column(0), *(found[f.name] for f in fields)]
                yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, to_arrow(f.dataType)) for a, f in zip(arrays, schema.fields)], names=schema.names)

    return source.mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary()}[kind.simpleString()]


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))
