"""What the operators of this package share: Arrow mapping, byte words, code shipping."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastro.session import ship

#: The white space of all contracts: blank and code points 9 to 13.
SPACE = r"\x20\x09-\x0D"

#: Rows and bytes of an Arrow batch that are turned into Python objects at once, so that long texts stay few in memory.
SLICE_ROWS, SLICE_BYTES = 1024, 2 << 20

def map_rows(df: DataFrame, schema: str, fn: Callable[[list], list], setup: Callable[[], object] | None = None) -> DataFrame:
    """Apply ``fn(columns) -> columns`` to small slices of rows, by Arrow.

    ``setup`` runs once per task and its value is passed as a second argument. Columns come and go as
    Python lists (or as Arrow or numpy arrays on the way out). No row is kept between slices.
    """
    ship(df.sparkSession)
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # many small objects, no cycles
        try:
            state = setup() if setup else None
            for batch in batches:
                for part in slices(batch):
                    columns = [c.to_pylist() for c in part.columns]
                    out = fn(columns, state) if setup else fn(columns)
                    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(out, target)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)
        finally:
            state = None
            gc.enable()
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: a worker waits for its next task with what it holds, beside the JVM that then works alone."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library than glibc


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Halve a batch until each part is small, or one row."""
    n = batch.num_rows
    if n > 1 and (n > SLICE_ROWS or batch.nbytes > SLICE_BYTES):
        yield from slices(batch.slice(0, n // 2))
        yield from slices(batch.slice(n // 2))
    elif n:
        yield batch


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def ddl_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def hex_digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keep_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order, then what the operator added."""
    return out.select(*docs.columns, *[c for c in out.columns if c not in docs.columns])


def free_name(df: DataFrame, name: str) -> str:
    """A helper column's name that the input does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
