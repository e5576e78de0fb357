"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import kept, release, shared_folder, table

__all__ = ["TASK_TABLES", "arrow_schema", "batch_of", "cut", "join_facts", "map_columns", "partitions", "pieces", "release", "shared_folder", "table", "task_memory"]


#: Writes df to the folder in spark.checkpoint.dir and reads it back, so that a lost executor costs no recomputation.
cut = kept


#: A key counts as hot if more than one row in HOT_ONE_IN has it, so that no more than HOT_ONE_IN keys do; each spreads over SALTS tasks.
HOT_ONE_IN, SALTS = 1000, 64


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """rows with what is known of their keys; facts has one row a key, and a column n: how many of rows have it.

    A hot key's rows are dealt over SALTS tasks by the hash of spread, and its fact goes to each of them. Only the hot keys
    are broadcast: HOT_ONE_IN rows at most, whatever the size of rows. Keys without facts drop out; the column n goes.
    """
    total = facts.agg(F.sum("n")).head()[0] or 0
    hot = F.col("n") > F.lit(max(1, total // HOT_ONE_IN))
    known = F.broadcast(facts.where(hot).select(*keys, F.lit(SALTS).alias("salts_")))
    salted = rows.join(known, keys, "left").withColumn("salt_", F.coalesce(F.pmod(F.xxhash64(spread), "salts_"), F.lit(0)).cast("int")).drop("salts_")
    held = facts.withColumn("salt_", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    return salted.join(held, [*keys, "salt_"]).drop("salt_")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Tables that worker processes fill during a task, such as hashes of words seen; they are emptied when the task ends.
TASK_TABLES: list[dict] = []


@contextlib.contextmanager
def task_memory():
    """Around a task's work: empties its tables afterwards and gives unused Arrow memory back, as workers are used again."""
    try:
        yield
    finally:
        for held in TASK_TABLES:
            held.clear()
        pa.default_memory_pool().release_unused()


def map_columns(df: DataFrame, fn: Callable[..., list], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """Arrow batches in and out; fn takes the columns as Python lists and returns the output columns as lists.

    setup runs once a task and its result is passed as the first argument.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            extra = (setup(),) if setup else ()
            for batch in batches:
                for part in pieces(batch):
                    out = fn(*extra, *(part.column(i).to_pylist() for i in range(part.num_columns)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; made on the driver, as parsing asks Spark."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl), prefers_large_types=False)


def batch_of(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    """One Arrow batch of rows given as sequences."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def pieces(batch: pa.RecordBatch, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about most_bytes, so that very long texts do not pile up in a Python worker."""
    n = max(1, -(-batch.nbytes // most_bytes))
    step = max(1, -(-batch.num_rows // n))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
