"""Shared pieces of the training-data operators: Arrow maps, bounded look-ups, samples, and the shared folder of the rest of the library.

Defined cases: maps take rows as they are, repeated ones as often as they stand there; a null text is empty, a null key stays null; an
empty table gives no batch, so that what a map tells at a task's end is told of none; sample_rows takes all rows that share a key, or none."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.plans.shared import numbered, scratch, shared_root, stored  # noqa: F401 (operators take them from here)

# White space as in Unicode-aware patterns of the tokenizers (\s), which leaves out \x1c-\x1f.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Rows in one Arrow batch; a batch of long texts stays small enough for a Python worker.
ROWS_PER_BATCH = 500


def joined_anew(totals: DataFrame, key: str) -> DataFrame:
    """totals, which are aggregated by a whole-number key, with the key computed again (its complement twice): a join back by it then shuffles both sides, and
    Spark can split a hot key's rows of the other side over tasks. Without that it takes the totals as they lie, and can not."""
    return totals.withColumn(key, F.bitwise_not(F.bitwise_not(F.col(key))))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that long texts do not fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def release() -> None:
    """To be called when a task ends: what its Python worker has freed goes back to the system, for the worker stays and other stages need the memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, ddl: str, start: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """mapInArrow over columns as Python lists. start() runs once in each task and returns the function of a batch;
    strings arrive as they are, binary as bytes."""
    small_batches(df.sparkSession)
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in batches:
            f = f or start()
            out = f({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)})
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in schema], schema=schema)
        f = out = b = None
        release()

    return df.mapInArrow(run, ddl)


def bytes_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text as binary); null text becomes empty. Other columns, whatever their names, are left out."""
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def sample_rows(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """About `rows` rows, chosen by a hash of the key, so that every run chooses the same; all rows of a small table."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < F.lit(int((1 << 30) * rows / total)))
