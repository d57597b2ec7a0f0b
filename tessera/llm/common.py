"""Helpers shared by the corpus operators: the shared folder, byte views of texts and packed arrays."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

#: Lower-cases A-Z only; every other byte stays.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


#: Tables written by the operators that are running, innermost last.
_written: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and survives lost executors. The table goes
    when the application ends, and before that when a tidy operator no longer needs it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a table of ours from the shared folder, through Hadoop's file system so that any store works."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that, when its plan is ready, removes the tables it has stored but for those that the plan reads."""

    @functools.wraps(operator)
    def run(*args, **options) -> DataFrame:
        _written.append([])
        try:
            out = operator(*args, **options)
        finally:
            mine = _written.pop()
        used = {f.rsplit("/", 2)[-2] for f in out.inputFiles()} if mine else set()
        for path in mine:
            if path.rsplit("/", 1)[-1] not in used:
                dropped(out.sparkSession, path)
            elif _written:
                _written[-1].append(path)
        return out

    return run


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with each row's number, from 0, among the rows of equal keys (none null): a task numbers its own rows and adds the
    counts of the tasks before it, so a hot key is spread over all tasks that have it. Rows of one key are told apart by
    place alone, which df's stored copy fixes."""
    held = stored(df.withColumn("__task", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(*keys, "__task").agg(F.count("*").alias("__n"))
    counts = counts.select(*keys, "__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = held.withColumn("__own", F.row_number().over(Window.partitionBy(*keys, "__task").orderBy("__task")) - 1)
    return own.join(counts, [*keys, "__task"]).withColumn(name, F.col("__base") + F.col("__own")).drop("__task", "__own", "__base")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_bytes(column: str) -> F.Column:
    """A text as UTF-8 bytes; null becomes the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def rows_of(batches: Iterable[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose binary columns hold about `most` bytes, so that a kernel's memory is bounded."""
    for batch in batches:
        binary = next((c for c in batch.columns if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type)), None)
        if binary is None or batch.num_rows == 0:
            yield batch
            continue
        size = np.cumsum(np.asarray(pa.compute.binary_length(binary).fill_null(0)), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end
