"""Shared plumbing of the text-corpus operators: inputs, the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (tests, a laptop) gets a temporary folder; on a cluster this is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        directory = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = directory.get() if directory.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomstone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/loomstone/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage with a table in the shared folder: a lost executor loses none of it."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Delete the files behind DataFrames from written(), once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# --- Arrow batches ------------------------------------------------------------------------------


def batched(df: DataFrame, keep: list[str], made: str, make: Callable[[pa.RecordBatch], tuple[list[int] | None, list]], start: Callable[[], None] | None = None) -> DataFrame:
    """df's columns in keep, untouched, beside new ones made from each Arrow batch.

    make: a batch -> (rows of the batch that the new rows belong to, or None for one each; the new columns). Ids that
    are kept never pass through Python, so null and 64-bit ones stay exact. start runs once a task.
    """
    fields = [df.schema[c] for c in keep] + list(T.StructType.fromDDL(made).fields)
    schema = T.StructType(fields)
    types = to_arrow_schema(T.StructType(fields[len(keep):])).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if start:
            start()
        for batch in batches:
            at, columns = make(batch)
            held = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            if at is not None:
                held = [c.take(pa.array(at, pa.int64())) for c in held]
            new = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*held, *new], names=[f.name for f in fields])

    return df.mapInArrow(run, schema)


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """A column without nulls as an array."""
    found = batch.column(batch.schema.get_field_index(name))
    return found.to_numpy() if isinstance(found, pa.ChunkedArray) else found.to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Sorted batches dealt anew: about so many rows at once, and never a part of a group of equal keys."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        k = np.stack([numbers(rows, c) for c in keys], 1)
        ends = np.flatnonzero((k[1:] != k[:-1]).any(axis=1))
        if len(ends):
            yield rows.slice(0, int(ends[-1]) + 1)
            rows = rows.slice(int(ends[-1]) + 1)
        held, n = rows.to_batches(), rows.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
