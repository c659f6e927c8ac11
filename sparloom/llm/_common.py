"""What the operators of this package share: staged tables, Arrow batches, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task handles at a time; longer documents are handled alone.
CHUNK_BYTES = 1 << 20

_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a temporary folder takes its place, but only if Spark runs in
    one process; on a cluster executors would write where nobody reads.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Writes df once as Parquet into the shared folder and reads it again.

    This cuts the lineage, so that a lost executor costs no more than its own
    tasks, and Python work above it runs once. release() removes such tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables from which nothing will be read again: what was made of them is written."""
    for t in tables:
        path = getattr(t, "_sparloom_path", None)
        if path in _staged:
            _staged.remove(path)
            _delete(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes all staged tables, when no result that reads them is needed any more."""
    while _staged:
        _delete(spark, _staged.pop())


def free_name(taken: list[str], name: str) -> str:
    """`name`, with as many underscores before it as make it differ from the taken ones (Spark's names ignore case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """df with columns of the given names renamed, and all its column names now, in order.

    df.select(*[F.col(now).alias(was) for now, was in zip(names now, df.columns)]) brings them back.
    """
    lower = {n.lower() for n in names}
    now: list[str] = []
    for c in df.columns:
        now.append(free_name([*now, *df.columns, *names], c) if c.lower() in lower else c)
    return df.toDF(*now), now


def back(df: DataFrame, now: list[str], was: list[str]) -> DataFrame:
    """Of df the columns `now` under their names `was`."""
    return df.select(*[F.col(f"`{n}`").alias(w) for n, w in zip(now, was)])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The texts as UTF-8; null as empty."""
    return [x or b"" for x in column(batch, name).cast(pa.binary()).to_pylist()]


def as_text(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in column(batch, name).to_pylist()]


def out_batch(batch: pa.RecordBatch, carry: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The carried columns of batch and new ones."""
    return pa.RecordBatch.from_arrays([column(batch, c) for c in carry] + list(new.values()), [*carry, *new])
