"""Helpers shared by the training-data operators: the shared work folder, written tables, files."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship as ship_package


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, local mode (one machine, one JVM) gets a temporary folder; on a cluster that is an error, as any
    folder taken for granted could be a machine-local one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master.startswith("local[") or master == "local":
            found = tempfile.mkdtemp(prefix="ohlcraft-work-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage by a table that survives lost executors, and gives the planner the true
    size for its choice between broadcast and sort-merge joins.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    _delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """Work tables serve results that are read later; they go when the application ends."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(col: str):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def _remote(uri: str):
    """(file system, path) of a URI that is no local or mounted path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def write_file(uri: str, chunks) -> int:
    """Write the byte chunks to a new file, whole or not at all; a repeated attempt replaces it."""
    part, size = f"{uri}.{uuid.uuid4().hex}.part", 0
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(part), "wb") as out:
            for c in chunks:
                out.write(c)
                size += len(c)
        os.replace(_local(part), path)
        return size
    store, path = _remote(part)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as out:
        for c in chunks:
            out.write(c)
            size += len(c)
    store.move(path, _remote(uri)[1])
    return size


def read_range(uri: str, offset: int, length: int) -> bytes:
    """``length`` bytes of a file from ``offset``, fewer at its end."""
    if (path := _local(uri)) is not None:
        with open(path, "rb") as f:
            f.seek(offset)
            return f.read(length)
    store, path = _remote(uri)
    with store.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per application, in case their path doesn't have it.

    Texts go to Python in batches of a thousand, unless the session says otherwise: ten thousand long
    texts at once would not fit beside an executor's heap.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    ship_package(spark)


def forget_words() -> None:
    """Drop this worker's tokenizer cache, and give freed memory back: workers serve other stages after those that encode."""
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    if encoding := sys.modules.get(f"{__package__}.encoding"):
        encoding.encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library than glibc
            pass
