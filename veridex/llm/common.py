"""What the operators share: tables, the shared folder, files that executors write and read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in no fewer partitions than there are cores: a small table is often one file, which one task would read and work on."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; unset it will do only where all is one process, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'veridex-checkpoints')}"
    return found.rstrip("/")


def _path(spark: SparkSession, uri: str):
    """(Hadoop file system, Hadoop path) of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the application's own in the shared one, which goes when the application ends."""
    own = f"{shared_dir(spark)}/veridex-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        fs, path = _path(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _OWN.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table to the shared folder and read again: lost executors repeat nothing that lies before it."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veridex_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what saved() wrote, once nothing will read it any more."""
    for t in tables:
        fs, path = _path(t.sparkSession, t._veridex_path)
        fs.delete(path, True)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder, on any executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(lengths, limit: int):
    """(from, to) of runs of neighbours that sum to limit at most; what is longer alone is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def release() -> None:
    """Gives memory that a worker no longer uses back to the system, so that it doesn't count against its executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def rows_of(batches):
    """The rows of record batches as dicts, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        release()
