"""Shared pieces of the corpus operators: table access, intermediate tables, internal column names."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of white space, and a word, as every operator here reads them.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Folder names of the tables that materialize() wrote.
_made: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def internal(df: DataFrame, *stems: str) -> list[str]:
    """Column names that do not clash with those of df, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own under a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="wayline-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again. It goes when the driver's JVM ends."""
    return materialize_all([df], name)


def materialize_all(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """One table of all parts, at least one, each written before the next is asked for."""
    own = f"{name}-{uuid.uuid4().hex}"
    for k, df in enumerate(parts):
        if not k:
            spark, schema = df.sparkSession, df.schema
            path = f"{shared_dir(spark)}/{own}"
            _made.add(own)
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives the memory it has freed back to the system: workers outlive their tasks, and what
    an idle one keeps is missing in the stages that follow."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
        if trim:
            trim(0)

    return whole


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so as the driver collects garbage."""
    for _ in range(2):  # the first lets go of what Python still names in the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote and nothing reads any more; other tables stay."""
    spark = df.sparkSession
    for path in {p for p in (f.rsplit("/", 1)[0] for f in df.inputFiles()) if p.rsplit("/", 1)[-1] in _made}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
