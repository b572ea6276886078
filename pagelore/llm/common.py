"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.session import ship

#: Rows and bytes of one Arrow batch. Texts may be long, so batches stay small.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a batch of long texts fits a Python worker; send the package along.

    Spark reads the two settings when a plan runs, and what operators return runs later, so they stay set in the session;
    smaller ones of the caller are left as they are.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)  # None where nobody has set it
        if not (now and now.isdecimal() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that hold for what runs within the block, and are put back after it, whatever happens there."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_HELD: dict = {}


def held(key: tuple, make: Callable):
    """What a worker process keeps between tasks: one thing at a time, so that one operator's tables are gone when another's come."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Memory that is free within this process goes back to the machine, which the executor's own heap shares with it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries than GNU's have no such call
        ctypes.CDLL(None).malloc_trim(0)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder the cluster shares; a folder of our own only where none is set and the master is local."""
    sc: SparkContext = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="pagelore-")
    atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_root(spark)}/{what}-{uuid.uuid4().hex}"


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Spark's own file system deletes the folder when the application ends: a DataFrame that was returned may read it until then."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared folder through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. The table goes when the application ends."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that are needed only until the block ends, or until they are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, what: str) -> DataFrame:
        path = fresh_path(self.spark, what)
        self.paths[path] = None
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for p, t in self.paths.items() if any(t is x for x in tables)]:
            remove_path(self.spark, path)
            del self.paths[path]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            remove_path(self.spark, path)
        self.paths = {}


def id_hash_mod(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
