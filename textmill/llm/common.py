"""Helpers that the operators of this subpackage share.

All operators take a DataFrame and the names of the columns they need, project those to private
names at once (extra columns, whatever they are called, never reach the work), and return a fixed
schema.  A null text counts as the empty text.  Rows that repeat are kept as rows.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session is gone already; only disk space is at stake
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/textmill/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def saved(df: DataFrame, name: str, like: DataFrame | int | None = None) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and returns the table read back.

    like: a saved table that df is no larger than, or its bytes; they, not the session's partitions, then say how many files there are.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if like is not None:
        size = like if isinstance(like, int) else bytes_of(like)
        df = df.coalesce(max(LEAST_FILES, -(-size // FILE_BYTES)))
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


#: Files of a table whose size is known beforehand.
LEAST_FILES, FILE_BYTES = 4, 2 << 20


def bytes_of(df: DataFrame) -> int:
    """Size of a saved table."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths[df])
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


#: Where saved tables are.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def free(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more: what was made of them has been saved itself."""
    for df in tables:
        if path := _paths.pop(df, None):
            _drop(df.sparkSession, path)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def learnable(id_column: str = "doc_id") -> Column:
    """Rows that models may learn from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 3 != 1


def open_fs(uri: str):
    """File system and path of a URI, for Python code on driver or executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


#: What a worker process holds beyond a task, by owner, with the function that frees it.
_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, release: Callable[[], None] | None = None) -> None:
    """Called at the start of a task's Python code: what other operators left in this worker process is freed."""
    others = [x for x in _held if x != owner]
    for x in others:
        _held.pop(x)()
    if others:
        trim()
    if release:
        _held[owner] = release


def trim() -> None:
    """Gives freed memory back to the machine."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it keeps


#: Rows in an Arrow batch where the session has Spark's default: a batch of texts stays at a few megabytes.
BATCH_ROWS, SPARK_ROWS = "2000", "10000"


def arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in smaller batches; a worker process that idles after a task keeps none of its memory."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == SPARK_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def tidy(parts):
        yield from run(parts)
        trim()

    return df.mapInArrow(tidy, schema)
