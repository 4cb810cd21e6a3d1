"""What the operators of this subpackage share: shared tables, guarded broadcasts, text as bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as words

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table of one short row per group may be broadcast.
BROADCAST_ROWS = 100_000
#: Text bytes that a numpy kernel works on at once (one longer text is taken alone).
CHUNK_BYTES = 2_000_000
#: Bytes of an Arrow batch on its way to a worker.
BATCH_BYTES = 4_000_000


_owner: str | None = None
_kept: dict = {}


def settle(owner: str) -> None:
    """In a worker, before a task of the operator ``owner``: keep little memory that nothing needs.

    Workers live on from task to task. Large arrays and Arrow's buffers go back to the system when they are freed,
    and what another operator keeps for its next task (``keep``) goes when a task of this one starts. Only functions
    that run on executors call this; the driver's allocator is left alone.
    """
    global _owner
    if owner == _owner:
        return
    libc = ctypes.CDLL(None) if sys.platform == "linux" else None
    if _owner is None and libc:
        with contextlib.suppress(AttributeError):
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())
    _owner = owner
    _kept.clear()
    words.forget()
    gc.collect()
    with contextlib.suppress(AttributeError):  # not in every C library
        libc and libc.malloc_trim(0)


def keep(key, make: Callable):
    """What ``make`` gives, kept by this worker until a task of another operator starts in it."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session without one gets a temporary folder; a cluster must name one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="causeway-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_table_path(spark: SparkSession, label: str) -> str:
    """A new folder below the session's own one, which goes when the session's JVM ends."""
    own = f"{shared_dir(spark).rstrip('/')}/causeway/{spark.sparkContext.applicationId}"
    path, fs = _path(spark, own)
    fs.mkdirs(path)  # what is not there is not marked
    fs.deleteOnExit(path)
    return f"{own}/{uuid.uuid4().hex}/{label}"


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._causeway_table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables of which nothing that is still to run reads."""
    for t in tables:
        path, fs = _path(t.sparkSession, t._causeway_table)
        fs.delete(path, True)


def map_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes, which 10,000 long texts are not.

    The session's bound is lowered to BATCH_BYTES unless the user has lowered it already; Spark reads it when the
    plan runs, so it cannot be put back here.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int((conf.get(name, None) or "67108864").rstrip("b")) >= 67108864:
        conf.set(name, str(BATCH_BYTES))

    owner = f.__module__

    def run(batches):
        settle(owner)
        yield from f(batches)

    return df.mapInArrow(run, schema)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which else stay until the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def guarded(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialised table for broadcast if it is counted to be small; else leave the join to Catalyst."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def fraction(*cols) -> "F.Column":
    """A repeatable number in [0, 1) from the values of columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def crc_mod(col, n: int) -> "F.Column":
    """crc32 of the value as text, modulo n; a null id counts as remainder of the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(col).cast("string"), F.lit("")), "utf-8")), F.lit(n))


def as_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and where each text starts (one more at the end); null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES):
    """Parts of a batch that hold about ``limit`` text bytes each, in order."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)] if len(size) else [0, 0]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
