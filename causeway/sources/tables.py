"""Tables in the folder that driver and executors share, to cut a lineage that grows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df below spark.checkpoint.dir and read it back; what is written goes when the session's JVM ends.

    A local session that names no folder gets a temporary one; a cluster must name one that all executors share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="causeway-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/causeway/{context.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = folder.getFileSystem(context._jsc.hadoopConfiguration())
    fs.mkdirs(folder)  # what is not there is not marked
    fs.deleteOnExit(folder)
    path = f"{own}/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Deal rows by keys over a stated number of tasks, which AQE does not merge: for heavy work on few bytes."""
    spark = df.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
