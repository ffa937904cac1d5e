"""Tables written in the folder that the cluster shares, to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """A folder of this process under spark.checkpoint.dir (a local one only in a local session that has none)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tidewright-checkpoints"
    if base not in _ROOTS:
        _ROOTS[base] = f"{base.rstrip('/')}/tidewright-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _ROOTS[base])
    return _ROOTS[base]


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended; its folder goes with the checkpoints
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: what follows reads it as often as it likes, and survives lost executors."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
