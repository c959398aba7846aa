"""Intermediate tables in the folder that driver and executors share.

The cluster names that folder in ``spark.checkpoint.dir``; only where the setting is
absent and the master is local (tests, a local shell) is a temporary folder chosen.  A table written there cuts
the lineage and outlives any executor, so a lost executor costs a re-read, not a re-run.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session's cluster."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="orrery-")
    return _local[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/orrery/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, codec: str = "lz4") -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of the copy."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
