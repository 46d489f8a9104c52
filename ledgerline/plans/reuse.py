"""Tables that several branches of a plan read: written once as Parquet to the folder that the cluster shares
(spark.checkpoint.dir), so that no branch computes them again, later reads take the columns and rows they need, and a lost
executor costs nothing. They are removed when the session ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session in spark.checkpoint.dir, removed at the end. Where that is unset, a session on one machine
    takes a local folder; on a cluster there is then no place that executors are known to share."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    known = known or tempfile.gettempdir()
    if spark.sparkContext.applicationId not in _MADE:
        path = f"{known.rstrip('/')}/ledgerline-{uuid.uuid4().hex}"
        _MADE[spark.sparkContext.applicationId] = path
        atexit.register(_remove, spark, path)
    return _MADE[spark.sparkContext.applicationId]


_MADE: dict[str, str] = {}


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped: the cluster's folder goes with it
        return
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession) -> str:
    """A new path there."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as such a table; df itself if it is one."""
    if getattr(df, _CUT, False):
        return df
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(out, _CUT, True)
    return out


_CUT = "_ledgerline_table"
