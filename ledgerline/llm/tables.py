"""Reading the corpus tables, and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that a Python worker gets at a time: texts can be long, and ten thousand of them fill a worker's memory.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where that is unset, on one machine (tests), a new local folder."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    made = spark.sparkContext.getCheckpointDir()
    if known is None and made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="ledgerline-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known or made)
    return known or made


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/ledgerline-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there, and an executor's loss costs nothing. The
    files stay as long as the folder does; what an iteration writes goes to table() instead."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """The same as Parquet, and its path for remove()."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def crc_mod(doc_id: Column | str, m: int) -> Column:
    """crc32 of the id's text, modulo m; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % F.lit(m)


def uniform(key: Column, seed: int, buckets: int = 1 << 30) -> Column:
    """A whole number in [0, buckets), as good as random but fixed by key and seed."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(buckets))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df lacks."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name
