"""A table in partitions that batches are merged into, version by version.

    <path>/data/<id>/_part=<value>/   Parquet of one partition as some merge left it
    <path>/versions/<number>.json     the batches merged so far, the folder of each partition, the schema

A merge writes the partitions that it touches to a new folder and then publishes a version that names these and, for all other
partitions, the folders as they were. Before that nothing refers to the new folder, so a merge that stops anywhere leaves
the table as it was, and the next attempt starts anew. A batch that a version names is not merged again. Readers of an older
version keep it until vacuum() removes what no kept version names. Of two merges at once, one fails to publish."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.plans.reuse import cut

PART = "_part"


class Conflict(RuntimeError):
    """Another merge has published the version that this one was to become."""


@dataclass(frozen=True)
class Version:
    number: int
    batches: list[str]
    parts: dict[str, str]  # partition -> folder under the table's path
    schema: str
    by: str


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at(path))] if fs.exists(at(path)) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/versions") if n.endswith(".json"))


def latest(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The last version, or the one of that number."""
    known = _numbers(spark, path)
    if not known:
        raise ValueError(f"no table at {path}")
    text = spark.read.text(f"{path}/versions/{known[-1] if number is None else number:08d}.json", wholetext=True).first()[0]
    return Version(**json.loads(text))


def _publish(spark: SparkSession, path: str, version: Version) -> None:
    fs, at = _files(spark, path)
    fs.mkdirs(at(f"{path}/versions"))
    made, final = at(f"{path}/versions/.{uuid.uuid4().hex}"), at(f"{path}/versions/{version.number:08d}.json")
    out = fs.create(made)
    out.write(json.dumps(asdict(version)).encode())
    out.close()
    if fs.exists(final) or not fs.rename(made, final):
        fs.delete(made, False)
        raise Conflict(f"version {version.number} of {path} is there already")


def _label(by: str) -> Column:
    return F.coalesce(F.col(by).cast("string"), F.lit("none"))


def _write(spark: SparkSession, path: str, rows: DataFrame, by: str) -> dict[str, str]:
    """rows in a new folder, large partitions in several files; the folder of each."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.withColumn(PART, _label(by)).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{path}/{folder}")
    return {n[len(PART) + 1 :]: f"{folder}/{n}" for n in _names(spark, f"{path}/{folder}") if n.startswith(f"{PART}=")}


def create(path: str, rows: DataFrame, by: str) -> Version:
    """A new table of rows, in partitions by the column `by`, of which there are few (years)."""
    spark = rows.sparkSession
    version = Version(0, [], _write(spark, path, rows, by), rows.schema.json(), by)
    _publish(spark, path, version)
    return version


def read(spark: SparkSession, path: str, version: Version | None = None, only: set[str] | None = None) -> DataFrame:
    """The rows of a version (the last one), of some partitions or of all."""
    version = version or latest(spark, path)
    schema = StructType.fromJson(json.loads(version.schema))
    folders = [f"{path}/{f}" for p, f in sorted(version.parts.items()) if only is None or p in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def ingest(path: str, batch: DataFrame, batch_id: str, keys: list[str], from_feed: Column) -> Version:
    """Merges a batch as merge.merge_by_source does and returns the version that holds it: the present one if it does already.
    Rewritten are the partitions that take rows of the batch or hold fed rows that give way to it; of all others keys are
    read once. Columns that only the batch has are null in older rows. batch should be a table or a part of one: it is
    read several times."""
    spark = batch.sparkSession
    now = latest(spark, path)
    if batch_id in now.batches:
        return now
    held = read(spark, path, now)
    known = held.select(*keys, _label(now.by).alias(PART), from_feed.alias("_fed"))
    same_keys = cut(known.join(batch.select(*keys).distinct(), keys, "left_semi"))
    new = batch.join(same_keys.where("NOT _fed").select(*keys).distinct(), keys, "left_anti")
    touched = {r[0] for r in new.select(_label(now.by)).union(same_keys.where("_fed").select(PART)).distinct().collect()}
    current = read(spark, path, now, touched)
    old = current.where(from_feed).join(batch.select(*keys).distinct(), keys, "left_anti")
    merged = current.where(~from_feed).unionByName(old).unionByName(new, allowMissingColumns=True)
    schema = held.limit(0).unionByName(batch.limit(0), allowMissingColumns=True).schema
    parts = {p: f for p, f in now.parts.items() if p not in touched} | _write(spark, path, merged, now.by)
    version = Version(now.number + 1, [*now.batches, batch_id], parts, schema.json(), now.by)
    _publish(spark, path, version)
    return version


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes what the last `keep` versions do not name, merges that stopped half way among it; not while one runs. Returns
    the number of folders removed."""
    fs, at = _files(spark, path)
    known = _numbers(spark, path)
    named = {f for n in known[-keep:] for f in latest(spark, path, n).parts.values()}
    gone = 0
    for folder in _names(spark, f"{path}/data"):
        parts = [n for n in _names(spark, f"{path}/data/{folder}") if n.startswith(f"{PART}=")]
        unused = [n for n in parts if f"data/{folder}/{n}" not in named]
        for n in unused if len(unused) < len(parts) else ():
            fs.delete(at(f"{path}/data/{folder}/{n}"), True)
        if len(unused) == len(parts):
            fs.delete(at(f"{path}/data/{folder}"), True)
        gone += len(unused)
    for n in known[:-keep]:
        fs.delete(at(f"{path}/versions/{n:08d}.json"), False)
    return gone
