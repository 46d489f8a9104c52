"""Exact deduplication as a stateful stream.

Arriving texts are logged as (digest, doc_id, content locator); the locator is the file and row that hold the text. A
streaming aggregation keeps one state row for each digest, in RocksDB on the executors' disks with its changelog in the
shared folder, without a watermark and so without expiry: the largest id seen, the locator of its content, and the
number of arrivals. Tasks aggregate before the shuffle, so a digest that a third of all rows share sends one row per
task. A digest that arrived more than once, in one arrival or in several, is a hit: its texts are read from where the
locators lead and compared by their full bytes, which is a grouping by the bytes themselves, begun in each task, so that
copies inside a task meet there and one of them travels. Texts that differ under one digest form groups of their own.
The same state folder can be fed again, and old groups grow.

Rows learn their group by a join of digests and ids, no texts; digests of many rows are joined from a bounded table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.ranking import hot_join
from ledgerline.llm.tables import cut, fresh, remove, scratch

#: State on disk, with a bound on what all stores of an executor hold in memory. A store is closed when its batch is
#: committed: arrivals come in few large batches, and every open store keeps some MB on its executor's disk.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Hit digests (some 80 bytes each in a task) that are sent to the scan of the texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
LOG = "digest binary, doc_id long, sha binary, file string, row long"
KNOWN = "digest binary, keep_id long, locator struct<file: string, row: long>, n long, batch int"


def same(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class Moved(ValueError):
    pass


class StreamingDedup:
    """State over one folder. arrive() logs rows and lets the stream take them up; state() is what it knows; groups() has
    every row that ever arrived, checked on its bytes."""

    def __init__(self, spark: SparkSession, folder: str, digest=sha256):
        self.spark, self.folder, self.digest = spark, folder, digest

    def arrive(self, docs: DataFrame) -> None:
        """docs: doc_id long, text. Texts as files hold them (rows may be left out) stay where they are, and the state leads
        to them; a table that is read from no files becomes one in this folder."""
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
        try:
            held = docs.select("doc_id", "text", *place)
        except Exception as e:  # the hidden column exists for file scans only
            if "_metadata" not in str(e):
                raise
            part = f"{self.folder}/content-{uuid.uuid4().hex}"
            docs.select("doc_id", "text").write.parquet(part)
            held = self.spark.read.schema("doc_id long, text string").parquet(part).select("doc_id", "text", *place)
        text = same(F.col("text"))
        sha = F.lit(None).cast("binary") if self.digest is sha256 else sha256(text)
        held.select(self.digest(text).cast("binary").alias("digest"), "doc_id", sha.alias("sha"), "file", "row").write.mode("append").parquet(f"{self.folder}/log")
        self._take_up()

    def _take_up(self) -> None:
        spark = self.spark
        before = {k: spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            spark.conf.set(k, v)
        try:
            arrived = spark.readStream.schema(LOG).parquet(f"{self.folder}/log")
            known = arrived.groupBy("digest").agg(
                F.max("doc_id").alias("keep_id"), F.max_by(F.struct("file", "row"), F.struct("doc_id", "file", "row")).alias("locator"), F.count("*").alias("n")
            )
            table = f"{self.folder}/known"
            query = (
                known.writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.folder}/stream")
                .trigger(availableNow=True)
                .foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{table}/batch={k}"))  # the same batch again: the same folder
                .start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")

    def state(self) -> DataFrame:
        """digest, keep_id, locator, n: the last word of the stream on each digest."""
        said = self.spark.read.schema(KNOWN).parquet(f"{self.folder}/known")
        return said.groupBy("digest").agg(F.max_by("keep_id", "n").alias("keep_id"), F.max_by("locator", "n").alias("locator"), F.max("n").alias("n"))

    def content(self) -> DataFrame:
        """doc_id, text, digest, locator of every row that arrived, read from the files that the locators name."""
        files = [r.file for r in self.log().select("file").distinct().collect()]  # the files' names, which a scan of them lists too
        text = same(F.col("text"))
        return self.spark.read.schema("doc_id long, text string").parquet(*files).select(
            F.col("doc_id"), text.alias("text"), self.digest(text).cast("binary").alias("digest"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator")
        )

    def groups(self) -> DataFrame:
        """digest, doc_id, sha, locator, keep_id, keep_at (locator of the row that stays), group_size of every row.
        Raises Moved if the texts of hits are not where their locators lead."""
        state = cut(self.state())
        hits = state.where("n > 1").select("digest", F.col("n").alias("_rows"))
        n, rows = state.where("n > 1").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        log = self.log().select("digest", "doc_id", F.coalesce("sha", "digest").alias("sha"), F.struct("file", "row").alias("locator"))
        known = state.withColumnsRenamed({"locator": "keep_at", "n": "group_size"})
        if not n:
            return hot_join(log, known, "digest", "group_size")
        content = self.content()
        # beyond the bound, digests of many rows still go to the scan, where one text of a task stands for its copies there
        hit = hot_join(content, hits, "digest", "_rows", small=BROADCAST_ROWS).drop("_rows")
        texts = cut(hit.groupBy("digest", "text").count().groupBy("digest").agg(F.count("*").alias("texts"), F.sum("count").alias("n")))
        if (texts.agg(F.sum("n")).first()[0] or 0) < rows:
            raise Moved("texts of logged rows are not in their files")
        different = texts.where("texts > 1").select("digest")
        if not different.take(1):  # every hit was one text, byte for byte
            return hot_join(log, known, "digest", "group_size")
        apart = cut(content.join(different, "digest").drop("doc_id").join(log, ["digest", "locator"]))  # files may hold rows that did not arrive
        own = apart.groupBy("digest", "text").agg(
            F.max("doc_id").alias("keep_id"), F.max_by("locator", F.struct("doc_id", "locator")).alias("keep_at"), F.count("*").alias("group_size")
        )
        alone = hot_join(log.join(different, "digest", "left_anti"), known.join(different, "digest", "left_anti"), "digest", "group_size")
        return alone.unionByName(apart.join(own, ["digest", "text"]).drop("text"))


def groups(docs: DataFrame, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    Texts are equal when their bytes are; null counts as empty. The row with the largest id stays; of rows that share
    that id too, all are marked kept. Rows with a null id belong to their text's group and never stay, unless no row has
    an id. An empty table gives an empty result; other columns are not looked at. A table that is not as its files hold it
    (texts changed after the scan) is written to the shared folder first."""
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    columns = ("doc_id", "keep_id", "group_size", kept.alias("kept"), "sha")
    try:
        out = _judged(rows, digest, *columns)
    except Moved:
        out = _judged(written(rows), digest, *columns)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _judged(docs: DataFrame, digest, *columns) -> DataFrame:
    """These columns of StreamingDedup.groups() for docs alone, as a table; the stream's folder is gone then."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "dedup")
    if not docs.take(1):
        empty = spark.createDataFrame([], "digest binary, doc_id long, sha binary, locator struct<file: string, row: long>, keep_id long, keep_at struct<file: string, row: long>, group_size long")
        return empty.select(*columns)
    stream = StreamingDedup(spark, folder, digest)
    try:
        stream.arrive(docs)
        return cut(stream.groups().select(*columns))
    finally:
        remove(spark, folder)


def written(docs: DataFrame) -> DataFrame:
    path = scratch(docs.sparkSession, "texts")
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one for each text, with docs' columns. Of rows that share id and text, one stays: the one
    that the locator names. Null and empty texts are one text; a null id stays only where its text has no other. A table
    that is not as its files hold it is written to the shared folder first, and stays there for the result to be read from."""
    file, row = fresh(docs, "_file"), fresh(docs, "_row")
    place = {file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")}
    at = [F.col("locator.file").alias(file), F.col("locator.row").alias(row)]
    ids = F.col("doc_id").cast("long").alias("doc_id")
    try:
        held = docs.withColumns(place)
        stay = _judged(docs.select(ids, "text"), sha256, *at, (F.col("locator") == F.col("keep_at")).alias("kept"))
    except Exception as e:
        if not isinstance(e, Moved) and "_metadata" not in str(e):
            raise
        docs = written(docs)
        held = docs.withColumns(place)
        stay = _judged(docs.select(ids, "text"), sha256, *at, (F.col("locator") == F.col("keep_at")).alias("kept"))
    return held.join(stay.where("kept").drop("kept"), [file, row], "left_semi").drop(file, row)
