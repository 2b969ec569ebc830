"""Exact dedup as a stateful stream.

Texts are equal when their bytes are, after deleting ASCII white space.  Each
row is read and hashed once, into a table of entries: digest, identifier, length
and locator (file and row index).  A Structured Streaming aggregation over the
entries, without a watermark, keeps in RocksDB one state entry for each digest
for ever: the identifier and locator of the row that stays, and the size of the
group.  Rows that hit an entry are then compared with the keeper's full bytes;
only texts of groups of two or more are read again, through their locators.  A
digest that two texts share (never seen with SHA-256) has its rows grouped anew
by whole text.

State lives in a folder that the caller names: ``arrive`` can be called again
with further rows, which meet the state of all former ones, and a stream that
was cut off goes on where its checkpoint stands.  A later row can take a
group's place from an earlier one; an arrival's decisions are those at its time.

Defined results: a null text is the empty text; empty texts are equal to one
another and to texts of white space; texts of any length are hashed and compared
whole; ids are whole numbers, and a null id sorts after all others; of rows
that tie in all (repeated rows) the one with the smallest locator stays; an
empty table gives an empty result; other columns, whatever their names, are
passed by, or kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import BROADCAST_BYTES, OWN, located, new_folder, sized, spread_join, without_own, written

#: Rows of one keeper that are compared in one task before its text is repeated for a further one.
ROWS_PER_COPY = 64
#: Files of entries that the stream takes in one batch.
FILES = 4096
#: State on disk; no files made large in advance, which small state partitions would never fill, and small buffers: an
#: executor has one for each of its state partitions, outside the JVM's heap, until the store is unloaded.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
ENTRY = "doc_id long, n_cp int, digest binary, file string, row long"
STATE = "digest binary, keeper struct<less:int,no_id:boolean,doc_id:long,file:string,row:long>, group_size long"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def entries(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """A row of ids and digests for each document; ``docs`` has a locator."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce("text", F.lit(""))).alias("n_cp"),
        digest(normalised(F.col("text"))).alias("digest"),
        F.col(OWN + "file").alias("file"),
        F.col(OWN + "row").alias("row"),
    )


def rank() -> Column:
    """Sorts the keeper of a group to the front."""
    return F.struct((-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")


def stream_state(spark: SparkSession, folder: str, files: int = FILES) -> None:
    """Run the stream until there are no more entries in ``folder``; each batch writes the state entries that it changed.

    The state store's settings hold for a session of the stream's own.
    """
    own = spark.newSession()
    for key, value in (STATE_STORE | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
        own.conf.set(key, value)
    arrivals = own.readStream.schema(ENTRY).option("maxFilesPerTrigger", files).parquet(f"{folder}/entries/*")
    state = arrivals.groupBy("digest").agg(F.min(rank()).alias("keeper"), F.count("*").alias("group_size"))
    (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/progress")
        .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/state/batch={batch}"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """The last written entry of each digest."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], STATE)
    return (
        spark.read.schema(STATE + ", batch long").parquet(f"{folder}/state")
        .groupBy("digest")
        .agg(F.max(F.struct("batch", "group_size", "keeper")).alias("e"))
        .select("digest", "e.keeper", "e.group_size")
    )


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``places`` (``file`` and ``row``, written) with ``body``, their text; from ``docs``, or else from the files themselves."""
    def read(rows: DataFrame) -> DataFrame:
        at = rows.select(F.col(OWN + "file").alias("file"), F.col(OWN + "row").alias("row"), "text")
        return at.join(sized(places, 400), ["file", "row"]).withColumn("body", normalised(F.col("text"))).drop("text")

    own = docs.select(F.col(OWN + "file").alias("file")).distinct()
    others = [r.file for r in places.select("file").distinct().join(own, "file", "left_anti").collect()]  # of former arrivals
    found = read(docs)
    return found.unionByName(read(located(docs.sparkSession.read.schema("text string").parquet(*others)))) if others else found


def decide(docs: DataFrame, own: DataFrame, everything: DataFrame, state: DataFrame) -> DataFrame:
    """own: written entries of ``docs`` (which has a locator); everything: those of all arrivals; state: written.

    A row for each of ``own``: the entry, ``keep_id``, ``group_size``, ``kept``.
    """
    groups = written(state.filter("group_size > 1"), "dedup-groups")
    if groups.count() * 400 <= BROADCAST_BYTES:
        rows = own.join(F.broadcast(groups), "digest", "left")
    else:
        rows = spread_join(own, groups, ["digest"], "group_size", "left")
    is_keeper = F.col("keeper").isNull() | ((F.col("keeper.file") == F.col("file")) & (F.col("keeper.row") == F.col("row")))
    rows = written(rows.withColumn("kept", is_keeper), "dedup-rows")

    copies = F.ceil(F.col("group_size") / ROWS_PER_COPY).cast("int").alias("copies")
    hits = rows.filter("not kept").select("digest", "file", "row", F.lit(False).alias("keeper"), copies)
    first = groups.select("digest", "keeper.file", "keeper.row", F.lit(True).alias("keeper"), copies)
    if own is not everything:
        first = first.join(hits.select("digest").distinct(), "digest", "left_semi")
    bodies = _texts(docs, written(hits.unionByName(first), "dedup-places"))
    one = bodies.filter("not keeper").withColumn("copy", F.pmod(F.xxhash64("file", "row"), F.col("copies")).cast("int")).select("digest", "copy", "body")
    other = bodies.filter("keeper").select("digest", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("body").alias("kept_body"))
    clash = written(one.join(other, ["digest", "copy"]).filter(F.col("body") != F.col("kept_body")).select("digest").distinct(), "dedup-clashes")

    wanted = ["doc_id", "digest", "n_cp", "file", "row", F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "kept"]
    if clash.isEmpty():
        return rows.select(*wanted)
    anew = everything.join(clash, "digest", "left_semi")
    anew = anew.join(_texts(docs, written(anew.select("file", "row"), "dedup-places")), ["file", "row"])
    anew = written(anew, "dedup-anew")
    anew = anew.join(anew.groupBy("body").agg(F.min(rank()).alias("keeper"), F.count("*").alias("group_size")), "body").withColumn("kept", is_keeper)
    if own is not everything:
        anew = anew.join(own.select("file", "row"), ["file", "row"], "left_semi")
    return rows.join(clash, "digest", "left_anti").select(*wanted).unionByName(anew.select(*wanted))


def arrive(docs: DataFrame, folder: str, digest: Callable[[Column], Column] = sha256, files: int = FILES) -> DataFrame:
    """Rows that arrive at the state in ``folder`` (a new one, or that of former arrivals): a decision on each of them."""
    spark, docs = docs.sparkSession, located(docs)
    path = f"{folder}/entries/{new_folder(spark, '').rpartition('-')[2]}"
    entries(docs, digest).write.option("compression", "zstd").parquet(path)
    stream_state(spark, folder, files)
    own = spark.read.schema(ENTRY).parquet(path)
    everything = spark.read.schema(ENTRY).parquet(f"{folder}/entries/*")
    only = {f.rsplit("/", 2)[1] for f in everything.inputFiles()} <= {path.rsplit("/", 1)[1]}
    return decide(docs, own, own if only else everything, written(latest_state(spark, folder), "dedup-keepers"))


def dedup_folder(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The Parquet files at ``path`` (a folder, or a single file) as one arrival at a new state."""
    return arrive(spark.read.parquet(path), new_folder(spark, "dedup"), digest)


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that exact dedup drops; its columns stay as they are."""
    docs = located(docs)
    dropped = arrive(docs, new_folder(spark, "dedup")).filter(~F.col("kept")).select(F.col("file").alias(OWN + "file"), F.col("row").alias(OWN + "row"))
    return without_own(docs.join(sized(written(dropped, "dedup-dropped"), 400), [OWN + "file", OWN + "row"], "left_anti"))
