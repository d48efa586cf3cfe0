"""Exact deduplication as a stream over keyed state that never expires.

A pass over the texts writes their digests. A stream reads those and keeps, in a disk-backed (RocksDB) store, for each
digest the stable identifier of the copy that stays, where its content is, and how many copies there are. Partial
aggregation before the shuffle leaves one row per digest and task, so a group of copies of any size is cheap. Digests
seen twice are hits: the full bytes of all their copies are compared, and should two texts share a digest, they are
told apart by their bytes.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textshield import runtime
from textshield.llm import rows

#: Hits (32 bytes each) that are sent to the tasks as a set; beyond it, all texts are joined with them.
HITS_SENT = 200_000

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores takes megabytes
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.minDeltasForSnapshot": "10",
}


def normalised(text: bytes) -> bytes:
    """What makes texts equal: their bytes after lower-casing A-Z."""
    return text.lower()


def _keys(docs: DataFrame, digest_bytes: int, text: str, key: str) -> DataFrame:
    """Identifier, locator, full digest, and the digest that state is kept by, of each row."""
    located = rows.with_locator(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "locator")

    def make():
        return lambda batch: [pa.array([hashlib.sha256(normalised(x)).digest() for x in rows.raw(batch.column("text"))], pa.binary())]

    keys = rows.appended(located, [T.StructField("sha", T.BinaryType())], make, keep=["doc_id", "locator"])
    return keys.withColumn("digest", F.substring("sha", 1, digest_bytes) if digest_bytes < 32 else F.col("sha"))


def _stream(spark: SparkSession, source: str, folder: str, schema: T.StructType, files_at_once: int | None) -> DataFrame:
    """Run the stream over all there is and return the last state of each digest."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(schema)
        if files_at_once:
            reader = reader.option("maxFilesPerTrigger", files_at_once)
        state = reader.parquet(source).groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("top"), F.count(F.lit(1)).alias("n"))

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")  # a batch that is run again replaces itself

        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    shape = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("top", T.StructType([schema["doc_id"], schema["locator"]])), T.StructField("n", T.LongType()), T.StructField("batch", T.LongType())])
    if runtime.exists(spark, f"{folder}/state"):
        found = spark.read.schema(shape).parquet(f"{folder}/state")
    else:
        found = spark.createDataFrame([], shape)  # no row came, so no batch was run
    latest = found.groupBy("digest").agg(F.max(F.struct("batch", "n", "top")).alias("s"))
    return latest.select("digest", F.col("s.top.doc_id").alias("keep_id"), F.col("s.top.locator").alias("keep_locator"), F.col("s.n").alias("group_size"))


def _texts_of(docs: DataFrame, hits: DataFrame, digest_bytes: int, text: str, key: str, hits_sent: int) -> DataFrame:
    """Full normalised bytes of the rows whose digest is a hit."""
    located = rows.with_locator(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "locator")
    known = hits.select("digest").limit(hits_sent + 1).collect() if hits_sent else None
    few = None if known is None or len(known) > hits_sent else docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r[0]) for r in known))

    def run(batches):
        for batch in batches:
            full = [normalised(x) for x in rows.raw(batch.column("text"))]
            digest = [hashlib.sha256(x).digest()[:digest_bytes] for x in full]
            at = [i for i, d in enumerate(digest) if few is None or d in few.value]
            if at:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), batch.column("locator").take(pa.array(at)), pa.array([digest[i] for i in at], pa.binary()), pa.array([full[i] for i in at], pa.binary())], ["doc_id", "locator", "digest", "bytes"])

    found = located.mapInArrow(run, "doc_id long, locator string, digest binary, bytes binary")
    return found if few is not None else found.join(hits.select("digest"), "digest", "left_semi")


def _earlier_texts(spark: SparkSession, keys: DataFrame, text: str) -> DataFrame:
    """Full normalised bytes of rows of earlier calls (doc_id, locator, digest), read from where their locators say."""
    files = [r[0] for r in keys.select(F.substring_index("locator", "#", 1)).distinct().collect()]  # input files, not rows
    if not files:
        return spark.createDataFrame([], "doc_id long, locator string, digest binary, bytes binary")
    located = rows.with_locator(spark.read.parquet(*files).select(F.col(text).alias("text")), "locator").join(keys, "locator")

    def make():
        return lambda batch: [pa.array([normalised(x) for x in rows.raw(batch.column("text"))], pa.binary())]

    return rows.appended(located, [T.StructField("bytes", T.BinaryType())], make, keep=["doc_id", "locator", "digest"])


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", *, folder: str | None = None, digest_bytes: int = 32, hits_sent: int = HITS_SENT, files_at_once: int | None = None) -> DataFrame:
    """One row for each row: doc_id, locator, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest identifier stays; of repeated rows of that identifier, the one whose locator
    is last. A null text counts as empty; a null identifier is below all others. Very long texts are hashed and compared
    whole. Other columns are not read, whatever they are called; an empty table gives no rows. digest_bytes below 32
    makes digests collide, for tests of the comparison of bytes.

    With a folder, the stream and its state go on from earlier calls with that folder: groups are those of all rows ever
    given, of which the new ones come back. Hits are compared with the bytes of earlier copies, at their locators, so
    files of earlier calls must still be there; a table that is not read from files is written into the folder.
    """
    spark = runtime.prepare(docs.sparkSession)
    lasting = folder is not None
    if lasting and (settled := rows.settled(docs, f"{folder}/texts/{uuid.uuid4().hex}")) is not docs:
        docs = settled
    elif not lasting:
        docs, folder = rows.settled(docs), runtime.shared_dir(spark, "exact")
    keys = _keys(docs, digest_bytes, text, key)
    schema, earlier = keys.schema, None
    if lasting:
        keys = runtime.written(keys, "exact-keys")
        earlier = spark.read.schema(schema).parquet(f"{folder}/keys") if runtime.exists(spark, f"{folder}/keys") else None
        earlier = earlier if earlier is None else runtime.written(earlier.join(keys.select("digest").distinct(), "digest", "left_semi").select(*schema.names), "exact-earlier")
    keys.write.mode("append").parquet(f"{folder}/keys")
    if not lasting:
        keys = spark.read.schema(schema).parquet(f"{folder}/keys")
    latest = _stream(spark, f"{folder}/keys", folder, schema, files_at_once)
    latest = runtime.written(latest.join(keys.select("digest").distinct(), "digest", "left_semi") if lasting else latest, "exact-latest")
    answer = F.struct("keep_id", "keep_locator", "group_size")
    hits = latest.where("group_size > 1")
    seen = _texts_of(docs, hits, digest_bytes, text, key, hits_sent)
    if earlier is not None:
        seen = seen.unionByName(_earlier_texts(spark, earlier.join(hits.select("digest"), "digest", "left_semi").select("doc_id", "locator", "digest"), text))
    differ = seen.groupBy("digest").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b")).where("a != b").select("digest")
    differ = runtime.written(differ, "exact-differ")
    if differ.isEmpty():
        out = keys.join(latest.select("digest", answer.alias("s")), "digest")
    else:
        apart = seen.join(differ, "digest", "left_semi")
        classes = apart.groupBy("digest", "bytes").agg(F.max(F.struct("doc_id", "locator")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        told = apart.join(classes, ["digest", "bytes"]).select("locator", F.struct(F.col("top.doc_id").alias("keep_id"), F.col("top.locator").alias("keep_locator"), "group_size").alias("s"))
        rest = keys.join(differ, "digest", "left_anti").join(latest.select("digest", answer.alias("s")), "digest")
        out = rest.unionByName(keys.join(told, "locator"))
    return out.select("doc_id", "locator", F.col("s.keep_id").alias("keep_id"), F.col("s.group_size").alias("group_size"), (F.col("locator") == F.col("s.keep_locator")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def kept_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns, whatever they are called; edge cases are those of deduplicate."""
    docs = rows.settled(docs)
    with runtime.scratch(docs.sparkSession):
        dropped = deduplicate(docs, text, key).where(~F.col("kept")).select("locator")
        dropped = runtime.written(dropped, "exact-dropped", keep=True)
    return rows.without(docs, dropped)


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
