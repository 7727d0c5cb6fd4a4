"""Structured Streaming: event-time windows and hash-gated upserts by micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.store import is_folder, shared_dir


def shared(spark, name: str) -> str:
    return f"{shared_dir(spark)}/stream/{name}-{uuid.uuid4().hex}"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files."""
    path = f"{sf_dir}/{table}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_folder(spark, path):
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def tumbling(spark, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """Calls and calls without results for each window; late events count up to the watermark."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    agg = e.groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_id") % 5 == 0).alias("zero_calls"))
    agg = agg.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "calls", "zero_calls")
    out = shared(spark, "tumbling")
    q = agg.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", out + "-state").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def upsert_batch(current: DataFrame, batch: DataFrame) -> DataFrame:
    """``current`` after ``batch`` (id, content_hash): same hash changes nothing, another hash is a revision more."""
    new = batch.dropDuplicates(["id"]).withColumnRenamed("content_hash", "new_hash")
    j = current.join(new, "id", "full")
    same = F.col("new_hash").isNull() | F.col("content_hash").eqNullSafe(F.col("new_hash"))
    return j.select("id", F.when(same, F.col("content_hash")).otherwise(F.col("new_hash")).alias("content_hash"), F.when(F.col("revision").isNull(), 1).when(same, F.col("revision")).otherwise(F.col("revision") + 1).cast("int").alias("revision"))


def windows(spark, sf_dir: str, kind: str) -> DataFrame:
    """Calls in windows that slide by half an hour, or in sessions of a user that end after an hour without one."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    if kind == "sliding":
        keys, agg = [F.window("ts", "1 hour", "30 minutes").alias("w")], e
    else:
        keys, agg = ["user_id", F.session_window("ts", "1 hour").alias("w")], e
    agg = agg.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"))
    agg = agg.select(*keys[:-1], F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "calls", "total")
    out = shared(spark, kind)
    q = agg.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", out + "-state").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.parquet(out)


BUCKETS = 16


def upsert_into(spark, stream: DataFrame, out: str) -> DataFrame:
    """The table at ``out`` after all of a stream (id, content_hash) that it has not taken yet.

    Offsets stand in the checkpoint beside the table, so another run goes on where the last one ended. Rows are kept in
    BUCKETS folders by id; a micro-batch writes only the buckets it touches, as new versions named by its number, so a batch
    that is replayed writes the same again. A reader takes each bucket's highest version.
    """
    spark.createDataFrame([], "id string, content_hash string, revision int, bucket int, v long").write.partitionBy("v").mode("append").parquet(f"{out}/rows")

    def current() -> DataFrame:
        rows = spark.read.schema("id string, content_hash string, revision int, bucket int, v long").parquet(f"{out}/rows")
        return rows

    def newest(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("bucket").agg(F.max("v").alias("v"))
        return rows.join(F.broadcast(last), ["bucket", "v"])  # a row for each bucket

    def apply(batch, n):
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
        old = newest(current().where((F.col("v") <= n) & F.col("bucket").isin(touched)))
        new = upsert_batch(old.select("id", "content_hash", "revision"), batch.select("id", "content_hash"))
        new = new.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
        new.write.mode("overwrite").parquet(f"{out}/rows/v={n + 1}")

    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(apply).start()
    q.awaitTermination()
    return newest(current()).select("id", "content_hash", "revision")


def upsert(spark, sf_dir: str) -> DataFrame:
    """Documents as a stream into a table of one row for each id."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return upsert_into(spark, d, shared(spark, "upsert")).select("id", "revision")
