"""Progress of jobs and freshness of results over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.partitioning import hadoop

SEGMENT_EVENTS = "event_id bigint, ts timestamp, job_id bigint, segment_id bigint, status string, revision bigint, result string"


def read_events(spark: SparkSession, path: str, schema: str = SEGMENT_EVENTS, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once_each(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events delivered again within ``late`` dropped; the state is bounded by
    the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_progress(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """Events of each status by window of event time and job; with ``late``,
    each event once and windows closed by the watermark (append mode)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    source = once_each(events, late) if late else events
    counted = source.groupBy(w.alias("w"), "job_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "job_id", "events", "completed", "failed")


def newest_result(events: DataFrame) -> DataFrame:
    """Newest result of each segment: highest revision, then highest job, so a
    late result of an old revision never replaces a newer one.  Run in update
    or complete mode; one row of state a segment."""
    rank = F.struct("revision", "job_id", "event_id")
    return events.where("status = 'completed'").groupBy("segment_id").agg(F.max_by(F.struct("job_id", "revision", "result"), rank).alias("r")).select("segment_id", "r.*")


def _complete(spark: SparkSession, target: str, before: int) -> int | None:
    """The newest batch before the given one whose list of parts is complete."""
    fs, at = hadoop(spark, target)
    if not fs.exists(at):
        return None
    names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(at)]
    done = [int(n[2:]) for n, p in names if n.startswith("m=") and int(n[2:]) < before and fs.exists(hadoop(spark, f"{p}/_SUCCESS")[1])]
    return max(done, default=None)


def _parts(spark: SparkSession, target: str, version: int | None) -> dict[int, int]:
    """Bucket -> batch that wrote it last; no more entries than buckets."""
    if version is None:
        return {}
    return {r.bucket: r.version for r in spark.read.parquet(f"{target}/m={version}").collect()}


def upsert_newest(target: str, key: str = "segment_id", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` that keeps the newest row of each key.

    Rows are dealt to buckets by key.  A batch writes the buckets it changes, as
    new files beside the old ones, then a list of which batch wrote each bucket
    last; a batch that is repeated after a failure reads what the one before it
    listed and writes the same again.  Only a target without any list is empty:
    files that are listed and can't be read fail the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parts = _parts(spark, target, _complete(spark, target, batch_id))
        number = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = [r.bucket for r in batch.select(number.alias("bucket")).distinct().collect()]
        rows = batch
        old = [f"{target}/v={parts[b]}/bucket={b}" for b in touched if b in parts]
        if old:
            rows = spark.read.schema(batch.schema).parquet(*old).unionByName(batch)
        rank = F.struct("revision", "job_id")
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*batch.columns), rank).alias("r")).select("r.*")
        newest.withColumn("bucket", number).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={batch_id}")
        listed = sorted((parts | dict.fromkeys(touched, batch_id)).items())
        spark.createDataFrame(listed, "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{target}/m={batch_id}")

    return write


def read_newest(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The table that ``upsert_newest`` keeps, after its last complete batch."""
    parts = _parts(spark, target, _complete(spark, target, 1 << 62))
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{target}/v={v}/bucket={b}" for b, v in sorted(parts.items())))


def run_once(df: DataFrame, target: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process all that is there, stop, and read the result back from ``target``,
    a folder all executors share.  In complete mode each batch replaces the
    table; in append mode each batch has a folder of its own, so a repeated batch
    replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        at = target if mode == "complete" else f"{target}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(at)

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(target)
