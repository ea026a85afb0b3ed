"""Incremental ingestion on Structured Streaming: new files are merged batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.merge import apply_merge, latest_by, merge_plan
from inkwell.session import folder_exists, list_folder, remove_folder


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events and their value by window and type; rows later than the watermark are dropped by the engine."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("value"))
        .select(F.col("w.start").alias("start"), "event_type", "events", "value")
    )


class MergeSink:
    """foreachBatch target that merges each batch into a table kept as Parquet under a folder of any file system Spark reads.

    Rows lie in `buckets` parts by a hash of their keys. A batch reads and writes only the parts its keys fall in, under a
    version of its own; a part's newest finished version is the current one, older ones go with drop_old. A batch that comes
    again (same batch id after a restart) is recognised by its version and not applied twice. Within a batch the last row per
    key by `order` wins; a merge never prunes.
    """

    def __init__(self, folder: str, keys: list[str], fields: list[str], order: str, buckets: int = 64):
        self.folder, self.keys, self.fields, self.order, self.buckets = folder.rstrip("/"), keys, fields, order, buckets

    def versions(self, spark: SparkSession) -> list[int]:
        """Ids of the batches whose write is finished."""
        ids = [f[1:] for f in list_folder(spark, self.folder) if f.startswith("v") and f[1:].isdigit()]
        return sorted(int(v) for v in ids if folder_exists(spark, f"{self.folder}/v{v}/_SUCCESS"))

    def parts(self, spark: SparkSession) -> dict[int, str]:
        """bucket -> folder of its newest version."""
        out: dict[int, str] = {}
        for v in self.versions(spark):
            for f in list_folder(spark, f"{self.folder}/v{v}"):
                if f.startswith("__bucket="):
                    out[int(f.split("=")[1])] = f"{self.folder}/v{v}/{f}"
        return out

    def current(self, spark: SparkSession, buckets: set[int] | None = None) -> DataFrame | None:
        """The table, or those of its parts; None where there is nothing yet."""
        paths = [p for b, p in sorted(self.parts(spark).items()) if buckets is None or b in buckets]
        return spark.read.parquet(*paths) if paths else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in self.versions(spark):
            return
        new = latest_by(batch, self.keys, [F.col(self.order).desc_nulls_last(), *[F.col(f).desc() for f in self.fields]])
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = {r.b for r in new.select(bucket.alias("b")).distinct().collect()}  # at most `buckets` rows
        old = self.current(spark, touched)
        if old is not None:
            plan = merge_plan(old, new, self.keys, self.fields).where("action <> 'pruned'")
            new = apply_merge(old, new.select(*old.columns), self.keys, plan)
        new.withColumn("__bucket", bucket).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.folder}/v{batch_id}")

    def drop_old(self, spark: SparkSession) -> int:
        """Remove the parts that a newer version replaces; the number removed. Not while a reader of an older state is at work."""
        keep, gone = set(self.parts(spark).values()), 0
        for v in self.versions(spark):
            for f in list_folder(spark, f"{self.folder}/v{v}"):
                path = f"{self.folder}/v{v}/{f}"
                if f.startswith("__bucket=") and path not in keep:
                    remove_folder(spark, path)
                    gone += 1
        return gone


def merge_stream(stream: DataFrame, sink: MergeSink, checkpoint: str | None = None):
    """Start the merge of a stream, to run until the input there is has been read."""
    where = checkpoint or f"{sink.folder}-checkpoint-{uuid.uuid4().hex}"
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", where).trigger(availableNow=True).start()
