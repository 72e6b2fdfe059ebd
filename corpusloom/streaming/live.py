"""Streams: documents ingested as they arrive and feedback averaged over time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.chunking import ChunkConfig
from corpusloom.plans.ingest import ingest
from corpusloom.sources.store import SnapshotStore


def ingest_stream(docs: DataFrame, store: SnapshotStore, *, checkpoint: str, cfg: ChunkConfig = ChunkConfig(), **options) -> StreamingQuery:
    """Every micro-batch replaces the chunks of the sources it brings; a repeated batch gives the same state."""

    def apply(batch: DataFrame, _: int) -> None:
        latest = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("_place")))
        newest = batch.withColumn("_place", F.monotonically_increasing_id()).withColumn("_latest", latest).where("_latest = 1").drop("_place", "_latest")
        chunks = ingest(newest, cfg=cfg)
        old = store.load_all()
        store._swap(chunks=chunks if old is None else old.join(newest.select("source_id"), "source_id", "left_anti").unionByName(chunks, allowMissingColumns=True))

    return docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()


def windowed(events: DataFrame, *, time: str, by: list[str], value: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and mean of a value in tumbling windows; rows later than ``late`` behind the newest are dropped by the watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, every).alias("w"), *by).agg(F.count("*").alias("n_events"), F.avg(value).alias("mean_value")).select(F.col("w.start").alias("window_start"), *by, "n_events", "mean_value")
