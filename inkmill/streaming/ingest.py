"""Streaming ingestion: new files in a folder are submitted and processed, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkmill.operators.embed import Provider
from inkmill.plans.ingest import process, submit
from inkmill.schemas import Settings
from inkmill.sources.store import Snapshots
from inkmill.sources.uploads import stream_files


def start(spark: SparkSession, folder: str, store: Snapshots, provider: Provider, checkpoint: str, settings: Settings = Settings(), once: bool = False) -> StreamingQuery:
    """Starts the stream. The checkpoint replays a batch that a crash cut off, and a replayed upload is a duplicate:
    its document already has that content, so nothing is stored twice."""

    def batch(df: DataFrame, _: int) -> None:
        now = F.current_timestamp()
        submit(store, df, now, settings)
        process(store, provider, now, settings)

    writer = stream_files(spark, folder, settings).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
