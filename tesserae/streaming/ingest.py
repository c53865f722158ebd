"""Extension: documents that arrive as a stream are appended to the postings; events are counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.functions.text import DEFAULT, TokenizerConfig
from tesserae.operators.index import postings_of


def append_postings(docs: DataFrame, path: str, checkpoint: str, config: TokenizerConfig = DEFAULT) -> StreamingQuery:
    """docs: a streaming (doc_id, content). Each batch's postings go to a folder named by its id, so a repeated batch
    replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        postings_of(batch, config).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows; events later than the watermark are left out of a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", window).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
