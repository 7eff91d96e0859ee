"""Incremental ingestion: each micro-batch of documents becomes chunks, entities and edges once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract, rules


def mentions_stream(chunks: DataFrame) -> DataFrame:
    """Valid entities of a stream of chunks (id, document_id, text): stateless, so it runs on either kind of frame."""
    return rules.valid_entities(extract.rule_entities(chunks))


def write_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to its own partition, so that a batch that is run again replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts of event types in tumbling windows with a bound on lateness."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
