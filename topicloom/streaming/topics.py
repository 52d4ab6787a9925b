"""Streams (an extension): new documents placed in frozen topics, and counts of events in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.topics import nearest


def placed_stream(docs: DataFrame, centres: DataFrame, vec: str = "emb_hd", centre: str = "centroid_hd") -> DataFrame:
    """(doc_id, topic_idx) of a stream of documents with vectors: the nearest of fixed centroids, without state."""
    return nearest(docs, centres, vec, centre, "topic_idx")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """(start, end, by, n) of a stream of events with ``ts``; events later than ``late`` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
