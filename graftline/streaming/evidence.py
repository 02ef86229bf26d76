"""Clip evidence as a stream: per-site counts that grow as alignments arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import FindFlanks
from ..plans.flanks import SITE, clips


def stream_site_counts(alignments: DataFrame, p: FindFlanks = FindFlanks()) -> DataFrame:
    """Clipped reads of each site and orientation, for update or complete output.

    A stream can't count distinct names exactly, so names are counted about; the
    batch plan is exact.
    """
    return clips(alignments, p).groupBy(*SITE, "orient").agg(F.approx_count_distinct("read_name", 0.01).alias("softclip_count"), F.count("*").alias("reads"))


def windowed_event_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events and values of each type in tumbling windows, closed by a watermark."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return rows.groupBy(F.window(ts, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")
