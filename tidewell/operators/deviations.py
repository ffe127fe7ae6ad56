"""Deviation index: points at least k population standard deviations off their series' mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.options import Options
from tidewell.sources.storage import within


def deviating(points: DataFrame, deviation_start: int, index_start: int, end: int, k: float) -> DataFrame:
    """Mean and deviation over [deviation_start, end], points of [index_start, end]. Sums go to a row for each series
    before anything meets, so a series of any length is no task's burden. Constant series have no deviating points."""
    used = within(points, deviation_start, end).where(F.col("unix_time").between(deviation_start, end))
    stats = used.groupBy("key_norm").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sigma")).where("sigma > 0")
    return used.where(F.col("unix_time") >= index_start).join(stats, "key_norm").where(F.abs(F.col("value") - F.col("mean")) >= k * F.col("sigma"))


def minute_slots(found: DataFrame, o: Options) -> DataFrame:
    """The ring of minutes: which series deviate in each slot, and how many times."""
    total = o.buckets * o.window // 60
    return found.groupBy((F.floor(F.col("unix_time") / 60) % total).alias("minute_slot"), "key_norm").agg(F.count("*").alias("n"))
