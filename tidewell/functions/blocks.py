"""Blocks: a series' points in a bucket as one row of differences, small numbers that a column format packs well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timestamp_bits(points: DataFrame) -> DataFrame:
    """Bits of each block's times as differences of differences: 31 for the first, then 1, 9, 12, 16 or 36 by size."""
    order = Window.partitionBy("key_norm", "bucket").orderBy("unix_time", "arrival_seq")
    delta = F.col("unix_time") - F.lag("unix_time").over(order)
    rows = points.select("key_norm", "bucket", "unix_time", "arrival_seq").withColumn("delta", delta).withColumn("number", F.row_number().over(order))
    rows = rows.withColumn("change", F.col("delta") - F.coalesce(F.lag("delta").over(order), F.lit(60)))
    bits = F.when(F.col("number") == 1, 31).when(F.col("change") == 0, 1).when(F.col("change").between(-63, 64), 9).when(F.col("change").between(-255, 256), 12).when(F.col("change").between(-2047, 2048), 16).otherwise(36)
    return rows.groupBy("key_norm", "bucket").agg(F.count("*").alias("n_points"), F.sum(bits).cast("long").alias("bits"))


def closed(points: DataFrame) -> DataFrame:
    """A row for each block: n_points, start, its times' steps and its values, in order, and a hash of the content, equal
    for equal blocks. A block holds no more than a series' points of one bucket."""
    one = points.groupBy("shard_id", "bucket", "key_norm").agg(F.array_sort(F.collect_list(F.struct("unix_time", "value"))).alias("p"))
    times = F.transform("p", lambda x: x["unix_time"])
    steps = F.transform(times, lambda t, i: t - F.try_element_at(times, F.greatest(i, F.lit(1))))
    made = one.select("shard_id", "bucket", "key_norm", F.size("p").cast("long").alias("n_points"), times[0].alias("start"), steps.alias("steps"), F.transform("p", lambda x: x["value"]).alias("values"))
    return made.withColumn("content", F.sha2(F.to_json(F.struct("start", "steps", "values")), 256))


def opened(blocks: DataFrame) -> DataFrame:
    """The points that blocks hold."""
    rows = blocks.select("key_norm", "bucket", "start", F.posexplode(F.arrays_zip("steps", "values")).alias("place", "p"))
    order = Window.partitionBy("key_norm", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("key_norm", "bucket", (F.col("start") + F.sum("p.steps").over(order)).alias("unix_time"), F.col("p.values").alias("value"))
