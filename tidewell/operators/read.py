"""Reads: point-get, shard scans, pages, last updates and exclusions, over the points table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import buckets, keys
from tidewell.options import Options
from tidewell.sources.storage import within

OK, KEY_MISSING = 0, 3  # of the statuses, those that a table of points alone can give


def in_range(begin: int, end: int, o: Options) -> Column:
    """Both ends count. The bucket is bounded too, so that partitions by bucket are skipped."""
    t, shard = F.col("unix_time"), F.col("shard_id")
    lowest, highest = buckets.bucket(F.lit(begin), shard, o), buckets.bucket(F.lit(end), shard, o)
    return t.between(begin, end) & F.col("bucket").between(lowest, highest)


def get_data(points: DataFrame, requests: DataFrame, begin: int, end: int, o: Options) -> DataFrame:
    """requests(request_idx, key): a row for each point in range, or one with status KEY_MISSING for an unknown key and
    one without a point for a key that has none in range. Keys match without case."""
    wanted = requests.select("request_idx", F.col("key").alias("asked"), keys.normal(F.col("key")).alias("key_norm"))
    known = points.select("key_norm").distinct().withColumn("known", F.lit(True))
    found = within(points, begin, end).where(in_range(begin, end, o)).select("key_norm", "unix_time", "value")
    status = F.when(F.col("known").isNull(), KEY_MISSING).otherwise(OK).cast("long")
    return wanted.join(known, "key_norm", "left").join(found, "key_norm", "left").select("request_idx", F.col("asked").alias("key"), status.alias("status"), "unix_time", "value")


def scan_shards(points: DataFrame, begin: int, end: int, subshards: int, o: Options) -> DataFrame:
    """Every series with points in range, by shard and sub-shard: counts and ends; floors both ends to buckets first."""
    shard = F.col("shard_id")
    low, high = buckets.bucket(F.lit(begin), shard, o), buckets.bucket(F.lit(end), shard, o)
    inside = within(points, begin - o.window, end + o.window).where(F.col("bucket").between(low, high))
    blocks = inside.groupBy("shard_id", "key_norm", "bucket").agg(F.count("*").alias("n"), F.min("unix_time").alias("low"), F.max("unix_time").alias("high"))
    return blocks.groupBy("shard_id", "key_norm").agg(F.sum("n").alias("n_points"), F.min("low").alias("first_time"), F.max("high").alias("last_time"), F.count("*").alias("n_blocks")).withColumn("subshard", keys.subshard_of(F.col("key_norm"), subshards))


def series(points: DataFrame) -> DataFrame:
    """The catalogue: each series' number in its shard by first arrival, its first spelling, category and ends."""
    one = points.groupBy("shard_id", "key_norm").agg(F.min("arrival_seq").alias("first_seq"), F.min_by("key", "arrival_seq").alias("key"), F.max_by("category_id", "arrival_seq").alias("category_id"), F.min("unix_time").alias("first_time"), F.max("unix_time").alias("last_time"), F.min("bucket").alias("min_bucket"), F.max("bucket").alias("max_bucket"), F.count("*").alias("n_points"))
    return one.withColumn("series_id", F.row_number().over(Window.partitionBy("shard_id").orderBy("first_seq")).cast("long") - 1)


def page(catalogue: DataFrame, offset: int, limit: int) -> DataFrame:
    """The slots [offset, offset + limit) of every shard, and whether more follow."""
    slots = catalogue.groupBy("shard_id").agg((F.max("series_id") + 1).alias("slots"))
    inside = F.col("series_id").between(offset, offset + limit - 1)
    return catalogue.where(inside).join(slots, "shard_id").withColumn("more", F.lit(offset + limit) < F.col("slots"))


def last_updates(catalogue: DataFrame, least: int) -> DataFrame:
    return catalogue.where(F.col("last_time") >= least).select("shard_id", "key_norm", "category_id", F.col("last_time").alias("update_time"))


def update_pages(catalogue: DataFrame, heats: DataFrame, least: int, offset: int, limit: int, o: Options) -> DataFrame:
    """The series in slots [offset, offset + limit) of every shard with an update since ``least``: heats(key_norm,
    queried_ago). Slots of series that are left out count, so a page may hold fewer rows than its limit."""
    rows = page(catalogue, offset, limit).where(F.col("last_time") >= least).join(heats, "key_norm")
    return rows.select("shard_id", "series_id", "key", "category_id", F.col("last_time").alias("update_time"), (F.col("queried_ago") <= 86400 // o.window).alias("queried_recently"), "more")


def bucket_page(points: DataFrame, catalogue: DataFrame, begin: int, end: int, offset: int, limit: int, o: Options) -> DataFrame:
    """The points that series in slots [offset, offset + limit) have in the buckets of a range, by series and bucket."""
    shard = F.col("shard_id")
    low, high = (buckets.bucket(F.lit(t).cast("long"), shard, o) for t in (begin, end))
    rows = page(catalogue, offset, limit).select("shard_id", "series_id", "key_norm", "more")
    found = within(points, begin - o.window, end + o.window).where(F.col("bucket").between(low, high)).select("shard_id", "key_norm", "bucket", "unix_time", "value")
    return rows.join(found, ["shard_id", "key_norm"]).select("shard_id", "series_id", "bucket", "unix_time", "value", "more")


def without_blacklist(points: DataFrame, low: int, high: int) -> DataFrame:
    """Points outside [low, high]; the first of a block stays whatever its time."""
    first = F.row_number().over(Window.partitionBy("key_norm", "bucket").orderBy("unix_time", "arrival_seq")) == 1
    return points.withColumn("_first", first).where(~F.col("unix_time").between(low, high) | F.col("_first")).drop("_first")


def heat(points: DataFrame, queried: DataFrame) -> DataFrame:
    """Buckets since each series was last read, 255 if never; queried(key_norm, bucket)."""
    now = points.groupBy("key_norm").agg(F.max("bucket").alias("current"))
    last = queried.groupBy("key_norm").agg(F.max("bucket").alias("asked"))
    ago = F.when(F.col("asked").isNull(), 255).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), F.col("current") - F.col("asked"))))
    return now.join(last, "key_norm", "left").select("key_norm", ago.cast("long").alias("queried_ago"))


def cold(ago: Column, o: Options) -> Column:
    """Not read for more buckets than the threshold, or never."""
    return ago > o.cold_threshold


def recently_queried(ago: Column, o: Options) -> Column:
    return (ago != 255) & (ago <= 86400 // o.window)
