"""Events as points: the series of a user's events of one type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import buckets, keys
from tidewell.options import Options

#: Categories by event type; others are 0.
CATEGORIES = {"click": 1, "view": 2, "purchase": 3, "error": 4, "login": 5}


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def as_points(events: DataFrame, o: Options) -> DataFrame:
    """(arrival_seq, key, key_norm, unix_time, value, category_id, shard_id, bucket)."""
    stamp = F.col("ts").cast("timestamp_ntz")
    category = F.coalesce(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])[F.col("event_type")], F.lit(0))
    points = events.select(F.col("event_id").alias("arrival_seq"), F.concat_ws(":", "event_type", "user_id").alias("key"), keys.epoch_seconds(stamp).alias("unix_time"), "value", category.cast("long").alias("category_id"), "event_type", "user_id")
    points = points.withColumn("key_norm", keys.normal(F.col("key"))).withColumn("shard_id", keys.shard_of(F.col("key_norm"), o.shards))
    return points.withColumn("bucket", buckets.bucket(F.col("unix_time"), F.col("shard_id"), o))


def replicas(points: DataFrame) -> DataFrame:
    """Three services' copies with gaps of their own; the second a second late, the third five percent high."""
    copies = F.array(*(F.struct(F.lit(s).alias("s"), (F.col("arrival_seq") % m != r).alias("has")) for s, m, r in ((0, 3, 0), (1, 3, 1), (2, 5, 0))))
    one = points.withColumn("copy", F.explode(copies)).where("copy.has")
    return one.withColumn("service_id", F.col("copy.s").cast("long")).withColumn("unix_time", F.col("unix_time") + (F.col("service_id") == 1).cast("long")).withColumn("value", F.col("value") * F.when(F.col("service_id") == 2, 1.05).otherwise(1.0)).drop("copy")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(read_events(spark, sf_dir).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def arrivals(events: DataFrame, o: Options, users: int = 4) -> DataFrame:
    """Events as points that arrive up to half an hour late, some a little early, in series of ``users`` groups of users:
    arrival_seq is by arrival, now when it is, low whether memory is low then, primary whether the service is."""
    points = as_points(events.withColumn("user_id", F.col("user_id") % users), o)
    now = F.col("unix_time") + F.col("arrival_seq") * 7919 % 1800 - 90
    return points.withColumns({"now": now, "low": F.col("arrival_seq") % 4 == 0, "primary": F.col("arrival_seq") % 7 != 0}).withColumn("arrival_seq", now * (1 << 32) + F.col("arrival_seq"))


def shard_states(points: DataFrame, services: int = 3) -> DataFrame:
    """A state for each service and shard that points have, spread by their numbers: most own their shards, some are
    loading, have given them up or are down, and for some data before the second day of reads may be missing."""
    every = points.select("shard_id").distinct().withColumn("service_id", F.explode(F.sequence(F.lit(0), F.lit(services - 1)).cast("array<long>")))
    x = (F.col("shard_id") * 5 + F.col("service_id") * 3) % 11
    state = F.when(x == 0, 1).when(x == 1, 5).when(x == 2, 7).when(x == 3, 0).otherwise(8)
    late = F.when((F.col("shard_id") + F.col("service_id")) % 4 == 0, 1704758400).otherwise(0)
    return every.select("service_id", "shard_id", state.cast("int").alias("state"), late.cast("long").alias("reliable_start"), (x != 4).alias("up"))
