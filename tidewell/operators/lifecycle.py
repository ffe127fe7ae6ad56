"""Lifecycle as tables: retention, finalization, gaps, holes, purges, the key log and shard states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import buckets
from tidewell.options import Options

# The states in their order.
STATES = ("PRE_UNOWNED", "UNOWNED", "PRE_OWNED", "READING_KEYS", "READING_KEYS_DONE", "READING_LOGS", "PROCESSING_QUEUED_DATA_POINTS", "READING_BLOCK_DATA", "OWNED")


def may_move(old: str, new: str) -> bool:
    """Upward only, except that an owned shard may prepare to be given up."""
    return STATES.index(new) > STATES.index(old) or (old, new) == ("OWNED", "PRE_UNOWNED")


def retained(points: DataFrame, o: Options) -> DataFrame:
    """Points of each series' open bucket and the closed ones that are kept before it."""
    newest = points.groupBy("key_norm").agg(F.max("bucket").alias("_now"))
    return points.join(newest, "key_norm").where(F.col("bucket") >= F.col("_now") - o.buckets).drop("_now")


def last_finalized(now: Column, shard: Column, o: Options) -> Column:
    """The last bucket that is finalized at a time: late points, a minute and a whole bucket have passed."""
    return buckets.bucket(now - o.behind - 60 - o.window, shard, o)


def log_gaps(points: DataFrame, threshold: int) -> DataFrame:
    """By shard: points that come more than threshold after all before them, and the last such time. Each bucket is a
    summary first, so no shard's points meet in one task."""
    inner = Window.partitionBy("shard_id", "bucket").orderBy("unix_time")
    spans = points.groupBy("shard_id", "bucket").agg(F.min("unix_time").alias("_lo"), F.max("unix_time").alias("_hi"))
    before = spans.withColumn("_before", F.max("_hi").over(Window.partitionBy("shard_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("shard_id", "bucket", "_before")
    last = F.lag("unix_time").over(inner)
    gaps = points.select("shard_id", "bucket", "unix_time").withColumn("_last", last).join(before, ["shard_id", "bucket"])
    gap = F.col("unix_time") - F.coalesce("_last", "_before") > threshold
    return gaps.where(gap).groupBy("shard_id").agg(F.count("*").alias("n_gaps"), F.max("unix_time").alias("reliable_start"))


def block_holes(points: DataFrame) -> DataFrame:
    """By shard how often the positions of its blocks skip."""
    positions = points.select("shard_id", "bucket").distinct()
    skip = F.col("bucket") - F.lag("bucket").over(Window.partitionBy("shard_id").orderBy("bucket")) > 1
    return positions.withColumn("skip", skip).groupBy("shard_id").agg(F.count(F.when(F.col("skip"), 1)).alias("n_holes"), F.count("*").alias("n_blocks"))


def purged(catalogue: DataFrame, now_bucket: int, o: Options) -> DataFrame:
    """By category how many series have nothing in the kept buckets."""
    return catalogue.where(F.col("max_bucket") < now_bucket - o.buckets).groupBy("category_id").agg(F.count("*").alias("n_purged"))


def finalize_plan(points: DataFrame, done: DataFrame, now: int, o: Options) -> DataFrame:
    """By shard, from done(shard_id, done: the last finalized bucket, 0 if none): the first and last bucket to finalize
    and how many, how many series roll forward with them, and whether the shard is behind. A first run finalizes the
    last bucket alone."""
    last = last_finalized(F.lit(now).cast("long"), F.col("shard_id"), o)
    plan = done.withColumn("last", last).withColumn("first", F.when(F.col("done") == 0, F.col("last")).otherwise(F.col("done") + 1))
    current = points.groupBy("shard_id", "key_norm").agg(F.max("bucket").alias("current")).join(plan, "shard_id")
    rolled = current.groupBy("shard_id", "done", "first", "last").agg(F.count_if(F.col("current") <= F.col("last")).alias("n"))
    runs = F.col("first").between(F.col("done") + 1, F.col("last"))
    return rolled.select("shard_id", "first", "last", F.when(runs, F.col("last") - F.col("first") + 1).otherwise(0).alias("n_buckets"), F.when(runs, F.col("n")).otherwise(0).alias("n_rolled"), ((F.col("done") != 0) & (F.col("last") > F.col("done") + 1)).alias("behind"))


def expired(points: DataFrame, now: int, o: Options) -> DataFrame:
    """Blocks that are older than all that is kept."""
    oldest = buckets.bucket(F.lit(now).cast("long"), F.col("shard_id"), o) - o.buckets - 1
    return points.where(F.col("bucket") < oldest).groupBy("shard_id", "bucket").agg(F.count("*").alias("n_points"))


def owned(states: DataFrame) -> DataFrame:
    """By service the shards that it owns or is about to."""
    has = F.col("state") >= STATES.index("PRE_OWNED")
    shards = F.array_join(F.array_sort(F.collect_list(F.when(has, F.col("shard_id")))), ",")
    return states.groupBy("service_id").agg(F.count_if(has).alias("n_owned"), shards.alias("owned"))


def key_log(points: DataFrame) -> DataFrame:
    """An append-only log: a series is added with its first point and deleted when its last event is an error."""
    added = points.groupBy("shard_id", "key_norm").agg(F.min("arrival_seq").alias("sequence"), F.min_by("category_id", "arrival_seq").alias("category_id"), F.min("unix_time").alias("first_time"), F.max("arrival_seq").alias("_last"), F.max("value").alias("_top"), F.max_by("value", "arrival_seq").alias("_end"))
    gone = added.where("_end = _top").select("shard_id", "key_norm", (F.col("_last") + 1).alias("sequence"), "category_id", "first_time", F.lit("delete").alias("op"))
    return added.select("shard_id", "key_norm", "sequence", "category_id", "first_time", F.lit("append").alias("op")).unionByName(gone)


def current_keys(log: DataFrame) -> DataFrame:
    """The catalogue that a replay of the log gives: keys whose last entry isn't a deletion."""
    last = log.groupBy("shard_id", "key_norm").agg(F.max_by(F.struct("op", "category_id", "first_time"), "sequence").alias("e"))
    return last.where("e.op <> 'delete'").select("shard_id", "key_norm", "e.category_id", "e.first_time")


def duplicate_keys(log: DataFrame) -> DataFrame:
    """Consistency: keys appended more than once without a deletion between, none if the log is sound."""
    return log.where("op = 'append'").groupBy("shard_id", "key_norm").agg(F.count("*").alias("n")).where("n > 1")


def replayed(wal: DataFrame, window: int) -> DataFrame:
    """Records of wal(shard_id, file_time, pos, unix_time) up to the first of each file beyond the file's bucket, whose
    end still counts. Damage is one row for each file, so no file is sorted as a whole."""
    bad = ~F.col("unix_time").between(F.col("file_time"), F.col("file_time") + window)
    first = wal.where(bad).groupBy("shard_id", "file_time").agg(F.min("pos").alias("_bad"))
    return wal.join(first, ["shard_id", "file_time"], "left").where(F.col("_bad").isNull() | (F.col("pos") < F.col("_bad"))).drop("_bad")


def reconciled(owned: DataFrame, desired: DataFrame) -> DataFrame:
    """(shard_id, action): what turns the owned shards into the desired ones."""
    both = owned.select("shard_id", F.lit(True).alias("has")).join(desired.select("shard_id", F.lit(True).alias("wants")), "shard_id", "full")
    return both.select("shard_id", F.when(F.col("has").isNull(), "add").when(F.col("wants").isNull(), "drop").otherwise("keep").alias("action"))


def matched_blocks(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """By shard how many blocks belong to a known series and how many are dropped: blocks(shard_id, key_norm)."""
    marked = blocks.join(known.select("key_norm").distinct().withColumn("_known", F.lit(True)), "key_norm", "left")
    return marked.groupBy("shard_id").agg(F.count("_known").alias("n_known"), F.count(F.when(F.col("_known").isNull(), 1)).alias("n_unknown"))
