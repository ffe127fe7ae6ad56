"""Read statuses: what a service answers for a key or a shard, and what a reader makes of several answers.

States of shards come as states(service_id, shard_id, state, reliable_start, up): state is a number of STATES, data
before reliable_start may be missing, and a service that isn't up answers nothing for the shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import buckets, keys
from tidewell.operators import lifecycle
from tidewell.options import Options
from tidewell.sources.storage import within

# The statuses in their order.
STATUSES = ("OK", "DONT_OWN_SHARD", "SHARD_IN_PROGRESS", "KEY_MISSING", "RPC_FAIL", "MISSING_TOO_MUCH_DATA", "BUCKET_NOT_FINALIZED")
OK, DONT_OWN, IN_PROGRESS, KEY_MISSING, RPC_FAIL, MISSING_DATA, NOT_FINALIZED = range(7)
UNOWNED, PRE_OWNED, READING_BLOCKS, OWNED = (lifecycle.STATES.index(s) for s in ("UNOWNED", "PRE_OWNED", "READING_BLOCK_DATA", "OWNED"))


def key_statuses(requests: DataFrame, copies: DataFrame, states: DataFrame, begin: int, o: Options) -> DataFrame:
    """requests(request_idx, key, shard_id): (service_id, request_idx, key_norm, status, served) of every service, served
    if the series' data goes with it. A shard that a service has no state for, or a key that is too long, is missing."""
    known = copies.select("service_id", "key_norm").distinct().withColumn("known", F.lit(True))
    asked = requests.withColumn("key_norm", keys.normal(F.col("key")))
    every = asked.join(states, "shard_id").join(known, ["service_id", "key_norm"], "left")
    has, state = F.col("known").isNotNull(), F.col("state")
    loading = state.between(PRE_OWNED, READING_BLOCKS - 1)
    status = (
        F.when(~F.col("up"), RPC_FAIL)
        .when(~keys.key_fits(F.col("key"), o.max_key_bytes), KEY_MISSING)
        .when(state == UNOWNED, DONT_OWN)
        .when(loading, IN_PROGRESS)
        .when(~has, KEY_MISSING)
        .when(state == READING_BLOCKS, IN_PROGRESS)
        .when(F.lit(begin) < F.col("reliable_start"), MISSING_DATA)
        .otherwise(OK)
    )
    served = has & ~loading & status.isin(OK, IN_PROGRESS, MISSING_DATA)
    return every.select("service_id", "request_idx", "key_norm", status.cast("long").alias("status"), served.alias("served"))


def route(status: Column) -> Column:
    """What a reader of one service does with an answer if it takes partial data only from the last service."""
    return F.when(status == OK, "found").when(status == KEY_MISSING, "missing").when(status.isin(RPC_FAIL, DONT_OWN), "failed").when(status == IN_PROGRESS, "in_progress").otherwise("partial")


def failover(statuses: DataFrame) -> DataFrame:
    """For each request the answer that counts: the first service, in order, that has found the key or knows that it is
    missing; else the last service's, if data goes with it; else none (found false)."""
    final = F.col("status").isin(OK, KEY_MISSING)
    order = Window.partitionBy("request_idx").orderBy(F.desc(final.cast("int")), F.when(final, F.col("service_id")).otherwise(-F.col("service_id")))
    first = statuses.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return first.select("request_idx", "key_norm", "service_id", "status", (F.col("served") & (F.col("status") != KEY_MISSING)).alias("found"))


def completeness(statuses: DataFrame) -> DataFrame:
    """By request: how many services gave a complete answer, and how many gave any."""
    complete, received = F.col("status").isin(OK, MISSING_DATA, KEY_MISSING), F.col("status").isin(OK, MISSING_DATA, KEY_MISSING, IN_PROGRESS)
    return statuses.groupBy("request_idx").agg(F.count_if(complete).alias("n_complete"), F.count_if(received).alias("n_received"))


def get_stats(statuses: DataFrame, merges: DataFrame, services: int) -> DataFrame:
    """By service: points that others added and it lacks or that it lacks of the result (missing_points), keys it gave
    no answer for (failed_keys), and mismatches. merges: a row for each series and merge, in order of service; a series'
    first merge counts against services before it that answered without data. Mismatches of a merge count for its
    service, and for the one other service where just that one had answered, with a complete copy."""
    received, complete = F.col("status").isin(OK, MISSING_DATA, KEY_MISSING, IN_PROGRESS), F.col("status").isin(OK, MISSING_DATA, KEY_MISSING)
    answers = statuses.where(received).select("key_norm", F.col("service_id").alias("other"), complete.cast("int").alias("complete"))
    prior = merges.join(answers, "key_norm").where("other < service_id")
    alone = Window.partitionBy("key_norm", "service_id")
    prior = prior.withColumn("only", (F.count("*").over(alone) == 1) & (F.sum("complete").over(alone) == 1))
    own = merges.select("service_id", F.col("missing").alias("missing_points"), "mismatches")
    others = prior.select(F.col("other").alias("service_id"), F.col("added").alias("missing_points"), F.when(F.col("only"), F.col("mismatches")).otherwise(0).alias("mismatches"))
    sums = own.unionByName(others).groupBy("service_id").agg(F.sum("missing_points").alias("missing_points"), F.sum("mismatches").alias("mismatches"))
    failed = statuses.groupBy("service_id").agg(F.count_if(~received).alias("failed_keys"))
    return failed.join(sums, "service_id", "left").select("service_id", F.coalesce("missing_points", F.lit(0)).alias("missing_points"), "failed_keys", F.coalesce("mismatches", F.lit(0)).alias("mismatches"))


def scan_statuses(states: DataFrame, end: int, now: int, o: Options) -> DataFrame:
    """(service_id, shard_id, status) of a scan up to the bucket of ``end``."""
    state, shard = F.col("state"), F.col("shard_id")
    late = buckets.bucket(F.lit(end).cast("long"), shard, o) > lifecycle.last_finalized(F.lit(now).cast("long"), shard, o)
    status = F.when(~F.col("up"), RPC_FAIL).when(state <= UNOWNED, DONT_OWN).when(state != OWNED, IN_PROGRESS).when(late, NOT_FINALIZED).otherwise(OK)
    return states.select("service_id", "shard_id", status.cast("long").alias("status"))


def scanned(points: DataFrame, statuses: DataFrame, begin: int, end: int, subshards: int, subshard: int, o: Options) -> DataFrame:
    """Series of one sub-shard with points in the buckets of a range, where the service's status is OK; a row without a
    series for other statuses. times: of the points, in order, joined by commas."""
    shard = F.col("shard_id")
    low, high = (buckets.bucket(F.lit(t).cast("long"), shard, o) for t in (begin, end))
    inside = within(points, begin - o.window, end + o.window).where(F.col("bucket").between(low, high) & (keys.subshard_of(F.col("key_norm"), subshards) == subshard))
    rows = inside.groupBy("service_id", "shard_id", "key_norm").agg(F.array_join(F.array_sort(F.collect_list("unix_time")), ",").alias("times"), F.count("*").alias("n_points"))
    return statuses.where(F.col("status") == OK).join(rows, ["service_id", "shard_id"]).unionByName(statuses.where(F.col("status") != OK), allowMissingColumns=True)


def collected(statuses: DataFrame) -> DataFrame:
    """By shard, what a reader of all services gets: OK if any is; else the first that isn't a failed call; else that."""
    order = F.struct((F.col("status") != OK).cast("int").alias("a"), (F.col("status") == RPC_FAIL).cast("int").alias("b"), F.col("service_id"))
    return statuses.groupBy("shard_id").agg(F.min_by("status", order).alias("status"), F.bool_and(F.col("status") == OK).alias("all_success"), F.count_if(F.col("status") == OK).alias("n_ok"))
