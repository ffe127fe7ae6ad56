"""Ingest: repair of times, routing, the spam filter, the bucket rule and categories, with reasons for what is refused."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import buckets, keys
from tidewell.options import Options


def repaired(t: Column, now: int | Column, o: Options) -> Column:
    """Zero, late and early times become now: nothing is dropped for its time."""
    now = F.lit(now).cast("long") if isinstance(now, int) else now
    return F.when((t == 0) | (t < now - o.behind) | (t > now + o.ahead), now).otherwise(t)


State = tuple[int, int]


def seed(least_time: int, least_bucket: int, delta: int) -> State:
    """The state of a new series that takes no points before a time and a bucket."""
    return max(least_time, delta) - delta, least_bucket


def gate(state: State | None, t: int, bucket: int, delta: int) -> tuple[str, State]:
    """One point against (last accepted time, open bucket): its fate and the state after it. The bucket opens even if
    the point is refused as spam; a last time of zero refuses nothing."""
    last, now = state or (0, -1)
    if bucket < now:
        return "old_bucket", (last, now)
    if last and t - last < delta:
        return "spam", (last, bucket)
    return "accepted", (t, bucket)


def admitted(state: State | None, t: int, bucket: int, low: bool, primary: bool, delta: int) -> tuple[str, State | None]:
    """The gate behind what a new series must pass: memory that isn't low, and a service that is primary."""
    if state is None and low:
        return "blocked", None
    if state is None and not primary:
        return "not_primary", None
    return gate(state, t, bucket, delta)


def filtered(points: DataFrame, o: Options) -> DataFrame:
    """Adds fate to (key_norm, arrival_seq, unix_time, bucket, low, primary, ...): points of a series stream by in order
    of arrival. Columns seed_time and seed_bucket, if there, begin a series' state with :func:`seed`."""
    seeded = "seed_time" in points.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, state = None, None
        for rows in batches:
            fates = []
            seeds = zip(rows["seed_time"], rows["seed_bucket"], strict=True) if seeded else [None] * len(rows)
            for key, t, b, low, primary, first in zip(rows["key_norm"], rows["unix_time"], rows["bucket"], rows["low"], rows["primary"], seeds, strict=True):
                if key != series:
                    series, state = key, seed(int(first[0]), int(first[1]), o.min_delta) if first else None
                fate, state = admitted(state, t, b, low, primary, o.min_delta)
                fates.append(fate)
            yield rows.assign(fate=fates)

    ordered = points.repartition("key_norm").sortWithinPartitions("key_norm", "arrival_seq")
    return ordered.mapInPandas(run, T.StructType([*ordered.schema.fields, T.StructField("fate", T.StringType())]))


def prepared(points: DataFrame, now: int | Column, o: Options) -> DataFrame:
    """Repaired times and their buckets; low memory and primary as given, or no and yes."""
    given = {c: F.lit(v) for c, v in (("low", False), ("primary", True)) if c not in points.columns}
    fixed = points.withColumn("unix_time", repaired(F.col("unix_time"), now, o)).withColumns(given) if given else points.withColumn("unix_time", repaired(F.col("unix_time"), now, o))
    return fixed.withColumn("bucket", buckets.bucket(F.col("unix_time"), F.col("shard_id"), o))


def refused(o: Options, owned: bool) -> Column:
    """Why a point never reaches its series, or null: a key that is too long, a shard that isn't there or not owned."""
    no_fit = F.when(~keys.key_fits(F.col("key"), o.max_key_bytes), "key_too_long")
    return no_fit.when(F.col("state").isNull(), "bad_shard").when(F.col("state") < 2, "not_owned") if owned else no_fit


def ingested(points: DataFrame, now: int | Column, o: Options, states: DataFrame | None = None) -> DataFrame:
    """All points with their repaired time, bucket and fate: accepted, spam, old_bucket, blocked, not_primary,
    key_too_long, and with states(shard_id, state) bad_shard and not_owned, whose times stay as they were."""
    routed = points.join(states, "shard_id", "left") if states is not None else points
    why = refused(o, states is not None)
    marked = prepared(routed, now, o).withColumn("why", why)
    if states is not None:
        back = routed.withColumn("why", why).where("why = 'not_owned'")
        marked = marked.where("why is null or why <> 'not_owned'").unionByName(back, allowMissingColumns=True)
    return filtered(marked.where("why is null"), o).unionByName(marked.where("why is not null").withColumn("fate", F.col("why"))).drop("why", "state")
