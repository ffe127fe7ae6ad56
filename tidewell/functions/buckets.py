"""Buckets of time: tumbling windows whose phase is shifted by shard. Integer seconds throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.options import Options


def _div(a: Column, b: int | Column) -> Column:
    return F.floor(a / b).cast("long")


def offset(shard: Column, o: Options) -> Column:
    return _div(shard * o.window, o.shards)


def bucket(t: Column, shard: Column, o: Options) -> Column:
    return F.when(t < offset(shard, o), F.lit(0)).otherwise(_div(t - offset(shard, o), o.window)).cast("long")


def bucket_start(b: Column, shard: Column, o: Options) -> Column:
    return b * o.window + offset(shard, o)


def duration(n: Column, o: Options) -> Column:
    return n * o.window


def buckets_in(seconds: Column, o: Options) -> Column:
    return _div(seconds, o.window)


def floor_time(t: Column, shard: Column, o: Options) -> Column:
    return bucket_start(bucket(t, shard, o), shard, o)


def ceil_time(t: Column, shard: Column, o: Options) -> Column:
    return F.when(t <= offset(shard, o), offset(shard, o)).otherwise(bucket_start(bucket(t - 1, shard, o) + 1, shard, o))


def aligned_bucket(t: Column, o: Options) -> Column:
    return _div(t, o.window)


def aligned_start(b: Column, o: Options) -> Column:
    return b * o.window


def aligned_floor(t: Column, o: Options) -> Column:
    return t - t % o.window


def is_aligned(t: Column, o: Options) -> Column:
    return t % o.window == 0


def age(now: Column, then: Column) -> Column:
    return now - then
