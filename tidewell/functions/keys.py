"""Keys of series: identity without case, shards and sub-shards by hash, limits, lists and times in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(key: Column) -> Column:
    """The form by which keys are equal: A-Z lower-cased."""
    return F.translate(key, UPPER, LOWER)


def key_hash(key: Column, seed: int = 0) -> Column:
    """32 bits of an md5 of seed and key. Any hash that spreads keys will do; this one exists in other engines too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), normal(key)).cast("binary")), 1, 8), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(key_hash(key), F.lit(shards))


def subshard_of(key: Column, n: int, seed: int = 1) -> Column:
    return F.pmod(key_hash(key, seed), F.lit(n))


def key_fits(key: Column, most: int) -> Column:
    return (F.octet_length(key) > 0) & (F.octet_length(key) <= most)


def names_in(text: Column) -> Column:
    """A comma-separated list, trimmed, without empty names."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def iso_seconds(text: Column) -> Column:
    """Epoch seconds of the first 19 characters of an ISO-8601 time, as UTC; fails on what is none."""
    stamp = F.to_timestamp_ntz(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return epoch_seconds(stamp)


def epoch_seconds(stamp: Column) -> Column:
    """Whole seconds since 1970 of a time without zone, whatever the session's zone."""
    day = F.datediff(stamp.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86400 + F.hour(stamp).cast("long") * 3600 + F.minute(stamp).cast("long") * 60 + F.second(stamp).cast("long")
