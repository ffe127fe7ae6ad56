"""Replicas: presence of keys by service, missing counts, failover, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def presence(copies: DataFrame, services: int) -> DataFrame:
    """For each key the services that have it, as a bit mask, and how many lack it."""
    mask = F.bit_or(F.expr("shiftleft(1L, cast(service_id AS int))"))
    return copies.groupBy("key_norm").agg(mask.alias("mask")).withColumn("missing", (F.lit(services) - F.bit_count("mask")).cast("long"))


def missing_points(copies: DataFrame, services: int) -> DataFrame:
    """For each service the points (by arrival) that another has and it hasn't."""
    mask = presence(copies.withColumn("key_norm", F.concat_ws("#", "key_norm", "arrival_seq")), services)
    lacks = F.explode(F.filter(F.sequence(F.lit(0), F.lit(services - 1)), lambda s: F.getbit(F.col("mask"), s) == 0))
    return mask.select(lacks.alias("service_id")).groupBy("service_id").agg(F.count("*").alias("missing"))


def scan_stats(merges: DataFrame, services: int) -> DataFrame:
    """(service_id, missing, missing_by_count) from a row for each series and merge: a service lacks what the result has
    after its merge and it hasn't, and all that later ones add. A service without the series lacks all that is there.
    Series that a merge shrinks don't count. missing_by_count is null, as it is known for two services at most."""
    steps = F.array_sort(F.collect_list(F.struct("service_id", "added", "missing", "size")))
    one = merges.groupBy("key_norm").agg(steps.alias("s"), F.min(F.least("added", "missing")).alias("least")).where("least >= 0")
    every = one.withColumn("service_id", F.explode(F.sequence(F.lit(0), F.lit(services - 1)).cast("array<long>")))
    total = lambda rows, name: F.aggregate(rows, F.lit(0).cast("long"), lambda n, x: n + x[name])
    own = F.filter("s", lambda x: x["service_id"] == F.col("service_id"))
    before = F.filter("s", lambda x: x["service_id"] < F.col("service_id"))
    later = F.filter("s", lambda x: x["service_id"] > F.col("service_id"))
    there = F.when(F.size(own) > 0, total(own, "missing")).otherwise(F.coalesce(F.try_element_at(before, F.lit(-1))["size"], F.lit(0)))
    sums = every.groupBy("service_id").agg(F.sum(there + total(later, "added")).alias("missing"))
    return sums.withColumn("missing_by_count", F.lit(None).cast("long"))


def missing_by_count(merges: DataFrame) -> DataFrame:
    """For two services: how many points none and one of them lacks. Series that a merge shrinks don't count."""
    second = F.max(F.when(F.col("service_id") == 1, F.col("added"))), F.max(F.when(F.col("service_id") == 1, F.col("missing")))
    one = merges.groupBy("key_norm").agg(F.max_by("size", "step").alias("size"), F.coalesce(second[0], F.lit(0)).alias("added"), second[1].alias("lacks"), F.min(F.least("added", "missing")).alias("least")).where("least >= 0")
    lacks = one.withColumn("lacks", F.coalesce("lacks", "size"))
    counts = F.array(F.struct(F.lit(0).cast("long").alias("n_missing"), (F.col("size") - F.col("added") - F.col("lacks")).alias("n")), F.struct(F.lit(1).cast("long").alias("n_missing"), (F.col("added") + F.col("lacks")).alias("n")))
    return lacks.select(F.explode(counts).alias("c")).groupBy("c.n_missing").agg(F.sum("c.n").alias("n_points"))


def by_missing_services(copies: DataFrame, services: int) -> DataFrame:
    return presence(copies, services).groupBy("missing").agg(F.count("*").alias("n_keys"))


def failover(copies: DataFrame, complete: DataFrame) -> DataFrame:
    """For each key the first service, in order, whose copy is complete, and else the last one that has any.
    complete(service_id, key_norm, complete)."""
    order = Window.partitionBy("key_norm").orderBy(F.desc("complete"), F.when(F.col("complete"), F.col("service_id")).otherwise(-F.col("service_id")))
    chosen = complete.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("key_norm", "service_id", "complete")
    return copies.join(chosen, ["key_norm", "service_id"])


def completeness(complete: DataFrame) -> DataFrame:
    """How many complete copies each key has; a read succeeded if none has zero."""
    return complete.groupBy("key_norm").agg(F.sum(F.col("complete").cast("long")).alias("n_complete"))
