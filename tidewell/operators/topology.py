"""Topologies: which host serves a shard of a service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "shardCount int, serviceMap array<struct<serviceName:string,location:string,isLoggingNewKeysEnabled:boolean,shardMap:array<struct<shardId:int,hostAddress:string,port:int>>>>"


def generated(shards: DataFrame, hosts: list[str], port: int, service: str) -> DataFrame:
    """Round robin: shards(shard_id) over hosts."""
    names = F.array(*map(F.lit, hosts))
    return shards.select(F.lit(service).alias("service_name"), "shard_id", F.element_at(names, (F.col("shard_id") % len(hosts) + 1).cast("int")).alias("host"), F.lit(port).cast("long").alias("port"))


def read(spark, path: str) -> DataFrame:
    """A configuration file as (service_name, location, logging, shard_count, shard_id, host, port)."""
    config = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    services = config.select("shardCount", F.explode("serviceMap").alias("s"))
    return services.select(F.col("s.serviceName").alias("service_name"), "s.location", F.col("s.isLoggingNewKeysEnabled").alias("logging"), F.col("shardCount").alias("shard_count"), F.explode("s.shardMap").alias("m")).select("service_name", "location", "logging", "shard_count", F.col("m.shardId").alias("shard_id"), F.col("m.hostAddress").alias("host"), F.col("m.port").alias("port"))


def problems(topology: DataFrame) -> DataFrame:
    """(service_name, problem): names, hosts and ports that are missing, shards out of range, doubled or missing."""
    by_row = F.when(F.coalesce(F.col("service_name"), F.lit("")) == "", "no service name").when(F.coalesce(F.col("host"), F.lit("")) == "", "no host").when(~F.col("port").between(1, 65535), "bad port").when(~F.col("shard_id").between(0, F.col("shard_count") - 1), "shard out of range")
    rows = topology.select("service_name", by_row.alias("problem")).where("problem is not null")
    counts = topology.groupBy("service_name").agg(F.first("shard_count").alias("want"), F.count("*").alias("n"), F.count_distinct("shard_id").alias("d"))
    sums = counts.select("service_name", F.when(F.col("n") > F.col("d"), "doubled shard").when(F.col("d") < F.col("want"), "missing shard").alias("problem")).where("problem is not null")
    return rows.unionByName(sums).distinct()


def shards_of_hosts(topology: DataFrame) -> DataFrame:
    return topology.groupBy("service_name", "host", "port").agg(F.array_sort(F.collect_set("shard_id")).alias("shards"))


def host_names(text: str) -> list[str]:
    """A comma-separated list of hosts, as they are."""
    return text.split(",")


def hosts_of_shards(asked: DataFrame, topology: DataFrame) -> DataFrame:
    """asked(service_name, shard_id) with host and port, null where the service has no such shard."""
    return asked.join(topology, ["service_name", "shard_id"], "left")


def services(names: DataFrame, topology: DataFrame) -> DataFrame:
    """names(service_name) with n_shards, 0 for one that isn't there; nearest, the first by name of those that are; and
    largest, those with most shards."""
    counts = topology.groupBy("service_name").agg(F.count_distinct("shard_id").alias("n_shards"))
    ends = counts.agg(F.min("service_name").alias("first"), F.max("n_shards").alias("most"))
    known = counts.join(F.broadcast(ends)).select("service_name", "n_shards", (F.col("service_name") == F.col("first")).alias("nearest"), (F.col("n_shards") == F.col("most")).alias("largest"))
    return names.join(known, "service_name", "left").na.fill({"n_shards": 0, "nearest": False, "largest": False})
