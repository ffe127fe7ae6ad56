"""Results for dashboards and shells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import keys


def tsv(points: DataFrame) -> DataFrame:
    """key, value and time of each point in a line."""
    return points.select("key", F.concat_ws("\t", "key", F.col("value").cast("long"), "unix_time").alias("line"))


def json_series(points: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target of targets(target), exactly as spelled, {"target", "datapoints": [[value, ms], ...]} by time.

    A response holds one series, so its points are one row; targets without points have an empty list."""
    lists = points.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("unix_time", "value"))).alias("p"))
    pairs = F.transform(F.coalesce("p", F.array().cast("array<struct<unix_time:bigint,value:double>>")), lambda x: F.array(F.round(x["value"]).cast("long"), x["unix_time"] * 1000))
    return targets.join(lists, targets["target"] == lists["key"], "left").select("target", F.to_json(F.struct("target", pairs.alias("datapoints"))).alias("response"))


REQUEST = "panelId long, range struct<from:string,to:string>, targets array<struct<target:string,refId:string>>, maxDataPoints int"


def parsed(bodies: DataFrame) -> DataFrame:
    """Requests from body, a JSON text: panel, begin and end in seconds, and a row for each target with its place."""
    one = bodies.select(F.from_json("body", REQUEST).alias("r"))
    return one.select(F.col("r.panelId").alias("panel"), keys.iso_seconds(F.col("r.range.from")).alias("begin"), keys.iso_seconds(F.col("r.range.to")).alias("end"), F.posexplode("r.targets").alias("place", "t")).select("panel", "begin", "end", "place", "t.target")


def answered(requests: DataFrame, points: DataFrame) -> DataFrame:
    """(panel, response): for each request an array of its targets' series, in the order asked."""
    found = requests.join(points.select(F.col("key").alias("target"), "unix_time", "value"), "target", "left")
    inside = F.when(F.col("unix_time").between(F.col("begin"), F.col("end")), F.struct("unix_time", "value"))
    lists = found.groupBy("panel", "place", "target").agg(F.array_sort(F.collect_list(inside)).alias("p"))
    pairs = F.transform("p", lambda x: F.array(F.round(x["value"]).cast("long"), x["unix_time"] * 1000))
    series = F.array_sort(F.collect_list(F.struct("place", F.struct("target", "datapoints").alias("s"))))
    return lists.withColumn("datapoints", pairs).groupBy("panel").agg(F.to_json(F.transform(series, lambda x: x["s"])).alias("response"))
