"""The points table: events as points, written once in an order that reads can skip by."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.options import Options
from tidewell.sources.events import as_points, read_events

DAY = 86400
_WRITTEN: dict[tuple[str, str, Options], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode, where it may be unset, one of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-tidewell-")
    return base.rstrip("/")


def write_points(points: DataFrame, path: str) -> None:
    """A folder for each day; files are ranges of shard, key and time, so hot days and series are many files."""
    days = points.withColumn("day", F.floor(F.col("unix_time") / DAY))
    days.repartitionByRange("day", "shard_id", "key_norm", "unix_time").sortWithinPartitions("day", "shard_id", "key_norm", "unix_time").write.partitionBy("day").parquet(path)


def stored_points(spark: SparkSession, sf_dir: str, o: Options) -> DataFrame:
    """The points of a folder's events, from a table that the first call of an application writes in the shared folder.
    Events of a folder are taken not to change while the application runs."""
    known = spark.sparkContext.applicationId, sf_dir, o
    if known not in _WRITTEN:
        path = f"{shared_dir(spark)}/points-{uuid.uuid4().hex}"
        write_points(as_points(read_events(spark, sf_dir), o), path)
        _WRITTEN[known] = path
    return spark.read.parquet(_WRITTEN[known])


def within(points: DataFrame, begin: int, end: int) -> DataFrame:
    """Only the days that a time range touches are read; points without days are as they were."""
    return points.where(F.col("day").between(begin // DAY, end // DAY)) if "day" in points.columns else points
