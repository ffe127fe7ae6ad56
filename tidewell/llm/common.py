"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a folder of our own in local mode,
    where one machine runs all; on a cluster it must be set, as executors don't see each other's folders."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tidewell.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.tidewell.scratch", base)
    return base.rstrip("/")


class Scratch:
    """Written intermediate tables in the shared folder: they cut lineage and outlive lost executors. Operators drop
    what they have read to the end; what a lazy result still reads goes by :func:`sweep` once that is written."""

    live: list[Scratch] = []

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", {}
        Scratch.live.append(self)

    def write(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """batch: rows that Python gets at once while this table is made, where rows are large."""
        path, key = f"{self.base}/{name}-{len(self.paths)}", "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        if batch:
            self.spark.conf.set(key, str(batch))
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(key, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables whose readers have all ended."""
        for name in names:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def sweep(since: int) -> None:
    """Delete the tables of all scratches made since there were so many, when nothing that reads them is yet to run."""
    for scratch in Scratch.live[since:]:
        scratch.drop(*scratch.paths)
    del Scratch.live[since:]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Those names, lengthened until none clashes with a column (whose names Spark compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=False) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        return x ^ (x >> np.uint64(31))
