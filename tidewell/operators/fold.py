"""Folds along a series, where each point's fate hangs on the last one kept.

A point that comes at least the least distance after the point before it is kept whatever came earlier, so a series
falls into runs that don't know of each other. Runs begin at every such gap, found within slices of time and from one
summary row for each slice. Points that are a run by themselves, most of them in a sparse series, are decided without
Python; the others stream by in order, in memory that doesn't grow. A series without any gap is one run, so one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_runs(points: DataFrame, series: list[str], delta: int, services: bool = False, width: int = 1 << 20) -> DataFrame:
    """Adds run, equal for the points of a run, which begins with each point that comes at least delta after all before
    it, and alone, if a point and its successor begin runs. services: adds mask too, the services that the series has.

    Runs are numbered within slices of ``width`` seconds; the first run of a slice may go on from the one before."""
    inner = Window.partitionBy(*series, "slice").orderBy("unix_time")
    order = Window.partitionBy(*series).orderBy("slice")
    near = points.withColumn("slice", F.floor(F.col("unix_time") / width)).withColumn("last", F.lag("unix_time").over(inner)).withColumn("next", F.lead("unix_time").over(inner))
    breaks = (F.col("unix_time") - F.col("last") >= delta).cast("long")
    near = near.withColumn("number", F.sum(F.coalesce(breaks, F.lit(0))).over(inner))  # by range, so that equal times are in one run
    marks = [F.bit_or(F.expr("shiftleft(1L, cast(service_id AS int))")).alias("mask")] if services else []
    spans = near.groupBy(*series, "slice").agg(F.min("unix_time").alias("low"), F.max("unix_time").alias("high"), F.max("number").alias("numbers"), *marks)
    known = spans.withColumn("before", F.lag("high").over(order)).withColumn("after", F.lead("low").over(order))
    begins = lambda a, b: F.coalesce(b - a >= delta, F.lit(True))
    own = lambda number: F.col("slice") * (1 << 32) + number
    fresh = begins(F.col("before"), F.col("low"))
    ends_with = F.when((F.col("numbers") > 0) | fresh, own(F.col("numbers")))  # the run that a slice ends with, if it began there
    carried = F.last("tail", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    known = known.withColumn("first", fresh).withColumn("tail", ends_with).withColumn("carried", carried)
    if services:
        known = known.withColumn("mask", F.bit_or("mask").over(Window.partitionBy(*series)))
    both = near.join(known.drop("low", "high", "numbers", "tail"), [*series, "slice"])
    run = F.when((F.col("number") == 0) & ~F.col("first"), F.col("carried")).otherwise(own(F.col("number")))
    alone = begins(F.coalesce("last", "before"), F.col("unix_time")) & begins(F.col("unix_time"), F.coalesce("next", "after"))
    return both.withColumn("run", run).withColumn("alone", alone).drop("slice", "last", "next", "number", "before", "after", "first", "carried")


def kept(new: np.ndarray, t: np.ndarray, delta: int, last: int | None) -> np.ndarray:
    """Which points of runs stay, each at least delta after the last one that did. new: where runs begin; last: the last
    point kept of the run that the first ones belong to, if they don't begin one. All runs take a step at a time."""
    low = int(t.min())
    number = np.cumsum(new)
    line = number * (int(t.max()) - low + delta + 1) + (t - low)
    stay, at = np.zeros(len(t), bool), np.nonzero(new)[0]
    if not new[0]:
        at = np.append(np.searchsorted(line[: int((number == 0).sum())], last + delta - low), at)
        at = at[(number[np.minimum(at, len(t) - 1)] > 0) | (at < (number == 0).sum())]
    while len(at):
        stay[at] = True
        then = np.searchsorted(line, line[at] + delta)
        at = then[(then < len(t)) & (number[np.minimum(then, len(t) - 1)] == number[at])]
    return stay


def changes(columns: list[np.ndarray], before: tuple | None) -> np.ndarray:
    """Where a row differs from the one before it in any column."""
    differs = columns[0][1:] != columns[0][:-1]
    for c in columns[1:]:
        differs = differs | (c[1:] != c[:-1])
    return np.concatenate([[before is None or before != tuple(c[0] for c in columns)], differs]).astype(bool)


def thinned(points: DataFrame, series: list[str], delta: int, rank: str | None = None) -> DataFrame:
    """Greedy thinning in order of time: a point stays if it comes at least delta after the last one that stayed."""
    order = [*series, "run", "unix_time", *([rank] if rank else [])]
    runs = with_runs(points, series, delta)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for rows in batches:
            if not len(rows):
                continue
            columns, t = [rows[c].to_numpy() for c in [*series, "run"]], rows["unix_time"].to_numpy()
            stay = kept(changes(columns, now), t, delta, last)
            now = tuple(c[-1] for c in columns)
            last = int(t[stay][-1]) if stay.any() else last
            yield rows[stay]

    contested = runs.where(~F.col("alone")).repartition(*series, "run").sortWithinPartitions(*order)
    return runs.where("alone").unionByName(contested.mapInPandas(keep, runs.schema)).drop("run", "alone")


def merge_fates(copies: DataFrame, services: int, delta: int, epsilon: float) -> DataFrame:
    """Copies of series (key_norm, service_id, unix_time, value, arrival_seq), merged service after service: the first
    copy is taken as it is; each later one is merged into the result by time, the result first on ties, and thinned.

    Adds copy (1 for the first service that has the series), copies (how many have it), died (the merge in which the
    point was displaced, null if it stays) and off (it was, and its value differs by more than epsilon, relative or
    absolute). A series that one service has is never thinned. Contested points alone stream through the merges."""
    below = F.expr("mask & (shiftleft(1L, cast(service_id AS int)) - 1)")
    runs = with_runs(copies.select("key_norm", "service_id", "unix_time", "value", "arrival_seq"), ["key_norm"], delta, services=True)
    ranked = runs.select("key_norm", "run", "service_id", "unix_time", "value", "arrival_seq", (F.bit_count(below) + 1).cast("int").alias("copy"), F.bit_count("mask").cast("int").alias("copies"), F.lit(None).cast("int").alias("died"), F.lit(False).alias("off"), "alone")
    settled = F.col("alone") | (F.col("copies") == 1)
    contested = ranked.where(~settled).drop("alone")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in contested.schema])

    def merge(step: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, held = None, None, 0.0
        for rows in batches:
            died, off = rows["died"].to_numpy(np.float64, na_value=np.nan, copy=True), rows["off"].to_numpy(bool, copy=True)
            part = np.nonzero(np.isnan(died) & (rows["copy"].to_numpy() <= step))[0]
            if len(part):
                columns, t, v = [rows[c].to_numpy()[part] for c in ("key_norm", "run")], rows["unix_time"].to_numpy()[part], rows["value"].to_numpy()[part]
                stay = kept(changes(columns, now), t, delta, last)
                nearest = np.maximum.accumulate(np.where(stay, np.arange(len(t)), -1))
                over = np.where(nearest >= 0, v[nearest], held)
                died[part[~stay]] = step
                off[part[~stay]] = (np.abs(v - over) > np.maximum(epsilon * np.abs(over), epsilon))[~stay]
                now = tuple(c[-1] for c in columns)
                if stay.any():
                    last, held = int(t[stay][-1]), float(v[stay][-1])
            yield rows.assign(died=pd.array(died).astype("Int32"), off=off)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for step in range(2, services + 1):
            batches = merge(step, batches)
        yield from batches

    # copies in order on ties: so what the result has comes before the copy that is merged, in every step
    dealt = contested.repartition("key_norm", "run").sortWithinPartitions("key_norm", "run", "unix_time", "copy", "arrival_seq")
    return ranked.where(settled).drop("alone").unionByName(dealt.mapInPandas(run, schema))


def merged(copies: DataFrame, services: int, delta: int, epsilon: float) -> DataFrame:
    """The merged series: (key_norm, unix_time, value)."""
    return merge_fates(copies, services, delta, epsilon).where("died is null").select("key_norm", "unix_time", "value")


def merge_stats(fates: DataFrame, services: int) -> DataFrame:
    """By series and merge (step, the service it brings): in_size points of the service, size of the result after it,
    added by it, missing from it, and mismatches. A step that shrinks the result has a negative number added."""
    steps = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("step")
    rows = fates.select("key_norm", "service_id", "copy", "copies", F.coalesce("died", F.lit(services + 1)).alias("died"), "off", steps)
    own, inside = F.col("copy") == F.col("step"), (F.col("copy") <= F.col("step")) & (F.col("died") > F.col("step"))
    before = (F.col("copy") < F.col("step")) & (F.col("died") >= F.col("step"))
    sums = rows.groupBy("key_norm", "step").agg(F.max(F.when(own, F.col("service_id"))).alias("service_id"), F.count_if(own).alias("in_size"), F.count_if(inside).alias("size"), F.count_if(before).alias("old"), F.count_if(F.col("off") & (F.col("died") == F.col("step"))).alias("mismatches"))
    return sums.select("key_norm", F.col("step").cast("long").alias("step"), "service_id", "in_size", "size", (F.col("size") - F.col("old")).alias("added"), (F.col("size") - F.col("in_size")).alias("missing"), "mismatches")
