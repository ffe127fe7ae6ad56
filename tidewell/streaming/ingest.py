"""Ingest as a stream: the batch's rules, with (last accepted time, open bucket) as the state of each series."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import keys
from tidewell.operators.ingest import admitted, prepared
from tidewell.options import Options
from tidewell.sources.storage import shared_dir

OUT = "arrival_seq long, key_norm string, unix_time long, bucket long, fate string"


def gated(points: DataFrame, o: Options) -> DataFrame:
    """No watermark: late points were repaired, not dropped. Rows of a series in a batch are put in order of arrival."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).sort_values("arrival_seq")
        now = tuple(state.get) if state.exists else None
        fates = []
        for t, b, low, primary in zip(rows["unix_time"], rows["bucket"], rows["low"], rows["primary"], strict=True):
            fate, now = admitted(now, int(t), int(b), low, primary, o.min_delta)
            fates.append(fate)
        if now:
            state.update(now)
        yield rows.assign(fate=fates)[["arrival_seq", "key_norm", "unix_time", "bucket", "fate"]]

    return points.groupBy("key_norm").applyInPandasWithState(run, OUT, "last long, now long", "append", "NoTimeout")


def ingested(events: DataFrame, points: Callable[[DataFrame], DataFrame], now: int | Column, o: Options) -> DataFrame:
    """Runs the stream ``events``, made points by a function, to what is there now and returns what it has written."""
    where = f"{shared_dir(events.sparkSession)}/ingest-{uuid.uuid4().hex}"
    fixed = prepared(points(events), now, o).where(keys.key_fits(F.col("key"), o.max_key_bytes))
    stream = gated(fixed.select("arrival_seq", "key_norm", "unix_time", "bucket", "low", "primary"), o).writeStream.format("parquet").option("checkpointLocation", f"{where}/state").option("path", f"{where}/out").trigger(availableNow=True).start()
    stream.awaitTermination()
    return events.sparkSession.read.schema(OUT).parquet(f"{where}/out")
