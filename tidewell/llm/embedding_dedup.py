"""Embedding near-dedup by an epsilon grid order join.

Vectors of unit length with cosine >= c lie within eps = sqrt(2 - 2c) of each other, and so do their projections. The
rows are sorted by label and by the grid cells (width eps) of their leading principal coordinates, and cut into blocks
of consecutive rows, each with its bounds. Two blocks are compared only if their bounds come within eps in every
leading dimension; within a pair of blocks the sequences are halved recursively, again skipping halves that are
provably distant, and what remains is decided by cosine in double precision.

Equal vectors of a label are one row with a weight before the join, so copies cost nothing; a block holds a fixed
number of rows, so a label or cell that holds most rows is spread over many tasks. A block pair gives at most one count
and one edge for each of its rows, whatever the number of links.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label or id, link
with nothing; vectors of unequal length never link; repeated rows count as vectors; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, table
from tidewell.llm.components import components, roots

SLACK = 1e-9


def principal(rows: DataFrame, size: int, leading: int) -> np.ndarray:
    """The leading eigenvectors of the unit vectors' second moments: one pass; each task gives one size-by-size sum."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = unit(np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, size))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["i", "x"])

    got = rows.where(F.size("v") == size).select("v").mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()
    if got.empty:
        return np.zeros((size, 0))
    _, vectors = np.linalg.eigh(got["x"].to_numpy().reshape(size, size))
    return vectors[:, ::-1][:, :leading]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Scaled by their greatest component first, so that no finite row's squares leave the range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near(xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray, same: bool, eps: float, cosine: float, leaf: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers with cosine of xa and xb at least that; ya and yb are the leading coordinates. If same, the
    sequences are one and each pair comes once."""
    todo = [(0, len(xa), 0, len(xb))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1 or same and b1 <= a0 + 1 and b0 >= a0:
            continue
        if (np.maximum(ya[a0:a1].min(0) - yb[b0:b1].max(0), yb[b0:b1].min(0) - ya[a0:a1].max(0)) > eps + SLACK).any():
            continue
        if a1 - a0 <= leaf and b1 - b0 <= leaf:
            i, j = np.nonzero(xa[a0:a1] @ xb[b0:b1].T >= cosine)
            i, j = i + a0, j + b0
            yield (i[i < j], j[i < j]) if same else (i, j)
            continue
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        if same and (a0, a1) == (b0, b1):
            todo += [(a0, am, a0, am), (a0, am, am, a1), (am, a1, am, a1)]
        elif a1 - a0 >= b1 - b0:
            todo += [(a0, am, b0, b1), (am, a1, b0, b1)]
        else:
            todo += [(a0, a1, b0, bm), (a0, a1, bm, b1)]


def linked(vectors: DataFrame, cosine: float = 0.98, leading: int = 8, block: int = 1024) -> DataFrame:
    """From vectors(vec_id, embedding, label): vec_id, n_links, component_id, kept for each row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ego")
    v = F.col("embedding").cast("array<double>")
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(good, F.concat_ws(":", F.xxhash64("label", v), F.xxhash64(v, "label", F.lit(1)))).alias("key"), F.when(good, v).alias("v"), "label")
    reps = scratch.write(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"), F.first("label").cast("string").alias("label")), "reps")
    counts, edges = [], []
    sizes = [r[0] for r in reps.select(F.size("v")).distinct().collect()]
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    for size in sizes:
        axes = principal(reps, size, min(leading, size))
        blocks = scratch.write(in_blocks(reps.where(F.size("v") == size), size, axes, eps, block), f"blocks{size}")
        said = scratch.write(compared(block_pairs(blocks, eps), blocks, size, axes, eps, cosine), f"said{size}", batch=16)
        counts.append(said.where("other is null").select("rep", "n"))
        edges.append(said.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    base = rows.select("vec_id", "key").join(reps.select("key", "rep", "weight"), "key", "left")
    if not counts:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    several = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(several(dfs[1:]))
    found = components(several(edges), scratch)
    found = reps.select("key", "rep").join(several(counts).groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    reached = scratch.write(found.select("key", "n", "component"), "reached")
    out = base.join(reached, "key", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("weight") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def in_blocks(reps: DataFrame, size: int, axes: np.ndarray, eps: float, block: int) -> DataFrame:
    """Rows in epsilon grid order, cut into blocks: block, label, lo and hi (bounds), reps, weights and vectors."""
    coordinates = F.pandas_udf(lambda v: pd.Series([*(unit(np.stack(v.to_list())) @ axes)] if len(v) else [], dtype=object), "array<double>")
    cells = reps.withColumn("y", coordinates("v")).withColumn("cells", F.transform("y", lambda y: F.floor(y / eps)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, number = [], TaskContext.get().partitionId() << 32

        def made(rows: list[dict]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            y = np.array([r["y"] for r in rows])
            columns = [number, rows[0]["label"], y.min(0).tolist(), y.max(0).tolist(), np.array([r["rep"] for r in rows], np.int64).tobytes(), np.array([r["weight"] for r in rows], np.int64).tobytes(), np.array([r["v"] for r in rows], np.float64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "label", "lo", "hi", "reps", "weights", "vectors"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["label"] != held[0]["label"] or len(held) == block):
                    yield made(held)
                    held = []
                held.append(row)
        if held:
            yield made(held)

    order = ["label", *(F.col("cells")[i] for i in range(axes.shape[1])), "rep"]
    ranged = cells.repartitionByRange(*order).sortWithinPartitions(*order).select("rep", "weight", "v", "label", "y")
    return ranged.mapInArrow(cut, "block long, label string, lo array<double>, hi array<double>, reps binary, weights binary, vectors binary")


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(x, y), x <= y: blocks of a label whose bounds come within eps. They meet by the cells of the first dimension."""
    heads = blocks.select("block", "label", "lo", "hi")
    cell = lambda bound, more: F.floor(F.col(bound)[0] / eps) + more
    x = heads.select(F.col("block").alias("x"), "label", F.col("lo").alias("x_lo"), F.col("hi").alias("x_hi"), F.explode(F.sequence(cell("lo", -1), cell("hi", 1))).alias("cell"))
    y = heads.select(F.col("block").alias("y"), "label", F.col("lo").alias("y_lo"), F.col("hi").alias("y_hi"), F.explode(F.sequence(cell("lo", 0), cell("hi", 0))).alias("cell"))
    apart = F.exists(F.zip_with(F.zip_with("x_lo", "y_hi", lambda a, b: a - b), F.zip_with("y_lo", "x_hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b)), lambda d: d > eps + SLACK)
    return x.join(y, ["label", "cell"]).where(F.col("x") <= F.col("y")).where(~apart).select("x", "y").distinct()


def compared(pairs: DataFrame, blocks: DataFrame, size: int, axes: np.ndarray, eps: float, cosine: float) -> DataFrame:
    """(rep, other, n): counts have no other; edges, a spanning forest of each block pair's links, have no n."""
    side = lambda k: blocks.select(F.col("block").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("reps", "weights", "vectors")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {k: batch.column(i)[row].as_py() for i, k in enumerate(batch.schema.names)}
                same = one["x"] == one["y"]
                ids, weights, xs, ys = [], [], [], []
                for k in ("x", "y"):
                    ids.append(np.frombuffer(one[f"{k}_reps"], np.int64))
                    weights.append(np.frombuffer(one[f"{k}_weights"], np.int64))
                    xs.append(unit(np.frombuffer(one[f"{k}_vectors"], np.float64).reshape(-1, size)))
                    ys.append(xs[-1] @ axes)
                n = len(ids[0])
                count, links = [np.zeros(len(i), np.int64) for i in ids], []
                for i, j in near(xs[0], ys[0], xs[1], ys[1], same, eps, cosine):
                    np.add.at(count[0], i, weights[1][j])
                    np.add.at(count[0 if same else 1], j, weights[0][i])
                    links += zip(i.tolist(), (j if same else j + n).tolist(), strict=True)
                all_ids = ids[0] if same else np.concatenate(ids)
                count = count[0] if same else np.concatenate(count)
                root = np.array(roots(links, len(all_ids)), np.int64)
                some, joined = np.nonzero(count)[0], np.nonzero(root != np.arange(len(root)))[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([all_ids[some], all_ids[joined]])), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(all_ids[root[joined]])]), pa.concat_arrays([pa.array(count[some]), pa.nulls(len(joined), pa.int64())])],
                    ["rep", "other", "n"],
                )

    return pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(run, "rep long, other long, n long")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), low AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, low.component_id, v.vec_id = low.component_id AS kept FROM v JOIN low USING (vec_id)
"""
