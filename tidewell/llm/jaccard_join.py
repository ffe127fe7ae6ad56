"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

A document is a row of the matrix, its set of word shingles. Equal rows are one row with a class of copies. All shingles
have one order: by hash, but those that very many documents have come last, by how many in a sample have them. Sizes give two bounds. A set of n shingles
that links has at least need(n) = p % of n in common with the other; so of its first n - need(n) + j shingles at least j
stand among the other's first ones too (j is 1 and a share of n). Only these columns of the matrix are multiplied.

- Columns of few rows give pairs of rows; their overlaps are summed, and pairs below j are discarded.
- Columns of many rows come second, with only the rows that meet others in j columns or more; those that still have
  many rows give no pairs: they are nodes beside the rows.

Rows that hold together by such pairs and nodes are a block. Within a block the whole sets' overlaps are summed over
blocks of columns; pairs of row blocks beyond the ratio of sizes are skipped and pairs below the bound discarded. Only
a spanning forest of the links leaves a block.

Nothing is dropped or capped: every pair above the bound shares a block. A block of many rows is dealt into tiles of a
bounded number of shingles, and each pair of tiles is a task's work, so a huge group of near copies costs more tasks and
not a larger one. Copies are merged before keys are made, in each task and again after the shuffle.

Cases: a null or empty text, or one without words, has no shingles and links with nothing, as does a row without a
doc_id; fewer words than n are one shingle; repeated rows and ties share the least doc_id; very long texts give more
keys; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, mix64, table
from tidewell.llm.components import components, roots
from tidewell.llm.shingles import shingle_sets


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with one it links to."""
    return (n * percent + 99) // 100


def shared(n: np.ndarray, percent: int, extra: int = 10) -> np.ndarray:
    """j: how many of the first shingles two linked sets share at least; of two sizes the lesser counts."""
    return np.minimum(1 + n * extra // 100, np.maximum(need(n, percent), 1))


def shared_sql(n: Column, percent: int, extra: int = 10) -> Column:
    """The same as an expression, for whole numbers."""
    return F.least(1 + F.floor(n * extra / 100), F.greatest(F.floor((n * percent + 99) / 100), F.lit(1)))


def prints(found: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(total, owner, mix64(found, 7))
        return mix64(total + np.bincount(owner, minlength=n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 8)


def first_shingles(found: np.ndarray, owner: np.ndarray, n: int, percent: int, common: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each set's first n - need(n) + j shingles, their owners, and whether they are common. common: sorted, and how
    common; which they are changes the work and never the links, as the order is the same for all sets."""
    sizes = np.bincount(owner, minlength=n)
    place = np.minimum(np.searchsorted(common, found), max(0, len(common) - 1))
    often = common[place] == found if len(common) else np.zeros(len(found), bool)
    order = np.lexsort((mix64(found, 9), np.where(often, times[place] if len(common) else 0, 0), owner))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    many = np.minimum(sizes, sizes - need(sizes, percent) + shared(sizes, percent))
    first = order[np.arange(len(found)) - begin[owner] < many[owner]]
    return found[first], owner[first], often[first]


def _sets(batches: Iterator[pa.RecordBatch], words: int, step: int = 400) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (doc_id, text, ...): a slice, its sets and their fingerprints. Long texts make small slices."""
    for batch in batches:
        sizes = np.cumsum([len(x) for x in (batch.column(1).cast(pa.binary()).fill_null(b"")).to_pylist()])
        at = 0
        while at < batch.num_rows:
            end = min(at + step, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 22), side="right")) + 1, batch.num_rows)
            some = batch.slice(at, end - at)
            data = [x or b"" for x in some.column(1).cast(pa.binary()).to_pylist()]
            found, owner = shingle_sets(data, words)
            yield some, found, owner, prints(found, owner, len(data))
            at = end


def described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles and print (null without shingles or id) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, owner, marks in _sets(batches, words):
            sizes = np.bincount(owner, minlength=some.num_rows)
            none = (sizes == 0) | np.array(some.column(0).is_null())
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(sizes.astype(np.int64)), pa.array(marks.view(np.int64), mask=none)], ["doc_id", "mark", "n_shingles", "print"])

    return docs.withColumn("mark", F.xxhash64("text")).mapInArrow(run, "doc_id long, mark long, n_shingles long, print long")


def common_shingles(docs: DataFrame, words: int, least: int = 3, part: int = 16, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least that many documents have in one part of 16, dealt by hash; if they are more than ``most``,
    the bound rises until they are not; and how many have them. They only steer which keys are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found, _, _ in _sets(batches, words):
            value, times = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times)], ["shingle", "n"])

    scratch = Scratch(docs.sparkSession, "common")
    chosen = docs.where(F.pmod(F.xxhash64(F.lit("common"), "doc_id"), F.lit(part)) == 0)
    counts = scratch.write(chosen.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "counts")
    for bound, many in sorted(counts.groupBy(F.least("n", F.lit(1 << 12)).alias("n")).count().collect(), reverse=True):
        most -= many
        if most < 0:
            least = bound + 1
            break
    found = counts.where(F.col("n") >= least).toPandas()
    scratch.drop("counts")
    value = found["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(value)
    return value[order], found["n"].to_numpy(np.int64)[order]


def keyed(docs: DataFrame, words: int, percent: int, common: tuple[np.ndarray, np.ndarray], most: int = 1 << 20) -> DataFrame:
    """(key, print, n, common): first shingles of each set, mostly once for each set of a task. A common shingle stands
    in the last column, and the key is the set's, so that its rows spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for some, found, owner, marks in _sets(batches, words):
            fresh, ids = np.zeros(some.num_rows, bool), np.array(some.column(0).is_null())
            if len(seen) > most:
                seen.clear()
            for i, mark in enumerate(marks.tolist()):
                if mark not in seen and not ids[i]:
                    seen.add(mark)
                    fresh[i] = True
            keep = fresh[owner]
            first, of, often = first_shingles(found[keep], owner[keep], some.num_rows, percent, *common)
            sizes = np.bincount(owner, minlength=some.num_rows)
            key = np.where(often, mix64(marks[of], 13), first).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(marks[of].view(np.int64)), pa.array(sizes[of].astype(np.int32)), pa.array(first.view(np.int64), mask=~often)], ["key", "print", "n", "common"])

    return docs.mapInArrow(run, "key long, print long, n int, common long")


_MET = "a long, na int, b long, nb int, node long"


def met(keys: DataFrame, percent: int, few: int = 32) -> DataFrame:
    """(a, na, b, nb, node) from sets that share keys. Keys of few sets give their pairs, if sizes allow a link, and a
    row with neither b nor node for each set; keys of more, and common shingles, give a node for each set. Rows come
    sorted and stream by; the memory holds a batch and the sets of one short key."""

    def rows(a, na, b=None, nb=None, node=None) -> pa.RecordBatch:
        column = lambda x, t: pa.nulls(len(a), t) if x is None else pa.array(x, t)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(na, pa.int32()), column(b, pa.int64()), column(nb, pa.int32()), column(node, pa.int64())], ["a", "na", "b", "nb", "node"])

    def pairs(begin: np.ndarray, size: np.ndarray, mark: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for m in np.unique(size):
            x, y = np.triu_indices(int(m), 1)
            at = begin[size == m]
            i, j = (at[:, None] + x).ravel(), (at[:, None] + y).ravel()
            near = (100 * n[i].astype(np.int64) >= percent * n[j].astype(np.int64)) & (100 * n[j].astype(np.int64) >= percent * n[i].astype(np.int64))
            yield rows(mark[i[near]], n[i[near]], mark[j[near]], n[j[near]])
            every = (at[:, None] + np.arange(m)).ravel()
            yield rows(mark[every], n[every])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mark, n, long_key, last = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), None, None
        for batch in batches:
            often = np.array(batch.column(3).is_valid())
            if often.any():
                some = batch.filter(pa.array(often))
                yield rows(some.column(1), some.column(2), node=some.column(3))
            key, mark, n = (np.concatenate([x, batch.column(i).to_numpy()[~often]]) for i, x in enumerate((key, mark, n)))
            if not len(key):
                continue
            fresh = np.concatenate([[(key[0], mark[0]) != last], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])])
            key, mark, n = key[fresh], mark[fresh], n[fresh]
            if not len(key):
                continue
            begin = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            size = np.diff(np.append(begin, len(key)))
            end = begin[-1]  # where the last key begins, which may go on
            many = (size > few) | (key[begin] == long_key)
            for b, s in zip(begin[many], size[many], strict=True):
                yield rows(mark[b : b + s], n[b : b + s], node=key[b : b + s])
            short = ~many & (size > 1) & (begin != end)
            yield from pairs(begin[short], size[short], mark, n)
            long_key, last = (key[end], (key[-1], mark[-1])) if many[-1] else (None, None)
            key, mark, n = (x[len(x) if many[-1] else end :] for x in (key, mark, n))
        if len(key) > 1:
            yield from pairs(np.array([0]), np.array([len(key)]), mark, n)

    return keys.repartition("key").sortWithinPartitions("key", "print").mapInArrow(run, _MET)


def candidates(keys: DataFrame, percent: int, scratch: Scratch, few: int = 32, spread: int = 1024) -> DataFrame:
    """Edges (a, b) that hold blocks together, of prints and nodes. spread: rows of a node that are no task's alone."""
    smallest = F.floor((F.col("n") * percent + 99) / 100)  # of the sets that a set of n can link to

    def entries(*found: DataFrame) -> DataFrame:
        """(a, na, node) of the last one, of sets that meet others in enough columns of all."""
        singles = found[0].where("b is null").select("a", "na", "node")
        for before in found[1:]:
            singles = singles.unionByName(before.where("b is null and node is null").select("a", "na", "node"))
        enough = singles.groupBy("a").agg(F.count("*").alias("o"), F.count("node").alias("nodes"), F.first("na").alias("n")).where((F.col("nodes") > 0) & (F.col("o") >= shared_sql(smallest, percent)))
        return found[0].where("node is not null").select("a", "na", "node").join(enough.select("a"), "a", "left_semi")

    first = scratch.write(met(keys, percent, few), "first")
    often = scratch.write(entries(first), "often")
    sized = often.join(often.groupBy("node").agg(F.count("*").alias("k")), "node")
    own = F.col("k") > spread
    again = sized.select(F.when(own, F.xxhash64("a", "node")).otherwise(F.col("node")).alias("key"), F.col("a").alias("print"), F.col("na").alias("n"), F.when(own, F.col("node")).alias("common"))
    second = scratch.write(met(again, percent, few), "second")
    pairs = first.where("b is not null").unionByName(second.where("b is not null")).groupBy("a", "b").agg(F.count("*").alias("o"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    enough = pairs.where(F.col("o") >= F.least(shared_sql(F.col("na"), percent), shared_sql(F.col("nb"), percent))).select("a", "b")
    out = scratch.write(enough.unionByName(entries(second, first).select("a", F.col("node").alias("b"))), "candidates")
    scratch.drop("first", "often", "second")
    return out


def overlaps(found: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray | None, percent: int, rows: int = 256, columns: int = 4096) -> list[tuple[int, int]]:
    """Linked pairs of rows. left and right: row numbers by size; right None: within left. The product's blocks are
    ``rows`` by ``rows``, summed over ``columns`` columns at a time; a column with one row counts in sizes only."""
    n = int(max(left.max(), right.max() if right is not None else 0)) + 1
    sizes = np.bincount(owner, minlength=n)
    _, column, times = np.unique(found, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    place = np.cumsum(times > 1) - 1
    row, col = owner[shared], place[column[shared]]
    order = np.argsort(row, kind="stable")
    row, col = row[order], col[order]
    begin = np.searchsorted(row, np.arange(n + 1))
    width = int(col.max()) + 1 if len(col) else 0
    out: list[tuple[int, int]] = []

    for i in range(0, len(left), rows):
        a = left[i : i + rows]
        other = left if right is None else right
        for j in range(i if right is None else 0, len(other), rows):
            b = other[j : j + rows]
            if 100 * sizes[a].max() < percent * sizes[b].min() or 100 * sizes[b].max() < percent * sizes[a].min():
                continue
            some = np.intersect1d(np.concatenate([col[begin[r] : begin[r + 1]] for r in a]), np.concatenate([col[begin[r] : begin[r + 1]] for r in b])) if width else np.empty(0, np.int64)
            both = np.zeros((len(a), len(b)), np.float32)
            for at in range(0, len(some), columns):
                both += dense_of(a, begin, col, some, at, columns) @ dense_of(b, begin, col, some, at, columns).T
            shared_n = both.astype(np.int64)
            good = 100 * shared_n >= percent * (sizes[a][:, None] + sizes[b][None] - shared_n)
            x, y = np.nonzero(good)
            x, y = a[x], b[y]
            keep = x != y
            out += zip(x[keep].tolist(), y[keep].tolist(), strict=True)
    return out


def dense_of(block: np.ndarray, begin: np.ndarray, col: np.ndarray, some: np.ndarray, at: int, columns: int) -> np.ndarray:
    """Rows of the incidence matrix at columns some[at : at + columns]."""
    part = some[at : at + columns]
    made = np.zeros((len(block), len(part)), np.float32)
    for i, r in enumerate(block):
        own = col[begin[r] : begin[r + 1]]
        place = np.minimum(np.searchsorted(part, own), len(part) - 1)
        made[i, place[part[place] == own]] = 1
    return made


def linked_in_tiles(members: DataFrame, words: int, percent: int) -> DataFrame:
    """From (text, rep, print, cluster, a, b, side), a tile's rows together: edges (a, b) between reps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list[tuple]) -> tuple[list[int], list[int]]:
            found, owner = shingle_sets([(r[0] or "").encode() for r in rows], words)
            marks = prints(found, owner, len(rows)).view(np.int64).tolist()
            good = [i for i, r in enumerate(rows) if marks[i] == r[2]]  # another row of that id may have another text
            sizes = np.bincount(owner, minlength=len(rows))
            by_size = lambda numbers: np.array(sorted(numbers, key=lambda i: sizes[i]), np.int64)
            left, right = by_size([i for i in good if rows[i][6] == 0]), by_size([i for i in good if rows[i][6] == 1])
            if not len(left) or rows[0][4] != rows[0][5] and not len(right):
                return [], []
            links = overlaps(found, owner, left, right if rows[0][4] != rows[0][5] else None, percent)
            root = roots(links, len(rows))
            some = [i for i in good if root[i] != i]
            return [rows[i][1] for i in some], [rows[root[i]][1] for i in some]

        held: list[tuple] = []
        made: tuple[list[int], list[int]] = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[3:6] != held[0][3:6]:
                    for side, more in zip(made, solved(held), strict=True):
                        side.extend(more)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], ["a", "b"])
            made = [], []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in solved(held)], ["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def jaccard_classes(docs: DataFrame, words: int = 5, percent: int = 80, tile: int = 3 << 19, few: int = 32) -> DataFrame:
    """From docs(doc_id, text): doc_id, mark (xxhash64 of the text), n_shingles, component_id. tile: shingles in a side of a tile, about;
    few: sets of a key that still give pairs."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = scratch.write(described(docs, words), "rows")
    common = common_shingles(docs, words)
    clusters = components(candidates(keyed(docs, words, percent, common), percent, scratch, few), scratch)
    reps = rows.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    near = scratch.write(reps.join(clusters.withColumnRenamed("id", "print"), "print"), "near")
    sums = near.groupBy("component").agg(F.ceil(F.greatest(F.sum("n") / tile, F.count("*") / 2048)).cast("int").alias("g"))
    dealt = scratch.write(near.join(sums, "component").withColumn("own", F.pmod(F.xxhash64("print"), "g").cast("int")), "dealt")
    every = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda k: F.struct(F.least(k, "own").alias("a"), F.greatest(k, "own").alias("b"), (F.col("own") > k).cast("int").alias("side")))
    placed = dealt.withColumn("tile", F.explode(every)).select(F.col("rep").alias("doc_id"), "rep", "print", F.col("component").alias("cluster"), "tile.a", "tile.b", "tile.side")
    texts = docs.join(dealt.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    members = texts.join(placed, "doc_id").select("text", "rep", "print", "cluster", "a", "b", "side")
    tiled = members.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")
    links = components(linked_in_tiles(tiled, words, percent), scratch)
    scratch.drop("candidates", "near")
    of = scratch.write(reps.join(links.withColumnRenamed("id", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id")), "of")
    scratch.drop("dealt")
    return rows.join(of, "print", "left").select("doc_id", "mark", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), words=3, percent=90).drop("mark")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w
), u AS (SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS h FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS o
  FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY ALL
), half AS (SELECT a, b FROM common WHERE 100 * o >= 90 * (na + nb - o)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, low.component_id FROM s JOIN low USING (doc_id)
"""
