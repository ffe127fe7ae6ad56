"""Substring dedup by compact windows.

Tokens are shingles of five words. For each of k hash functions the Cartesian tree over a document's token hashes gives
its compact windows: at a node c with range [l, r] all subsequences within l..r that hold c have c's hash as their
min-hash. Only nodes whose range holds a passage of the least length are made; so every passage of that length lies in
one window of each function. Windows of two functions, joined as intervals, leave runs of passages that have both
min-hashes in common; their key is the pair of tokens. Such keys bring exact passages together, and near ones with a
chance. Near passages that meet the share have a stretch of 20 equal tokens, as an edit costs nine tokens of both sides
(fewer only where words repeat): so compact windows of that width, by hashes of four tokens, give keys that near passages
are sure to have in common. A key in common with another document is a candidate.

Runs of a key aren't paired with each other. In order of document, each is paired with the first one, the pivot; so a key
costs one row for each run. Keys are dealt in buckets, as many as the texts' size asks for, and one is in memory at a time. A pivot may have both tokens and not the passage, so where a key
has three documents or more, runs whose whole content isn't the pivot's are opened: each passage in them is keyed by all
of its tokens and paired with the least document of that key. Exact passages depend on no pivot, and what is found does
not depend on how rows are dealt. Near passages are verified by the tokens of both sides, sent as the fragments that
candidates name: one counts if at least 80 % of the tokens of both sides agree, after trimming to agreeing ends. The
document with the least id keeps a passage.

Keys that very many documents have (a documented share of a sample, so their number is bounded) don't go to one task:
their pivots are a partial aggregate, broadcast, and all their runs are opened.

Cases: null and empty texts and texts shorter than a passage have none; rows without a doc_id are not compared; rows
that repeat a doc_id are not compared with each other, and what is found in one of them is not cut out of another text;
whole copies are passages of full length; ties among hashes are broken by place; very long texts are read whole; an
empty table gives no rows; other columns are not read by :func:`repeated` and kept by :func:`removed`, whatever their
names. A repeat within one document is left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, mix64, table, unused
from tidewell.llm.shingles import _BASE as BASE
from tidewell.llm.shingles import _INVERSE as INVERSE
from tidewell.llm.shingles import _powers as powers
from tidewell.llm.shingles import shingles, words

#: The hash functions whose min-hashes are a key of exact passages.
FUNCTIONS = (0, 1)
#: Tokens that a near passage has in common without a break, at least; and how many of them are a key.
STRETCH, GRAM = 20, 4
#: Bytes of text whose runs are a bucket of keys (seven times as many bytes in all, at a run for 20 bytes).
BUCKET = 3 << 20
_RUN = "bucket int, hot boolean, runs binary"
#: A run; a run of a hot key has the key behind.
ROW = np.dtype([("deal", np.uint64), ("doc", np.int64), ("s1", np.int32), ("s2", np.int32), ("c", np.int32), ("opens", np.bool_), ("whole", np.int64)])
HOT = np.dtype([(n, ROW[n]) for n in ROW.names] + [("key", np.int64)])
_MET = "kind int, key long, doc long, pdoc long, s1 int, s2 int, c int, equal boolean"


def compact_windows(value: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), inclusive, of all nodes of the Cartesian trees over the ranges [start, end) that are that wide.

    All trees grow together, a level at a time; the least value of a range comes from a table of powers of two, whose
    rows end with the last range that is so wide: so it is small if wide ranges come first."""
    ranges = np.stack([start, end - 1])[:, end - start >= least]
    if not ranges.size:
        return (np.empty(0, np.int64),) * 3
    best, width, least_value = [np.arange(len(value), dtype=np.int32)], ranges[1] - ranges[0] + 1, value
    while 2 ** len(best) <= int(width.max()):
        size, last = 2 ** len(best), best[-1]
        many, half = int(ranges[1][width >= size].max()) - size + 2, size // 2
        a, b = least_value[:many], least_value[half : half + many]
        best.append(np.where(a <= b, last[:many], last[half : half + many]))
        least_value = np.minimum(a, b)
    found = []
    while ranges.shape[1]:
        l, r = ranges
        power = np.frexp(r - l + 1)[1] - 1
        c = np.empty(len(l), np.int64)
        for p in np.unique(power):
            at = power == p
            a, b = best[p][l[at]], best[p][r[at] - 2**p + 1]
            c[at] = np.where(value[a] <= value[b], a, b)
        found.append(np.stack([l, c, r]))
        ranges = np.concatenate([np.stack([l, c - 1]), np.stack([c + 1, r])], 1)
        ranges = ranges[:, ranges[1] - ranges[0] + 1 >= least]
    return tuple(np.concatenate(found, 1))


def _ordered(value: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Values with ties broken by place."""
    return (value & ~np.uint64(0xFFFF)) | (mix64(place, 19) & np.uint64(0xFFFF))


#: Bytes of text that are worked on at a time: what is made of them fits into a core's cache.
SLICE = 1 << 19


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[tuple]:
    """From (id, text, ...): ids and texts (and what else there is, as lists) of about that many bytes at a time."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        ids, *more = (batch.column(i).to_pylist() for i in range(batch.num_columns) if i != 1)
        at = 0
        while at < len(ids):
            took, end = 0, at
            while end < len(ids) and (end == at or took + len(texts[end] or b"") <= most):
                took += len(texts[end] or b"")
                end += 1
            some = [i for i in range(at, end) if ids[i] is not None and texts[i]]
            yield np.array([ids[i] for i in some], np.int64), [texts[i] for i in some], *([x[i] for i in some] for x in more)
            at = end


def minima(value: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """For every passage of that length, in order: the place of its least value, from the compact windows."""
    l, c, r = compact_windows(value, bounds[:-1], bounds[1:], least)
    first, last = np.maximum(l, c - least + 1), np.minimum(c, r - least + 1)
    order = np.argsort(first)
    return np.repeat(c[order], (last - first + 1)[order])


class Content:
    """Hashes of any stretch of a token array, from prefix sums."""

    def __init__(self, token: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(token * powers(BASE, len(token)))])
            self.back = powers(INVERSE, len(token) + 1)

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[first]) * self.back[first] + (end - first).astype(np.uint64), 6)


def seeds(token: np.ndarray, content: Content, bounds: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(place, key, s1, s2) of the grams that are the least of a stretch: s1..s2 are the first tokens of the passages of the
    least length that hold one of the gram's stretches."""
    at = np.arange(max(0, len(token) - GRAM + 1))
    gram = content.of(at, at + GRAM)
    value = np.append(gram, np.zeros(len(token) - len(gram), np.uint64))
    ends = np.maximum(bounds[1:] - GRAM + 1, bounds[:-1])
    wide = STRETCH - GRAM + 1
    l, c, r = compact_windows(_ordered(mix64(value, 22), np.arange(len(value)) - bounds[np.append(owner, 0)[: len(value)]]), bounds[:-1], ends, wide)
    first, last = np.maximum(l, c - wide + 1), np.minimum(c, r - wide + 1)
    order = np.argsort(first)
    first, last, c = first[order], last[order], c[order]
    value, doc = gram[c], owner[c]
    new = np.nonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]))[0] if len(c) else order
    first, last, c, doc = first[new], last[np.append(new[1:], len(c))[: len(new)] - 1], c[new], doc[new]
    s1, s2 = np.maximum(bounds[doc], first - (least - STRETCH)), np.minimum(last, bounds[doc + 1] - least)
    fits = s1 <= s2
    return c[fits], mix64(gram[c[fits]], 41), s1[fits], s2[fits]


def tokens(data: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens, each text's bounds among them, and each token's first and end byte in its text."""
    hashed, text, first, end = words(data)
    token, at = shingles(hashed, text, n)
    return token, np.searchsorted(text[at], np.arange(len(data) + 1)), first[at], end[at + n - 1]


def made(ids: np.ndarray, data: list[bytes], n: int, least: int, hot: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of passages (doc, s1..s2 their first tokens) of texts, as ROW and HOT. c: where the first function's token is;
    opens: whether it is a key of exact passages; whole: a hash of all the run covers, for these; key: the key, if it is a
    hot one, whose rows are spread; deal: the key, else."""
    token, bounds, _, _ = tokens(data, n)
    owner = np.repeat(np.arange(len(data)), np.diff(bounds))
    place = np.arange(len(token)) - bounds[owner]
    start = np.nonzero(owner[: max(0, len(token) - least + 1)] == owner[least - 1 :])[0]
    if not len(start):
        return
    content = Content(token)
    for number in (0, 1):
        if number:
            c, key, s1, s2 = seeds(token, content, bounds, owner, least)
        else:
            cf, cg = (minima(_ordered(mix64(token, 20 + f), place), bounds, least) for f in FUNCTIONS)
            f, g = token[cf], token[cg]
            new = np.nonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (g[1:] != g[:-1]) | (owner[start[1:]] != owner[start[:-1]])]))[0]
            s1, s2, c = start[new], start[np.append(new[1:], len(start)) - 1], cf[new]
            with np.errstate(over="ignore"):
                key = mix64(mix64(f[new], 30) + g[new], 40)
        often = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key if len(hot) else np.zeros(len(key), bool)
        doc = owner[s1]
        rows = np.empty(len(key), HOT if often.any() else ROW)
        rows["deal"] = np.where(often, mix64(ids[doc].view(np.uint64) + s1.astype(np.uint64), 50), key) if often.any() else key
        rows["doc"], rows["s1"], rows["s2"], rows["c"] = ids[doc], s1 - bounds[doc], s2 - bounds[doc], c - bounds[doc]
        rows["opens"], rows["whole"] = number == 0, 0 if number else content.of(s1, s2 + least).view(np.int64)
        if often.any():
            rows["key"] = key.view(np.int64)
            yield rows[often]
            rows = rows[~often][[*ROW.names]].astype(ROW)
        yield rows


def dealt(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Runs by bucket, those of one as bytes: they are much less work for Spark than a row for each. Runs of hot keys are met
    by none, and lie together in any bucket."""
    bucket = (rows["deal"] % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    if rows.dtype == HOT:
        bucket[:] = bucket[0]
    rows = rows[np.argsort(bucket, kind="stable")]
    many = np.bincount(bucket, minlength=buckets)
    there = np.nonzero(many)[0]
    ends = np.append(0, np.cumsum(many[there]) * rows.itemsize).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(ends), pa.py_buffer(rows)])
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(np.full(len(there), rows.dtype == HOT)), packed], _names(_RUN))


def by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    for ids, data in slices(batches):
        order = sorted(range(len(data)), key=lambda i: -len(data[i]))  # noqa: B023
        yield ids[order], [data[i] for i in order]


def runs(docs: DataFrame, n: int, least: int, hot: np.ndarray, buckets: int) -> DataFrame:
    """Runs of docs(doc_id, text), by buckets of keys. So many are gathered before they are dealt that the number of rows
    grows with that of runs and not with the buckets' too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for ids, data in by_size(batches):
            some = [rows for rows in made(ids, data, n, least, hot) if len(rows)]
            yield from (dealt(rows, buckets) for rows in some if rows.dtype == HOT)
            held += [rows for rows in some if rows.dtype == ROW]
            many += sum(len(rows) for rows in some)
            if many > min(1024 * buckets, 1 << 20):
                yield from (dealt(np.concatenate(held), buckets) for _ in held[:1])
                held, many = [], 0
        yield from (dealt(np.concatenate(held), buckets) for _ in held[:1])

    return docs.mapInArrow(run, _RUN)


def hot_keys(docs: DataFrame, n: int, least: int, share: float = 0.001, part: int = 16) -> np.ndarray:
    """Keys of at least that share of the documents (and 16 of them) in one part of 16, dealt by hash: no more than the
    mean number of runs of a document over share. They only steer how rows are dealt."""
    return sampled(docs, n, least, share, part)[0]


def sampled(docs: DataFrame, n: int, least: int, share: float = 0.001, part: int = 16) -> tuple[np.ndarray, int]:
    """The hot keys, and in how many buckets all keys are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in by_size(batches):
            for rows in made(ids, data, n, least, np.empty(0, np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(rows["deal"].view(np.int64))], ["deal"])

    chosen = docs.where(F.pmod(F.xxhash64(F.lit("hot"), "doc_id"), F.lit(part)) == 0)
    count, size = chosen.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    found = chosen.mapInArrow(run, "deal long").groupBy("deal").count().where(F.col("count") >= max(16.0, share * count))
    return np.sort(found.select("deal").toPandas()["deal"].to_numpy(np.int64).view(np.uint64)), max(16, part * size // BUCKET)


def met(rows: DataFrame, least: int, most: int = 4096) -> DataFrame:
    """From runs: kind 0, pairs of a run with its pivot (c: how far it is from pdoc's place; equal: of equal content);
    kind 1, runs to open; kind 2, runs of hot keys as they are, equal if they are keys of exact passages; kind 3, all runs
    of a stretch's key that later ones may need besides the pivot, as they are. A bucket of keys is in memory at a time; all
    runs of keys of more than ``most`` are opened."""

    def given(kind: int, doc, s1, s2, c=None, pdoc=None, equal=None, key=None) -> pa.RecordBatch:
        k = len(doc)
        column = lambda x, t: pa.nulls(k, t) if x is None else pa.array(x, t)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), column(key, pa.int64()), column(doc, pa.int64()), column(pdoc, pa.int64()), column(s1, pa.int32()), column(s2, pa.int32()), column(c, pa.int32()), column(equal, pa.bool_())], _names(_MET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            hot = batch.column(1).to_numpy(zero_copy_only=False)
            if hot.any():
                r = np.frombuffer(b"".join(batch.column(2).filter(batch.column(1)).to_pylist()), HOT)
                yield given(2, *(r[c].copy() for c in ("doc", "s1", "s2", "c")), equal=r["opens"].copy(), key=r["key"].copy())
            for bucket, data in zip(batch.column(0).to_numpy()[~hot].tolist(), batch.column(2).filter(pa.array(~hot)).to_pylist(), strict=True):
                if bucket != current:
                    yield from groups(held)
                    held, current = [], bucket
                held.append(data)
        yield from groups(held)

    def groups(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(held), ROW)
        deal = rows["deal"].copy()
        order = np.argsort(deal)
        again = deal[order[1:]] == deal[order[:-1]]
        rows = rows[order[np.append(again, False) | np.append(False, again)]] if len(rows) else rows  # a run by itself meets nothing
        if not len(rows):
            return
        key, doc, s1, s2, c, whole, opens = (rows[x].copy() for x in ("deal", "doc", "s1", "s2", "c", "whole", "opens"))
        order = np.lexsort((whole, c, s2, s1, doc, key))
        key, doc, s1, s2, c, whole, opens = (x[order] for x in (key, doc, s1, s2, c, whole, opens))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        number = np.cumsum(new) - 1
        first = np.nonzero(new)[0]
        pdoc, p1, p2, pc, pwhole = (x[first] for x in (doc, s1, s2, c, whole))
        size = np.diff(np.append(first, len(key)))
        documents = np.bincount(number[np.concatenate([[True], (doc[1:] != doc[:-1]) | new[1:]])])
        several = (documents > 1) | (size > most)
        equal = opens & (whole == pwhole[number])
        pair = doc != pdoc[number]
        yield given(0, doc[pair], s1[pair], s2[pair] + least - 1, np.where(equal, s1 - p1[number], c - pc[number])[pair], pdoc[number][pair], equal[pair])
        differ = opens & ~equal & several[number]
        too = (np.bincount(number[differ], minlength=len(first)) > 0) | (size > most) & opens[first]
        yield given(1, np.concatenate([doc[differ], pdoc[too]]), np.concatenate([s1[differ], p1[too]]), np.concatenate([s2[differ], p2[too]]))
        again = np.bincount(number[~pair], minlength=len(first)) > 1  # the pivot's document has the key at other places
        more = ((documents > 2) | (documents > 1) & again | (size > most))[number] & ~opens
        yield given(3, doc[more], s1[more], s2[more], c[more], key=key[more].view(np.int64))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _MET)


def _counterparts(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a's tokens that b has too, and for each the place in b of the equal token nearest to its alignment."""
    order = np.argsort(b, kind="stable")
    rising = b[order]
    start = np.append(0, np.nonzero(rising[1:] != rising[:-1])[0] + 1)
    names = rising[start]
    rank = np.minimum(np.searchsorted(names, a), len(names) - 1)
    own = np.nonzero(names[rank] == a)[0]
    if len(names) == len(b):
        return own, order[rank[own]]
    rank, stop = rank[own], np.append(start, len(b))[1:]
    far = 2 * (len(a) + len(b)) + abs(shift) + 1
    keys = np.repeat(np.arange(len(names)), stop - start) * far + order
    at = np.searchsorted(keys, rank * far + np.clip(own - shift, 0, len(b) - 1))
    left, right = np.clip(at - 1, start[rank], stop[rank] - 1), np.clip(at, start[rank], stop[rank] - 1)
    return own, np.where(np.abs(order[left] - own + shift) <= np.abs(order[right] - own + shift), order[left], order[right])


def _repeats(a: np.ndarray, b: np.ndarray) -> tuple[tuple, tuple, int, bool]:
    """For either side each token's number and the place where it stood before, -1 if nowhere; how many numbers there
    are; whether any repeats."""
    names, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    out = []
    for ids in (number[: len(a)], number[len(a) :]):
        order = np.argsort(ids, kind="stable")
        before = np.full(len(ids), -1)
        again = ids[order[1:]] == ids[order[:-1]]
        before[order[1:][again]] = order[:-1][again]
        out.append((ids, before))
    return *out, len(names), any((before >= 0).any() for _, before in out)


def _distinct(own: tuple, other: tuple, n: int, i: int, x: int, j: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Which of the ranges i..j and x..y, that grow together, meet the share if tokens that repeat count once."""
    first = [lo + np.nonzero(before[lo:hi] < lo)[0] for (_, before), lo, hi in ((own, i, j[-1]), (other, x, y[-1]))]
    there = np.full(n, y[-1])
    there[other[0][first[1]]] = first[1]
    from_own, from_other = np.searchsorted(j, first[0], side="right"), np.searchsorted(y, there[own[0][first[0]]], side="right")
    common = np.bincount(np.maximum(from_own, from_other), minlength=len(j) + 1)[: len(j)].cumsum()
    return common >= share * (np.searchsorted(first[0], j) + np.searchsorted(first[1], y) - common) - 1e-9


def _heaviest(x: np.ndarray, size: np.ndarray) -> list[int]:
    """The heaviest chain of ranges x..x+size, each beginning where the one before ends or later; of equal ones the first."""
    n, ends = len(x), np.unique(x + size)
    under, put, weight = (v.tolist() for v in (np.searchsorted(ends, x, side="right"), np.searchsorted(ends, x + size) + 1, size))
    tree, before, top = [0] * (len(ends) + 1), [-1] * n, 0  # prefix maxima by end: weight of a chain and its last range in one number
    for k in range(n):
        best, at = 0, under[k]
        while at:
            best = max(best, tree[at])
            at &= at - 1
        if best:
            before[k] = n - best % (n + 1)
        best = (best // (n + 1) + weight[k]) * (n + 1) + n - k
        top, at = max(top, best), put[k]
        while at < len(tree):
            tree[at] = max(tree[at], best)
            at += at & -at
    chain = [n - top % (n + 1)]
    while before[chain[-1]] >= 0:
        chain.append(before[chain[-1]])
    return chain[::-1]


def agreeing(a: np.ndarray, b: np.ndarray, least: int, share: float, shift: int = 0) -> list[tuple[int, int, int, int]]:
    """Verified passages (first, last, first, last) of token sequences a and b, a's places less shift being about b's:
    all of the least length that begin and end with stretches of equal tokens, have at least that share of both sides'
    tokens in common and are part of no longer one. The share alone says how far other tokens are bridged."""
    if not len(a) or not len(b):
        return []
    own, there = _counterparts(a, b, shift)
    if np.count_nonzero(np.bincount(there, minlength=1)) < share * least:
        return []
    cut = np.nonzero((own[1:] - own[:-1] != 1) | (there[1:] - there[:-1] != 1))[0]
    first = np.zeros(len(cut) + 2, np.int64)
    first[1:-1], first[-1] = cut + 1, len(own)
    i, x, size = own[first[:-1]], there[first[:-1]], first[1:] - first[:-1]
    if (x[1:] < (x + size)[:-1]).any():  # the heaviest chain of stretches that rise in both
        chain = _heaviest(x, size)
        i, x, size = (v[chain] for v in (i, x, size))
    j, y, sums = i + size, x + size, np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=sums[1:])
    # no stretch after reach[k] can end a passage that begins with k: a's side alone would have too little in common
    rest = np.maximum.accumulate((sums[1:] - share * j)[::-1])[::-1]
    reach = len(i) - np.searchsorted(rest[::-1], sums[:-1] - share * i - 1e-6) - 1
    out, done, sides = [], -1, None
    for k in np.nonzero((reach >= np.arange(len(i))) & (j[np.maximum(reach, 0)] - i >= least))[0]:
        if reach[k] <= done:
            continue
        begin = max(k, done + 1)
        ends = np.arange(begin + int(np.searchsorted(j[begin : reach[k] + 1], i[k] + least)), reach[k] + 1)
        common = sums[ends + 1] - sums[k]
        good = common >= share * (j[ends] - i[k] + y[ends] - x[k] - common) - 1e-9
        if len(ends) and not good[-1]:
            sides = sides or _repeats(a, b)
            if sides[3]:
                good |= _distinct(*sides[:3], i[k], x[k], j[ends], y[ends], share)
        for e in ends[good][-1:]:
            out.append((int(i[k]), int(j[e]) - 1, int(x[k]), int(y[e]) - 1))
            done = e
    return out


def reaches(held: np.ndarray, bare: np.ndarray, least: int, share: float) -> np.ndarray:
    """For rows that say which tokens of a run another one has: whether a passage can hold one that isn't covered. It
    begins and ends with tokens that both have, and so does a range around it, in which they have the share."""
    size = held.shape[1]
    after = np.zeros((len(held), size + 1))
    np.cumsum(held - share, 1, out=after[:, 1:])
    best = np.maximum.accumulate(np.where(held, after[:, 1:], -np.inf)[:, ::-1], 1)[:, ::-1]
    next_ = np.minimum.accumulate(np.where(bare, np.arange(size), size)[..., ::-1], -1)[..., ::-1]
    end = np.maximum(np.arange(size) + least - 1, next_)
    if bare.ndim > 1:
        there = np.where(end < size, np.take_along_axis(best, np.minimum(end, size - 1), 1), -np.inf)
        return (held & (there >= after[:, :-1] - 1e-5)).any(1)
    end = end[end < size]
    return (held[:, : len(end)] & (best[:, end] >= after[:, : len(end)] - 1e-5)).any(1)


def asked(found: DataFrame, least: int, share: float) -> DataFrame:
    """What is asked of each text (doc_id): fragments (doc, pdoc, side, tokens lo..hi, and on side 0 all hits) for pairs,
    and ranges (s1, s2) of runs to open."""
    hot = found.where("kind = 2")
    pivots = hot.groupBy("key").agg(F.min(F.struct("doc", "s1", "c")).alias("p"))
    hot_pairs = hot.join(F.broadcast(pivots), "key").where("doc <> p.doc").select("doc", F.col("p.doc").alias("pdoc"), "s1", (F.col("s2") + least - 1).alias("s2"), (F.col("c") - F.col("p.c")).alias("c"), F.lit(False).alias("equal"))
    pairs = found.where("kind = 0").select("doc", "pdoc", "s1", "s2", "c", "equal").unionByName(hot_pairs)
    hits = pairs.groupBy("doc", "pdoc").agg(F.collect_list(F.struct(F.col("c").alias("shift"), F.col("s1").alias("a"), F.col("s2").alias("b"), "equal")).alias("hits"), F.min("s1").alias("a"), F.max("s2").alias("b"), F.min(F.col("s1") - F.col("c")).alias("pa"), F.max(F.col("s2") - F.col("c")).alias("pb"))
    room = F.ceil((F.greatest(F.col("b") - F.col("a"), F.col("pb") - F.col("pa")) + 1) * (1 / share - 1)).cast("int") + 1 + 2 * least
    side = lambda k, of, a, b, hits: F.struct(F.col(of).alias("doc_id"), F.lit(k).alias("side"), F.greatest(F.lit(0), F.col(a) - room).alias("lo"), (F.col(b) + room).alias("hi"), hits.alias("hits"))
    none = F.lit(None).cast(hits.schema["hits"].dataType)
    fragments = hits.select("doc", "pdoc", F.explode(F.array(side(0, "doc", "a", "b", F.col("hits")), side(1, "pdoc", "pa", "pb", none))).alias("f")).select("f.doc_id", "doc", "pdoc", "f.side", "f.lo", "f.hi", "f.hits")
    opened = found.where("kind = 1 or kind = 2 and equal").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set(F.struct("s1", "s2")).alias("ranges"))
    return fragments.unionByName(opened, allowMissingColumns=True)


_CUT = "key long, doc long, pdoc long, side int, lo int, first long, last long, mark long, part string, hits array<struct<shift:int,a:int,b:int,equal:boolean>>"


def cut(texts: DataFrame, n: int, least: int) -> DataFrame:
    """From texts(doc_id, text, mark) joined with what is asked of them: fragments, and passages by key (lo: the first
    token; first and last: code points)."""

    names = [x.split()[0] for x in _CUT.split(", ")[:10]]
    hit = pa.list_(pa.struct([("shift", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("equal", pa.bool_())]))
    types = dict(zip(names, (*[pa.int64()] * 3, *[pa.int32()] * 2, *[pa.int64()] * 3, pa.string(), hit), strict=True))

    def given(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c not in columns else columns[c].cast(t) if isinstance(columns[c], pa.Array) else pa.array(columns[c], t) for c, t in types.items()], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("text").cast(pa.binary()).to_pylist()
            rows = [*zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), strict=True)]
            at = 0
            while at < len(rows):
                number: dict[tuple, int] = {}
                took, upto = 0, at
                while upto < len(rows) and (upto == at or took < SLICE):
                    if rows[upto] not in number:
                        number[rows[upto]] = len(number)
                        took += len(data[upto])
                    upto += 1
                of = np.array([number[r] for r in rows[at:upto]])
                texts = [b""] * len(number)
                for k, i in enumerate(of):
                    texts[i] = data[at + k]
                yield from made(batch.slice(at, upto - at), of, texts)
                at = upto

    def made(rows: pa.RecordBatch, of: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        token, bounds, first, end = tokens(texts, n)
        sizes, counts = np.diff(bounds), {}

        def points(i: int, byte: np.ndarray | int) -> np.ndarray:
            """The code points that bytes of a text begin."""
            if i not in counts:
                raw = np.frombuffer(texts[i], np.uint8)
                counts[i] = None if texts[i].isascii() else np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            return byte if counts[i] is None else counts[i][byte]

        opened = rows.filter(rows.column("ranges").is_valid())
        if opened.num_rows:
            lists = opened.column("ranges")
            ends = lists.offsets.to_numpy()
            s1, s2 = (lists.values.field(k).to_numpy() for k in ("s1", "s2"))
            content, own = Content(token), of[np.array(rows.column("ranges").is_valid())]
            found = []
            for i, a, b in zip(own.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                inside = np.zeros(max(0, int(sizes[i]) - least + 1), bool)
                for c, d in zip(s1[a:b].tolist(), s2[a:b].tolist(), strict=True):
                    inside[c : d + 1] = True
                s = np.nonzero(inside)[0]
                found.append((s, bounds[i] + s, points(i, first[bounds[i] + s]), points(i, end[np.minimum(bounds[i] + s + least - 1, len(end) - 1)])))
            place, at, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
            many = [len(f[0]) for f in found]
            docs, marks = (np.repeat(opened.column(c).to_numpy(), many) for c in ("doc_id", "mark"))
            yield given(len(at), key=content.of(at, at + least).view(np.int64), doc=docs, lo=place, first=low, last=high, mark=marks)

        asked = np.array(rows.column("doc").is_valid()) & (rows.column("lo").fill_null(0).to_numpy() < sizes[of])
        part = rows.filter(pa.array(asked))
        if part.num_rows:
            spans = [(i, int(first[bounds[i] + lo]), int(end[bounds[i] + min(hi, sizes[i] - 1)])) for i, lo, hi in zip(of[asked], part.column("lo").to_pylist(), part.column("hi").to_pylist(), strict=True)]
            yield given(part.num_rows, doc=part.column("doc"), pdoc=part.column("pdoc"), side=part.column("side"), lo=part.column("lo"), first=[int(points(i, a)) for i, a, _ in spans], mark=part.column("mark"), part=[texts[i][a:b].decode() for i, a, b in spans], hits=part.column("hits"))

    return texts.mapInArrow(run, _CUT)


_FOUND = "doc_id long, start long, end long, source_doc_id long, source_start long, source_end long, mark long"


def same_passages(cuts: DataFrame) -> DataFrame:
    """Passages of the least length, keyed by all of their tokens, paired with the least document of their key; those
    that follow each other in both documents are joined. The least ones are partial aggregates; the join with them sees
    a key's rows in one task, as plain rows that stream by."""
    keyed = cuts.where("key is not null").select("key", "doc", "lo", "first", "last", "mark")
    least = keyed.groupBy("key").agg(F.min(F.struct("doc", "lo", "first", "last")).alias("p"), F.max("doc").alias("most")).where("p.doc < most")
    pairs = keyed.join(least.select("key", "p"), "key").where("doc <> p.doc").select("doc", "mark", "lo", "first", "last", F.col("p.doc").alias("pdoc"), F.col("p.lo").alias("plo"), F.col("p.first").alias("pfirst"), F.col("p.last").alias("plast")).distinct()
    order = Window.partitionBy("doc", "mark", "pdoc", F.col("lo") - F.col("plo")).orderBy("lo")
    stretch = pairs.withColumn("shift", F.col("lo") - F.col("plo")).withColumn("island", F.col("lo") - F.row_number().over(order))
    joined = stretch.groupBy("doc", "mark", "pdoc", "shift", "island").agg(F.min("first").alias("start"), F.max("last").alias("end"), F.min("pfirst").alias("source_start"), F.max("plast").alias("source_end"))
    return joined.select(F.col("doc").alias("doc_id"), "start", "end", F.col("pdoc").alias("source_doc_id"), "source_start", "source_end", "mark")


def joined_hits(hits: list[tuple]) -> list[tuple[int, int, int]]:
    """(shift, a, b) of hits, those of one alignment that meet joined."""
    out: list[list[int]] = []
    for shift, a, b in sorted(h[:3] for h in hits):
        if out and out[-1][0] == shift and a <= out[-1][2] + 1:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([shift, a, b])
    return [(s, a, b) for s, a, b in out]


def plainly(a: np.ndarray, b: np.ndarray, least: int, share: float, shift: int) -> list[tuple[int, int, int, int]] | None:
    """What :func:`agreeing` finds if they share too few tokens, or nothing but a stretch of equal ones; else None."""
    own, other = a.tolist(), b.tolist()
    common = sum(map({*other}.__contains__, own))
    if common < share * least:
        return []
    low, high = max(0, shift), min(len(a), len(b) + shift)
    if high - low < least:
        return None
    edges = np.nonzero(np.diff(np.concatenate([[False], a[low:high] == b[low - shift : high - shift], [False]])))[0]
    if not len(edges):
        return None
    longest = int((edges[1::2] - edges[::2]).argmax())
    i, j = low + int(edges[2 * longest]), low + int(edges[2 * longest + 1])
    alone = j - i == common >= least and sum(map({*own}.__contains__, other)) == common
    return [(i, j - 1, i - shift, j - 1 - shift)] if alone else None


def verified(cuts: DataFrame, n: int, least: int, share: float) -> DataFrame:
    """From fragments: the passages that hold."""

    def passages(hits: list[tuple], own: np.ndarray, lo: int, other: np.ndarray, plo: int) -> Iterator[tuple[int, int, int, int]]:
        """All that passages of the fragments and of an interval cover is found: the fragments as a whole come first, and
        what they leave of an interval. own and other begin with tokens lo and plo of their documents; so do the places
        returned."""
        covered, held = np.zeros(len(own), bool), np.fromiter(map({*other.tolist()}.__contains__, own.tolist()), bool, len(own))
        common = np.nonzero(held)[0]
        joined = sorted(joined_hits(hits), key=lambda h: h[1] - h[2])
        windows = [(0, len(own), 0, len(other), joined[0][0])] if joined else []
        for shift, a, b in joined:
            room = int((b - a + 1) * (1 / share - 1)) + 1
            windows.append((max(0, a - lo - room), b - lo + room + 1, max(0, a - shift - plo - room), max(0, b - shift - plo + room + 1), shift))
        for i, j, x, y, shift in windows:
            first, end = np.searchsorted(common, (i, j))
            if first == end or covered[common[first] : common[end - 1] + 1].all():
                continue
            if covered.any() and not reaches(held[None, i:j], ~covered[i:j], least, share).any():
                continue
            sides, between = (own[i:j], other[x:y]), shift - (lo + i) + (plo + x)
            plain = plainly(*sides, least, share, between)
            for a0, b0, x0, y0 in agreeing(*sides, least, share, between) if plain is None else plain:
                if not covered[a0 + i : b0 + i + 1].all():
                    covered[a0 + i : b0 + i + 1] = True
                    yield a0 + i, b0 + i, x0 + x, y0 + x
        for shift, a, b in joined_hits([h for h in hits if h[3]]):
            a, b = a - lo, b - lo
            x, y = a + lo - shift - plo, b + lo - shift - plo
            if 0 <= a and 0 <= x and b < len(own) and y < len(other) and not covered[a : b + 1].all() and (own[a : b + 1] == other[x : y + 1]).all():
                covered[a : b + 1] = True
                yield a, b, x, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        todo: list[tuple[tuple, tuple]] = []
        same: list[tuple] = []
        took = 0

        def pairs() -> None:
            nonlocal took
            for own in held:
                for other in held:
                    if own[2] == 0 and other[2] == 1 and alike(own, other):
                        length = len(own[6].decode())
                        same.append((own[0], own[4], own[4] + length, own[1], other[4], other[4] + length, own[5]))
                        took += 1
                    elif own[2] == 0 and other[2] == 1:
                        todo.append((own, other))
                        took += len(own[6]) + len(other[6])

        for batch in batches:
            parts = batch.column(6).cast(pa.binary()).to_pylist()
            lists, ends = batch.column(7), batch.column(7).offsets.to_numpy()
            flat = lists.values.slice(ends[0], ends[-1] - ends[0])
            flat, ends = [*zip(*(flat.field(i).to_pylist() for i in range(4)), strict=True)], (ends - ends[0]).tolist()
            hits = [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), parts, hits, strict=True):
                if held and row[:2] != held[0][:2]:
                    pairs()
                    held = []
                    if took > SLICE:
                        yield solved(todo, same)
                        todo, same, took = [], [], 0
                held.append(row)
        pairs()
        yield solved(todo, same)

    def alike(own: tuple, other: tuple) -> bool:
        """Whether a pair of fragments is one passage, as they are equal and the longest run is where it is in the other one."""
        if own[3] != other[3] or own[6] != other[6] or len(own[6].split()) < least + n - 1:
            return False
        joined = joined_hits(own[7])
        return bool(joined) and min(joined, key=lambda h: h[1] - h[2])[0] == 0

    def solved(todo: list[tuple[tuple, tuple]], same: list[tuple]) -> pa.RecordBatch:
        data = [side[6] for pair in todo for side in pair]
        token, bounds, first, end = tokens(data, n)
        out = [*same]
        for k, (own, other) in enumerate(todo):
            a_, b_ = (slice(bounds[2 * k + i], bounds[2 * k + i + 1]) for i in (0, 1))
            for a, b, x, y in passages(own[7], token[a_], own[3], token[b_], other[3]):
                spans = []
                for side, i, j in ((0, a, b), (1, x, y)):
                    text, base, at = data[2 * k + side], int(bounds[2 * k + side]), todo[k][side][4]
                    spans += (at + len(text[: int(first[base + i])].decode()), at + len(text[: int(end[base + j])].decode()))
                out.append((own[0], *spans[:2], own[1], *spans[2:], own[5]))
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(7)], [x.split()[0] for x in _FOUND.split(", ")])

    fragments = cuts.where("key is null and side < 2").select("doc", "pdoc", "side", "lo", "first", "mark", "part", "hits")
    return fragments.repartition("doc", "pdoc").sortWithinPartitions("doc", "pdoc", "side").mapInArrow(run, _FOUND)


_OPENED = "key long, doc long, mark long, lo int, first int, last int, place int, tokens binary, covered binary"


def opened(texts: DataFrame, n: int, least: int, share: float) -> DataFrame:
    """From texts(doc_id, text, mark, base) with runs (of stretches' keys) and spans found so far: each run
    (lo + first..last) with tokens around it, from lo on, and which of them the spans cover. place: of the key's token."""
    names = [x.split()[0] for x in _OPENED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, marks, bases, runs, spans in slices([batch]):
                token, bounds, first, end = tokens(data, n)
                out: list[tuple] = []
                for k, text in enumerate(data):
                    own, size = token[bounds[k] : bounds[k + 1]].astype(np.uint32), int(bounds[k + 1] - bounds[k])
                    covered = np.zeros(size, bool)
                    if spans[k]:
                        low, high = first[bounds[k] : bounds[k + 1]], end[bounds[k] : bounds[k + 1]]
                        if not text.isascii():
                            counts = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                            low, high = counts[low], counts[high]
                        for span in spans[k]:
                            covered[np.searchsorted(low, span["start"] - bases[k]) : np.searchsorted(high, span["end"] - bases[k], side="right")] = True
                    for r in runs[k]:
                        a, b = r["s1"], r["s2"] + least - 1
                        if b < size:
                            room = int((b - a + 1) * (1 / share - 1)) + 1
                            lo, hi = max(0, a - room), min(size, b + room + 1)
                            out.append((r["key"], ids[k], marks[k], lo, a - lo, b - lo, r["c"], own[lo:hi].tobytes(), np.packbits(covered[lo:hi]).tobytes()))
                        if len(out) >= 2000:
                            yield given(out)
                            out = []
                yield given(out)

    def given(out: list[tuple]) -> pa.RecordBatch:
        types = [*[pa.int64()] * 3, *[pa.int32()] * 4, *[pa.binary()] * 2]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    return texts.select("doc_id", "text", "mark", "base", "runs", "spans").mapInArrow(run, _OPENED)


class Group:
    """Runs of one key, in order of document, of different contents: for each one what of it a passage in an earlier
    one's document can still cover. Only runs that can meet the share and cover more are compared.

    A passage that covers more holds a token that isn't covered and that both have; or it bridges a stretch between two
    covered ones, that is then no more than a quarter of the run. And both have more than ``few`` of the run's tokens,
    so one besides any tokens that fill ``few`` places: the most common ones. Where no token repeats, all stretches that a
    run has in common with any earlier one are known at once: two of them must begin and end a passage. Contents that meet
    again, as lines that repeat do, are compared once."""

    def __init__(self, rows: list[tuple], least: int, share: float):
        self.rows, self.least, self.share = rows, least, share
        self.few = int(np.ceil(share * least - 1e-9)) - 1
        sizes = [r[5] - r[4] + 1 for r in rows]
        self.at = np.cumsum([0, *sizes])
        self.owner = np.repeat(np.arange(len(rows)), sizes)
        names, self.number = np.unique(np.concatenate([self.part(k, 7) for k in range(len(rows))]), return_inverse=True)
        order = np.argsort(self.number, kind="stable")
        number, owner = self.number[order], self.owner[order]
        once = np.concatenate([[True], (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])])
        self.holders = owner[once]
        self.begin = np.searchsorted(number[once], np.arange(len(names) + 1))
        self.times = np.diff(np.append(np.nonzero(once)[0], len(order)))
        self.repeats = np.bincount(self.holders, minlength=len(rows)) < sizes
        contents: dict[bytes, int] = {}
        self.content = [contents.setdefault(self.part(k, 7).tobytes(), k) for k in range(len(rows))]
        self.compared: dict[tuple, list] = {}
        self.bare = ~np.concatenate([self.part(k, 8) for k in range(len(rows))])
        self.first = self.holders[self.begin[:-1]]
        self.order, self.doc, self.block = order, np.array([r[1] for r in rows]), np.array([r[9] for r in rows])
        self.slot = np.full(len(names), -1)

    def part(self, k: int, of: int) -> np.ndarray:
        return self.rows[k][of][self.rows[k][4] : self.rows[k][5] + 1]

    def bridged(self, k: int) -> bool:
        there = np.nonzero(self.part(k, 8))[0]
        gaps, tokens = np.nonzero(np.diff(there) > 1)[0], self.part(k, 7)
        return any(len(np.unique(tokens[there[g] + 1 : there[g + 1]])) <= len(tokens) * (1 / self.share - 1) for g in gaps)

    def shares(self, most: int = 1 << 21) -> np.ndarray | None:
        """Which runs of earlier documents (columns) have enough of a run's tokens, as often, by one product of matrices;
        None, if there are too many tokens for that."""
        new = np.repeat(np.cumsum(self.times) - self.times, self.times)  # the nth of equal tokens of a run is a column
        nth = np.arange(len(self.order)) - new
        column = self.number[self.order] if not nth.any() else np.unique(self.number[self.order] * (nth.max() + 1) + nth, return_inverse=True)[1]
        if len(self.rows) * (int(column.max()) + 1) > most:
            return None
        there = np.zeros((len(self.rows), int(column.max()) + 1), np.float32)
        there[self.owner[self.order], column] = 1
        return (there @ there.T > self.few + 0.5) & (self.doc[:, None] > self.doc)

    def narrowed(self) -> np.ndarray:
        """Of those that share enough, which may cover more of a run; for all runs of a group at once."""
        sizes = np.diff(self.at)
        place = np.arange(int(sizes.max()))
        inside = place < sizes[:, None]
        at = np.minimum(self.at[:-1, None] + place, len(self.number) - 1)
        number, bare = np.where(inside, self.number[at], len(self.begin) - 1), inside & self.bare[at]
        self.has = np.zeros((len(self.rows), len(self.begin)), bool)
        self.has[self.holders, np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))] = True
        shared = self.shared & bare.any(1)[:, None]
        k, j = np.nonzero(shared)
        for lo in range(0, len(k), step := max(1, (1 << 18) // len(place))):
            ks, js = k[lo : lo + step], j[lo : lo + step]
            shared[ks, js] = reaches(self.has[js[:, None], number[ks]], bare[ks], self.least, self.share)
        return shared

    def probe(self, tokens: np.ndarray, slot: np.ndarray, bare: np.ndarray) -> np.ndarray:
        """The rarest tokens of a run (slot: the token at each place), so many that the others don't suffice for a passage
        over what isn't covered: a run that may cover more has one of them."""
        order = np.argsort((self.begin[tokens + 1] - self.begin[tokens]), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        low, high = 0, len(order)
        while low < high:  # the least number that is enough, by eight trials at a time
            tried = np.unique(np.linspace(low, high - 1, 8).astype(np.int64))
            enough = tried[~reaches(rank[slot] >= tried[:, None], bare, self.least, self.share)]
            high = int(enough[0]) if len(enough) else high
            low = int(tried[tried < high][-1]) + 1 if (tried < high).any() else high
        return tokens[order[:high]]

    def gathered(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of those runs, one after the other: which run it is, counted in found, and where it stands among all."""
        many = self.at[found + 1] - self.at[found]
        row = np.repeat(np.arange(len(found)), many)
        return row, np.arange(len(row)) + np.repeat(self.at[found] - np.cumsum(many) + many, many)

    def possible(self, k: int, crossing: bool, most: int = 64) -> tuple[np.ndarray, ...]:
        """Which runs before it may hold a passage that covers more of run k, and which of its tokens each one has; these
        tokens, which one is at each place and how often they are there. Such a run has enough of its tokens, as often, and
        begins and ends with stretches of equal tokens between which both sides have the share. The latter is not asked of
        runs with repeated tokens or more stretches than ``most``."""
        tokens, slot, times = np.unique(self.number[self.at[k] : self.at[k + 1]], return_inverse=True, return_counts=True)
        bare = self.bare[self.at[k] : self.at[k + 1]]
        self.slot[tokens] = np.arange(len(tokens))
        if self.shared is None:
            found, has = self.probed(k, tokens, slot, times, bare)
        else:
            found = np.nonzero(self.shared[k])[0]
            has = self.has[found[:, None], tokens]
        if crossing:
            good = self.block[found] != self.block[k]
            found, has = found[good], has[good]
        if not self.repeats[k] and len(found):
            good = self.fitting(k, found, slot, bare, most)
            found, has = found[good], has[good]
        self.slot[tokens] = -1
        return found, has, tokens, slot, times

    def probed(self, k: int, tokens: np.ndarray, slot: np.ndarray, times: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of earlier documents that may cover more of run k, of those that have a token that these must have; and
        which of its tokens each one has."""
        probe = self.probe(tokens, slot, bare)
        having = np.concatenate([np.empty(0, np.int64), *(self.holders[self.begin[t] : self.begin[t + 1]] for t in probe[self.first[probe] < k])])
        found = np.unique(having[having < k])
        found = found[self.doc[found] < self.doc[k]]
        kept, step = [(found[:0], np.empty((0, len(tokens)), bool))], max(1, (1 << 18) // len(slot))
        for lo in range(0, len(found), step):
            some = found[lo : lo + step]
            row, at = self.gathered(some)
            there = self.slot[self.number[at]]
            row, there = row[there >= 0], there[there >= 0]
            counts = np.bincount(row * len(tokens) + there, minlength=len(some) * len(tokens)).reshape(len(some), -1)
            good = np.nonzero(np.minimum(counts, times).sum(1) > self.few)[0]
            good = good[reaches((counts[good] > 0)[:, slot], bare, self.least, self.share)]
            kept.append((some[good], counts[good] > 0))
        return tuple(np.concatenate(x) for x in zip(*kept, strict=True))

    def fitting(self, k: int, found: np.ndarray, slot: np.ndarray, bare: np.ndarray, most: int) -> np.ndarray:
        """Of which of those runs two stretches can begin and end a passage; all with repeated tokens."""
        good = self.repeats[found].copy()
        row, at = self.gathered(found)
        there = self.slot[self.number[at]]
        own = np.nonzero((there >= 0) & ~good[row])[0]
        run, p = row[own], np.argsort(slot)[there[own]]
        order = np.lexsort((p, run))
        run, p, x = run[order], p[order], (at[own] - self.at[found[run]])[order]
        before = np.concatenate([[0], np.cumsum(bare)])
        first = np.nonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (np.diff(p) != 1) | (np.diff(x) != 1)]))[0] if len(run) else own
        end, of = np.append(first[1:], len(run))[: len(first)], run[first]
        begins = np.searchsorted(of, np.arange(len(found) + 1))
        several = np.diff(begins)
        good |= several > most
        later = np.where(several[of] > most, 0, begins[of + 1] - np.arange(len(of)))
        for lo in range(0, len(of), 4096):  # pairs of stretches of one run, the first and the last of a passage
            n = later[lo : lo + 4096]
            s = np.repeat(np.arange(lo, lo + len(n)), n)
            e = s + np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
            i, j, u, v = first[s], end[e], x[first[s]], x[end[e] - 1] + 1
            long, other, common = p[j - 1] + 1 - p[i], v - u, j - i
            fits = (long >= self.least) & ((s == e) | (x[first[e]] > x[end[s] - 1])) & (common >= self.share * (long + other - common) - 1e-6)
            good[of[s[fits & (before[p[j - 1] + 1] > before[p[i]])]]] = True
        return good

    def links(self, crossing: bool) -> Iterator[tuple]:
        """(doc, mark, first, last, pdoc, pmark, first, last) of passages, by token, that cover more."""
        barren: set[tuple] = set()  # runs of one document of equal contents, of which no more is covered
        self.shared = self.shares()
        if self.shared is None:
            hope = {*np.unique(self.owner[self.bare & (self.first[self.number] < self.owner)]).tolist()}
            some = np.array([k for k in np.unique(self.owner[self.bare]).tolist() if k in hope or self.bridged(k)], np.int64)
        else:
            self.shared = self.narrowed() if self.shared.any() else self.shared
            some = np.nonzero(self.shared.any(1))[0]
        for k in some.tolist():
            row = self.rows[k]
            state = *row[1:3], self.content[k], row[6] - row[3] - row[4], self.part(k, 8).tobytes()
            if state not in barren:
                links = [*self._links(k, crossing)]
                yield from links
                if not links:
                    barren.add(state)

    def _links(self, k: int, crossing: bool) -> Iterator[tuple]:
        doc, mark, lo, a, b, place, own, covered = self.rows[k][1:9]
        found, has, tokens, slot, times = self.possible(k, crossing)  # what covers no more now never will
        often = self.begin[tokens + 1] - self.begin[tokens]
        order = np.argsort(-often, kind="stable")
        rare, tried = order[np.cumsum(times[order]) > self.few], np.zeros(len(found), bool)
        while len(found) and not covered[a : b + 1].all():
            bare = np.unique(slot if self.bridged(k) else slot[~covered[a : b + 1]])
            shared = has[:, min((bare, rare), key=lambda t: often[t].sum())].sum(1)  # those that share most come first
            rest = np.nonzero((shared > 0) & ~tried)[0]
            for i_ in rest[np.argsort(-shared[rest], kind="stable")].tolist():
                j, more = int(found[i_]), False
                tried[i_] = True
                pdoc, pmark, plo, x, y, pplace, other, _ = self.rows[j][1:9]
                shift = (place - lo) - (pplace - plo)
                pair = self.content[k], self.content[j], shift - a + x
                if pair not in self.compared:
                    self.compared[pair] = agreeing(self.part(k, 7), self.part(j, 7), self.least, self.share, pair[2])
                for i, p, passages in ((a, x, self.compared[pair]), (0, 0, None)):
                    for a0, b0, x0, y0 in agreeing(own, other, self.least, self.share, shift) if passages is None else passages:
                        if not covered[i + a0 : i + b0 + 1].all():
                            more = True
                            covered[i + a0 : i + b0 + 1] = True
                            yield doc, mark, lo + i + a0, lo + i + b0, pdoc, pmark, plo + p + x0, plo + p + y0
                    if not more:
                        break
                if more:
                    tried |= ~reaches(has[:, slot], ~covered[a : b + 1], self.least, self.share)
                    break
            else:
                return


def hopeful(rows: list[tuple], least: int, share: float, most: int = 6) -> bool:
    """Whether any of a few runs may cover more of a later one: stretches that both have, and between which both have the
    share, lie before and behind a token that isn't covered (where tokens repeat, any tokens that both have). True of more
    runs than ``most``, if any isn't covered."""
    bare = [k for k in range(1, len(rows)) if not rows[k][8][rows[k][4] : rows[k][5] + 1].all()]
    if not bare or len(rows) > most:
        return bool(bare)
    parts = [r[7][r[4] : r[5] + 1].tolist() for r in rows]
    places = [dict(zip(p, range(len(p)), strict=True)) for p in parts]
    for k in bare:
        covered = rows[k][8][rows[k][4] : rows[k][5] + 1]
        for j in range(k):
            if rows[j][1] < rows[k][1]:
                there = places[j]
                both = [(p, there[t]) for p, t in enumerate(parts[k]) if t in there]
                if len(both) < share * least - 1e-9 or both[-1][0] - both[0][0] < least - 1 or covered[both[0][0] : both[-1][0] + 1].all():
                    continue
                if len(places[k]) < len(parts[k]) or len(there) < len(parts[j]):
                    return True
                begins = [n for n, (p, x) in enumerate(both) if not n or both[n - 1] != (p - 1, x - 1)]
                ends = [*begins[1:], len(both)]
                for n, s in enumerate(begins):
                    p, x = both[s]
                    for e in ends[n:]:
                        q, y = both[e - 1]
                        long, other, common = q + 1 - p, y + 1 - x, e - s
                        if long >= least and other > 0 and common >= share * (long + other - common) - 1e-6 and not covered[p : q + 1].all():
                            return True
    return False


_LINKED = "doc long, mark long, first int, last int, pdoc long, pmark long, pfirst int, plast int"


def linked(rows: DataFrame, least: int, share: float, most: int = 4096) -> DataFrame:
    """From opened runs: passages of runs with any earlier one of their key that cover what wasn't covered. Keys of more
    than ``most`` runs are dealt as pairs of blocks."""
    names = [x.split()[0] for x in _LINKED.split(", ")]
    blocks = rows.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(blocks), "key", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit("block"), "doc"), "blocks")).cast("int"))
    other = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = dealt.withColumn("o", F.explode(other)).select("key", *_names(_OPENED)[1:], "block", F.least("block", "o").alias("b1"), F.greatest("block", "o").alias("b2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: dict[bytes, int] = {}
        tile, out = None, []
        for batch in batches:
            for *row, block, b1, b2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row[0], b1, b2) != tile:
                    out += solved(held, tile)
                    tile, held, seen = (row[0], b1, b2), [], {}
                    if len(out) > 1000:
                        yield given(out)
                        out = []
                if seen.setdefault(row[7][4 * row[4] : 4 * row[5] + 4], row[1]) == row[1]:  # an equal run of an earlier document covers it
                    held.append((*row, block))
        yield given(out + solved(held, tile))

    def solved(held: list[tuple], tile: tuple | None) -> list[tuple]:
        if len(held) < 2:
            return []
        rows = [(*r[:7], np.frombuffer(r[7], np.uint32), np.unpackbits(np.frombuffer(r[8], np.uint8), count=len(r[7]) // 4).view(bool), r[9]) for r in held]
        return [*Group(rows, least, share).links(tile[1] != tile[2])] if hopeful(rows, least, share) else []

    def given(out: list[tuple]) -> pa.RecordBatch:
        types = 2 * [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    return tiles.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2", "doc", "mark", "lo", "first").mapInArrow(run, _LINKED)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def placed(found: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Passages by token as passages by code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, marks, bases, asked in slices([batch]):
                _, bounds, first, end = tokens(data, n)
                out = [(int(ids[k]), marks[k], a["first"], a["last"], bases[k] + len(data[k][: first[bounds[k] + a["first"]]].decode()), bases[k] + len(data[k][: end[bounds[k] + a["last"]]].decode())) for k in range(len(data)) for a in asked[k]]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(6)], ["doc", "mark", "first", "last", "start", "end"])

    sides = found.select("doc", "mark", "first", "last").unionByName(found.select(F.col("pdoc").alias("doc"), F.col("pmark").alias("mark"), F.col("pfirst").alias("first"), F.col("plast").alias("last")))
    asked = sides.groupBy(F.col("doc").alias("doc_id"), "mark").agg(F.collect_set(F.struct("first", "last")).alias("asked"))
    places = texts.join(asked, ["doc_id", "mark"]).select("doc_id", "text", "mark", "base", "asked").mapInArrow(run, "doc long, mark long, first long, last long, start long, end long").distinct()
    p = places.select(F.col("doc").alias("pdoc"), F.col("mark").alias("pmark"), F.col("first").alias("pfirst"), F.col("last").alias("plast"), F.col("start").alias("source_start"), F.col("end").alias("source_end"))
    both = found.join(places, ["doc", "mark", "first", "last"]).join(p, ["pdoc", "pmark", "pfirst", "plast"])
    return both.select(F.col("doc").alias("doc_id"), "start", "end", F.col("pdoc").alias("source_doc_id"), "source_start", "source_end", "mark")


def whole_pairs(found: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of texts of passages by token as fragments, as a passage can be wider than what is around one key."""
    hits = found.groupBy("doc", "mark", "pdoc", "pmark").agg(F.collect_list(F.struct((F.col("first") - F.col("pfirst")).cast("int").alias("shift"), F.col("first").cast("int").alias("a"), F.col("last").cast("int").alias("b"), F.lit(False).alias("equal"))).alias("hits"))
    own, other = (hits.select("doc", "pdoc", F.col(d).alias("doc_id"), F.col(m).alias("mark"), F.lit(side).alias("side"), h.alias("hits")) for side, d, m, h in ((0, "doc", "mark", F.col("hits")), (1, "pdoc", "pmark", F.lit(None).cast(hits.schema["hits"].dataType))))
    both = own.unionByName(other.dropDuplicates(["doc", "pdoc", "mark"])).join(texts, ["doc_id", "mark"])
    return both.select(F.lit(None).cast("long").alias("key"), "doc", "pdoc", "side", F.lit(0).alias("lo"), F.col("base").alias("first"), "mark", F.col("text").alias("part"), "hits")


def repeated(docs: DataFrame, passage: int = 50, n: int = 5, share: float = 0.8) -> DataFrame:
    """Passages of docs(doc_id, text) of at least that many words that stand, nearly alike, in a document of a smaller
    id: doc_id, start, end, source_doc_id, source_start, source_end, and mark, a hash of the text they stand in."""
    scratch = Scratch(docs.sparkSession, "passages")
    least = passage - n + 1
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    found = scratch.write(met(runs(docs, n, least, *sampled(docs, n, least)), least), "met", batch=256)
    later = found.where("kind = 3 or kind = 2 and not equal")
    whole = later.select(F.col("doc").alias("doc_id"), "doc").distinct().select("*", F.lit(2).alias("side"), F.lit(0).alias("lo"), F.lit(2**31 - 1).alias("hi"))
    texts = docs.withColumn("mark", F.xxhash64("text")).join(asked(found, least, share).unionByName(whole, allowMissingColumns=True), "doc_id")
    cuts = scratch.write(cut(texts, n, least), "cut", batch=256)
    out = scratch.write(verified(cuts, n, least, share).unionByName(same_passages(cuts)).distinct(), "found", batch=1000)
    texts = cuts.where("side = 2").select(F.col("doc").alias("doc_id"), F.col("part").alias("text"), "mark", F.col("first").alias("base"))
    first = texts.groupBy("mark").agg(F.min("doc_id").alias("doc_id"))  # copies of a text are covered by the first one
    several = later.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set(F.struct("key", "s1", "s2", "c")).alias("runs"))
    open_ = texts.join(first, ["doc_id", "mark"]).join(several, "doc_id").join(merged(out, "doc_id", "mark"), ["doc_id", "mark"], "left")
    rest = scratch.write(linked(scratch.write(opened(open_, n, least, share), "opened", batch=256), least, share), "linked", batch=1000)
    more = scratch.write(placed(rest, texts, n), "placed", batch=256)
    wider = scratch.write(verified(whole_pairs(rest, texts), n, least, share), "wider", batch=256)
    scratch.drop("met", "cut", "opened", "linked")
    return out.unionByName(more).unionByName(wider)


def merged(found: DataFrame, *keys: str) -> DataFrame:
    """(doc_id or keys, spans): each one's passages, those that meet joined, as array of (start, end, source_doc_id)."""
    keys = keys or ("doc_id",)
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    islands = found.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(upto))
    spans = islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("source_doc_id").alias("source_doc_id"))
    return spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "source_doc_id"))).alias("spans"))


def removed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the passages found: the texts around them are joined; the columns stay."""
    doc, mark, spans = unused(docs, "doc", "mark", "spans")
    cuts = merged(found, "doc_id", "mark").select(F.col("doc_id").alias(doc), F.col("mark").alias(mark), F.col("spans").alias(spans))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length("text").cast("long")))
    text = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(F.col("text"), a.cast("int") + 1, (b - a).cast("int"))), "")
    joined = docs.join(cuts, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(mark)), "left")
    return joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(text)).select(*docs.columns)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with repeated passages: doc_id, source_docs (the ids they come from), n_passages, chars,
    spans (start:end, comma-joined, of the passages with those that meet joined)."""
    found = repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sources = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("source_doc_id")).alias("source_docs"))
    one = merged(found).join(sources, "doc_id")
    chars = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return one.select("doc_id", "source_docs", F.size("spans").cast("long").alias("n_passages"), chars.alias("chars"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"))
