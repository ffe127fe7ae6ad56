"""URL filters: a cascade of Bloom filters with exact membership over a known key universe.

Level 1 encodes the listed keys. Level 2 encodes the keys of the universe that level 1 accepts wrongly, level 3 the
listed keys that level 2 accepts wrongly, and so on until a level errs on nothing. A key is listed if the first level
that refuses it has an even number. The universe is every distinct key of the corpus, so no key of the corpus is ever
judged wrongly, and the pages meet only the bit arrays: no join.

The bits go to every executor, so their size is checked: where a level would be over ``max_bits``, :func:`judge_urls`
asks that list by an equi-join of the distinct keys, which gives the same answer. Keys are known by 64-bit hashes, so
two keys of a corpus with one hash would be judged alike.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; repeated pages get
a row each; an empty list or universe gives a cascade that accepts nothing; other columns of the pages are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import LOWER, UPPER, Scratch, mix64, table

# The rules of the query, and the name parts that put a host on the block list.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BLOCKED_PARTS = ("casino", "bets", "pills", "ads", "porn", "warez")


class TooManyKeys(ValueError):
    """A level would be larger than what may go to every executor."""


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: np.ndarray

    def accepts(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for at in positions(keys, self.bits, self.hashes, self.seed):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """keys: 64-bit hashes of the universe's keys."""
        keys = keys.astype(np.int64).view(np.uint64)
        listed, open_ = np.zeros(len(keys), dtype=bool), np.arange(len(keys))
        for depth, level in enumerate(self.levels):
            passed = level.accepts(keys[open_])
            listed[open_[~passed]] = depth % 2 == 1
            open_ = open_[passed]
        listed[open_] = len(self.levels) % 2 == 1
        return listed


def positions(keys: np.ndarray, bits: int, hashes: int, seed: int) -> Iterator[np.ndarray]:
    """seed: the level's, so that keys which meet in one level part in the next."""
    keys, step = mix64(keys, 2 * seed), mix64(keys, 2 * seed + 1) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(hashes):
            yield (keys + np.uint64(i) * step) % np.uint64(bits)


def encode(keys: DataFrame, n: int, seed: int, error: float, max_bits: int) -> Level:
    """One level over the n keys of a DataFrame with a column h. Each task makes words; words are merged by bit_or."""
    bits = max(256, math.ceil(n * -math.log(error) / math.log(2) ** 2 / 64) * 64)
    if bits > max_bits:
        raise TooManyKeys(f"a level of {bits} bits is over max_bits={max_bits}")
    hashes = max(1, round(bits / max(n, 1) * math.log(2)))
    hashes = min(hashes, 16)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, int] = {}
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate([*positions(h, bits, hashes, seed)])) if len(h) else np.empty(0, np.uint64)
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                for w, v in zip(word.tolist(), value.tolist(), strict=True):
                    own[w] = own.get(w, 0) | v
        yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.int64()), pa.array(np.array([*own.values()], np.uint64).view(np.int64))], ["word", "value"])

    merged = keys.select("h").mapInArrow(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[merged["word"].to_numpy(np.int64)] = merged["value"].to_numpy(np.int64).view(np.uint64)
    return Level(bits, hashes, seed, out)


def build_cascade(listed: DataFrame, universe: DataFrame, error: float = 0.02, max_bits: int = 1 << 28) -> Cascade:
    """listed and universe: DataFrames with a string column ``key``. Distinct keys are hashed to 64 bits."""
    scratch = Scratch(universe.sparkSession, "cascade")
    hashed = lambda df: df.where("key is not null").select(F.xxhash64("key").alias("h")).distinct()
    everything = hashed(universe)
    wanted = scratch.write(everything.join(hashed(listed), "h", "left_semi"), "wanted")
    other = scratch.write(everything.join(hashed(listed), "h", "left_anti"), "other")
    levels: list[Level] = []
    n = wanted.count()
    while n:
        level = encode(wanted, n, len(levels), error, max_bits)
        levels.append(level)
        passing = F.pandas_udf(lambda h, one=level: pd.Series(one.accepts(h.to_numpy(np.int64).view(np.uint64))), "boolean")
        wrong = scratch.write(other.where(passing("h")), f"wrong{len(levels)}")
        wanted, other = wrong, wanted
        n = wrong.count()
    scratch.drop(*list(scratch.paths))
    return Cascade(tuple(levels))


def flag(cascade: Cascade, keys: Column) -> Column:
    """For an array of keys, an array of booleans: is each listed?"""

    def judge(hashes: pd.Series) -> pd.Series:
        sizes = np.array([len(x) for x in hashes], dtype=np.int64)
        flat = cascade.contains(np.concatenate([*hashes]) if sizes.sum() else np.empty(0, np.int64))
        return pd.Series(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [], dtype=object)

    return F.pandas_udf(judge, "array<boolean>")(F.transform(keys, lambda k: F.xxhash64(k)))


def flag_by_join(df: DataFrame, keys: str, listed: DataFrame, name: str) -> DataFrame:
    """The way beyond max_bits: the same array of booleans, as column ``name``, by equi-joins of distinct keys."""
    asked = df.select(keys).distinct().select(F.xxhash64(keys).alias("id"), F.explode(keys).alias("key"))
    hits = asked.join(listed.select("key").distinct(), "key").groupBy("id").agg(F.collect_set("key").alias("hits"))
    none = F.array().cast("array<string>")
    joined = df.withColumn("id", F.xxhash64(keys)).join(hits, "id", "left")
    return joined.withColumn(name, F.transform(keys, lambda k: F.array_contains(F.coalesce("hits", none), k))).drop("id", "hits")


def flagged(df: DataFrame, keys: str, listed: DataFrame, name: str, error: float, max_bits: int) -> DataFrame:
    """Adds an array of booleans: which of the keys are listed?"""
    universe = df.select(F.explode(keys).alias("key")).distinct()
    try:
        cascade = build_cascade(listed, universe, error, max_bits)
    except TooManyKeys:
        return flag_by_join(df, keys, listed, name)
    return df.withColumn(name, flag(cascade, F.col(keys)))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host and every domain above it: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every domain with every prefix of the path that has the length of some rule's path."""
    prefixes = F.filter(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substr(path, F.lit(1), n)), lambda p: F.array_contains(F.array(*map(F.lit, lengths)), F.length(p)))
    pairs = F.transform(host_suffixes(host), lambda h: F.transform(F.array_distinct(prefixes), lambda p: F.concat(h, p)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.flatten(pairs))


def judge_urls(pages: DataFrame, listed_hosts: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, error: float = 0.02, max_bits: int = 1 << 28) -> DataFrame:
    """Adds host, path, rule, listed and verdict to pages(page_id, url).

    rules: (allow or block, host, path start). A rule fits its host and all subdomains; the longest wins, and else a
    host is blocked if it or a domain above it is listed. Both the rules and the list are asked through cascades.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    lengths = sorted({len(p) for _, _, p in rules})
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    base = base.select("*", rule_keys(F.col("host"), F.col("path"), lengths).alias("_keys"), host_suffixes(F.col("host")).alias("_hosts"))
    said = base
    for act, name in (("allow", "_a"), ("block", "_b")):
        said = flagged(said, "_keys", spark.createDataFrame([(h + p,) for a, h, p in rules if a == act], "key string"), name, error, max_bits)
    said = flagged(said, "_hosts", listed_hosts, "_h", error, max_bits)
    fits = F.filter(F.zip_with("_keys", F.arrays_zip("_a", "_b"), lambda k, ab: F.when(ab["_a"] | ab["_b"], F.struct(F.length(k).alias("n"), k.alias("rule"), ab["_b"].alias("block")))), lambda x: x.isNotNull())
    best = F.array_max(fits)
    listed = F.exists("_h", lambda x: x)
    return said.select("page_id", "host", "path", best["rule"].alias("rule"), listed.alias("listed"), F.when(best.isNotNull(), F.when(best["block"], "block").otherwise("allow")).when(listed, "block").otherwise("allow").alias("verdict"))


def hosts_with_parts(pages: DataFrame, parts: tuple[str, ...] = BLOCKED_PARTS) -> DataFrame:
    """A block list for a corpus without one: of each host with a listed name part, the domain that begins with it."""
    host, _ = split_url(F.col("url"))
    marked = F.filter(host_suffixes(host), lambda h: F.arrays_overlap(F.split(F.substring_index(h, ".", 1), "-"), F.array(*map(F.lit, parts))))
    return pages.select(F.explode(marked).alias("key")).distinct()


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, hosts_with_parts(pages))


OP9_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1, 's') AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule,
    list_has_any(string_split_regex(host, '[.-]'), ['casino', 'bets', 'pills', 'ads', 'porn', 'warez']) AS listed FROM q
)
SELECT page_id, host, path, rule, listed, CASE
  WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
