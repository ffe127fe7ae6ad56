"""The registered queries over events, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import blocks as block, buckets, keys
from tidewell.operators import deviations, fold, ingest, lifecycle, read, render, replica, status, topology
from tidewell.options import EVENTS as O
from tidewell.options import NOW
from tidewell.sources.events import arrivals, as_points, read_events, replicas, shard_states, stream_events
from tidewell.sources.storage import stored_points
from tidewell.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
BEGIN, END = 1704672000, 1705708800  # 2024-01-08 and 2024-01-20
HOSTS = ["host-a", "host-b", "host-c"]
SERVICES = 3
ARRIVING = replace(O, max_key_bytes=9)  # so that some keys are too long
_ALL: dict[str, tuple[Query, str | None]] = {}

BASE = f"""
p0 AS (SELECT event_id AS arrival_seq, event_type, user_id, event_type || ':' || user_id AS key, floor(epoch(ts))::BIGINT AS unix_time, value,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 WHEN 'login' THEN 5 ELSE 0 END::BIGINT AS category_id FROM events),
p1 AS (SELECT *, lower(key) AS key_norm, ('0x' || substr(md5('0:' || lower(key)), 1, 8))::BIGINT % {O.shards} AS shard_id FROM p0),
points AS (SELECT *, CASE WHEN unix_time < shard_id * {O.window} // {O.shards} THEN 0 ELSE (unix_time - shard_id * {O.window} // {O.shards}) // {O.window} END::BIGINT AS bucket FROM p1)"""
ARRIVALS = f"""
e0 AS (SELECT event_id, event_type || ':' || user_id % 4 AS key, floor(epoch(ts))::BIGINT AS t0, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 WHEN 'login' THEN 5 ELSE 0 END::BIGINT AS category_id FROM events),
e1 AS (SELECT *, lower(key) AS key_norm, ('0x' || substr(md5('0:' || lower(key)), 1, 8))::BIGINT % {O.shards} AS shard_id, t0 + event_id * 7919 % 1800 - 90 AS now, event_id % 4 = 0 AS low, event_id % 7 <> 0 AS prim FROM e0),
e2 AS (SELECT *, shard_id * {O.window} // {O.shards} AS off, now * 4294967296 + event_id AS arrival_seq, CASE WHEN t0 = 0 OR t0 < now - {O.behind} OR t0 > now + {O.ahead} THEN now ELSE t0 END AS t FROM e1),
arrivals AS (SELECT *, CASE WHEN t < off THEN 0 ELSE (t - off) // {O.window} END AS b FROM e2)"""
SERIES = """
cat0 AS (SELECT shard_id, key_norm, min(arrival_seq) AS first_seq, arg_min(key, arrival_seq) AS key, arg_max(category_id, arrival_seq) AS category_id, min(unix_time) AS first_time,
  max(unix_time) AS last_time, min(bucket) AS min_bucket, max(bucket) AS max_bucket, count(*) AS n_points FROM points GROUP BY shard_id, key_norm),
catalogue AS (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY first_seq) - 1 AS series_id FROM cat0)"""
COPIES = """
copies AS (SELECT p.* REPLACE (unix_time + (s = 1)::BIGINT AS unix_time, value * CASE WHEN s = 2 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS value), s::BIGINT AS service_id
  FROM points p, (VALUES (0), (1), (2)) v(s) WHERE (s = 0 AND arrival_seq % 3 <> 0) OR (s = 1 AND arrival_seq % 3 <> 1) OR (s = 2 AND arrival_seq % 5 <> 0))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _ALL[name] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_points(spark, sf_dir, O)


@query("q_wn01_bucket_functions", f"""WITH {BASE}, o AS (SELECT *, shard_id * {O.window} // {O.shards} AS off FROM points)
SELECT arrival_seq, shard_id, bucket, bucket * {O.window} + off AS start_time, (unix_time - off) // {O.window} * {O.window} + off AS floor_time,
  CASE WHEN unix_time <= off THEN off ELSE ((unix_time - 1 - off) // {O.window} + 1) * {O.window} + off END AS ceil_time, unix_time // {O.window} AS aligned_bucket,
  unix_time - unix_time % {O.window} AS aligned_floor, unix_time % {O.window} = 0 AS is_aligned, 3 * {O.window}::BIGINT AS three_buckets, unix_time // {O.window} AS buckets_in FROM o""")
def bucket_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = F.col("unix_time"), F.col("shard_id")
    return points_of(spark, sf_dir).select("arrival_seq", "shard_id", "bucket", buckets.bucket_start(F.col("bucket"), s, O).alias("start_time"), buckets.floor_time(t, s, O).alias("floor_time"), buckets.ceil_time(t, s, O).alias("ceil_time"), buckets.aligned_bucket(t, O).alias("aligned_bucket"), buckets.aligned_floor(t, O).alias("aligned_floor"), buckets.is_aligned(t, O).alias("is_aligned"), buckets.duration(F.lit(3).cast("long"), O).alias("three_buckets"), buckets.buckets_in(t, O).alias("buckets_in"))


@query("q_sc01_get_data", f"""WITH {BASE}, k AS (SELECT DISTINCT key_norm FROM points), r AS (SELECT upper(key_norm) AS key, key_norm, true AS known FROM k UNION ALL SELECT upper('no-' || key_norm), 'no-' || key_norm, false FROM k)
SELECT r.key AS request_idx, r.key, CASE WHEN known THEN 0 ELSE 3 END::BIGINT AS status, p.unix_time, p.value FROM r LEFT JOIN points p ON p.key_norm = r.key_norm AND p.unix_time BETWEEN {BEGIN} AND {END}""")
def get_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    known = points.select("key_norm").distinct()
    asked = known.select(F.upper("key_norm").alias("key")).unionByName(known.select(F.upper(F.concat(F.lit("no-"), "key_norm")).alias("key")))
    return read.get_data(points, asked.withColumn("request_idx", F.col("key")), BEGIN, END, O)


@query("q_sc02_scan_shards", f"""WITH {BASE}, b AS (SELECT *, shard_id * {O.window} // {O.shards} AS off FROM points)
SELECT shard_id, key_norm, count(*) AS n_points, min(unix_time) AS first_time, max(unix_time) AS last_time, count(DISTINCT bucket) AS n_blocks, ('0x' || substr(md5('1:' || key_norm), 1, 8))::BIGINT % 4 AS subshard
FROM b WHERE bucket BETWEEN ({BEGIN} - off) // {O.window} AND ({END} - off) // {O.window} GROUP BY shard_id, key_norm""")
def scan_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan_shards(points_of(spark, sf_dir), BEGIN, END, 4, O)


@query("q_sc03_page", f"""WITH {BASE}, {SERIES}, s AS (SELECT shard_id, max(series_id) + 1 AS slots FROM catalogue GROUP BY shard_id)
SELECT shard_id, series_id, key, 15 < slots AS more FROM catalogue JOIN s USING (shard_id) WHERE series_id BETWEEN 5 AND 14""")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.page(read.series(points_of(spark, sf_dir)), 5, 10).select("shard_id", "series_id", "key", "more")


@query("q_sc04_last_updates", f"WITH {BASE}, {SERIES} SELECT shard_id, key_norm, category_id, last_time AS update_time FROM catalogue WHERE last_time >= {END}")
def last_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.last_updates(read.series(points_of(spark, sf_dir)), END)


@query("q_sc05_series", f"WITH {BASE}, {SERIES} SELECT * FROM catalogue")
def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.series(points_of(spark, sf_dir))


@query("q_fl03_blacklist", f"""WITH {BASE}, f AS (SELECT *, row_number() OVER (PARTITION BY key_norm, bucket ORDER BY unix_time, arrival_seq) AS rn FROM points)
SELECT arrival_seq, key_norm, unix_time FROM f WHERE NOT unix_time BETWEEN {BEGIN} AND {END} OR rn = 1""")
def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.without_blacklist(points_of(spark, sf_dir), BEGIN, END).select("arrival_seq", "key_norm", "unix_time")


@query("q_fl04_repair", f"WITH {ARRIVALS} SELECT arrival_seq, t AS unix_time, t <> t0 AS repaired FROM arrivals")
def repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = arrivals(read_events(spark, sf_dir), ARRIVING)
    fixed = ingest.repaired(F.col("unix_time"), F.col("now"), ARRIVING)
    return points.select("arrival_seq", fixed.alias("unix_time"), (fixed != F.col("unix_time")).alias("repaired"))


@query("q_wn14_thinning", f"""WITH RECURSIVE {BASE}, r AS (SELECT arrival_seq, event_type, unix_time, row_number() OVER (PARTITION BY event_type ORDER BY unix_time, arrival_seq) AS rn FROM points),
g AS (SELECT *, unix_time AS last, true AS keep FROM r WHERE rn = 1 UNION ALL
  SELECT r.*, CASE WHEN r.unix_time - g.last >= 600 THEN r.unix_time ELSE g.last END, r.unix_time - g.last >= 600 FROM g JOIN r ON r.event_type = g.event_type AND r.rn = g.rn + 1)
SELECT arrival_seq, event_type, unix_time FROM g WHERE keep""")
def thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense series: all events of a type, at least ten minutes apart."""
    points = points_of(spark, sf_dir).withColumn("bucket", buckets.aligned_bucket(F.col("unix_time"), O)).select("arrival_seq", "event_type", "bucket", "unix_time")
    return fold.thinned(points, ["event_type"], 600, "arrival_seq").select("arrival_seq", "event_type", "unix_time")


def _fates(seeds: str = "SELECT DISTINCT key_norm, 0::BIGINT AS last, -1::BIGINT AS open, false AS known FROM arrivals", where: str = f"octet_length(key::BLOB) <= {ARRIVING.max_key_bytes}") -> str:
    """Arrivals and their fates, point after point of each series."""
    fate = f"""CASE WHEN NOT known AND low THEN 'blocked' WHEN NOT known AND NOT prim THEN 'not_primary' WHEN r.b < open THEN 'old_bucket' WHEN last <> 0 AND r.t - last < {ARRIVING.min_delta} THEN 'spam' ELSE 'accepted' END"""
    return f"""WITH RECURSIVE {ARRIVALS}, r AS (SELECT *, row_number() OVER (PARTITION BY key_norm ORDER BY arrival_seq) AS rn FROM arrivals WHERE {where}),
g AS (SELECT key_norm, 0::BIGINT AS rn, 0::BIGINT AS arrival_seq, 0::BIGINT AS t, 0::BIGINT AS b, 0::BIGINT AS category_id, last, open, known, NULL::VARCHAR AS fate FROM ({seeds}) UNION ALL
  SELECT r.key_norm, r.rn, r.arrival_seq, r.t, r.b, r.category_id, CASE WHEN {fate} = 'accepted' THEN r.t ELSE last END, CASE WHEN {fate} IN ('accepted', 'spam') THEN r.b ELSE open END, known OR {fate} NOT IN ('blocked', 'not_primary'), {fate}
  FROM g JOIN r ON r.key_norm = g.key_norm AND r.rn = g.rn + 1),
long_keys AS (SELECT * FROM arrivals WHERE octet_length(key::BLOB) > {ARRIVING.max_key_bytes})"""


@query("q_sk01_ingest", _fates() + " SELECT arrival_seq, key_norm, t AS unix_time, b AS bucket, fate FROM g WHERE rn > 0 UNION ALL SELECT arrival_seq, key_norm, t, b, 'key_too_long' FROM long_keys")
def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fate that a point can meet at an owned shard; the clock moves with arrival."""
    return ingest.ingested(arrivals(read_events(spark, sf_dir), ARRIVING), F.col("now"), ARRIVING).select("arrival_seq", "key_norm", "unix_time", "bucket", "fate")


@query("q_sk02_routed", _fates(where=f"octet_length(key::BLOB) <= {ARRIVING.max_key_bytes} AND shard_id % 5 NOT IN (0, 1)") + """, f AS (SELECT fate, arrival_seq, t FROM g WHERE rn > 0 UNION ALL SELECT 'key_too_long', arrival_seq, t FROM long_keys
  UNION ALL SELECT CASE shard_id % 5 WHEN 0 THEN 'bad_shard' ELSE 'not_owned' END, arrival_seq, CASE shard_id % 5 WHEN 0 THEN t ELSE t0 END FROM arrivals WHERE arrival_seq NOT IN (SELECT arrival_seq FROM long_keys) AND shard_id % 5 IN (0, 1))
SELECT fate, count(*) AS n_points, sum(t)::BIGINT AS times FROM f GROUP BY fate""")
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every fifth shard isn't there and the one after it isn't owned: points of the latter go back as
    they came."""
    points = arrivals(read_events(spark, sf_dir), ARRIVING)
    states = points.select("shard_id").distinct().where("shard_id % 5 <> 0").withColumn("state", F.when(F.col("shard_id") % 5 == 1, 1).otherwise(8))
    return ingest.ingested(points, F.col("now"), ARRIVING, states).groupBy("fate").agg(F.count("*").alias("n_points"), F.sum("unix_time").alias("times"))


@query("q_ag05_categories", _fates() + " SELECT key_norm, arg_max(category_id, arrival_seq) AS category_id, count(*) AS n_accepted FROM g WHERE fate = 'accepted' GROUP BY key_norm")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ingest.ingested(arrivals(read_events(spark, sf_dir), ARRIVING), F.col("now"), ARRIVING).where("fate = 'accepted'")
    return kept.groupBy("key_norm").agg(F.max_by("category_id", "arrival_seq").alias("category_id"), F.count("*").alias("n_accepted"))


@query("q_st02_stream_ingest", _fates() + " SELECT arrival_seq, key_norm, t AS unix_time, b AS bucket, fate FROM g WHERE rn > 0")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream with keyed state, over all files that are there; keys that are too long don't get to it."""
    made = streaming.ingested(stream_events(spark, sf_dir), lambda events: arrivals(events, ARRIVING), F.col("now"), ARRIVING)
    return made.select("arrival_seq", "key_norm", "unix_time", "bucket", "fate")


_SEEDS = f"SELECT key_norm, greatest(min(t0) + 86400, {ARRIVING.min_delta}) - {ARRIVING.min_delta} AS last, (min(t0) + 72000 - any_value(off)) // {O.window} AS open, true AS known FROM arrivals GROUP BY key_norm"


@query("q_st03_seeded", _fates(_SEEDS) + " SELECT key_norm, fate, count(*) AS n_points, min(t) AS first_time FROM g WHERE rn > 0 GROUP BY key_norm, fate")
def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New series that take nothing before a day after their first point, nor in buckets that end long before that."""
    points = arrivals(read_events(spark, sf_dir), ARRIVING).where(F.octet_length("key") <= ARRIVING.max_key_bytes)
    first = points.groupBy("key_norm").agg((F.min("unix_time") + 86400).alias("seed_time"))
    both = points.join(first, "key_norm").withColumn("seed_bucket", buckets.bucket(F.col("seed_time") - 14400, F.col("shard_id"), O))
    return ingest.ingested(both, F.col("now"), ARRIVING).groupBy("key_norm", "fate").agg(F.count("*").alias("n_points"), F.min("unix_time").alias("first_time"))


def _greedy(name: str, rows: str, delta: int) -> str:
    return f"""{name}r AS (SELECT *, row_number() OVER (PARTITION BY key_norm ORDER BY unix_time, rank, arrival_seq) AS rn FROM ({rows})),
{name}g AS (SELECT *, unix_time AS last, value AS had, true AS keep, false AS off FROM {name}r WHERE rn = 1 UNION ALL
  SELECT r.*, CASE WHEN r.unix_time - g.last >= {delta} THEN r.unix_time ELSE g.last END, CASE WHEN r.unix_time - g.last >= {delta} THEN r.value ELSE g.had END, r.unix_time - g.last >= {delta},
    r.unix_time - g.last < {delta} AND abs(r.value - g.had) > greatest({O.epsilon}::DOUBLE * abs(g.had), {O.epsilon}::DOUBLE) FROM {name}g g JOIN {name}r r ON r.key_norm = g.key_norm AND r.rn = g.rn + 1),
{name} AS (SELECT key_norm, unix_time, value, arrival_seq FROM {name}g WHERE keep)"""


def _merges(copies: str = "copies") -> str:
    """The merges of copies: first d (c: a service's number in its series), m (n: how many a series has), two and three."""
    return f"""d AS (SELECT *, dense_rank() OVER (PARTITION BY key_norm ORDER BY service_id) AS c FROM {copies}), m AS (SELECT key_norm, max(c) AS n FROM d GROUP BY key_norm),
{_greedy("two", "SELECT key_norm, unix_time, value, arrival_seq, c AS rank FROM d JOIN m USING (key_norm) WHERE n > 1 AND c <= 2", O.min_delta)},
{_greedy("three", "SELECT *, 1 AS rank FROM two UNION ALL SELECT key_norm, unix_time, value, arrival_seq, 2 AS rank FROM d WHERE c = 3", O.min_delta)},
off AS (SELECT key_norm, 2 AS step, count(*) FILTER (off) AS mismatches FROM twog GROUP BY key_norm UNION ALL SELECT key_norm, 3, count(*) FILTER (off) FROM threeg GROUP BY key_norm),
sizes AS (SELECT key_norm, 1 AS step, count(*) AS size FROM d WHERE c = 1 GROUP BY key_norm UNION ALL SELECT key_norm, 2, count(*) FROM two GROUP BY key_norm UNION ALL SELECT key_norm, 3, count(*) FROM three GROUP BY key_norm),
merges AS (SELECT i.key_norm, i.c::BIGINT AS step, i.service_id, i.in_size, s.size, s.size - coalesce(p.size, 0) AS added, s.size - i.in_size AS missing, coalesce(o.mismatches, 0) AS mismatches
  FROM (SELECT key_norm, c, any_value(service_id) AS service_id, count(*) AS in_size FROM d GROUP BY key_norm, c) i JOIN sizes s ON s.key_norm = i.key_norm AND s.step = i.c
  LEFT JOIN sizes p ON p.key_norm = i.key_norm AND p.step = i.c - 1 LEFT JOIN off o ON o.key_norm = i.key_norm AND o.step = i.c)"""


@query("q_jn05_replica_merge", f"""WITH RECURSIVE {BASE}, {COPIES}, {_merges()}
SELECT key_norm, unix_time, value FROM three UNION ALL SELECT key_norm, unix_time, value FROM d JOIN m USING (key_norm) WHERE n = 1 UNION ALL SELECT key_norm, unix_time, value FROM two JOIN m USING (key_norm) WHERE n = 2 AND key_norm NOT IN (SELECT key_norm FROM three)""")
def replica_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.merged(replicas(points_of(spark, sf_dir)), SERVICES, O.min_delta, O.epsilon)


@query("q_wn15_mismatches", f"WITH RECURSIVE {BASE}, {COPIES}, {_merges()} SELECT key_norm, sum(mismatches)::BIGINT AS mismatches, arg_max(size, step) AS n_points FROM merges GROUP BY key_norm")
def mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = fold.merge_stats(fold.merge_fates(replicas(points_of(spark, sf_dir)), SERVICES, O.min_delta, O.epsilon), SERVICES)
    return stats.groupBy("key_norm").agg(F.sum("mismatches").alias("mismatches"), F.max_by("size", "step").alias("n_points"))


_SCAN = """, s AS (SELECT unnest([0, 1, 2])::BIGINT AS service_id), have AS (SELECT key_norm, service_id, added, missing, size FROM merges), shrunk AS (SELECT DISTINCT key_norm FROM merges WHERE added < 0 OR missing < 0),
lack AS (SELECT k.key_norm, s.service_id, max(h.size) AS size FROM (SELECT DISTINCT key_norm FROM have) k, s LEFT JOIN have h ON h.key_norm = k.key_norm AND h.service_id < s.service_id
  WHERE NOT EXISTS (SELECT 1 FROM have x WHERE x.key_norm = k.key_norm AND x.service_id = s.service_id) GROUP BY ALL),
parts AS (SELECT key_norm, service_id, missing AS n FROM have UNION ALL SELECT key_norm, service_id, coalesce(size, 0) FROM lack UNION ALL SELECT h.key_norm, s.service_id, h.added FROM have h, s WHERE s.service_id < h.service_id)"""


@query("q_ag08_scan_stats", f"WITH RECURSIVE {BASE}, {COPIES}, {_merges()}{_SCAN} SELECT service_id, sum(n)::BIGINT AS missing, NULL::BIGINT AS missing_by_count FROM parts WHERE key_norm NOT IN (SELECT key_norm FROM shrunk) GROUP BY service_id")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points each service lacks, merge after merge; by how many services lack them is known for two at most."""
    stats = fold.merge_stats(fold.merge_fates(replicas(points_of(spark, sf_dir)), SERVICES, O.min_delta, O.epsilon), SERVICES)
    return replica.scan_stats(stats, SERVICES)


@query("q_ag09_two_services", f"""WITH RECURSIVE {BASE}, {COPIES}, pair AS (SELECT * FROM copies WHERE service_id < 2), {_merges("pair")}{_SCAN.replace("[0, 1, 2]", "[0, 1]")}, k AS (SELECT key_norm, sum(added) AS total, max_by(size, step) AS size FROM merges WHERE key_norm NOT IN (SELECT key_norm FROM shrunk) GROUP BY key_norm),
z AS (SELECT k.key_norm, k.size, coalesce(h.added, 0) AS added, coalesce(h.missing, k.size) AS missing FROM k LEFT JOIN have h ON h.key_norm = k.key_norm AND h.service_id = 1)
SELECT 0::BIGINT AS n_missing, sum(size - added - missing)::BIGINT AS n_points FROM z UNION ALL SELECT 1, sum(added + missing)::BIGINT FROM z""")
def two_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that none or one of two services lacks, summed over series."""
    copies = replicas(points_of(spark, sf_dir)).where("service_id < 2")
    return replica.missing_by_count(fold.merge_stats(fold.merge_fates(copies, 2, O.min_delta, O.epsilon), 2))


@query("q_jn06_presence", f"WITH {BASE}, {COPIES} SELECT key_norm, bit_or((1 << service_id::INT)::BIGINT) AS mask, 3 - bit_count(bit_or((1 << service_id::INT)::BIGINT))::BIGINT AS missing FROM copies GROUP BY key_norm")
def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replica.presence(replicas(points_of(spark, sf_dir)), 3)


@query("q_ag07_missing_by_services", f"WITH {BASE}, {COPIES}, m AS (SELECT key_norm, 3 - count(DISTINCT service_id) AS missing FROM copies GROUP BY key_norm) SELECT missing, count(*) AS n_keys FROM m GROUP BY missing")
def missing_by_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replica.by_missing_services(replicas(points_of(spark, sf_dir)), 3)


@query("q_ag08_missing_points", f"""WITH {BASE}, {COPIES}, u AS (SELECT DISTINCT key_norm, arrival_seq FROM copies), s AS (SELECT unnest([0, 1, 2])::INT AS service_id)
SELECT s.service_id, count(*) AS missing FROM u, s WHERE NOT EXISTS (SELECT 1 FROM copies c WHERE c.arrival_seq = u.arrival_seq AND c.service_id = s.service_id) GROUP BY s.service_id""")
def missing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replica.missing_points(replicas(points_of(spark, sf_dir)), 3)


def _complete(copies: DataFrame) -> DataFrame:
    """A copy is complete if it has a point in each bucket in which any copy has one."""
    want = copies.groupBy("key_norm").agg(F.count_distinct("bucket").alias("want"))
    return copies.groupBy("key_norm", "service_id").agg(F.count_distinct("bucket").alias("has")).join(want, "key_norm").select("service_id", "key_norm", (F.col("has") == F.col("want")).alias("complete"))


_COMPLETE = f"""WITH {BASE}, {COPIES}, w AS (SELECT key_norm, count(DISTINCT bucket) AS want FROM copies GROUP BY key_norm),
complete AS (SELECT key_norm, service_id, count(DISTINCT bucket) = any_value(want) AS complete FROM copies JOIN w USING (key_norm) GROUP BY key_norm, service_id)"""


@query("q_rd02_failover", _COMPLETE + """, o AS (SELECT *, row_number() OVER (PARTITION BY key_norm ORDER BY complete DESC, CASE WHEN complete THEN service_id ELSE -service_id END) AS rn FROM complete)
SELECT c.key_norm, c.service_id, o.complete, c.unix_time, c.value FROM copies c JOIN o ON o.key_norm = c.key_norm AND o.service_id = c.service_id AND rn = 1""")
def failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = replicas(points_of(spark, sf_dir))
    return replica.failover(copies, _complete(copies)).select("key_norm", "service_id", "complete", "unix_time", "value")


@query("q_ag11_completeness", _COMPLETE + " SELECT key_norm, sum(complete::BIGINT)::BIGINT AS n_complete FROM complete GROUP BY key_norm")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replica.completeness(_complete(replicas(points_of(spark, sf_dir))))


_DEVIATING = f"""WITH {BASE}, u AS (SELECT * FROM points WHERE unix_time BETWEEN {BEGIN} AND {END}), s AS (SELECT key_norm, avg(value) AS mean, stddev_pop(value) AS sigma FROM u GROUP BY key_norm HAVING stddev_pop(value) > 0),
found AS (SELECT u.*, mean, sigma FROM u JOIN s USING (key_norm) WHERE unix_time >= {BEGIN + 86400} AND abs(value - mean) >= 1.7 * sigma)"""


@query("q_wn11_deviations", _DEVIATING + " SELECT arrival_seq, key_norm, round(mean, 6) AS mean, round(sigma, 6) AS sigma FROM found")
def deviating(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deviations.deviating(points_of(spark, sf_dir), BEGIN, BEGIN + 86400, END, 1.7)
    return found.select("arrival_seq", "key_norm", F.round("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"))


@query("q_wn12_minute_slots", _DEVIATING + f" SELECT unix_time // 60 % {O.buckets * O.window // 60} AS minute_slot, key_norm, count(*) AS n FROM found GROUP BY ALL")
def minute_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deviations.minute_slots(deviations.deviating(points_of(spark, sf_dir), BEGIN, BEGIN + 86400, END, 1.7), O)


@query("q_wn13_retention", f"WITH {BASE}, n AS (SELECT key_norm, max(bucket) AS now FROM points GROUP BY key_norm) SELECT arrival_seq, key_norm, bucket FROM points JOIN n USING (key_norm) WHERE bucket >= now - {O.buckets}")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.retained(points_of(spark, sf_dir), O).select("arrival_seq", "key_norm", "bucket")


@query("q_st11_heat", f"""WITH {BASE}, n AS (SELECT key_norm, max(bucket) AS current FROM points GROUP BY key_norm), a AS (SELECT key_norm, max(bucket) AS asked FROM points WHERE value > 100 GROUP BY key_norm)
SELECT key_norm, CASE WHEN asked IS NULL THEN 255 ELSE least(255, greatest(0, current - asked)) END::BIGINT AS queried_ago, asked IS NOT NULL AND least(255, greatest(0, current - asked)) <= {86400 // O.window} AND least(255, greatest(0, current - asked)) <> 255 AS recent FROM n LEFT JOIN a USING (key_norm)""")
def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of more than 100 stand for reads."""
    points = points_of(spark, sf_dir)
    return read.heat(points, points.where("value > 100")).withColumn("recent", read.recently_queried(F.col("queried_ago"), O))


@query("q_st08_finalized", f"""WITH {BASE}, f AS (SELECT *, ({NOW} - {O.behind} - 60 - {O.window} - shard_id * {O.window} // {O.shards}) // {O.window} AS final FROM points)
SELECT shard_id, bucket, count(*) AS n_points, count(DISTINCT key_norm) AS n_series FROM f WHERE bucket <= final GROUP BY shard_id, bucket""")
def finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = lifecycle.last_finalized(F.lit(NOW).cast("long"), F.col("shard_id"), O)
    return points_of(spark, sf_dir).where(F.col("bucket") <= final).groupBy("shard_id", "bucket").agg(F.count("*").alias("n_points"), F.count_distinct("key_norm").alias("n_series"))


@query("q_st15_log_gaps", f"""WITH {BASE}, g AS (SELECT shard_id, unix_time, unix_time - max(unix_time) OVER (PARTITION BY shard_id ORDER BY unix_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM points)
SELECT shard_id, count(*) AS n_gaps, max(unix_time) AS reliable_start FROM g WHERE gap > {O.missing_logs_threshold} GROUP BY shard_id""")
def log_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.log_gaps(points_of(spark, sf_dir), O.missing_logs_threshold)


@query("q_st16_block_holes", f"""WITH {BASE}, b AS (SELECT DISTINCT shard_id, bucket FROM points), l AS (SELECT *, bucket - lag(bucket) OVER (PARTITION BY shard_id ORDER BY bucket) AS step FROM b)
SELECT shard_id, count(*) FILTER (step > 1) AS n_holes, count(*) AS n_blocks FROM l GROUP BY shard_id""")
def block_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.block_holes(points_of(spark, sf_dir))


@query("q_ag10_purge", f"WITH {BASE}, {SERIES} SELECT category_id, count(*) AS n_purged FROM catalogue WHERE max_bucket < {1706659200 // O.window} - {O.buckets} GROUP BY category_id")
def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.purged(read.series(points_of(spark, sf_dir)), 1706659200 // O.window, O)


_LOG = f"""WITH {BASE}, a AS (SELECT shard_id, key_norm, min(arrival_seq) AS sequence, arg_min(category_id, arrival_seq) AS category_id, min(unix_time) AS first_time, max(arrival_seq) AS last, max(value) AS top, arg_max(value, arrival_seq) AS fin FROM points GROUP BY ALL),
log AS (SELECT shard_id, key_norm, sequence, category_id, first_time, 'append' AS op FROM a UNION ALL SELECT shard_id, key_norm, last + 1, category_id, first_time, 'delete' FROM a WHERE fin = top)"""


@query("q_sk12_key_log", _LOG + " SELECT * FROM log")
def key_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.key_log(points_of(spark, sf_dir))


@query("q_lc01_current_keys", _LOG + " SELECT shard_id, key_norm, category_id, first_time FROM log QUALIFY row_number() OVER (PARTITION BY shard_id, key_norm ORDER BY sequence DESC) = 1 AND op <> 'delete'")
def current_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.current_keys(lifecycle.key_log(points_of(spark, sf_dir)))


@query("q_lc06_consistency", f"WITH {BASE} SELECT shard_id, count(DISTINCT key_norm) AS n_keys, count(DISTINCT key) AS n_spellings FROM points GROUP BY shard_id")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_of(spark, sf_dir).groupBy("shard_id").agg(F.count_distinct("key_norm").alias("n_keys"), F.count_distinct("key").alias("n_spellings"))


@query("q_jn07_hosts", f"""WITH {BASE}, t AS (SELECT DISTINCT shard_id, ['host-a', 'host-b', 'host-c'][shard_id % 3 + 1] AS host FROM points)
SELECT host, count(DISTINCT p.shard_id) AS n_shards, count(DISTINCT key_norm) AS n_keys, count(*) AS n_points FROM points p JOIN t USING (shard_id) GROUP BY host""")
def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    made = topology.generated(points.select("shard_id").distinct(), HOSTS, 9999, "s0")
    return points.join(made, "shard_id").groupBy("host").agg(F.count_distinct("shard_id").alias("n_shards"), F.count_distinct("key_norm").alias("n_keys"), F.count("*").alias("n_points"))


@query("q_lc17_shards_of_hosts", f"WITH {BASE}, t AS (SELECT DISTINCT shard_id FROM points) SELECT 's0' AS service_name, ['host-a', 'host-b', 'host-c'][shard_id % 3 + 1] AS host, 9999::BIGINT AS port, string_agg(shard_id, ',' ORDER BY shard_id) AS shards FROM t GROUP BY ALL")
def shards_of_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = topology.generated(points_of(spark, sf_dir).select("shard_id").distinct(), HOSTS, 9999, "s0")
    return topology.shards_of_hosts(made).withColumn("shards", F.array_join("shards", ","))


@query("q_fn05_scalars", f"""WITH {BASE} SELECT arrival_seq, floor(epoch(date_trunc('second', ts)))::BIGINT AS iso_seconds, len(list_filter(list_transform(string_split(points.event_type || ' , ,' || points.user_id, ','), lambda x: trim(x)), lambda x: x <> '')) AS n_names,
  ('0x' || substr(md5('1:' || key_norm), 1, 8))::BIGINT % 7 AS subshard, octet_length(key::BLOB) AS key_bytes FROM points JOIN events ON event_id = arrival_seq""")
def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = as_points(read_events(spark, sf_dir), O).join(read_events(spark, sf_dir).select(F.col("event_id").alias("arrival_seq"), F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso")), "arrival_seq")
    names = keys.names_in(F.concat("event_type", F.lit(" , ,"), F.col("user_id").cast("string")))
    return points.select("arrival_seq", keys.iso_seconds(F.col("iso")).alias("iso_seconds"), F.size(names).cast("long").alias("n_names"), keys.subshard_of(F.col("key_norm"), 7).alias("subshard"), F.octet_length("key").cast("long").alias("key_bytes"))


@query("q_sk20_tsv", f"WITH {BASE} SELECT key, key || chr(9) || trunc(value)::BIGINT || chr(9) || unix_time AS line FROM points")
def tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.tsv(points_of(spark, sf_dir))


@query("q_sk19_json", f"""WITH {BASE}, t AS (SELECT DISTINCT key AS target FROM points UNION SELECT DISTINCT upper(key) FROM points), l AS (SELECT key, string_agg('[' || trunc(value)::BIGINT || ',' || unix_time * 1000 || ']', ',' ORDER BY unix_time, value) AS p FROM points GROUP BY key)
SELECT target, '{{"target":"' || target || '","datapoints":[' || coalesce(p, '') || ']}}' AS response FROM t LEFT JOIN l ON l.key = t.target""")
def json_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    targets = points.select(F.col("key").alias("target")).unionByName(points.select(F.upper("key").alias("target"))).distinct()
    return render.json_series(points.withColumn("value", F.col("value").cast("long").cast("double")), targets)


@query("q_cd01_timestamp_bits", f"""WITH {BASE}, d AS (SELECT key_norm, bucket, unix_time, row_number() OVER w AS rn, unix_time - lag(unix_time) OVER w AS delta FROM points WINDOW w AS (PARTITION BY key_norm, bucket ORDER BY unix_time, arrival_seq)),
e AS (SELECT *, delta - coalesce(lag(delta) OVER (PARTITION BY key_norm, bucket ORDER BY rn), 60) AS dd FROM d)
SELECT key_norm, bucket, count(*) AS n_points, sum(CASE WHEN rn = 1 THEN 31 WHEN dd = 0 THEN 1 WHEN dd BETWEEN -63 AND 64 THEN 9 WHEN dd BETWEEN -255 AND 256 THEN 12 WHEN dd BETWEEN -2047 AND 2048 THEN 16 ELSE 36 END)::BIGINT AS bits FROM e GROUP BY key_norm, bucket""")
def timestamp_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block.timestamp_bits(points_of(spark, sf_dir))


@query("q_cd02_round_trip", f"WITH {BASE} SELECT key_norm, bucket, unix_time, value FROM points")
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to compressed blocks and back."""
    return block.opened(block.closed(points_of(spark, sf_dir)))


@query("q_sk06_blocks", f"""WITH {BASE}, b AS (SELECT shard_id, bucket, key_norm, count(*) AS n, string_agg(unix_time || ':' || (value * 100)::BIGINT, ',' ORDER BY unix_time, value) AS body FROM points GROUP BY ALL)
SELECT shard_id, bucket, count(*) AS n_series, count(DISTINCT body) AS n_blocks, sum(n)::BIGINT AS n_points FROM b GROUP BY shard_id, bucket""")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a shard's bucket; series with equal points share one."""
    made = block.closed(points_of(spark, sf_dir))
    return made.groupBy("shard_id", "bucket").agg(F.count("*").alias("n_series"), F.count_distinct("content").alias("n_blocks"), F.sum("n_points").alias("n_points"))


@query("q_sc13_wal_replay", f"""WITH {BASE}, w AS (SELECT shard_id, unix_time // {O.window} * {O.window} AS file_time, arrival_seq AS pos, unix_time + CASE WHEN arrival_seq % 97 = 0 THEN {2 * O.window} ELSE 0 END AS t FROM points),
r AS (SELECT *, bool_or(t NOT BETWEEN file_time AND file_time + {O.window}) OVER (PARTITION BY shard_id, file_time ORDER BY pos) AS bad FROM w)
SELECT shard_id, file_time, pos FROM r WHERE NOT bad""")
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each shard and aligned bucket; every 97th record is damaged."""
    points = points_of(spark, sf_dir)
    damaged = F.col("unix_time") + F.when(F.col("arrival_seq") % 97 == 0, 2 * O.window).otherwise(0)
    wal = points.select("shard_id", buckets.aligned_floor(F.col("unix_time"), O).alias("file_time"), F.col("arrival_seq").alias("pos"), damaged.alias("unix_time"))
    return lifecycle.replayed(wal, O.window).select("shard_id", "file_time", "pos")


@query("q_lc11_reconcile", f"""WITH {BASE}, o AS (SELECT DISTINCT shard_id FROM points WHERE bucket % 3 = 0 AND event_type = 'click' AND value > 150), d AS (SELECT DISTINCT shard_id FROM points WHERE event_type = 'purchase' AND value > 150)
SELECT coalesce(o.shard_id, d.shard_id) AS shard_id, CASE WHEN o.shard_id IS NULL THEN 'add' WHEN d.shard_id IS NULL THEN 'drop' ELSE 'keep' END AS action FROM o FULL JOIN d ON o.shard_id = d.shard_id""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with large clicks stand for owned ones, those with large purchases for desired ones."""
    points = points_of(spark, sf_dir)
    return lifecycle.reconciled(points.where("bucket % 3 = 0 AND event_type = 'click' AND value > 150").select("shard_id").distinct(), points.where("event_type = 'purchase' AND value > 150").select("shard_id").distinct())


@query("q_jn03_blocks_of_series", _LOG + ", k AS (SELECT key_norm FROM log QUALIFY row_number() OVER (PARTITION BY shard_id, key_norm ORDER BY sequence DESC) = 1 AND op <> 'delete'), b AS (SELECT DISTINCT shard_id, bucket, key_norm FROM points) SELECT shard_id, count(k.key_norm) AS n_known, count(*) - count(k.key_norm) AS n_unknown FROM b LEFT JOIN k USING (key_norm) GROUP BY shard_id")
def blocks_of_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks against the catalogue that the key log gives."""
    points = points_of(spark, sf_dir)
    return lifecycle.matched_blocks(points.select("shard_id", "bucket", "key_norm").distinct(), lifecycle.current_keys(lifecycle.key_log(points)))


STATES = """
shards AS (SELECT DISTINCT shard_id FROM points), x0 AS (SELECT shard_id, s::BIGINT AS service_id, (shard_id * 5 + s * 3) % 11 AS x FROM shards, (VALUES (0), (1), (2)) v(s)),
states AS (SELECT service_id, shard_id, CASE x WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN 0 ELSE 8 END AS state, CASE WHEN (shard_id + service_id) % 4 = 0 THEN 1704758400 ELSE 0 END AS reliable_start, x <> 4 AS up FROM x0)"""
ANSWERS = f"""{STATES}, known AS (SELECT DISTINCT key_norm, shard_id FROM points),
asked AS (SELECT key_norm AS request_idx, key_norm AS key, shard_id FROM known UNION ALL SELECT 'no-' || key_norm, 'no-' || key_norm, shard_id FROM known UNION ALL SELECT repeat(key_norm, 50), repeat(key_norm, 50), shard_id FROM known),
ans0 AS (SELECT s.service_id, a.request_idx, lower(a.key) AS key_norm, state, up, reliable_start, octet_length(a.key::BLOB) <= {O.max_key_bytes} AS fits, h.key_norm IS NOT NULL AS has
  FROM asked a JOIN states s USING (shard_id) LEFT JOIN (SELECT DISTINCT service_id, key_norm FROM copies) h ON h.service_id = s.service_id AND h.key_norm = lower(a.key)),
ans1 AS (SELECT *, CASE WHEN NOT up THEN 4 WHEN NOT fits THEN 3 WHEN state = 1 THEN 1 WHEN state BETWEEN 2 AND 6 THEN 2 WHEN NOT has THEN 3 WHEN state = 7 THEN 2 WHEN {BEGIN} < reliable_start THEN 5 ELSE 0 END::BIGINT AS status FROM ans0),
answers AS (SELECT service_id, request_idx, key_norm, status, has AND NOT state BETWEEN 2 AND 6 AND status IN (0, 2, 5) AS served FROM ans1)"""


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Replicas, and each service's answer for every key, one that isn't there for each, and one that is too long."""
    points = points_of(spark, sf_dir)
    copies, known = replicas(points), points.select("key_norm", "shard_id").distinct()
    asked = known.select(F.explode(F.array(F.col("key_norm"), F.concat(F.lit("no-"), "key_norm"), F.repeat("key_norm", F.lit(50)))).alias("key"), "shard_id").withColumn("request_idx", F.col("key"))
    return copies, status.key_statuses(asked, copies, shard_states(points), BEGIN, O)


@query("q_sc01_statuses", f"WITH {BASE}, {COPIES}, {ANSWERS} SELECT a.service_id, a.request_idx, a.status, c.unix_time, c.value FROM answers a LEFT JOIN copies c ON a.served AND c.service_id = a.service_id AND c.key_norm = a.key_norm AND c.unix_time BETWEEN {BEGIN} AND {END}")
def get_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gets from every service with all statuses, the points of those that are served."""
    copies, answers = _answers(spark, sf_dir)
    found = copies.where(F.col("unix_time").between(BEGIN, END)).select("service_id", "key_norm", F.lit(True).alias("served"), "unix_time", "value")
    return answers.join(found, ["service_id", "key_norm", "served"], "left").select("service_id", "request_idx", "status", "unix_time", "value")


@query("q_rd01_triage", f"WITH {BASE}, {COPIES}, {ANSWERS} SELECT service_id, CASE status WHEN 0 THEN 'found' WHEN 3 THEN 'missing' WHEN 2 THEN 'in_progress' WHEN 5 THEN 'partial' ELSE 'failed' END AS route, count(*) AS n_keys, count(*) FILTER (served) AS n_served FROM answers GROUP BY ALL")
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, answers = _answers(spark, sf_dir)
    return answers.groupBy("service_id", status.route(F.col("status")).alias("route")).agg(F.count("*").alias("n_keys"), F.count_if("served").alias("n_served"))


_CHOSEN = """, chosen AS (SELECT request_idx, key_norm, service_id, status, served AND status <> 3 AS found FROM answers QUALIFY row_number() OVER (PARTITION BY request_idx ORDER BY status IN (0, 3) DESC, CASE WHEN status IN (0, 3) THEN service_id ELSE -service_id END) = 1)"""


@query("q_rd02_status_failover", f"WITH {BASE}, {COPIES}, {ANSWERS}{_CHOSEN} SELECT request_idx, service_id, status, found FROM chosen")
def status_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.failover(_answers(spark, sf_dir)[1]).drop("key_norm")


@query("q_rd03_trimmed", f"WITH {BASE}, {COPIES}, {ANSWERS}{_CHOSEN} SELECT h.request_idx, c.unix_time, c.value FROM chosen h JOIN copies c ON h.found AND c.service_id = h.service_id AND c.key_norm = h.key_norm AND c.unix_time BETWEEN {BEGIN} AND {END}")
def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the service that failover ends with, within the range."""
    copies, answers = _answers(spark, sf_dir)
    chosen = status.failover(answers).where("found").select("request_idx", "service_id", "key_norm")
    return copies.where(F.col("unix_time").between(BEGIN, END)).join(chosen, ["service_id", "key_norm"]).select("request_idx", "unix_time", "value")


@query("q_ag11_success", f"WITH {BASE}, {COPIES}, {ANSWERS} SELECT request_idx, count(*) FILTER (status IN (0, 3, 5)) AS n_complete, count(*) FILTER (status IN (0, 2, 3, 5)) AS n_received FROM answers GROUP BY request_idx")
def success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.completeness(_answers(spark, sf_dir)[1])


@query("q_ag06_get_stats", f"""WITH RECURSIVE {BASE}, {COPIES}, {ANSWERS}, given AS (SELECT c.* FROM copies c JOIN answers a ON a.served AND a.service_id = c.service_id AND a.key_norm = c.key_norm), {_merges("given")},
got AS (SELECT key_norm, service_id AS other, status IN (0, 3, 5) AS complete FROM answers WHERE status IN (0, 2, 3, 5)),
prior AS (SELECT g.*, got.other, count(*) OVER w = 1 AND sum(complete::INT) OVER w = 1 AS single FROM merges g JOIN got ON got.key_norm = g.key_norm AND got.other < g.service_id WINDOW w AS (PARTITION BY g.key_norm, g.service_id)),
parts AS (SELECT service_id, missing AS points, mismatches FROM merges UNION ALL SELECT other, added, CASE WHEN single THEN mismatches ELSE 0 END FROM prior),
failed AS (SELECT service_id, count(*) FILTER (status NOT IN (0, 2, 3, 5)) AS failed_keys FROM answers GROUP BY service_id)
SELECT f.service_id, coalesce(sum(points), 0)::BIGINT AS missing_points, any_value(failed_keys) AS failed_keys, coalesce(sum(mismatches), 0)::BIGINT AS mismatches FROM failed f LEFT JOIN parts USING (service_id) GROUP BY f.service_id""")
def get_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing points, failed keys and mismatches by service; a reader reports the greatest of each."""
    copies, answers = _answers(spark, sf_dir)
    given = copies.join(answers.where("served").select("service_id", "key_norm"), ["service_id", "key_norm"])
    merges = fold.merge_stats(fold.merge_fates(given, SERVICES, O.min_delta, O.epsilon), SERVICES)
    return status.get_stats(answers, merges, SERVICES)


@query("q_ag12_recent", f"""WITH {BASE}, {COPIES}, n AS (SELECT service_id, key_norm, max(bucket) AS current, max(bucket) FILTER (value > 100) AS asked FROM copies GROUP BY ALL)
SELECT key_norm, bool_or(asked IS NOT NULL AND least(255, current - asked) <= {86400 // O.window}) AS queried_recently FROM n GROUP BY key_norm""")
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any service's copy was read within a day; points of more than 100 stand for reads."""
    copies = replicas(points_of(spark, sf_dir)).withColumn("key_norm", F.struct("service_id", "key_norm"))
    heats = read.heat(copies, copies.where("value > 100"))
    return heats.groupBy("key_norm.key_norm").agg(F.bool_or(read.recently_queried(F.col("queried_ago"), O)).alias("queried_recently"))


SCAN_NOW = END + O.behind + 60 + O.window + O.window // 2  # some shards' last bucket is finalized by then, some shards' not
SCANS = f"""{STATES}, scans AS (SELECT service_id, shard_id, CASE WHEN NOT up THEN 4 WHEN state <= 1 THEN 1 WHEN state <> 8 THEN 2
  WHEN ({END} - shard_id * {O.window} // {O.shards}) // {O.window} > ({SCAN_NOW - O.behind - 60 - O.window} - shard_id * {O.window} // {O.shards}) // {O.window} THEN 6 ELSE 0 END::BIGINT AS status FROM states)"""


@query("q_sc02_scan_statuses", f"""WITH {BASE}, {COPIES}, {SCANS}, f AS (SELECT service_id, shard_id, key_norm, string_agg(unix_time, ',' ORDER BY unix_time) AS times, count(*) AS n_points FROM copies
  WHERE bucket BETWEEN ({BEGIN} - shard_id * {O.window} // {O.shards}) // {O.window} AND ({END} - shard_id * {O.window} // {O.shards}) // {O.window} AND ('0x' || substr(md5('1:' || key_norm), 1, 8))::BIGINT % 4 = 1 GROUP BY ALL)
SELECT s.service_id, s.shard_id, s.status, f.key_norm, f.times, f.n_points FROM scans s JOIN f ON s.status = 0 AND f.service_id = s.service_id AND f.shard_id = s.shard_id UNION ALL SELECT service_id, shard_id, status, NULL, NULL, NULL FROM scans WHERE status <> 0""")
def scan_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of every shard's second sub-shard of four, by every service."""
    points = points_of(spark, sf_dir)
    found = status.scan_statuses(shard_states(points), END, SCAN_NOW, O)
    return status.scanned(replicas(points), found, BEGIN, END, 4, 1, O).select("service_id", "shard_id", "status", "key_norm", "times", "n_points")


@query("q_rd06_collected", f"""WITH {BASE}, {SCANS} SELECT shard_id, arg_min(status, CASE WHEN status = 0 THEN 0 WHEN status = 4 THEN 20 ELSE 10 END + service_id) AS status, bool_and(status = 0) AS all_success, count(*) FILTER (status = 0) AS n_ok, any_value(status) FILTER (service_id = 0) AS first_status FROM scans GROUP BY shard_id""")
def scans_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of all services gets for each shard, and what a reader of the first one does."""
    found = status.scan_statuses(shard_states(points_of(spark, sf_dir)), END, SCAN_NOW, O)
    first = found.where("service_id = 0").select("shard_id", F.col("status").alias("first_status"))
    return status.collected(found).join(first, "shard_id")


_HEAT = "heats AS (SELECT key_norm, CASE WHEN max(bucket) FILTER (value > 100) IS NULL THEN 255 ELSE least(255, max(bucket) - max(bucket) FILTER (value > 100)) END AS ago FROM points GROUP BY key_norm), slots AS (SELECT shard_id, max(series_id) + 1 AS slots FROM catalogue GROUP BY shard_id)"


def _pages(least: int, offset: int, limit: int) -> str:
    return f"""WITH {BASE}, {SERIES}, {_HEAT} SELECT shard_id, series_id, key, category_id, last_time AS update_time, ago <= {86400 // O.window} AS queried_recently, {offset + limit} < slots AS more
FROM catalogue JOIN slots USING (shard_id) JOIN heats USING (key_norm) WHERE series_id BETWEEN {offset} AND {offset + limit - 1} AND last_time >= {least}"""


@query("q_sc04_update_pages", _pages(END, 10, 20))
def update_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    return read.update_pages(read.series(points), read.heat(points, points.where("value > 100")), END, 10, 20, O)


@query("q_sc18_shard_keys", _pages(0, 0, 30))
def shard_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    return read.update_pages(read.series(points), read.heat(points, points.where("value > 100")), 0, 0, 30, O)


@query("q_sc03_bucket_page", f"""WITH {BASE}, {SERIES}, {_HEAT} SELECT shard_id, series_id, bucket, unix_time, value, 15 < slots AS more FROM points JOIN catalogue c USING (shard_id, key_norm) JOIN slots USING (shard_id)
WHERE series_id BETWEEN 5 AND 14 AND bucket BETWEEN ({BEGIN} - shard_id * {O.window} // {O.shards}) // {O.window} AND ({BEGIN + 172800} - shard_id * {O.window} // {O.shards}) // {O.window}""")
def bucket_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    return read.bucket_page(points, read.series(points), BEGIN, BEGIN + 172800, 5, 10, O)


@query("q_sc08_clamped", f"""WITH {BASE}, n AS (SELECT key_norm, max(bucket) AS now FROM points GROUP BY key_norm) SELECT key_norm, bucket, count(*) AS n_points FROM points JOIN n USING (key_norm)
WHERE bucket BETWEEN greatest(({BEGIN} - shard_id * {O.window} // {O.shards}) // {O.window}, now - {O.buckets}) AND least(({END} - shard_id * {O.window} // {O.shards}) // {O.window}, now) GROUP BY ALL""")
def clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a range, within the buckets that each series still keeps."""
    low, high = (buckets.bucket(F.lit(t).cast("long"), F.col("shard_id"), O) for t in (BEGIN, END))
    return lifecycle.retained(points_of(spark, sf_dir), O).where(F.col("bucket").between(low, high)).groupBy("key_norm", "bucket").agg(F.count("*").alias("n_points"))


@query("q_fl10_cold", f"WITH {BASE}, {SERIES}, {_HEAT} SELECT key_norm, ago > {O.cold_threshold} AS cold FROM heats")
def cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    return read.heat(points, points.where("value > 100")).select("key_norm", read.cold(F.col("queried_ago"), O).alias("cold"))


@query("q_fn11_bucket_age", f"WITH {BASE}, n AS (SELECT key_norm, max(bucket) AS now FROM points GROUP BY key_norm) SELECT arrival_seq, now - bucket AS age, CASE WHEN unix_time % {O.window} = 0 THEN unix_time ELSE (unix_time // {O.window} + 1) * {O.window} END AS ceil_time FROM points JOIN n USING (key_norm)")
def bucket_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    now, t = points.groupBy("key_norm").agg(F.max("bucket").alias("now")), F.col("unix_time")
    return points.join(now, "key_norm").select("arrival_seq", buckets.age(F.col("now"), F.col("bucket")).alias("age"), buckets.aligned_floor(t + O.window - 1, O).alias("ceil_time"))


_PLAN = f"""p0s AS (SELECT shard_id, max(bucket) FILTER (value > 20) AS newest FROM points GROUP BY shard_id), plan0 AS (SELECT shard_id, CASE WHEN shard_id % 4 = 0 THEN 0 ELSE newest - 107 + shard_id % 3 END AS done,
  ({NOW} - {O.behind} - 60 - {O.window} - shard_id * {O.window} // {O.shards}) // {O.window} AS last FROM p0s), plan AS (SELECT shard_id, done, last, CASE WHEN done = 0 THEN last ELSE done + 1 END AS first FROM plan0)"""


@query("q_st07_finalize_plan", f"""WITH {BASE}, {_PLAN}, cur AS (SELECT shard_id, key_norm, max(bucket) AS current FROM points GROUP BY ALL),
roll AS (SELECT shard_id, count(*) FILTER (current <= last) AS n_rolled FROM cur JOIN plan USING (shard_id) GROUP BY shard_id)
SELECT shard_id, first, last, CASE WHEN first <= done OR first > last THEN 0 ELSE last - first + 1 END AS n_buckets, CASE WHEN first <= done OR first > last THEN 0 ELSE n_rolled END AS n_rolled, done <> 0 AND last > done + 1 AS behind FROM plan JOIN roll USING (shard_id)""")
def finalize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From what each shard has finalized to what the clock allows; a fourth of the shards have finalized nothing."""
    points = points_of(spark, sf_dir)
    newest = points.groupBy("shard_id").agg(F.max(F.when(F.col("value") > 20, F.col("bucket"))).alias("newest"))
    done = newest.select("shard_id", F.when(F.col("shard_id") % 4 == 0, 0).otherwise(F.col("newest") - 107 + F.col("shard_id") % 3).alias("done"))
    return lifecycle.finalize_plan(points, done, NOW, O)


@query("q_st18_expired", f"WITH {BASE} SELECT shard_id, bucket, count(*) AS n_points FROM points WHERE bucket < ({NOW} - shard_id * {O.window} // {O.shards}) // {O.window} - {O.buckets} - 1 GROUP BY shard_id, bucket")
def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.expired(points_of(spark, sf_dir), NOW, O)


@query("q_lc13_owned", f"WITH {BASE}, {STATES} SELECT service_id, count(*) FILTER (state >= 2) AS n_owned, string_agg(shard_id, ',' ORDER BY shard_id) FILTER (state >= 2) AS owned FROM states GROUP BY service_id")
def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = shard_states(points_of(spark, sf_dir))
    return lifecycle.owned(states)


_TOPOLOGY = """hosts AS (SELECT DISTINCT 's' || (shard_id % 3) AS service_name, shard_id, ['host-a', 'host-b', 'host-c'][shard_id % 3 + 1] AS host, 9999::BIGINT AS port FROM points)"""


def _topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services named by a shard's number modulo three; hosts as a list in text."""
    shards = points_of(spark, sf_dir).select("shard_id").distinct()
    return topology.generated(shards, topology.host_names("host-a,host-b,host-c"), 9999, "s").withColumn("service_name", F.concat("service_name", (F.col("shard_id") % 3).cast("string")))


@query("q_lc16_host_of_shard", f"WITH {BASE}, {_TOPOLOGY}, ask AS (SELECT DISTINCT shard_id FROM points), n AS (SELECT service_name FROM hosts UNION SELECT 'none') SELECT n.service_name, a.shard_id, h.host, h.port FROM ask a CROSS JOIN n LEFT JOIN hosts h ON h.service_name = n.service_name AND h.shard_id = a.shard_id")
def host_of_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every shard and service, one unknown, the host; null where there is none."""
    made = _topology(spark, sf_dir)
    names = made.select("service_name").distinct().unionByName(spark.sql("SELECT 'none' AS service_name"))
    asked = made.select("shard_id").distinct().withColumn("names", F.lit(1)).join(names.withColumn("names", F.lit(1)), "names").drop("names")
    return topology.hosts_of_shards(asked, made).select("service_name", "shard_id", "host", "port")


@query("q_lc18_services", f"WITH {BASE}, {_TOPOLOGY}, c AS (SELECT service_name, count(DISTINCT shard_id) AS n_shards FROM hosts GROUP BY 1) SELECT service_name, n_shards, service_name = min(service_name) OVER () AS nearest, n_shards = max(n_shards) OVER () AS largest FROM c UNION ALL SELECT 'none', 0, false, false")
def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each service's shards, which is the nearest (the first by name) and which have most; an unknown one has none."""
    made = _topology(spark, sf_dir)
    names = made.select("service_name").distinct().unionByName(spark.sql("SELECT 'none' AS service_name"))
    return topology.services(names, made)


@query("q_fn13_requests", f"""WITH {BASE}, t AS (SELECT event_type, user_id, key FROM points WHERE user_id < 10 GROUP BY ALL), l AS (SELECT key, string_agg('[' || trunc(value)::BIGINT || ',' || unix_time * 1000 || ']', ',' ORDER BY unix_time, value) AS p FROM points WHERE unix_time BETWEEN {BEGIN} AND {END} GROUP BY key)
SELECT user_id AS panel, '[' || string_agg('{{"target":"' || t.key || '","datapoints":[' || coalesce(p, '') || ']}}', ',' ORDER BY event_type) || ']' AS response FROM t LEFT JOIN l ON l.key = t.key GROUP BY user_id""")
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard requests as JSON, one for each of ten users, answered with an array in the order of their targets."""
    points = points_of(spark, sf_dir)
    targets = points.where("user_id < 10").groupBy("user_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    span = F.struct(F.lit("2024-01-08T00:00:00.000Z").alias("from"), F.lit("2024-01-20T00:00:00.000Z").alias("to"))
    bodies = targets.select(F.to_json(F.struct(F.col("user_id").alias("panelId"), span.alias("range"), F.transform("keys", lambda k: F.struct(k.alias("target"))).alias("targets"))).alias("body"))
    whole = points.withColumn("value", F.col("value").cast("long").cast("double"))
    return render.answered(render.parsed(bodies), whole).select(F.col("panel"), "response")


@query("q_fl13_problems", f"""WITH {BASE}, {_TOPOLOGY}, t AS (SELECT service_name, shard_id, CASE WHEN shard_id = 5 THEN '' ELSE host END AS host, CASE WHEN shard_id = 3 THEN 0 ELSE port END AS port FROM hosts WHERE shard_id <> 9
  UNION ALL SELECT service_name, shard_id, host, port FROM hosts WHERE shard_id = 7 UNION ALL SELECT service_name, shard_id + 100, host, port FROM hosts WHERE shard_id = 6),
n AS (SELECT service_name, count(*) AS n, count(DISTINCT shard_id) AS d FROM t GROUP BY 1)
SELECT service_name, CASE WHEN host = '' THEN 'no host' WHEN NOT port BETWEEN 1 AND 65535 THEN 'bad port' ELSE 'shard out of range' END AS problem FROM t WHERE host = '' OR NOT port BETWEEN 1 AND 65535 OR NOT shard_id BETWEEN 0 AND {O.shards - 1}
UNION SELECT service_name, CASE WHEN n > d THEN 'doubled shard' ELSE 'missing shard' END FROM n WHERE n > d OR d < {O.shards}""")
def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topology with faults: a shard without a host, a bad port, one out of range, one doubled and many missing."""
    made = _topology(spark, sf_dir)
    shard = F.col("shard_id")
    faulty = made.where(shard != 9).withColumn("host", F.when(shard == 5, "").otherwise(F.col("host"))).withColumn("port", F.when(shard == 3, 0).otherwise(F.col("port")))
    more = made.where(shard == 7).unionByName(made.where(shard == 6).withColumn("shard_id", shard + 100))
    return topology.problems(faulty.unionByName(more).withColumn("shard_count", F.lit(O.shards)))


@query("q_lc06_duplicate_keys", f"""WITH {BASE}, {COPIES}, a AS (SELECT DISTINCT service_id, shard_id, key_norm FROM copies) SELECT shard_id, key_norm, count(*) AS n FROM a GROUP BY shard_id, key_norm HAVING count(*) > 1""")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that the key logs of several services have appended."""
    copies = replicas(points_of(spark, sf_dir))
    logs = [lifecycle.key_log(copies.where(F.col("service_id") == s)) for s in range(SERVICES)]
    return lifecycle.duplicate_keys(logs[0].unionByName(logs[1]).unionByName(logs[2]))
