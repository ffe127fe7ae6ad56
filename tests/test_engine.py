"""Small cases whose results are known."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import blocks, buckets, keys
from tidewell.operators import deviations, fold, ingest, lifecycle, read, render, replica, status, topology
from tidewell.options import Options


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def points(spark, rows):
    return spark.createDataFrame(rows, "key_norm string, bucket long, unix_time long, service_id long, value double, arrival_seq long")


def test_blocks_open_to_their_points(spark):
    rng = random.Random(5)
    rows = [(0, b, k, rng.randrange(1000) + 1000 * b, rng.choice([0.5, 1.5, rng.random()]), i) for i, (b, k) in enumerate((rng.randrange(3), rng.choice("ab")) for _ in range(200))]
    rows += [(0, 7, k, t, 1.0, t) for k in "cd" for t in (7000, 7060, 7120)]
    frame = spark.createDataFrame(rows, "shard_id long, bucket long, key_norm string, unix_time long, value double, arrival_seq long")
    made = blocks.closed(frame)
    back = sorted((r["key_norm"], r["bucket"], r["unix_time"], r["value"]) for r in blocks.opened(made).collect())
    assert back == sorted((k, b, t, v) for _, b, k, t, v, _ in rows)
    same = made.where("bucket = 7").collect()
    assert len(same) == 2 and len({r["content"] for r in same}) == 1 and same[0]["steps"] == [0, 60, 60]
    bits = {(r["key_norm"], r["bucket"]): r["bits"] for r in blocks.timestamp_bits(frame).collect()}
    assert bits["c", 7] == 31 + 1 + 1


@pytest.mark.parametrize(("delta", "times", "kept"), [(60, [100, 160, 190, 220, 160], [100, 160, 220]), (30, [5, 5, 34, 35, 66, 66, 95, 96, 97, 127], [5, 35, 66, 96, 127])])
def test_spam_gate(delta, times, kept):
    state, got = None, []
    for t in times:
        fate, state = ingest.gate(state, t, 0, delta)
        got += [t] * (fate == "accepted")
    assert got == kept


def test_old_bucket_and_zero_time():
    assert ingest.gate((100, 3), 500, 2, 30) == ("old_bucket", (100, 3))
    assert ingest.gate((0, 0), 0, 0, 30)[0] == "accepted"


def test_repair(spark):
    o, now = Options(), 1_000_000
    got = one(spark, *(ingest.repaired(F.lit(t).cast("long"), now, o) for t in (0, now - 901, now - 900, now + 60, now + 61)))
    assert got == (now, now, now - 900, now + 60, now)


def test_bucket_bounds(spark):
    o = Options(shards=10, window=100)
    t = lambda x: F.lit(x).cast("long")
    assert one(spark, buckets.bucket(t(49), t(5), o), buckets.bucket(t(50), t(5), o), buckets.bucket(t(150), t(5), o), buckets.ceil_time(t(10), t(5), o), buckets.ceil_time(t(150), t(5), o), buckets.ceil_time(t(151), t(5), o)) == (0, 0, 1, 50, 150, 250)


def test_merge_of_three(spark):
    base = [60, 120, 180, 240]
    rows = [("a", 0, t, 0, 1.0, t) for t in base] + [("a", 0, t, 1, 1.0, t) for t in base]
    rows += [("b", 0, t, 0, 1.0, t) for t in (118, 180)] + [("b", 0, t, 1, 1.0, t) for t in (60, 239)]
    rows += [("c", 0, t, 1, 1.0, t) for t in (1, 2, 3)]
    got = fold.merged(points(spark, rows), 2, 30, 0.1).collect()
    by = {k: sorted(r["unix_time"] for r in got if r["key_norm"] == k) for k in "abc"}
    assert by == {"a": base, "b": [60, 118, 180, 239], "c": [1, 2, 3]}  # one copy is never thinned


def test_merge_compare(spark):
    """Three services and two keys, whose results and mismatches are known."""
    given = [
        [[(60, 100), (180, 300), (241, 400)], [(60, 100), (122, 180), (180, 300)]],
        [[(60, 100), (120, 200), (182, 300), (240, 400)], [(61, 200), (120, 200), (181, 301), (242, 420)]],
        [[(181, 350)], [(60, 100), (121, 180), (182, 300), (240, 400)]],
    ]
    rows = [(k, 0, t, s, float(v), 0) for s, of in enumerate(given) for k, ps in zip("ab", of) for t, v in ps if 60 <= t <= 240]
    fates = fold.merge_fates(points(spark, rows), 3, 30, 0.01)
    for k in "ab":
        kept = sorted((r["unix_time"], r["value"]) for r in fates.where(f"died is null and key_norm = '{k}'").collect())
        assert [v for _, v in kept] == [100, 200, 300, 400][: len(kept)] and len(kept) == 4
    stats = {(r["key_norm"], r["step"]): r for r in fold.merge_stats(fates, 3).collect()}
    assert [sum(stats[k, s]["mismatches"] for k in "ab") for s in (1, 2, 3)] == [0, 2, 2]
    assert stats["a", 2]["added"] == 2 and stats["a", 2]["missing"] == 0 and stats["a", 3]["missing"] == 3
    answers = spark.createDataFrame([(s, k, k, 0, True) for s in range(3) for k in "ab"], "service_id long, request_idx string, key_norm string, status long, served boolean")
    got = {r["service_id"]: r for r in status.get_stats(answers, fold.merge_stats(fates, 3), 3).collect()}
    assert [got[s]["mismatches"] for s in range(3)] == [2, 2, 2] and all(got[s]["failed_keys"] == 0 for s in range(3))


def test_merge_equals_a_plain_one(spark):
    """Passes over contested points against a merge of whole lists."""
    rng = random.Random(11)
    rows = [(k, 0, rng.randrange(3000) if k != "x" else rng.randrange(9) * 500, s, float(rng.randrange(3)), i) for i, (k, s) in enumerate((rng.choice("abcx"), rng.randrange(4)) for _ in range(400))]
    rows += [("lone", 0, t, 2, 1.0, t) for t in (1, 2, 3)]
    want = {}
    for key in {r[0] for r in rows}:
        out = None
        for service in sorted({r[3] for r in rows if r[0] == key}):
            new = [(t, v, i) for k, _, t, s, v, i in sorted(rows, key=lambda r: (r[2], r[5])) if (k, s) == (key, service)]
            if out is None:
                out = [(t, 0, v) for t, v, _ in new]
                continue
            kept = []
            for t, _, v in sorted([(t, 0, v) for t, _, v in out] + [(t, 1, v) for t, v, _ in new], key=lambda p: p[:2]):
                if not kept or t - kept[-1][0] >= 30:
                    kept.append((t, 0, v))
            out = kept
        want[key] = sorted((t, v) for t, _, v in out)
    got = {}
    for r in fold.merged(points(spark, rows).repartition(5), 4, 30, 0.1).collect():
        got.setdefault(r["key_norm"], []).append((r["unix_time"], r["value"]))
    assert {k: [t for t, _ in sorted(v)] for k, v in got.items()} == {k: [t for t, _ in v] for k, v in want.items()}


def test_scan_stats_of_two_and_three(spark):
    """Service 0 has p0 and p1, service 1 has p1 and p2."""
    rows = [("k", 0, t, s, 1.0, t) for s, ts in enumerate([(0, 100), (100, 200)]) for t in ts]
    two = fold.merge_stats(fold.merge_fates(points(spark, rows), 2, 30, 0.1), 2)
    assert {r["service_id"]: r["missing"] for r in replica.scan_stats(two, 2).collect()} == {0: 1, 1: 1}
    assert {r["n_missing"]: r["n_points"] for r in replica.missing_by_count(two).collect()} == {0: 1, 1: 2}
    assert {r["service_id"]: r["missing"] for r in replica.scan_stats(two, 3).collect()} == {0: 1, 1: 1, 2: 3}


def test_runs_split_at_every_gap(spark):
    rows = [("a", 0, t, 0, 1.0, t) for t in (0, 10, 16380, 16390, 16430, 40000, 40029, 40059)]
    narrow = fold.with_runs(points(spark, rows), ["key_norm"], 30, width=20)
    assert len({r["run"] for r in narrow.collect()}) == 5
    got = {r["unix_time"]: (r["run"], r["alone"]) for r in fold.with_runs(points(spark, rows), ["key_norm"], 30, width=1 << 14).collect()}
    assert len({got[t][0] for t in (0, 10)}) == 1 and got[16380][0] == got[16390][0] != got[16430][0]
    assert [got[t][1] for t in (0, 10, 16380, 16430, 40000, 40059)] == [False, False, False, True, False, True]


def test_empty_second_copy_thins(spark):
    rows = [("a", 0, 10, 0, 1.0, 0), ("a", 0, 11, 0, 1.0, 1), ("a", 9, 99999, 1, 1.0, 2)]
    assert sorted(r["unix_time"] for r in fold.merged(points(spark, rows), 2, 30, 0.1).collect()) == [10, 99999]


def test_deviations(spark):
    rows = [("a", 0, 60 * i, 0, 10.0 if i == 5 else 1.0, i) for i in range(10)] + [("flat", 0, 60 * i, 0, 1.0, i) for i in range(10)]
    assert [r["unix_time"] for r in deviations.deviating(points(spark, rows), 0, 0, 600, 2).collect()] == [300]
    rows = [("a", 0, 60 * i, 0, 100.0 * (i % 2), i) for i in range(10)]
    assert deviations.deviating(points(spark, rows), 0, 0, 600, 0.1).count() == 10


def test_states():
    assert lifecycle.may_move("UNOWNED", "OWNED") and lifecycle.may_move("OWNED", "PRE_UNOWNED") and lifecycle.may_move("PRE_UNOWNED", "OWNED")
    assert not lifecycle.may_move("OWNED", "READING_KEYS") and not lifecycle.may_move("OWNED", "OWNED")


def test_keys(spark):
    same = keys.key_hash(F.lit("foo")) == keys.key_hash(F.lit("FoO"))
    got = one(spark, same, keys.names_in(F.lit(" a, ,b ,")), keys.iso_seconds(F.lit("2016-10-31T06:33:44.866Z")), keys.key_fits(F.lit("x" * 401), 400), keys.key_fits(F.lit("x" * 400), 400))
    assert got == (True, ["a", "b"], 1477895624, False, True)


def test_page_and_heat(spark):
    rows = [(s, f"k{i}", f"K{i}", i, 1, 60 * i, 0.0, 0) for s, i in enumerate(range(5))]
    frame = spark.createDataFrame([(0, *r[1:]) for r in rows], "shard_id long, key_norm string, key string, arrival_seq long, category_id long, unix_time long, value double, bucket long")
    got = sorted(tuple(r) for r in read.page(read.series(frame), 1, 2).select("key", "more").collect())
    assert got == [("K1", True), ("K2", True)]
    assert {r["queried_ago"] for r in read.heat(frame, frame.where("key_norm = 'k1'")).collect()} == {0, 255}


def test_topology(spark, tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"shardCount": 3, "serviceMap": [{"serviceName": "s", "location": "x", "isLoggingNewKeysEnabled": true, "shardMap": [{"shardId": 0, "hostAddress": "h", "port": 1}, {"shardId": 0, "hostAddress": "", "port": 1}]}]}')
    found = {r["problem"] for r in topology.problems(topology.read(spark, str(file))).collect()}
    assert found == {"no host", "doubled shard"}


def test_json(spark):
    p = spark.createDataFrame([("k", 2, 3.0), ("k", 1, 4.0)], "key string, unix_time long, value double")
    got = render.json_series(p, spark.createDataFrame([("k",), ("K",)], "target string")).collect()
    assert {r["response"] for r in got} == {'{"target":"k","datapoints":[[4,1000],[3,2000]]}', '{"target":"K","datapoints":[]}'}


def test_admission():
    assert ingest.admitted(None, 100, 1, True, True, 30) == ("blocked", None)
    assert ingest.admitted(None, 100, 1, False, False, 30) == ("not_primary", None)
    assert ingest.admitted((100, 1), 200, 1, True, False, 30) == ("accepted", (200, 1))
    state = ingest.seed(1000, 5, 60)
    assert ingest.gate(state, 999, 5, 60)[0] == "spam" and ingest.gate(state, 1000, 5, 60)[0] == "accepted" and ingest.gate(state, 2000, 4, 60)[0] == "old_bucket"
    assert ingest.gate(ingest.seed(0, 0, 60), 5, 0, 60)[0] == "accepted"


def test_status_precedence(spark):
    rows = [(0, 0, 4), (1, 0, 2), (2, 0, 1), (0, 1, 6), (1, 1, 0), (0, 2, 4), (1, 2, 4), (0, 3, 0), (1, 3, 0)]
    got = {r["shard_id"]: (r["status"], r["all_success"]) for r in status.collected(spark.createDataFrame(rows, "service_id long, shard_id long, status long")).collect()}
    assert got == {0: (2, False), 1: (0, False), 2: (4, False), 3: (0, True)}


def test_failover(spark):
    rows = [(0, "a", 2, True), (1, "a", 0, True), (0, "b", 3, False), (1, "b", 0, True), (0, "c", 0, True), (1, "c", 5, True), (0, "d", 5, True), (1, "d", 2, True), (0, "e", 5, True), (1, "e", 1, False)]
    frame = spark.createDataFrame([(s, k, k, st, sv) for s, k, st, sv in rows], "service_id long, request_idx string, key_norm string, status long, served boolean")
    got = {r["request_idx"]: (r["service_id"], r["status"], r["found"]) for r in status.failover(frame).collect()}
    assert got == {"a": (1, 0, True), "b": (0, 3, False), "c": (0, 0, True), "d": (1, 2, True), "e": (1, 1, False)}


def test_finalize_plan(spark):
    o = Options(shards=10, window=100, buckets=5, behind=0)
    rows = [(0, k, b) for k, b in (("a", 3), ("b", 9))]
    frame = spark.createDataFrame(rows, "shard_id long, key_norm string, bucket long")
    plan = lambda done: lifecycle.finalize_plan(frame, spark.createDataFrame([(0, done)], "shard_id long, done long"), 960, o).first()
    assert plan(0)[1:] == (8, 8, 1, 1, False) and plan(5)[1:] == (6, 8, 3, 1, True) and plan(7)[1:] == (8, 8, 1, 1, False) and plan(8)[1:] == (9, 8, 0, 0, False)


def test_requests(spark):
    body = '{"panelId": 1, "range": {"from": "1970-01-01T00:00:01.000Z", "to": "1970-01-01T00:00:02.000Z"}, "targets": [{"target": "z"}, {"target": "a"}, {"target": "none"}]}'
    p = spark.createDataFrame([("a", 1, 4.0), ("a", 3, 5.0), ("z", 2, 6.0)], "key string, unix_time long, value double")
    got = render.answered(render.parsed(spark.createDataFrame([(body,)], "body string")), p).first()
    assert got["panel"] == 1 and got["response"] == '[{"target":"z","datapoints":[[6,2000]]},{"target":"a","datapoints":[[4,1000]]},{"target":"none","datapoints":[]}]'


def test_thinning_equals_a_plain_one(spark):
    """Batches of five rows, slices of 50 seconds, runs that go on over many of either."""
    rng = random.Random(3)
    rows = [(k, 0, rng.randrange(1500), 0, 1.0, i) for i in range(300) for k in "ab"] + [("c", 0, 40 * i, 0, 1.0, i) for i in range(9)]
    want = {}
    for k, _, t, *_ in sorted(rows, key=lambda r: r[2]):
        if not want.get(k) or t - want[k][-1] >= 30:
            want.setdefault(k, []).append(t)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = fold.thinned(points(spark, rows).repartition(3), ["key_norm"], 30, "arrival_seq").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert {k: sorted(r["unix_time"] for r in got if r["key_norm"] == k) for k in "abc"} == want
