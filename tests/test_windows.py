"""Window operators against sequential Python models of the reference loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ragloom.operators import windows as W

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def limiter_model(reqs, limit, window_s):
    """Sequential limiter: append every request, count those newer than t - window."""
    out, hist = {}, {}
    for rid, client, t in sorted(reqs, key=lambda r: (r[2], r[0])):
        h = hist.setdefault(client, [])
        h.append(t)
        h[:] = [x for x in h if x > t - dt.timedelta(seconds=window_s)]
        out[rid] = len(h)
    return out


def _requests(spark, reqs):
    return spark.createDataFrame(reqs, "request_id long, client_id string, ts timestamp")


def test_rate_limit_edges(spark):
    reqs = [(i, "a", T0 + dt.timedelta(milliseconds=500 * i)) for i in range(61)]  # 61 requests in 30 s
    reqs += [(100 + i, "b", T0) for i in range(3)]  # equal timestamps
    reqs += [(200, "c", T0), (201, "c", T0 + dt.timedelta(seconds=60)), (202, "c", T0 + dt.timedelta(seconds=59))]
    got = {r["request_id"]: r for r in W.rate_limit(_requests(spark, reqs), limit=60, window_seconds=60).collect()}
    model = limiter_model(reqs, 60, 60)
    assert {k: v["n_in_window"] for k, v in got.items()} == model
    assert got[60]["allowed"] is False and got[59]["allowed"] is True and got[60]["remaining"] == 0
    assert [got[100 + i]["n_in_window"] for i in range(3)] == [1, 2, 3]
    assert got[201]["n_in_window"] == 2  # the request exactly 60 s old is out of the window


def test_rate_limit_random_against_model(spark):
    rnd = random.Random(5)
    reqs = [(i, f"c{rnd.randint(0, 3)}", T0 + dt.timedelta(seconds=rnd.randint(0, 3000))) for i in range(800)]
    got = {r["request_id"]: r["n_in_window"] for r in
           W.rate_limit(_requests(spark, reqs), limit=5, window_seconds=60, bucket_windows=2).collect()}
    assert got == limiter_model(reqs, 5, 60)


def test_failure_streaks_against_loop(spark):
    rnd = random.Random(7)
    calls = [(i, f"k{rnd.randint(0, 2)}", rnd.random() < 0.4, T0 + dt.timedelta(hours=i)) for i in range(300)]
    df = spark.createDataFrame(calls, "seq long, key string, success boolean, ts timestamp")
    got = {r["seq"]: (r["streak"], r["tripped"]) for r in W.failure_streaks(df, threshold=3).collect()}
    streak = {}
    for seq, key, ok, _t in calls:
        streak[key] = 0 if ok else streak.get(key, 0) + 1
        assert got[seq] == (streak[key], streak[key] >= 3)


def test_lru_evict_against_loop(spark):
    rows = [(f"k{i:02d}", i % 3, T0 + dt.timedelta(days=i // 2), 10 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "cache_key string, grp int, last_accessed timestamp, size_bytes long")
    got = sorted(r["cache_key"] for r in W.lru_evict(df, 100).collect())
    freed, evicted = 0, []
    for key, _g, _t, size in sorted(rows, key=lambda r: (r[2], r[0])):
        if freed >= 100:
            break
        evicted.append(key)
        freed += size
    assert got == sorted(evicted)


def test_evict_oldest_keeps_max_minus_one(spark):
    rows = [(f"k{i}", T0 + dt.timedelta(minutes=i)) for i in range(10)]
    df = spark.createDataFrame(rows, "cache_key string, created_at timestamp")
    assert sorted(r["cache_key"] for r in W.evict_oldest(df, 8).collect()) == ["k0", "k1", "k2"]
    assert W.evict_oldest(df, 20).count() == 0


def test_prefix_agg_hot_key_equals_plain_window(spark):
    rnd = random.Random(11)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", T0 + dt.timedelta(minutes=rnd.randint(0, 5000)), rnd.randint(-3, 3))
            for i in range(600)]
    df = spark.createDataFrame(rows, "seq long, name string, ts timestamp, delta long")
    got = {r["seq"]: r["gauge"] for r in W.running_gauge(df).collect()}
    run = {}
    for seq, name, ts, d in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        run[name] = run.get(name, 0) + d
        assert got[seq] == run[name]


def test_counter_rate_and_last_n(spark):
    rows = [("m", T0 + dt.timedelta(seconds=10 * i), i, 100 + 5 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "name string, ts timestamp, seq long, total_requests long")
    r = {x["seq"]: x["requests_per_sec"] for x in W.counter_rate(df, ["name"]).collect()}
    assert r[0] == 0.0 and r[4] == 20 / 40
    assert sorted(x["seq"] for x in W.last_n_per_key(df, 2).collect()) == [3, 4]


def test_one_key_in_one_instant_is_cut_into_many_chunks(spark):
    """All rows have one key and one time: their runs still come from many tasks."""
    rnd = random.Random(13)
    rows = [(i, "k", T0, rnd.random() < 0.1) for i in range(4000)]
    df = spark.createDataFrame(rows, "seq long, key string, ts timestamp, success boolean").repartition(4)
    chunks = W.row_chunks(df, ["key"], ["ts", "seq"]).groupBy("__chunk").count().collect()
    assert len(chunks) >= 4 and max(r["count"] for r in chunks) < 2000
    got = {r["seq"]: r["streak"] for r in W.failure_streaks(df, 3).collect()}
    streak = 0
    for seq, _k, _t, ok in rows:
        streak = 0 if ok else streak + 1
        assert got[seq] == streak


@pytest.mark.parametrize("share", [0.0, 0.002, 0.5, 1.0])
def test_streaks_over_chunk_edges(spark, share):
    """Keys inside a chunk, keys over several, chunks without a success; nulls as keys and answers."""
    rnd = random.Random(17)
    rows = [(i, rnd.choice(["a", "a", "a", "b", None]), T0 + dt.timedelta(seconds=i // 7),
             None if i % 50 == 9 else rnd.random() < share) for i in range(1500)]
    df = spark.createDataFrame(rows, "seq long, key string, ts timestamp, success boolean").repartition(3)
    got = {r["seq"]: (r["streak"], r["tripped"]) for r in W.failure_streaks(df, 5, chunks=11).collect()}
    streak = {}
    for seq, key, _t, ok in rows:
        streak[key] = 0 if ok else streak.get(key, 0) + 1
        assert got[seq] == (streak[key], streak[key] >= 5)


def test_running_totals_over_chunk_edges(spark):
    rnd = random.Random(19)
    rows = [(f"k{i:04d}", rnd.choice(["x", "x", "y", None]), T0 + dt.timedelta(days=i // 400), rnd.randint(1, 9)) for i in range(1200)]
    df = spark.createDataFrame(rows, "cache_key string, model string, at timestamp, size_bytes long").repartition(3)
    got = {r["cache_key"]: r["p"] for r in W.prefix_agg(df, ["model"], ["at", "cache_key"], F.col("size_bytes"), "sum", False, "p", 13).collect()}
    most = {r["cache_key"]: r["p"] for r in W.prefix_agg(df, ["model"], ["at", "cache_key"], F.col("size_bytes"), "max", True, "p", 13).collect()}
    run, top = {}, {}
    for key, model, _t, size in rows:
        assert got[key] == run.get(model, 0)
        run[model] = run.get(model, 0) + size
        top[model] = max(top.get(model, 0), size)
        assert most[key] == top[model]
    oldest = {r["cache_key"] for r in W.evict_oldest(df, 101, ["model"], "at").collect()}
    for model in ("x", "y", None):
        mine = [k for k, m, _t, _s in rows if m == model]
        assert oldest & set(mine) == set(mine[:len(mine) - 100])
    assert {r["cache_key"] for r in W.evict_oldest(df, 101, None, "at").collect()} == {k for k, *_ in rows[:1100]}
    assert W.prefix_agg(df.limit(0), ["model"], ["at"], F.lit(1)).count() == 0


def test_hot_bucket_is_counted_by_positions(spark):
    """A client with most requests of a window, many at one time: the same counts as in groups."""
    rnd = random.Random(23)
    reqs = [(i, "hot" if i % 4 else f"c{i % 3}", T0 + dt.timedelta(seconds=rnd.randint(0, 1500) // 10 * 10)) for i in range(1200)]
    df = _requests(spark, reqs)
    got = {r["request_id"]: r["n_in_window"] for r in W.rate_limit(df, 5, 60, hot_rows=100).collect()}
    assert got == limiter_model(reqs, 5, 60)
