"""Streams against the batch operators and a Python model of the breaker."""

import contextlib
import datetime as dt
import io
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ragloom.operators import windows as W
from ragloom.streaming import online as S

T0 = dt.datetime(2024, 1, 1)


def _stream_of(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    df.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _requests(n, seconds, clients, seed):
    rnd = random.Random(seed)
    return [(i, f"c{rnd.randint(0, clients - 1)}", T0 + dt.timedelta(seconds=rnd.randint(0, seconds))) for i in range(n)]


REQUESTS = "request_id long, client_id string, ts timestamp"


@pytest.mark.parametrize("files", [1, 4])
def test_rate_limit_stream_equals_batch(spark, files):
    """Out of order within the lateness, over bucket edges, in one micro-batch and in several."""
    df = spark.createDataFrame(_requests(300, 4000, 3, 2), REQUESTS)
    batch = {r["request_id"]: (r["n_in_window"], r["allowed"], r["remaining"]) for r in W.rate_limit(df, 4, 60).collect()}
    stream = S.replay(df, "t-st3", files=files, jitter="100 seconds")
    run = S.run_stream(spark, S.rate_limit_stream(stream, 4, 60), "t-st3", rocksdb=True)
    got = {r["request_id"]: (r["n_in_window"], r["allowed"], r["remaining"]) for r in run.rows.collect()}
    assert got == batch and run.late_rows == 0
    assert all(n <= 4 or not ok for n, ok, _ in got.values()) and any(not ok for _, ok, _ in got.values())


def test_breaker_stream_equals_model(spark, tmp_path):
    rnd = random.Random(4)
    calls = [(i, f"k{rnd.randint(0, 1)}", rnd.random() < 0.3, T0 + dt.timedelta(seconds=7 * i)) for i in range(200)]
    df = spark.createDataFrame(calls, "seq long, key string, success boolean, ts timestamp")
    out = S.run_to_table(spark, S.circuit_breaker_stream(_stream_of(spark, df, tmp_path, "calls"), 3, 60),
                         "t-st5", "append")
    got = {r["seq"]: (r["decision"], r["state"]) for r in out.collect()}
    state = {}
    for seq, key, ok, ts in calls:
        st, f, last = state.get(key, ("CLOSED", 0, 0))
        t = int(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
        d, st, f, last = S.breaker_step(st, f, last, t, ok, 3, 60_000_000)
        state[key] = (st, f, last)
        assert got[seq] == (d, st)
    assert any(v[0] == "rejected" for v in got.values())


def test_breaker_does_not_forget_an_idle_key(spark, tmp_path):
    hours = [[("a", 0.0), ("a", 0.01), ("a", 0.02)], [("b", 5)], [("c", 6)], [("a", 7)]]
    calls, files = "seq long, key string, success boolean, ts timestamp", []
    for part in hours:
        start = sum(map(len, files))
        files.append([(start + i, k, False, T0 + dt.timedelta(hours=h)) for i, (k, h) in enumerate(part)])
    got = []
    for name, parts in (("one", [sum(files, [])]), ("several", files)):
        path = str(tmp_path / name)
        for rows in parts:
            spark.createDataFrame(rows, calls).coalesce(1).write.mode("append").parquet(path)
        stream = S.file_stream(spark, path, spark.read.parquet(path).schema, max_files=1)
        out = S.run_to_table(spark, S.circuit_breaker_stream(stream, 3, 60), f"t-st5-{name}", "append")
        got.append(sorted((r["seq"], r["decision"], r["state"], r["failure_count"]) for r in out.collect()))
    assert got[0] == got[1]
    assert got[1][-1] == (5, "allowed", "OPEN", 4)


def test_threshold_alerts_and_latest(spark, tmp_path):
    snaps = spark.createDataFrame([(1, 2048.0, 10.0), (2, 10.0, 95.0), (3, 2000.0, 99.0), (4, 1024.0, 80.0)],
                                  "id long, memory_mb double, cpu_percent double")
    out = S.run_to_table(spark, S.stream_threshold_alerts(_stream_of(spark, snaps, tmp_path, "snap")), "t-st2", "append")
    assert sorted((r["id"], r["alert"]) for r in out.collect()) == [
        (1, "high_memory"), (2, "high_cpu"), (3, "high_cpu"), (3, "high_memory")]


def test_ingest_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "image_path string, seq long")
    table = str(tmp_path / "table")
    src = _stream_of(spark, rows, tmp_path, "src")
    S.continuous_ingest(src, table, order_col="seq", checkpoint=str(tmp_path / "ck")).awaitTermination()
    more = spark.createDataFrame([("a", 9), ("c", 4)], "image_path string, seq long")
    more.write.mode("append").parquet(str(tmp_path / "src"))
    S.continuous_ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "src")), table, order_col="seq",
                        checkpoint=str(tmp_path / "ck")).awaitTermination()
    # a second stream, which begins anew with its own checkpoint, adds nothing
    S.continuous_ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "src")), table, order_col="seq",
                        checkpoint=str(tmp_path / "other")).awaitTermination()
    got = sorted((r["image_path"], r["seq"]) for r in spark.read.parquet(table).collect())
    assert got == [("a", 1), ("b", 2), ("c", 4)]


def test_ingest_fails_on_a_broken_key_table(spark, tmp_path):
    """A key table that can't be read is no reason to insert its keys again."""
    table = tmp_path / "table"
    bad = tmp_path / "table-keys" / "run=00000000" / "batch=0" / "bucket=0"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_text("no parquet")
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(200)], "image_path string, seq long")
    q = S.continuous_ingest(_stream_of(spark, rows, tmp_path, "src"), str(table), order_col="seq", checkpoint=str(tmp_path / "ck"))
    with pytest.raises(StreamingQueryException):
        q.awaitTermination()
    assert not (table / "run=00000000").exists()


def test_ingest_reads_only_the_buckets_it_touches(spark, tmp_path):
    keys = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("image_path"), F.col("id").alias("seq"))
    table = str(tmp_path / "table")
    S.continuous_ingest(_stream_of(spark, keys, tmp_path, "src"), table, order_col="seq", checkpoint=str(tmp_path / "ck")).awaitTermination()
    one = keys.filter("seq = 7").select("image_path", (F.pmod(F.xxhash64("image_path"), F.lit(S.KEY_BUCKETS)).cast("int")).alias("bucket"))
    scan = spark.read.parquet(f"{table}-keys").join(F.broadcast(one.select("bucket").distinct().filter("bucket >= 0")), "bucket", "left_semi")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        scan.explain("formatted")
    assert "dynamicpruning" in buf.getvalue().lower() and scan.select("bucket").distinct().count() == 1
    assert spark.read.parquet(table).count() == 500


def test_latest_values_merge_in_any_order_and_replay_changes_nothing(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(f"m{rnd.randint(0, 4)}", float(i), T0 + dt.timedelta(seconds=rnd.randint(0, 500)), i) for i in range(200)]
    want = {}
    for name, value, ts, seq in rows:
        best, n = want.get(name, ((ts, seq, value), 0))
        want[name] = max(best, (ts, seq, value)), n + 1
    schema = "name string, value double, ts timestamp, seq long"
    for every, parts in ((50, 1), (2, 7)):
        src, table = str(tmp_path / f"src{every}"), str(tmp_path / f"table{every}")
        for k in range(parts):
            spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(src)
        stream = S.file_stream(spark, src, spark.read.parquet(src).schema, max_files=1)
        for ck in ("a", "a", "b"):  # again with its checkpoint: nothing new; with another: all of it again
            S.upsert_latest(stream, table, checkpoint=str(tmp_path / f"ck{every}{ck}"), compact_every=every).awaitTermination()
            got = {r["name"]: (r["value"], r["total_values"]) for r in S.latest_values(spark, table).collect()}
            assert got == {k: (b[2], n) for k, (b, n) in want.items()}


def test_rolling_windows_do_not_depend_on_the_files(spark):
    rnd = random.Random(8)
    rows = [(f"m{rnd.randint(0, 2)}", float(rnd.randint(0, 9)), T0 + dt.timedelta(seconds=rnd.randint(0, 6000)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, value double, ts timestamp, seq long")
    got = []
    for files in (1, 3, 20):
        run = S.run_stream(spark, S.rolling_metric_stats(S.replay(df, "t-st1", files=files, jitter="8 minutes")), "t-st1")
        assert run.late_rows == 0 and run.batches >= files
        got.append(sorted((r["name"], r["window"]["start"], r["count"], r["min"], r["max"], r["sum"]) for r in run.rows.collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) > 200


def test_days_do_not_depend_on_the_files_and_late_rows_are_counted(spark):
    rows = [(T0 + dt.timedelta(hours=7 * i), 10.0 * i, "completed" if i % 3 else "failed") for i in range(60)]
    df = spark.createDataFrame(rows, "created_at timestamp, generation_time_ms double, status string")
    got = []
    for files in (1, 5):
        run = S.run_stream(spark, S.daily_trend_stream(S.replay(df, "t-st6", "created_at", files, "3 days", "10 hours")), "t-st6")
        got.append(sorted((r["window"]["start"], r["count"], r["successful"]) for r in run.rows.collect()))
    assert got[0] == got[1] and sum(n for _, n, _ in got[0]) == 60
    late = S.run_stream(spark, S.daily_trend_stream(S.replay(df, "t-st6", "created_at", 12, "3 days", "9 days"), "1 hour"), "t-st6")
    assert late.late_rows > 0 and sum(r["count"] for r in late.rows.collect()) < 60


def test_dedup_within_ttl(spark, tmp_path):
    rows = spark.createDataFrame([(1, "q", T0), (2, "q", T0 + dt.timedelta(seconds=10)), (3, "r", T0)],
                                 "id long, query string, ts timestamp")
    out = S.run_to_table(spark, S.dedup_within_ttl(_stream_of(spark, rows, tmp_path, "dd"), ["query"]), "t-st4",
                         "append")
    assert sorted(r["query"] for r in out.collect()) == ["q", "r"]


def test_dedup_keeps_one_row_a_ttl_window(spark, tmp_path):
    seconds = [0, 10, 300, 301, 500, 602, 86_400, 86_401]
    rows = [(i, "q", T0 + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    schema, got = "id long, query string, ts timestamp", []
    for name, files in (("one", [rows]), ("several", [rows[:3], rows[3:5], rows[5:7], rows[7:]])):
        path = str(tmp_path / name)
        for part in files:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = S.file_stream(spark, path, spark.read.parquet(path).schema, max_files=1)
        out = S.run_to_table(spark, S.dedup_within_ttl(stream, ["query"]), f"t-st4-{name}", "append")
        got.append(sorted(r["id"] for r in out.collect()))
    assert got == [[0, 3, 5, 6]] * 2


def test_dedup_query_equals_the_cache_sql(spark):
    import duckdb

    import __spark_entry__ as E
    from tests.conftest import SF_SMOKE

    sql = E.oracle_sql()["st4_ttl_cache"].replace("86400000000", "300000000")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_SMOKE}/events.parquet'")
    want = {r[0] for r in con.execute(f"SELECT request_id FROM ({sql}) t WHERE NOT cache_hit").fetchall()}
    got = [r["event_id"] for r in E.queries()["st4_dedup_within_ttl"](spark, SF_SMOKE).collect()]
    assert len(got) == len(want) and set(got) == want


def test_ttl_cache_stream_model(spark, tmp_path):
    rows = [("q", 1, T0), ("q", 2, T0 + dt.timedelta(seconds=300)), ("q", 3, T0 + dt.timedelta(seconds=301)),
            ("q", 4, T0 + dt.timedelta(seconds=400)), ("r", 5, T0 + dt.timedelta(seconds=10))]
    df = spark.createDataFrame(rows, "query_key string, request_id long, ts timestamp")
    out = S.run_to_table(spark, S.ttl_cache_stream(_stream_of(spark, df, tmp_path, "ttl"), "query_key", 300),
                         "t-st4x", "append")
    got = {r["request_id"]: r["cache_hit"] for r in out.collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_rate_limit_micro_batches_carry_state(spark, tmp_path):
    rnd = random.Random(9)
    reqs = [(i, f"c{rnd.randint(0, 1)}", T0 + dt.timedelta(seconds=rnd.randint(0, 600))) for i in range(400)]
    reqs.sort(key=lambda r: (r[2], r[0]))
    df = spark.createDataFrame(reqs, "request_id long, client_id string, ts timestamp")
    src = str(tmp_path / "src")
    first, second = reqs[:250], reqs[250:]  # arrive in time order, in two files
    spark.createDataFrame(first, df.schema).coalesce(1).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    S.rate_limit_micro_batches(stream, out, 5, 60, state_dir=str(tmp_path / "state"),
                               checkpoint=str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame(second, df.schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    S.rate_limit_micro_batches(stream, out, 5, 60, state_dir=str(tmp_path / "state"),
                               checkpoint=str(tmp_path / "ck")).awaitTermination()
    got = {r["request_id"]: r["n_in_window"] for r in spark.read.parquet(out).collect()}
    want = {r["request_id"]: r["n_in_window"] for r in W.rate_limit(df, 5, 60).collect()}
    assert got == want


def test_rate_limit_micro_batches_hold_back_what_may_be_overtaken(spark, tmp_path):
    """Requests out of order across batches; those later than the lateness are written apart."""
    df = spark.createDataFrame(_requests(400, 2000, 2, 12), REQUESTS)
    want = {r["request_id"]: r["n_in_window"] for r in W.rate_limit(df, 5, 60).collect()}
    for files in (1, 3, 6):
        out = str(tmp_path / f"out{files}")
        S.rate_limit_micro_batches(S.replay(df, "t-st3b", files=files, jitter="100 seconds"), out, 5, 60,
                                   lateness_seconds=120).awaitTermination()
        assert {r["request_id"]: r["n_in_window"] for r in spark.read.parquet(out).collect()} == want
    out = str(tmp_path / "late")
    S.rate_limit_micro_batches(S.replay(df, "t-st3b", files=6, jitter="900 seconds"), out, 5, 60,
                               lateness_seconds=120).awaitTermination()
    late = {r["request_id"] for r in spark.read.parquet(f"{out}-late").collect()}
    kept = {r["request_id"] for r in spark.read.parquet(out).collect()}
    assert late and late | kept == set(want) and not late & kept


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    src = str(tmp_path / "late")
    on_time = spark.createDataFrame([("m", 1.0, T0 + dt.timedelta(hours=2), i) for i in range(5)],
                                    "name string, value double, ts timestamp, seq long")
    late = spark.createDataFrame([("m", 9.0, T0, 100)], on_time.schema)
    on_time.coalesce(1).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(on_time.schema).option("maxFilesPerTrigger", 1).parquet(src)
    agg = S.rolling_metric_stats(stream, lateness="10 minutes")
    out = str(tmp_path / "out")
    q = (agg.writeStream.outputMode("update").foreachBatch(
            lambda b, i: b.write.mode("append").parquet(out))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    late.coalesce(1).write.mode("append").parquet(src)
    q = (agg.writeStream.outputMode("update").foreachBatch(
            lambda b, i: b.write.mode("append").parquet(out))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert S.dropped_late_rows(q) >= 1
    assert spark.read.parquet(out).agg(F.max("max")).first()[0] == 1.0


def test_streams_equal_their_batch_operators(spark):
    import __spark_entry__ as E
    from ragloom import adapters as A
    from ragloom.operators import aggregates as G
    from tests.conftest import SF_SMOKE

    q = E.queries()
    daily = {r["date"]: (r["count"], r["successful"]) for r in q["st6_daily_trend"](spark, SF_SMOKE).collect()}
    g = A.generations(spark, SF_SMOKE)
    batch = G.generation_trends(g, 10_000, as_of=g.agg(F.max("created_at")))
    assert daily == {r["date"].isoformat(): (r["count"], r["successful"]) for r in batch.collect()}
    latest = {r["name"]: (r["value"], r["total_values"]) for r in q["st7_latest_value"](spark, SF_SMOKE).collect()}
    lb = G.latest_metric_values(A.metric_samples(spark, SF_SMOKE)).collect()
    assert latest == {r["name"]: (r["latest_value"], r["total_values"]) for r in lb}


def test_breaker_timeout_edges():
    us = 1_000_000
    st, f, last = "CLOSED", 0, 0
    for i in range(5):  # five straight failures open the breaker
        d, st, f, last = S.breaker_step(st, f, last, i * us, False, 5, 60 * us)
    assert st == "OPEN" and f == 5
    d, st2, f2, last2 = S.breaker_step(st, f, last, 4 * us + 60 * us, True, 5, 60 * us)
    assert d == "rejected" and st2 == "OPEN"  # exactly 60 s later: still open
    d, st3, f3, _ = S.breaker_step(st, f, last, 4 * us + 61 * us, True, 5, 60 * us)
    assert d == "allowed" and st3 == "CLOSED" and f3 == 0  # 61 s later: half-open, success closes
    d, st4, f4, _ = S.breaker_step(st, f, last, 4 * us + 61 * us, False, 5, 60 * us)
    assert d == "allowed" and st4 == "OPEN" and f4 == 6  # half-open failure re-opens


def test_keys_share_states_by_hash(spark, tmp_path, monkeypatch):
    """A key has no state row of its own: one bucket keeps all keys apart, also null ones, over several micro-batches."""
    monkeypatch.setattr(S, "STATE_BUCKETS", 1)
    seconds = [0, 10, 301, 400, 1200]
    rows = [(100 * k + i, f"q{k}" if k else None, k if k != 1 else None, T0 + dt.timedelta(seconds=s)) for k in range(4) for i, s in enumerate(seconds)]
    schema, path = "id long, query string, n long, ts timestamp", str(tmp_path / "one")
    for low, high in ((0, 10), (301, 400), (1200, 1200)):
        some = [r for r in rows if low <= (r[3] - T0).total_seconds() <= high]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(path)
    stream = S.file_stream(spark, path, spark.read.parquet(path).schema, max_files=1)
    out = S.run_to_table(spark, S.dedup_within_ttl(stream, ["query"]), "t-st4-shared")
    got = sorted((r["id"], r["query"], r["n"]) for r in out.collect())
    assert got == sorted((100 * k + i, f"q{k}" if k else None, k if k != 1 else None) for k in range(4) for i in (0, 2, 4))
    req = stream.select("query", F.col("id").alias("request_id"), "ts")
    hits = S.run_to_table(spark, S.ttl_cache_stream(req, "query", 300), "t-st4-hits").collect()
    assert {r["request_id"] for r in hits if not r["cache_hit"]} == {r[0] for r in got} and len(hits) == 20


def test_breaker_hands_a_keys_calls_back_in_parts(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", i, i % 5 == 0, T0 + dt.timedelta(seconds=7 * i)) for i in range(100)],
                               "key string, seq long, success boolean, ts timestamp")
    got = []
    for rows in (7, 1 << 16):
        monkeypatch.setattr(S, "OUT_ROWS", rows)
        out = S.run_to_table(spark, S.circuit_breaker_stream(_stream_of(spark, df, tmp_path, f"parts{rows}"), 3, 60), f"t-st5-parts{rows}")
        got.append(sorted(tuple(r) for r in out.collect()))
    assert got[0] == got[1] and len(got[0]) == 100


def test_replay_writes_a_slice_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "REPLAY_ROWS", 10)
    df = spark.range(90).select("id", F.timestamp_seconds(F.col("id") + 1_704_067_200).alias("ts"))
    run = S.run_stream(spark, S.replay(df, "t-many", files=3, closing=None), "t-many")
    assert run.batches == 3 and run.rows.count() == 90
