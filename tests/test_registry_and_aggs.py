"""Registries (U2, U3), empty inputs and unknown metrics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ragloom.functions import registry as R
from ragloom.operators import aggregates as G
from ragloom.operators import changes as D

T0 = dt.datetime(2024, 1, 1)


def test_register_metric_overwrites_keeping_position(spark):
    reg = R.default_registry(spark)
    reg2 = R.register_metric(reg, "cpu_usage_percent", "gauge", "new text")
    reg3 = R.register_metric(reg2, "queue_depth", "gauge", "q")
    rows = {r["name"]: r for r in reg3.collect()}
    assert len(rows) == 14 and rows["cpu_usage_percent"]["description"] == "new text"
    assert rows["cpu_usage_percent"]["reg_seq"] == 12 and rows["queue_depth"]["reg_seq"] == 13


def test_empty_generation_table(spark):
    empty = spark.createDataFrame([], "id long, status string, generation_time_ms double, created_at timestamp")
    r = G.success_rate(empty).first()
    assert r["total"] == 0 and r["success_rate"] == 0.0
    assert G.generation_trends(empty, 30, as_of=T0).count() == 0
    s = G.database_stats(empty, empty, empty, empty).first()
    assert s["generations"] == 0 and s["recent_generations"] == 0 and s["avg_generation_time_ms"] == 0.0


def test_window_stats_no_samples_and_unknown(spark):
    reg = R.default_registry(spark)
    samples = spark.createDataFrame([("api_requests_total", 1.0, T0, 1, {}),
                                     ("api_requests_total", 2.0, T0 + dt.timedelta(minutes=10), 2, {})],
                                    "name string, value double, ts timestamp, seq long, labels map<string,string>")
    st = {r["name"]: r for r in G.metric_window_stats(samples, reg, 5, as_of=T0 + dt.timedelta(minutes=10)).collect()}
    assert st["api_requests_total"]["count"] == 1 and st["api_requests_total"]["sum"] == 2.0
    assert st["cpu_usage_percent"]["count"] == 0 and st["cpu_usage_percent"]["sum"] == 0.0
    assert st["cpu_usage_percent"]["min"] is None
    req = spark.createDataFrame([("nope",), ("api_requests_total",)], "name string")
    assert [r["error"] for r in G.unknown_metric_errors(req, reg).collect()] == ["Metric nope not found"]


def test_health_rollup_and_checks(spark):
    res = spark.createDataFrame([("a", "healthy"), ("a", "warning"), ("b", "unknown"), ("c", "critical"),
                                 ("c", "healthy")], "g string, status string")
    got = {r["g"]: r["overall_status"] for r in G.health_rollup(res, ["g"]).collect()}
    assert got == {"a": "warning", "b": "unknown", "c": "critical"}
    empty = spark.createDataFrame([], "status string")
    assert G.health_rollup(empty).first()["overall_status"] == "unknown"
    chk = R.CheckRegistry()
    chk.register_check("queue", F.when(F.col("x") > 5, "warning").otherwise("healthy"))
    chk.register_check("broken", F.lit(None))
    df = spark.createDataFrame([(1,), (9,)], "x int")
    assert sorted((r["check"], r["status"]) for r in chk.evaluate(df).collect()) == [
        ("broken", "unknown"), ("broken", "unknown"), ("queue", "healthy"), ("queue", "warning")]


def test_changes_cutoffs(spark):
    df = spark.createDataFrame([(1, T0 - dt.timedelta(days=30), T0), (2, T0 - dt.timedelta(days=31), None),
                                (3, T0, T0 - dt.timedelta(seconds=1))],
                               "id long, created_at timestamp, expires_at timestamp")
    assert sorted(r["id"] for r in D.retain_since(df, 30, "days", as_of=T0).collect()) == [1, 3]
    assert sorted(r["id"] for r in D.expire_ttl(df, as_of=T0).collect()) == [1, 2]
    types = spark.createDataFrame([("a", "type1"), ("b", "type2"), ("c", "type1")], "k string, model_type string")
    assert [r["k"] for r in D.clear_by_type(types, "type1").collect()] == ["b"]
    assert D.clear_by_type(types).count() == 0
    tgt = spark.createDataFrame([("p1",)], "image_path string")
    new = spark.createDataFrame([("p1", 1), ("p2", 2), ("p2", 3)], "image_path string, seq int")
    ins, rej = D.insert_unique(tgt, new, "image_path", "seq")
    assert [(r["image_path"], r["seq"]) for r in ins.collect()] == [("p2", 2)]
    assert sorted(r["reason"] for r in rej.collect()) == ["duplicate", "exists"]


def test_performance_summary(spark):
    rows = [(i, "a" if i % 2 else "b", float(i), 0.0, float(i % 3), float(i), T0 + dt.timedelta(seconds=i))
            for i in range(10)]
    ops = spark.createDataFrame(rows, "seq long, component string, duration double, memory_before double, "
                                      "memory_after double, cpu_percent double, ts timestamp")
    full = {(r["level"], r["component"]): r for r in G.performance_summary(ops).collect()}
    assert full[("overall", None)]["n"] == 10 and full[("component", "a")]["max_duration"] == 9.0
    assert full[("overall", None)]["min_duration"] == 0.0 and full[("component", "b")]["n"] == 5


def test_insert_unique_loses_no_row(spark):
    new = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (2, "a", 5), (3, "b", 1), (4, None, 1), (5, None, 1)],
                                "id int, path string, seq int")
    target = spark.createDataFrame([("b",)], "path string")
    for order in (None, "seq"):
        ins, rej = D.insert_unique(target, new, "path", order)
        assert sorted((r["id"], r["path"]) for r in ins.collect() if r["path"]) == [(1, "a")]
        assert sorted((r["id"], r["reason"]) for r in rej.collect()) == [(2, "duplicate"), (2, "duplicate"), (3, "exists"), (5, "duplicate")]
        assert ins.count() + rej.count() == new.count()


def test_window_stats_count_every_sample(spark):
    samples = spark.range(2500).selectExpr("'m' AS name", "cast(id AS double) AS value",
                                           "timestamp'2024-01-01 00:00:00' AS ts", "id AS seq", "map('a', 'b') AS labels")
    reg = spark.createDataFrame([("m",)], "name string")
    r = G.metric_window_stats(samples, reg, 5, as_of=dt.datetime(2024, 1, 1, 0, 1)).first()
    assert (r["count"], r["min"], r["max"]) == (2500, 0.0, 2499.0)


def test_rules_as_data_match_fixed_rules(spark):
    from ragloom import adapters as A
    from ragloom.operators import predicates as P
    from tests.conftest import SF_SMOKE

    sm = A.system_metrics(spark, SF_SMOKE)
    long = {(r["id"], r["check"]): r["status"] for r in P.classify_with_rules(sm, P.threshold_rules(spark)).collect()}
    wide = P.classify_thresholds(sm).select("id", "memory_status", "cpu_status", "disk_status", "gpu_status").collect()
    for r in wide:
        for c in ("memory", "cpu", "disk", "gpu"):
            assert long[(r["id"], c)] == r[f"{c}_status"]


def test_auto_registration_follows_first_sample(spark):
    reg = R.default_registry(spark)
    samples = spark.createDataFrame([("zeta", 1.0, T0 + dt.timedelta(seconds=5), 2),
                                     ("alpha", 2.0, T0 + dt.timedelta(seconds=9), 3),
                                     ("zeta", 3.0, T0, 1),
                                     ("cpu_usage_percent", 4.0, T0, 4)],
                                    "name string, value double, ts timestamp, seq long")
    eff = {r["name"]: (r["type"], r["reg_seq"]) for r in R.effective_registry(reg, samples).collect()}
    assert eff["zeta"] == ("gauge", 13) and eff["alpha"] == ("gauge", 14)
    assert eff["cpu_usage_percent"] == ("gauge", 12) and len(eff) == 15


def test_pagination_edges(spark):
    from ragloom.operators import ordering as O

    df = spark.range(0, 45).withColumnRenamed("id", "id")
    info = O.page_info(df, limit=20, offset=40).first()
    assert (info["total"], info["pages"], info["page"], info["has_next"], info["has_prev"]) == (45, 3, 3, False, True)
    first = O.page_info(df, limit=20, offset=0).first()
    assert first["has_next"] is True and first["has_prev"] is False
    assert [r["id"] for r in O.paginate(df, 20, 40).collect()] == list(range(40, 45))
    assert [r["id"] for r in O.paginate_after(df, 39, 20).collect()] == list(range(40, 45))


def test_a_check_that_fails_leaves_the_others(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "id int, v string")
    chk = R.CheckRegistry()
    chk.register_check("bad cast", F.when(F.col("v").cast("int") > 3, "healthy").otherwise("warning"))
    chk.register_check("no such column", F.col("missing"))
    chk.register_check("fine", F.when(F.col("v").isNotNull(), "healthy"))
    got = {(r["id"], r["check"]): r["status"] for r in chk.evaluate(df, keep=["id"]).collect()}
    assert got == {(i, "bad cast"): "unknown" for i in (1, 2, 3)} | {(i, "no such column"): "unknown" for i in (1, 2, 3)} | {
        (1, "fine"): "healthy", (2, "fine"): "healthy", (3, "fine"): "unknown"}


def test_metric_definitions_merge_by_name(spark):
    reg = R.default_registry(spark)
    new = spark.createDataFrame([("queue", "gauge", "q", "", {"a": "b"}, 50), ("cpu_usage_percent", "counter", "c", "", {}, 51)], R.REGISTRY_SCHEMA)
    once = R.register_metrics(reg, new)
    rows = lambda d: sorted((r["name"], r["type"], r["reg_seq"], tuple(r["labels"].items())) for r in d.collect())
    assert rows(once) == rows(R.register_metrics(once, new))
    got = {n: (t, s, m) for n, t, s, m in rows(once)}
    assert got["queue"] == ("gauge", 50, (("a", "b"),)) and got["cpu_usage_percent"] == ("counter", 12, ()) and len(got) == 14


def test_insert_unique_with_map_columns(spark):
    from ragloom.operators import changes as D

    schema = "id int, labels map<string,int>, n int"
    target = spark.createDataFrame([(1, {"a": 1}, 0)], schema)
    new = spark.createDataFrame([(1, {"b": 2}, 1), (2, {"x": 1, "y": 2}, 5), (2, {"y": 2, "x": 1}, 4), (3, None, 6), (3, None, 6)], schema)
    inserted, rejected = D.insert_unique(target, new, "id", "n")
    assert sorted((r["id"], r["n"], r["labels"]) for r in inserted.collect()) == [(2, 4, {"x": 1, "y": 2}), (3, 6, None)]
    assert sorted((r["id"], r["n"], r["reason"]) for r in rejected.collect()) == [(1, 1, "exists"), (2, 5, "duplicate"), (3, 6, "duplicate")]


def test_rule_tables_are_bounded(spark, monkeypatch):
    from ragloom.operators import predicates as P

    monkeypatch.setattr(P, "MAX_RULES", 3)
    df = spark.createDataFrame([(1, 50.0)], "id int, memory_percent double")
    with pytest.raises(ValueError):
        P.classify_with_rules(df, P.threshold_rules(spark))


def test_cache_stats_name_the_models(spark):
    rows = [("a", "m2", 1, "cpu", 5), ("a", "m1", 2, "cuda", 7), ("a", "m2", 0, "cpu", 1), ("b", None, 3, "cpu", 2)]
    df = spark.createDataFrame(rows, "model_type string, model_name string, access_count long, device string, size_bytes long")
    got = {r["model_type"]: r["model_names"] for r in G.cache_stats(df).collect()}
    assert got == {"a": ["m1", "m2"], "b": []}
