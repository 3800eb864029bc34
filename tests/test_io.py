"""Sources, sinks and composed jobs on temporary folders."""

import datetime as dt
import json

from pyspark.sql import functions as F

from ragloom.operators import aggregates as G
from ragloom.operators import joins as J
from ragloom.plans import ingest, reports
from ragloom.sources import readers as R
from ragloom.sources import sinks as K
from tests.conftest import SF_SMOKE
from ragloom import adapters as A


def test_metadata_csv_and_ingest(spark, tmp_path):
    img_dir = tmp_path / "images"
    img_dir.mkdir()
    for n in ("a.jpg", "b.jpg"):
        (img_dir / n).write_bytes(b"x")
    csv = tmp_path / "metadata.csv"
    csv.write_text("image_filename,description,tags,style,category\n"
                   "a.jpg,A cat,\"cat,chair\",photo,animals\nb.jpg,,dog,,\nmissing.jpg,gone,x,y,z\n")
    meta = R.read_metadata_csv(spark, str(csv))
    assert meta.count() == 3 and R.read_metadata_csv(spark, str(csv), max_rows=1).first()["image_filename"] == "a.jpg"
    items = ingest.csv_items(meta, str(img_dir))
    files = R.list_files(spark, str(img_dir), "*.jpg")
    existing = spark.createDataFrame([], "image_path string")
    imgs, emb, rejected = ingest.ingest(items, files, existing)
    got = {r["image_path"].split("/")[-1]: r["text"] if "text" in r else None for r in imgs.collect()}
    assert set(got) == {"a.jpg", "b.jpg"}
    assert {r["image_id"] for r in emb.collect()} == {r["id"] for r in imgs.collect()}
    assert emb.select(F.size("embedding")).first()[0] == 384
    again, _, rej = ingest.ingest(items, files, imgs.select("image_path"))
    assert again.count() == 0 and rej.count() == 2


def test_annotations_and_coco(spark, tmp_path):
    ann = [{"id": 2, "image_path": "data/train/b.jpg", "file_name": "b.jpg", "width": 5, "height": 6,
            "captions": ["x"], "num_objects": 1},
           {"id": 1, "image_path": "data/train/a.jpg", "file_name": "a.jpg", "width": 5, "height": 6,
            "captions": ["y", "z"], "num_objects": 2},
           {"id": 3, "image_path": "data/val/c.jpg", "file_name": "c.jpg", "width": 5, "height": 6,
            "captions": [], "num_objects": 0}]
    p = tmp_path / "ann.json"
    p.write_text(json.dumps(ann))
    got = R.read_annotations_json(spark, str(p), "train", "data", max_rows=1).collect()
    assert [r["id"] for r in got] == [1]
    coco = {"images": [{"id": 1, "file_name": "a.jpg", "width": 1, "height": 1, "coco_url": "u"},
                       {"id": 2, "file_name": "b.jpg", "width": 1, "height": 1, "coco_url": "u"}],
            "annotations": [{"image_id": 1, "category_id": 7}, {"image_id": 1, "category_id": 7},
                            {"image_id": 1, "category_id": 8}],
            "categories": [{"id": 7, "name": "cat"}, {"id": 8, "name": "bed"}]}
    c = tmp_path / "instances.json"
    c.write_text(json.dumps(coco))
    images, anns, cats = R.read_coco_instances(spark, str(c))
    s = {r["id"]: (r["categories"], r["num_objects"]) for r in G.summarize_annotations(images, anns, cats).collect()}
    assert s == {1: (["bed", "cat"], 3), 2: ([], 0)}
    out = tmp_path / "ann_out"
    K.write_annotations_json(images, str(out))
    assert spark.read.json(str(out)).count() == 2


def test_logs_levels_and_performance(spark, tmp_path):
    lines = [
        {"timestamp": "2024-01-01T00:00:00", "level": "INFO", "logger": "performance", "message": "m",
         "module": "x", "function": "f", "line": 1, "operation": "search", "duration_ms": 12.5,
         "performance_metric": True, "component": "db", "custom": "kept"},
        {"timestamp": "2024-01-01T00:00:01", "level": "ERROR", "logger": "app", "message": "boom",
         "module": "x", "function": "f", "line": 2,
         "exception": {"type": "ValueError", "message": "bad", "traceback": ["t1", "t2"]}},
        {"timestamp": "2024-01-01T00:00:02", "level": "INFO", "logger": "performance", "message": "m",
         "module": "x", "function": "f", "line": 3, "operation": "search", "duration_ms": 7.5,
         "performance_metric": True, "component": "db"},
    ]
    p = tmp_path / "app.log"
    p.write_text("\n".join(json.dumps(x) for x in lines))
    logs = R.read_structured_logs(spark, str(p))
    from ragloom.operators.predicates import log_level_filter
    assert [r["message"] for r in log_level_filter(logs, "ERROR").collect()] == ["boom"]
    assert logs.filter("line = 1").first()["extras"] == {"custom": "kept"}
    perf = G.log_performance_stats(logs).first()
    assert perf["n"] == 2 and perf["avg_duration_ms"] == 10.0


def test_vector_bundle_and_photo_search(spark, tmp_path):
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0]), (2, [0.5, 0.5])], "pos long, embedding array<double>")
    meta = spark.createDataFrame([(0, "a"), (2, "c"), (3, "d")], "pos long, name string")
    K.write_table(vecs, str(tmp_path / "v"), mode="overwrite")
    K.write_table(meta, str(tmp_path / "m"), mode="overwrite")
    v, m = R.load_vector_bundle(spark, str(tmp_path / "v"), str(tmp_path / "m"))
    assert J.count_by_position(v, m, dim=2).first()["migrated"] == 2
    resp = spark.createDataFrame([
        (0, "nature", [("forest", [("Tall trees", ["a", "b", "c", "d", "e", "f"]), (None, None)]), ("lake", [])]),
        (1, "city", [("street", [("Night", ["x"])])])], R.PHOTO_SEARCH_SCHEMA)
    rows = {r["image_filename"]: r for r in R.flatten_photo_search(resp).collect()}
    assert set(rows) == {"image_001.jpg", "image_002.jpg", "image_003.jpg"}
    assert rows["image_001.jpg"]["tags"] == "a,b,c,d,e" and rows["image_002.jpg"]["description"] == "forest"
    assert rows["image_003.jpg"]["style"] == "city"
    K.write_metadata_csv(R.flatten_photo_search(resp), str(tmp_path / "csv"))
    assert R.read_metadata_csv(spark, str(tmp_path / "csv")).count() == 3


def test_reports_exports_and_snapshots(spark, tmp_path):
    g = A.generations(spark, SF_SMOKE)
    rep = reports.analytics_report(A.images(spark, SF_SMOKE), A.embeddings(spark, SF_SMOKE), g,
                                   A.cache_entries(spark, SF_SMOKE), as_of=g.select(F.max("created_at")).scalar())
    K.write_report(rep, str(tmp_path / "rep_json"), "json")
    K.write_report(rep, str(tmp_path / "rep_txt"), "text")
    sections = {r["section"] for r in spark.read.json(str(tmp_path / "rep_json")).collect()}
    assert sections == {"basic_stats", "success_rate", "generation_trends", "trends_summary", "top_models"}
    assert len(spark.read.text(str(tmp_path / "rep_txt")).collect()) == rep.count()
    from ragloom.functions import registry as RG
    samples = A.metric_samples(spark, SF_SMOKE)
    reg = RG.effective_registry(RG.default_registry(spark), samples)
    K.export_prometheus(reg, G.latest_metric_values(samples), str(tmp_path / "prom"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "prom")).collect()]
    assert len(text) == 15 and text[0].startswith("# HELP ") and text[1].startswith("# TYPE ")
    t1 = dt.datetime(2024, 1, 1)
    t2 = dt.datetime(2024, 3, 1)
    K.snapshot_tables(spark, {"cache": A.cache_entries(spark, SF_SMOKE)}, str(tmp_path / "bk"), taken_at=t1)
    K.snapshot_tables(spark, {"cache": A.cache_entries(spark, SF_SMOKE).limit(3)}, str(tmp_path / "bk"), taken_at=t2)
    snaps = K.list_snapshots(spark, str(tmp_path / "bk")).collect()
    assert [s["taken_at"] for s in snaps] == [t2, t1]
    assert K.restore_snapshot(spark, str(tmp_path / "bk"), "cache").count() == 3
    assert K.retain_snapshots(spark, str(tmp_path / "bk"), 30, as_of=t2).count() == 1


def test_monitor_report(spark):
    from ragloom.operators import predicates as P
    from ragloom.plans.q_aggregates import STATUS_COLS
    c = P.classify_thresholds(A.system_metrics(spark, SF_SMOKE))
    long = G.checks_long(c, STATUS_COLS, ["component"])
    rep = reports.monitor_report(A.operations(spark, SF_SMOKE), long, A.cache_entries(spark, SF_SMOKE))
    assert {r["section"] for r in rep.collect()} == {"performance", "health", "cache"}


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    a = spark.range(0, 2000).select(F.col("id").alias("image_id"), (F.col("id") * 2).alias("x"))
    b = spark.range(0, 2000).select(F.col("id").alias("image_id"), (F.col("id") * 3).alias("y"))
    K.write_bucketed_table(a, "t_bucket_a", str(tmp_path / "a"), 4, ["image_id"])
    K.write_bucketed_table(b, "t_bucket_b", str(tmp_path / "b"), 4, ["image_id"])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("t_bucket_a").join(spark.table("t_bucket_b"), "image_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and j.count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_size_for_input(spark):
    from ragloom.session import size_for_input
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        assert size_for_input(spark, 100 * (1 << 40)) == 409_600
        assert size_for_input(spark, 1 << 20) == spark.sparkContext.defaultParallelism * 3
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_jdbc_reader_options_without_a_database():
    """S4 builds a partitioned JDBC scan; checked with a recording reader (no database here)."""

    class Rec:
        def __init__(self):
            self.opts, self.fmt = {}, None

        def format(self, f):
            self.fmt = f
            return self

        def option(self, k, v):
            self.opts[k] = v
            return self

        def load(self):
            return self

    class FakeSpark:
        def __init__(self):
            self.read = Rec()

    s = FakeSpark()
    R.read_jdbc_table(s, "jdbc:postgresql://db/x", "images", "id", 0, 1000, 16, {"user": "u"})
    assert s.read.fmt == "jdbc"
    assert s.read.opts == {"url": "jdbc:postgresql://db/x", "dbtable": "images", "user": "u",
                           "partitionColumn": "id", "lowerBound": 0, "upperBound": 1000, "numPartitions": 16}


def test_deleted_snapshots_are_gone_and_no_longer_listed(spark, tmp_path):
    base = str(tmp_path / "bk")
    df = spark.range(5).toDF("id")
    for day in (1, 20, 40):
        K.snapshot_tables(spark, {"a": df, "b": df}, base, taken_at=dt.datetime(2024, 1, 1) + dt.timedelta(days=day))
    as_of = dt.datetime(2024, 2, 10)
    assert sorted(r["name"] for r in K.delete_snapshots(spark, base, 30, as_of).collect()) == ["a", "b"]
    assert K.delete_snapshots(spark, base, 30, as_of).count() == 0
    listed = K.list_snapshots(spark, base).collect()
    assert len(listed) == 4 and all(spark.read.parquet(r["path"]).count() == 5 for r in listed)
    assert not (tmp_path / "bk" / "20240102_000000" / "a").exists()
    assert K.restore_snapshot(spark, base, "a").count() == 5


def test_large_json_tables_come_as_several_documents(spark, tmp_path, monkeypatch):
    """No task sorts or writes a whole table: each document goes to a task, and the readers see them all."""
    import os

    from ragloom.plans import q_io

    monkeypatch.setattr(q_io, "FILE_BYTES", 1)
    monkeypatch.setattr(q_io, "ceil", lambda x: 3)
    rows = spark.createDataFrame([(i, f"x{{{i}\n") for i in range(40)], "id long, name string")
    lines = q_io._values(rows, F.struct("id", "name"), 0).unionByName(q_io._values(rows, F.struct(F.col("id").alias("image_id")), 1))
    path = q_io._documents(spark, "t-several", [rows], lines, ['{"categories": [', '], "annotations": ['], "]}")
    assert len([f for d in os.listdir(path) if d.startswith("file=") for f in os.listdir(f"{path}/{d}") if f.startswith("part-")]) == 3
    _, ann, cats = R.read_coco_instances(spark, path)
    assert sorted((r["id"], r["name"]) for r in cats.collect()) == [(i, f"x{{{i}\n") for i in range(40)]
    assert sorted(r["image_id"] for r in ann.collect()) == list(range(40))
