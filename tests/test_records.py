"""One file read by several tasks: records with line breaks, quotes and braces over the ranges' edges."""

import csv
import json
import random

import pytest

from ragloom.sources import readers as R
from ragloom.sources import records


@pytest.fixture
def small_ranges(spark):
    """Ranges of 2 kB: every record of some length lies over an edge."""
    names = {"spark.sql.files.maxPartitionBytes": "2048", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def _text(rnd, long=False):
    return "".join(rnd.choice(['a', 'b ', '"', "\n", ",", "{", "}", "[", "]", "\\", "é", "日", ": ", "\\n"]) for _ in range(rnd.randint(0, 6000 if long else 60)))


def test_csv_records_over_range_edges(spark, tmp_path, small_ranges):
    rnd = random.Random(1)
    for name, n in (("b.csv", 150), ("a.csv", 60)):
        with open(tmp_path / name, "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow([x.name for x in R.METADATA_CSV_SCHEMA.fields])
            for i in range(n):
                w.writerow([f"{name}-{i}", _text(rnd, i % 40 == 3), "t,u", "s", _text(rnd)])
            if name == "a.csv":
                f.write("\n")  # an empty line is no record
    want = []
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, newline="") as f:
            want += [[v or None for v in r] for r in csv.reader(f) if r][1:]
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 8
    got = R.read_metadata_csv(spark, str(tmp_path)).orderBy("row_pos").collect()
    assert [[v or None for v in r[:5]] for r in got] == want
    head = R.read_metadata_csv(spark, str(tmp_path), max_rows=70).orderBy("row_pos").collect()
    assert [r[0] for r in head] == [r[0] for r in want[:70]]


def test_csv_with_carriage_returns(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(b'image_filename,description,tags,style,category\r\nx.jpg,"two\r\nlines",a,b,c\r\ny.jpg,,,,\r\n')
    got = [tuple(r[:5]) for r in R.read_metadata_csv(spark, str(tmp_path / "m.csv")).orderBy("row_pos").collect()]
    assert got == [("x.jpg", "two\r\nlines", "a", "b", "c"), ("y.jpg", None, None, None, None)]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_over_range_edges(spark, tmp_path, small_ranges, indent):
    rnd = random.Random(2)
    rows = [{"id": i, "image_path": f"d/{'train' if i % 2 else 'val'}/{i}.jpg", "file_name": f"{i}.jpg", "width": 1, "height": 2,
             "captions": [_text(rnd, i % 50 == 7), _text(rnd)], "num_objects": 3, "extra": {"nested": [{"a": 1}, []]}} for i in range(200)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(indent)), encoding="utf-8")
    back = R.read_annotations_json(spark, str(path), split="train", image_dir="d")
    assert {r["id"]: (r["captions"], r["image_path"]) for r in back.collect()} == {r["id"]: (r["captions"], r["image_path"]) for r in rows if r["id"] % 2}
    elements = records.json_elements(spark, str(path), 1)
    assert elements.select("block").distinct().count() > 8
    assert [json.loads(r["text"]) for r in elements.orderBy("file", "block", "pos").collect()] == rows


def test_instances_over_range_edges(spark, tmp_path, small_ranges):
    rnd = random.Random(3)
    docs = []
    for k in range(2):
        doc = {"info": {"images": [{"id": -1}], "year": 1}, "licenses": [],
               "images": [{"id": 1000 * k + i, "file_name": _text(rnd), "width": i, "height": 2, "coco_url": "u", "x": [[1]]} for i in range(90)],
               "annotations": [{"image_id": i, "category_id": i % 7, "segmentation": [[1.5, 2], [3]], "bbox": [1, 2]} for i in range(300)],
               "categories": [{"id": i, "name": f"c {i} }}"} for i in range(7)]}
        docs.append(doc)
        (tmp_path / f"instances_{k}.json").write_text(json.dumps(doc))
    images, ann, cats = R.read_coco_instances(spark, str(tmp_path))
    assert {r["id"]: r["file_name"] for r in images.collect()} == {i["id"]: i["file_name"] for d in docs for i in d["images"]}
    assert ann.count() == 600 and sorted((r["id"], r["name"]) for r in cats.distinct().collect()) == [(i, f"c {i} }}") for i in range(7)]


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    assert R.read_annotations_json(spark, str(tmp_path / "a.json")).count() == 0
    (tmp_path / "m.csv").write_text("image_filename,description,tags,style,category\n")
    assert R.read_metadata_csv(spark, str(tmp_path / "m.csv")).count() == 0
