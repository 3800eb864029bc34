"""The command line runs the composed jobs on parquet tables."""

import json
import os
import subprocess
import sys

from ragloom import adapters as A
from ragloom.__main__ import main
from tests.conftest import SF_SMOKE


def test_cli_search_rag_report(spark, tmp_path, capsys):
    vec, img, gen = str(tmp_path / "vec"), str(tmp_path / "img"), str(tmp_path / "gen")
    A.embeddings(spark, SF_SMOKE).write.parquet(vec)
    A.images(spark, SF_SMOKE).write.parquet(img)
    A.generations(spark, SF_SMOKE).write.parquet(gen)
    main(["search", "--vectors", vec, "--images", img, "--query-id", "3", "--k", "3"])
    lines = capsys.readouterr().out.strip().splitlines()
    assert lines[0].startswith("3 ") and lines[0].endswith(" 1.0")
    q = str(tmp_path / "q")
    spark.read.parquet(vec).selectExpr("id AS qid", "'a cat on a chair' AS query", "embedding AS query_vector") \
        .limit(4).write.parquet(q)
    main(["rag", "--queries", q, "--vectors", vec, "--images", img, "--out", str(tmp_path / "rag")])
    assert spark.read.parquet(str(tmp_path / "rag")).count() == 4
    main(["report", "--generations", gen, "--embeddings", vec, "--images", img, "--out", str(tmp_path / "rep")])
    rows = [json.loads(x) for p in (tmp_path / "rep").glob("part-*") for x in p.read_text().splitlines()]
    assert {r["section"] for r in rows} >= {"basic_stats", "generation_trends", "top_models"}


def test_cli_ingest(spark, tmp_path, capsys):
    img = tmp_path / "images"
    img.mkdir()
    for n in ("a.jpg", "b.jpg"):
        (img / n).write_bytes(b"x")
    csv = tmp_path / "metadata.csv"
    csv.write_text("image_filename,description,tags,style,category\na.jpg,A cat,\"cat,chair\",photo,pets\n"
                   "b.jpg,A dog,dog,photo,pets\nc.jpg,gone,x,y,z\n")
    main(["ingest", "--metadata", str(csv), "--images", str(img), "--out", str(tmp_path / "out")])
    assert "ingest written" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "out" / "images")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "embeddings")).count() == 2


def test_a_session_in_another_folder_sends_the_package_to_its_workers(tmp_path):
    """Neither installed nor on the workers' path: a query with Python in its tasks still runs."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
print("rows", E.queries()["v8_projection_values"](spark, {SF_SMOKE!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in out.stdout and int(out.stdout.split("rows ")[1].split()[0]) > 0, out.stderr[-2000:]
