"""Scalar functions on hand-written rows."""

import re

import pytest
from pyspark.sql import functions as F

from ragloom.functions import prompt as PR
from ragloom.functions import text as T


# raw text, as normalised text, as a safe file name
EDGE = [
    ("  a\tb\x01c\x00d  ", "a b cd", "a_b_cd"),
    ("\x7f\x85x", "x", "x"),
    ("   ", "", "unnamed"),
    ("plain", "plain", "plain"),
    ("line\n\nbreak", "line break", "line_break"),
    ("../../a b.png", "../../a b.png", "a_b.png"),
    ("...", "...", "unnamed"),
    ("", "", "unnamed"),
    ("x" * 300 + ".jpg", "x" * 300 + ".jpg", "x" * 255),
    ("dir/sub/k\u00e9 y__.PNG", "dir/sub/k\u00e9 y__.PNG", "k_y_.PNG"),
    ("._ weird _.", "._ weird _.", "weird"),
]


def test_text_length_guard(spark):
    df = spark.createDataFrame([("a  b",), ("x" * 12,)], "s string")
    assert [r[0] for r in df.select(T.text_too_long("s", 10)).collect()] == [False, True]


def test_normalize_and_sanitize(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _, _) in enumerate(EDGE)], "i int, s string")
    got = df.select("i", T.normalize_text("s").alias("n"), T.sanitize_filename("s").alias("f")).orderBy("i").collect()
    assert [(r["n"], r["f"]) for r in got] == [(n, f) for _, n, f in EDGE]


def test_upload_tags_and_extensions(spark):
    df = spark.createDataFrame([("a, b ,,c d,../x", "image/PNG; q=1", "photo.JPEG"),
                                (None, None, "noext"), ("x", "text/plain", ".hidden")], "t string, ct string, o string")
    r = df.select(F.array_join(T.split_upload_tags("t"), "|").alias("tags"),
                  T.storage_name("ct", "o", key=F.lit("k")).alias("n"), T.file_extension("o").alias("e")).collect()
    assert r[0]["tags"] == "a|b|c_d|x" and r[0]["n"].endswith(".png") and r[0]["e"] == ".jpeg"
    assert r[1]["tags"] == "" and r[1]["n"].endswith(".bin") and r[1]["e"] == ""
    assert r[2]["n"].endswith(".bin") and r[2]["e"] == ""
    assert re.fullmatch(r"upload_[0-9a-f]{32}\.png", r[0]["n"])


CASES = [
    ("a cat", [], "a cat"),
    ("a cat", [{"description": "A cat in the kitchen, indoor", "tags": ["cat", "chair"]}],
     "a cat, in indoor, kitchen setting, with chair"),
    ("cat chair", [{"description": "x", "tags": ["Cat", "chair"]}], "cat chair, in realistic style"),
    ("dog", [{"description": "outdoor park street garden", "tags": None},
             {"description": None, "tags": ["a", "b", "c", "d"]}], "dog, in outdoor, park setting, with a, b, c"),
    ("car", [{"description": "A parking lot", "tags": []}], "car, in park setting"),
    ("tree", [{"description": "", "tags": ["tree"]}], "tree, in realistic style"),
]


@pytest.mark.parametrize("query,examples,expected", CASES)
def test_augment_prompt(spark, query, examples, expected):
    df = spark.createDataFrame([(query, examples)], "q string, ex array<struct<description:string,tags:array<string>>>")
    assert df.select(PR.augment_prompt("q", "ex").alias("p")).first()["p"] == expected


def test_metadata_texts_and_labels(spark):
    df = spark.createDataFrame([("desc", ["t1", "t2"], 10, 20, {"b": "2", "a": "1"}),
                                (None, None, 0, 5, {})],
                               "d string, tags array<string>, w int, h int, m map<string,string>")
    r = df.select(T.metadata_text_db("d", "tags", "w", "h").alias("db"),
                  T.metadata_text_csv("d", F.lit("x,y"), F.lit(None), F.lit("cat")).alias("csv"),
                  T.metadata_text_coco("tags", "w", "h").alias("coco"),
                  T.prometheus_labels("m").alias("lab")).collect()
    assert r[0]["db"] == "desc | t1 | t2 | Size: 10x20" and r[1]["db"] == "No description available"
    assert r[0]["csv"] == "Description: desc | Tags: x,y | Category: cat"
    assert r[0]["coco"] == "Objects: t1, t2 | Size: 10x20" and r[1]["coco"] == ""
    assert r[0]["lab"] == '{a="1",b="2"}' and r[1]["lab"] == ""


def test_client_id_and_output_name(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "h"), (None, "h"), ("", None)], "ff string, host string")
    assert [r[0] for r in df.select(T.client_id("ff", "host")).collect()] == ["1.2.3.4", "h", "unknown"]
    n = spark.range(1).select(T.output_name(F.lit("img"), F.lit("run"), F.lit(0), F.lit(".PNG")).alias("n")).first()
    assert n["n"] == "img_run_01.png"


def test_path_safety_forms(spark):
    paths = ["a/b.png", "a/../b.png", "../x", "a/../../x", "/etc/passwd", "/data/img/a.png", "a..b", "a\x00b", "./a"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    from ragloom.operators import predicates as P
    got = {r["p"]: (r["i"], r["j"], r["jb"]) for r in df.select(
        "p", P.index_path_ok("p").alias("i"), P.join_stays_under_base("p").alias("j"),
        P.join_stays_under_base("p", "/data/img").alias("jb")).collect()}
    assert got["a/b.png"] == (True, True, True)
    assert got["a/../b.png"] == (False, True, True)
    assert got["../x"][1] is False and got["a/../../x"][1] is False
    assert got["/etc/passwd"][1:] == (False, False) and got["/data/img/a.png"][1:] == (False, True)
    assert got["a..b"] == (False, True, True) and got["a\x00b"][0] is False and got["a\x00b"][1] is True
    assert got["./a"] == (True, True, True)


def test_output_name_extension_rules(spark):
    df = spark.createDataFrame([("..JPG",), ("",), (None,)], "e string")
    got = [r[0] for r in df.select(T.output_name(F.lit("p"), F.lit("r"), F.lit(1), F.col("e"))).collect()]
    assert got == ["p_r_02.jpg", "p_r_02.png", "p_r_02.png"]


def test_vectors_of_a_batch_are_made_in_parts(spark, monkeypatch):
    """The tokens of an Arrow batch are not all held as numbers at once; the vectors are the same."""
    from ragloom.functions import encoders as N

    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 9))) for i in range(50)] + [(99, None)], "id long, text string").coalesce(1)
    want = N.HashingEncoder(dim=16).transform(docs, "text").collect()
    monkeypatch.setattr(N, "BATCH_TOKENS", 5)
    got = N.HashingEncoder(dim=16).transform(docs, "text").collect()
    assert sorted((r["id"], r["embedding"]) for r in got) == sorted((r["id"], r["embedding"]) for r in want)
    monkeypatch.setattr(N, "COUNT_BYTES", 64)
    counts = N.HashingEncoder(dim=16).signed_counts(docs, "text", "id")
    assert counts.agg(F.sum(F.abs("count"))).first()[0] <= sum(i % 9 for i in range(50))
