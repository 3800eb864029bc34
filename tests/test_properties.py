"""Properties that hold for many generated strings in one DataFrame, plus the request rules, cache keys and the encoder plug-in."""

import random
import re

import numpy as np

from ragloom.functions import encoders as EN
from ragloom.functions import text as T
from ragloom.operators import predicates as P

ALPHABET = list("abcXYZ019 ._-/\t\n\r") + ["\x00", "\x01", "\x1f", "\x7f", "\x85", "\x9f", "é", "ß", "日", " "]


def test_random_strings_come_out_normal_and_safe(spark):
    rnd = random.Random(42)
    strings = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(strings)), "i int, s string")
    df = df.select("s", T.normalize_text("s").alias("n"), T.sanitize_filename("s").alias("f"))
    for r in df.select("s", "n", T.normalize_text("n").alias("nn"), "f", T.sanitize_filename("f").alias("ff")).collect():
        assert r["n"] == r["nn"] and r["n"] == r["n"].strip() and "  " not in r["n"], repr(r["s"])
        assert not any(ord(c) < 32 or 127 <= ord(c) < 160 for c in r["n"]), repr(r["s"])
        assert r["f"] == r["ff"] and 0 < len(r["f"]) <= 255 and "__" not in r["f"], repr(r["s"])
        assert re.fullmatch(r"[A-Za-z0-9._-]+", r["f"]) and r["f"][0] not in "._" and r["f"][-1] not in "._", repr(r["s"])


def test_search_and_upload_rules(spark):
    req = spark.createDataFrame([("a cat", 5, 0.5), ("   ", 0, 1.5), ("x" * 501, 51, None)],
                                "query string, k int, threshold double")
    v = [r["violations"] for r in P.validate_requests(req, P.SEARCH_RULES).collect()]
    assert v == [[], ["query_empty_after_sanitize", "k_range", "threshold_range"], ["query_length", "k_range"]]
    up = spark.createDataFrame([("image/png", 100), ("text/plain", 100), ("image/jpeg", 11 * 1024 * 1024)],
                               "content_type string, size_bytes long")
    ok, bad = P.split_accepted(up, P.UPLOAD_RULES)
    assert ok.count() == 1 and sorted(r["violations"][0] for r in bad.collect()) == ["content_type_image", "size_limit"]


def test_cache_key_sorts_params(spark):
    df = spark.createDataFrame([("t", "m", {"b": "2", "a": "1"}), ("t", "m", {"a": "1", "b": "2"})],
                               "t string, m string, p map<string,string>")
    keys = [r[0] for r in df.select(T.cache_key("t", "m", "p")).collect()]
    assert keys[0] == keys[1] and len(keys[0]) == 32


class _ToyModel:
    def encode(self, texts):
        return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)


def test_model_encoder_plugin(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import test modules
    enc = EN.PandasModelEncoder(lambda: _ToyModel(), dim=2, name="toy")
    df = spark.createDataFrame([(1, "banana"), (2, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in EN.embed_text(df, "text", enc).collect()}
    assert got == {1: [6.0, 3.0], 2: [0.0, 0.0]}


def test_hashing_encoder_unit_norm_and_deterministic(spark):
    df = spark.createDataFrame([(1, "The cat sat on the mat."), (2, ""), (3, "the CAT sat on the mat")],
                               "id int, text string")
    rows = {r["id"]: np.array(r["embedding"]) for r in EN.embed_text(df, "text", EN.HashingEncoder(64)).collect()}
    assert abs(np.linalg.norm(rows[1]) - 1) < 1e-5 and not rows[2].any()
    assert np.allclose(rows[1], rows[3])


def test_random_prompts_keep_the_query_and_stay_short(spark):
    from ragloom.functions import prompt as PR

    rnd = random.Random(11)
    words = ["cat", "Dog", "park", "parking", "kitchen", "indoor", "street", "garden", "living room", "chair", "a"]
    cases = []
    for i in range(200):
        ex = [{"description": rnd.choice([None, "", " ".join(rnd.choices(words, k=4))]),
               "tags": rnd.choice([None, [], rnd.choices(words, k=3)])} for _ in range(rnd.randint(0, 4))]
        cases.append((i, " ".join(rnd.choices(words, k=2)), ex))
    df = spark.createDataFrame(cases, "i int, q string, ex array<struct<description:string,tags:array<string>>>")
    got = {r["i"]: r["p"] for r in df.select("i", PR.augment_prompt("q", "ex").alias("p")).collect()}
    for i, q, ex in cases:
        if not ex:
            assert got[i] == q
            continue
        assert got[i].startswith(q + ", ") and len(got[i].split(", ")) <= 6
        tags = {t for e in ex for t in e["tags"] or []}
        if ", with " in got[i]:
            used = got[i].split(", with ")[1].split(", ")
            assert set(used) <= tags and len(used) <= 3 and not any(t.lower() in q.lower() for t in used)


def test_hashing_vector_equals_normalised_counts(spark):
    enc = EN.HashingEncoder(32, hash_fn="md5")
    df = spark.createDataFrame([(1, "The cat, the CAT and a dog."), (2, "Élan über Straße 12"), (3, None)],
                               "id int, text string")
    counts = {}
    for r in enc.signed_counts(df, "text", "id").collect():
        counts.setdefault(r["id"], np.zeros(32))[r["bucket"]] = r["count"]
    vecs = {r["id"]: np.array(r["embedding"]) for r in enc.transform(df, "text").collect()}
    for i, c in counts.items():
        assert np.allclose(vecs[i], c / np.linalg.norm(c), atol=1e-6)
    assert 3 not in counts and not vecs[3].any()
