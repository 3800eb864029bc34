"""Vector search edge cases: zero vector, wrong dimension, NaN, ties, self-match, both V5 plans."""

import contextlib
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators import ann, vectors as V


def _corpus(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def test_self_match_is_rank_one_384(spark):
    rng = np.random.default_rng(42)
    vecs = rng.uniform(-1, 1, (50, 384)).astype(np.float32)
    df = _corpus(spark, [(i, v.tolist()) for i, v in enumerate(vecs)])
    hits = V.cosine_topk(df, vecs[7].tolist(), k=3).collect()
    assert hits[0]["id"] == 7 and math.isclose(hits[0]["similarity_score"], 1.0, rel_tol=1e-6)


def test_zero_vector_scores_zero_and_is_flagged(spark):
    df = _corpus(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [float("nan"), 1.0])])
    s = {r["id"]: r["similarity_score"] for r in V.cosine_topk(df, [1.0, 0.0], k=10).collect()}
    assert s == {1: 0.0, 2: 1.0}  # another size or a NaN component is no hit
    z = {r["id"]: r["similarity_score"] for r in V.zero_safe_cosine_topk(df, [1.0, 0.0], k=10).collect()}
    assert z[1] == 0.0
    flags = {r["id"]: r["problems"] for r in V.check_vectors(df, 2).collect()}
    assert flags[1] == ["zero"] and flags[2] == [] and flags[3] == ["dimension"] and flags[4] == ["nan"]


def test_threshold_only_when_positive(spark):
    df = _corpus(spark, [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0])])
    assert len(V.cosine_topk(df, [1.0, 0.0], k=5, threshold=0.0).collect()) == 3
    assert [r["id"] for r in V.cosine_topk(df, [1.0, 0.0], k=5, threshold=0.5).collect()] == [1]


def test_ties_break_by_id(spark):
    df = _corpus(spark, [(5, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [1.0, 0.0]), (1, [0.0, 1.0])])
    assert [r["id"] for r in V.cosine_topk(df, [1.0, 0.0], k=2).collect()] == [2, 5]
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, query_vector array<double>")
    for kw in ({}, {"max_broadcast_bytes": 0, "block_rows": 1}):
        got = V.batch_topk(q, df, k=2, **kw).orderBy("rank").collect()
        assert [r["id"] for r in got] == [2, 5]


def test_l2_topk_squared_distance_and_similarity(spark):
    df = _corpus(spark, [(1, [0.0, 0.0]), (2, [3.0, 4.0])])
    r = V.l2_topk(df, [0.0, 0.0], k=2).collect()
    assert [x["id"] for x in r] == [1, 2]
    assert r[1]["distance"] == 25.0 and math.isclose(r[1]["similarity_score"], 1 / 26)


def test_batch_plans_agree_with_single_query(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(120, 16))
    df = _corpus(spark, [(i, v.tolist()) for i, v in enumerate(vecs)])
    q = df.select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    for metric in ("cosine", "dot", "l2"):
        a = {(r["qid"], r["id"]) for r in V.batch_topk(q, df, k=4, metric=metric).collect()}
        b = {(r["qid"], r["id"]) for r in V.batch_topk(q, df, k=4, metric=metric, max_broadcast_bytes=0,
                                                        block_rows=25).collect()}
        assert a == b and len(a) == 120 * 4
    single = [r["id"] for r in V.cosine_topk(df, vecs[3].tolist(), k=4).collect()]
    batch = [r["id"] for r in V.batch_topk(q.filter("qid = 3"), df, k=4).orderBy("rank").collect()]
    assert single == batch


def test_retrieve_threshold(spark):
    df = _corpus(spark, [(1, [0.0]), (2, [1.0]), (3, [10.0])])
    q = spark.createDataFrame([(0, [0.0])], "qid long, query_vector array<double>")
    got = {r["id"] for r in V.retrieve(q, df, n=3, threshold=0.1).collect()}
    assert got == {1, 2}  # 1/(1+100) < 0.1


def test_projection_is_seeded(spark):
    df = _corpus(spark, [(1, [1.0, 2.0, 3.0, 4.0]), (2, [0.0, 1.0, 0.0, 1.0])])
    a = V.project_vectors(df, 2, 4, seed=7).orderBy("id").collect()
    b = V.project_vectors(df, 2, 4, seed=7).orderBy("id").collect()
    m = V.projection_matrix(4, 2, 7)
    assert np.allclose(a[0]["projected"], np.array([1.0, 2.0, 3.0, 4.0]) @ m)
    assert [r["projected"] for r in a] == [r["projected"] for r in b]


def test_ivf_recall_against_exact(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(8, 16)) * 5
    vecs = np.vstack([c + rng.normal(size=(40, 16)) for c in centers])
    df = _corpus(spark, [(i, v.tolist()) for i, v in enumerate(vecs)])
    q = df.select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector")).filter("qid % 10 = 0")
    index, cents = ann.ivf_build(df, lists=8, max_iter=10, materialize=True)
    approx = ann.ivf_search(q, index, cents, k=5, nprobe=3, block_rows=10)
    exact = V.batch_topk(q, df, k=5)
    assert ann.recall_at_k(approx, exact).first()["recall"] >= 0.9


def test_batch_topk_skips_bad_query_vectors(spark):
    df = _corpus(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0]), (2, None)], "qid long, query_vector array<double>")
    for kw in ({}, {"max_broadcast_bytes": 0, "block_rows": 1}):
        got = sorted((r["qid"], r["id"]) for r in V.batch_topk(q, df, k=1, **kw).collect())
        assert got == [(0, 1)]


def test_ivf_stored_index_prunes_lists(spark, tmp_path):
    import contextlib
    import io

    rng = np.random.default_rng(8)
    centers = rng.normal(size=(6, 8)) * 6
    vecs = np.vstack([c + rng.normal(size=(30, 8)) for c in centers])
    df = _corpus(spark, [(i, v.tolist()) for i, v in enumerate(vecs)])
    index, cents = ann.ivf_build(df, lists=6, max_iter=10)
    path = str(tmp_path / "ivf")
    ann.ivf_write(index, path)
    hits = ann.ivf_search_one(spark, vecs[17].tolist(), path, cents, k=3, nprobe=2)
    got = [r["id"] for r in hits.collect()]
    exact = [r["id"] for r in V.cosine_topk(df, vecs[17].tolist(), k=3).collect()]
    assert got[0] == 17 and len(set(got) & set(exact)) >= 2
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        hits.explain("formatted")
    assert "PartitionFilters: [isnotnull(list_id" in buf.getvalue() or "PartitionFilters: [list_id" in buf.getvalue()


def test_chunked_scoring_equals_one_block(monkeypatch):
    rng = np.random.default_rng(1)
    c = rng.integers(-2, 3, (50, 4)).astype(float)
    q = rng.integers(-2, 3, (7, 4)).astype(float)
    monkeypatch.setattr(V, "SCORE_MATRIX_BYTES", 8 * 7 * 3)  # three corpus rows per chunk
    qi, ci, _ = V._score_chunked(c, np.arange(50), q, "dot", 5, None, None)
    for j in range(7):
        s = c @ q[j]
        assert [int(x) for x in ci[qi == j]] == sorted(range(50), key=lambda i: (-s[i], i))[:5]


def test_prepared_corpus_gives_same_hits(spark):
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(80, 12))
    df = _corpus(spark, [(i, v.tolist()) for i, v in enumerate(vecs)] + [(999, [0.0] * 12)])
    prepared = V.prepare_corpus(df)
    for qi in (0, 5, 9):
        a = [(r["id"], round(r["similarity_score"], 9)) for r in V.cosine_topk(df, vecs[qi].tolist(), k=6).collect()]
        b = [(r["id"], round(r["similarity_score"], 9)) for r in
             V.cosine_topk(prepared, vecs[qi].tolist(), k=6, corpus_is_unit=True).collect()]
        assert a == b
    prepared.unpersist()


def test_hit_without_an_image_is_dropped_after_topk(spark):
    from ragloom.operators import joins as J

    hits = spark.createDataFrame([(1, 0.95), (99, 0.9)], "image_id long, similarity_score double")
    images = spark.createDataFrame([(1, "a/1.jpg")], "id long, image_path string")
    got = J.enrich_hits(hits, images, hits_bounded=True).collect()
    assert [(r["image_id"], r["image_path"]) for r in got] == [(1, "a/1.jpg")]


def test_mixed_sizes_and_bad_components_lose_no_query(spark):
    nan, inf = float("nan"), float("inf")
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [nan, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [0.0, 1.0]),
                                    (6, None), (7, [inf, 1.0])], "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [nan, 0.0]), (4, None)], "qid long, query_vector array<double>")
    for kw in ({}, {"max_broadcast_bytes": 0, "block_rows": 2}):
        got = sorted((r["qid"], r["rank"], r["id"]) for r in V.batch_topk(queries, corpus, k=3, **kw).collect())
        assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 5), (2, 1, 4)]
    assert [r["id"] for r in V.cosine_topk(corpus.where("id <> 7"), [1.0, 0.0], k=5).collect()] == [1, 2, 5]
    assert [r["id"] for r in V.cosine_topk(corpus.where("id <> 7"), [1.0, 0.0], k=5, method="arrow").collect()] == [1, 2, 5]
    assert [r["id"] for r in V.l2_topk(corpus, [1.0, 0.0], k=3).collect()] == [1, 2, 5]


def _clusters(n, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim))
    return centres[rng.integers(0, 10, n)] + 0.3 * rng.normal(size=(n, dim))


def test_stored_index_answers_a_batch(spark, tmp_path):
    """One index written once: recall, exact answers when all lists are probed, hot lists and crowds of queries
    in parts, odd vectors in none."""
    vecs = _clusters(600)
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    odd = [(1000, None), (1001, [float("nan")] * 16), (1002, [1.0, 2.0]), (1003, [])]
    df = spark.createDataFrame(rows + odd, "id long, embedding array<double>").repartition(3)
    path = str(tmp_path / "ivf")
    ann.ivf_store(df, path, lists=12, max_iter=10, list_rows=20)
    lists = spark.read.parquet(f"{path}/lists")
    assert lists.agg(F.sum("n"), F.max("parts")).first()[0] == 600 and lists.agg(F.max("parts")).first()[0] > 1
    q = df.select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    exact = V.batch_topk(q, df.filter("size(embedding) = 16"), k=5, metric="cosine").filter("qid < 1000")
    some = ann.ivf_probe(q, path, k=5, nprobe=4, query_rows=50)
    recall = ann.recall_rows(some, exact).agg(F.sum("found"), F.sum("wanted"), F.count("*")).first()
    assert recall[0] >= 0.9 * recall[1] and recall[2] == 600
    every = ann.ivf_probe(q, path, k=5, nprobe=12, query_rows=50)
    key = lambda d: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in d.collect())
    assert key(every) == key(exact)
    first = {r["qid"]: r["id"] for r in ann.ivf_probe(q, path, k=1, nprobe=1).collect()}
    assert first == {i: i for i in range(600)}
    assert ann.ivf_probe(q.limit(0), path).count() == 0


def test_batch_probe_prunes_the_lists_by_a_join(spark, tmp_path):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(_clusters(300))], "id long, embedding array<double>")
    path = str(tmp_path / "ivf")
    ann.ivf_store(df, path, lists=10, max_iter=5)
    q = df.filter("id = 7").select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    hits = ann.ivf_probe(q, path, k=3, nprobe=2)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        hits.explain("formatted")
    assert "dynamicpruning" in buf.getvalue() and hits.first()["id"] == 7


def test_centroids_beyond_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(ann, "MAX_CENTROID_BYTES", 100)
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "id long, embedding array<double>")
    with pytest.raises(ValueError):
        ann.ivf_train(df, lists=8)


def test_blocks_of_a_batch_search_stay_few():
    """A row is sent to every block of the other side: their number is bounded while the blocks fit memory."""
    assert V.block_count(500, 500 * 64, 200) == 3
    assert V.block_count(600_000, 600_000 * 64, 200) == V.SIDE_BLOCKS
    assert V.block_count(6_000_000, 6_000_000 * 64, 200) * V.BLOCK_BYTES >= 6_000_000 * 64 * 8


def test_equal_vectors_score_alike_wherever_they_stand():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1, 37))
    c = np.vstack([v, rng.normal(size=(700, 37)), v, v])
    for metric in ("cosine", "dot", "l2"):
        top = V.TopK(v, metric, 3)
        top.add(c, np.arange(len(c))[::-1].copy())
        _, ids, scores = top.found()
        if metric != "dot":
            assert ids.tolist() == [0, 1, 702] and len(set(scores.tolist())) == 1


def test_probes_leave_a_worker_one_row_a_query(spark, tmp_path):
    """A query is not repeated for each of its lists, and meets a shard of lists once."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(_clusters(200))], "id long, embedding array<double>")
    path = str(tmp_path / "ivf")
    ann.ivf_store(df, path, lists=10, max_iter=5)
    q = df.select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    cents = ann._centroid_matrix(spark.read.parquet(f"{path}/centroids"))
    near = ann._nearest_lists(q, "query_vector", cents, 6, as_array=True)
    assert near.count() == 200 and near.select(F.size("lists")).distinct().collect()[0][0] == 6
    rows = ann._nearest_lists(q, "query_vector", cents, 6)
    assert {(r["qid"], r["list_id"]) for r in rows.collect()} == {(r["qid"], x) for r in near.collect() for x in r["lists"]}
