"""The training-data operators on small tables, against plain versions of what they compute."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragloom.llm import ann, bpe, jaccard, langid, packing, quality, repair, sharding, stats, textbytes, tokens, toxicity, warc
from ragloom.llm import queries as Q
from ragloom.session import scratch_path

VOCABULARY = tokens.public("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: null, empty, white, short, repeated and long texts, ties, and a repeated id
TEXTS = [None, "", " \n\t", "x", "a b c", "A  b\nc", "one two three four five six", "One two three  four five six", "é ñ 日本 🙂 x", "a b a b a b a b", "line\nline\nother\n line", "w" * 3000, " ".join(f"word{i}" for i in range(900)), "<|endoftext|> it's  12 #$%", "a  b\x85 c  d"]
DOCS = [(i, t, "src0" if i % 3 else None) for i, t in enumerate(TEXTS)] + [(3, "x", "src1"), (4, "another text", "src1"), (None, "no id", "src0"), (40, "one two three four five six", "src0")]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators also use."""
    rows = [(i, t, s, "clash", -1) for i, t, s in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids string, kept int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


# ------------------------------------------------------------------ shared helpers
def test_encoder_equals_the_library_on_odd_texts():
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab é'sé \n\t 1.!　日🙂\x1c\x85") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    encoder, plain = tokens.Encoder(VOCABULARY), tokenizer()
    for _ in range(2):  # the second time pieces come from those kept
        got = [f[i:j].tolist() for _, f, o in encoder.encode(pa.array(texts, pa.string())) for i, j in zip(o, o[1:], strict=False)]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_and_counts_equal_plain_versions():
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("ab #é\n\t ") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    got = stats.measure(pa.array(texts, pa.string()))
    for i, t in enumerate(t or "" for t in texts):
        words, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        n = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        marked = {k + d for k in range(len(words) - 2) if n[tuple(words[k : k + 3])] > 1 for d in range(3)}
        assert [int(got[c][i]) for c in stats.COUNTS] == [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)]


# ------------------------------------------------------------------ 1 sharding
def test_sharding_obeys_the_law_and_the_mixture(spark, docs, empty):
    rows = sharding.shards(docs, 4, bucket_rows=3).collect()
    assert len(rows) == len(DOCS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in DOCS)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shards(empty, 4).count() == 0
    big = spark.range(3000).selectExpr("id AS doc_id", "cast(id AS string) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 7)) AS source")
    mix = Counter((r.source, r.shard) for r in sharding.shards(big, 6, bucket_rows=100).collect())
    for source in {s for s, _ in mix}:
        each = [mix[source, k] for k in range(6)]
        assert max(each) - min(each) <= 2


# ------------------------------------------------------------------ 2 byte-level BPE
def test_chunks_stitch_to_the_whole(spark, docs, empty):
    import public_tokenizers

    file = tokens.public("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    codec = bpe.loaded(*file)
    rng = random.Random(7)
    for k in range(400):
        t = "x" * rng.choice([0, 60]) + "".join(rng.choice("ab é'sé \n\t 1.!") for _ in range(rng.randint(1, 90)))
        for chunk, overlap in ((7, 4), (16, 8)):
            starts = range(0, max(0, len(t) - 1 - overlap) + 1, chunk)
            pieces = (bpe.Piece(codec, t[s : s + chunk + overlap], s, overlap, s == 0, s + chunk + overlap >= len(t)) for s in starts)
            assert bpe.stitch(codec, pieces, overlap).tolist() == codec.encode(t).tolist()
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (50, 20)):
        rows, ids = bpe.encoded(docs, *file, chunk=chunk, overlap=overlap)
        rows, back = bpe.decoded(rows, *file, ids_col=ids)
        got = Counter((r.doc_id, bytes(r[ids]), bytes(r[back])) for r in rows.collect())
        assert got == Counter((i, codec.encode(t or "").astype("<u4").tobytes(), (t or "").encode()) for i, t, _ in DOCS)
        assert ids != "ids" and "ids" in rows.columns
    assert bpe.encoded(empty, *file)[0].count() == 0


# ------------------------------------------------------------------ 3 language ID
def test_codewords_differ_and_languages_are_told_apart(spark, empty):
    for n in (2, 3, 7, 12, 40):
        code = langid.codewords(n)
        assert len(np.unique(code, axis=0)) == n and (abs(code.sum(0)) < n).all()
    rng = random.Random(8)
    kinds = {"aa": "the and ing tion er", "bb": "über sch keit ung ver", "cc": "ñado ción que es la"}
    rows = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(30)), k) for i in range(90) for k in kinds]
    rows += [(900, None, "aa"), (901, "12 !", "bb"), (902, "", "cc"), (903, "日", None), (904, "the and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.learn(df, F.col("doc_id") % 4 != 2)
    out, names = langid.identified(df, model)
    got = {(r.doc_id, r.lang): r for r in out.collect()}
    assert names == ["lang_pred", "score_", "ambiguous"]
    assert all(r.lang_pred == k and 0 <= r.score_ <= 1 for (i, k), r in got.items() if i < 900)
    assert [got[i, k].lang_pred for i, k in ((900, "aa"), (901, "bb"), (902, "cc"))] == ["und"] * 3
    assert got[904, None].lang_pred == "aa" and got[903, None].lang_pred in kinds
    nothing = langid.learn(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.identified(df, nothing)[0].collect()} == {"und"}
    assert langid.identified(df.limit(0), model)[0].count() == 0


# ------------------------------------------------------------------ 4 toxicity
def test_ordinal_regression_catches_marked_texts(spark, empty):
    rng = random.Random(9)
    clean = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(40))
    rows = [(i, clean() + (" vilexx" * (1 + i % 9) if i % 4 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "VILEXXABLE thing vilexx"), (903, "alpha1 beta2")], "doc_id long, text string").withColumn("grade", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels)
    assert (np.diff(model.thresholds) > 0).all()
    out, names = toxicity.judged(df, model)
    got = {r.doc_id: r for r in out.collect()}
    assert names == ["severity", "grade_", "toxic"]
    assert all(got[i].toxic == (i % 4 == 0) for i in range(400))
    assert got[900].severity == got[901].severity == got[903].severity == 0 and got[902].toxic
    assert got[0].severity < got[8 * 4].severity
    assert toxicity.filtered(df, labels).columns == df.columns and toxicity.filtered(df, labels.limit(0)).count() == df.count()
    assert toxicity.judged(df.limit(0), model)[0].count() == 0


# ------------------------------------------------------------------ 5 Re-Pair
def test_shards_round_trip_and_access_at_random(spark, docs, empty):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 40, 4000):
        ids = rng.integers(0, 5, n).astype(np.uint32)
        ends = np.append(np.sort(rng.integers(0, n + 1, 6)), n)
        shard = repair.Shard(repair.shard_bytes(ids, ends, 10))
        flat, off = shard.decode(0, 7)
        assert (flat == ids).all() and (off[1:] == ends).all()
        for d, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            assert shard.ids(d, 2, 9).tolist() == ids[a:b][2:9].tolist()
    plain, folder = tokenizer(), scratch_path(spark, "ids")
    repair.write(docs, VOCABULARY, folder, end_id=2)
    rows = repair.read(spark, folder).orderBy("start").collect()
    want = sorted(((i is not None, i or 0, t is not None, t or "") for i, t, _ in DOCS))
    encoded = [np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for _, _, _, t in want]
    assert [bytes(r.ids) for r in rows] == encoded and [r.doc_id or 0 for r in rows] == [w[1] for w in want]
    assert [r.start for r in rows] == (np.cumsum([len(e) // 4 for e in encoded]) - [len(e) // 4 for e in encoded]).tolist()
    assert repair.read_document(spark, folder, 12, 5, 9) == plain.encode(TEXTS[12], add_special_tokens=False).ids[5:9]
    folder = scratch_path(spark, "ids")
    repair.write(empty, VOCABULARY, folder, end_id=2)
    assert repair.read(spark, folder).count() == 0


# ------------------------------------------------------------------ 6 quality rules
def test_decision_list_covers_bad_rows(spark, docs):
    rng = np.random.default_rng(2)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["c"] > 0.95)
    rules = quality.cover(x, bad, np.arange(3000) % 3 == 0)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= quality._matches(rule, x)
    assert 2 <= len(rules) <= 12 and (hit & bad).sum() > 0.95 * bad.sum() and (hit & ~bad).sum() < 0.02 * bad.sum()
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good.replace("word", "word|" if i % 5 == 0 else "word") + f" n{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(0))
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(300)], "doc_id long, quality int")
    out = quality.filtered(df, labels)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [i for i in range(300) if i % 5]
    judged, names = quality.judged(docs, [])
    assert {r.doc_id for r in judged.where(F.col(names["kept"])).collect()} == {12}
    assert quality.learn(df, labels.limit(0)) == [] and quality.judged(df.limit(0), [])[0].count() == 0


# ------------------------------------------------------------------ 7 packing
def test_packing_concatenates_and_cuts(docs, empty):
    plain, length = tokenizer(), 64
    rows = packing.pack(docs, VOCABULARY, 1, length).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert 0 < r.length <= length and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, pieces in sequences.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == length or k == max(sequences)
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        key = r.doc_id
        if r.start == 0:
            whole[key].append(b"")
        whole[key][-1] += bytes(r.ids)
    want = defaultdict(list)
    for i, t, _ in DOCS:
        want[i].append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(empty, VOCABULARY, 1, length).count() == 0


# ------------------------------------------------------------------ 8 WARC
def test_archives_round_trip_and_push_down(spark):
    rows = [(5, "http://a/ü\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", ""), (4, "http://c", None), (None, "http://d", "z" * 300_000), (9, "http://e", "z" * 300_000), (9, "http://e", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    folder = scratch_path(spark, "warc")
    warc.write(warc.archived(pages), folder)
    got = [(r.record_id, r.record_type, r.refers_to, r.payload_length, r.payload_digest) for r in warc.read(spark, folder).collect()]
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    first = {"<p>é</p>": 2, "": 3, "z" * 300_000: 9}
    want = []
    for i, _, html in rows:
        b, k = (html or "").encode(), first[html or ""]
        want.append((name(i), "response" if i == k else "revisit", None if i == k else name(k), len(b), "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()))
    assert Counter(got) == Counter(want)
    some = warc.read(spark, folder).where("record_type = 'response' AND record_id IN ('<urn:x-page:2>', '<urn:x-page:3>')")
    assert "PushedFilters: []" not in some._jdf.queryExecution().toString()
    assert {(r.record_id, bytes(r.payload)) for r in some.collect()} == {(name(2), "<p>é</p>".encode()), (name(3), b"")}
    assert {r.payload for r in warc.read(spark, folder, payload=False).collect()} == {None}
    folder = scratch_path(spark, "warc")
    warc.write(warc.archived(pages.limit(0)), folder)
    assert warc.read(spark, folder).count() == 0


def test_files_of_other_writers_are_read(spark, tmp_path):
    import gzip

    record = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <x:%d>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record % (b"response", i)) for i in range(3)))
    (tmp_path / "b.warc").write_bytes(b"".join(record % (b"request", i) for i in range(3, 6)))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, r.record_type, bytes(r.payload)) for r in rows) == [(f"<x:{i}>", "response" if i < 3 else "request", b"hello") for i in range(6)]


# ------------------------------------------------------------------ 9 Jaccard join
def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(rows):
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def family(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for base in range(10):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 40, 400]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, rng.choice([" ", "  ", "\n"]).join(copy)))
    return rows + [(2, "common words that all of them have here"), (500, "Common words that all of them HAVE here")]


@pytest.mark.parametrize("heavy", [jaccard.HEAVY, 3])
def test_join_loses_no_link(spark, docs, empty, heavy):
    for rows in (family(1), [(i, t) for i, t, _ in DOCS]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        out, links = jaccard.joined(df, heavy=heavy)
        got, want = out.collect(), plain_components(rows)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((i, len(shingle_set(t)), want.get(i)) for i, t in rows)
        text = dict(rows)
        for r in links.collect():
            assert 100 * r.overlap >= 75 * r.total
            if len(text) == len(rows):
                x, y = shingle_set(text[r.a]), shingle_set(text[r.b])
                assert (len(x & y), len(x | y)) == (r.overlap, r.total)
    assert jaccard.joined(empty)[0].count() == 0


@pytest.mark.parametrize("block", [jaccard.BLOCK, 2])
def test_join_gives_every_link(spark, empty, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    copies = [[f"v{i}" for i in range(100)] for _ in range(12)]
    for k, words in enumerate(copies):
        words[7 * k] = f"x{k}"
    family_rows = [(i, " ".join(w)) for i, w in enumerate(copies)]
    for rows in (family_rows, family(1), [(i, t) for i, t, _ in DOCS] + [(3, "x"), (3, "X  "), (70, family_rows[0][1]), (70, family_rows[1][1])]):
        out, links = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), every_link=True)
        named = [(i, frozenset(shingle_set(t))) for i, t in rows]
        alike = lambda x, y: bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)
        want = [(i, len(x), sum(alike(x, y) for k, (j, y) in enumerate(named) if k != n and j is not None) if i is not None else 0) for n, (i, x) in enumerate(named)]
        assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in out.collect()) == Counter(want)
        classes = defaultdict(list)
        for i, x in named:
            if x and i is not None:
                classes[x].append(i)
        pairs = {tuple(sorted((min(classes[x]), min(classes[y])))): (len(x & y), len(x | y)) for x, y in combinations(classes, 2) if alike(x, y)}
        assert {(r.a, r.b): (r.overlap, r.total) for r in links.collect()} == {p: n for p, n in pairs.items() if p[0] != p[1]}
    out, links = jaccard.joined(empty, every_link=True)
    assert out.count() == 0 and links.count() == 0


@pytest.mark.parametrize("carried, few, points", [(jaccard.CARRIED, jaccard.FEW, jaccard.POINTS), (1, 0, 7)])
def test_pair_of_many_cells_is_a_candidate_once(spark, monkeypatch, carried, few, points):
    # copies of 400 shingles, a few exchanged, each in 40 of 60 cells and most in a component of its own
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) > 0.02], rng.integers(0, 1 << 63, 8, dtype=np.uint64)])) for _ in range(24)]
    root = {i: i % 15 for i in range(len(sets))}
    cells = rng.integers(-(1 << 62), 1 << 62, 60)
    inside = [(int(c), i) for i in range(len(sets)) for c in rng.choice(cells, 40, replace=False)]
    # and two that share one cell of their many with them
    sets += sets[:2]
    root |= {24: 24, 25: 25}
    inside += [(int(cells[k]), i) for i, k in ((24, 3), (25, 3))] + [(int(c), i) for i in (24, 25) for c in rng.integers(-(1 << 62), 1 << 62, 50)]
    rooted = spark.createDataFrame([(c, i, root[i]) for c, i in inside], "cell long, doc_id long, root long")
    point = spark.createDataFrame([(i, len(s), bytearray(jaccard.point(s))) for i, s in enumerate(sets)], "doc_id long, n_shingles long, groups binary")
    of = defaultdict(set)
    for c, i in inside:
        of[c].add(i)
    want = {(a, b) for ids in of.values() if len(ids) > 2 for a, b in combinations(sorted(ids), 2) if root[a] != root[b]}
    monkeypatch.setattr(jaccard, "CARRIED", carried)
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "POINTS", points)
    assert {tuple(r) for r in jaccard.candidates(rooted, point, "long", 75).collect()} == want
    if carried > 1:
        monkeypatch.setattr(type(rooted), "distinct", lambda df: df)
        assert jaccard.candidates(rooted, point, "long", 75).count() == len(want)


def test_one_document_of_each_group_stays(docs, empty):
    kept = jaccard.deduplicated(docs)
    want = plain_components([(i, t) for i, t, _ in DOCS])
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*{i for i, k in want.items() if i == k}, None])
    assert jaccard.deduplicated(empty).count() == 0


def test_rtree_finds_all_that_may_link():
    rng = np.random.default_rng(3)
    points = rng.poisson(1.0, (200, jaccard.GROUPS)).astype(np.uint32)
    points[100:] = points[:100] + (rng.random((100, jaccard.GROUPS)) < 0.05)
    sizes = points.sum(1).astype(np.int64)
    tree = jaccard.RTree(points, sizes, leaf=4)
    for i in range(200):
        overlap = np.minimum(points, points[i]).sum(1)
        want = {j for j in range(200) if overlap[j] * 175 >= 75 * (sizes[i] + sizes[j])}
        assert want <= set(tree.near(points[i], int(sizes[i]), 75).tolist()) | set() and i in want


# ------------------------------------------------------------------ 10 nearest neighbours
def test_search_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[700:760] = x[700]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0, 2.0]), (2200, [2.0, 4.1]), (2250, [None, 1.0]), (None, [1.0] * 16), (2300, [float("inf")] + [0.0] * 15), (2301, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.neighbours(df, F.col("vec_id") % 50 == 0, k=5, sample=400, cell_rows=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = x.astype(float)
    norm = np.sqrt((y * y).sum(1))
    hits = 0
    for i in range(0, 1500, 50):
        score = (y * y[i]).sum(1) / (norm * norm[i])
        score[i] = -9
        best = np.lexsort((np.arange(1500), -np.round(score, 12)))[:5].tolist()
        hits += len({j for j, _ in got[i]} & set(best))
        assert len(got[i]) == 5 and all(abs(s - score[j]) < 1e-12 for j, s in got[i])
    assert hits >= 0.9 * 150 and [j for j, _ in got[700]] == [701, 702, 703, 704, 705]
    assert [j for j, _ in got[2150]] == [2200] and [j for j, _ in got[2200]] == [2150]
    assert set(got) == {*range(0, 1500, 50), 2150, 2200}
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("cell_rows", [8192, 40])
def test_repeated_ids_take_no_neighbours_place(spark, cell_rows):
    rng = np.random.default_rng(6)
    v, w, z = rng.standard_normal((3, 16))
    rows = [(100, v)] * 6 + [(101, v)] * 4 + [(i, v) for i in range(102, 106)]
    rows += [(200, w)] * 2 + [(201, w * f) for f in (1, 2, 3, 5, 7, 11)] + [(i, w + 0.1 * rng.standard_normal(16)) for i in range(202, 208)]
    rows += [(300, z), (300, w), (300, z)] + [(i, z + 0.2 * rng.standard_normal(16)) for i in (301, 302, 302, 303, 303)]
    rows += [(int(i), x) for i, x in zip(rng.integers(1000, 1060, 200), rng.standard_normal((200, 16)), strict=True)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in ann.neighbours(df, F.col("vec_id") % 100 == 0, k=5, certainty=1 - 1e-12, cell_rows=cell_rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    cosine = lambda x, y: round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 9)
    for i in {i for i, _ in rows if i % 100 == 0}:
        hits = {(j, cosine(x, y)) for n, x in rows if n == i for j, y in rows if j != i}
        assert got[i] == sorted(hits, key=lambda h: (-h[1], h[0]))[:5]
    assert [j for j, _ in got[100]] == [101, 102, 103, 104, 105]
    assert set(got) == {i for i, _ in rows if i % 100 == 0}


# ------------------------------------------------------------------ pipeline and queries
def test_pipeline_runs_every_stage(spark):
    import corpus_pipeline
    from tests.conftest import SF_SMOKE

    docs = spark.read.parquet(f"{SF_SMOKE}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    rows, last = docs, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF_SMOKE).persist()
        assert rows.columns == docs.columns and 0 < rows.count() <= last
        last = rows.count()
    left = [(r.doc_id, r.text) for r in rows.collect()]
    assert all(k == i for i, k in plain_components(left).items())
    pieces = corpus_pipeline.run(spark, SF_SMOKE).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in left} and all(r.n == r.m for r in pieces)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_covers_its_table(spark, name):
    from tests.conftest import SF_SMOKE

    out = Q.QUERIES[name](spark, SF_SMOKE)
    assert len(out.columns) == len(set(out.columns)) and out.count() > 0


def test_fresh_names_avoid_columns(docs):
    assert textbytes.fresh(docs, "IDS", "other", "other") == ["IDS_", "other", "other_"]
