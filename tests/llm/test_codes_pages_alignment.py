"""Vector codes, page text and tokenizer alignment, against plain versions of what they compute."""

import hashlib
import random
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
import pytest

from ragloom.llm import align, codes, htmltext, keyed, tokens
from ragloom.llm import queries as Q
from tests.conftest import SF_SMALL, SF_SMOKE

A, B = tokens.public("byte_bpe_50k.json"), tokens.public("piece_bpe_32k.model")


# ------------------------------------------------------------------ vector codes
def plain_codes(rows, entries=256, rounds=4):
    """id -> (code, error, label_error, digest) by distances to every entry."""
    kept = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64), g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0]))
    vectors = np.array([r[1] for r in kept]).reshape(len(kept), 4, -1)
    books = vectors[:entries].transpose(1, 0, 2).copy()

    def nearest():
        found = [((vectors[:, p, None] - books[p][None]) ** 2).sum(-1) for p in range(4)]
        return np.array([d.argmin(1) for d in found]).T, sum(d.min(1) for d in found)

    for _ in range(rounds):
        best = nearest()[0]
        for p in range(4):
            for e in range(books.shape[1]):
                mine = vectors[best[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    best, error = nearest()
    together = Counter()
    for r, e in zip(kept, error, strict=True):
        together[r[2]] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return {r[0]: (bytes(b.tolist()).hex(), int(e), together[r[2]], digest) for r, b, e in zip(kept, best, error, strict=True)}


def vector_rows(rng, n, size=8):
    centres = rng.normal(size=(6, size))
    return [(i * 3, [float(x) for x in centres[i % 6] + 0.1 * rng.normal(size=size)], i % 4 if i % 5 else None) for i in range(n)]


def test_codes_equal_distances_to_every_entry(spark):
    rng = np.random.default_rng(1)
    rows = vector_rows(rng, 700)
    rows[10:14] = [(30, None, 1), (33, [float("nan")] * 8, 1), (36, [1.0, None] * 4, 1), (39, [float("inf")] + [0.0] * 7, 2)]
    rows[40:60] = [(i, rows[0][1], 9) for i, _, _ in rows[40:60]]  # equal vectors: ties
    rows.append((None, [0.25] * 8, 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    out, books = codes.compress(df)
    got = {r.vec_id: (bytes(r.code).hex(), r.error, r.label_error, r.codebooks_sha256) for r in out.collect()}
    assert got == plain_codes(rows) and books.shape == (4, 256, 2)
    vectors = {i: v for i, v, _ in rows}
    mean = np.mean([np.abs(codes.restored(np.frombuffer(bytes.fromhex(c), np.uint8)[None], books)[0] - vectors[i]).mean() for i, (c, *_) in got.items()])
    assert mean < 0.1


def test_gnat_finds_what_all_distances_find_and_leaves_entries_out():
    rng = np.random.default_rng(2)
    entries = np.concatenate([rng.integers(-5, 5, (120, 6)) + c for c in rng.integers(-400, 400, (2, 6))])
    entries[100:110] = entries[:10]
    points = entries[rng.integers(0, len(entries), 3000)] + rng.integers(-3, 3, (3000, 6))
    best, least, done = codes.Gnat(entries).nearest(points)
    d = ((points[:, None] - entries[None]) ** 2).sum(-1)
    assert (best == d.argmin(1)).all() and (least == d.min(1)).all() and done < 0.7 * d.size
    same = np.zeros((200, 3), np.int64)
    assert (codes.Gnat(same).nearest(same)[0] == 0).all()
    far = rng.integers(-(1 << 27), 1 << 27, (200, 2))  # beyond the whole numbers that doubles hold
    wide = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in far] for x in far[:50]], dtype=object)
    got = codes.Gnat(far).nearest(far[:50] + 7)
    assert (got[0] == np.arange(50)).all() and (got[1] == 98).all() and codes.squares(far[:50], far).tolist() == wide.tolist()


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string, code string"
    rows = [(1, [0.5, 0.25, -1.0, 2.0], "a", "x"), (1, [0.5, 0.25, -1.0, 2.0], "a", "y"), (2, [1.0] * 8, None, "z"), (3, [3e30, 0.0, 0.0, 0.0], None, "z"), (4, [], "b", "z"), (5, [1.0] * 4, None, "z")]
    out = codes.compress(spark.createDataFrame(rows, schema))[0]
    assert out.columns == ["vec_id", "label", "code", "code_", "error", "label_error", "codebooks_sha256"]
    got = {(r.vec_id, r.code): (None if r.code_ is None else bytes(r.code_).hex(), r.error, r.label_error) for r in out.collect()}
    # the part of the smallest id is met by both copies; what fits no codebook has no code
    assert got == {(1, "x"): ("00000000", 0, 0), (1, "y"): ("00000000", 0, 0), (2, "z"): (None, None, 0), (3, "z"): (None, None, 0), (4, "z"): (None, None, None), (5, "z"): ("02020202", 0, 0)}
    out, books = codes.compress(spark.createDataFrame([], schema))
    assert out.count() == 0 and books is None
    out, books = codes.compress(spark.createDataFrame([(1, [1.0] * 3, "a", "x")], schema))
    assert out.select("code_").first()[0] is None and books is None


def test_values_beside_hot_and_rare_keys(spark, monkeypatch):
    monkeypatch.setattr(keyed, "SENT_BYTES", 0)
    monkeypatch.setattr(keyed, "SHARE", 10)
    rows = [(i, "hot" if i % 2 else None if i % 6 == 0 else f"k{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "key long, name string")
    values = spark.createDataFrame([("hot", 1), (None, 2), ("k2", 3), ("none", 4)], "key string, value int")
    got = {r[0]: r[2] for r in keyed.beside(df, "name", values, "v").collect()}
    assert got == {i: {"hot": 1, None: 2, "k2": 3}.get(k) for i, k in rows}


# ------------------------------------------------------------------ page text
S = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore."
PAGES = {
    "div": (f'<html><body class="has-sidebar"><div id="header"><h1>Site</h1></div><ul class="menu"><li><a href=x>a</a></ul><div class="wrap"><div class="content"><h1>Title</h1><p>{S}<p>{S}<ul><li>one<li>two &lt;x&gt;</ul></div><div class="sidebar"><p>{S * 3}</div></div><div id="comments"><p>{S * 9}</div><div class="cookie-notice">We use cookies {S}</div><form><input name=q><label>Search</label></form><div class="footer">c</div></body></html>', f"Title\n{S}\n{S}\none\ntwo <x>"),
    "cells": (f"<table><tr><td><a href=1>x</a><br><a href=2>y</a></td><td><h1>T</h1>{S}<br>{S}<p>{S}</td></tr></table>", f"T\n{S} {S}\n{S}"),
    "comments": (f'<main><article class="post-12"><header><h1>T</h1></header><p>{S}</p><div class="ad-slot">buy</div><div class="share-buttons">tweet</div><footer>tags</footer></article><section class="comments"><article class="comment"><p>{S * 9}</p></article></section></main>', f"T\n{S}"),
    "sections": (f"<body><header>top</header><article><section><h2>A</h2><p>{S}</section><section><h2>B</h2><p>{S} {S}</section></article><aside>{S * 9}</aside></body>", f"A\n{S}\nB\n{S} {S}"),
    "plain": ("just text & more &amp; &nbsp; x", "just text & more & x"),
    "broken": (f'<body><div class="content"><p>a<b>b<i>c</p><p>d</b></i> {S}<p title="x>y">q</p><!-- c --><script>if(a<b)"</p>"</script><p>z < 3 &am', f"abc\nd {S}\nq\nz < 3 &am"),
    "cut": ("<body><article><p>abc</p><p>def</p><p cla", "abc\ndef"),
    "hidden": (f'<body><div style="display:none">{S}</div><p hidden>{S}<p>x y</p></body>', "x y"),
    "form": (f'<body><form id=aspnet><div class="main"><h1>T</h1><p>{S}</div></form></body>', f"T\n{S}"),
    "blocks": (f'<body><div class=main-content><blockquote><p>{S}</p></blockquote><pre> a  b\n c</pre><table><tr><th>H<th>I<tr><td>1<td>2</table></div></body>', f"{S}\na b c\nH\nI\n1\n2"),
    "nav": ("<nav>a b c</nav>", ""),
    "white": ("  \n", ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_text_of_single_pages(name):
    html, want = PAGES[name]
    page = htmltext.Page(html)
    assert page.text(page.best()) == want


def test_hosts_outvote_a_page_and_odd_rows_are_pages(spark):
    """A page with far more unnamed comment text than article follows its host; without a host it can't."""
    usual = f"<body><div class=a><h1>T</h1><p>{S}</div><div class=b><p>short remark</div></body>"
    odd = f"<body><div class=a><h1>T</h1><p>{S}</div><div class=b><p>{S} {S} {S} {S}</div></body>"
    rows = [(i, f"HTTPS://user@News.example:8080/{i}", usual, "t") for i in range(30)]
    rows += [(100, "https://news.example/x", odd, "t"), (101, None, odd, "t"), (101, "no url", odd, "t"), (None, "https://news.example/y", None, None), (102, "https://other.example/", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4)
    out, won = htmltext.extract(df)
    assert out.columns == ["page_id", "url", "text", "text_", "n_chars"] and out.count() == len(rows)
    got = {(r.page_id, r.url): (r.text_, r.n_chars) for r in out.collect()}
    article = f"T\n{S}"
    assert got[0, rows[0][1]] == got[100, "https://news.example/x"] == (article, len(article))
    longer = f"{article}\n{S} {S} {S} {S}"  # left alone, the page takes both for its text
    assert got[101, None] == got[101, "no url"] == (longer, len(longer))
    assert got[None, "https://news.example/y"] == got[102, "https://other.example/"] == ("", 0)
    assert [(r.host, r.spelled, r.votes) for r in won.collect()] == [("news.example", "body>div.a", 30)]
    assert htmltext.extract(df.limit(0))[0].count() == 0


def test_extraction_equals_the_articles_of_the_table(spark):
    """Every page of the table has one article; its blocks are cut out by hand."""
    import re

    got = {r.page_id: r.text for r in Q.QUERIES["op11_html"](spark, SF_SMALL).collect()}
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(x for x in blocks if x)


def test_long_and_deep_pages_take_time_in_proportion():
    for html in ("<div>" * 50_000, "<b>" * 50_000 + "<li>x" * 1000, '<a title="' * 50_000, "<!--" * 50_000, "<ul><li>x" * 20_000, "&" * 100_000):
        page = htmltext.Page(html)
        page.text(page.best())


# ------------------------------------------------------------------ alignment
def plain_alignment(rows):
    """Rows of the result by the common ends of both tokenizers' tokens, and the pairs written out."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_of = Tokenizer.from_file(A)
    a_of.encode_special_tokens = True
    b_of = SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    docs = []
    for i, t in rows:
        groups = None
        if t:
            a, b = a_of.encode(" " + t, add_special_tokens=False).ids, b_of.encode(t)
            x = [bytes(byte[c] for c in a_of.id_to_token(k)) for k in a]
            y = [bytes([int(b_of.id_to_piece(k)[3:5], 16)]) if b_of.is_byte(k) else b_of.id_to_piece(k).replace("▁", " ").encode() for k in b]
            if b"".join(x) == b"".join(y) == (" " + t).encode():
                ends = [np.cumsum([len(v) for v in side]).tolist() for side in (x, y)]
                groups, at = [], [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    to = [ends[s].index(cut, at[s]) + 1 for s in (0, 1)]
                    groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
                    at = to
        docs.append((i, groups))
    held = Counter(pair for _, g in docs for pair in {(x, y) for xs, ys in g or () for x in xs for y in ys})
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = Counter()
    for i, g in docs:
        links = [(x, y) for xs, ys in g or () for x in xs for y in ys]
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g or ())
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out[i, sum(len(xs) for xs, _ in g or ()), sum(len(ys) for _, ys in g or ()), len(g or ()), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), digest] += 1
    return out


def odd_texts():
    rng = random.Random(5)
    texts = [None, "", " ", "  ", "a", "▁x", "<0x41> <s> <unk>", "\x00a\t\n b", " lead", "trail  ", "日本語テキスト ไทย " * 30, "x" * 3000, " " * 3000, "ﬁ ｆ１ 　\xa0 z", "<|endoftext|> it's"]
    texts += ["".join(rng.choice("ab é'sé \n\t 1.!　日🙂\x1c\x85") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    return texts + [texts[6], texts[8], " ".join(rng.choice(["word", "  is", "日本", "🙂x", "1999"]) for _ in range(4000))]


@pytest.mark.parametrize("sent", [align.SENT, 150])
def test_alignment_equals_the_plain_version(spark, sent):
    """With all pairs sent to the executors, and with most of them met in a shuffle."""
    rows = [(i if i % 7 else None, t, "clash") for i, t in enumerate(odd_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(3)
    out = align.align(df, A, B, most_sent=sent)
    assert out.columns == ["doc_id", "n_a", "n_a_", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter((r[0], *r[2:]) for r in out.collect()) == plain_alignment([(i, t) for i, t, _ in rows])
    assert align.align(df.limit(0), A, B).count() == 0


def test_alignment_of_the_table_equals_the_plain_version(spark):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = Counter(tuple(r) for r in Q.QUERIES["op13_alignment"](spark, SF_SMOKE).select(columns).collect())
    assert got == plain_alignment([tuple(r) for r in spark.read.parquet(f"{SF_SMOKE}/documents.parquet").select("doc_id", "text").collect()])


def test_long_text_in_runs_has_the_groups_of_the_whole():
    both = align.loaded(A, B)
    for text in (odd_texts()[-1], "日本語テキスト ไทย " * 300, "x" * 5000 + "  y" * 300):
        data = np.frombuffer((" " + text).encode(), np.uint8)
        whole, runs = both.groups(data, np.array([0, len(data)])), both.long_text(data, 1000)
        assert all(np.array_equal(x, y) for k in whole for x, y in zip(whole[k], runs[k], strict=True))


def test_pieces_equal_the_library_on_odd_texts():
    from sentencepiece import SentencePieceProcessor

    texts, plain, ours = [t for t in odd_texts() if t], SentencePieceProcessor(model_file=B), align.Pieces(B)
    for _ in range(2):  # the second time from those kept
        got = [f[i:j].tolist() for _, f, o in ours.encode(align.led(pa.array(texts))) for i, j in zip(o, o[1:], strict=False)]
        assert got == [plain.encode(t) for t in texts]


def test_counts_are_looked_up_for_a_few_rows_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * 8 * n for n in (3, 0, 9, 1, 1)], pa.binary())], names=["pairs"])
    parts = [[len(v.as_py()) // 8 for v in p.column(0)] for p in align.in_parts(batch, "pairs", 4)]
    assert parts == [[3, 0], [9], [1, 1]]
