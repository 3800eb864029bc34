"""Main text of web pages by the consensus of their host's pages.

1. Each page is read into elements once: its containers (article, main, section, div, table cell, body) get the
   characters outside links of the blocks they hold, fewer the deeper these lie, and more for names that tell of
   an article; menus, headers, footers, sidebars, notices, adverts, forms, comments and hidden elements hold none.
2. A container's path is the tags and classes of the block elements around it, digits generalised. Every page votes for the
   path with the best sum of scores, and Spark counts the votes of each host. A host's winning paths are those with at
   least a twentieth of its votes, so there are at most twenty.
3. Each page is read again and gives the text of the elements on its host's first winning path that it has. Where it has
   none, or one of less than a tenth of its own best score, or its url names no host, its own best path counts.

Text: character references are decoded, white space inside a block (also a line break) becomes one space, blocks are joined by
\\n in page order, empty ones left out. A page is parsed in one pass with a stack of open elements, in
time and memory in proportion to its length, as browsers do where tags are missing.

Defined results: a null or empty page, or one without such text, has the empty text. Null and broken urls have no host. Every row
is a page, also with a null or repeated id, and a repeated page votes as often. Other columns are kept; the columns
added get a longer name where theirs is taken.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import beside
from .prefix import written
from .textbytes import appended, fresh, q, widened

SHARE = 20  # a winning path has at least one in so many of its host's votes
FAINT = 0.1  # of the page's own best score: below it the consensus is not about this page
DEEPER = 0.75  # of a container's score counts for the one around it

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w:]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Element names of the HTML standard by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body center details div main section td".split())
MENU = frozenset("center div dl ol td tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("aside audio button canvas datalist dialog embed footer head iframe input menu nav noembed noframes noscript object select svg template textarea video".split())
CLOSES = {  # the open elements of which the nearest is closed, and those beyond which it is not looked for
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
# Words of class and id names, and roles, of what is not the article.
COMMENT = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
NOISE = COMMENT | frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertisements advertising adv banner breadcrumb breadcrumbs consent cookie cookies copyright footer "
    "gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promotion "
    "recommended recommendations related rail search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar trending widget widgets".split()
)
TOP = frozenset("header masthead topbar".split())
ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
STORY = frozenset("article body content entry main page post story text".split())
NOT_A_NAME = re.compile(r"(?:has|no|not|with|without|is)[-_]")


def words(names: str) -> set[str]:
    """Words of class and id names, `has-sidebar` and its like left out."""
    out: set[str] = set()
    for name in names.split():
        if not NOT_A_NAME.match(name.lower()):
            out.update(re.findall(r"[a-z]+", _HUMP.sub(" ", name).lower()))
    return out


def label(tag: str, classes: str) -> str:
    """The tag with its classes in order, runs of digits as one sign."""
    if not classes or tag in ("html", "body"):
        return tag
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", c.lower()) for c in classes.split()})])


class Page:
    """Elements in page order (a parent before its children), and pieces of text with their element, block and
    whether they lie in a link."""

    def __init__(self, html: str):
        self.tag, self.parent, self.label, self.drop = ["#page"], [-1], [""], [False]
        self.story = [False]
        self.texts: list[tuple[int, int, str, bool]] = []
        self.links = [0]
        self._read(html)
        self._weigh()

    def _open(self, tag: str, attributes: str) -> int:
        names = classes = ""
        gone = tag in NEVER
        if attributes and not attributes.isspace():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(_ATTRIBUTE.finditer(attributes)))}
            classes = found.get("class", "")
            names = classes + " " + found.get("id", "")
            gone = gone or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLE or ("style" in found and bool(_HIDDEN.search(found["style"])))
        mine = words(names) if not names.isspace() and names else set()
        kind: bool | str = gone
        if not gone and tag not in ("html", "body", "#page"):
            if tag == "header" or mine & TOP and not mine & COMMENT:
                kind = "top"
            elif tag in ("article", "main"):
                kind = bool(mine & COMMENT)
            elif tag == "form" or mine & NOISE:
                kind = "noise"
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.label.append(label(tag, classes) if tag in BLOCK else "")
        self.drop.append(kind)
        self.story.append(bool(mine & STORY) or tag in ("article", "main"))
        self.links.append(0)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        self.stack = stack = [0]
        open_tags: dict[str, int] = {}
        tags, texts = self.tag, self.texts
        block, at, end = 0, 0, len(html)

        def close(upto: int) -> None:
            """Closes the elements above the first `upto` of the stack."""
            nonlocal block
            while len(stack) > upto:
                name = tags[stack.pop()]
                open_tags[name] -= 1
                if name in BLOCK:
                    block += 1

        def close_one(name: str) -> None:
            while open_tags.get(name):
                last = tags[stack[-1]] == name
                close(len(stack) - 1)
                if last:
                    return

        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                lt = end
            if lt > at:
                text = html[at:lt]
                if not text.isspace() and open_tags.get("head"):
                    close_one("head")
                texts.append((stack[-1], block, unescape(text) if "&" in text else text, bool(open_tags.get("a"))))
                at = lt
                continue
            m = _TAG.match(html, at)
            if not m:
                after = html[at + 1 : at + 2]
                if html.startswith("<!--", at):
                    stop = html.find("-->", at + 2)  # `<!-->` ends too
                    at = stop + 3 if stop >= 0 else end
                elif after in ("!", "?") and after or (after == "/" and html[at + 2 : at + 3] != ""):
                    stop = html.find(">", at)
                    at = stop + 1 if stop >= 0 else end
                elif after.isalpha() and after.isascii():
                    at = end  # a tag that the page's end cuts off
                else:
                    texts.append((stack[-1], block, "<", bool(open_tags.get("a"))))
                    at += 1
                continue
            at = m.end()
            name = m[2].lower()
            if m[1]:
                if name in ("body", "html"):
                    continue
                if name == "br":
                    texts.append((stack[-1], block, " ", False))
                else:
                    close_one(name)
                continue
            if name in ("html", "body") and open_tags.get(name):
                continue
            if open_tags.get("head") and name not in IN_HEAD:
                close_one("head")
            if name == "br":
                texts.append((stack[-1], block, " ", False))
                continue
            if name in BLOCK:
                if open_tags.get("p"):
                    close_one("p")
                block += 1
            if name == "a":
                self.links[stack[-1]] += 1
                if open_tags.get("a"):
                    close_one("a")
            if name in CLOSES:
                again, walls = CLOSES[name]
                if any(open_tags.get(t) for t in again):
                    up = len(stack) - 1
                    while up and tags[stack[up]] not in walls and tags[stack[up]] not in again:
                        up -= 1
                    if tags[stack[up]] in again:
                        close(up)
            if name in VOID:
                continue
            node = self._open(name, m[3])
            if name in RAW:
                stop = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
                at = stop.start() if stop else end
                if stop:
                    at = html.find(">", at) + 1 or end
                if name in BLOCK:
                    block += 1
                continue
            if m[3].endswith("/") and name in ("svg", "path", "circle", "rect", "use"):
                continue
            stack.append(node)
            open_tags[name] = open_tags.get(name, 0) + 1

    def _weigh(self) -> None:
        """Which elements go, and each container's score."""
        n, tag, parent = len(self.tag), self.tag, self.parent
        heads, mains, h1 = [0] * n, [0] * n, [0] * n
        plain, links = [0] * n, self.links[:]
        for node, _, text, link in self.texts:
            if not link and any(map(str.isalnum, text)):  # marks between links are no text
                plain[node] += sum(map(len, text.split()))
        total = plain[:]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            heads[p] += heads[i] + (tag[i] in HEADING)
            mains[p] += mains[i] + (tag[i] in ("article", "main") and not self.drop[i])
            h1[p] += h1[i] + (tag[i] == "h1")
            total[p] += total[i]
            links[p] += links[i]
        self.gone = gone = [False] * n
        within = [False] * n
        for i in range(1, n):
            p = parent[i]
            within[i] = within[p] or tag[i] in ("article", "main")
            kind = self.drop[i]
            if kind == "top":  # an article's own header holds its heading
                kind = not (heads[i] and (within[i] or self.story[i])) and not mains[i]
            elif kind == "noise":
                kind = not mains[i] and not (tag[i] == "form" and h1[i])
            elif not kind and tag[i] in MENU and not within[i]:
                kind = links[i] > 1 and not total[i]  # nothing but links
            gone[i] = gone[p] or bool(kind)
        score = [0.0] * n
        has_h1 = [False] * n
        for i in range(n - 1, -1, -1):
            if not gone[i]:
                own = score[i] + plain[i]
                title = has_h1[i] or tag[i] == "h1"
                if i:
                    has_h1[parent[i]] |= title
                    score[parent[i]] += own * (DEEPER if tag[i] in CONTAINER else 1.0)
                score[i] = own
        self.paths: list[bytes] = [b""] * n
        self.score: dict[bytes, float] = {}
        self.first: dict[bytes, int] = {}
        for i in range(n):
            around = self.paths[parent[i]] if i else b""
            self.paths[i] = hashlib.blake2b(around + self.label[i].encode(), digest_size=8).digest() if self.label[i] else around
            if (tag[i] in CONTAINER or not i) and not gone[i] and score[i] > 0:
                weight = 2.5 if tag[i] == "article" else 1.5 if self.story[i] else 0.9 if tag[i] in ("body", "#page") else 1.0
                path = self.paths[i]
                self.score[path] = self.score.get(path, 0.0) + score[i] * weight * (1.5 if has_h1[i] else 1.0)
                self.first.setdefault(path, i)

    def best(self) -> bytes | None:
        """The path of the best score, of equal ones the one that comes first."""
        return max(self.score, key=lambda p: (self.score[p], -self.first[p]), default=None)

    def spelled(self, path: bytes) -> str:
        i, out = self.first[path], []
        while i > 0:
            if self.label[i]:
                out.append(self.label[i])
            i = self.parent[i]
        return ">".join(reversed(out))

    def chosen(self, winners: list[bytes]) -> bytes | None:
        own = self.best()
        if own is not None:
            for path in winners:
                if self.score.get(path, 0.0) >= FAINT * self.score[own]:
                    return path
        return own

    def text(self, path: bytes | None) -> str:
        """The blocks of the containers on the path."""
        if path is None:
            return ""
        inside = [False] * len(self.tag)
        for i in range(len(self.tag)):
            inside[i] = not self.gone[i] and ((i > 0 and inside[self.parent[i]]) or (self.paths[i] == path and (self.tag[i] in CONTAINER or not i)))
        out: list[str] = []
        last, held = -1, []
        for node, block, text, _ in self.texts:
            if block != last:
                out.append(" ".join("".join(held).split()))
                last, held = block, []
            if inside[node]:
                held.append(text)
        out.append(" ".join("".join(held).split()))
        return "\n".join(t for t in out if t)


# ------------------------------------------------------------------ the operator
def host(url: Column) -> Column:
    """The host of a url in lower case, without a port; null where there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1), F.lit(""))


def number(path: bytes) -> int:
    return int.from_bytes(path, "big", signed=True)


def votes(pages: DataFrame, host_col: str, html_col: str) -> DataFrame:
    """host, path (its number), spelled (its text) and the votes of the host's pages."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, keys, names = [], [], []
            for name, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                page = Page(html.as_py() or "")
                path = page.best()
                if path is not None:
                    hosts.append(name)
                    keys.append(number(path))
                    names.append(page.spelled(path))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(names, pa.string())], names=["host", "path", "spelled"])

    seen = pages.where(F.col(q(host_col)).isNotNull()).select(F.col(q(host_col)).alias("host"), F.col(q(html_col)).alias("html"))
    return seen.mapInArrow(rows, "host string, path long, spelled string").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.min("spelled").alias("spelled"))


def winners(counted: DataFrame) -> DataFrame:
    """The votes of the winning paths: those with at least a twentieth of their host's."""
    totals = counted.groupBy(F.col("host").alias("key")).agg(F.sum("votes").alias("value"))
    return beside(counted, "host", totals, "cast").where(F.col("votes") * SHARE >= F.col("cast"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """The table without its html, with `text` and `n_chars` (its code points); and the winning paths of each
    host (host, path, votes, spelled, cast)."""
    host_col, paths_col, *names = fresh(pages, "host", "paths")
    text, n_chars = fresh(pages.drop(html_col), "text", "n_chars")
    with_host = pages.withColumn(host_col, host(F.col(q(url_col))))
    won = written(winners(written(votes(with_host, host_col, html_col), "votes")), "winners")
    # at most SHARE numbers a host
    order = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("votes"), "path")))
    lists = won.groupBy(F.col("host").alias("key")).agg(F.array_join(F.transform(order, lambda s: s["path"].cast("string")), ",").alias("value"))
    ready = beside(with_host, q(host_col), lists, paths_col).drop(host_col)
    left = pages.drop(html_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, list[bytes]] = {None: []}
        for b in batches:
            out = []
            for html, paths in zip(b.column(b.schema.get_field_index(html_col)), b.column(b.schema.get_field_index(paths_col)).to_pylist(), strict=True):
                if paths not in known:
                    if len(known) > 10_000:
                        known = {None: []}
                    known[paths] = [int(p).to_bytes(8, "big", signed=True) for p in paths.split(",")]
                page = Page(html.as_py() or "")
                out.append(page.text(page.chosen(known[paths])))
            rest = b.select([n for n in b.schema.names if n not in (html_col, paths_col)])
            yield appended(rest, **{text: pa.array(out, pa.string()), n_chars: pa.array([len(t) for t in out], pa.int64())})

    return ready.mapInArrow(rows, widened(left, {text: "string", n_chars: "long"})), won
