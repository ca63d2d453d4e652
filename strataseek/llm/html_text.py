"""Main text of web pages by the style trees of their sites.

The pages of a host are merged into one tree. Its nodes are the block elements by
their path, each kind (tag and class names) of sibling once; a page adds to a node the
kinds of its children (presentation) and, where text stands in it, the texts
(content). A node is as important as it is varied:

* presentation: the entropy of the ways the node is built, in units of log m, m the
  number of pages that have it;
* content: one less the mean entropy of its texts; a text on k of m pages has log k /
  log m, so a site's menu, the same everywhere, comes out at 0, prose at 1. The mean is
  taken over different texts: copies of a page weigh no more than the page;
* a branch: (1 - 0.9^l) of its own presentation, l the ways it is built, and 0.9^l of
  the mean of the content in it and in its children.

A text's importance is that of its node, drawn towards its branch where few pages have
the node. Branches below a threshold go. What markup names is a prior: navigation,
forms, adverts, comments and the like have no importance, whatever their texts, while
text within ``article`` needs strong evidence to go.

The trees are counted by built-in aggregations, hot hosts in partial sums; a page is
parsed twice, once for its numbers and once for its text, and never shuffled.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataseek.llm.common import Memo, map_batches, texts, unused, written

#: Importance below which text goes: anywhere, within a part that markup names as content, and in links.
NOISE, NAMED, LINKS = 0.4, 0.1, 0.8
#: Pages that a host's tree needs to judge by, in general and within named content; pages that count as much as the branch.
PAGES, NAMED_PAGES, BRANCH_PAGES = 3, 20, 4
GAMMA = 0.9
#: Numbers of noisy nodes that may be sent to every task; beyond, they are joined by host and salt.
SENT, SALTS = 1_000_000, 64

# Names of HTML. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes template".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th
    thead tr ul""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A start tag ends open elements of these names, up to an element of those names.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
} | {h: ({*HEADINGS}, BLOCKS - HEADINGS) for h in HEADINGS - {"hgroup"}}
_P_SCOPE = frozenset("table td th caption button object".split())

# Names that say what an element is for.
NOISE_TAGS = frozenset("nav aside footer header form button select datalist dialog menu noscript svg math object canvas audio video map head search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
NOISE_WORDS = frozenset(
    """ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar
    breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar cookie cookies consent gdpr notice popup modal overlay dialog newsletter
    subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies respond
    discussion search pagination pager widget copyright disclaimer skip form""".split()
)
CONTENT_WORDS = frozenset("article articlebody post entry story content main text body page prose".split())

_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)([^>\"']*)|!--|[!?])")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_UNQUOTED = re.compile(r"[^>\"']*")
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

FORM, GONE = 1, 2
NAMED_CONTENT, MAIN, ARTICLE = 1, 2, 3


def _purpose(tag: str, attributes: str) -> tuple[int, int, str]:
    """Noise (none, a form, or more), content (none, by name, main, article) and label of an element."""
    own = {n.lower(): v.strip("\"'") for n, v in _ATTRIBUTE.findall(attributes)} if attributes and not attributes.isspace() else {}
    names = f"{own.get('class', '')} {own.get('id', '')}"
    words = [w.lower() for w in _WORD.findall(names)]
    role = own.get("role", "").lower()
    content = ARTICLE if tag == "article" or role == "article" else MAIN if tag == "main" or role == "main" else 0
    noise = GONE if role in NOISE_ROLES or "hidden" in own or own.get("aria-hidden") == "true" or _HIDDEN.search(own.get("style", "")) else 0
    if not noise and tag in NOISE_TAGS:
        noise = FORM if tag == "form" else GONE
    if not noise and not content and tag not in ("html", "body") and not NOISE_WORDS.isdisjoint(words):
        noise = GONE
    if content == ARTICLE and not {"comment", "comments", "reply"}.isdisjoint(words):
        noise = GONE
    if not noise and not content and (own.get("itemprop") == "articleBody" or not CONTENT_WORDS.isdisjoint(words)) and tag not in ("html", "body"):
        content = NAMED_CONTENT
    return noise, content, ".".join([tag, *sorted(set(words))])


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


class Page:
    """A page read into its blocks of text and the nodes of its site's tree.

    ``blocks``: (text, node, content, noise, share of it in links); ``built``: node -> kinds of its children;
    ``parent``: node -> the node it lies in. Reading takes time in proportion to the length.
    """

    purposes = Memo(lambda key: _purpose(*key), 50_000)
    node_ids = Memo(lambda key: _hash(f"{key[0]}>{key[1]}"), 200_000)

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int, int, float]] = []
        self.built: dict[int, list[str]] = {0: []}
        self.parent: dict[int, int | None] = {0: None}
        # open elements: tag, node, noise, content, whether only headings count; and where each tag is open
        self.open: list[tuple[str, int, int, int, bool]] = [("", 0, 0, 0, False)]
        self.where: dict[str, list[int]] = {}
        self.parts: list[str] = []
        self.linked, self.in_link = 0, False
        self._read(html)
        self._flush()

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        more = {'"': True, "'": True}  # whether a later quote of the kind exists
        while at < size:
            m = _START.search(html, at)
            if m is None:
                self._text(html[at:])
                return
            if m.start() > at:
                self._text(html[at : m.start()])
            tag = m[2]
            if tag is None:
                end = html.find("-->", m.start() + 2) if m[0] == "<!--" else html.find(">", m.end())
                at = size if end < 0 else end + (3 if m[0] == "<!--" else 1)
                continue
            end = m.end()
            while end < size and html[end] != ">":  # a quoted value; without a second quote it ends with the tag
                quote = html[end]
                after = html.find(quote, end + 1) if more[quote] else -1
                more[quote] = after >= 0
                end = _UNQUOTED.match(html, after + 1 if after >= 0 else end + 1).end()
            tag = tag.lower()
            if m[1]:
                self._end(tag)
            else:
                self._begin(tag, html[m.end(2) : end])
                if tag in RAW:
                    found = _RAW_ENDS[tag].search(html, end)
                    end = html.find(">", found.end()) if found else -1
                    if end < 0:
                        return
            at = end + 1

    def _text(self, text: str) -> None:
        self.parts.append(text)
        if self.in_link:
            self.linked += len(text)

    def _flush(self) -> None:
        """End the block that text was gathered for."""
        if self.parts:
            raw = "".join(self.parts)
            # each run of text between tags is decoded by itself
            text = _SPACE.sub(" ", "".join(map(unescape, self.parts)) if "&" in raw else raw).strip(" ")
            if text:
                _, node, noise, content, heads = self.open[-1]
                if heads and not any(self.where.get(h) for h in HEADINGS):
                    noise = GONE
                self.blocks.append((text, node, content, noise, self.linked / len(raw)))
            self.parts, self.linked = [], 0

    def _pop(self, to: int) -> None:
        if self.open[-1][1:3] != self.open[to - 1][1:3]:  # another node, or noise that ends
            self._flush()
        while len(self.open) > to:
            self.where[self.open.pop()[0]].pop()

    def _last(self, tags) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def _close(self, tags, upto) -> None:
        at = self._last(tags)
        if at and at > self._last(upto):
            self._pop(at)

    def _begin(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in RAW or tag in VOID and tag != "hr":
            return
        block = tag in BLOCKS
        if block:
            self._flush()
            self.in_link = False
            self._close(("p",), _P_SCOPE)
            if tag in ENDS:
                self._close(*ENDS[tag])
            if tag == "hr":
                return
        elif tag == "a":
            self.in_link = True
        _, parent, noise, content, heads = self.open[-1]
        own_noise, own_content, label = self.purposes[tag, attributes.rstrip("/")]
        node = parent
        if block:
            node = self.node_ids[parent, label]
            if node not in self.built:
                self.built[node], self.parent[node] = [], parent
            self.built[parent].append(label)
        if own_content == ARTICLE and content == ARTICLE:
            own_noise = GONE  # an article within an article is a comment on it
        elif own_content >= MAIN and noise == FORM:
            noise = 0  # a form around the whole page
        if own_noise and content and (tag == "header" or tag in ("div", "section") and "header" in label.split(".")):
            own_noise, heads = 0, True
        if own_noise > noise and not block:
            self._flush()
        self.where.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node, max(noise, own_noise), max(content, own_content), heads))

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        at = self._last((tag,))
        # an inline element that a block was opened in is left to that block's end
        if at and (tag in BLOCKS or self.open[at][1] == self.open[-1][1]):
            self._pop(at)

    def kept(self, noisy: frozenset[int] = frozenset(), named: frozenset[int] = frozenset()) -> str:
        """The main text: ``noisy`` nodes go, within named content only those in ``named``."""
        fine = [b for b in self.blocks if not b[3]]
        region = max((b[2] for b in fine if b[2] >= MAIN), default=0)
        out = []
        for text, node, content, _, linked in fine:
            if region:
                keep = content >= region and node not in named
            elif content:
                keep = node not in named
            else:
                keep = node not in noisy and linked < LINKS
            if keep:
                out.append(text)
        return "\n".join(out)


def host_of(url: Column) -> Column:
    """The host, lower-cased; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


_FEATURES = [("node", T.ArrayType(T.LongType())), ("parent", T.ArrayType(T.LongType())), ("text", T.ArrayType(T.BooleanType())), ("feature", T.ArrayType(T.LongType())), ("page", T.LongType())]


def _features():
    """A batch's pages as numbers: for each node one way it is built and its different texts."""

    def run(batch: pa.RecordBatch) -> list:
        out = [[], [], [], [], []]
        for html in texts(batch, "html"):
            page = Page(html)
            rows = {}
            for node, kinds in page.built.items():
                alike = [k for i, k in enumerate(kinds) if not i or k != kinds[i - 1]]
                rows[node, False, _hash(" ".join(alike))] = None
            for text, node, *_ in page.blocks:
                rows[node, True, _hash(text)] = None
            for column, values in zip(out, ([r[0] for r in rows], [page.parent[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows]), strict=False):
                column.append(values)
            out[4].append(_hash("\n".join(b[0] for b in page.blocks if not b[3])))
        return out

    return run


def style_trees(pages: DataFrame) -> DataFrame:
    """``host, node, pages, different, importance``: the merged trees of all hosts, a row a node.

    ``pages`` have the node; ``different`` is the number of different main texts of the host, about. The importance is that
    of the content and, as far as few pages have the node, of the branch it lies in.
    """
    read = map_batches(pages.select(host_of(F.col("url")).alias("host"), "html"), _features, _FEATURES, ["host"])
    read = read.withColumn("host", F.xxhash64("host"))
    read = written(read, "html-features")
    each = read.select("host", F.inline(F.arrays_zip("node", "parent", "text", "feature")))
    counted = each.groupBy("host", "node", "text", "feature").agg(F.count("*").alias("k"), F.first("parent").alias("parent"))
    style, text = ~F.col("text"), F.col("text")
    k = F.col("k").cast("double")
    nodes = counted.groupBy("host", "node").agg(
        F.first("parent").alias("parent"),
        F.sum(F.when(style, F.col("k"))).alias("pages"),
        F.sum(F.when(style, k * F.log(k))).alias("spread"),
        F.count_if(style).alias("ways"),
        F.sum(F.when(text, F.log(k))).alias("repeated"),
        F.count_if(text).alias("texts"),
    )
    nodes = nodes.withColumn("pages", F.coalesce("pages", F.lit(1)))
    whole = F.log(F.col("pages").cast("double"))
    alone = F.col("pages") < 2
    nodes = nodes.select(
        "host", "node", "parent", "pages", "ways", "texts",
        F.when(alone, 1.0).otherwise((whole - F.col("spread") / F.col("pages")) / whole).alias("presentation"),
        F.when(F.col("texts") > 0, F.when(alone, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("repeated") / (F.col("texts") * whole)))).alias("content"),
    )
    nodes = written(nodes, "html-nodes")  # one row for each kind of node and host
    leaves = nodes.where("texts > 0").select("host", F.explode(F.array("node", "parent")).alias("node"), "pages", "content")
    below = leaves.groupBy("host", "node").agg((F.sum(F.col("content") * F.col("pages")) / F.sum("pages")).alias("below"))
    share = F.pow(F.lit(GAMMA), F.col("ways"))
    branch = nodes.join(below, ["host", "node"]).select("host", F.col("node").alias("parent"), ((1 - share) * F.col("presentation") + share * F.col("below")).alias("branch"))
    sites = read.groupBy("host").agg(F.approx_count_distinct("page").alias("different"))
    found = nodes.where("texts > 0").join(branch, ["host", "parent"], "left").join(sites, "host")
    drawn = (F.col("pages") * F.col("content") + BRANCH_PAGES * F.coalesce("branch", "content")) / (F.col("pages") + BRANCH_PAGES)
    return found.select("host", "node", "pages", "different", drawn.alias("importance"))


def _extractor(noisy_column: str, named_column: str):
    def make():
        def run(batch: pa.RecordBatch) -> list:
            sets = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (noisy_column, named_column)]
            found = [Page(html).kept(frozenset(a or ()), frozenset(b or ())) for html, a, b in zip(texts(batch, "html"), *sets, strict=True)]
            return [found, [len(t) for t in found]]

        return run

    return make


def extract(pages: DataFrame) -> DataFrame:
    """The pages with ``text`` and ``n_chars``, the main text and its code points.

    Defined results: a null html gives the empty text, a null url or one without ``://`` the host ''; repeated and tied
    rows are each extracted; broken markup is read to its end, an unended comment or script swallows the rest as in a
    browser; a very long page is one row's work, linear in its length. Columns named ``text`` and ``n_chars`` give way to
    the new ones, others stay. An empty table gives no rows.
    """
    tree = style_trees(pages)
    bad = F.col("importance") < F.when(F.col("pages") >= PAGES, NOISE).otherwise(0.0)
    sure = (F.col("importance") < NAMED) & (F.col("pages") >= NAMED_PAGES) & (F.col("different") >= NAMED_PAGES)
    noisy, named, host, salt = (unused(pages, f"_html_{n}") for n in ("noisy", "named", "host", "salt"))
    by_host = tree.where(bad | sure).groupBy(F.col("host").alias(host)).agg(F.collect_list(F.when(bad, F.col("node"))).alias(noisy), F.collect_list(F.when(sure, F.col("node"))).alias(named))
    by_host = written(by_host, "html-noise")
    keyed = pages.withColumn(host, F.xxhash64(host_of(F.col("url"))))
    n = by_host.agg(F.coalesce(F.sum(F.size(noisy) + F.size(named) + 1), F.lit(0))).first()[0]
    if n <= SENT:
        joined = keyed.join(F.broadcast(by_host), host, "left")
    else:  # a hot host's pages are dealt out over the salts
        dealt = by_host.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(dealt, [host, salt], "left")
    return map_batches(joined, _extractor(noisy, named), [("text", T.StringType()), ("n_chars", T.LongType())], pages.columns)
