"""Main text of web pages by minimum-cut labelling of text blocks.

A tolerant tokenizer turns a page into blocks (runs of text between block-level tags, and inline adverts) with their
ancestors. A logistic classifier, trained on a bounded sample of pages whose landmark elements label their own blocks, prices
each block as content or as boilerplate; the prices become terminal capacities. Neighbouring blocks, and blocks close in the
tree, are joined by smoothness edges. Their strength is the one that labels the sampled pages best when their landmarks are
hidden, as they are in pages without landmarks. The minimum cut (an exact reduction first, then augmenting paths) separates
the two kinds.

Formulas and xmp texts are text like any other; svg drawings and annotations of formulas are not.

Null and empty pages, and pages without text, give the empty text. Unclosed elements, comments, scripts and quotes end
with the page. Equal costs leave a block out of the content. Rows keep all their columns, repeated rows equal results.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps, stratified, table, with_field, without

# Kinds of HTML elements.
BLOCK_TAGS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul xmp".split())
HIDDEN_TAGS = set("annotation annotation-xml audio canvas datalist head iframe noscript object select svg template textarea title video".split())
VOID_TAGS = set("area base br col embed hr img input keygen link meta param source track wbr".split())
CLOSES_P = BLOCK_TAGS - {"button", "label", "option", "optgroup", "body", "html"}
BOILERPLATE_TAGS = set("aside button dialog footer form menu nav search".split())
BOILERPLATE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BOILERPLATE_WORDS = set("ad ads adbox adsense advert adverts advertisement alert banner bottombar breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header hidden legal links login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup privacy promo promoted promotion recommend recommended related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
ADVERT_WORDS = set("ad ads adbox adsense advert adverts advertisement sponsored".split())
CONTENT_WORDS = set("article articlebody body content entry main page post story text".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe)\b((?:[^>"']++|"[^"]*"|'[^']*')*+)>.*?(?:</\1\s*>|\Z)|<xmp\b((?:[^>"']++|"[^"]*"|'[^']*')*+)>(.*?)(?:</xmp\s*>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Features of a block, with the weights that the classifier's prior expects.
FEATURES = {
    "bias": -0.3, "boilerplate element": -5.0, "boilerplate word": -5.0, "header element": -3.0, "article element": 2.0, "main element": 1.5, "content word": 1.5,
    "paragraph": 0.8, "heading": 0.3, "list item": -0.2, "table cell": -0.3, "quote or code": 0.8, "log of length": 0.5, "link density": -2.5, "sentence ends": 0.7, "short": -0.5, "copyright sign": -2.0,
}
PRIOR = np.array(list(FEATURES.values()))
#: Strengths of the edges that training chooses from; a margin is a logarithm of odds.
STRENGTHS = (0.5, 1.0, 2.0, 4.0, 8.0)
LANDMARKS = [list(FEATURES).index(k) for k in ("boilerplate element", "boilerplate word", "header element", "article element", "main element", "content word")]


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    bad: bool = False
    bad_word: bool = False
    header: bool = False
    article: bool = False
    main: bool = False
    good_word: bool = False
    hidden: bool = False
    link: bool = False
    advert: bool = False


@dataclass
class Block:
    text: str
    linked: int
    node: Node


def _open(tag: str, attributes: str, parent: Node | None) -> Node:
    up = parent or Node("", None, 0)
    node = Node(tag, parent, up.depth + 1, up.bad, up.bad_word, up.header, up.article, up.main, up.good_word, up.hidden, up.link)
    node.bad |= tag in BOILERPLATE_TAGS
    node.header |= tag == "header" and not up.article
    node.article |= tag == "article"
    node.main |= tag == "main"
    node.hidden |= tag in HIDDEN_TAGS
    node.link |= tag == "a"
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                words = {w.lower() for w in PART.findall(value)}
                inside = {"header"} if up.article or words & CONTENT_WORDS else set()  # the header of an article is no page header
                node.bad_word |= bool(words & BOILERPLATE_WORDS - inside) and tag not in ("body", "html")
                node.good_word |= bool(words & CONTENT_WORDS)
                node.advert |= bool(words & ADVERT_WORDS) and tag not in BLOCK_TAGS
            elif name == "role":
                node.bad |= value.lower() in BOILERPLATE_ROLES
                node.main |= value.lower() == "main"
                node.article |= value.lower() == "article"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                node.hidden = True
    return node


def blocks(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    root = top = Node("", None, 0)
    pieces: list[str] = []
    linked, owner, at = 0, root, 0

    def end() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, linked, owner))
            pieces.clear()
            linked = 0

    def said(text: str) -> None:
        nonlocal linked, owner
        if not text or top.hidden:
            return
        if not pieces:
            if text.isspace():
                return
            owner = top
            while owner.parent is not None and owner.tag not in BLOCK_TAGS and not owner.advert:
                owner = owner.parent
        pieces.append(text)
        if top.link:
            linked += len(text.strip())

    def foreign() -> bool:
        node = top
        while node is not None and node.tag not in ("svg", "math"):
            node = node.parent
        return node is not None

    while m := TOKEN.search(page, at):
        said(page[at : m.start()])
        at = m.end()
        if m[1] and m[2].endswith("/") and foreign():  # an empty element there; in HTML the slash means nothing
            at = m.end(2) + 1
        slash, tag, attributes = ("", "xmp", m[3]) if m[4] is not None else (m[5], m[6], m[7]) if m[6] else (m[8], m[9], m[10])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            end()
        if slash:
            node = top
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                if node.advert:
                    end()
                top = node.parent
        elif tag == "br":
            said(" ")
        elif tag not in VOID_TAGS:
            if tag == "body" or top.tag == "head" and tag not in ("script", "style", "title", "base", "link", "meta", "noscript", "template"):
                while top.parent is not None and top.tag == "head":
                    top = top.parent
            if tag in CLOSES_P or tag in ("li", "td", "th", "tr", "dd", "dt", "option"):
                node = top
                same = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}.get(tag, ()) + ("p",)
                while node.parent is not None and node.tag not in same and (node.tag not in BLOCK_TAGS or node.tag in ("td", "th") and "tr" in same):
                    node = node.parent
                if node.tag in same:
                    top = node.parent
            if not attributes.endswith("/") or tag in BLOCK_TAGS:
                top = _open(tag, attributes, top)
                if top.advert:
                    end()
            if m[4] is not None:
                said(html.escape(m[4]))
                end()
                top = top.parent
    said(page[at:])
    end()
    return out


def features(found: list[Block]) -> np.ndarray:
    rows = []
    for b in found:
        n, t = len(b.text), b.node
        heading = len(t.tag) == 2 and t.tag[0] == "h" and t.tag[1].isdigit()
        ends = b.text.count(". ") + b.text.count("? ") + b.text.count("! ") + b.text.endswith((".", "?", "!"))
        rows.append((1, t.bad, t.bad_word, t.header, t.article, t.main, t.good_word, t.tag == "p", heading, t.tag in ("li", "dd", "dt"), t.tag in ("td", "th"), t.tag in ("blockquote", "pre", "xmp"), math.log1p(n) / 4, min(1.0, b.linked / max(1, n)), min(1.0, ends / 3), n < 25, "©" in b.text))
    return np.array(rows, float).reshape(len(rows), len(PRIOR))


def fit(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps with a Gaussian prior around the expected weights."""
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """Weights of the features, and the strength of the smoothness edges."""

    weights: np.ndarray
    smooth: float = 1.0


def labelled(page: str) -> tuple[list[Block], np.ndarray, np.ndarray]:
    """Blocks of a page, and for those under landmarks of one kind only (their places) whether they are content."""
    found = blocks(page)
    x = features(found)
    bad, good = x[:, 1:4].any(1), x[:, 4:6].any(1)
    known = np.flatnonzero(bad != good)
    return found, known, good[known]


def learn(pages: list[str]) -> Model:
    """A model from pages that label themselves: blocks under landmarks of one kind only; every second row hides its landmarks.

    Landmarks say what a block is, but other pages lack them: the hidden half teaches length, links and punctuation. Of equal
    errors the strength nearest 1 wins.
    """
    known = [(found, places, good) for found, places, good in map(labelled, pages) if len(places)]
    if not known:
        return Model(PRIOR.copy())
    x = np.concatenate([features(found)[places] for found, places, _ in known])
    y = np.concatenate([good for _, _, good in known]).astype(float)
    blind = x.copy()
    blind[:, LANDMARKS] = 0
    model = Model(fit(np.concatenate([x, blind]), np.concatenate([y, y]), strength=max(1.0, len(x) / 100)))  # the prior keeps a say
    wrong = {s: sum(int((labels(found, Model(model.weights, s), hide=True)[places] != good).sum()) for found, places, good in known) for s in STRENGTHS}
    model.smooth = min(STRENGTHS, key=lambda s: (wrong[s], abs(math.log(s))))
    return model


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours, falling with their distance in the tree, and between blocks of one parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            x, y, far = found[i - 1].node, b.node, 0
            while x is not y:
                far += 1
                if x.depth >= y.depth and x.parent is not None:
                    x = x.parent
                elif y.parent is not None:
                    y = y.parent
            out.append((i - 1, i, 1.0 / (1.0 + far)))
        k = id(b.node.parent)
        if k in last and last[k] < i - 1:
            out.append((last[k], i, 0.25))
        last[k] = i
    return out


def minimum_cut(content: np.ndarray, boilerplate: np.ndarray, joins: list[tuple[int, int, float]]) -> np.ndarray:
    """True for the blocks on the content side of the cheapest cut.

    ``content[i]`` is the price of calling i content, ``boilerplate[i]`` of calling it boilerplate; a join costs its weight if
    its ends differ. A block whose own price difference exceeds all its joins is settled first (no cheapest cut has it
    otherwise), and its joins become prices of its neighbours; what is left goes to augmenting paths.
    """
    n = len(content)
    net = (boilerplate - content).tolist()  # over 0: content is cheaper
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in joins:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(net[i]) > sum(near[i].values()):
            side[i] = net[i] > 0
            for j, w in near[i].items():
                net[j] += w if side[i] else -w
                del near[j][i]
                queue.append(j)
    left = [i for i in range(n) if side[i] is None]
    if left:
        source, sink = n, n + 1
        cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in left} | {source: {}, sink: {}}
        for i in left:
            if net[i] > 0:
                cap[source][i], cap[i][source] = net[i], 0.0
            elif net[i] < 0:
                cap[i][sink], cap[sink][i] = -net[i], 0.0
        while True:
            before, todo = {source: source}, deque([source])
            while todo and sink not in before:
                a = todo.popleft()
                for b, c in cap[a].items():
                    if c > 1e-12 and b not in before:
                        before[b] = a
                        todo.append(b)
            if sink not in before:
                break
            path, b = [], sink
            while b != source:
                path.append((before[b], b))
                b = before[b]
            flow = min(cap[a][b] for a, b in path)
            for a, b in path:
                cap[a][b] -= flow
                cap[b][a] = cap[b].get(a, 0.0) + flow
        for i in left:
            side[i] = i in before
    return np.array(side, bool)


def labels(found: list[Block], model: Model, hide: bool = False) -> np.ndarray:
    """Which blocks are content by the minimum cut; ``hide`` takes the landmarks away."""
    x = features(found)
    if hide:
        x[:, LANDMARKS] = 0
    margin = x @ model.weights
    return minimum_cut(np.logaddexp(0, -margin), np.logaddexp(0, margin), [(i, j, model.smooth * w) for i, j, w in edges(found)])


def extract_text(page: str | None, model: Model) -> str:
    """Main text of one page."""
    found = blocks(page or "")
    if not found:
        return ""
    return " ".join(b.text for b, k in zip(found, labels(found, model)) if k)


def train(pages: DataFrame, n_pages: int = 300, key: str = "page_id") -> Model:
    """A model from a bounded sample: about ``n_pages`` pages drawn by hash from all."""
    drawn = stratified(pages.select(key, "html").where(F.col("html").isNotNull()).withColumn("all", F.lit(1)), "all", F.col(key), n_pages, F.lit(""))
    return learn(sorted(r[0] for r in drawn.select("html").distinct().collect()))


def extract(df: DataFrame, model: Model, page: str = "html", output: str = "text") -> DataFrame:
    """Add ``output``: the main text of every whole page."""
    df = without(df, output)
    at = df.columns.index(page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, at):
                made = pa.array([extract_text(t.as_py(), model) for t in part.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, output])

    return df.mapInArrow(run, with_field(df.schema, T.StructField(output, T.StringType())))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
