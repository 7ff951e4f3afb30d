"""Operator 6: main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements; text between block boundaries
hangs below the element that holds it.  Every node is content or boilerplate.
Parent-child potentials tie a node to its parent, node potentials speak for its
tag, its class and id words, its share of linked text and its length.  One
upward and one downward sweep of sum-product messages give the exact marginal
of each node; text whose content marginal is above one half is the page's text.
Potentials are trained by smoothed counts from labelled pages, which a rule
makes (no two alike in names, order or nesting).

Cases: null html counts as empty and gives empty text; null urls and ids are
kept; broken, unclosed or cut-off markup is read on (a tag cut off by the end of
the page is dropped; what cannot stand in a head ends it, a block ends a drawing); character references are decoded once, as browsers do;
repeated rows are extracted each; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of the HTML standard by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template svg head title object iframe canvas audio video select textarea datalist".split())
IN_HEAD = set("html head base basefont bgsound link meta title noscript noframes style script template".split())
RAW = set("script style textarea title noscript iframe".split())
BLOCK = set(
    "html body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption form fieldset legend address details summary hr center dialog menu hgroup search".split()
)
CLOSES_P = BLOCK - {"html", "body", "li", "dt", "dd", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "legend", "summary", "figcaption"}
SAME_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

MARKUP = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?>(?:[^>"'=]++|=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|[="'])*+))(?P<end>>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
NAME_WORD = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")


@dataclass
class Node:
    """A block element, or text that stands directly in one (tag ``#text``)."""

    tag: str
    names: tuple[str, ...] = ()
    parent: int = -1
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    label: int | None = None

    @property
    def text(self) -> str:
        return SPACES.sub(" ", html.unescape("".join(self.parts))).strip()


def parse(page: str) -> list[Node]:
    """Nodes of the page, parents before children, in page order."""
    nodes = [Node("#root")]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and the block node each stands in
    opened = Counter(["#root"])
    hidden = links = 0
    current: Node | None = None
    at = 0

    def write(text: str) -> None:
        nonlocal current
        if stack[-1][0] == "head" and text and not text.isspace():
            pop(len(stack) - 1)  # text ends a head whose end tag is left out
        if hidden or not text:
            return
        if current is None:
            if text.isspace():
                return
            nodes.append(current := Node("#text", parent=stack[-1][1]))
        current.parts.append(text)
        if links:
            current.linked += len(text)

    def pop(to: int) -> None:
        nonlocal hidden, links, current
        while len(stack) > to:
            tag, _ = stack.pop()
            opened[tag] -= 1
            hidden -= tag in UNSEEN
            links -= tag == "a"
            if tag in BLOCK:
                current = None

    def innermost(tags: set[str], stops: set[str]) -> int | None:
        if not any(opened[t] for t in tags):  # so deep pages are not searched for what is not open
            return None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stops:
                return None
        return None

    while m := MARKUP.search(page, at):
        write(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or not m["end"]:
            continue
        if m["close"]:
            stops = {"table", "#root"} if tag in BLOCK else BLOCK - {"p", "li"}
            k = innermost({tag}, stops - {tag})
            if k is not None:
                pop(k)
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            pop(len(stack) - 1)
        if tag in BLOCK and (k := innermost({"svg"}, {"foreignobject", "desc"})) is not None:
            pop(k)  # a block ends a drawing, but for the places in it that hold HTML
        if tag == "br":
            write(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                current = None
            continue
        if tag in CLOSES_P and (k := innermost({"p"}, {"table", "button", "td", "th", "foreignobject", "desc"})) is not None:
            pop(k)
        if tag in SAME_CLOSES and (k := innermost(*SAME_CLOSES[tag])) is not None:
            pop(k)
        if tag == "a" and (k := innermost({"a"}, BLOCK)) is not None:
            pop(k)
        if tag == "body" and (k := innermost({"head"}, set())) is not None:
            pop(k)
        if m["rest"].endswith("/") and tag not in BLOCK:
            continue
        owner = stack[-1][1]
        if tag in BLOCK and not hidden:
            words = tuple(sorted({w for a in ATTRIBUTE.finditer(m["rest"]) for w in NAME_WORD.findall((a[2] or a[3] or a[4] or "").lower())}))
            nodes.append(Node(tag, words, owner))
            owner, current = len(nodes) - 1, None
        stack.append((tag, owner))
        opened[tag] += 1
        hidden += tag in UNSEEN
        links += tag == "a"
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else len(page)
    if at < len(page):
        write(page[at:])
    return nodes


def bucket(n: int) -> int:
    return min(n.bit_length(), 12)


def features(node: Node) -> list[tuple]:
    if node.tag == "#text":
        size = sum(map(len, node.parts))
        return [("size", bucket(size) // 3), ("linked", int(4 * node.linked / max(size, 1)))]
    return [("tag", node.tag), *(("name", n) for n in node.names)]


@dataclass
class TreeModel:
    """Log potentials: of a node's features by label, of (parent, child) labels, and of the root."""

    node: dict[tuple, np.ndarray]
    edge: np.ndarray

    def content_marginals(self, nodes: list[Node]) -> np.ndarray:
        """P(content) of each node, by exact sum-product on the tree."""
        n = len(nodes)
        own = np.zeros((n, 2))
        for i, x in enumerate(nodes):
            for f in features(x):
                if f in self.node:
                    own[i] += self.node[f]
        own[0] += (0.0, -20.0)  # the page as a whole is no content
        up, sent = own.copy(), np.zeros((n, 2))
        e = self.edge
        for i in range(n - 1, 0, -1):  # children stand after their parents
            u0, u1 = up[i]
            sent[i] = np.logaddexp(e[:, 0] + u0, e[:, 1] + u1)
            up[nodes[i].parent] += sent[i]
        belief = up.copy()
        for i in range(1, n):
            outside = belief[nodes[i].parent] - sent[i]
            belief[i] = up[i] + np.logaddexp(outside[0] + e[0], outside[1] + e[1])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def train_model(pages: list[list[Node]], smooth: float = 0.5) -> TreeModel:
    """Potentials from labelled trees: log ratios of smoothed counts."""
    moves = np.full((2, 2), smooth)
    seen: dict[tuple, np.ndarray] = defaultdict(lambda: np.full(2, smooth))
    groups: dict[tuple, np.ndarray] = defaultdict(lambda: np.full(2, 2 * smooth))
    for nodes in pages:
        for x in nodes[1:]:
            moves[nodes[x.parent].label, x.label] += 1
            for f in features(x):
                seen[f][x.label] += 1
                groups[(x.tag == "#text", f[0])][x.label] += 1
    node = {f: np.log(c / (groups[(f[0] in ("size", "linked"), f[0])])) for f, c in seen.items()}
    return TreeModel({f: v - v.max() for f, v in node.items()}, np.log(moves / moves.sum(axis=1, keepdims=True)))


# Names that the labelled pages use; fixed words, as page authors write them.
CONTENT_NAMES = "article post entry content main story body text page".split()
BOILERPLATE = {
    "nav": ("nav", "nav navbar menu navigation breadcrumb breadcrumbs links topbar toolbar pagination pager tabs".split()),
    "header": ("header", "header masthead banner top logo branding site".split()),
    "footer": ("footer", "footer copyright bottom legal colophon credits".split()),
    "aside": ("aside", "sidebar side aside widget related recommended popular trending more".split()),
    "ad": ("div", "ad ads advert advertisement sponsor sponsored promo promotion banner adsense outbrain taboola".split()),
    "notice": ("div", "notice cookie consent cookies gdpr alert popup modal overlay message warning paywall".split()),
    "form": ("form", "form newsletter subscribe signup login search contact".split()),
    "comments": ("section", "comments comment reply replies respond discussion disqus thread responses".split()),
    "share": ("div", "share social sharing buttons follow tags meta byline".split()),
}


def labelled_pages(n: int = 400, seed: int = 11) -> list[list[Node]]:
    """Labelled trees of made pages; every text carries its label in a mark that is then removed."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(1, 9)))

    def sentence() -> str:
        return " ".join(word() for _ in range(min(int(draw.paretovariate(0.7)), 200))).capitalize() + draw.choice(["", ".", ".", "!", "?"])

    def block(mark: str, link: float) -> str:
        text = f"{mark}{sentence()}"
        if draw.random() < link:
            return draw.choice(["<ul><li><a href=x>{0}</a></li><li><a href=y>{0}</a></li></ul>", "<a href=x>{0}</a>", "<p><a href=x>{0}</a></p>"]).format(text)
        return draw.choice(["<p>{}</p>", "<p>{}", "{}", "<div>{}</div>", "<h3>{}</h3>", "<ul><li>{}</li></ul>", "<p><b>{}</b></p>", "<span>{}</span>"]).format(text)

    def attribute(names: list[str]) -> str:
        return draw.choice(['class="{}"', 'id="{}"', 'class="x {}"', 'class="{}-box"', 'role="{}"']).format(draw.choice(names))

    def boilerplate() -> str:
        kind = draw.choice(list(BOILERPLATE))
        tag, names = BOILERPLATE[kind]
        own = tag != "div" and draw.random() < 0.6
        tag = tag if own else draw.choice(["div", "div", "section", "ul"])
        link = 0.8 if kind in ("nav", "aside", "share") else 0.25
        inner = "".join(block("\x01", link) for _ in range(draw.randint(1, 5)))
        return f"<{tag}{'' if own and draw.random() < 0.6 else ' ' + attribute(names)}>{inner}</{tag}>"

    def content() -> str:
        parts = [draw.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>"]).format("\x02" + sentence())]
        for _ in range(draw.randint(1, 12)):
            text = "\x02" + sentence()
            parts.append(draw.choice(["<p>{}</p>"] * 5 + ["<p><b>{}<br>", "<h2>{}</h2>", "<ul><li>{0}</li><li>{0}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<p>{} <a href=x>link</a></p>", "<p><a href=x>{}</a></p>", "<figure><figcaption>{}</figcaption></figure>"]).format(text))
            if draw.random() < 0.1:
                parts.append(boilerplate())
        return "".join(parts)

    trees = []
    for _ in range(n):
        tag = draw.choice(["article"] * 5 + ["main", "main", "div", "div", "section"])
        mark = "" if tag in ("article", "main") and draw.random() < 0.6 else " " + attribute(CONTENT_NAMES)
        middle = f"<{tag}{mark}>{content()}</{tag}>"
        for _ in range(draw.randint(0, 2)):
            middle = draw.choice(["<div class='wrap'>{}</div>", "<div>{}</div>", "<div id='container'>{}</div>", "<main>{}</main>"]).format("".join([*(boilerplate() for _ in range(draw.randint(0, 1))), middle, *(boilerplate() for _ in range(draw.randint(0, 2)))]))
        before, after = ("".join(boilerplate() for _ in range(draw.randint(1, 4))) for _ in range(2))
        nodes = parse(f"<html><head><title>x</title></head><body>{before}{middle}{after}</body></html>")
        kinds = [Counter() for _ in nodes]
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].tag == "#text":
                raw = "".join(nodes[i].parts)
                kinds[i]["\x02" if "\x02" in raw else "\x01"] += 1
                nodes[i].parts = [p.replace("\x01", "").replace("\x02", "") for p in nodes[i].parts]
            if i:
                kinds[nodes[i].parent] += kinds[i]
        for i, x in enumerate(nodes):
            wrapper = x.tag in ("#root", "html", "body") or (x.tag != "#text" and kinds[i]["\x01"] > kinds[i]["\x02"])
            x.label = int(bool(kinds[i]["\x02"]) and not wrapper)
        trees.append(nodes)
    return trees


def main_text(page: str, model: TreeModel) -> str:
    nodes = parse(page)
    wanted = model.content_marginals(nodes) > 0.5
    blocks = (x.text for x, w in zip(nodes, wanted, strict=True) if w and x.tag == "#text")
    return "\n".join(b for b in blocks if b)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    held = pages.sparkSession.sparkContext.broadcast(model or train_model(labelled_pages()))
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(page, held.value) if page else "" for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
