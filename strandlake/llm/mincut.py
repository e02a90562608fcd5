"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A logistic classifier looks at the text of each block (its length, how it ends, how much
of it is linked, what it says); its two costs are the block's capacities to the terminals. Smoothness edges join blocks that
follow each other, weighing less the farther apart they are in the document tree, and successive blocks under one parent that
others stand between. Every element whose tag or name marks it as the page's content, or as boilerplate, is a node of its
own, tied to its side, and pulls the blocks within by an edge each; where there is a content element, blocks outside of any
hang by a weaker edge on a node tied to boilerplate. A maximum flow separates the two sides: headings, short lines and link
lists of an article are content against their own score, a sentence between menu entries or in an advert is not.

The classifier's weights are learned from a bounded sample of pages: within pages that mark their content, blocks are labelled
by the marks around them; the weights found are those most probable under a prior around PRIOR, which holds where no page
marks anything.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_sample, expand_texts, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z-]+)(?=[\s/>])")
SPLIT = re.compile(r"[^a-z]+")

# Elements by their part in a page, and words of class, id and role names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text up to the closing tag is not markup; unclosed, they reach to the page's end.
RAW = frozenset("script style textarea title".split())
#: Left out with all they hold; unclosed, only the tag is.
UNSEEN = frozenset("noscript template select svg math iframe object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split())
SELF_CLOSING = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "td th tr", "td": "td th", "th": "td th", "option": "option"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription signup signin login share sharing sharebar social comment comments commentlist reply replies respond "
    "disqus discussion sidebar side rail widget widgets related recommended recommendations nav navbar navigation menu menus breadcrumb breadcrumbs footer foot "
    "header masthead toolbar topbar search searchbox popup modal overlay pagination pager copyright legal skip outbrain taboola tracking paywall form".split()
)
#: Words that qualify what follows; a name that begins with one means boilerplate whatever it ends with.
FIRST_WORDS = frozenset("ad ads advert advertisement sponsored sponsor promoted promo related recommended cookie outbrain taboola".split())
#: Words of a name that say where or how, not what.
PLACE_WORDS = frozenset("left right top bottom inner outer wrapper wrap container box block list item items slot bar area section unit main site page primary secondary global fixed sticky mobile desktop content text body link links title js".split())
CONTENT_WORDS = frozenset("article articlebody post entry story main maincontent".split())
#: What notices, adverts and page ends say of themselves.
SAYS = re.compile(r"\b(?:cookies?|newsletter|subscribe|sign (?:up|in)|log ?in|privacy policy|terms of (?:use|service)|all rights reserved|advertisements?|sponsored|accept all)\b|©", re.I)

SCALE = 1000
#: Weight of an edge between neighbours, over one more than their distance in the tree; of a block's edge to the content
#: element around it, to an element named as boilerplate, to one whose name hints at it, and, outside of all content
#: elements, to the boilerplate.
SMOOTH, WITHIN, NAMED, HINTED, OUTSIDE = 3.0, 4.0, 9.0, 1.5, 0.5
#: Ties of content elements and of boilerplate. An element marked as content that holds little else than what looks like
#: boilerplate (a card of links) goes to the other side; one named as boilerplate doesn't, whatever it holds.
TIE, SURE = 40.0, 1e6
#: Features of a block and the prior of their weights.
PRIOR = {"bias": -0.3, "words": 2.4, "ends": 0.8, "linked": -3.5, "heading": 0.8, "says": -2.5}
#: Bounds of the pages that are learned from and of the blocks of each; worth of the sample against a prior of deviation 1.
SAMPLE_PAGES, SAMPLE_BLOCKS, WORTH = 300, 400, 100.0


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int = 0
    named: bool = False
    sure: bool = False
    hinted: bool = False
    content: bool = False
    holds_main: bool = False
    dark: Node | None = None
    hint: Node | None = None
    main: Node | None = None


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _meaning(name: str) -> tuple[bool, bool, bool]:
    """Whether a class or id names boilerplate, only hints at it, or names content. A name's last word that isn't of place
    decides: site-footer is a footer, comment-on-policy no comment."""
    words = [w for w in SPLIT.split(name) if w]
    said = [w for w in words if w not in PLACE_WORDS]
    bad = any(w in BOILER_WORDS for w in words)
    named = bool(said) and (said[-1] in BOILER_WORDS or said[0] in FIRST_WORDS)
    return named, bad and not named, not bad and any(w in CONTENT_WORDS for w in words)


def _open(tag: str, raw: str, parent: Node, nodes: list[Node]) -> Node:
    node = Node(tag, parent, parent.depth + 1)
    nodes.append(node)
    node.sure = tag in BOILER_TAGS
    node.named = tag == "header"  # unless within content, which is known later
    if "=" in raw or "hidden" in raw:
        for name, a, b, c, bare in ATTRIBUTE.findall(raw[len(tag) + 1 :]):
            name, value = (name or bare).lower(), (a or b or c).lower()
            if name in ("class", "id"):
                for one in value.split():
                    named, hinted, content = _meaning(one)
                    node.named, node.hinted, node.content = node.named or named, node.hinted or hinted, node.content or content
            elif name == "role" and value in BOILER_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                node.sure = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                node.sure = True
            elif name == "role" and value in ("main", "article") or name == "itemprop" and value == "articlebody":
                node.content = True
    node.content = (node.content or tag in CONTENT_TAGS) and not (node.named or node.sure) and tag not in ("html", "body")
    if node.content:
        up = parent
        while up is not None and not up.holds_main:
            up.holds_main = True
            up = up.parent
    return node


def _inherit(nodes: list[Node]) -> None:
    """Hands down, parents first, the boilerplate, hinting or content element around; an element that holds content isn't
    what its name says."""
    for n in nodes:
        up = n.parent
        own = n.sure or n.named and not n.holds_main and not (n.tag == "header" and up.main is not None)
        n.dark = up.dark or (n if own else None)
        n.hint = up.hint or (n if n.hinted and not n.holds_main else None)
        n.main = None if n.dark else n if n.content else up.main


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order, with the element each stands in. Markup that the page's end cuts off is dropped."""
    root = Node("", None)
    nodes: list[Node] = []
    at, out, block, link, pos = root, [], None, None, 0
    unclosed: set[str] = set()

    def ended(block: Block | None) -> None:
        if block is not None:
            out.append(block)

    while m := TOKEN.match(page, pos):
        token, pos = m.group(), m.end()
        if token[0] != "<" or len(token) == 1:
            if block is None:
                block = Block(at)
            text = html.unescape(token)
            block.parts.append(text)
            if link is not None:
                block.linked += len(text)
            continue
        if token[1] in "!?":
            continue
        tag = NAME.match(token)[1].lower()
        if token[1] == "/":
            if tag == "a":
                link = None
            if tag in INLINE:
                continue
            ended(block)
            block, up = None, at
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                at = up.parent
                if link is not None and link.depth > at.depth:
                    link = None
            continue
        if tag in RAW or tag in UNSEEN:
            if not token.endswith("/>"):
                end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
                if end:
                    pos = end.end()
                elif tag in RAW:
                    pos = len(page)
                else:
                    unclosed.add(tag)
            continue
        if tag in INLINE:
            if tag == "a":
                link = at
            elif tag in ("br", "img") and block is not None:
                block.parts.append(" ")
            continue
        ended(block)
        block = None
        if tag in VOID:
            continue
        if tag in CLOSES_P and at.tag == "p":
            at = at.parent
        for other in SELF_CLOSING.get(tag, "").split():
            if at.tag == other:
                at = at.parent
        at = _open(tag, token, at, nodes)
    ended(block)
    _inherit(nodes)
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def features(found: list[Block]) -> np.ndarray:
    """A row for each block, columns as in PRIOR."""
    out = np.zeros((len(found), len(PRIOR)))
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        out[i] = (
            1.0, min(1.0, words / 30), b.text[-1] in ".!?\"'”»…", min(1.0, b.linked / len(b.text)), b.node.tag in HEADINGS,
            min(1.0, 6 * sum(1 for _ in SAYS.finditer(b.text)) / words),
        )
    return out


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Neighbours in page order, and successive blocks under one parent that others stand between. All distances together
    are at most twice the tree's edges."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            x, y, far = found[i - 1].node, b.node, 1
            while x is not y:
                x, y, far = (x.parent, y, far + 1) if x.depth >= y.depth else (x, y.parent, far + 1)
            out.append((i - 1, i, int(SCALE * SMOOTH / far)))
        up = id(b.node.parent)
        if up in last and last[up] < i - 1:
            out.append((last[up], i, int(SCALE * SMOOTH / 6)))
        last[up] = i
    return out


def graph(found: list[Block], weights: np.ndarray) -> tuple[list[float], list[tuple[int, int, int]]]:
    """Log odds of content of blocks, then the ties of elements around them; and all edges."""
    scores, joined = (features(found) @ weights).tolist(), edges(found)
    place: dict[int, int] = {}

    def pull(i: int, node: Node | None, tie: float, weight: float) -> None:
        if id(node) not in place:
            place[id(node)] = len(scores)
            scores.append(tie)
        joined.append((i, place[id(node)], int(SCALE * weight)))

    marked = any(b.node.main is not None for b in found)
    for i, b in enumerate(found):
        if b.node.dark is not None:
            pull(i, b.node.dark, -SURE, NAMED)
        elif b.node.main is not None:
            pull(i, b.node.main, TIE, WITHIN)
        elif marked:
            pull(i, None, -SURE, OUTSIDE)
        if b.node.hint is not None and b.node.dark is None:
            pull(i, b.node.hint, -SURE, HINTED)
    return scores, joined


def cut(scores: list[float], joined: list[tuple[int, int, int]]) -> list[bool]:
    """The side of each node in a minimum cut, True for the source's (the least such side, where several cuts are least).

    The costs of a node's two labels, -log p and -log (1 - p), differ by its log odds: it hangs on the source or the sink
    by that. A node that its tie outweighs all of its edges is on that side in some minimum cut, so it is taken out and its
    edges become ties of its neighbours; what is left goes through a maximum flow by blocking flows (Dinic)."""
    n = len(scores)
    spare = [int(SCALE * max(-SURE, min(SURE, s))) for s in scores]
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, c in joined:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += (b, a)
        room += (c, c)
    loose = [sum(room[e] for e in own) for own in near]
    side = [0] * n
    queue = [i for i in range(n) if spare[i] > loose[i] or -spare[i] >= loose[i]]
    while queue:
        i = queue.pop()
        if side[i] or -loose[i] < spare[i] <= loose[i]:
            continue
        side[i] = 1 if spare[i] > loose[i] else -1
        for e in near[i]:
            j = to[e]
            if not side[j]:
                spare[j] += side[i] * room[e]
                loose[j] -= room[e]
                queue.append(j)
            room[e] = room[e ^ 1] = 0
    rest = [i for i in range(n) if not side[i]]
    while rest:
        level = [-1] * n
        reached = [i for i in rest if spare[i] > 0]
        for i in reached:
            level[i] = 0
        tops, ends = list(reached), False
        while reached and not ends:
            further = []
            for i in reached:
                for e in near[i]:
                    j = to[e]
                    if room[e] > 0 and level[j] < 0:
                        level[j] = level[i] + 1
                        ends = ends or spare[j] < 0
                        further.append(j)
            reached = further
        if not ends:
            for i in rest:
                side[i] = 1 if level[i] >= 0 else -1
            break
        turn = [0] * n
        for top in tops:
            path, i = [], top
            while spare[top] > 0:
                if spare[i] < 0:
                    flow = min(spare[top], -spare[i], *(room[e] for e in path))
                    spare[top] -= flow
                    spare[i] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    full = next((k for k, e in enumerate(path) if not room[e]), None)
                    if full is not None:
                        i = to[path[full] ^ 1]
                        del path[full:]
                    elif spare[i] == 0:
                        continue
                own = near[i]
                while turn[i] < len(own) and not (room[own[turn[i]]] > 0 and level[to[own[turn[i]]]] == level[i] + 1):
                    turn[i] += 1
                if turn[i] < len(own):
                    path.append(own[turn[i]])
                    i = to[own[turn[i]]]
                elif path:
                    i = to[path.pop() ^ 1]
                    turn[i] += 1
                else:
                    break
    return [s > 0 for s in side]


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    """Content blocks in page order, white space within each turned into one space, joined by one space; '' if none."""
    found = blocks(page or "")
    if not found:
        return ""
    side = cut(*graph(found, np.array(list(PRIOR.values())) if weights is None else weights))
    return " ".join(b.text for b, s in zip(found, side, strict=False) if s)


def evidence(page: str | None) -> np.ndarray | None:
    """Features and label of SAMPLE_BLOCKS blocks at most, evenly over the page, if it marks its content."""
    found = blocks(page or "")
    if not any(b.node.main is not None for b in found):
        return None
    some = [found[i] for i in np.unique(np.linspace(0, len(found) - 1, SAMPLE_BLOCKS).astype(int))]
    return np.column_stack([features(some), [b.node.main is not None for b in some]])


def learn(pages: list[np.ndarray]) -> np.ndarray:
    """Weights most probable after the ``evidence`` of some pages; each page counts alike."""
    prior = np.array(list(PRIOR.values()))
    if not pages:
        return prior
    every, c = np.concatenate(pages), np.concatenate([np.full(len(p), WORTH / len(pages) / len(p)) for p in pages])
    x, y, w = every[:, :-1], every[:, -1], prior.copy()
    for _ in range(30):  # Newton's method; the objective is convex
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w - np.linalg.solve(x.T @ (x * (c * p * (1 - p))[:, None]) + np.eye(len(w)), x.T @ (c * (p - y)) + (w - prior))
    return w


def fit(df: DataFrame, page: str = "html", key: str = "page_id", limit: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights learned from ``limit`` pages at most, by hash of ``key``, and SAMPLE_BLOCKS blocks of each. The prior's, where
    no page marks its content."""
    some = F.broadcast(bounded_sample(df.where(F.col(page).isNotNull() & F.col(key).isNotNull()).select(key), key, limit).distinct())  # ``limit`` keys
    rows = df.select(key, page).join(some, key).groupBy(key).agg(F.min(page).alias(page))
    seen = expand_texts(rows, page, [], {"seen": "binary"}, lambda pages, _: [[None if e is None else e.tobytes() for e in map(evidence, pages)]])
    raw = sorted(bytes(r["seen"]) for r in seen.where("seen is not null").collect())
    return learn([np.frombuffer(r).reshape(-1, len(PRIOR) + 1) for r in raw])


def extract(df: DataFrame, page: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """Adds text and n_chars in place of ``page``. Null and empty pages give ''; other columns pass through, but for any
    named text or n_chars; repeated rows are answered alike, ties between labels go to boilerplate."""
    rest = [c for c in df.columns if c not in (page, "text", "n_chars")]

    def run(pages, _):
        text = [main_text(p, weights) for p in pages]
        return [text, [len(t) for t in text]]

    return expand_texts(df, page, rest, {"text": "string", "n_chars": "bigint"}, run)


def op1_main_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page, by weights learned from a sample of the same pages. Null or empty html: ''; a null page_id
    stays null."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, weights=fit(pages))
