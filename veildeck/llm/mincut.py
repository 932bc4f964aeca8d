"""Main text of HTML pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags. A logistic classifier of a block's own features
(containers, groups of class names, links, length, punctuation) gives the log-odds that it is content; these
are the capacities to the two terminals. Smoothness edges, of about the size of an uncertain block's odds,
join blocks that follow each other, the more strongly the nearer they are in the DOM tree. The minimum cut is
the labelling of least total cost: a one-word paragraph between others stays, though it looks like a menu.

The classifier is fitted on `SAMPLE_PAGES` labelled pages, made here from a seeded grammar of page parts, as
`pages` has no labels: tags and class names are often missing or mislead there, as they do on the web.

Parsing is linear in the page: a tag that never ends drops the rest, as in browsers, and elements nested
deeper than `MOST_DEEP` count as their ancestor at that depth.

Cases: null or empty HTML and pages without content give an empty text; broken nesting, stray and missing
end tags are borne as browsers bear them; rows may repeat; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
SILENT = RAW | frozenset("head select button svg math canvas audio video object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img br wbr input".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
ENDS_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BOILER_TAGS = frozenset("nav header footer aside form menu dialog search".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Parts of class names and ids, by group; what each group tells is fitted.
NAMES = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion teaser".split(),
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay banner newsletter subscribe".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs sidebar header masthead topbar footer bottombar toolbar pagination pager related recommended".split(),
    "reader": "comment comments commentlist disqus reply replies respond".split(),
    "vague": "aside widget share sharing social follow login search copyright disclaimer legal tags rail skip signup subscription".split(),
    "text": "article content main post entry story body text".split(),
}
GROUP = {part: group for group, parts in NAMES.items() for part in parts}
FEATURES = ("bias", "boiler", "content", *NAMES, "links", "words", "stops", "heading", "item")

#: Labelled pages that the classifier is fitted on, and the weight of its ridge penalty.
SAMPLE_PAGES, RIDGE = 600, 1.0
#: Capacity between neighbours at most two steps apart in the tree; halved for each step more.
SMOOTH = 2.0
SCALE = 1000
MOST_DEEP = 500

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.DOTALL)
OTHER = re.compile(r"<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)")
#: A quote counts only after an equals sign.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
NAME_PART = re.compile(r"[a-z]+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in RAW}


class Node:
    __slots__ = ("tag", "parent", "depth", "boiler", "names", "content", "silent")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.boiler = tag in BOILER_TAGS or bool(parent and parent.boiler)
        self.content = tag in CONTENT_TAGS or bool(parent and parent.content)
        self.silent = tag in SILENT or bool(parent and parent.silent)
        self.names: frozenset[str] = parent.names if parent else frozenset()
        if attributes and "=" in attributes or "hidden" in attributes:
            for k, v in ATTRIBUTE.findall(attributes):
                k = k.lower()
                v = v.strip("\"'").lower()
                if k in ("class", "id") and tag not in ("html", "body"):
                    self.names |= {GROUP[x] for x in NAME_PART.findall(v) if x in GROUP}
                elif k == "role":
                    self.boiler |= v in BOILER_ROLES
                    self.content |= v in ("main", "article")
                elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and "display:none" in v.replace(" ", ""):
                    self.silent = True


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, white space put right, empty and silent ones left out."""
    root = Node("#root", "", None)
    stack, out, parts = [root], [], []
    opened, deeper = Counter(), Counter()  # open elements, and those too deep to be kept, by tag
    runs = [Counter()]  # open inline elements within each open block
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not stack[-1].silent:
                out.append(Block(next(n for n in reversed(stack) if n.tag not in INLINE), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        for n in reversed(stack[k:]):
            opened[n.tag] -= 1
            if n.tag in INLINE:
                runs[-1][n.tag] -= 1
            else:
                runs.pop()
        del stack[k:]

    def end(tag: str) -> None:
        if deeper[tag]:
            deeper[tag] -= 1
        elif tag == "br":
            parts.append(" ")
        elif not opened[tag]:
            if tag == "p":
                flush()
        elif tag not in INLINE or runs[-1][tag]:  # an inline one not through a block: what follows goes on within it
            if tag not in INLINE:
                flush()
            close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))

    def start(tag: str, attributes: str) -> None:
        if tag not in INLINE:
            flush()
            for due, same, stop in ((tag in ENDS_P and opened["p"], {"p"}, ENDS_P), (tag in ENDS_SAME, *ENDS_SAME.get(tag, ((), ())))):
                for k in range(len(stack) - 1, 0, -1) if due else ():
                    if stack[k].tag in same:
                        close(k)
                        break
                    if stack[k].tag in stop:
                        break
        elif tag in ("br", "img", "input"):
            parts.append(" ")
        if tag in VOID or attributes.endswith("/") and tag not in INLINE and tag not in ENDS_P:
            return
        if len(stack) > MOST_DEEP:
            deeper[tag] += 1
            return
        stack.append(Node(tag, attributes, stack[-1]))
        opened[tag] += 1
        if tag in INLINE:
            runs[-1][tag] += 1
        else:
            runs.append(Counter())

    at, n = 0, len(page)
    while at < n:
        here = page.find("<", at)
        text = page[at : here if here >= 0 else n]
        if text and not stack[-1].silent:
            text = _html.unescape(text) if "&" in text else text
            parts.append(text)
            if opened["a"]:
                linked += len(text.strip())
        if here < 0:
            break
        if m := (COMMENT if page.startswith("<!--", here) else OTHER).match(page, here):
            at = m.end()
            continue
        letter = page[here + 1 + page.startswith("/", here + 1) : here + 3][:1]
        if not (letter.isascii() and letter.isalpha()):  # a less-than sign
            if not stack[-1].silent:
                parts.append("<")
            at = here + 1
            continue
        if not (m := TAG.match(page, here)):
            break  # a tag that never ends
        at, tag = m.end(), m[2].lower()
        if m[1]:
            end(tag)
        elif tag in RAW:
            if tag not in INLINE:
                flush()
            close_ = RAW_END[tag].search(page, at)
            at = close_.end() if close_ else n
        else:
            start(tag, m[3])
    flush()
    return out


def features(b: Block) -> list[float]:
    n, words = b.node, b.text.count(" ") + 1
    stops = min(b.text.count(". ") + (b.text[-1] in ".!?"), 2)
    heading = n.tag[0] == "h" and n.tag[1:].isdigit()
    return [1.0, n.boiler, n.content, *(g in n.names for g in NAMES), b.linked / len(b.text), min(words / 12, 2.0), stops, heading, n.tag in ("li", "td", "dt", "dd")]


# --- the labelled sample


def _words(rng: random.Random, mark: str, n: int) -> str:
    return " ".join(mark + "".join(rng.choices("aeiourstln", k=rng.randint(1, 8))) for _ in range(n))


def _prose(rng: random.Random, mark: str, short: float) -> str:
    if rng.random() < short:
        return _words(rng, mark, rng.randint(1, 3)) + rng.choice([".", "", ":"])
    return " ".join(_words(rng, mark, rng.randint(2, 18)) + "." for _ in range(rng.randint(1, 6)))


def _box(rng: random.Random, tags: str, group: str | None, inner: str, named: float = 0.8) -> str:
    """inner in an element of one of the tags, mostly with a class of the group where it is a plain one."""
    tag = rng.choice(tags.split())
    plain = tag in ("div", "section")
    name = rng.choice(NAMES[group]) if group and (plain or rng.random() < 0.3) and rng.random() < named else ""
    return f"<{tag} class={name}-x>{inner}</{tag}>" if name else f"<{tag}>{inner}</{tag}>"


def _links(rng: random.Random, n: int) -> str:
    rows = [f"<a href=#>{_words(rng, 'b', rng.randint(1, 4))}</a>" for _ in range(n)]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in rows) + "</ul>" if rng.random() < 0.7 else " ".join(rows)


def labelled_page(rng: random.Random) -> str:
    """A page whose words tell its labels: those of content begin with c, others with b."""
    p = lambda mark, short=0.15: f"<p>{_prose(rng, mark, short)}</p>"
    body = [f"<h1>{_words(rng, 'c', rng.randint(2, 12))}</h1>"]
    for _ in range(rng.randint(1, 20)):
        kind = rng.random()
        if kind < 0.80:
            body.append(p("c"))
        elif kind < 0.84:
            body.append(f"<h2>{_words(rng, 'c', rng.randint(1, 6))}</h2>")
        elif kind < 0.88:
            body.append("<ul>" + "".join(f"<li>{_prose(rng, 'c', 0.5)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif kind < 0.92:  # names that mislead
            body.append(_box(rng, "div section", "vague", p("c", 0)))
        elif kind < 0.94:
            body.append(_box(rng, "div", rng.choice(["ad", "notice"]), p("b", 0.3), 1.0))
        elif kind < 0.97:
            body.append(_box(rng, "div aside", rng.choice(["menu", "vague"]), _links(rng, rng.randint(1, 5))))
        else:
            body.append(_box(rng, "form", None, p("b", 0.5)))
    parts = [_box(rng, "header div", "menu", p("b", 0.5)), _box(rng, "nav div", "menu", _links(rng, rng.randint(2, 9)))]
    parts += [_box(rng, "div", "notice", p("b", 0.2), 0.95)] * (rng.random() < 0.5) + [_box(rng, "div", "ad", p("b", 0.2), 0.95)] * (rng.random() < 0.6)
    parts.append(_box(rng, "article main div article", "text", "".join(body), 0.6))
    parts += [_box(rng, "section div", "reader", "".join(p("b", 0.2) for _ in range(rng.randint(1, 5))), 0.95)] * (rng.random() < 0.5)
    parts += [_box(rng, "aside div", "menu", p("b", 0.3) + _links(rng, 3))] * (rng.random() < 0.5)
    parts.append(_box(rng, "footer div", "menu", f"&copy; {_words(rng, 'b', rng.randint(1, 12))}."))
    return "<html><body>" + "".join(parts) + "</body></html>"


def fitted(pages: int = SAMPLE_PAGES, seed: int = 17, ridge: float = RIDGE) -> np.ndarray:
    """Weights in the order of FEATURES: logistic regression by Newton's method."""
    rng = random.Random(seed)
    found = [b for _ in range(pages) for b in blocks(labelled_page(rng))]
    x, y = np.array([features(b) for b in found], float), np.array([" c" in f" {b.text}" for b in found], float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (q * (1 - q))) @ x + ridge * np.eye(len(w)), x.T @ (y - q) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def tree_distance(a: Node, b: Node) -> int:
    d = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        d += 1
    return d


def cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling of least cost: gain above 0 is lost where a node isn't chosen, below 0 where it is;
    an edge's capacity is lost where its ends differ. By Dinic's maximum flow in whole units."""
    n = len(gain)
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]
    source, sink = n, n + 1

    def edge(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, g in enumerate(gain):
        if g > 0:
            edge(source, k, round(g * SCALE), 0)
        elif g < 0:
            edge(k, sink, round(-g * SCALE), 0)
    for a, b, c in edges:
        edge(a, b, round(c * SCALE), round(c * SCALE))
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                back = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[back] ^ 1]
                del path[back:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(e)
                a = to[e]
            elif a == source:
                break
            else:
                turn[to[path[-1] ^ 1]] += 1
                a = to[path.pop() ^ 1]


def edges_of(found: list[Block]) -> list[tuple[int, int, float]]:
    edges = [(k, k + 1, SMOOTH * 0.5 ** max(0, tree_distance(found[k].node, found[k + 1].node) - 2)) for k in range(len(found) - 1)]
    last: dict[int, int] = {}
    for k, b in enumerate(found):  # the block before under the same parent, if others lie between
        up = id(b.node.parent or b.node)
        if last.get(up, k - 1) < k - 1:
            edges.append((last[up], k, SMOOTH / 2))
        last[up] = k
    return [e for e in edges if e[2] * SCALE >= 1]


def main_text(page: str | None, weights: np.ndarray, smooth: bool = True) -> str:
    """The text of the blocks on the content side of the cut; without smoothness, of those with positive odds."""
    found = blocks(page) if page else []
    if not found:
        return ""
    odds = (np.array([features(b) for b in found], float) @ weights).tolist()
    chosen = cut(odds, edges_of(found)) if smooth else [x > 0 for x in odds]
    return "\n".join(b.text for b, c in zip(found, chosen, strict=True) if c)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    weights = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 1000):
                b = big.slice(start, 1000)
                texts = [main_text(p, weights) for p in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
