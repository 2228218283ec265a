"""Main-text extraction by minimum-cut labelling.

A page is read once into blocks (runs of text between block-level tags) with
their DOM paths. Each block has a cost of calling it content and a cost of calling
it boilerplate: the capacities to the two terminals. They are the log-odds of a linear
classifier over what a block looks like (its length, link density, kind of element,
how it ends, how much of the page's text stands with it under one parent) plus the evidence of
names, if the page has any (elements such as nav or article, words in class, id and role).
Neighbours in page order and blocks close in the DOM are tied by smoothness edges.
The minimum cut is the labelling of least total cost; the source side is the article.

The classifier is fitted on a sample of at most about `fit_pages` pages, whose blocks
label themselves where a page names its parts; it so carries over to pages
that don't. Without such pages its weights are the prior ones.

Blocks of the same parent element with the same features are joined into one
node (their capacities add), and components are solved by augmenting paths; so a
page costs about as much as it has distinct runs, however long it is.

Some elements are never text (scripts, styles, forms and the like) and fall out
when the page is read.

Edge cases: null or empty html, or a page without content, gives an empty text;
unclosed and stray tags are repaired by the usual implied ends; text is never
cut; repeated page ids are pages of their own; other columns are kept or ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, map_batches, table, without

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
NEVER = frozenset("head script style textarea title noscript iframe template select button form svg math object canvas audio video map dialog".split())
AROUND = frozenset("nav header footer aside menu".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id and role that speak for or against an element; weights of the classifier.
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising adslot banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead sidebar side rail widget related recommended share sharing social follow subscribe newsletter signup login cookie cookies consent gdpr notice alert modal popup overlay comment comments disqus reply replies respond discussion reactions form search searchbox pagination pager tags toolbar copyright legal disclaimer skip complementary contentinfo toc outbrain taboola paywall".split())
GOOD_WORDS = frozenset("article articlebody body content entry main post story text hentry page".split())
#: Words by which a class says how a page is laid out, not what the element is.
LAYOUT_WORDS = frozenset("with has no without layout wrap wrapper container columns grid".split())
#: Log-odds that names add.
NAMES = {"around": -6.0, "bad": -4.5, "good": 1.0, "article": 2.0, "nested": -4.5}
#: Features of a block and the classifier's prior weights.
PRIOR = {"bias": -2.0, "length": 3.0, "links": -4.0, "share": 3.0, "paragraph": 1.0, "item": -0.7, "heading": 1.0, "alone": -1.0, "sentence": 0.5, "mark": -1.5}
ADJACENT, SIBLINGS = 0.6, 1.2

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("name", "parent", "depth", "never", "around", "bad", "good", "nested", "article", "link", "key")

    def __init__(self, name: str, attributes: str, parent: Element | None, key: int):
        self.name, self.parent, self.key = name, parent, key
        words: set[str] = set()
        hidden = False
        if attributes:
            for a in ATTRIBUTE.finditer(attributes):
                value = (a[2] or a[3] or a[4] or "").lower()
                what = a[1].lower()
                if what in ("class", "id", "role", "itemprop"):
                    for token in (a[2] or a[3] or a[4] or "").split():
                        parts = set(NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()))
                        words |= parts - BAD_WORDS if parts & LAYOUT_WORDS else parts
                elif what == "hidden" or what == "aria-hidden" and value == "true" or what == "style" and "display:none" in value.replace(" ", ""):
                    hidden = True
        p = parent
        self.depth = p.depth + 1 if p else 0
        in_article = p is not None and p.article
        self.never = (p is not None and p.never) or hidden or name in NEVER
        # a header inside an article may hold its headline
        self.around = (p is not None and p.around) or name in AROUND and not (name == "header" and in_article)
        if in_article:
            words.discard("header")
        bad = bool(words & BAD_WORDS) and name not in ("body", "html") and not (name in ("article", "main") and words & GOOD_WORDS)
        self.bad = (p is not None and p.bad) or bad
        self.nested = (p is not None and p.nested) or name == "article" and in_article and not (words & GOOD_WORDS)  # comments are often articles in an article
        self.good = (p is not None and p.good) or bool(words & GOOD_WORDS) and not bad
        self.article = in_article or name in ("article", "main")
        self.link = name == "a" or (p is not None and p.link)


class Block:
    __slots__ = ("text", "element", "linked", "size")

    def __init__(self, text: str, element: Element, linked: int, size: int):
        self.text, self.element, self.linked, self.size = text, element, linked, size


def blocks(page: str) -> list[Block]:
    """Runs of text between block-level tags, in page order, references decoded and white space single."""
    out: list[Block] = []
    root = Element("html", "", None, 0)
    stack, keys = [root], 1
    parts: list[str] = []
    linked = size = 0
    owner: Element | None = None
    at, n = 0, len(page)

    def end_block() -> None:
        nonlocal parts, linked, size, owner
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text and owner is not None:
                out.append(Block(text, owner, linked, size))
        parts, linked, size, owner = [], 0, 0, None

    def block_of(e: Element) -> Element:
        while e.parent is not None and e.name not in BLOCK:
            e = e.parent
        return e

    def add(raw: str) -> None:
        nonlocal linked, size, owner
        top = stack[-1]
        if top.never or not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if not text.isspace():
            owner = owner or block_of(top)
            size += len(text)
            linked += len(text) if top.link else 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        m = TOKEN.match(page, lt) or LOOSE.match(page, lt)
        if not m:  # a lone "<" is text
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        at = m.end()
        if m.re is TOKEN and m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                end_block()
            elif name == "br":
                parts.append(" ")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if stack[k].name in ("td", "th", "table", "article") and name not in ("table", "article", "body", "html", "main", "tr"):
                    break
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            end_block()
            if name in CLOSES_P or name in ("p",):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p":
                        del stack[k:]
                        break
                    if stack[k].name in BLOCK:
                        break
            if name == "li":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "li":
                        del stack[k:]
                        break
                    if stack[k].name in ("ul", "ol", "menu"):
                        break
            elif name in ("td", "th", "tr", "dt", "dd"):
                same = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in same:
                        del stack[k:]
                        break
                    if stack[k].name in ("table", "dl"):
                        break
        if name in VOID:
            continue
        attributes = m[3] or ""
        if attributes.endswith("/") and name not in BLOCK and name not in RAW:
            continue
        e = Element(name, attributes, stack[-1], keys)
        keys += 1
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if name == "script" and close is None or close is None:
                at = n
                continue
            if not e.never:
                stack.append(e)
                add(page[at : close.start()])
                stack.pop()
            at = close.end()
            continue
        stack.append(e)
    end_block()
    return out


SENTENCE = re.compile("[.!?\u2026:;\"'\u201d\u00bb)]\\Z")
MARK = re.compile("[\u00a9|\u00b7\u2022\u203a]")


def features(found: list[Block]) -> list[tuple[int, ...]]:
    """What each block looks like, in small whole numbers, in the order of PRIOR (less the bias); then its names: around, bad, good, article, nested."""
    total = max(1, sum(len(b.text) for b in found))
    size, count = Counter(), Counter()
    for b in found:
        parent = (b.element.parent or b.element).key
        size[parent] += len(b.text)
        count[parent] += 3 if b.element.name in HEADINGS else 1  # with a heading, a block is not alone
    out = []
    for b in found:
        e = b.element
        parent = (e.parent or e).key
        looks = (
            min(6, int(2 * math.log10(len(b.text)))),
            round(4 * b.linked / max(b.size, 1)),
            round(8 * size[parent] / total),
            e.name in ("p", "blockquote", "pre"),
            e.name in ("li", "td", "th", "dt", "dd"),
            e.name in HEADINGS,
            count[parent] < 3,
            SENTENCE.search(b.text) is not None,
            MARK.search(b.text) is not None,
        )
        out.append((*map(int, looks), int(e.around), int(e.bad), int(e.good), int(e.article), int(e.nested)))
    return out


SCALE = (6, 4, 8, 1, 1, 1, 1, 1, 1)
LOOKS = len(SCALE)


def score(f: tuple[int, ...], weights: tuple[float, ...]) -> float:
    """The log-odds that a block is content, from its looks and its names."""
    names = sum(v * x for v, x in zip(NAMES.values(), (f[LOOKS], f[LOOKS + 1], f[LOOKS + 2], f[LOOKS + 3], f[LOOKS + 4]), strict=True))
    return weights[0] + sum(w * x / s for w, x, s in zip(weights[1:], f, SCALE, strict=False)) + names


def fit(examples: dict[tuple[int, ...], tuple[int, int]], pull: float = 30.0, rounds: int = 60) -> tuple[float, ...]:
    """Logistic weights from (boilerplate, content) counts by looks, the two kinds weighing alike, drawn to the prior as by `pull` blocks; Newton's steps."""
    prior = np.array(list(PRIOR.values()))
    keys = sorted(examples)
    n = np.array([examples[k] for k in keys], float).reshape(-1, 2)
    if (n.sum(0) == 0).any():
        return tuple(prior.tolist())
    n *= n.sum() / 2 / n.sum(0)
    x = np.hstack([np.ones((len(keys), 1)), np.array(keys) / SCALE])
    w, pull = prior.copy(), pull * n.sum() / (n.sum() + pull)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (n.sum(1) * p - n[:, 1]) + pull * (w - prior)
        step = np.linalg.solve((x.T * (n.sum(1) * p * (1 - p))) @ x + pull * np.eye(len(w)), slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.round(6).tolist())


def examples(page: str) -> dict[tuple[int, ...], list[int]]:
    """looks -> [boilerplate, content]: how often blocks of the page that its names label look so."""
    out: dict[tuple[int, ...], list[int]] = {}
    for f in features(blocks(page)):
        around, bad, _, article, nested = f[LOOKS:]
        if around or bad or nested or article:
            out.setdefault(f[:LOOKS], [0, 0])[int(not (around or bad or nested))] += 1
    return out


def fitted(pages: DataFrame, fit_pages: int = 2000) -> tuple[float, ...]:
    """The classifier's weights from a sample of at most about `fit_pages` pages, chosen by hash. What is collected is a count for each of the looks, whose number is bounded by their grid."""
    n = pages.count()
    if n > fit_pages:
        pages = pages.where(F.xxhash64(F.lit(31), "html") < F.lit(int(-(1 << 63) + fit_pages / n * (1 << 64))))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: dict[tuple[int, ...], list[int]] = {}
        for html in batch.column("html"):
            for k, v in examples(html.as_py() or "").items():
                have = total.setdefault(k, [0, 0])
                have[0] += v[0]
                have[1] += v[1]
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.list_(pa.int32())), *(pa.array([v[i] for v in total.values()], pa.int64()) for i in (0, 1))], ["looks", "around", "content"])

    seen = map_batches(pages.select("html"), run, "looks array<int>, around long, content long").groupBy("looks").agg(F.sum("around").alias("around"), F.sum("content").alias("content")).collect()
    return fit({tuple(r.looks): (r.around, r.content) for r in seen})


def min_cut(source: list[float], sink: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stay on the source's side of the least cut: shortest augmenting paths, then the residual graph's reach."""
    n = len(source)
    s, t = n, n + 1
    residual: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i in range(n):  # what both terminals take alike flows at once
        through = min(source[i], sink[i])
        residual[s][i], residual[i][s] = source[i] - through, 0.0
        residual[i][t], residual[t][i] = sink[i] - through, 0.0
    for (i, j), c in ties.items():
        residual[i][j] = residual[i].get(j, 0.0) + c
        residual[j][i] = residual[j].get(i, 0.0) + c
    while True:
        came = {s: s}
        queue = deque([s])
        while queue and t not in came:
            u = queue.popleft()
            for v, c in residual[u].items():
                if c > 1e-9 and v not in came:
                    came[v] = u
                    queue.append(v)
        if t not in came:
            return [i in came for i in range(n)]
        path, v = [], t
        while v != s:
            path.append((came[v], v))
            v = came[v]
        push = min(residual[u][v] for u, v in path)
        for u, v in path:
            residual[u][v] -= push
            residual[v][u] += push


_solved: dict[tuple, list[bool]] = {}


def content(found: list[Block], weights: tuple[float, ...] = tuple(PRIOR.values())) -> list[bool]:
    """Labels of the blocks of one page."""
    nodes: list[tuple] = []  # (features, parent's key); neighbours alike are one node
    counts: list[int] = []
    of: list[int] = []
    chain: list[tuple[int, ...]] = []
    for b, f in zip(found, features(found), strict=True):
        parent = (b.element.parent or b.element).key
        if not nodes or nodes[-1] != (f, parent):
            nodes.append((f, parent))
            counts.append(0)
            chain.append(_ancestors(b.element))
        counts[-1] += 1
        of.append(len(nodes) - 1)
    ties: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, (_, parent) in enumerate(nodes):
        if i:
            shared = sum(a == b for a, b in zip(chain[i - 1], chain[i], strict=False))
            near = shared / max(len(chain[i - 1]), len(chain[i]))
            ties[i - 1, i] = ADJACENT * near
        if (j := last.get(parent)) is not None:
            ties[j, i] = ties.get((j, i), 0.0) + SIBLINGS
        last[parent] = i
    key = (weights, tuple(f for f, _ in nodes), tuple(counts), tuple((k, round(v, 6)) for k, v in ties.items()))
    labels = _solved.get(key)
    if labels is None:
        odds = [score(f, weights) * c for (f, _), c in zip(nodes, counts, strict=True)]
        labels = min_cut([max(x, 0.0) for x in odds], [max(-x, 0.0) for x in odds], ties)
        if len(_solved) > 20_000:
            _solved.clear()
        _solved[key] = labels
    return [labels[i] for i in of]


def _ancestors(e: Element | None) -> tuple[int, ...]:
    out = []
    while e is not None:
        out.append(e.key)
        e = e.parent
    return tuple(reversed(out))


def main_text(page: str | None, weights: tuple[float, ...] = tuple(PRIOR.values())) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, content(found, weights), strict=True) if keep) if found else ""


def extract(pages: DataFrame, fit_pages: int = 2000) -> DataFrame:
    """All columns of `pages` and q_text, its main text, which replaces a column of this name."""
    own = without(pages, ["q_text"])
    safe = aside(own, "html")
    names = safe.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in safe.schema)
    weights = fitted(safe, fit_pages)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = [main_text(x.as_py(), weights) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*names, "q_text"])

    return map_batches(safe, run, f"{schema}, q_text string").toDF(*own.columns, "q_text")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("q_text").alias("text"), F.length("q_text").cast("long").alias("n_chars"))
