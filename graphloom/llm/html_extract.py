"""Main-text extraction: a tree-shaped graphical model over the DOM, solved by sum-product message passing.

Every element is content or not. What is seen of it gives a potential, and so does each parent with its child; both are
learned from labelled pages. Messages go up from the leaves and down from the root, after which each element's
marginal is exact. The text of a block is kept where the block's element is content with at least half the probability.
What is seen are tags, amounts of text and of sentences, shares of text in links, in the parent and in the page, the
place in the page, the siblings, and words: those that name an element, and those of short lines. The weights are
learned by the model's own marginals (the gradient of the labels' likelihood), on pages of which many have no names
or made-up ones, so names help where they are known and are not needed.

Where no block is content but there is prose (lines of sentences outside links, menus, forms and the like), the prose
is taken whose elements are about as likely as the likeliest: a page of text never comes out empty.

A block is the text between starts and ends of block-level elements; `br` is white space in it. Character references
are decoded, white space becomes one space, blocks are joined by a newline. Comments, script, style and other raw
elements have no text. Missing end tags, stray ones and truncated pages are read as browsers do in the main.

Pages are read in one pass, whatever is left open in them, and time and memory are in proportion to a page: a page is
held whole, with about 500 bytes for each of its elements.

A null or empty page has empty text. Rows are independent: repeated rows get equal results, and other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .html_labelled import MADE_UP, labelled_pages

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The rest of a tag up to its end; nothing is tried twice, so a tag that never ends is found out in one pass.
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)")
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; what they hold is no text of the page.
RAW = frozenset("script style textarea title noembed noframes iframe xmp template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: Which open elements the start of an element ends, and where the search for them stops.
_BLOCKS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
ENDS = {t: ({"p"}, {"button", "td", "th", "table", "object", "html"}) for t in _BLOCKS} | {
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "p"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th", "p"}, {"table"}), "body": ({"head"}, {"html"}),
}
WORDS = re.compile(r"[A-Za-z]+")
#: Characters of a line whose words count as what an element says.
SHORT = 40
SAYS = re.compile(r"[^\W\d_]+")
RAW_END = {t: re.compile(rf"</{t}(?![^\s/>])", re.I) for t in RAW}


@dataclass(slots=True)
class Node:
    """An element: where it hangs, and what it holds."""

    tag: str
    attributes: str
    parent: int
    before: int = 0
    own: int = 0
    total: int = 0
    linked: int = 0
    ends: int = 0
    said: str = ""
    children: list[int] = field(default_factory=list)


class Scanner:
    """Finds the tags of a page in one pass; a reader may move `at` on.

    A comment without end takes the rest of the page. A tag whose quotes never close ends at the next `>`, and so do
    those that begin before the place of that quote. A `<` that no `>` follows is text.
    """

    def __init__(self, page: str):
        self.page, self.at, self.last, self.broken = page, 0, page.rfind(">"), 0

    def tag(self) -> tuple[int, str, bool, str] | None:
        """Where the next tag starts, its name in small letters, whether it is an end tag, and its attributes; comments and declarations have no name."""
        page, at = self.page, self.at
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                self.at = end + 3 if end >= 0 else len(page)
                return at, "", False, ""
            if at >= self.last:
                return None
            if page[at + 1] in "!?":
                self.at = page.index(">", at) + 1
                return at, "", False, ""
            ends = page[at + 1] == "/"
            name = NAME.match(page, at + 1 + ends)
            if name is None:
                at += 1
                continue
            rest = REST.match(page, name.end()) if at >= self.broken else None
            if rest is not None and rest[2]:
                self.at, attributes = rest.end(), rest[1]
            else:
                if rest is not None:
                    self.broken = rest.end()
                if name.end() > self.last:
                    return None
                self.at = page.index(">", name.end()) + 1
                attributes = page[name.end() : self.at - 1]
            return at, name[0].lower(), ends, attributes
        return None


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The elements in page order, the first a root, and the text blocks with the element of each; time in proportion to the page."""
    nodes = [Node("#root", "", -1)]
    blocks: list[tuple[int, str]] = []
    open_: list[int] = [0]
    solid = [0]  # for each open element, the place of the nearest one, itself included, that is not inline
    count: Counter = Counter()  # open elements by name
    run: list[str] = []
    size, links, read = len(page), 0, 0
    scanner = Scanner(page)

    def text(raw: str) -> None:
        nonlocal read
        run.append(raw)
        bare = raw.strip()
        n, node = len(bare), nodes[open_[-1]]
        node.own += n
        read += n
        node.ends += bare.count(". ") + bare.count("! ") + bare.count("? ") + (bare[-1:] in ".!?:…" and n > 0)
        if 0 < n <= SHORT and not node.said:
            node.said = bare
        if links:
            node.linked += n

    def flush() -> None:
        if run:
            raw = "".join(run)
            run.clear()
            whole = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if whole:
                blocks.append((open_[solid[-1]], whole))

    def close(place: int) -> None:
        nonlocal links
        for i in open_[place:]:
            count[nodes[i].tag] -= 1
            links -= nodes[i].tag == "a"
        del open_[place:], solid[place:]

    while True:
        before = scanner.at
        found = scanner.tag()
        if found is None:
            if before < size:
                text(page[before:])
            break
        start, tag, ends, attributes = found
        if start > before:
            text(page[before:start])
        if not tag:
            continue
        if ends:
            if count[tag]:
                place = next(k for k in range(len(open_) - 1, 0, -1) if nodes[open_[k]].tag == tag)
                if tag not in INLINE or solid[-1] >= place:
                    flush()
                close(place)
            continue
        if tag == "br":
            run.append(" ")
        if tag not in INLINE:
            flush()
            if tag in ENDS:
                names, stop = ENDS[tag]
                k, last = solid[-1], None
                while k > 0 and nodes[open_[k]].tag not in stop and nodes[open_[k]].tag in names:
                    last, k = k, solid[k - 1]
                if last is not None:
                    close(last)
        elif tag == "a" and links and nodes[open_[-1]].tag == "a":
            close(len(open_) - 1)
        nodes.append(Node(tag, attributes, open_[-1], read))
        nodes[open_[-1]].children.append(len(nodes) - 1)
        if tag in RAW:
            end = RAW_END[tag].search(page, scanner.at)
            stop = page.find(">", end.end()) if end else -1
            scanner.at = stop + 1 if stop >= 0 else size
        elif tag not in VOID and not attributes.endswith("/") or tag in _BLOCKS:
            open_.append(len(nodes) - 1)
            solid.append(solid[-1] if tag in INLINE else len(open_) - 1)
            count[tag] += 1
            links += tag == "a"
    flush()
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        n.total += n.own
        if i:
            nodes[n.parent].total += n.total
            nodes[n.parent].linked += n.linked
            nodes[n.parent].ends += n.ends
    return nodes, blocks


def named(n: Node) -> set[str]:
    """The words of an element's class, id and role."""
    if not n.attributes.strip():
        return set()
    return {w.lower() for name, a, b, c in ATTRIBUTE.findall(n.attributes) if name.lower() in ("class", "id", "role") for w in WORDS.findall(a or b or c)}


def says(n: Node) -> set[str]:
    return {w.lower() for w in SAYS.findall(n.said)}


def share(part: int, whole: int) -> int:
    """How small a part is, in powers of two: 0 from half on, 9 at most."""
    return min((whole // part).bit_length() - 1, 9) if part > 0 else 9


def shapes(nodes: list[Node]) -> list[list[str]]:
    """What is seen of each element without the words that name it."""
    page = max(nodes[0].total, 1)
    out: list[list[str]] = [[] for _ in nodes]
    for i, n in enumerate(nodes):
        above = nodes[n.parent] if n.parent >= 0 else None
        f = out[i]
        f += (f"tag {n.tag}", f"in {above.tag if above else ''} {n.tag}", f"size {min(n.total.bit_length(), 11)}")
        if n.total:
            plain = n.total - n.linked
            f += (f"links {4 * n.linked // n.total}", f"own {4 * min(n.own, n.total) // n.total}", f"prose {min(n.ends.bit_length(), 5)} {min(n.total // (n.ends + 1) // 30, 3)}", f"page {share(plain, page)} {4 * n.linked // n.total}", f"at {4 * n.before // page}", f"until {4 * (n.before + n.total) // (page + 1)} {share(n.total, page)}")
            if above:
                f.append(f"of {share(n.total, above.total)} {n.tag}")
        elif above is None:
            f.append("nothing")
    for n in nodes:
        if not n.children:
            continue
        # The child of most text outside links, and how it stands to the second.
        plain = [nodes[c].total - nodes[c].linked for c in n.children]
        top = max(plain)
        second = sorted(plain)[-2] if len(plain) > 1 else 0
        before = ""
        for k, c in enumerate(n.children):
            tag = nodes[c].tag
            out[c].append(f"after {before} {tag}")
            out[c].append(f"then {nodes[n.children[k + 1]].tag if k + 1 < len(n.children) else ''} {tag}")
            if plain[k] == top > 0:
                out[c].append(f"most {share(second, top) if second else 'alone'}")
            elif top:
                out[c].append(f"less {share(plain[k], top)}")
            before = tag
    return out


def features(nodes: list[Node]) -> list[list[str]]:
    """All that is seen of each element; the words that name its parent, and those that its parent begins with, count too."""
    own, begun = [named(n) for n in nodes], [first_words(n, nodes) for n in nodes]
    return [[*seen, *(f"word {w}" for w in words), *(f"begins {w}" for w in begun[i]), *((f"under {w}" for w in own[n.parent]) if n.parent >= 0 else ()), *((f"follows {w}" for w in begun[n.parent]) if n.parent >= 0 else ())] for i, (n, seen, words) in enumerate(zip(nodes, shapes(nodes), own, strict=True))]


def first_words(n: Node, nodes: list[Node]) -> set[str]:
    """The words of an element's first line, if it is short."""
    for c in [n, *(nodes[c] for c in n.children[:2])]:
        if c.said:
            return says(c)
    return set()


def kind(tag: str) -> str:
    """Parent-child potentials differ for inline elements, for sections and for other blocks."""
    return "inline" if tag in INLINE else "section" if tag in ("article", "aside", "div", "footer", "form", "header", "main", "nav", "section") else "block"


@dataclass
class Model:
    """Log odds of features, and by kind of child the log potentials of (parent, child) states."""

    unary: dict[str, float]
    pair: dict[str, tuple[float, float, float, float]]

    def potentials(self, nodes: list[Node]) -> list[float]:
        """The log odds of what is seen of each element; what comes of its parent is added up once for all of the parent's children."""
        get = self.unary.get
        own, begun = [named(n) for n in nodes], [first_words(n, nodes) for n in nodes]
        under = [sum(get(f"under {w}", 0.0) for w in sorted(a)) + sum(get(f"follows {w}", 0.0) for w in sorted(b)) if n.children else 0.0 for n, a, b in zip(nodes, own, begun, strict=True)]
        return [sum(get(f, 0.0) for f in seen) + sum(get(f"word {w}", 0.0) for w in sorted(a)) + sum(get(f"begins {w}", 0.0) for w in sorted(b)) + (under[n.parent] if n.parent >= 0 else 0.0) for n, seen, a, b in zip(nodes, shapes(nodes), own, begun, strict=True)]

    def marginals(self, nodes: list[Node], unary: list[float] | None = None) -> list[float]:
        """Log odds that each element is content, by one pass up and one down."""
        exp, log = math.exp, math.log
        up = self.potentials(nodes) if unary is None else list(unary)
        sent = [0.0] * len(nodes)
        pairs = [self.pair[kind(n.tag)] for n in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            p00, p01, p10, p11 = pairs[i]
            e = exp(max(-40.0, min(40.0, up[i])))
            sent[i] = log((p11 * e + p10) / (p01 * e + p00))
            up[nodes[i].parent] += sent[i]
        belief = up
        for i in range(1, len(nodes)):
            p00, p01, p10, p11 = pairs[i]
            e = exp(max(-40.0, min(40.0, belief[nodes[i].parent] - sent[i])))
            belief[i] = up[i] + log((p11 * e + p01) / (p10 * e + p00))
        return belief

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, blocks = parse(page)
        belief = self.marginals(nodes)
        kept = [t for i, t in blocks if belief[i] >= 0]
        if not kept:
            prose = [(i, t) for i, t in blocks if is_prose(i, t, nodes)]
            best = max((belief[i] for i, _ in prose), default=0.0)
            kept = [t for i, t in prose if belief[i] >= best - NEAR]
        return "\n".join(kept)


#: Log odds by which prose may be less likely than the likeliest, where nothing is likely.
NEAR = 2.0
NEVER = frozenset("nav header footer aside form button select option label menu noscript dialog".split())


def is_prose(i: int, text: str, nodes: list[Node]) -> bool:
    """Whether a block is sentences, not links, and not in an element that never holds a page's text."""
    n = nodes[i]
    if len(text.split()) < 5 or not re.search(r"[.!?…。]", text) or 2 * n.linked > n.total:
        return False
    while i > 0:
        if nodes[i].tag in NEVER:
            return False
        i = nodes[i].parent
    return True


MARKED = re.compile(r"\s*\blabel=\"([01])\"")


def marked(page: str) -> tuple[list[Node], list[int]]:
    """The elements of a labelled page and their labels; the marks are taken off."""
    nodes, _ = parse(page)
    label: list[int] = []
    for n in nodes:
        mark = MARKED.search(n.attributes)
        label.append(int(mark[1]) if mark else label[n.parent] if n.parent >= 0 else 0)
        n.attributes = MARKED.sub("", n.attributes)
    return nodes, label


def learn(pages: Iterator[str], epochs: int = 4, rate: float = 0.4, least: int = 4) -> Model:
    """Parent-child states are counted; the weights of what is seen (on `least` elements at least) follow the gradient of the labels' likelihood under the model's marginals, page by page, with steps that shrink by what a weight has moved; the weights of the later half are averaged."""
    read = []
    states: dict[str, Counter] = {k: Counter() for k in ("inline", "section", "block")}
    often: Counter = Counter()
    for page in pages:
        nodes, label = marked(page)
        seen = features(nodes)
        for f in seen:
            often.update(f)
        for n, y in zip(nodes, label, strict=True):
            if n.parent >= 0:
                states[kind(n.tag)][label[n.parent], y] += 1
        read.append((nodes, label, seen))
    pair = {}
    for k, c in states.items():
        rows = [[c[p, y] + 1.0 for y in (0, 1)] for p in (0, 1)]
        pair[k] = tuple(rows[p][y] / sum(rows[p]) for p in (0, 1) for y in (0, 1))
    real = lambda f: not f.startswith(("begins ", "follows ")) or not MADE_UP.fullmatch(f.partition(" ")[2])
    weight, moved = dict.fromkeys((f for f, n in often.items() if n >= least and real(f)), 0.0), dict.fromkeys(often, 1e-3)
    model = Model(weight, pair)
    read = [(nodes, label, [[f for f in own if f in weight] for own in seen]) for nodes, label, seen in read]
    sums, taken = dict.fromkeys(weight, 0.0), 0
    for epoch in range(epochs):
        for turn, (nodes, label, seen) in enumerate(read):
            belief = model.marginals(nodes, [sum([weight[f] for f in own]) for own in seen])
            for y, b, own in zip(label, belief, seen, strict=True):
                step = y - 1 / (1 + math.exp(-max(-40.0, min(40.0, b))))
                if abs(step) > 0.02:
                    for f in own:
                        moved[f] += step * step
                        weight[f] += rate * step / math.sqrt(moved[f])
            if 2 * epoch >= epochs and turn % 50 == 0:
                taken += 1
                for f, w in weight.items():
                    sums[f] += w
    return Model({f: w / taken for f, w in sums.items()}, pair) if taken else model


@lru_cache(1)
def default_model() -> Model:
    return learn(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html)."""
    own = model or default_model()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 4 << 20):
                texts = [own.extract(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind_ = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(extracted, f"page_id {kind_}, url string, text string, n_chars bigint")
