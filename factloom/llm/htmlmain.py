"""Main text of web pages by template deduction from equivalence classes.

Pages of one host, in blocks of bounded size, are read as tokens: each tag, and each whole block of text, is told apart by the
path of elements it stands in. Tokens with the same occurrence vector (how often they occur on each page of the block) form
a class. Classes of tags that keep one order on all pages are valid; the class that occurs once on every page is the template's
spine, and further classes nest into the slot of the spine that holds all their occurrences. Blocks of text that are on every
page, or in one slot on half of the pages, belong to the template and go, from three distinct pages on; inside an article or
main element only those on every page do, and only if the article is no copy. Of the slots that remain, the main one is the
template's article or main element; without one, the innermost container of the template (an element that a page has once)
that holds three quarters of all that varies and is no link, with the pages' own top heading. Inside it, elements whose name or
class says that they are menus, adverts, forms or comments are left out: such text varies like any other, and no template tells it.

Paths are numbered nodes with a parent, so that a page of any depth takes time and memory in proportion to its length.
"""

from __future__ import annotations

import heapq
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = 64  # of one host in a block, on average
SMALL = 100_000  # hosts whose counts are sent to all executors; more are joined by a shuffle

_ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^'"<>])*"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|object|head)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})>|[^<]+|<",
    re.S | re.I,
)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SHORT = re.compile(r"[a-z]+(?:[0-9]{1,2}(?![0-9]))?")

# fixed values: elements without an end, elements that begin a block, what an opening tag ends, and what holds no main text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = frozenset("ul ol menu dl table article section div aside nav main body form header footer blockquote td th".split())
DROPPED = frozenset("nav header footer aside form menu button select textarea input label script style noscript template iframe svg object head dialog search title".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice popup modal newsletter subscribe signup login share sharing social comment comments disqus replies related recommended toolbar pagination pager".split()
)
ROOTS = frozenset({"article", "main"})
CONTAINERS = frozenset("html body div section center table tbody tr td".split())
LEAST = 3  # distinct pages that a text must be on to belong to the template
SHARE = 0.75  # of the varying text that the main container holds
TWINS = 1024  # equal rows in a block, about

Text = tuple[int, str]  # a block of text and the node of the element that it stands in


class Paths:
    """Paths of elements as numbered nodes: a parent and a label each, parents first. Node 0 is the page itself."""

    def __init__(self) -> None:
        self.parent, self.label, self.name, self.block = [0], [""], [""], [0]
        self._at: dict[tuple[int, str], int] = {}

    def child(self, parent: int, name: str, label: str) -> int:
        node = self._at.get((parent, label))
        if node is None:
            node = self._at[parent, label] = len(self.parent)
            self.parent.append(parent)
            self.label.append(label)
            self.name.append(name)
            self.block.append(node if name in BLOCKS else self.block[parent])  # the nearest element that begins a block
        return node

    def node(self, *labels: str) -> int:
        """The node of a path of labels."""
        at = 0
        for x in labels:
            at = self._at[at, x]
        return at

    def down(self, own: Callable[[int], bool]) -> list[bool]:
        """Of each node whether ``own`` holds for it or one above it."""
        out = [False]
        for n in range(1, len(self.parent)):
            out.append(out[self.parent[n]] or own(n))
        return out

    def sums(self, weights: dict[int, int]) -> list[int]:
        """Of each node the weights of itself and of all below it."""
        out = [0] * len(self.parent)
        for n, w in weights.items():
            out[n] += w
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] += out[n]
        return out


@dataclass
class Page:
    """Tokens in order: (node, None) for a tag, (node, text) for text between tags."""

    tokens: list[tuple[int, str | None]] = field(default_factory=list)
    breaks: list[int] = field(default_factory=list)  # of each token, the number of block borders before it
    blocks: dict[int, Text] = field(default_factory=dict)  # by number of borders: the block's text and its element


def _label(name: str, attributes: str) -> str:
    """The element's name, with a mark if the name or one of its classes, ids and roles says that no main text is in it."""
    parts = [p.lower() for m in _HINT.finditer(attributes) for p in (m[1] or m[2] or m[3] or "").split()] if attributes else []
    hints = {w for p in parts for w in _WORD.findall(p)}
    shape = ".".join(sorted({w for p in parts for w in _SHORT.findall(p)}))  # long numbers tell pages apart, not places
    if name in DROPPED or (hints & WORDS and name not in ("body", "html", *ROOTS)) or "comment" in hints or "comments" in hints:
        return f"{name}!{shape}"
    return f"{name}.{shape}" if shape else name


class _Open:
    """The open elements, with the places of each name and of those that end tags don't reach out of."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []

    def push(self, name: str, node: int) -> None:
        self.places[name].append(len(self.stack))
        if name in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((name, node))

    def cut(self, at: int) -> bool:
        """Closes the elements from a place on; whether one of them began a block."""
        border = False
        while len(self.stack) > at:
            name, _ = self.stack.pop()
            self.places[name].pop()
            if name in SCOPES:
                self.scopes.pop()
            border |= name in BLOCKS
        return border

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    @property
    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else -1

    @property
    def node(self) -> int:
        return self.stack[-1][1] if self.stack else 0


def read(html: str | None, paths: Paths) -> Page:
    """Tokens of one page. Comments, scripts, styles and heads are passed over whole; missing end tags are taken as given where HTML lets them be left out, stray ones are ignored."""
    page, open_, border = Page(), _Open(), 0
    for m in _TOKEN.finditer(html or ""):
        name = (m[3] or "").lower()
        if not name:
            raw = m[0]
            if m[1] or raw[:2] in ("<!", "<?"):
                border += bool(m[1])
                continue
            page.tokens.append((open_.node, raw))
            page.breaks.append(border)
        elif m[2]:
            at = open_.last(name)
            if at >= 0 and (name == "p" or name in SCOPES or open_.scope < at):
                border += open_.cut(at)
            border += name in BLOCKS
        else:
            at = max((open_.last(x) for x in SIBLINGS.get(name, set()) | ({"p"} if name in ENDS_P else set())), default=-1)
            if at >= 0 and at >= open_.scope:
                open_.cut(at)
            border += name in BLOCKS
            above = open_.node
            node = paths.child(above, name, _label(name, m[4]))
            if name not in VOID and not m[4].rstrip().endswith("/"):
                open_.push(name, node)
            page.tokens.append((node, None))
            page.breaks.append(border)
            if name == "br":
                page.tokens.append((above, " "))
                page.breaks.append(border)
    page.blocks = _blocks(page, paths)
    return page


def _spaced(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def _blocks(page: Page, paths: Paths) -> dict[int, Text]:
    found: dict[int, tuple[int, list[str]]] = {}
    for (node, text), border in zip(page.tokens, page.breaks, strict=True):
        if text is not None and (border in found or text.strip()):
            found.setdefault(border, (node, []))[1].append(text)
    return {border: (paths.block[node], text) for border, (node, parts) in found.items() if (text := _spaced(parts))}


def _sequence(page: Page) -> Iterator[int | Text]:
    """The page's tokens in order: nodes of tags, and texts where their blocks begin."""
    last = None
    for (node, text), border in zip(page.tokens, page.breaks, strict=True):
        if text is None:
            yield node
        elif border != last and border in page.blocks:
            last = border
            yield page.blocks[border]


Vector = tuple[tuple[int, int], ...]  # (page, occurrences), pages without the token left out


def classes_of(pages: list[Page]) -> dict[Vector, list[int | Text]]:
    """Equivalence classes: occurrence vector → the tokens that have it, in order of the first page that has them; texts on fewer than ``LEAST`` pages are in none."""
    on = Counter(t for p in pages for t in set(p.blocks.values()))
    counts: dict[int | Text, dict[int, int]] = defaultdict(dict)
    for i, p in enumerate(pages):
        for t in _sequence(p):
            if isinstance(t, int) or on[t] >= LEAST:
                counts[t][i] = counts[t].get(i, 0) + 1
    out: dict[Vector, list[int | Text]] = defaultdict(list)
    for token, vector in counts.items():
        out[tuple(vector.items())].append(token)  # pages are counted in order
    return dict(out)


def _ordered(pages: list[Page], tokens: list[int]) -> list[int]:
    """Those tokens of a class whose first places keep the first page's order on every page where they occur."""
    wanted, ranks = set(tokens), []
    for p in pages:
        first: dict[int, int] = {}
        for at, (node, text) in enumerate(p.tokens):
            if text is None and node in wanted:
                first.setdefault(node, at)
        ranks.append(first)
    kept: list[int] = []
    for t in sorted(tokens, key=lambda t: next((r[t] for r in ranks if t in r), 0)):
        if not kept or all(r[kept[-1]] < r[t] for r in ranks if t in r and kept[-1] in r):
            kept.append(t)
    return kept


@dataclass
class Template:
    spine: list[int]  # nodes that occur once on every page, in order
    nested: dict[int, int]  # node of another valid class → the slot of the spine that holds it
    fixed: set[Text]  # texts on every page
    usual: set[Text]  # texts on half of the pages, all in one slot of the spine
    dropped: list[bool]  # of each node whether it or one above it is marked as no main text
    inside: list[bool] | None  # of each node whether it is in the main slot; None: the template has none
    named: bool  # whether the main slot is an article or main element
    heading: list[bool]  # of each node whether it is in a top heading


def deduce(pages: list[Page], paths: Paths) -> Template:
    """The template of a block of pages. A class is valid if it occurs on half of the pages at least and all its occurrences fall into one slot of the spine."""
    found = classes_of(pages)
    spine = _ordered(pages, [t for t in found.get(tuple((i, 1) for i in range(len(pages))), []) if isinstance(t, int)])
    place = {t: i for i, t in enumerate(spine)}
    slots: dict[int | Text, set[int]] = defaultdict(set)
    for p in pages:
        slot = -1
        for t in _sequence(p):
            if isinstance(t, int):
                slot = place.get(t, slot)
            slots[t].add(slot)
    nested, fixed, usual, once = {}, set(), set(), set(spine)
    for vector, tokens in found.items():
        if 2 * len(vector) >= len(pages):
            texts, tags = [t for t in tokens if not isinstance(t, int)], [t for t in tokens if isinstance(t, int) and t not in place]
            held = set().union(*(slots[t] for t in tags))
            if len(held) == 1:
                nested |= {t: min(held) for t in tags}
                if all(n == 1 for _, n in vector):
                    once.update(tags)
            if len(vector) == len(pages):
                fixed.update(texts)
            else:
                usual.update(t for t in texts if len(slots[t]) == 1)
    wrappers = _wrappers(pages, paths, fixed | usual)
    dropped = paths.down(lambda n: "!" in paths.label[n] and n not in wrappers)
    roots = {t for t in (*spine, *nested) if paths.name[t] in ROOTS and not dropped[t]}
    main = None if roots or len(pages) < LEAST else _main_container(pages, paths, fixed | usual, dropped, once)
    inside = paths.down(lambda n: n in roots) if roots else paths.down(lambda n: n == main) if main else None
    return Template(spine, nested, fixed, usual, dropped, inside, bool(roots), paths.down(lambda n: paths.name[n] == "h1"))


def _main_container(pages: list[Page], paths: Paths, constant: set[Text], dropped: list[bool], once: set[int]) -> int:
    """The innermost container of the template that holds ``SHARE`` of the varying text outside links; 0 if only the page itself does."""
    linked = paths.down(lambda n: paths.name[n] == "a")
    weights: Counter[int] = Counter()
    for p in pages:
        for (node, text), border in zip(p.tokens, p.breaks, strict=True):
            if text is not None and not linked[node] and not dropped[node] and p.blocks.get(border, (0, "")) not in constant:
                weights[node] += len(text.strip())
    held = paths.sums(weights)
    # nodes that hold so much lie on one path, parents first
    return max((n for n in once if paths.name[n] in CONTAINERS and held[n] >= SHARE * held[0] > 0), default=0)


def _wrappers(pages: list[Page], paths: Paths, constant: set[Text]) -> set[int]:
    """Nodes marked by a word of their class that hold nine tenths, on the pages that have them, of the text that is not the template's: a page's wrapper may be called "with-sidebar"."""
    marked = [n for n in range(1, len(paths.parent)) if "!" in paths.label[n]]
    if not marked:
        return set()
    never = paths.down(lambda n: "!" in paths.label[n] and _fixed_mark(paths.label[n]))
    nearest = [0]  # of each node the nearest marked one, itself included
    for n in range(1, len(paths.parent)):
        nearest.append(n if "!" in paths.label[n] else nearest[paths.parent[n]])
    held: Counter[int] = Counter()
    beside: Counter[int] = Counter()
    for p in pages:
        own: Counter[int] = Counter()
        for node, text in p.blocks.values():
            if (node, text) not in constant and not never[node]:
                own[nearest[node]] += len(text)
        whole = sum(own.values())
        queue = [-n for n in own if n]  # the largest number first: what is below comes before what is above
        heapq.heapify(queue)
        while queue:
            n = -heapq.heappop(queue)
            held[n] += own[n]
            beside[n] += whole
            if above := nearest[paths.parent[n]]:
                if above not in own:
                    heapq.heappush(queue, -above)
                own[above] += own[n]
    return {n for n, x in held.items() if 10 * x >= 9 * beside[n]}


def _fixed_mark(label: str) -> bool:
    """Whether the element's name itself, or a section of comments, is what marks it."""
    name, _, hints = label.partition("!")
    return name in DROPPED or not {"comment", "comments"}.isdisjoint(_WORD.findall(hints))


def extract(page: Page, template: Template) -> str:
    """The text of the template's slots that hold main text, white space in a block made one space, blocks joined by line ends. An article of which half is on every page is a copy and stays whole; so does what a page of usual texts only has."""
    inside = template.inside
    if inside is not None and not any(inside[node] for node, text in page.tokens if text):
        inside = None
    blocks: dict[int, list[str]] = defaultdict(list)
    for (node, text), border in zip(page.tokens, page.breaks, strict=True):
        if text is None or template.dropped[node] or inside is not None and not inside[node] and (template.named or not template.heading[node]):
            continue
        blocks[border].append(text)
    texts = {border: x for border, b in blocks.items() if (x := _spaced(b))}
    varying = {border: x for border, x in texts.items() if page.blocks.get(border) not in template.fixed}
    if inside is not None and template.named:
        return "\n".join((varying if 2 * sum(map(len, varying.values())) >= sum(map(len, texts.values())) else texts).values())
    alone = {border: x for border, x in varying.items() if page.blocks.get(border) not in template.usual}
    return "\n".join((alone or varying).values())


def texts_of(htmls: list[str | None]) -> list[str]:
    """Main texts of pages of one host. Copies of a page and pages without any token say nothing about the template."""
    paths = Paths()
    pages = {h: read(h, paths) for h in dict.fromkeys(htmls)}
    template = deduce([p for p in pages.values() if p.tokens], paths)
    texts = {h: extract(p, template) for h, p in pages.items()}
    return [texts[h] for h in htmls]


def _joined(rows: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the counts of those keys that have many rows: sent to all executors if they are few."""
    few = large.limit(SMALL + 1).count() <= SMALL
    return rows.join(F.broadcast(large) if few else large, keys, "left")


def main_texts(pages: DataFrame, per_block: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every page. A host's pages are dealt into blocks of some ``per_block`` by a hash of id and url, so that a host of any size is many bounded groups.

    Null and empty html gives an empty text; pages without url are one host; repeated rows each stay (of more than ``TWINS`` rows of one id and url equal ones
    are read once, the others dealt by their html as well, so that a block never depends on how the rows lay); a host's only page is its own block; an empty
    table gives no rows. Extra columns are not read.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html").withColumn("host", host).withColumn("h", F.xxhash64("page_id", "url"))
    rows = rows.withColumn("copies", F.lit(1).cast("bigint"))
    many = rows.groupBy("h").agg(F.count("*").alias("twins")).where(F.col("twins") > TWINS)
    if not many.isEmpty():
        marked = _joined(rows, many, ["h"])
        once = marked.where("twins IS NOT NULL").groupBy("page_id", "url", "html", "host").agg(F.count("*").alias("copies"))
        rows = marked.where("twins IS NULL").drop("twins").unionByName(once.withColumn("h", F.xxhash64("page_id", "url", "html")))
    blocks = _joined(rows, rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > per_block), ["host"])
    blocks = blocks.withColumn("block", F.pmod(F.col("h"), F.ceil(F.coalesce("n", F.lit(1)) / per_block).cast("bigint")))

    def run(table: pa.Table) -> pa.Table:
        texts = texts_of(table.column("html").to_pylist())
        return pa.table([table.column("page_id"), table.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), table.column("copies")], ["page_id", "url", "text", "n_chars", "copies"])

    read = blocks.select("host", "block", "page_id", "url", "html", "copies").groupBy("host", "block").applyInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint, copies bigint")
    return read.select("page_id", "url", "text", "n_chars", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("col")
