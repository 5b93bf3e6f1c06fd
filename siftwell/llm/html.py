"""Operator 1: main text of web pages as a maximum-scoring subsequence.

A page is one sequence of words and tags. Words score by where they stand, tags score below zero, and a linear scan finds
the contiguous region with the highest sum; its words are the text. A word's weight adds up, each part bounded: the mark
around it (pages may mark their text: article, main, role=main, itemprop=articleBody), its block's tag, and the block's shape (mostly
links, a rights notice, else its length). Weights are log odds counted on pages with a mark, where words of menus,
headers and footers count as outside.

Elements whose tag, class, id or role names a menu, notice, advert, form or the like (NOISE_TAGS, NOISE_WORDS) lose NAME a word
and whatever a mark gives. Those that end below zero are not printed and cost the region no more than a tag, so that an advert
doesn't cut a text in two. Other names get a weight by the labelled pages. An element that is or holds the marked text is never covered. Where marks stand both inside and
outside of such elements (readers' comments are often articles too) those outside are the text. Pages without a mark are
scored by blocks alone; there an element that holds more than WRAPS of the words is a wrapper, whatever its name.

The weights are fitted on about max_labelled marked pages (all if there are fewer), chosen by hash; every page is then scored whole.

Defined results: null, empty or wordless html gives empty text. Broken markup (open or stray tags, a page that ends in a
comment or script) is read as browsers do it: an end tag closes what is open inside it. Of two regions with the same
score the first counts. Repeated rows give equal rows; an empty table gives no rows; without labelled pages the weights
are the priors alone. Columns but page_id, url and the html are left out, whatever their names. A page takes time linear in its length."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import slices, table

MAX_LABELLED = 2000  # labelled pages, about, that the weights are fitted on
WRAPS = 2 / 3  # of a page's words; what holds more is a wrapper
# HTML's own element kinds and the names that mark what is no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr"
    " main menu nav ol p pre section table ul".split()
)
LIST_ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
NOISE_TAGS = frozenset(
    "head nav menu header footer aside form script style noscript template title button select textarea iframe object svg canvas"
    " dialog".split()
)
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent"
    " gdpr notice notices popup modal overlay menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside footer"
    " footers header headers masthead comment comments respond disqus replies form forms newsletter subscribe signup share sharing"
    " social related contentinfo complementary search".split()
)
QUALIFIERS = frozenset("with has no without hide show is".split())  # "with-sidebar" says what a page has, not what it is
UNSEEN = frozenset("head script style noscript template title textarea select iframe object svg canvas".split())  # never shown as text
MARKED = frozenset(["article", "main"])
EXEMPT = frozenset(["html", "body", "main"])
NOTICE = re.compile(r"©|\(c\)|copyright|all rights reserved|alle rechte vorbehalten|tous droits r|todos los derechos", re.I)

_piece = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
_attribute = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_name_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _attributes(written: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attribute.finditer(written)} if "=" in written else {}


@dataclass(slots=True)
class Element:
    """One element of a page, after its parent. names are the parts of class, id and role; block is the place of the
    nearest element that is no inline one."""

    tag: str
    parent: int
    block: int
    link: bool
    names: tuple[str, ...] = ()
    mark: str = ""  # article or main
    noise: bool = False


def _names(attributes: dict[str, str]) -> tuple[tuple[str, ...], bool]:
    """Name parts, and whether one of them says that the element is no main text."""
    parts, noise = [], False
    for name in " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split():
        own = [part.lower() for part in _name_part.findall(name)]
        parts += own
        noise |= any(w in NOISE_WORDS for w in own) and not (own[0] in QUALIFIERS)
    return tuple(parts), noise


def parse(html: str) -> tuple[list[Element], list[tuple[int, str, str]]]:
    """Elements (the first is the page itself) and tokens in page order: (element, "", decoded text) for text, (element,
    tag, blank or nothing) for tags; a blank if the tag parts words."""
    elements = [Element("", -1, 0, False)]
    tokens: list[tuple[int, str, str]] = []
    stack = [0]
    places: dict[str, list[int]] = {}  # tag -> its places on the stack

    def close(tag: str, stops: tuple[str, ...] = ()) -> None:
        open_places = places.get(tag)
        if open_places and all(not places.get(stop) or places[stop][-1] <= open_places[-1] for stop in stops):
            at = open_places[-1]
            while len(stack) > at:
                places[elements[stack.pop()].tag].pop()

    at, raw_end = 0, None
    while at < len(html):
        if raw_end:
            end = re.compile(rf"</{raw_end}(?=[\s/>]|\Z)", re.I).search(html, at)
            stop = end.start() if end else len(html)
            tokens.append((stack[-1], "", html[at:stop]))
            at, raw_end = stop, None
            continue
        m = _piece.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if not m[0].startswith(("<!", "<?")):
                tokens.append((stack[-1], "", unescape(m[0])))
            continue
        tag = tag.lower()
        parts = "" if tag in INLINE else " "
        if m[1]:
            tokens.append((stack[-1], tag, parts))
            close(tag, ("td", "th", "table") if tag in CLOSES_P and tag != "table" else ())
            continue
        if tag in CLOSES_P:
            close("p", ("table", "td", "th", "button", "object"))
        if tag in LIST_ITEMS:
            for other in ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,):
                close(other, LIST_ITEMS[tag])
        if tag not in VOID and not (m[3] or "").endswith("/"):
            attributes = _attributes(m[3] or "")
            mark = "article" if tag == "article" or attributes.get("itemprop") == "articleBody" else ""
            mark = mark or ("main" if tag == "main" or attributes.get("role") == "main" else "")
            names, noise = _names(attributes)
            noise = tag not in EXEMPT and (noise or tag in NOISE_TAGS)
            above, place = stack[-1], len(elements)
            block = elements[above].block if tag in INLINE else place
            elements.append(Element(tag, above, block, elements[above].link or tag == "a", names, mark, noise))
            places.setdefault(tag, []).append(len(stack))
            stack.append(place)
            raw_end = tag if tag in RAW else None
        tokens.append((stack[-1], tag, parts))
    return elements, tokens


class Page:
    """A parsed page with what its weights ask for: where each element stands ("in" or "out" of the marked text, "near" if
    only a main holds it whose text is marked more narrowly, "none" on pages without a mark), the outermost covering
    element round each element (-1: none), and the shape of each block."""

    def __init__(self, html: str) -> None:
        self.elements, self.tokens = parse(html)
        elements = self.elements
        self.n_words = [len(text.split()) if not tag else 0 for _, tag, text in self.tokens]
        size = [0] * len(elements)
        held = [0] * len(elements)  # words in an element and below
        linked = [0] * len(elements)
        shown = [""] * len(elements)
        for (own, _, text), n in zip(self.tokens, self.n_words, strict=True):
            if n:
                block = elements[own].block
                size[block] += n
                held[own] += n
                linked[block] += n if elements[own].link else 0
                if size[block] <= 40:
                    shown[block] += text
        hidden = [False] * len(elements)
        for i, e in enumerate(elements[1:], 1):
            hidden[i] = hidden[e.parent] or e.tag in UNSEEN
        for i in range(len(elements) - 1, 0, -1):
            held[elements[i].parent] += 0 if elements[i].tag in UNSEEN else held[i]
        self.shape = [self._shape(*block) for block in zip(size, linked, shown, strict=True)]

        # which marks are the text: those outside of covers, else those that only cover themselves, else all
        under = [False] * len(elements)
        levels: dict[int, int] = {}
        for i, e in enumerate(elements[1:], 1):
            outer = under[e.parent]
            under[i] = outer or e.noise
            if e.mark and held[i] and not hidden[i]:
                levels[i] = 2 if outer else 1 if e.noise else 0
        best = min(levels.values(), default=0)
        chosen = {i for i, level in levels.items() if level == best}
        self.marked = bool(chosen)
        holds: set[int] = set()  # is or holds a chosen mark
        narrow: set[int] = set()  # holds a chosen article
        for i in chosen:
            for known, start in ((holds, i), (narrow, elements[i].parent if elements[i].mark == "article" else -1)):
                while start >= 0 and start not in known:
                    known.add(start)
                    start = elements[start].parent
        all_words = held[0]
        self.where = ["out" if self.marked else "none"] * len(elements)
        self.cover = [-1] * len(elements)
        for i, e in enumerate(elements[1:], 1):
            outer = self.where[e.parent]
            wraps = not self.marked and e.tag not in UNSEEN and held[i] > WRAPS * all_words
            covers = (e.noise or hidden[i]) and i not in holds and not wraps
            self.cover[i] = self.cover[e.parent] if self.cover[e.parent] >= 0 else i if covers else -1
            self.where[i] = outer
            if i in chosen:
                self.where[i] = "in" if e.mark == "article" or i not in narrow else "in" if outer == "in" else "near"

    @staticmethod
    def _shape(words: int, linked: int, text: str) -> str:
        if 2 * linked > words:
            return "links"
        if words <= 40 and NOTICE.search(text):
            return "notice"
        return "few" if words < 4 else "short" if words < 9 else "long" if words < 21 else "prose"


def label_counts(html: str) -> Counter:
    """(kind, key, inside) -> words or tags, of a page that marks its main text; nothing for other pages."""
    page, counts = Page(html), Counter()
    if not page.marked:
        return counts
    for (own, tag, _), n in zip(page.tokens, page.n_words, strict=True):
        e, cover = page.elements[own], page.cover[own]
        if (cover >= 0 and page.elements[cover].tag in UNSEEN) or page.where[own] == "near" or not (tag or n):
            continue
        inside = page.where[own] == "in" and cover < 0
        if tag:
            counts["tag", tag, inside] += 1
            continue
        counts["words", "", inside] += n
        block = page.elements[e.block]
        counts["shape", page.shape[e.block], inside] += n
        if page.shape[e.block] not in ("links", "notice") and (cover < 0 or page.elements[cover].tag in NOISE_TAGS):
            counts["words", block.tag, inside] += n  # links, notices and names explain themselves
        for name in set(block.names):
            counts["name", name, inside] += n
    return counts


class Weights:
    """Log odds of standing inside main text, bounded; tags and names never score above zero."""

    MARK, BLOCK, SHAPE, TAG, NAME, COVER = 8.0, 1.0, 2.0, 1.0, 4.0, 0.1
    SHAPES = {"links": -2.0, "notice": -2.0, "few": 0.0, "short": 0.25, "long": 0.5, "prose": 1.0}  # before any label

    def __init__(self, counts: dict[tuple[str, str, bool], int]) -> None:
        def odds(kind: str, key: str, bound: float) -> float:
            inside, outside = counts.get((kind, key, True), 0), counts.get((kind, key, False), 0)
            return max(-bound, min(bound, math.log((inside + 1) / (outside + 1))))

        keys = {k[:2] for k in counts if k[1]}
        seen_in, seen_out = counts.get(("words", "", True), 0), counts.get(("words", "", False), 0)
        self.marks = {"in": min(self.MARK, 4 + math.log1p(seen_in)), "out": -min(self.MARK, 4 + math.log1p(seen_out)), "near": 0.0, "none": 0.0}
        self.blocks = {key: odds(kind, key, self.BLOCK) for kind, key in keys if kind == "words"}
        learned = {key: odds(kind, key, self.SHAPE) for kind, key in keys if kind == "shape"}
        self.shapes = self.SHAPES | {k: min(v, -1.0) if self.SHAPES[k] < 0 else max(v, 0.0) for k, v in learned.items()}
        self.tags = {key: min(-0.01, odds(kind, key, self.TAG)) for kind, key in keys if kind == "tag"}
        self.names = {key: min(0.0, odds(kind, key, self.TAG)) for kind, key in keys if kind == "name" and key not in NOISE_WORDS}

    def word(self, page: Page, own: int) -> float:
        block = page.elements[own].block
        e = page.elements[block]
        base = self.blocks.get(e.tag, 0.25) + self.shapes[page.shape[block]] + min((self.names.get(n, 0.0) for n in e.names), default=0.0)
        return base - self.NAME if page.cover[own] >= 0 else base + self.marks[page.where[own]]

    def tag(self, where: str, tag: str) -> float:
        """Inside a marked text a tag costs next to nothing, so that a short last block is worth its tags."""
        return -0.001 if where == "in" else self.tags.get(tag, -0.1)


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end of the contiguous region with the highest sum above zero, the first of equals; (0, 0) if none."""
    best, first, last, total, start = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, last = total, start, i + 1
    return first, last


def main_text(html: str | None, weights: Weights) -> str:
    if not html:
        return ""
    page = Page(html)
    known: dict[int, float] = {}  # element -> weight of a word
    covered: dict[int, float] = {}  # covering element -> sum of its words
    scores = []
    for (own, tag, _), n in zip(page.tokens, page.n_words, strict=True):
        cover = page.cover[own]
        if tag:
            scores.append(0.0 if cover >= 0 else weights.tag(page.where[own], tag))
            continue
        if own not in known:
            known[own] = weights.word(page, own)
        scores.append(n * known[own])
        if cover >= 0:
            covered[cover] = covered.get(cover, 0.0) + n * known[own]
    left_out = {cover for cover, total in covered.items() if total <= 0 or page.elements[cover].tag in UNSEEN}
    paid: set[int] = set()
    for i, (own, _, _) in enumerate(page.tokens):
        cover = page.cover[own]
        if cover in left_out:  # its first token pays for the whole
            scores[i] = 0.0 if cover in paid or page.elements[cover].tag in UNSEEN else max(covered[cover], -weights.COVER)
            paid.add(cover)
    first, last = best_region(scores)
    shown = (text for own, _, text in page.tokens[first:last] if page.cover[own] not in left_out)
    return " ".join("".join(shown).split())


def fit_weights(pages: DataFrame, html: str = "html", max_labelled: int = MAX_LABELLED) -> Weights:
    """Counts over labelled pages, added up by Spark; the table of sums has a row per tag and name of the chosen pages. Chosen are the pages whose
    hash lies in that part of all hashes which should hold max_labelled of them, so pages are counted and filtered where
    they lie."""
    rows = pages.select(F.col(html).alias("_html"), F.xxhash64("page_id", "url", html).alias("_hash"))
    rows = rows.where(F.col("_html").rlike(r"(?i)<(article|main)[\s>]|role=.?main|articleBody"))
    share = min(1.0, max_labelled / max(rows.count(), 1))
    chosen = rows.where(F.col("_hash") <= min(2**63 - 1, int(-(2**63) + share * 2**64))).select("_html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column("_html").to_pylist():
                counts.update(label_counts(page))
        kinds, keys, inside = zip(*counts, strict=True) if counts else ((), (), ())
        arrays = [pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(inside, pa.bool_()), pa.array(counts.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["kind", "key", "inside", "n"])

    sums = chosen.mapInArrow(count, "kind string, key string, inside boolean, n bigint").groupBy("kind", "key", "inside").agg(F.sum("n").alias("n"))
    return Weights({(r.kind, r.key, r.inside): r.n for r in sums.collect()})


def extract(pages: DataFrame, weights: Weights, html: str = "html") -> DataFrame:
    """page_id, url, text."""
    rows = pages.select("page_id", "url", F.col(html).alias("_html"))
    ids = [rows.schema["page_id"], rows.schema["url"]]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in ids), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_html", 8 << 20):
            texts = [main_text(page, weights) for page in piece.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, schema)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit_weights(pages)).withColumn("n_chars", F.length("text").cast("bigint"))
