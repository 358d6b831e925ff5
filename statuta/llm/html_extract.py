"""Main text of web pages by wrapper induction.

Every page becomes a tree of its block elements. Of each host one page, chosen by a hash, is
the reference: the trees of all its pages are aligned with the reference by simple tree
matching, which gives each block the place it has on the host. By place, counts over all pages
of the host tell what is constant, and so template, and where the text that varies is: the
article's place is the deepest one that holds most of it. Each page then gives the text of the
blocks at that place, without template, and without what its element or its names exclude.

The counts are sums by host and place, so they are the same however pages are dealt to tasks,
and no task holds the pages of a host.
"""

from __future__ import annotations

import functools
import html
import json
import re
import zlib
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, slices, table

# fixed values: HTML elements by their role here
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav header footer aside form head button select option input menu dialog iframe object embed canvas audio video svg math noscript template".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt tr td th tbody thead".split())
ENDS_SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# fixed values: class, id and role words of what isn't article text
ROLES = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal overlay "
    "menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar aside widget footer header masthead comment comments disqus respond replies "
    "newsletter subscribe subscription signup login toolbar pagination pager complementary contentinfo skip hidden".split()
)
# fixed values: words that name article text as well; what they stand beside where they don't; elements that hold others
OPEN = frozenset("alert recommended related search share sharing social".split())
FURNITURE = frozenset("article articles bar block box button buttons container count counts entry form icon icons item items link links list module page panel post posts row section site stories story tools wrap wrapper".split())
CONTAINERS = frozenset("center details div dl fieldset ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = re.compile(r"(?:^|\s)(?:main|article|article-body|articlebody|entry-content|post-content|main-content)(?:$|\s)")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp|noembed|noframes)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^<>]*(?:>|\Z)", re.S | re.I)
ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b|\baria-hidden\s*=\s*[\"']?(true)|\bstyle\s*=\s*[\"'][^\"']*display\s*:\s*(none)", re.I)
WHITE = re.compile(r"\s+")
DIGITS = re.compile(r"\d{3,}")
#: A place is template if its text was the same on all pages that have it, and on so many at least.
CONSTANT_PAGES = 3
#: The article lies in a part of a place that has so much of its text; in an article element that has so much of the page's.
MOST, ENOUGH = 0.7, 0.3
#: Blocks within blocks in the tree. What lies deeper hangs there in page order, excluded if what it lies in is.
DEPTH = 150
#: Places that a task counts before it hands its counts on.
FLUSH_PLACES = 50_000
#: References and wrappers of all hosts are sent to every task up to this size; beyond, they are joined by host.
BROADCAST_BYTES = 8 << 20


class Node:
    """A block element: its key, whether its role excludes it, and text pieces and blocks in order."""

    __slots__ = ("dropped", "items", "key", "links", "tag")

    def __init__(self, tag: str, key: str, dropped: bool):
        self.tag, self.key, self.dropped, self.items, self.links = tag, key, dropped, [], 0


def parse(page: str) -> Node:
    """The block tree of a page, tag soup included: what is left open closes with what encloses it."""
    root = Node("html", "html", False)
    open_, text, at, linked = [root], [], 0, 0
    there: Counter[str] = Counter()  # open elements by tag
    unsure: list[tuple] = []  # open elements whose links will tell: depth, node, and what was there before
    deep: list[Node] = []  # blocks beyond the depth that such an element may hold
    seen = seen_links = 0

    def flush():
        if text:
            whole = WHITE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if whole:
                open_[-1].items.append(whole)

    def cut(k: int):
        """Closes all from the k-th open element on."""
        flush()
        while unsure and unsure[-1][0] >= k:
            _, node, chars, links, held = unsure.pop()
            if 2 * (seen_links - links) > seen - chars:
                for n in (node, *deep[held:]):
                    n.dropped = True
                del deep[held:]
        if not unsure:
            deep.clear()
        there.subtract(n.tag for n in open_[k:])
        del open_[k:]
        if len(open_) > DEPTH:  # what follows in an element beyond the depth stands behind what was closed
            n = open_[-1]
            open_[-1] = Node(n.tag, n.key, n.dropped)
            open_[DEPTH - 1].items.append(open_[-1])
            if unsure:
                deep.append(open_[-1])

    def close(names, stop=()):
        if not any(there[n] for n in names):
            return
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in names:
                cut(k)
                return
            if open_[k].tag in stop:
                return

    for m in TAG.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            seen += len(piece.strip())
            if linked:
                open_[-1].links += len(piece)
                seen_links += len(piece.strip())
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                linked = 0
            elif tag not in INLINE and tag not in ("html", "body"):
                close((tag,))
            continue
        if tag in INLINE:
            if tag == "br" or tag == "wbr" or tag == "img":
                text.append(" ")
            elif tag == "a":
                linked = 1
            continue
        flush()
        if tag in ENDS_P:
            close(("p",), ("td", "th", "li", "div", "article", "section", "main", "body", "blockquote", "aside", "nav", "header", "footer", "form"))
        if tag in ENDS_SAME:
            close(ENDS_SAME[tag], SCOPE[tag])
        if tag in VOID:
            continue
        if tag == "html":
            continue
        names, main, hidden = _attributes(m[4]) if m[4] else ("", False, False)
        if tag == "body":
            for k in range(1, len(open_)):
                if open_[k].tag == "head":
                    cut(k)
                    break
        key = DIGITS.sub("#", f"{tag}.{names.split()[0]}".replace("|", "-")) if names.split() else tag
        role = _role(tag, names) if names and tag not in ("body", "article", "main") else 0
        dropped = tag in DROPPED or hidden or role == 2
        node = Node(tag, "main" if main and not dropped else key, dropped)
        if role == 1 and not dropped:
            unsure.append((len(open_), node, seen, seen_links, len(deep)))
        if len(open_) > DEPTH:
            node.dropped = node.dropped or open_[-1].dropped
            if unsure:
                deep.append(node)
        open_[min(len(open_), DEPTH) - 1].items.append(node)
        open_.append(node)
        there[tag] += 1
    if at < len(page):
        text.append(page[at:])
    cut(1)
    return root


@functools.lru_cache(maxsize=10_000)
def _attributes(raw: str) -> tuple[str, bool, bool]:
    """Class, id and role words; whether they name the main part; whether the element is hidden."""
    words, hidden = [], False
    for m in ATTR.finditer(raw):
        hidden = hidden or bool(m[5] or m[6] or m[7])
        words.append((m[2] or m[3] or m[4] or "").lower())
    names = " ".join(filter(None, words))
    return names, bool(MAIN.search(names)), hidden


@functools.lru_cache(maxsize=10_000)
def _role(tag: str, names: str) -> int:
    """2 if its names exclude an element, 1 if most of its text has to be links for that, else 0."""
    words = set(re.split(r"[\s_-]+", names))
    if words & (ROLES - {"header"} if tag in HEADINGS else ROLES) or "sr-only" in names.split():
        return 2
    found = 0
    for name in names.split():
        parts = set(re.split("[_-]+", name))
        rest = parts - OPEN
        if rest != parts:
            found = max(found, 2 if rest & FURNITURE or (not rest and tag in CONTAINERS) else 1)
    return found


def runs(node: Node) -> list[list[Node]]:
    """The child blocks, neighbours of one key together: repeats of a list are one slot."""
    out: list[list[Node]] = []
    for x in node.items:
        if isinstance(x, Node):
            if out and out[-1][0].key == x.key:
                out[-1].append(x)
            else:
                out.append([x])
    return out


# A shape is the key of a run and the shapes of the runs within it.
def shape(members: list[Node]) -> tuple:
    """The shape of a run: of its members the one with the most runs stands for all."""
    return members[0].key, max((tuple(shape(r) for r in runs(n)) for n in members), key=len)


@functools.lru_cache(maxsize=100_000)
def matching(a: tuple, b: tuple) -> int:
    """Simple tree matching: how many nodes the largest top-down, order-keeping match of two shapes has."""
    if a[0] != b[0]:
        return 0
    head, tail = _ends(a[1], b[1])
    same = sum(map(weight, (*a[1][:head], *a[1][len(a[1]) - tail :])))
    return 1 + same + _table(a[1][head : len(a[1]) - tail], b[1][head : len(b[1]) - tail])[-1][-1]


@functools.lru_cache(maxsize=100_000)
def weight(a: tuple) -> int:
    """The nodes of a shape, all of which match in itself."""
    return 1 + sum(map(weight, a[1]))


def _ends(a: tuple, b: tuple) -> tuple[int, int]:
    """How many shapes are equal at the beginning, and how many behind them at the end: they match each other in a largest match."""
    most, head, tail = min(len(a), len(b)), 0, 0
    while head < most and a[head] == b[head]:
        head += 1
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head, tail


def _table(a: tuple, b: tuple) -> list[list[int]]:
    """The most matched nodes between the first i shapes of a and the first j of b."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + matching(x, y))
    return best


@functools.lru_cache(maxsize=100_000)
def aligned(a: tuple, b: tuple) -> dict[int, int]:
    """Which shapes of a match which of b, in a largest match."""
    head, tail = _ends(a, b)
    out = {i: i for i in range(head)} | {len(a) - k: len(b) - k for k in range(1, tail + 1)}
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    best, i, j = _table(a, b), len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out[head + i] = head + j
    return out


def places(page: Node, reference: tuple) -> dict[str, list[Node]]:
    """The blocks of a page by place. A place is the way through the reference; what has no match there goes by its key."""
    out: dict[str, list[Node]] = {}

    def visit(members: list[Node], like: tuple | None, place: str):
        out.setdefault(place, []).extend(members)
        for node in members:
            groups = runs(node)
            match = aligned(tuple(map(shape, groups)), like[1]) if like and groups else {}
            for i, group in enumerate(groups):
                if i in match:
                    visit(group, like[1][match[i]], f"{place}|{match[i]}")
                else:
                    visit(group, None, f"{place}|+{group[0].key}")

    visit([page], reference if reference[0] == page.key else None, "")
    return out


def counts(found: dict[str, list[Node]]) -> dict[str, tuple]:
    """Of each place of a page: key, checksum of its own text, characters, linked characters, whether it is excluded."""
    out = {}
    for place, members in found.items():
        text = [x for n in members for x in n.items if isinstance(x, str)]
        check = zlib.crc32("\n".join(text).encode("utf-8", "surrogatepass"))
        out[place] = members[0].key, check, sum(map(len, text)), sum(n.links for n in members), all(n.dropped for n in members)
    return out


class Place:
    """Counts of a place over the pages of a host."""

    __slots__ = ("chars", "free", "inner", "key", "links", "out", "pages", "template")

    def __init__(self, key, pages, constant, chars, links, out):
        self.key, self.pages, self.chars, self.links, self.out = key, pages, chars, links, out
        self.template, self.inner, self.free = bool(constant and pages >= CONSTANT_PAGES and chars), [], 0


def wrapper(found: dict[str, Place]) -> tuple[str, list[str]]:
    """The article's place, and the places of template; no template where nothing varies."""
    if not any(p.chars and not p.template and not p.out for p in found.values()):
        for p in found.values():
            p.template = False
    for name in sorted(found, key=lambda n: -n.count("|")):  # from within
        p = found[name]
        p.free = 0 if p.out else p.free + (0 if p.template else max(p.chars - p.links, 0))
        if name:
            parent = found.get(name.rpartition("|")[0])
            if parent:
                parent.free += p.free
                parent.inner.append(name)
    element = lambda p: p.key.split(".")[0]
    at = ""
    while at in found and element(found[at]) != "article":
        p = found[at]
        inner = [n for n in p.inner if found[n].inner or element(found[n]) in ("article", "main")]
        best = max(inner, key=lambda n: (found[n].free, n), default=None)
        headed = any(re.fullmatch("h[1-3]", element(found[n])) and found[n].free for n in p.inner)
        if best is None or found[best].free < MOST * max(p.free, 1) or (headed and element(found[best]) != "article"):
            break
        at = best
    if at in found and element(found[at]) not in ("article", "main"):
        # an element that says so, with a good part of the text
        named = [n for n, p in found.items() if element(p) in ("article", "main") and n.startswith(at) and not p.out]
        best = max(named, key=lambda n: (found[n].free, n.count("|"), n), default=None)
        if best is not None and found[best].free >= ENOUGH * max(found[at].free, 1):
            at = best
    return at, sorted(n for n, p in found.items() if p.template)


def extract(page: Node, reference: tuple, at: str, template: frozenset) -> str:
    """The article's blocks, one per line; a page without its host's place has its own."""
    found = places(page, reference)
    if at not in found:
        own = shape([page])
        found = places(page, own)
        at, _ = wrapper({k: Place(c[0], 1, False, *c[2:]) for k, c in counts(found).items()})
        template = frozenset()
    skipped = {id(n) for place in template & found.keys() for n in found[place]}
    blocks: list[str] = []

    def write(node: Node):
        for x in node.items:
            if not isinstance(x, str):
                if not x.dropped:
                    write(x)
            elif id(node) not in skipped:
                blocks.append(x)

    for node in found[at]:
        write(node)
    return "\n".join(blocks)


@functools.lru_cache(maxsize=4096)
def _loaded(reference: str) -> tuple:
    return _tuples(json.loads(reference))


def _tuples(x: list) -> tuple:
    return x[0], tuple(map(_tuples, x[1]))


def _references(batches):
    for batch in batches:
        shapes = [json.dumps(shape([parse(page)])) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("__host"), pa.array(shapes, pa.string())], ["__host", "__reference"])


def _counted(batches):
    held: dict[tuple, list] = {}

    def out():
        names = ("__host", "place", "key", "pages", "least", "most", "chars", "links", "outs")
        rows = [(*k, *v) for k, v in held.items()]
        return pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)))

    for batch in batches:
        for piece in slices(batch, "__html"):
            for host, page, reference in zip(*(piece.column(c).to_pylist() for c in ("__host", "__html", "__reference")), strict=True):
                for place, (key, check, chars, links, dropped) in counts(places(parse(page), _loaded(reference))).items():
                    h = held.setdefault((host, place), [key, 0, check, check, 0, 0, 0])
                    h[:] = min(h[0], key), h[1] + 1, min(h[2], check), max(h[3], check), h[4] + chars, h[5] + links, h[6] + dropped
            if len(held) > FLUSH_PLACES:
                yield out()
                held.clear()
    if held:
        yield out()


def _induced(group: pd.DataFrame) -> pd.DataFrame:
    found = {r.place: Place(r.key, r.pages, r.least == r.most, r.chars, r.links, 2 * r.outs > r.pages) for r in group.itertuples()}
    at, template = wrapper(found)
    return pd.DataFrame({"__host": [group["__host"].iloc[0]], "__at": [at], "__template": [template]})


def extract_pages(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """pages with text and n_chars.

    The text is empty where the html is null, empty or has no article text. Words that name
    article text as well (related-work) exclude an element only if most of its text is links. Pages without a
    host in their url share one wrapper. Equal pages get equal texts; a host whose pages are
    all the same has no template but what is excluded. Input columns named text or n_chars are
    replaced; names that begin with two underscores are this function's own.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    pages = pages.drop("text", "n_chars")
    names = pages.columns
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    ready = pages.withColumns({"__host": host, "__html": F.coalesce(F.col(page), F.lit(""))})
    # one page of each host, reduced in the tasks that read them
    chosen = ready.filter("__html != ''").groupBy("__host").agg(F.min(F.struct(F.xxhash64("__html"), "__html"))["__html"].alias("html"))
    references = materialize(chosen.mapInArrow(_references, "__host string, __reference string"))
    send = _sent(references)
    counted = ready.select("__host", "__html").join(send(references), "__host").mapInArrow(_counted, "__host string, place string, key string, pages long, least long, most long, chars long, links long, outs long")
    summed = counted.groupBy("__host", "place").agg(F.min("key").alias("key"), F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"), *[F.sum(c).alias(c) for c in ("chars", "links", "outs")])
    # places of one page alone that aren't the reference's tell nothing about the host
    told = summed.filter((F.col("pages") > 1) | ~F.contains("place", F.lit("+")))
    wrappers = told.groupBy("__host").applyInPandas(_induced, "__host string, __at string, __template array<string>")
    wrappers = materialize(references.join(wrappers, "__host"))
    joined = ready.join(_sent(wrappers)(wrappers), "__host", "left")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), "text string"])

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "__html"):
                columns = (piece.column(c).to_pylist() for c in ("__html", "__reference", "__at", "__template"))
                texts = [extract(parse(source), _loaded(reference), at, frozenset(template)) if source else "" for source, reference, at, template in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(texts, pa.string())], [*names, "text"])

    return joined.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def _sent(table_: DataFrame):
    """How to join a table of hosts: sent to every task if its size, which is counted, is small."""
    size = F.length("__host") + sum((F.length(F.col(c)) if kind == "string" else F.length(F.array_join(c, "|")) for c, kind in table_.dtypes), F.lit(64))
    held = table_.agg(F.sum(size)).first()[0] or 0
    return F.broadcast if held <= BROADCAST_BYTES else (lambda df: df)


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
