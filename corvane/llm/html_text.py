"""Main text of web pages, with site template removal.

Every page is parsed once into text blocks and the element subtrees around them, each with a hash of its source. Spark
counts for each host on how many different pages a subtree recurs; blocks inside subtrees that recur on many are deleted.
Elements whose meaning is boilerplate whatever their text (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, scripts) are dropped while parsing, since their texts often differ from page to page and a host may have too few
pages to tell; what their tag, role or whole class name does not say is left to the counts alone (``names`` false: class
names say nothing).

Only subtrees that may recur are counted exactly: a first count of hash cells, whose bitmap has a fixed size, rules out the
rest, and only pages with a template in their text leave their place for a join.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITS, discard, maybe_in, stage

#: A subtree is a template if it recurs on so many of its host's pages of different text: the first number at least, and
#: beyond that this share of the pages or the last number, whichever is less, so that large hosts need no more than that.
COUNTS = (3, 0.2, 50)
#: The same for paragraphs, headings and quotations inside an article, where a text that recurs now and then is still text.
TEXT_COUNTS = (20, 0.5, 250)

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
_SPACED = frozenset("br td th wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript".split())
_DROP = frozenset(
    "head script style title noscript template nav footer aside form button select textarea input iframe object svg canvas dialog menu audio video search map datalist".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored banner cookie cookies consent gdpr notice popup newsletter subscribe signup login "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination header footer masthead comment comments commentlist respond disqus replies".split()
)
#: What a class or id may have before or after a name of _NAMES, with a hyphen between, and still be one: site-footer, sidebar-left.
_BEFORE = frozenset("site page main top bottom global primary secondary left right user reader".split())
_AFTER = frozenset("bar box list links wrapper container section area block top bottom left right form".split())
#: Template hits are joined by a broadcast where a template has more than this share of all hits; at most 1 / HOT have.
HOT = 1e-3
#: Inside the article all blocks but these need TEXT_COUNTS.
_CONTAINERS = frozenset("div section ul ol dl table figure details fieldset center".split())
#: Start tags that end an open element of the same kind.
_SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_STOP = {"li": frozenset(("ul", "ol", "menu")), "dd": frozenset(("dl",)), "dt": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "option": frozenset(("select",))}


def _named(value: str) -> bool:
    """Whether one of the names in a class or id is, as a whole, one of boilerplate."""
    for name in value.strip("\"'").lower().replace("_", "-").split():
        first, _, last = name.partition("-")
        if name in _NAMES or (first in _NAMES and last in _AFTER) or (first in _BEFORE and last in _NAMES):
            return True
    return False


def _boilerplate(tag: str, attrs: str, in_article: bool, names: bool) -> bool | None:
    """True for boilerplate by tag, role or hiding; None by class or id alone, which holds only for elements without an article."""
    if tag in _DROP or (tag == "header" and not in_article):
        return True
    named = False
    if not attrs or attrs.isspace() or tag in ("html", "body", "main"):
        return False
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        if name == "hidden":
            return True
        if name in ("class", "id"):
            named = named or (names and tag not in ("article", "header") and _named(value))
        elif name == "role":
            if value.strip("\"' ").lower() in _ROLES:
                return True
        elif name == "aria-hidden" and value.strip("\"' ").lower() == "true":
            return True
    return None if named else False


class _Open:
    __slots__ = ("tag", "start", "drop", "article", "first", "named")

    def __init__(self, tag: str, start: int, drop: bool, article: bool, first: int, named: int):
        self.tag, self.start, self.drop, self.article, self.first, self.named = tag, start, drop, article, first, named


def parse(page: str | None, names: bool = True) -> tuple[list[str], list[tuple[int, int, int, bool]]]:
    """(blocks, elements): the blocks of text that can be main text, in page order, and (hash, first block, last block + 1,
    whether it is text of an article) of the element subtrees around them. If articles and main elements hold at least half of the text, only what is inside counts."""
    page = page or ""
    blocks: list[tuple[str, bool, int]] = []
    # elements named like boilerplate: the one around each (0 for none), and whether an article was found inside
    around, holds = [0], [True]
    elements: list[tuple[int, int, int, bool, bool]] = []
    stack: list[_Open] = []
    opened: dict[str, int] = {}  # open elements by tag, so that a stray end tag need not look through the stack
    pieces: list[str] = []
    inside = False

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                blocks.append((text, inside, stack[-1].named if stack else 0))

    def pop(to: int, end: int) -> None:
        nonlocal inside
        flush()
        while len(stack) > to:
            e = stack.pop()
            opened[e.tag] -= 1
            if not e.drop and len(blocks) > e.first and e.tag not in ("html", "body", "article", "main") and (not e.article or e.tag in _BLOCK):
                elements.append((xxhash.xxh3_64_intdigest(page[e.start : end].encode("utf-8", "surrogatepass")) - (1 << 63), e.first, len(blocks), e.article, e.article and e.tag not in _CONTAINERS))
        inside = bool(stack) and stack[-1].article

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not (stack and stack[-1].drop):
            pieces.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag in _BLOCK:
                flush()
            elif tag in _SPACED and not (stack and stack[-1].drop):
                pieces.append(" ")
            if not opened.get(tag):
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    if tag not in _BLOCK and stack[-1].named != (stack[i - 1].named if i else 0):
                        flush()
                    if tag in _BLOCK:
                        pop(i, at)
                    else:
                        for e in stack[i:]:
                            opened[e.tag] -= 1
                        del stack[i:]
                    break
                if tag not in _BLOCK and stack[i].tag in _BLOCK:  # an inline element closes only itself, if no block stands between
                    break
            continue
        dropped, article = (stack[-1].drop, stack[-1].article) if stack else (False, False)
        if tag in _BLOCK:
            flush()
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[i].tag == "p":
                    pop(i, m.start())
                    break
                if stack[i].tag in _BLOCK:
                    break
            dropped, article = (stack[-1].drop, stack[-1].article) if stack else (False, False)
        if tag in _SAME:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in _STOP[tag]:
                    break
                if stack[i].tag in _SAME[tag]:
                    pop(i, m.start())
                    break
            dropped, article = (stack[-1].drop, stack[-1].article) if stack else (False, False)
        if tag in _SPACED and not dropped:
            pieces.append(" ")
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag in _DROP or dropped:
                at = end.end() if end else size
                continue
        if attrs.endswith("/") and tag not in _BLOCK:
            continue
        kind = dropped or _boilerplate(tag, attrs, article, names)
        drop, named = bool(kind), stack[-1].named if stack else 0
        if (drop and not dropped) or kind is None:
            flush()
        if kind is None:
            around.append(named)
            holds.append(False)
            named = len(holds) - 1
        elif tag in ("article", "main") and not drop:
            i = named
            while i and not holds[i]:
                holds[i], i = True, around[i]
        inside = article or (tag in ("article", "main") and not drop)
        stack.append(_Open(tag, m.start(), drop, inside, len(blocks), named))
        opened[tag] = opened.get(tag, 0) + 1
    pop(0, size)
    good = [True]
    for i in range(1, len(holds)):
        good.append(holds[i] and good[around[i]])
    sizes = [0, 0]
    for text, ok, named in blocks:
        if good[named]:
            sizes[ok] += len(text)
    only = sizes[1] >= sizes[0] and sizes[1] > 0
    kept, place = [], [0]
    for text, ok, named in blocks:
        if good[named] and (ok or not only):
            kept.append(text)
        place.append(len(kept))
    return kept, [(h, place[a], place[b], text) for h, a, b, article, text in elements if (article or not only) and place[b] > place[a]]


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def parse_pages(pages: DataFrame, names: bool = True) -> DataFrame:
    """page_id, url, host, blocks, elements, print (hash of the text) of every page, with a row number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("text", pa.bool_())]))
        for b in batches:
            found = [parse(p, names) for p in b.column(3).to_pylist()]
            blocks = pa.array([x[0] for x in found], pa.list_(pa.string()))
            spans = pa.array([[{"hash": h, "first": i, "last": j, "text": t} for h, i, j, t in x[1]] for x in found], kind)
            prints = pa.array([xxhash.xxh3_64_intdigest("\n".join(x[0]).encode("utf-8", "surrogatepass")) - (1 << 63) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], blocks, spans, prints], ["page_id", "url", "host", "blocks", "elements", "print"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    return rows.mapInArrow(run, "page_id bigint, url string, host string, blocks array<string>, elements array<struct<hash:bigint,first:int,last:int,text:boolean>>, print bigint")


def _recurring(parsed: DataFrame, least: int) -> DataFrame:
    """row, host, print and element of the subtrees whose hash cell has ``least`` occurrences: all that recur, and a few more."""
    spans = parsed.where(F.size("elements") > 0).select("row", "host", "print", F.explode("elements").alias("e"))
    spans = spans.select("row", "host", "print", "e.*").withColumn("_cell", F.pmod(F.xxhash64("host", "hash", "text"), F.lit(BITS)))
    word, bit = F.floor(F.col("_cell") / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("_cell", F.lit(64)).cast("int"))
    often = spans.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    words = often.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))  # BITS / 64 rows at most
    held = spans.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(words), "_word")
    return held.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).drop("_word", "_bit", "_bits", "_cell")


def templates(parsed: DataFrame, counts: tuple[int, float, int] = COUNTS, text_counts: tuple[int, float, int] = TEXT_COUNTS, spans: DataFrame | None = None) -> DataFrame:
    """(host, hash, text, n) of subtrees that recur on n pages; copies of one page count once."""
    if spans is None:
        spans = _recurring(parsed, min(counts[0], text_counts[0]))
    pages = parsed.select("host", "print").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    often = spans.select("host", "print", "hash", "text").distinct().groupBy("host", "hash", "text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(counts[0], text_counts[0]))
    least = lambda c: F.greatest(F.lit(float(c[0])), F.least(F.lit(float(c[2])), c[1] * F.col("pages")))
    return often.join(pages, "host").where(F.col("n") >= F.when(F.col("text"), least(text_counts)).otherwise(least(counts))).select("host", "hash", "text", "n")


def extract(pages: DataFrame, names: bool = True) -> DataFrame:
    """op10: page_id, url, text, n_chars of every row; null or empty html gives an empty text. Repeated rows stay."""
    parsed = stage(parse_pages(pages, names).withColumn("row", F.monotonically_increasing_id()), "pages")
    spans = stage(_recurring(parsed, min(COUNTS[0], TEXT_COUNTS[0])), "spans")
    found = stage(templates(parsed, spans=spans), "templates")
    keys, most = ["host", "hash", "text"], HOT * max(1, spans.count())
    # n counts pages of different text, which are no more than a template's hits, so hot ones are at most 1 / HOT
    hot = F.broadcast(found.where(F.col("n") > most).select(*keys))
    rare = spans.join(hot, keys, "left_anti").join(found.where(F.col("n") <= most).select(*keys), keys)
    hits = spans.join(hot, keys).select("row", "first", "last").unionByName(rare.select("row", "first", "last"))
    hits = stage(hits.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("gone")), "hits")
    discard(spans, found)
    # pages without a template in their text stay where they are
    rows = parsed.select("page_id", "url", "blocks", "row")
    clean = maybe_in(rows, "row", hits.select("row"), inside=False).withColumn("gone", F.lit(None).cast(hits.schema["gone"].dataType))
    out = maybe_in(rows, "row", hits.select("row")).join(hits, "row", "left").unionByName(clean)
    kept = F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b, i: ~F.exists("gone", lambda g: (g["first"] <= i) & (i < g["last"]))))
    text = F.array_join(kept, "\n\n")
    return out.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))
