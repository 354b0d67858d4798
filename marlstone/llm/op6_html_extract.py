"""HTML extraction with a site style tree.

The DOMs of a host's pages are merged by path (tags with the words of their
class, id and role).  A path that ``m`` pages have gets

* presentation importance: the entropy, to the base ``m``, of its child
  sequences over the pages (one sequence everywhere gives 0);
* content importance: one less the mean entropy of its texts, where a text that
  ``d`` of the pages share has ``log_m d`` (a text of its own gives 0);
* both combined as ``(1 - g**l) * presentation + g**l * content`` for ``l``
  child sequences and ``g = 0.9``, times a prior from the names: elements called
  menus, headers, footers, sidebars, notices, adverts, forms or comments have 0,
  and inside a marked article those whose names only hint at one (``HINTS``, or one
  word of a longer name, as in ``notice-board``) have 0.5.

Branches of low importance whose texts are shared as well (low content
importance) are cut from each page; a hint doubles what counts as low.  What is
left is joined block by block.  If a page marks its article, nothing outside it
counts; inside, the tree decides of blocks as it does elsewhere, and inline
elements stay with their block.

Each of ``n`` equal pages of a host counts ``1/n``; which pages have copies is
found by the digests of host and page, and joined to the pages.  Each task folds
its pages' counts first, and counts are plain grouped sums, so a host with a
third of all pages is no hot spot.  The paths to cut are joined to the pages by
host.  Both joins broadcast at most ``BROADCAST_ROWS``, else they shuffle.

Defined results: a null or empty html gives an empty text.  A null url is a
host of its own.  Broken markup never fails: unclosed elements end with their
parents, an unclosed comment hides the rest.  Equal pages of a host count as one
page in its tree and give equal texts; ``html`` and ``body`` are never cut.  A
path on fewer than ``LEAST_PAGES`` distinct pages is judged by names alone.  Very
long pages are read whole; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

GAMMA = 0.9
LEAST_IMPORTANCE = 0.2
#: Distinct pages that a path must be on: fewer tell too little of what a host repeats, near copies of an article least of all.
LEAST_PAGES = 4
BROADCAST_ROWS = 200_000
#: Counts that a task folds before it hands them on.
FOLDED = 200_000

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
HIDDEN = frozenset("head script style noscript template iframe svg math canvas object embed audio video select option button input textarea datalist title".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("html body br caption td th tr tbody thead tfoot legend".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("article section main div td th ul ol dl table nav aside header footer form body html".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer form gdpr header legal login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo navigation".split()
)
#: Of these, names that an article's own content may have too.
HINTS = frozenset("banner header legal login masthead search share sharing skip social toolbar widget widgets".split())
ARTICLES = ("article", "main")
KEPT = ("html", "body", *ARTICLES)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PLAIN = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    """An element; ``names`` are the words of its class, id and role, ``tokens`` the words of each of these names."""

    __slots__ = ("tag", "names", "tokens", "inner")

    def __init__(self, tag: str, tokens: tuple[tuple[str, ...], ...] = ()):
        self.tag, self.tokens = tag, tokens
        self.names = tuple(dict.fromkeys(x for t in tokens for x in t))
        self.inner: list[Node | str] = []


def parse(text: str) -> Node:
    """A tolerant DOM of the whole page."""
    root = Node("#page")
    stack, at, n = [root], 0, len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            stack[-1].inner.append(text[at:])
            break
        if m.start() > at:
            stack[-1].inner.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in FENCES and tag not in FENCES and tag not in ARTICLES:
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, {"p"})
        if tag in CLOSES:
            _close(stack, CLOSES[tag])
        names = [w for f in _NAMES.finditer(m[3]) for w in (f[2] or f[3] or f[4] or "").split()] if m[3] else []
        node = Node(tag, tuple(tuple(x.lower() for x in _PLAIN.findall(_CAMEL.sub(r"\1 \2", w))) for w in names))
        stack[-1].inner.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)
            node.inner.append(text[at : end.start()] if end else text[at:])
            at = end.end() if end else n
        elif tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Node], tags: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in FENCES:
            return


def prior(node: Node, inside: bool) -> float:
    """0 for elements whose names call them boilerplate, 0.5 for a hint inside an article, else 1."""
    if node.tag in HIDDEN or node.tag in BOILER_TAGS or (node.tag == "header" and not inside):
        return 0
    if node.tag in KEPT and not {"comment", "comments"} & set(node.names):
        return 1
    if not BOILER_NAMES & set(node.names):
        return 1
    if not inside:
        return 0
    return 0 if any(t and BOILER_NAMES.issuperset(t) and not HINTS.issuperset(t) for t in node.tokens) else 0.5


def blocks(node: Node, cut, path: int = 0, inside: bool = False) -> list[str]:
    """Texts of the blocks that stay, in page order; ``cut`` tells of a path and a prior whether it goes."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(references.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)

    # Depth lives in a list, so deep nesting can't exhaust Python's stack.
    todo: list[tuple] = [(node, path, inside, False)]
    while todo:
        what, at, within, closing = todo.pop()
        if closing or isinstance(what, str):
            if closing:
                flush()
            else:
                line.append(what)
            continue
        if what.tag != "#page":
            at = _step(at, what)
            weight = prior(what, within)
            if not weight or (what.tag not in KEPT and (not within or what.tag in BLOCKS) and cut(at, weight)):
                continue
        block = what.tag in BLOCKS
        if block:
            flush()
            todo.append((what, at, within, True))
        within = within or what.tag in ARTICLES
        todo += [(x, at, within, False) for x in reversed(what.inner)]
    flush()
    return out


def _step(path: int, node: Node) -> int:
    return xxhash.xxh64_intdigest(f"{path} {node.tag} {'.'.join(node.names)}")


def articles(root: Node) -> list[tuple[Node, int]]:
    """The outermost elements that the page marks as its article, each with the path above it."""
    for tag in ARTICLES:
        found, todo = [], [(root, 0)]
        while todo:
            x, above = todo.pop()
            if x.tag == tag and prior(x, True):
                found.append((x, above))
            elif x.tag == "#page" or prior(x, False):
                at = above if x.tag == "#page" else _step(above, x)
                todo += [(y, at) for y in reversed(x.inner) if isinstance(y, Node)]
        if found:
            return found
    return []


def extract(page: str | None, cut=lambda path, weight: False) -> str:
    if not page:
        return ""
    root = parse(page)
    marked = articles(root)
    if marked:
        return "\n".join(b for a, above in marked for b in blocks(a, cut, above, inside=True))
    return "\n".join(blocks(root, cut))


def _hosts(url: str):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST.pattern, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def styles(page: str) -> Iterator[tuple[int, int, int]]:
    """Of each path with content: (path, hash of its child sequence, hash of its text), once a page."""
    seen: dict[int, list] = {}

    def visit(root: Node) -> None:
        order: list[tuple[Node, int, int]] = []
        todo = [(root, 0, -1)]
        while todo:
            x, at, above = todo.pop()
            at = at if x.tag == "#page" else _step(at, x)
            if x.tag in HIDDEN:
                continue
            order.append((x, at, above))
            me = len(order) - 1
            todo += [(y, at, me) for y in reversed(x.inner) if isinstance(y, Node)]
        texts: list[list[str]] = [[] for _ in order]
        for k in range(len(order) - 1, -1, -1):
            x, at, above = order[k]
            own = xxhash.xxh64()
            for y in x.inner:
                if isinstance(y, str):
                    own.update(" ".join(y.split()))
            own.update(" ".join(reversed(texts[k])))
            digest = own.hexdigest()
            if above >= 0:
                texts[above].append(digest)
            had = seen.setdefault(at, [[], []])
            had[0].append(" ".join(f"{y.tag}.{'.'.join(y.names)}" for y in x.inner if isinstance(y, Node)))
            had[1].append(digest)

    visit(parse(page))
    seen.pop(0, None)
    for at, (shapes, digests) in seen.items():
        yield _signed(at), _signed(xxhash.xxh64_intdigest("|".join(shapes))), _signed(xxhash.xxh64_intdigest("|".join(digests)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    folded: Counter = Counter()

    def given() -> pa.RecordBatch:
        rows = list(folded.items())
        folded.clear()
        cols = list(zip(*(k for k, _ in rows), strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array([n for _, n in rows], pa.float64())], ["host", "path", "kind", "feature", "n"])

    for batch in batches:
        for name, page, copies in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "copies")), strict=True):
            if not page:
                continue
            share = 1 / (copies or 1)
            for path, style, content in styles(page):
                folded[(name, path, 0, style)] += share
                folded[(name, path, 1, content)] += share
            if len(folded) >= FOLDED:
                yield given()
    yield given()


def _with_copies(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, html, copies) of every page; ``copies`` is null for one that its host has once."""
    rows = pages.select(_hosts("url").alias("host"), "html", F.xxhash64("html").alias("digest")).filter("html <> ''")
    copied = scratch.table(rows.groupBy("host", "digest").agg(F.count("*").alias("copies")).filter("copies > 1"), "copies")
    if copied.count() <= BROADCAST_ROWS:
        copied = F.broadcast(copied)
    return rows.join(copied, ["host", "digest"], "left").select("host", "html", "copies")


def style_tree(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(host, path, pages, presentation, content, importance) of the merged DOMs of distinct pages."""
    rows = _with_copies(pages, scratch or Scratch(pages.sparkSession, "style-tree"))
    counts = rows.mapInArrow(_counts, "host string, path long, kind int, feature long, n double")
    # Shares of equal pages add up to whole numbers.
    each = counts.groupBy("host", "path", "kind", "feature").agg(F.round(F.sum("n")).cast("long").alias("n"))
    pages_of = F.sum(F.when(F.col("kind") == 0, F.col("n")))
    # With p = n / m: the entropy is log m - sum(n log n) / m; the mean of log_m(n) over texts is sum(n log n) / (m log m).
    n_log_n = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n") * F.log(F.col("n"))).otherwise(0.0))
    per = each.groupBy("host", "path").agg(pages_of.alias("pages"), n_log_n(0).alias("s0"), n_log_n(1).alias("s1"), F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).alias("styles"))
    m = F.col("pages")
    many = m > 1
    presentation = F.when(many, 1 - F.col("s0") / (m * F.log(m))).otherwise(1.0)
    content = F.when(many, 1 - F.col("s1") / (m * F.log(m))).otherwise(1.0)
    weight = F.pow(F.lit(GAMMA), F.col("styles"))
    out = per.withColumn("presentation", presentation).withColumn("content", content)
    return out.withColumn("importance", (1 - weight) * F.col("presentation") + weight * F.col("content")).select("host", "path", "pages", "presentation", "content", "importance")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, low, hinted in zip(batch.column("html"), batch.column("low"), batch.column("hinted"), strict=True):
            gone, also = ({x & ((1 << 64) - 1) for x in paths.as_py() or ()} for paths in (low, hinted))
            texts.append(extract(page.as_py(), lambda path, weight, gone=gone, also=also: path in gone or weight < 1 and path in also))
        rest = batch.select(["page_id", "url"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, cut by its host's style tree."""
    scratch = Scratch(pages.sparkSession, "style-tree")
    most = F.greatest("importance", "content")
    low = style_tree(pages, scratch).filter((most < 2 * LEAST_IMPORTANCE) & (F.col("pages") >= LEAST_PAGES))
    sets = [F.collect_set(F.when(most < LEAST_IMPORTANCE, F.col("path"))).alias("low"), F.collect_set(F.when(most >= LEAST_IMPORTANCE, F.col("path"))).alias("hinted")]
    low = scratch.table(low.groupBy("host").agg(*sets), "low")
    size = low.agg(F.sum(F.size("low") + F.size("hinted") + 4)).first()[0] or 0
    if size <= BROADCAST_ROWS:
        low = F.broadcast(low)
    rows = pages.select("page_id", "url", "html", _hosts("url").alias("host")).join(low, "host", "left").select("page_id", "url", "html", "low", "hinted")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
