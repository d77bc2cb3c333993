"""Main text of web pages with a site style tree (after Yi, Liu and Li, 2003).

The pages of a host are merged into one tree. A node of it is a path of block elements (tag, class and id without
digits); it holds the contents found there, which are the blocks of text that the pages show, and the presentations, which
are the sequences of its children. Over the m pages that have a node, a content seen on n of them has the importance
1 - log_m(n): 1 if it is found on one page only, 0 if on all. The importance of presentation is the entropy of a node's l
different presentations to the base m. A branch is as important as (1 - 0.9^l) of the latter and 0.9^l of the mean of
what it holds, but no less than that mean, which is weighted by length, so that a story among buttons stays. From each page the branches of low importance are
removed, inside article and main as well as outside. A node needs ``min_pages`` different pages before it says anything.

Boilerplate that differs from page to page has a high entropy, which no tree can tell from an article. So tags, roles and
class names that say nothing but boilerplate (``sidebar``, ``cookie-banner``) mark branches at once; names that only hold such a
word (``social-history``) are a tie-break: such a branch is removed at a higher importance than others, and never without the tree.
Headings, list items and table cells go only with the branch that holds them.

Inside article and main, where a copied story looks like boilerplate, a branch must be nearly worthless, and
where the tree would take the greater part of the text it takes nothing.

Merging is a grouped count over (host, node, content); a host's tree is never in one place. Parsing takes
time in proportion to the page, well-formed or not.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.scratch import Scratch

# Fixed values of HTML: tags without an end tag, with raw text, that are never shown, that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSHOWN = frozenset("head script style template title iframe noembed noframes noscript object svg math canvas audio video map datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())  # may stand in head; anything else ends it
# What this module takes for boilerplate.
CHROME = frozenset("nav footer aside form menu dialog button select input textarea search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar pagination pager comment comments disqus respond replies "
    "share sharing social related recommended newsletter subscribe subscription signup login search widget widgets copyright skip".split()
)
# Words that do not change what a boilerplate word beside them says.
PLAIN = frozenset(
    "site page main global primary secondary top bottom left right upper lower inner outer first last fixed sticky mobile desktop box bar block list item items links link buttons button icons icon "
    "wrapper wrap container holder section area region row column col content slot unit zone module panel strip group card cards form post posts article articles story stories text message policy media "
    "user users reader readers visitor visitors guest thread threads feed external partner google inline floating responsive small large wide vertical horizontal dark light default active popular more a b c js the and for id new my".split()
)
TALK = frozenset("comment comments disqus replies respond".split())
_EXEMPT = frozenset("html body main".split())
_NOT = frozenset("no has with without".split())
_KEPT = frozenset("html body main article h1 h2 h3 h4 h5 h6 hgroup header li dt dd tr thead tbody tfoot caption figcaption legend summary".split())  # go only with the branch that holds them
_CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist")}
_CLOSES = {tag: (closed.split(), stop.split()) for tag, (closed, stop) in _CLOSES.items()}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|style|hidden|aria-hidden)\b(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")
_ENTRY, _BROADCAST = 64, 32 << 20  # bytes that an entry of the importances takes, and that are broadcast at most
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}


class Node:
    """An element: drop marks boilerplate, named that only its name says so, weak a name that may say so; main is article or main where it is one."""

    __slots__ = ("tag", "name", "children", "drop", "main", "named", "weak", "parent")

    def __init__(self, tag: str, name: str = "", drop: bool = False, main: str = "", named: bool = False, weak: bool = False, parent: Node | None = None):
        self.tag, self.name, self.drop, self.main, self.named, self.weak, self.parent = tag, name, drop, main, named, weak, parent
        self.children: list[Node | str] = []


def _says(word: str, inside: bool) -> tuple[bool, bool, bool]:
    """What one class or id says: boilerplate, perhaps boilerplate, comments."""
    parts = {x.lower() for x in _PART.findall(word)}
    bad = NAMES & parts
    if inside:
        bad = bad - {"header"}
    if not bad or not _NOT.isdisjoint(parts):
        return False, False, False
    sure = all(p in NAMES or p in PLAIN or p.isdigit() for p in parts)
    return sure, True, sure and not TALK.isdisjoint(bad)


def _node(tag: str, attrs: str, inside: bool, parent: Node) -> Node:
    """A node and whether HTML itself marks it; inside: it lies in an article or main element."""
    drop, name, talk, named, weak = tag in CHROME or tag in UNSHOWN or (tag == "header" and not inside), "", False, False, False
    main = tag if tag in ("article", "main") else ""
    if tag == "form":  # some sites wrap the whole page in one
        drop, named = False, True
    if attrs and not drop:
        for k, v in _ATTR.findall(attrs):
            k, v = k.lower(), v.strip("\"'")
            if k in ("class", "id"):
                name += f" {k}={_DIGITS.sub('#', v)}"
                if tag in _EXEMPT:
                    continue
                for word in v.split():
                    sure, perhaps, comments = _says(word, inside)
                    named, weak, talk = named or sure, weak or perhaps, talk or comments
            elif k == "role":
                drop = drop or v.lower() in ROLES and tag not in _EXEMPT
                main = main or (v.lower() if v.lower() in ("main", "article") else "")
            elif k == "style":
                drop = drop or "display:none" in v.replace(" ", "").lower()
            elif k == "hidden" or v.lower() == "true":
                drop = drop or tag not in _EXEMPT
    if tag == "article" and not talk:
        named = False
    return Node(tag, name, drop or named, "" if drop or named else main, named and not drop, weak, parent)


def parse(page: str) -> Node:
    """The page as a tree; end tags that HTML lets one leave out are supplied, stray ones ignored.

    Every character is looked at a bounded number of times: once a tag's quotes do not close before the
    end of the page, quotes count for nothing in the rest of it.
    """
    root = Node("")
    stack, depth_main = [root], 0
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack of the open elements of a tag
    blocks: list[int] = []  # those of open blocks
    pos, n, last = 0, len(page), page.rfind(">")
    tags, loose = _TAG, False

    def pop(k: int) -> None:
        nonlocal depth_main
        while len(stack) > k:
            x = stack.pop()
            opened[x.tag].pop()
            if x.tag in BLOCK:
                blocks.pop()
            depth_main -= bool(x.main)

    def text(part: str) -> None:
        if stack[-1].tag == "head" and not part.isspace():
            pop(opened["head"][-1])
        stack[-1].children.append(part)

    top = lambda names: max((opened[t][-1] for t in names if opened[t]), default=0)
    while pos < n:
        at = page.find("<", pos)
        if at < 0 or at > last:
            text(page[pos:])
            break
        nxt = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)  # <!--> and <!---> are comments too
            m, end = None, n if end < 0 else end + 3
        elif nxt in "!?" and nxt:
            m, end = None, page.find(">", at) + 1
        elif nxt.isascii() and (nxt.isalpha() or nxt == "/"):
            m = tags.match(page, at)
            if m is None and not loose and page[at + 1 : at + 3].lstrip("/")[:1].isalpha():
                tags, loose = _LOOSE, True
                m = tags.match(page, at)
            end = m.end() if m else at + 1
            if m is None:
                text(page[pos:end])
                pos = end
                continue
        else:
            text(page[pos : at + 1])
            pos = at + 1
            continue
        if at > pos:
            text(page[pos:at])
        pos = end
        if m is None:
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            if opened[tag]:
                pop(opened[tag][-1])
            continue
        if stack[-1].tag == "head" and tag not in HEAD:  # its end tag may be left out
            pop(opened["head"][-1])
        if tag in BLOCK and opened["p"] and opened["p"][-1] == blocks[-1]:
            pop(blocks[-1])
        if tag in _CLOSES:
            closed, stop = _CLOSES[tag]
            k = top(closed)
            if k > top(stop):
                pop(k)
        node = _node(tag, attrs, depth_main > 0, stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            found = _RAW_END[tag].search(page, pos)
            pos = n if found is None else page.find(">", found.start()) + 1 or n
        elif tag not in VOID and not (attrs.endswith("/") and tag in ("svg", "math", "path", "use")):  # a slash closes no HTML element
            opened[tag].append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(node)
            depth_main += bool(node.main)
    _frames(root)
    return root


def _frames(root: Node) -> None:
    """What holds the main element, or a form that holds an article or the title, is a frame, however it is named."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.children if not isinstance(c, str)]
    main, titled = set(), set()
    for x in reversed(order):  # children come after their parents
        if x.named and (id(x) in main or x.tag == "form" and id(x) in titled):
            x.drop = x.named = False
        if not x.drop and x.parent is not None:
            if id(x) in main or x.main == "main":
                main.add(id(x.parent))
            if id(x) in titled or x.main or x.tag == "h1":
                titled.add(id(x.parent))


def _digest(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"))


class Box:
    """A block element that is not marked as boilerplate, with its blocks of text and boxes in page order."""

    __slots__ = ("tag", "path", "main", "weak", "items", "size", "worth")

    def __init__(self, tag: str, path: int, main: str, weak: bool):
        self.tag, self.path, self.main, self.weak = tag, path, main, weak
        self.items: list[Box | str] = []
        self.size, self.worth = 0, 1.0


def boxes(root: Node) -> list[Box]:
    """The boxes of a page, parents before children; the first one is the page. What lies in inline elements belongs to the block around them."""
    out = [Box("", _digest("root"), "", False)]
    run: list[str] = []
    todo: list[tuple[Node | str | None, Box]] = [(root, out[0])]

    def flush(box: Box) -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            box.items.append(text)
        run.clear()

    while todo:
        x, box = todo.pop()
        if x is None:
            flush(box)
        elif isinstance(x, str):
            run.append(x)
        elif x.drop:
            if x.tag in BLOCK:
                flush(box)
        elif x.tag in BLOCK or x.main:
            flush(box)
            inner = Box(x.tag, _digest(box.path, x.tag + x.name), x.main, x.weak)
            box.items.append(inner)
            out.append(inner)
            todo.append((None, inner))
            todo += [(c, inner) for c in reversed(x.children)]
        else:
            if x.tag in ("br", "td", "th"):
                run.append(" ")
            todo += [(c, box) for c in reversed(x.children)]
    flush(out[0])
    for box in reversed(out):
        box.items = [i for i in box.items if isinstance(i, str) or i.items]
        box.size = sum(len(i) if isinstance(i, str) else i.size for i in box.items)
    return [b for b in out if b.items]


def shape(box: Box) -> int:
    """The presentation of a box: what it holds in which order, repeats in a row once."""
    kinds = ["text" if isinstance(i, str) else i.path for i in box.items]
    return _digest(*(k for i, k in enumerate(kinds) if not i or k != kinds[i - 1]))


def features(page: list[Box]) -> Iterator[tuple[int, bool, int]]:
    """(path, whether it is a content, digest) of every content and of the presentation of every box that holds boxes."""
    for box in page:
        own = {i for i in box.items if isinstance(i, str)}
        for text in own:
            yield box.path, True, _digest(text)
        if len(own) < len(box.items) and any(not isinstance(i, str) for i in box.items):
            yield box.path, False, shape(box)


def _weigh(page: list[Box], worth: dict[int, tuple[float, float]]) -> None:
    """Sets the importance of every box: the mean of what it holds, by length, or a * mean + b if that is more; worth has (a, b) by the key of a content or path."""
    for box in reversed(page):
        total = 0.0
        for i in box.items:
            total += len(i) * worth.get(_key(box.path, True, _digest(i)), (0.0, 1.0))[1] if isinstance(i, str) else i.size * i.worth
        a, b = worth.get(_key(box.path, False, 0), (1.0, 0.0))
        box.worth = max(total / box.size, b + a * total / box.size)


def _key(path: int, content: bool, digest: int) -> int:
    """Of a content its path and digest, of a presentation its path alone; signed, as Spark keeps it."""
    return _digest(path, digest if content else "p") - 2**63


def _tops(page: list[Box]) -> tuple[list[Box], bool]:
    """Where the main text is, and whether HTML itself says so.

    The main elements and articles outside them; where there is no main element the articles, with the page's title before them if
    they hold no heading, as long as they hold a third of the text; else the page.
    """
    outer: list[Box] = []
    first: list[Box] = []
    todo: list[tuple[Box, bool]] = [(page[0], False)]
    heading = None
    while todo:
        x, inside = todo.pop()
        if x.main and not inside:
            outer.append(x)
        elif x.tag == "h1" and not outer and not inside and heading is None:
            heading = x
        todo += [(i, inside or bool(x.main)) for i in reversed(x.items) if not isinstance(i, str)]
    if not outer:
        return [page[0]], False
    if not any(x.main == "main" for x in outer) and 3 * sum(x.size for x in outer) < page[0].size:
        return [page[0]], False
    if heading is not None and not any(_headed(x) for x in outer):
        first = [heading]
    return first + outer, True


def _headed(box: Box) -> bool:
    todo = [box]
    while todo:
        x = todo.pop()
        if x.tag in ("h1", "h2"):
            return True
        todo += [i for i in x.items if not isinstance(i, str)]
    return False


def _texts(tops: list[Box], low: float, tie: float) -> list[str]:
    """The blocks of text without the branches below ``low``, or below low + tie where only a name hints at boilerplate."""
    out: list[str] = []
    todo: list[Box | str] = list(reversed(tops))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "" or x.tag in _KEPT or x.main or x.worth >= low + (tie if x.weak else 0.0):
            todo += reversed(x.items)
    return out


def main_text(page: str | None, worth: dict[int, tuple[float, float]] | None = None, low: float = 0.3, low_main: float = 0.1) -> str:
    """Blocks of the main text in page order, joined by an empty line; worth: what the site's tree says of this page's branches."""
    if not page:
        return ""
    found = boxes(parse(page))
    if not found:
        return ""
    tops, marked = _tops(found)
    whole = _texts(tops, 0.0, 0.0)
    if worth:
        _weigh(found, worth)
        left = _texts(tops, low_main, 0.2) if marked else _texts(tops, low, 0.3)
        size = sum(map(len, left))
        if size and (not marked or 2 * size >= sum(map(len, whole))):  # a page that is mostly found on others is a copy
            whole = left
    return "\n\n".join(whole)


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def site_tree(pages: DataFrame, scratch: Scratch, min_pages: int) -> tuple[DataFrame, DataFrame]:
    """(host, page, path, content, item) of every node, and (host, path, content, item, a, b): what the tree says where it is not the default.

    pages has host, page (a hash of host and html) and html; copies of a page count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = boxes(parse(text or ""))
                got = list(zip(*features(found), strict=True)) or [(), (), ()]
                n = len(got[0])
                cols = [pa.array([host] * n, pa.string()), pa.array([page] * n, pa.int64()), pa.array([x - 2**63 for x in got[0]], pa.int64()), pa.array(got[1], pa.bool_()), pa.array([x - 2**63 for x in got[2]], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["host", "page", "path", "content", "item"])

    seen = pages.where("host <> ''").select("host", "page", "html").mapInArrow(run, "host string, page bigint, path bigint, content boolean, item bigint")
    seen = scratch.table(seen.distinct(), "nodes")
    n = seen.groupBy("host", "path", "content", "item").agg(F.count("*").alias("n"))
    m = seen.select("host", "path", "page").distinct().groupBy("host", "path").agg(F.count("*").alias("m")).where(F.col("m") >= min_pages)
    contents = n.where("content and n > 1").join(m, ["host", "path"]).select("host", "path", "content", "item", F.lit(0.0).alias("a"), (1 - F.log2("n") / F.log2("m")).alias("b"))
    shapes = n.where("not content").groupBy("host", "path").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"), F.count("*").alias("l")).join(m, ["host", "path"])
    a = F.pow(F.lit(0.9), F.col("l"))
    entropy = F.least(F.lit(1.0), (F.log2("s") - F.col("nlogn") / F.col("s")) / F.log2("m"))
    shapes = shapes.select("host", "path", F.lit(False).alias("content"), F.lit(None).cast("bigint").alias("item"), a.alias("a"), ((1 - a) * entropy).alias("b"))
    return seen, contents.union(shapes)


def importance(pages: DataFrame, scratch: Scratch, min_pages: int) -> DataFrame:
    """(page, worth): for each page an array of (path, content, item, a, b) of its nodes of which the tree has something to say."""
    seen, said = site_tree(pages, scratch, min_pages)
    said = scratch.table(said, "said")
    repeated = said.where("content").select("host", "path", "item", "a", "b")
    shapes = said.where("not content").select("host", "path", "a", "b")
    x = seen.where("content").join(repeated, ["host", "path", "item"])
    y = seen.where("not content").join(shapes, ["host", "path"])
    keep = ("page", "path", "content", "item", "a", "b")
    both = x.select(*keep).union(y.select(*keep))
    both = both.groupBy("page").agg(F.collect_list(F.struct("path", "content", "item", "a", "b")).alias("worth"))  # no more than the page has nodes
    return both.where(F.exists("worth", lambda w: w["content"]))  # presentation alone lowers nothing


def extract(pages: DataFrame, *, url: str = "url", html: str = "html", min_pages: int = 5, least: float = 0.3, least_main: float = 0.1) -> DataFrame:
    """All columns of pages, and text and n_chars (columns with these names are replaced).

    Null or empty html gives an empty text; a null url, or one without a host, belongs to no site, so that only what
    HTML itself says counts. Very long pages are processed whole. Repeated rows give equal results. Empty tables give no rows.
    """
    scratch = Scratch(pages.sparkSession, "html")
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    base = pages.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), _host(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").cast("string").alias("html"))
    base = base.withColumn("page", F.xxhash64("host", "html"))
    worth = scratch.table(importance(base, scratch, min_pages), "importance")
    size = worth.agg(F.sum(F.size("worth") + 1)).first()[0] or 0
    base = base.join(F.broadcast(worth) if size * _ENTRY <= _BROADCAST else worth, "page", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = []
            for h, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                worth = {_key(x["path"] + 2**63, x["content"], (x["item"] or 0) + 2**63): (x["a"], x["b"]) for x in w or ()}
                text.append(main_text(h, worth, least, least_main))
            row = batch.column(0)
            fields = [row.field(i) for i in range(row.type.num_fields)]
            yield pa.RecordBatch.from_arrays([*fields, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*names, "text", "n_chars"])

    schema = T.StructType([*(f for f in pages.schema.fields if f.name in names), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return base.select("row", "html", "worth").mapInArrow(run, schema)
