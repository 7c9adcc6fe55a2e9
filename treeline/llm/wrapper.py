"""Main text of web pages by wrapper induction (operator 8)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.tree_matching import Tree, matched
from treeline.llm.url_rules import url_host
from treeline.operators.skew import bounded, crowded_keys, salted_join
from treeline.session import cut

#: A text stands in a slot when it is on so large a share of the pages that have the slot; a slot is template when so large a share of its blocks stand.
SAME_SHARE = 0.9
#: What stands is on so many different pages of a layout at least, and on so large a share of the layout's pages.
LEAST_PAGES, LEAST_SHARE = 3, 0.05
#: A layout of which more than this share of the blocks and of the text stands consists of near copies of one page; they teach nothing.
COPY_SHARE = 0.5
#: Text of which more than this share stands in links may be a menu.
LINK_SHARE = 0.6

# Names of elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NEVER = {"head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "textarea", "iframe", "svg", "menu", "dialog", "object", "canvas"}
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
#: Elements that lay a page out; the others belong to the text.
FRAME = {"html", "body", "div", "section", "header", "main", "article", "center", "table", "tbody", "tr", "td"}
#: A paragraph or heading is no menu, whatever links it holds.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "dd", "td", "th", "caption", "figcaption"}
# Words in class, id or role that name what is not the article, and words that say nothing beside them.
OTHER_WORD = re.compile(
    r"(?:ad|ads|advert\w*|banners?|sponsor\w*|promos?|promotions?|cookies?|consent|notices?|alerts?|popups?|modals?|newsletters?|subscribe|subscription|menus?|nav|navbar|navigation|breadcrumbs?|header|masthead|"
    r"footer|sidebar|aside|comments?|disqus|replies|related|share|sharing|social|widgets?|pagination|pager|search|login|toolbar|complementary|contentinfo)"
)
PLAIN_WORD = re.compile(
    r"(?:site|page|global|box|block|wrapper|wrap|container|content|section|area|bar|list|item|items|slot|unit|inner|outer|top|bottom|left|right|form|links?|buttons?|icons?|media|user|users|reader|readers|"
    r"thread|posts?|articles?|stories|signup|primary|secondary|mobile|desktop|sticky|fixed|group|panel|row|col|column|js|the|main|\d+)"
)


def named_other(names: str) -> bool:
    """Whether one of the names, taken apart at hyphens and underscores, is made of words for other parts: ``comment-list`` is, ``search-results`` is not."""
    for name in names.split():
        words = [w for w in re.split(r"[-_]+", name) if w]
        other = [bool(OTHER_WORD.fullmatch(w)) for w in words]
        if any(other) and all(o or PLAIN_WORD.fullmatch(w) for o, w in zip(other, words, strict=True)) and words[0] not in ("article", "post"):
            return True
    return False


class Node:
    """An element: its label (tag and first class), its children (nodes and texts), whether its tag or its names say that it is not the article."""

    __slots__ = ("tag", "label", "children", "other", "named", "above")

    def __init__(self, tag: str, label: str, other: bool, named: bool, above: Node | None):
        self.tag, self.label, self.other, self.named, self.above, self.children = tag, label, other, named, above, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", "", False, False, None)
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        given = {k: (v or "").lower() for k, v in attrs if k in ("class", "id", "role", "hidden")}
        first = given.get("class", "").split()[:1]
        in_article = any(n.tag in ("article", "main") for n in self.open)
        other = tag in NEVER or "hidden" in given or (tag == "header" and not in_article)
        named = tag not in ("html", "body", "article", "main") and named_other(" ".join((given.get("class", ""), given.get("id", ""), given.get("role", ""))))
        if tag in BLOCKS:
            self._close(lambda n: n.tag == "p")
        if tag in CLOSED_BY:
            self._close(lambda n: n.tag in CLOSED_BY[tag], stop={"ul", "ol", "dl", "table", "select"})
        node = Node(tag, ".".join([tag, *first]), other, named, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
        if tag == "h1":
            self._heading()

    def _heading(self) -> None:
        """The element that holds the article with the page's heading is not another part, whatever its name."""
        node, article = self.open[-1], False
        while node is not None:
            article = article or node.tag in ("article", "main")
            node.named = node.named and not article
            node = node.above

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def _close(self, which, stop=frozenset()):
        for at in range(len(self.open) - 1, 0, -1):
            if which(self.open[at]):
                del self.open[at:]
                return
            if self.open[at].tag in stop or (not stop and self.open[at].tag in BLOCKS):
                return


def parsed(html: str | None) -> Node:
    """The page as a tree; unclosed paragraphs and list items end where the next begins."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def number(*parts: str) -> int:
    """64 bits of a hash, as a signed number."""
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


#: The label of a run of text in a page's tree.
TEXT = number("#text")


class Page:
    """A page without its other parts: blocks (runs of text between block borders) in page order, and the tree of block elements they are the leaves of.

    ``depth`` and ``label`` give the tree in pre-order; the n-th node labelled ``TEXT`` is the n-th block. ``frame`` holds the label paths of
    the elements that lay the page out, down to ``article`` and ``main``.
    """

    def __init__(self, root: Node):
        self.texts: list[str] = []
        self.paths: list[str] = []
        self.inside: list[bool] = []
        self.menu: list[bool] = []
        self.depth: list[int] = [0]
        self.label: list[str | None] = [""]
        self.frame: set[str] = set()
        self._read(root)

    def _read(self, root: Node) -> None:
        parts: list[tuple[str, int]] = []

        def flush(path: str, depth: int, tag: str, inside: bool, other: bool) -> None:
            text = " ".join("".join(p for p, _ in parts).split())
            if text and not other:
                linked = sum(len(p.strip()) for p, a in parts if a) / max(1, sum(len(p.strip()) for p, _ in parts))
                anchors = len({a for _, a in parts if a})
                self.texts.append(text)
                self.paths.append(path)
                self.inside.append(inside)
                self.menu.append(linked > LINK_SHARE and tag not in PROSE and (tag == "li" or anchors > 1))
                self.depth.append(depth + 1)
                self.label.append(None)
            parts.clear()

        # an explicit stack: pages may be nested deeper than Python calls may; a border is (path, depth, tag, inside, other)
        stack: list[tuple] = [(("", 0, "", False, False), True, 0, iter(root.children))]
        links = 0
        while stack:
            border, apart, link, rest = stack[-1]
            path, depth, _, inside, other = border
            for child in rest:
                if isinstance(child, str):
                    parts.append((child, link))
                elif child.tag == "br":
                    parts.append((" ", link))
                else:
                    gone = child.other or child.named
                    links += child.tag == "a"
                    within = links if child.tag == "a" else link
                    if child.tag in BLOCKS or gone:
                        flush(*border)
                        below = f"{path}/{child.label}"
                        if not (other or gone):
                            self.depth.append(depth + 1)
                            self.label.append(child.label)
                            if child.tag in FRAME and not inside:
                                self.frame.add(below)
                        stack.append(((below, depth + 1, child.tag, inside or child.tag in ("article", "main"), other or gone), True, within, iter(child.children)))
                    else:
                        stack.append((border, False, within, iter(child.children)))
                    break
            else:
                if apart:
                    flush(*border)
                stack.pop()

    def __len__(self) -> int:
        return len(self.texts)


TOLD = (
    "layout bigint, n_nodes bigint, texts array<string>, keys array<bigint>, paths array<bigint>, inside array<boolean>, menu array<boolean>, "
    "depth array<int>, label array<bigint>"
)
KINDS = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32()}


def arrow_type(kind: str) -> pa.DataType:
    return pa.list_(KINDS[kind[6:-1]]) if kind.startswith("array<") else KINDS[kind]


def told(html: str | None) -> dict[str, object]:
    """A page as columns: its blocks with hashes of their texts and label paths, and its tree in pre-order. ``layout`` hashes ``Page.frame``."""
    page = Page(parsed(html))
    hashes = {label: number("label", label) for label in set(page.label) if label is not None}
    of_path = {path: number("path", path) for path in set(page.paths)}
    return {
        "layout": number("frame", *sorted(page.frame)), "n_nodes": len(page.label), "texts": page.texts, "keys": [number("text", t) for t in page.texts],
        "paths": [of_path[p] for p in page.paths], "inside": page.inside, "menu": page.menu, "depth": page.depth,
        "label": [TEXT if label is None else hashes[label] for label in page.label],
    }


def parsed_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, host, _page, ...)`` with the columns of :func:`told`: every page parsed once, in its own task."""
    named = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), F.xxhash64(F.coalesce("html", F.lit(""))).alias("_page"), "html")
    carried = ("page_id", "url", "host", "_page")
    schema = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in carried) + ", " + TOLD
    kinds = dict(x.split() for x in TOLD.split(", "))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [told(html) for html in batch.column("html").to_pylist()]
            columns = {c: batch.column(c) for c in carried} | {c: pa.array([r[c] for r in rows], arrow_type(kind)) for c, kind in kinds.items()}
            yield pa.RecordBatch.from_pydict(columns)

    return named.mapInArrow(tell, schema)


ALIGNED = "_row bigint, host string, layout bigint, _page bigint, slots array<bigint>, keys array<bigint>, chars array<int>"


def slots(depth: list[int], label: list[int], paths: list[int], inside: list[bool], model: Tree) -> list[int]:
    """For each block the node of the model tree that its text is aligned with, or where it has none the hash of its label path.

    In ``article`` and ``main``, elements of one label side by side, like list items and paragraphs, are instances of one slot: the first of them in the model.
    """
    page = Tree(depth, label)
    found = matched(page, model)
    above = page.above()
    leaves, result = (at for at, name in enumerate(label) if name == TEXT), []
    for at, path, within in zip(leaves, paths, inside, strict=True):
        partner = found[at]
        if within:
            element = above[at]
            beside = model.children[found[above[element]]] if found[above[element]] >= 0 else []
            partner = next((c for c in beside if model.label[c] == label[element]), -1)
        result.append(path if partner < 0 else partner)
    return result


def aligned(parsed: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """Every page of ``parsed`` with its blocks' slots, by simple tree matching with the smallest page of its host and layout."""
    smallest = F.min_by(F.struct("depth", "label"), F.struct("n_nodes", "_page", "_row"))
    models = parsed.groupBy("host", "layout").agg(smallest.alias("_m")).select("host", "layout", F.col("_m.depth").alias("m_depth"), F.col("_m.label").alias("m_label"))
    narrow = parsed.select("_row", "host", "layout", "_page", "keys", "paths", "inside", "depth", "label", F.transform("texts", lambda t: F.length(t)).alias("chars"))
    beside = salted_join(narrow, models, ["host", "layout"], "inner", F.col("_row"), crowded)
    kept = ("_row", "host", "layout", "_page", "keys", "chars")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, model = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("host", "layout", "depth", "label", "paths", "inside", "m_depth", "m_label")]
            found = []
            for host, layout, depth, label, paths, inside, m_depth, m_label in zip(*columns, strict=True):
                if of != (host, layout):
                    of, model = (host, layout), Tree(m_depth, m_label)
                found.append(slots(depth, label, paths, inside, model))
            yield pa.RecordBatch.from_pydict({"slots": pa.array(found, pa.list_(pa.int64())), **{c: batch.column(c) for c in kept}}).select([x.split()[0] for x in ALIGNED.split(", ")])

    return beside.mapInArrow(align, ALIGNED)


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, layout, template)`` from all pages of :func:`aligned` (written): the slots and texts that stand.

    Counts by host, layout, slot and text are combined map-side. Equal pages of a host count once.
    """
    group, slot = ["host", "layout"], ["host", "layout", "slot"]
    rows = pages.select("_row", "host", "_page")
    groups = rows.groupBy("host", "_page").agg(F.min("_row").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    copies = rows.join(groups, ["host", "_page"]).where("_row <> _first").select("_row")
    different = pages.join(copies, "_row", "left_anti")
    told_slots = F.arrays_zip(F.col("slots").alias("slot"), F.col("keys").alias("key"), F.col("chars").alias("chars"))
    each = different.select("_row", *group, F.size("slots").alias("_n"), F.posexplode(told_slots).alias("_at", "b"), "slots", "keys")
    # what a slot or text of a page counts for is counted at its first block
    new_slot = F.array_position("slots", F.col("b.slot")) == F.col("_at") + 1
    again = F.exists(F.slice(F.arrays_zip("slots", "keys"), F.lit(1), F.col("_at")), lambda o: (o["slots"] == F.col("b.slot")) & (o["keys"] == F.col("b.key")))
    flat = each.select(*group, "b.slot", "b.key", "b.chars", new_slot.cast("int").alias("_slot"), (~again).cast("int").alias("_text"))
    counts = cut(
        flat.groupBy(*slot, "key").agg(
            F.sum("_text").alias("pages"), F.sum("_slot").alias("on_slot"), F.count("*").alias("n"), F.sum("chars").alias("chars")
        )
    )
    sizes = different.groupBy(*group).agg(F.count("*").alias("n_pages"))
    of_slot = counts.groupBy(*slot).agg(F.sum("on_slot").alias("on_slot"), F.sum("n").alias("every"))
    often = counts.where(F.col("pages") >= LEAST_PAGES).drop("on_slot")
    stand = often.join(of_slot, slot).join(sizes, group).where((F.col("pages") >= F.col("n_pages") * LEAST_SHARE) & (F.col("pages") >= F.col("on_slot") * SAME_SHARE))
    held = stand.groupBy(*slot).agg(F.collect_list("key").alias("keys"), F.sum("n").alias("n"), F.first("every").alias("every"), F.sum("chars").alias("chars")).where(F.col("n") >= F.col("every") * SAME_SHARE)
    pairs = F.transform("keys", lambda k: F.struct(F.col("slot").alias("slots"), k.alias("keys")))
    found = held.groupBy(*group).agg(F.flatten(F.collect_list(pairs)).alias("template"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    whole = counts.groupBy(*group).agg(F.sum("n").alias("_n"), F.sum("chars").alias("_chars"))
    varies = (F.col("n") <= F.col("_n") * COPY_SHARE) | (F.col("chars") <= F.col("_chars") * COPY_SHARE)
    return found.join(whole, group).where(varies).select(*group, "template")


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``.

    Every page is read whole and parsed once. Pages of one host whose layout elements are the same are one layout; the tree of each is
    aligned with that of the layout's smallest page, and counts over all pages tell which slots stay constant (template) and which
    vary (content). A block is dropped as template only where its own text is a standing one of its slot. Names and tags drop navigation, forms and the like
    before that. Where a page has ``article`` or ``main`` elements with text, only what stands in them counts; elsewhere lists and
    runs of links are menus. Pages without a host share the wrappers of the empty host. Null and empty html give an empty text;
    repeated rows stay rows of their own and count once; of standing texts that tie all are template; an empty table gives no rows.
    Other columns are ignored.
    """
    parsed = cut(parsed_pages(pages).withColumn("_row", F.monotonically_increasing_id()))
    crowded = bounded(crowded_keys(parsed, ["host", "layout"]))
    slotted = cut(aligned(parsed, crowded))
    found = cut(wrappers(slotted))
    joined = salted_join(slotted.select("_row", "host", "layout", "slots", "keys"), found, ["host", "layout"], "inner", F.col("_row"), crowded)
    stays = F.transform(F.arrays_zip("slots", "keys"), lambda b: ~F.array_contains("template", b))
    marked = cut(joined.select("_row", stays.alias("stays")).where(F.exists("stays", lambda s: ~s)))
    blocks = F.arrays_zip("texts", "inside", "menu", "stays")
    both = parsed.select("_row", "page_id", "url", "texts", "inside", "menu").join(marked, "_row", "left")
    kept = F.when(F.col("stays").isNull(), F.arrays_zip("texts", "inside", "menu")).otherwise(
        F.transform(F.filter(blocks, lambda b: b["stays"]), lambda b: F.struct(b["texts"].alias("texts"), b["inside"].alias("inside"), b["menu"].alias("menu")))
    )
    both = both.select("page_id", "url", kept.alias("kept"))
    chosen = F.when(F.exists("kept", lambda b: b["inside"]), F.filter("kept", lambda b: b["inside"])).otherwise(F.filter("kept", lambda b: ~b["menu"]))
    text = F.array_join(F.transform(chosen, lambda b: b["texts"]), "\n")
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
