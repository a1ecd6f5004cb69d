"""Main text of pages by a site style tree: pages of one host are merged, and branches that say the same on every page go.

Each page is read once into blocks in page order.  A block belongs to a presentation node, the path of tags, classes and ids
that leads to it.  The pages of a host share their nodes, so the site style tree is the table of (host, path): for each node
the texts that its blocks hold (content) and the sequences of children that its element has (presentation).  What is counted
are distinct pages: pages of a host with the same blocks are one page, and a page counts each value of a node once.  The
importance of a node is 1 less the mean of ``log n / log m`` over its values, where ``m`` distinct pages have the node and
``n`` of them share the value: 1 when every page differs, 0 when all agree.  A block's composite importance is
``(1 - GAMMA) * presentation of its parent + GAMMA * content of its node``; in nodes under ``LEAST`` the texts that at least
``SEEN`` distinct pages share are noise and are removed from every page.

What a single page shows by itself is decided while it is read: elements that never hold an article (menus, page headers,
footers, sidebars, forms, scripts, styles, by tag or role) and reader comments (containers with a class or id of ``COMMENTS``)
are left out, and a page that marks its article keeps that branch alone.  No other name cuts a branch: sidebars, adverts or
notices that are marked by class or id only are left to the site tree.  Paragraphs and headings directly inside a marked
article, under elements without a class, are never removed as noise, however often they repeat.

Texts stay where they were read: only hashes are counted, pre-aggregated per task, and the noise cells (hashes of node and
text) come back as a table that the planner broadcasts only when it is small.

Defined results: null or empty html gives an empty text; a null url is a host of its own; repeated pages are extracted each
for itself; malformed markup (unclosed tags, stray ends, cut references) is read as it comes; empty table, no rows; other
columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import stage

GAMMA = 0.9
LEAST = 0.2
SEEN = 5
JOINT = "\n\n"

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|iframe|noscript|xmp)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.I | re.S,
)
ATTR = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html li td th tr tbody thead tfoot caption option optgroup".split())
#: an element that starts ends these open ones, inside the nearest of the borders
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
LEFT_OUT = frozenset(
    "head nav footer aside form script style noscript iframe button select textarea template svg dialog menu object canvas video audio "
    "title".split()
)
#: whole names, as class or id of a container
COMMENTS = frozenset(
    "comment comments comments-area comments-section comment-section comment-list commentlist comment-respond respond replies disqus "
    "disqus_thread".split()
)
CONTAINERS = frozenset("article details div dl li ol section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tr td th figure figcaption header section".split())

PARSED = (
    "page_id long, url string, page long, texts array<string>, cells array<long>, "
    "stats array<struct<node:long,parent:long,value:long,first:boolean>>"
)
_STAT = pa.struct([("node", pa.int64()), ("parent", pa.int64()), ("value", pa.int64()), ("first", pa.bool_())])
_PARSED = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("page", pa.int64()), ("texts", pa.list_(pa.string())), ("cells", pa.list_(pa.int64())),
    ("stats", pa.list_(_STAT)),
])
#: cell number of blocks that are never noise
SAFE = 0


def _number(text: str) -> int:
    n = xxhash.xxh64_intdigest(text)
    return (n - (1 << 64) if n >> 63 else n) or 1


class _Open:
    """An open element."""

    __slots__ = ("name", "node", "out", "root", "plain", "children")

    def __init__(self, name: str, node: int, out: bool, root: bool, plain: bool):
        self.name, self.node, self.out, self.root, self.plain, self.children = name, node, out, root, plain, []


def host_of(url: str | None) -> str:
    found = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)", url or "", re.I)
    return found[1].lower() if found else ""


def read(page: str, host: str, paths: dict) -> tuple[int, list[str], list[int], list[dict]]:
    """Hash of host and candidate blocks, texts and cells of these blocks, and everything that the site tree counts, once each.

    ``first`` marks one value of each node, so that its sum over pages is the number of pages that have the node.
    """
    stack = [_Open("", _number(host), False, False, False)]
    blocks: list[tuple[str, int, int, bool, bool, bool]] = []
    stats: list[tuple[int, int, int]] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            top = next((e for e in reversed(stack) if e.name in BLOCK or not e.name))
            parent = stack[max(0, stack.index(top) - 1)]
            blocks.append((text, top.node, parent.node, top.out, top.root, top.plain))

    def pop() -> None:
        gone = stack.pop()
        if gone.name in BLOCK:
            if gone.children:
                # the sequence of children is the value of the element's presentation node
                stats.append((~gone.node, 0, _number(" ".join(gone.children))))

    def close(name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name == name:
                while len(stack) > k:
                    pop()
                return

    for t in TOKEN.finditer(page):
        text = t["text"]
        if text is not None:
            parts.append(references.unescape(text) if "&" in text else text)
            continue
        name = t["name"] or t["name2"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        block = name in BLOCK
        if block:
            flush()
        if t["end"] or t["end2"]:
            close(name)
            continue
        if name in CLOSES_P and any(e.name == "p" for e in stack):
            for e in reversed(stack):
                if e.name == "p":
                    close("p")
                    break
                if e.name in BLOCK:
                    break
        if name in IMPLIED:
            ends, borders = IMPLIED[name]
            for e in reversed(stack):
                if e.name in ends:
                    close(e.name)
                    break
                if e.name in borders:
                    break
        attrs = t["attrs"] or t["attrs2"] or ""
        marks, classed, role, body = "", False, "", False
        if attrs:
            for a in ATTR.finditer(attrs):
                value = a[2] or a[3] or a[4] or ""
                key = a[1].lower()
                if key == "role":
                    role = value.lower()
                elif key == "itemprop":
                    body = body or value == "articleBody"
                elif key != "hidden":
                    marks += " " + value
                    classed = classed or key == "class"
        up = stack[-1]
        up.children.append(name if not marks else name + marks)
        key = (up.node, name, marks)
        node = paths.get(key)
        if node is None:
            node = paths[key] = _number(f"{up.node}>{name}{marks}")
        root = up.root or name in ("article", "main") or role == "main" or body
        noisy = name in LEFT_OUT or role in ROLES or (name == "header" and not up.root)
        noisy = noisy or bool(marks and name in CONTAINERS and not COMMENTS.isdisjoint(marks.lower().split()))
        starts = root and not up.root
        stack.append(_Open(name, node, up.out or noisy, root, starts or (up.plain and name in PLAIN and not classed) or (up.plain and not block)))
    flush()
    while len(stack) > 1:
        pop()
    cells = [_number(f"{node}:{text}") for text, node, *_ in blocks]
    stats += [(node, ~parent, cell) for (_, node, parent, *_), cell in zip(blocks, cells)]
    inside = [(b, cell) for b, cell in zip(blocks, cells) if not b[3]]
    rooted = [(b, cell) for b, cell in inside if b[4]]
    chosen = rooted or inside
    counted, known = [], set()
    for node, parent, value in dict.fromkeys(stats):
        counted.append({"node": node, "parent": parent, "value": value, "first": node not in known})
        known.add(node)
    content = _number(f"{host} {' '.join(str(cell) for _, cell in chosen)}")
    return content, [b[0] for b, _ in chosen], [SAFE if b[4] and b[5] else cell for b, cell in chosen], counted


def parse(pages: DataFrame) -> DataFrame:
    """One row per page: candidate texts with their cells, and what the site tree counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: dict = {}
        for batch in batches:
            rows, held = [], 0
            for page_id, url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                page = page.as_py() or ""
                rows.append((page_id, url, *read(page, host_of(url), paths)))
                held += len(page)
                if len(paths) > 100_000:
                    paths.clear()
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PARSED.types)], schema=_PARSED)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PARSED.types)], schema=_PARSED)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, PARSED)


def shared_values(parsed: DataFrame) -> DataFrame:
    """For every node of the site trees a row per value that ``SEEN`` distinct pages share, and one (value null) for all others."""
    distinct = parsed.groupBy("page").agg(F.min("_row").alias("_row"))
    counted = parsed.select("_row", "stats").join(distinct, "_row", "left_semi").select(F.explode("stats").alias("s")).select("s.*")
    values = counted.groupBy("node", "parent", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("first").cast("long")).alias("pages"))
    shared = F.when(F.col("n") >= SEEN, F.col("value"))
    return values.groupBy("node", "parent", shared.alias("value")).agg(
        F.sum("n").alias("seen"), F.sum("pages").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("_nlogn")
    )


def importance(values: DataFrame) -> DataFrame:
    """node, parent, distinct pages and importance of every node of the site trees, in [0, 1]."""
    sums = values.groupBy("node", "parent").agg(F.sum("seen").alias("_seen"), F.sum("pages").alias("pages"), F.sum("_nlogn").alias("_nlogn"))
    spread = F.when(F.col("pages") > 1, 1 - F.col("_nlogn") / F.col("_seen") / F.log("pages")).otherwise(1.0)
    return sums.select("node", "parent", "pages", spread.alias("importance"))


def noise_cells(parsed: DataFrame) -> DataFrame:
    """Shared texts of nodes whose composite importance is too low."""
    values = stage(shared_values(parsed), "site-values")
    nodes = stage(importance(values), "site-nodes")
    shape = nodes.filter("parent = 0").select(F.col("node").alias("parent"), F.col("importance").alias("_shape"))
    content = nodes.filter("parent <> 0").join(shape, "parent", "left")
    score = (1 - GAMMA) * F.coalesce("_shape", F.lit(1.0)) + GAMMA * F.col("importance")
    low = content.filter((F.col("pages") >= SEEN) & (score < LEAST)).select("node").distinct()
    return values.filter("parent <> 0 and value is not null").join(low, "node", "left_semi").select(F.col("value").alias("cell")).distinct()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    parsed = stage(parse(pages).withColumn("_row", F.monotonically_increasing_id()), "site-pages")
    noise = stage(noise_cells(parsed), "site-noise")
    cells = parsed.select("_row", F.explode(F.array_distinct("cells")).alias("cell")).filter(F.col("cell") != SAFE)
    removed = stage(cells.join(noise, "cell").groupBy("_row").agg(F.collect_set("cell").alias("_noise")), "site-removed")
    rows = parsed.select("_row", "page_id", "url", "texts", "cells").join(removed, "_row", "left")
    kept = F.filter("texts", lambda t, k: F.coalesce(~F.array_contains("_noise", F.get("cells", k)), F.lit(True)))
    text = F.array_join(F.when(F.col("_noise").isNull(), F.col("texts")).otherwise(kept), JOINT)
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def digest(pages: DataFrame) -> DataFrame:
    """The columns of op4."""
    return extract(pages)
