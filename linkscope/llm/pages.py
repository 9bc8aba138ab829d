"""Main text of HTML pages by wrapper induction.

Pages of one host come from one template. For each host one page is the pattern;
every page of the host is aligned with it by simple tree matching (the largest
order-preserving match of nodes of one tag, equal class names counting double). Counted
over all aligned pages, a pattern node whose text is the same again and again belongs
to the template, and one whose text varies is a slot. The deepest container that holds
most varying text, links aside, is the wrapper's region; small containers at its edges,
outside its headings and paragraphs, are furniture even if their text varies, as that
of adverts does. Extraction aligns each page once more and reads the node that lies on
the region, without template and furniture.

So the alignment decides, whatever elements and classes are called. What elements and
class names say is used for what no alignment can tell: scripts, forms, menus and
readers' comments are left out by their names where they have them, and count as no
article when a region is sought. Hosts with one page and pages that don't fit their
host's pattern go by elements alone (article, main, body).

Statistics cover all pages of a host and are added up before they are shuffled, so a
host may have any share of the pages. A wrapper is a skeleton of tags and text
hashes, a few kB.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.llm.common import arrow_schema, cut, text_batches

#: Elements of HTML by what is done with them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav header footer aside form script style noscript template iframe svg math canvas object button select textarea dialog menu title head input label audio video".split())
#: Parts of a class, id or role that name what isn't the article.
DROPPED_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay popup promo promoted recommended related reply replies respond search share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets alert".split()
)
CONTAINERS = frozenset("article main section div body td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening one closes, up to the element that bounds it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.DOTALL)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
#: Shares that decide: of aligned pages with the same text (template), of varying text in
#: the region, and at most of its text in a container at its edge (furniture).
SAME, REGION, EDGE = 0.7, 0.6, 0.2
#: Elements nested deeper add their text to the one at this depth.
MAX_DEPTH = 200
#: A page larger than this isn't taken as its host's pattern if there is a smaller one.
PATTERN_BYTES = 32_768


class Node:
    __slots__ = ("tag", "name", "items", "dropped", "hash", "linked")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag = tag
        self.items: list = []  # strings and nodes in page order
        self.hash = None
        self.linked = 0  # characters of items inside links
        self.name = ""
        self.dropped = tag in DROPPED
        if attrs:
            found = NAMES.findall(attrs)
            self.name = next((a or b or c for k, a, b, c in found if k.lower() == "class"), "")
            if not self.dropped:
                self.dropped = any(not DROPPED_NAMES.isdisjoint(re.split(r"[\s_-]+", (a or b or c).lower())) for _, a, b, c in found) or bool(HIDDEN.search(attrs))

    def children(self) -> list[Node]:
        return [x for x in self.items if x.__class__ is Node]


def parse_html(text: str | None) -> Node:
    """A tree of the block elements; inline markup only adds its text to them.
    Unclosed elements end where HTML lets them end, stray end tags are passed over."""
    root = Node("#root")
    stack = [root]
    at, text = 0, text or ""
    link = False
    for m in iter(TOKEN.scanner(text).search, None):
        start = m.start()
        if start < at:
            continue  # inside the raw text of a script or the like
        if start > at:
            stack[-1].items.append(text[at:start])
            if link:
                stack[-1].linked += start - at
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].items.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = tag.lower()
        if tag == "a":
            link = not m[1]
        if m[1]:
            if tag in BLOCKS or tag in DROPPED:
                link = False
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag == "br" or tag == "hr":
            stack[-1].items.append(" " if tag == "br" else Node("hr"))
        if tag in VOID or not (tag in BLOCKS or tag in DROPPED):
            continue
        if tag in BLOCKS and stack[-1].tag == "p":
            stack.pop()
        if tag in CLOSES:
            ends, bound = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bound:
                    break
                if stack[k].tag in ends:
                    del stack[k:]
                    break
        node = Node(tag, m[3])
        stack[-1].items.append(node)
        if len(stack) < MAX_DEPTH and (not m[3].endswith("/") or tag in BLOCKS):
            stack.append(node)
    if at < len(text):
        stack[-1].items.append(text[at:])
    return root


def blocks(node: Node, without: frozenset = frozenset()) -> list[str]:
    """Texts of the blocks under node in page order: references decoded, white space
    squeezed, what isn't article left out, and the nodes (by id) in without."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if said := " ".join(html.unescape("".join(line)).split()):
                out.append(said)
            line.clear()

    todo: list = [iter(node.items)]
    while todo:
        for x in todo[-1]:
            if x.__class__ is str:
                line.append(x)
            elif x.tag in BLOCKS:
                flush()
                if not x.dropped and id(x) not in without:
                    todo.append(iter(x.items))
                    break
            # other nodes are controls and the like, which are left out
        else:
            todo.pop()
            flush()
    return out


def text_of(node: Node) -> str:
    """All text directly in node, without its child blocks'."""
    return " ".join("".join(x for x in node.items if x.__class__ is str).split())


def own_hash(node: Node) -> int:
    if node.hash is None:
        node.hash = xxhash.xxh3_64_intdigest(text_of(node).encode("utf-8", "replace")) >> 1
    return node.hash


def own_mass(node: Node) -> int:
    """Characters directly in node that may be article: not in links, nor in what its
    names say is something else."""
    return 0 if node.dropped else max(0, sum(len(x) for x in node.items if x.__class__ is str) - node.linked)


def mass(node: Node, seen: dict[int, int]) -> int:
    """Characters under node that may be article; noted for all nodes below."""
    if node.dropped:
        seen[id(node)] = 0
        return 0
    n = own_mass(node) + sum(mass(x, seen) for x in node.items if x.__class__ is Node)
    seen[id(node)] = n
    return n


class Pattern:
    """A host's pattern page: tags, class names and text hashes."""

    def __init__(self, tree: list):
        self.nodes: list[tuple] = []  # (tag, name, hash, children)

        def add(x: list) -> int:
            at = len(self.nodes)
            self.nodes.append(())
            self.nodes[at] = (x[0], x[1], x[2], [add(c) for c in x[3]])
            return at

        add(tree)

    @staticmethod
    def tree_of(node: Node) -> list:
        return [node.tag, node.name, own_hash(node), [Pattern.tree_of(c) for c in node.children()]]

    def align(self, page: Node) -> dict[int, Node]:
        """Simple tree matching: pattern node -> page node."""
        kept: dict[tuple[int, int], tuple[int, list]] = {}
        nodes = self.nodes

        def match(i: int, page_node: Node) -> int:
            tag, name, _, below = nodes[i]
            if tag != page_node.tag:
                return 0
            own = 2 if name == page_node.name else 1
            theirs = page_node.children()
            if not below or not theirs:
                return own
            score = [[0] * (len(theirs) + 1)]
            for a in below:
                last, row = score[-1], [0]
                for k, b in enumerate(theirs):
                    w = match(a, b) if nodes[a][0] == b.tag else 0
                    best = last[k] + w
                    row.append(max(best, last[k + 1], row[k]))
                score.append(row)
            kept[i, id(page_node)] = (score[-1][-1] + own, score)
            return score[-1][-1] + own

        found: dict[int, Node] = {}

        def walk(i: int, page_node: Node) -> None:
            found[i] = page_node
            got = kept.get((i, id(page_node)))
            if not got:
                return
            below, theirs, score = nodes[i][3], page_node.children(), got[1]
            a, b = len(below), len(theirs)
            while a and b:
                if score[a][b] == score[a - 1][b]:
                    a -= 1
                elif score[a][b] == score[a][b - 1]:
                    b -= 1
                else:
                    walk(below[a - 1], theirs[b - 1])
                    a, b = a - 1, b - 1

        if match(0, page):
            walk(0, page)
        return found


def host_of(url: Column) -> Column:
    """Host of an address in lower case; empty for null or no address."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


_patterns: dict[str, Pattern] = {}


def _pattern(text: str) -> Pattern:
    if text not in _patterns:
        if len(_patterns) > 2000:
            _patterns.clear()
        _patterns[text] = Pattern(json.loads(text))
    return _patterns[text]


def host_patterns(pages: DataFrame) -> DataFrame:
    """(host, pattern): for each host the skeleton of one page, the first by a hash
    among those of moderate size (else the shortest)."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    order = F.struct(F.when(size <= PATTERN_BYTES, 0).otherwise(size), F.xxhash64("html"))
    picked = pages.groupBy("host").agg(F.min(order).alias("first"))
    # the page itself is fetched by its hash, so that no page's text is aggregated
    rows = pages.select("host", "html", order.alias("first")).join(picked.hint("broadcast") if picked.count() <= FEW_HOSTS else picked.hint("merge"), ["host", "first"]).dropDuplicates(["host"])
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("pattern", T.StringType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [json.dumps(Pattern.tree_of(parse_html(h))) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], schema=arrow)

    return text_batches(rows.select("host", "html")).mapInArrow(run, schema)


#: Hosts and bytes of wrappers up to which they are broadcast; beyond, they are joined by
#: shuffling the pages, and Spark splits the hosts with many.
FEW_HOSTS, FEW_BYTES = 2000, 32_000_000


def with_hosts(pages: DataFrame, of_hosts: DataFrame) -> DataFrame:
    n, size = of_hosts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()
    side = of_hosts.hint("broadcast") if n <= FEW_HOSTS and size <= FEW_BYTES else of_hosts.hint("merge")
    return pages.join(side, "host", "left")


#: What is counted of each pattern node over all pages of its host: pages with a node on
#: it, those with the same own text, characters of possible article under it, and those
#: directly in it.
COUNTED = ("pages", "same", "chars", "own")


def alignment_counts(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """(host, node, and what COUNTED says)."""
    schema = T.StructType([T.StructField("host", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("node", *COUNTED)]])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple, list[int]] = defaultdict(lambda: [0] * len(COUNTED))
            for host, text, pattern in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, pat = parse_html(text), _pattern(pattern)
                size: dict[int, int] = {}
                mass(page, size)
                for i, node in pat.align(page).items():
                    t = total[host, i]
                    t[0] += 1
                    t[1] += own_hash(node) == pat.nodes[i][2]
                    t[2] += size.get(id(node), 0)
                    t[3] += own_mass(node) if size.get(id(node)) else 0
            columns = list(zip(*[(h, i, *t) for (h, i), t in total.items()], strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    each = text_batches(with_hosts(pages.select("host", "html"), patterns).select("host", "html", "pattern")).mapInArrow(run, schema)
    return each.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in COUNTED])


def choose_region(pattern: Pattern, seen: dict[int, tuple[int, ...]]) -> tuple[int, list[int], list[int]]:
    """The region (0: there is none, as with a single page), the template's nodes and the
    furniture at the region's edges: small containers before the first or after the last
    line whose text is in links or mostly stands bare, as menus, notices and credits have it. One with
    paragraphs of its own (a lead, a closing section) stays. seen: what COUNTED says, by node."""
    nothing = (0,) * len(COUNTED)
    nodes, n = pattern.nodes, seen.get(0, nothing)[0]
    if n < 2:
        return 0, [], []
    constant = {i for i, (pages, same, *_) in seen.items() if n > 2 and same >= SAME * pages and 2 * pages >= n}
    varying: dict[int, int] = {}
    for i in range(len(nodes) - 1, -1, -1):  # children have higher numbers
        _, _, chars, _ = seen.get(i, nothing)
        same_below = sum(seen.get(c, nothing)[2] - varying[c] for c in nodes[i][3])
        varying[i] = max(0, chars - same_below - (seen[i][3] if i in constant else 0))
    # a heading that repeats stays where what follows it, up to the next one, varies
    for i in range(len(nodes)):
        headed = None
        for c in nodes[i][3]:
            if nodes[c][0] in HEADINGS:
                headed = c
            elif headed is not None and varying[c]:
                constant.discard(headed)
    if 2 * varying[0] < seen.get(0, nothing)[2]:  # hardly anything varies: copies of a page tell nothing
        constant = set()
        varying = {i: seen.get(i, nothing)[2] for i in range(len(nodes))}
    at, region = 0, 0
    while nodes[at][3]:
        best = max(nodes[at][3], key=lambda c: varying[c])
        # a heading that varies belongs to the text beside it
        headed = any(nodes[c][0] in HEADINGS and varying[c] for c in nodes[at][3])
        if headed or varying[best] < max(1, REGION * varying[at]):
            break
        at = best
        if nodes[at][0] in CONTAINERS:
            region = at
    # text in paragraphs, headings and the like, not bare in a container
    lined: dict[int, int] = {}
    for i in range(len(nodes) - 1, -1, -1):
        lined[i] = sum(lined[c] for c in nodes[i][3]) if nodes[i][0] in CONTAINERS else seen.get(i, nothing)[2]
    below = nodes[region][3]
    lines = [k for k, c in enumerate(below) if nodes[c][0] not in CONTAINERS and varying[c]]
    edge = [c for k, c in enumerate(below) if nodes[c][0] in CONTAINERS and lines and not lines[0] < k < lines[-1] and varying[c] <= EDGE * varying[region] and 2 * lined[c] < max(1, seen.get(c, nothing)[2])]
    return region, sorted(constant), edge


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """(host, pattern, region, template, edge) from pages(host, html)."""
    patterns = cut(host_patterns(pages))
    counted = cut(alignment_counts(pages, patterns))
    stats = counted.groupBy("host").agg(F.collect_list(F.struct("node", *COUNTED)).alias("stats"))  # a pattern's nodes
    joined = patterns.join(stats.hint("merge"), "host")
    lists = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("pattern", T.StringType()), T.StructField("region", T.IntegerType()), T.StructField("template", lists), T.StructField("edge", lists)])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [choose_region(_pattern(p), {s["node"]: tuple(s[c] for c in COUNTED) for s in stats}) for p, stats in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            got = [pa.array([f[k] for f in found], arrow.field(2 + k).type) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *got], schema=arrow)

    return cut(joined.mapInArrow(run, schema))


def own_regions(page: Node) -> list[Node]:
    """Where a page that doesn't fit its host's wrapper has its article: its article
    elements, else its main element, else all of it."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [page]
    while todo:
        x = todo.pop()
        if x.dropped:
            continue
        if x.tag in found:
            found[x.tag].append(x)
            if x.tag == "article":
                continue
        todo += reversed(x.children())
    return found["article"] or found["main"][:1] or [page]


def extract(text: str | None, pattern: str | None, region: int | None, template: list[int] | None, edge: list[int] | None) -> str:
    """Main text of one page under its host's wrapper. A template node is left out where
    the page has the template's text on it, a node of the edge in any case."""
    page = parse_html(text)
    if pattern is not None and region:
        wrapper = _pattern(pattern)
        on = wrapper.align(page)
        if region in on:
            same = {id(on[i]) for i in template or () if i in on and i != region and own_hash(on[i]) == wrapper.nodes[i][2] and text_of(on[i])}
            return "\n\n".join(blocks(on[region], frozenset(same | {id(on[i]) for i in edge or () if i in on})))
    return "\n\n".join(b for r in own_regions(page) for b in blocks(r))


def extract_main_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, text, n_chars) for every row of pages(key, url, html).

    Null or empty html gives an empty text; a null url belongs to the host without a
    name; a host's only page goes by its elements; repeated rows give repeated rows;
    further columns are left out.
    """
    named = pages.select(key, "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = induce_wrappers(named.select("host", "html"))
    rows = with_hosts(named, wrappers).select(key, "url", "html", "pattern", "region", "template", "edge")
    schema = T.StructType([named.schema[key], named.schema["url"], T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [extract(*row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], schema=arrow)

    return text_batches(rows).mapInArrow(run, schema)
