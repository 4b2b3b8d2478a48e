"""Main text of web pages by wrapper induction over the pages of a host.

1. A page becomes a tree of its containers with leaves of text (`page_tree`), and its shape:
   that tree without the texts. Paragraphs, lists, tables and headings that follow each
   other in one container are one leaf; LEAST_RUN or more equal siblings of one leaf are one
   node. What the markup itself names as no article (navigation, forms, adverts, notices,
   comments and so on, by element, role, class or id) is marked.
2. The shapes of a host, each once with its number of pages, are merged into the host's
   wrapper: two trees are aligned by simple tree matching (`align`), aligned nodes add
   their page counts, others are put in between. Merging goes in rounds of at most FAN shapes
   a group, so a host with very many shapes is no large task. Nodes that fewer than RARE of
   a group's pages have are left out, which bounds a wrapper; their text stays a slot.
3. Each shape is aligned with its wrapper, and the texts at each wrapper node are counted
   over the host's distinct pages. A node where ALIKE of at least LEAST_PAGES pages read the
   same is template; the others are slots.
4. A page's text is that of its unmarked leaves inside its articles, else inside its main
   elements, else inside the host's main slot: the deepest wrapper node with MAIN_SHARE of
   the slots' characters, without leaves that are mostly links. Template leaves go unless
   that would leave less than half of the characters: pages of one article under several
   addresses keep it. Where nothing is left, all unmarked text is the page's.

Pages are parsed once; their texts wait in a table for the decision on their shape. Only
shapes, counts and hashes are shuffled.

Null or empty html, and pages without text, give the empty text. A null url or one without
a host counts as one host of its own. Repeated rows get a row each; exact copies of a page are
counted once in step 3. Very long pages are parsed in linear time and kept whole; containers
nested deeper than DEPTH belong to the one at that depth. Unclosed elements end with
their parents, text after an unclosed `<` of a tag is no text. Other columns are ignored.
White space of any kind counts as such. No pages give no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgate.llm.common import each_group
from siftgate.plans.joins import lookup_join
from siftgate.plans.scratch import forget, written

LEAST_RUN = 6
DEPTH = 100
FAN = 64
RARE = 0.02
ALIKE = 0.9
LEAST_PAGES = 3
MAIN_SHARE = 0.9
LINKS = 0.6

RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
NO_CONTENT = frozenset("area base col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("address article aside body center dialog div footer form header main nav section".split())
FLOW = frozenset(
    "blockquote caption dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li menu ol option p pre summary table "
    "tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("aside button dialog fieldset footer form head label legend nav noscript object select svg template".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words in a class or id by which pages name what is no article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended "
    "related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
PARSED = T.StructType([T.StructField("shape", T.StringType()), T.StructField("texts", T.ArrayType(T.StringType()))])
LEAF = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("leaf", T.BooleanType()), T.StructField("kind", T.StringType())])
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>]|$)", re.IGNORECASE) for tag in RAW}


class Node:
    __slots__ = ("label", "marked", "named", "items")

    def __init__(self, label: str, marked: bool, named: bool):
        self.label, self.marked, self.named = label, marked, named
        self.items: list[Node | list] = []  # a list is a leaf: [text, characters in links]


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)} if text.strip(" /\n") else {}


def _opened(tag: str, given: dict[str, str]) -> Node | None:
    """The node of an element, None for one that is no container and not marked."""
    role = given.get("role", "").lower()
    name = f"{given.get('class', '')} {given.get('id', '')}"
    named = tag not in ("html", "body") and any(w.lower() in NAMES for w in _WORD.findall(name))
    if tag in ("main", "article") or role in ("main", "article") or given.get("itemprop") == "articleBody":
        tag = "main" if "main" in (tag, role) else "article"
        named = named and not {w.lower() for w in _WORD.findall(name)}.isdisjoint({"comment", "comments", "ad", "advert", "sponsored", "promoted"})
    hidden = "hidden" in given or "display:none" in given.get("style", "").replace(" ", "").lower()
    marked = tag in NEVER or role in ROLES or hidden
    if tag not in CONTAINERS and not (marked or named):
        return None
    first = re.sub(r"\d+", "#", (given.get("class", "").split() or [given.get("id", "")])[0])
    return Node(f"{tag}.{first}" if first else tag, marked, named)


def page_tree(html: str) -> Node:
    """The tree of a page's containers. Named nodes that turn out to hold an article are unnamed."""
    root = Node("page", False, False)
    stack: list[tuple[str, Node]] = [("", root)]
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = at = 0
    quoted = True

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                items = stack[-1][1].items
                if items and isinstance(items[-1], list):
                    items[-1][0].append(text)
                    items[-1][1] += linked
                else:
                    items.append([[text], linked])
            parts.clear()
        linked = 0

    def pop() -> None:
        end_block()
        open_[stack.pop()[0]] -= 1

    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            start = len(html)
        if start > at:
            text = entities.unescape(html[at:start])
            parts.append(text)
            linked += len(text) if links else 0
        if start == len(html):
            break
        nxt = html[start + 1 : start + 2]
        if nxt == "!":
            close, size = ("-->", 3) if html.startswith("<!--", start) else (">", 1)
            end = html.find(close, start + 2)
            at = len(html) if end < 0 else end + size
            continue
        if nxt == "?":
            end = html.find(">", start)
            at = len(html) if end < 0 else end + 1
            continue
        if not (nxt.isascii() and nxt.isalpha() or nxt == "/" and html[start + 2 : start + 3].isascii() and html[start + 2 : start + 3].isalpha()):
            parts.append("<")
            at = start + 1
            continue
        found = _TAG.match(html, start) if quoted else None
        if found:
            closing, tag, rest = found.groups()
            at = found.end()
        else:  # a quote that never ends: from here on tags end at the next >
            quoted, end = False, html.find(">", start)
            if end < 0:
                break
            closing, tag, rest = re.match(r"<(/?)([^\s/>]*)(.*)", html[start:end], re.DOTALL).groups()
            at = end + 1
        tag = tag.lower()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if open_[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag in FLOW or tag in CONTAINERS:
                end_block()
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = len(html) if not end else end.start()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in FLOW or tag in CONTAINERS:
            end_block()
            if stack[-1][0] == "p" or tag == stack[-1][0] in ("li", "dd", "dt", "td", "th", "tr", "option"):
                pop()
        if tag in NO_CONTENT:
            continue
        if tag == "a":
            links += 1
        given = _attributes(rest)
        node = _opened(tag, given)
        if tag == "h1" or node and not node.named and not node.marked and node.label.split(".")[0] in ("article", "main"):
            for _, above in stack:
                above.named = False
        if node is None:
            continue
        end_block()
        if len(stack) <= DEPTH:
            stack[-1][1].items.append(node)
        else:
            node = stack[-1][1]
        stack.append((tag, node))
        open_[tag] += 1
    while stack:
        pop()
    return root


def shape_of(root: Node) -> tuple[list, list[str]]:
    """The shape [label, children] and the texts of its leaves in page order. Leaf labels: text or links; marked: with !."""
    texts: list[str] = []

    def visit(node: Node, marked: bool) -> list | None:
        children: list = []
        runs = 0
        for item in node.items:
            if isinstance(item, list):
                text = " ".join(item[0])
                texts.append(text)
                children.append(["links" if item[1] > LINKS * len(text) else "text", []])
                runs = 0
                continue
            child = visit(item, marked or item.marked or item.named)
            if child is None:
                continue
            folded = [child[0] + "+", child[1]]
            one = len(child[1]) == 1 and not child[1][0][1]
            if one and children and children[-1] == folded:
                texts[-2:] = [" ".join(texts[-2:])]
                continue
            children.append(child)
            runs = runs + 1 if one and len(children) > 1 and children[-2] == child else int(one)
            if runs == LEAST_RUN:
                del children[-LEAST_RUN:]
                children.append(folded)
                texts[-LEAST_RUN:] = [" ".join(texts[-LEAST_RUN:])]
        mark = "!" if node.marked or node.named else ""
        return [node.label + mark, children] if children else None

    return visit(root, False) or ["page", []], texts


def align(a: list, b: list) -> list[tuple[list, list]]:
    """Pairs of aligned nodes of two trees [label, children, ...] with equal roots: a largest simple tree matching."""
    sizes: dict[tuple[int, int], int] = {}

    def size(x: list, y: list) -> int:
        if x[0] != y[0]:
            return 0
        known = sizes.get((id(x), id(y)))
        if known is None:
            known = sizes[id(x), id(y)] = 1 + table(x[1], y[1])[-1][-1]
        return known

    def table(xs: list, ys: list) -> list[list[int]]:
        rows = [[0] * (len(ys) + 1)]
        for x in xs:
            last, row = rows[-1], [0]
            for j, y in enumerate(ys):
                best = max(last[j + 1], row[j])
                if x[0] == y[0]:
                    best = max(best, last[j] + size(x, y))
                row.append(best)
            rows.append(row)
        return rows

    pairs, todo = [], [(a, b)] if a[0] == b[0] else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        rows, i, j = table(x[1], y[1]), len(x[1]), len(y[1])
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((x[1][i], y[1][j]))
    return pairs


def weighted(shape: list, pages: int) -> list:
    return [shape[0], [weighted(c, pages) for c in shape[1]], pages]


def merge(wrapper: list, other: list) -> None:
    """Adds the other tree [label, children, pages] to the wrapper."""
    for x, y in align(wrapper, other):
        x[2] += y[2]
        if not y[1]:
            continue
        own = {id(c): i for i, c in enumerate(x[1])}
        partner = {id(q): own[id(p)] for p, q in align([None, x[1]], [None, y[1]])[1:] if id(p) in own}
        new, taken = [], 0
        for child in y[1]:
            at = partner.get(id(child))
            if at is None:
                new.append(child)
            else:
                new += x[1][taken : at + 1]
                taken = at + 1
        x[1][:] = new + x[1][taken:]


def without_rare(tree: list, least: float) -> list:
    return [tree[0], [without_rare(c, least) for c in tree[1] if c[2] >= least], tree[2]]


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


@F.arrow_udf(PARSED)
def _parsed(pages: pa.Array) -> pa.Array:
    out = []
    for page in pages:
        shape, texts = shape_of(page_tree(page.as_py() or ""))
        out.append({"shape": json.dumps(shape, separators=(",", ":"), ensure_ascii=False), "texts": texts})
    return pa.array(out, pa.struct([("shape", pa.string()), ("texts", pa.list_(pa.string()))]))


def _merged(batches):
    for table in each_group(batches, ["group"]):
        trees = [json.loads(t) for t in table.column("tree").to_pylist()]
        wrapper = trees[0]
        for other in trees[1:]:
            merge(wrapper, other)
        text = json.dumps(without_rare(wrapper, wrapper[2] * RARE), separators=(",", ":"), ensure_ascii=False)
        yield pa.RecordBatch.from_arrays([table.column("host")[:1].combine_chunks(), pa.array([text]), pa.array([wrapper[2]])], ["host", "tree", "pages"])


def wrappers(shapes: DataFrame) -> DataFrame:
    """Rows (host, shape, pages) to one wrapper a host: (host, tree), tree being [label, children, pages]."""

    @F.arrow_udf(T.StringType())
    def tree(shape: pa.Array, pages: pa.Array) -> pa.Array:
        return pa.array([json.dumps(weighted(json.loads(s.as_py()), n.as_py()), separators=(",", ":"), ensure_ascii=False) for s, n in zip(shape, pages)], pa.string())

    now = written(shapes.select("host", tree("shape", "pages").alias("tree"), "pages"), "wrappers")
    while True:
        sizes = now.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("groups"), F.count("*").alias("n"))
        if not sizes.where("n > 1").head(1):
            return now.select("host", "tree")
        # A group's place among its host's by hash; its number stands for (host, place) side by side in one partition.
        grouped = lookup_join(now, sizes, ["host"], "inner", salt_by=["tree"])
        grouped = grouped.withColumn("group", F.xxhash64("host", F.pmod(F.xxhash64("tree"), "groups")))
        dealt = grouped.select("host", "tree", "pages", "group").repartition("group").sortWithinPartitions("group", "host", F.desc("pages"), "tree")
        old, now = now, written(dealt.mapInArrow(_merged, "host string, tree string, pages long"), "wrappers")
        forget(old)


def _numbered(tree: list) -> dict[int, int]:
    """The number of each node, parents before children."""
    out, todo = {}, [tree]
    while todo:
        node = todo.pop()
        out[id(node)] = len(out)
        todo += reversed(node[1])
    return out


@F.arrow_udf(T.ArrayType(LEAF))
def _placed(shape: pa.Array, wrapper: pa.Array) -> pa.Array:
    """Each leaf of the shape in order: its nearest aligned wrapper node, whether that is the leaf itself, and its kind."""
    out, held, last = [], {}, None
    for s, w in zip(shape, wrapper):
        tree = json.loads(s.as_py())
        if w != last:
            last, whole = w, json.loads(w.as_py())
            held = _numbered(whole)
        partner = {id(x): held[id(y)] for x, y in align(tree, whole)}
        leaves, todo = [], [(tree, 0, "plain")]
        while todo:
            node, above, kind = todo.pop()
            own = partner.get(id(node))
            if not node[1]:
                if node is not tree:
                    leaves.append({"node": above if own is None else own, "leaf": own is not None, "kind": "links" if (kind, node[0]) == ("plain", "links") else kind})
                continue
            tag = node[0].rstrip("+!").split(".")[0]
            if node[0].rstrip("+").endswith("!") or tag == "header" and kind == "plain":
                kind = "marked"
            elif kind in ("plain", "main") and tag in ("article", "main"):
                kind = tag
            todo += [(c, above if own is None else own, kind) for c in reversed(node[1])]
        out.append(leaves)
    return pa.array(out, pa.list_(pa.struct([("node", pa.int32()), ("leaf", pa.bool_()), ("kind", pa.string())])))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _main_slot(wrapper: pa.Array, nodes: pa.Array, chars: pa.Array) -> pa.Array:
    """The nodes of the subtree that holds MAIN_SHARE of the slots' characters and has no child that does."""
    out = []
    for w, node, n in zip(wrapper, nodes, chars):
        tree = json.loads(w.as_py())
        number = _numbered(tree)
        own = dict(zip(node.as_py() or [], n.as_py() or []))
        total, order, todo = {}, [], [tree]
        while todo:
            x = todo.pop()
            order.append(x)
            todo += x[1]
        for x in reversed(order):
            total[id(x)] = own.get(number[id(x)], 0) + sum(total[id(c)] for c in x[1])
        at = tree
        while True:
            child = next((c for c in at[1] if c[1] and total[id(c)] >= MAIN_SHARE * total[id(tree)] > 0), None)
            if child is None:
                break
            at = child
        first = number[id(at)]
        inside, todo = [], [at]
        while todo:
            x = todo.pop()
            inside.append(number[id(x)])
            todo += x[1]
        out.append(inside if first else list(range(len(number))))
    return pa.array(out, pa.list_(pa.int32()))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars), one per row of pages."""
    page = F.col(html_col).cast("string")
    made = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), _host(F.col(url_col)).alias("host"), F.xxhash64(page).alias("content"), _parsed(page).alias("p"))
    parsed = written(made.select("id", "url", "host", "content", "p.shape", "p.texts").withColumn("key", F.xxhash64("shape")), "parsed")
    shapes = written(parsed.groupBy("host", "shape").agg(F.count("*").alias("pages")), "shapes")
    trees = written(wrappers(shapes), "trees")
    placed = written(lookup_join(shapes, trees, ["host"], "inner", salt_by=["shape"]).select("host", "shape", _placed("shape", "tree").alias("leaves")), "placed")

    thin = parsed.select("host", "shape", "content", F.transform("texts", lambda t: F.struct(F.xxhash64(t).alias("h"), F.char_length(t).alias("n"))).alias("t"))
    distinct = thin.dropDuplicates(["host", "content"])
    joined = lookup_join(distinct, placed, ["host", "shape"], "inner", salt_by=["content"])
    each = joined.select("host", F.explode(F.arrays_zip("leaves", "t")).alias("x")).select("host", "x.leaves.*", "x.t.h", "x.t.n")
    counted = each.where("leaf").groupBy("host", "node", "h").agg(F.count("*").alias("pages"), F.sum(F.when(F.col("kind") == "plain", F.col("n")).otherwise(0)).alias("chars"))
    stats = counted.groupBy("host", "node").agg(F.max(F.struct("pages", "h")).alias("top"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"))
    fixed = (F.col("pages") >= LEAST_PAGES) & (F.col("top.pages") >= ALIKE * F.col("pages"))
    # One row per wrapper node, which are bounded by RARE: a host's lists are small.
    stats = stats.select("host", "node", F.when(fixed, F.col("top.h")).alias("same"), F.when(fixed, 0).otherwise(F.col("chars")).alias("chars"))
    known = stats.groupBy("host").agg(F.collect_list(F.struct("node", "same", "chars")).alias("s"))
    hosts = trees.join(known, "host", "left")
    hosts = hosts.select("host", F.filter("s", lambda x: x["same"].isNotNull()).alias("fixed"), _main_slot("tree", F.col("s.node"), F.col("s.chars")).alias("slot"))
    rules = lookup_join(placed, written(hosts, "hosts"), ["host"], "left", salt_by=["shape"])
    same = F.map_from_entries(F.transform(F.coalesce("fixed", F.array()), lambda x: F.struct(x["node"], x["same"])))
    ruled = F.transform(
        "leaves", lambda x: F.struct(x["kind"].alias("kind"), F.when(x["leaf"], F.element_at("same", x["node"])).alias("same"), F.array_contains("slot", x["node"]).alias("main"))
    )
    rules = written(rules.withColumn("same", same).select("host", "shape", ruled.alias("rules")), "rules")

    full = lookup_join(parsed, rules, ["host", "shape"], "left", salt_by=["id", "content"])
    leaf = F.arrays_zip("texts", "rules")
    is_ = lambda kind: lambda x: x["rules"]["kind"] == kind
    inner = F.when(F.exists(leaf, is_("article")), F.filter(leaf, is_("article"))).when(F.exists(leaf, is_("main")), F.filter(leaf, is_("main")))
    inner = inner.otherwise(F.filter(leaf, lambda x: (x["rules"]["kind"] == "plain") & x["rules"]["main"]))
    varying = F.filter("inner", lambda x: ~F.coalesce(x["rules"]["same"] == F.xxhash64(x["texts"]), F.lit(False)))
    text = lambda leaves: F.array_join(F.transform(leaves, lambda x: x["texts"]), " ")
    unmarked = F.filter(leaf, lambda x: ~x["rules"]["kind"].isin("marked", "links"))
    out = full.withColumn("inner", inner).withColumn("varying", varying).select("id", "url", text("inner").alias("inner"), text("varying").alias("varying"), text(unmarked).alias("unmarked"))
    best = F.when(F.char_length("varying") * 2 >= F.char_length("inner"), F.col("varying")).otherwise(F.col("inner"))
    best = F.when(F.char_length(best) > 0, best).otherwise(F.col("unmarked"))
    return out.select("id", "url", F.coalesce(best, F.lit("")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
