"""Main-text extraction with site style trees.

The pages of a host are merged into one style tree. An element node is a path of elements with their presentation (tag, class,
id, role); its own text is a leaf below it, and the different texts that pages have there are content nodes. Importance is composed from the leaves up:

- A content node on n pages has the entropy H = ln n over them and the importance exp(-H): 1 for a text of one page, near 0 for
  one that comes on every page.
- The content importance of an element is the mean of that over all texts in its branch, weighed by their characters. As the
  sums over a branch are those of its nodes, every ancestor gets them from one pass over the tree.
- The presentation importance of an element with children is the entropy of the child sequences that its m pages show, to the
  base m. The composite importance takes CONTENT_WEIGHT of the first and the rest of the second.
- Figures of few pages say little. A host's importance counts with the number of its pages, that of the same path over all hosts
  with SITE_PAGES, and in that what HTML itself says of an element (a header, a class named advert, an article) with HINT_PAGES. There
  is no size at which anything is switched: every page added moves the figure a little.
- From the root down, a node takes OWN_SHARE of its own importance and the rest of its parent's. Text whose node ends below
  LEAST_IMPORTANCE is removed. So a repeated sentence in an article is held up by the article, and a new link in a menu goes
  with the menu.

Equal pages of a host count once. Elements without any text of a page (scripts, form controls) and those that are no main text
by the very meaning of HTML (menus, footers, asides, hidden ones) are left out before the tree.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, spread, stored

#: Elements that never hold main text, and those whose raw text is not markup.
NOISE = frozenset("nav footer aside script style noscript template iframe object embed svg canvas select button input textarea menu dialog head title".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset("article main".split())
#: Elements that are doubtful outside an article: a form around a page holds its text, one within a page a search or a login.
DOUBTFUL = frozenset(["form", "header"])
#: Words of class, id and role values that mark a doubtful branch.
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus replies respond pagination pager widget toolbar search skip".split())
#: An open element of the key is closed by a start tag of the values.
CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"])}
#: Elements that an end tag of another does not close over.
SCOPES = frozenset("article aside body div footer form header html main nav section table td ul ol".split())

#: Share of contents in the composite, pages that the tree of all hosts and the hints count as, share of a node's own figure.
CONTENT_WEIGHT, SITE_PAGES, HINT_PAGES, OWN_SHARE = 0.9, 40, 60, 0.8
#: Text of nodes that end below this is removed.
LEAST_IMPORTANCE = 0.65
EVERY_HOST = "*"
#: Elements nested deeper stand in the tree with the last one above this depth, as browsers flatten them too.
MOST_DEPTH = 256
#: Pages whose features are held at a time.
STEP_PAGES = 64

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    path: int  # hash of the elements from the root with their presentation
    chain: tuple[int, ...]  # paths from the root to it
    noise: bool
    held: bool = False  # in an article or main element
    marks: tuple[int, ...] = ()  # doubtful elements around it since the last article or main, itself last, by their order
    apart: bool = False  # an inline element whose text is a block of its own
    children: list[str] = field(default_factory=list)
    own: bool = False  # is doubtful itself
    hint: float = 1.0  # what HTML says of it: 1 main text or nothing, 0 doubtful itself, 0.5 in a doubtful branch


    def leaf(self) -> Node:
        """The content node below it that holds its own text."""
        if self.text is None:
            path = xxhash.xxh64_intdigest(f"{self.path}/#text", 0) >> 1
            self.text = Node("#text", path, (*self.chain, path), self.noise, self.held, self.marks, own=self.own)
        return self.text

    text: Node | None = None


@dataclass
class Block:
    text: str
    node: Node  # the content node


def _presentation(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """(tag with class, id and role, whether it is noise by its meaning, an article or main element, doubtful)."""
    noise, held, marked = tag in NOISE, tag in MAIN, tag in DOUBTFUL
    if not attrs or attrs.isspace():
        return tag, noise, held, marked
    marks = []
    for m in _ATTR.finditer(attrs):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
        marks.append(f"{m[1].lower()}={value.strip()}")
        for w in value.split():
            marked = marked or bool(set(_WORDS.findall(_CAMEL.sub(" ", w).lower())) & NOISE_WORDS)
            held = held or m[1].lower() == "role" and w.lower() in MAIN
    if _HIDDEN.search(attrs):
        noise = True
    root = tag in ("html", "body")
    return " ".join([tag, *sorted(marks)]), noise and not root, held and not noise, marked and not held and not root


def parse(source: str) -> tuple[list[Block], list[Node]]:
    """(blocks of text in page order, all elements) of a page; white space in a block is one space, blocks aren't empty.

    Unclosed and crossing elements are closed as HTML closes them: a paragraph ends where a block starts, an end tag closes
    what is open inside its element, and one without a start is left out.
    """
    root = Node("#root", 0, (0,), False)
    stack, nodes, out = [root], [root], []
    text: list[str] = []
    at, n = 0, len(source)

    def flush() -> None:
        if text:
            words = "".join(text).split()
            text.clear()
            if words:
                owner = next((x for x in reversed(stack) if x.tag not in INLINE or x.apart), root)
                out.append(Block(" ".join(words), owner.leaf()))

    def close(k: int) -> None:
        if any(x.tag not in INLINE or x.apart for x in stack[k:]):
            flush()
        del stack[k:]

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not stack[-1].tag in RAW:
            text.append(entities.unescape(source[at:lt]))
        if lt == n:
            break
        m = _TAG.match(source, lt) or _LOOSE.match(source, lt)
        if not m:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m.lastindex is None or not m[2]:
            continue  # a comment or a declaration
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in SCOPES and tag in INLINE | {"p", "li"}:
                    break
            continue
        closed = [t for t, by in CLOSES.items() if tag in by]
        for t in closed:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == t:
                    close(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            # Inline elements left open don't reach into the next block.
            k = len(stack)
            while k > 1 and stack[k - 1].tag in INLINE:
                k -= 1
            flush()
            del stack[k:]
        mark, noise, held, marked = _presentation(tag, m[3])
        parent = stack[-1]
        parent.children.append(tag)
        if tag in VOID:
            continue
        apart = tag in INLINE and (noise or marked)
        if apart:
            flush()
        marked = marked and not (parent.held and tag in DOUBTFUL and tag != "form")
        marks = () if held else (*parent.marks, len(nodes)) if marked else parent.marks
        if tag in INLINE and not apart:
            node = Node(tag, parent.path, parent.chain, parent.noise, parent.held, parent.marks, own=parent.own)
        else:
            deep = len(parent.chain) >= MOST_DEPTH
            path = parent.path if deep else xxhash.xxh64_intdigest(f"{parent.path}/{mark}", 0) >> 1
            node = Node(tag, path, parent.chain if deep else (*parent.chain, path), parent.noise or noise, parent.held or held, marks, apart, own=marked)
            nodes.append(node)
        if m[3].rstrip().endswith("/") and tag not in INLINE:
            continue
        stack.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else n
            stack.pop()
    flush()
    _hints(out, nodes)
    return out, nodes


def _hints(blocks_: list[Block], nodes: list[Node]) -> None:
    """A doubtful branch that has half of the page's text or more is the page's main text where no article stands elsewhere. The
    word is about the element that has it, and half as much about those below."""
    blocks_ = [b for b in blocks_ if not b.node.noise]
    size: dict[int, int] = {}
    for b in blocks_:
        for k in b.node.marks:
            size[k] = size.get(k, 0) + len(b.text)
    half = sum(len(b.text) for b in blocks_) / 2
    article = any(b.node.held and not b.node.marks for b in blocks_)
    for x in {id(n): n for n in (*nodes, *(b.node for b in blocks_))}.values():
        doubtful = x.marks and (article or size.get(x.marks[-1], 0) < half)
        x.hint = (0.0 if x.own else 0.5) if doubtful else 1.0


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def host_column(url: str) -> Column:
    """host_of() of a column."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), "^.*@", ""))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text, 0) >> 1


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, html) -> for each page its host, digest and what it has: (path, kind, content, size). Kind 0: the node, with twice its
    hint as size; 1: a text of `size` characters; 2: a child sequence, size 1 if not empty. And once a task for each path, its chain."""
    entry = pa.struct([("path", pa.int64()), ("kind", pa.int32()), ("content", pa.int64()), ("size", pa.int64())])
    known: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_PAGES):
            part = batch.slice(at, STEP_PAGES)
            hosts, digests, lists, paths, chains = [], [], [], [], []
            for url, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                source, host = source or "", host_of(url)
                blocks_, nodes = parse(source)
                nodes = [x for x in (*nodes, *{id(b.node): b.node for b in blocks_}.values()) if not x.noise]
                seen: dict[tuple[int, int, int], int] = {}
                for x in nodes:
                    seen[(x.path, 0, 0)] = max(seen.get((x.path, 0, 0), 0), int(2 * x.hint))
                    if x.path not in known:
                        known.add(x.path)
                        paths.append(x.path)
                        chains.append(x.chain)
                for b in blocks_:
                    if not b.node.noise:
                        # A host's own name in its texts is no difference between hosts.
                        text = b.text.replace(host, "\0") if host else b.text
                        seen[(b.node.path, 1, _hash(text))] = len(text)
                styles: dict[int, list[str]] = {}
                for x in nodes:
                    if x.tag != "#text":
                        styles.setdefault(x.path, []).append(",".join(x.children))
                seen |= {(p, 2, _hash("|".join(s))): int(any(s)) for p, s in styles.items()}
                hosts.append(host)
                digests.append(hashlib.md5(source.encode("utf-8", "surrogatepass")).digest())
                lists.append([{"path": p, "kind": k, "content": c, "size": v} for (p, k, c), v in seen.items()])
            none = [None] * len(paths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts + none, pa.string()), pa.array(digests + none, pa.binary()), pa.array(lists + none, pa.list_(entry)), pa.array([None] * len(hosts) + paths, pa.int64()), pa.array([None] * len(hosts) + chains, pa.list_(pa.int64()))],
                names=["host", "digest", "seen", "path", "chain"],
            )


def style_tree(pages: DataFrame, site_pages: float = SITE_PAGES, hint_pages: float = HINT_PAGES) -> DataFrame:
    """(host, path, pages, importance, standing): every element of each host's style tree; pages: url, html.

    importance is composed from below, standing is what is left of it from the root down. Pages of a host with the same html
    count once. Contents are counted by host, path and content, so no task holds a host; the tree itself has a row for
    each path, and rolls up through the paths' chains.
    """
    kinds = "host string, digest binary, seen array<struct<path:long,kind:int,content:long,size:long>>, path long, chain array<long>"
    found = stored(pages.select("url", "html").mapInArrow(_features, kinds), "pagefeatures")
    chains = found.filter("chain is not null").groupBy("path").agg(F.first("chain").alias("chain"))
    once = found.filter("host is not null").select("host", "digest", "seen").dropDuplicates(["host", "digest"])
    rows = once.select("host", F.explode("seen").alias("x")).select("host", "x.*")
    counts = stored(rows.groupBy("host", "path", "kind", "content").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.sum("size").alias("sizes")), "contents")
    every = counts.groupBy("path", "kind", "content").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.sum("sizes").alias("sizes")).select(F.lit(EVERY_HOST).alias("host"), "path", "kind", "content", "n", "size", "sizes")
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0.0))
    per = counts.unionByName(every).groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.max(F.when(F.col("kind") == 0, F.col("sizes") / 2)).alias("hinted"),
        of(1, F.col("size").cast("double")).alias("once"),
        of(1, F.col("size").cast("double") * F.col("n")).alias("all"),
        of(2, F.col("n") * F.log("n")).alias("nlogs"),
        (of(2, F.col("size").cast("double")) > 0).alias("inner"),
    )
    per = stored(per.join(chains, "path"), "treenodes")
    branch = per.select("host", F.explode("chain").alias("path"), "once", "all").groupBy("host", "path").agg(F.sum("once").alias("once"), F.sum("all").alias("all"))
    both = per.drop("once", "all").join(branch, ["host", "path"])
    content = F.when(F.col("all") > 0, F.col("once") / F.col("all")).otherwise(F.lit(1.0))
    style = F.when(F.col("pages") > 1, 1 - F.col("nlogs") / F.col("pages") / F.log("pages")).otherwise(F.lit(1.0))
    own = F.when(F.col("inner"), content * CONTENT_WEIGHT + style * (1 - CONTENT_WEIGHT)).otherwise(content)
    both = both.select("host", "path", "chain", "pages", "hinted", own.alias("own"))
    wide = both.filter(F.col("host") == EVERY_HOST).select("path", ((F.col("own") * F.col("pages") + F.col("hinted") / F.col("pages") * hint_pages) / (F.col("pages") + hint_pages)).alias("wide"), F.col("pages").alias("anywhere"))
    site = both.filter(F.col("host") != EVERY_HOST).join(wide, "path")
    site = stored(site.select("host", "path", "chain", "pages", "anywhere", ((F.col("own") * F.col("pages") + F.col("wide") * site_pages) / (F.col("pages") + site_pages)).alias("importance")), "styletree")
    depth = F.size("chain")
    up = site.select("host", "path", depth.alias("depth"), F.posexplode("chain").alias("at", "of"))
    weight = F.when(F.col("at") == 0, F.lit(1.0)).otherwise(F.lit(OWN_SHARE)) * F.pow(F.lit(1 - OWN_SHARE), F.col("depth") - 1 - F.col("at"))
    standing = up.join(site.select("host", F.col("path").alias("of"), "importance"), ["host", "of"]).groupBy("host", "path").agg(F.sum(weight * F.col("importance")).alias("standing"))
    return site.drop("chain").join(standing, ["host", "path"])


def alone(hint: float, site_pages: float = SITE_PAGES, hint_pages: float = HINT_PAGES) -> float:
    """The importance of a node that one page has only."""
    wide = (1 + hint * hint_pages) / (1 + hint_pages)
    return (1 + wide * site_pages) / (1 + site_pages)


def extract(source: str, standing: dict[int, float], least: float = LEAST_IMPORTANCE) -> str:
    """The main text of a page; standing: that of its paths, where more than one page has them."""
    blocks_, _ = parse(source)
    known = {0: standing.get(0, 1.0)}

    def of(x: Node) -> float:
        if x.path not in known:
            if x.path in standing:
                known[x.path] = standing[x.path]
            else:
                # The nearest ancestor that is known, then down again; what is unknown is of this page alone.
                k = next(i for i in range(len(x.chain) - 2, -1, -1) if x.chain[i] in known or x.chain[i] in standing)
                v = known.get(x.chain[k], standing.get(x.chain[k], 1.0))
                for p in x.chain[k + 1 :]:
                    v = known[p] = OWN_SHARE * alone(x.hint) + (1 - OWN_SHARE) * v
        return known[x.path]

    return " ".join(b.text for b in blocks_ if not b.node.noise and of(b.node) >= least)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", site_pages: float = SITE_PAGES, hint_pages: float = HINT_PAGES) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    A null page is an empty one; one without a host shares the tree of the host "". Repeated rows each have a row, and
    count as one page. A page of any length is one parse. An empty table gives an empty result. Other columns are ignored,
    whatever their names. What a host sends to its pages is a figure for each path that two pages or more have.
    """
    rows = spread(pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), col(html_col).alias("html")))
    tree = style_tree(rows, site_pages, hint_pages).filter("anywhere > 1")
    figures = stored(tree.groupBy("host").agg(F.collect_list(F.struct("path", "standing")).alias("tree")), "standings")
    joined = rows.withColumn("host", host_column("url")).join(figures, "host", "left").select("page_id", "url", "html", "host", "tree")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for batch in batches:
            done = []
            for source, host, tree_ in zip(batch.column(2), batch.column(3), batch.column(4)):
                host = host.as_py()
                if host != last:
                    last, held = host, {x["path"]: x["standing"] for x in tree_.as_py() or ()}
                done.append(extract(source.as_py() or "", held))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.string()), pa.array([len(x) for x in done], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    types = dict(joined.dtypes)
    return joined.mapInArrow(extracted, f"page_id {types['page_id']}, url string, text string, n_chars long")
