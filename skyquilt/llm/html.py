"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of element paths. Each node has the
distribution, over the host's distinct pages, of its presentation (the sequence of its
children's labels) and of its content (the text of its branch), and its share of a page's
text. A node whose presentation varies is important by its presentation, one whose content
differs from page to page by its content; a branch that is alike on many pages is neither.

Entropy tells templates from articles, not articles from adverts, whose words also change
from page to page. So a node's place weighs in: where pages have an article or main element, the
importance of what stands beside it is multiplied by its share of the host's text, whatever it
is called, so that it stays only where it is much of what a site has. The same holds for
blocks whose class says advert or promotion on pages without such an element, and for boxes of that
kind within one; paragraphs and other parts of an article are never judged by their class. Elements that
are by their kind no part of an article (menus, headers, forms, scripts and so on) have
importance 0. Branches of low importance are removed from each page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts_of
from .urlfilter import host_and_path

#: Importance below which a branch goes, the weight of content against presentation, and the pages, all different, that a node is taken to be on besides those seen: a node alike on all of its m pages goes from m = 9.
LEAST_IMPORTANCE, CONTENT_WEIGHT, UNSEEN = 0.2, 0.8, 2
#: Unimportant nodes that are broadcast at most, and shares that a host's pages are dealt in beyond it.
BROADCAST_NODES, SHARES = 100_000, 32
#: Pages that a task holds in mind, so as to send on a copy once.
HELD = 100_000

#: Elements without content, elements whose content is no markup, elements that end a block, elements that are no part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NOISE = frozenset("aside button canvas datalist dialog fieldset footer form head iframe input label menu nav noembed noframes noscript object option script select style svg template textarea title xmp".split())
#: Words in a class or id that mark what is no part of an article, those that mark what the tree is to judge by its share, and roles.
NOISE_WORDS = frozenset("breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation notice notices pagination respond sidebar toolbar".split())
DOUBTED_WORDS = frozenset("ad ads adsbygoogle advert advertisement advertising adverts banner newsletter popup promo promoted promotion related share sharebar sharing signup social sponsor sponsored subscribe widget".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Elements that hold the article, and boxes that may hold an advert inside it.
ARTICLE = frozenset("article main".split())
BOXES = frozenset("center details div dl figure ins ol section span table ul".split())
#: What an open element of the first kind is ended by, as far as an element of the second kind.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
#: A tag's name, and its attributes as far as the next > outside quotes; nothing is tried twice.
NAME = re.compile(r"/?\s*+[a-zA-Z][^\s/>]*+")
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[^a-z0-9]+")
COMMENTS = (("<!--", "-->"), ("<![CDATA[", "]]>"))
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    """An element: its label (name and first class), the hash of its path of labels, children in order (nodes and strings), whether it is noise or doubted by its kind, and whether it is in an article."""

    __slots__ = ("name", "label", "path", "children", "noise", "doubted", "inside")

    def __init__(self, name: str, label: str, parent: Node | None, noise: bool = False, doubted: bool = False) -> None:
        self.name, self.label, self.noise, self.doubted = name, label, noise, doubted
        self.path = path_key(f"{parent.path}/{label}") if parent else 0
        self.inside = name in ARTICLE or bool(parent and parent.inside)
        self.children: list[Node | str] = []


def path_key(path: str) -> int:
    return xxhash.xxh64_intdigest(path) - (1 << 63)


def _kind(name: str, attributes: str, parent: Node) -> tuple[str, bool, bool]:
    """An element's label, and whether it is noise, or doubted, by its name or attributes."""
    label, noise, doubted = name, name in NOISE or name == "header" and not parent.inside, False
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "class" or key == "id":
                if key == "class" and value.split():
                    label = f"{name}.{value.split()[0].lower()}"
                if name not in ("html", "body") and name not in ARTICLE:
                    words = WORDS.split(value.lower())
                    noise = noise or not NOISE_WORDS.isdisjoint(words)
                    doubted = doubted or (not parent.inside or name in BOXES) and not DOUBTED_WORDS.isdisjoint(words)
            elif key == "role":
                noise = noise or value.strip().lower() in NOISE_ROLES
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
                noise = True
    return label, noise, doubted


def _element(name: str, attributes: str, parent: Node) -> Node:
    label, noise, doubted = _kind(name, attributes, parent)
    return Node(name, label, parent, noise, doubted)


class Open:
    """The open elements, with the places of each name and of the blocks, so that no search walks them."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.blocks = [root], [0]
        self.at: dict[str, list[int]] = {}

    def last(self, name: str) -> int:
        return self.at[name][-1] if self.at.get(name) else 0

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.nodes))
        if node.name in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def end(self, place: int) -> None:
        """Close all elements from a place on."""
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.at[node.name].pop()
            if self.blocks[-1] == len(self.nodes):
                self.blocks.pop()


def tree(source: str) -> Node:
    """The element tree of a page, with missing end tags supplied.

    A tag ends at the first > outside quotes; from a tag on whose quotes never close, tags
    end at their first > whatever the quotes. What is behind a < that starts a tag without
    any > is part of that tag and so no text.
    """
    root = Node("", "", None)
    stack, at, quotes = Open(root), 0, True
    while at < len(source):
        found = source.find("<", at)
        if found < 0 or found + 1 == len(source):
            stack.nodes[-1].children.append(source[at:])
            break
        after = source[found + 1]
        named = NAME.match(source, found + 1) if after.isascii() and (after.isalpha() or after == "/") else None
        if not named and after not in "!?/":
            stack.nodes[-1].children.append(source[at : found + 1])
            at = found + 1
            continue
        if found > at:
            stack.nodes[-1].children.append(source[at:found])
        if not named:
            opens, closes = next((p for p in COMMENTS if source.startswith(p[0], found)), ("", ">"))
            end = source.find(closes, found + len(opens))
            at = end + len(closes) if end >= 0 else len(source)
            continue
        inside = quotes and INSIDE.match(source, named.end())
        end = inside.end() if inside else source.find(">", named.end()) + 1
        quotes = quotes and bool(inside)
        if not end:
            break
        attributes, at = source[named.end() : end - 1], end
        if after == "/":
            name = named[0][1:].strip().lower()
            if name == "br":
                stack.nodes[-1].children.append(" ")
            # an end tag of a phrase ends nothing outside its block
            elif (place := stack.last(name)) and (name in BLOCK or place > stack.blocks[-1]):
                stack.end(place)
            continue
        name = named[0].lower()
        if name in BLOCK and stack.blocks[-1] and stack.nodes[stack.blocks[-1]].name == "p":
            # a block ends an open paragraph, with the phrases that were left open in it
            stack.end(stack.blocks[-1])
        if name in CLOSES:
            ends, within = CLOSES[name]
            outer = max(map(stack.last, within))
            if places := [p for n in ends if (p := stack.last(n)) > outer]:
                stack.end(max(places))
        node = _element(name, attributes, stack.nodes[-1])
        stack.nodes[-1].children.append(node)
        if name in RAW:
            close = re.compile(rf"</\s*{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
            node.children.append(source[at : close.start() if close else len(source)])
            at = close.end() if close else len(source)
        elif name not in VOID and (name in BLOCK or not attributes.rstrip().endswith("/")):
            stack.push(node)
    doubt_beside(root)
    return root


def doubt_beside(root: Node) -> None:
    """Doubt the blocks that stand beside the article of a page that has one; a main heading may stand there."""
    every = list(walk(root, set()))
    if not any(x.name in ARTICLE and not x.noise for x in every):
        return
    around: set[int] = set()
    for x in reversed(every):  # children before parents
        if x.name in ARTICLE or any(isinstance(c, Node) and id(c) in around for c in x.children):
            around.add(id(x))
        elif not x.inside and x.name in BLOCK and x.name not in ("html", "body", "h1"):
            x.doubted = True


def judged(x: Node) -> bool:
    """Whether the tree judges an element: blocks do, but for the whole page, and what is doubted."""
    return x.doubted or x.name in BLOCK and x.name not in ("html", "body") and x.name not in ARTICLE


def walk(x: Node, gone: set[int]) -> Iterator[Node]:
    """The elements of a branch in page order, without what is below noise and below elements in `gone` (their id())."""
    work = [x]
    while work:
        x = work.pop()
        yield x
        if not x.noise and id(x) not in gone:
            work += [c for c in reversed(x.children) if isinstance(c, Node)]


def sizes(root: Node) -> dict[int, int]:
    """By id(): the words of each branch, without those of noise in it."""
    out: dict[int, int] = {}
    for x in reversed(list(walk(root, set()))):  # children before parents
        out[id(x)] = 0 if x.noise else sum(len(c.split()) if isinstance(c, str) else out.get(id(c), 0) for c in x.children)
    return out


def removed(root: Node, unimportant: frozenset[int] | set[int]) -> set[int]:
    """By id(): the elements that the tree removes from a page.

    Article and main elements are what a page is for. If the nodes to go from inside one
    hold half of its words or more, its text is like that of other pages (as copies under
    other menus are) and it keeps all of them; so does a page that would be left without a
    word.
    """
    if not unimportant:
        return set()
    low = {id(x): x for x in walk(root, set()) if judged(x) and x.path in unimportant}
    if not low:
        return set()
    size = sizes(root)

    def lost(top: Node, gone: set[int]) -> int:
        return sum(size[id(x)] for x in walk(top, gone) if id(x) in gone)

    gone = set(low)
    for top in walk(root, set()):
        if top.name in ARTICLE:
            plain = {i for i in gone if low[i].inside and not low[i].doubted}
            if plain and 2 * lost(top, plain) >= size[id(top)]:
                gone -= {id(x) for x in walk(top, set()) if id(x) in plain}
    return gone if lost(root, gone) < size[id(root)] else {i for i in gone if low[i].doubted}


def blocks(root: Node, gone: set[int] = frozenset()) -> list[str]:
    """The text blocks of what is left of a tree, in page order."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if text := " ".join(html.unescape("".join(run)).split()):
            out.append(text)
        run.clear()

    # own stack, as pages may be nested deeply
    work: list[Node | str | None] = [root]
    while work:
        x = work.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.name == "br":
            run.append(" ")
        elif x.noise or id(x) in gone:
            run.append(" ")
            if x.name in BLOCK:
                end()
        else:
            if x.name in BLOCK:
                end()
                work.append(None)
            work += reversed(x.children)
    end()
    return out


def features(root: Node) -> dict[int, tuple[int, int, bool, float]]:
    """For each path of judged elements: hashes of its presentation (children's labels, repeats once) and of its content (text), whether it is doubted, and its share of the page's words."""
    texts: dict[int, str] = {}
    found: dict[int, tuple[list, list]] = {}
    doubted: dict[int, bool] = {}
    words: dict[int, int] = {}
    size = sizes(root)
    for x in reversed(list(walk(root, set()))):  # children before parents
        if x.noise:
            continue
        texts[id(x)] = xxhash.xxh64_hexdigest("".join(c.strip() if isinstance(c, str) else texts.get(id(c), "") for c in x.children))
        if judged(x):
            labels = [c.label if isinstance(c, Node) else "#" for c in x.children if isinstance(c, Node) or c.strip()]
            style, content = found.setdefault(x.path, ([], []))
            style.append(" ".join(n for i, n in enumerate(labels) if not i or labels[i - 1] != n))
            content.append(texts[id(x)])
            doubted[x.path] = doubted.get(x.path, False) or x.doubted
            words[x.path] = words.get(x.path, 0) + size[id(x)]
    every = max(1, size[id(root)])
    return {p: (path_key("\n".join(s)), path_key("\n".join(c)), doubted[p], min(1.0, words[p] / every)) for p, (s, c) in found.items()}


NODES = "array<struct<path:long,style:long,content:long,doubted:boolean,share:double>>"


def style_counts(rows: DataFrame) -> DataFrame:
    """host, path, kind (0 presentation, 1 content), feature, n, doubted, share (a sum): over the distinct pages of each host.

    Copies of a page are one page: they tell nothing of what its host's pages share. Only a
    page's features are shuffled, once for each task that has a copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str | None, int]] = set()
        node = pa.struct([("path", pa.int64()), ("style", pa.int64()), ("content", pa.int64()), ("doubted", pa.bool_()), ("share", pa.float64())])
        kinds = [pa.string(), pa.int64(), pa.list_(node)]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    page = path_key(source)
                    if (host, page) in seen:
                        continue
                    if len(seen) >= HELD:
                        seen.clear()
                    seen.add((host, page))
                    out.append((host, page, [dict(zip(("path", "style", "content", "doubted", "share"), (p, *f))) for p, f in features(tree(source)).items()]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["host", "page", "nodes"])

    pages = rows.select("host", "html").mapInArrow(run, f"host string, page long, nodes {NODES}").dropDuplicates(["host", "page"])
    nodes = pages.select("host", F.explode("nodes").alias("x"))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("x.style").alias("feature")), F.struct(F.lit(1).alias("kind"), F.col("x.content").alias("feature")))
    return nodes.select("host", "x.path", "x.doubted", "x.share", F.explode(both).alias("y")).groupBy("host", "path", "y.kind", "y.feature").agg(F.count("*").alias("n"), F.max("doubted").alias("doubted"), F.sum("share").alias("share"))


def unimportant_nodes(counts: DataFrame) -> DataFrame:
    """host, path: the nodes of each host's tree whose importance is low.

    A feature that n of the m pages with the node have gives it n/m log n: presentation and
    content are 1 - sum(n log n) / (m log m), the entropy over its most, which is 1 if all
    pages differ and 0 if all are alike; a node of one page has 1. UNSEEN pages are taken in
    with the m, on which it differs and has no share. Importance is the weighted mean of both,
    times the node's mean share of a page's words if it is doubted.
    """
    n = F.col("n").cast("double")
    sums = counts.groupBy("host", "path", "kind").agg(F.sum(n).alias("m"), F.sum(n * F.log(n)).alias("s"), F.max("doubted").alias("doubted"), F.sum("share").alias("share"))
    v = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0)
    weight = F.when(F.col("kind") == 1, CONTENT_WEIGHT).otherwise(1 - CONTENT_WEIGHT)
    sums = sums.withColumn("part", weight * (F.col("m") * v + UNSEEN) / (F.col("m") + UNSEEN))
    nodes = sums.groupBy("host", "path").agg(F.sum("part").alias("importance"), F.max("doubted").alias("doubted"), (F.max("share") / (F.max("m") + UNSEEN)).alias("share"))
    importance = F.col("importance") * F.when(F.col("doubted"), F.col("share")).otherwise(1.0)
    return nodes.where(importance < LEAST_IMPORTANCE).select("host", "path")


def main_text(source: str | None, unimportant: frozenset[int] | set[int] = frozenset()) -> str:
    root = tree(source or "")
    return "\n".join(blocks(root, removed(root, unimportant)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: `id_col`, `url_col`, text, n_chars.

    Text is that of the blocks left, in page order, joined by line feeds; within a block
    character references are decoded and white space is one space. A null or empty page
    has an empty text, a null URL an empty host; hosts of few pages go by the same formula
    as others, with little weight on what their pages share. Repeated pages
    get equal texts, an empty table gives an empty result, further columns are ignored. A
    host's tree is merged from counts, so its size is that of its distinct paths and
    features, and no task gathers a host's pages. Time is linear in a page's length.
    """
    host, _ = host_and_path(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn("host", host)
    nodes = cut(unimportant_nodes(style_counts(rows)))
    kind = rows.schema["_id"].dataType.simpleString()
    few = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    if few:
        by_host: dict[str, set[int]] = {}
        for r in nodes.collect():  # BROADCAST_NODES at most
            by_host.setdefault(r["host"], set()).add(r["path"])
        known = pages.sparkSession.sparkContext.broadcast(by_host)
        dealt = rows.select("_id", "_url", "html", "host", F.lit(None).cast("int").alias("_share"), F.lit(None).cast("long").alias("path"))
    else:
        known = None
        shared = nodes.select(F.lit(None).cast(kind).alias("_id"), F.lit(None).cast("string").alias("_url"), F.lit(None).cast("string").alias("html"), "host", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share"), "path")
        own = rows.select("_id", "_url", "html", "host", F.pmod(F.xxhash64("_id", "_url"), F.lit(SHARES)).cast("int").alias("_share"), F.lit(None).cast("long").alias("path"))
        # each share of a host has its nodes first, then its pages
        dealt = own.unionByName(shared).repartition(parts_of(pages.sparkSession), "host", "_share").sortWithinPartitions("host", "_share", F.col("path").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: set[int] = set()
        now, own = None, none
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, out = batch.slice(at, 64), []
                for own_id, url, source, name, share, path in zip(*(part.column(c).to_pylist() for c in ("_id", "_url", "html", "host", "_share", "path"))):
                    if known is not None:
                        own = known.value.get(name, none)
                    elif now != (name, share):
                        now, own = (name, share), set()
                    if path is not None:
                        own.add(path)
                    else:
                        text = main_text(source, own)
                        out.append((own_id, url, text, len(text)))
                if out:
                    kinds = [part.schema.field("_id").type, pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["_id", "_url", "text", "n_chars"])

    out = dealt.mapInArrow(run, f"_id {kind}, _url string, text string, n_chars long")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
