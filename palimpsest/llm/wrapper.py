"""HTML extraction by wrapper induction: pages of a host are aligned by simple tree matching; constant leaves are template."""

from __future__ import annotations

import html as entities
import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import grouped, written

#: Share of the other pages of a host that must have a leaf's text at the aligned place to make it template.
CONSTANT = 0.5
#: Depth to which pages are compared for their layout; layouts with this share of common paths are one cluster.
LAYOUT_DEPTH, LIKE = 4, 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)>|</([a-zA-Z][^\s>]*)[^>]*>|<[!?][^>]*>|([^<]+|<)", re.S | re.I)
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body div dl dd dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header html li main nav ol p pre section table tbody td tfoot th thead title tr ul br hr".split())
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "body": {"head"}}
_SCOPE = frozenset("table ul ol dl div section article select".split())
#: Tags, and words of a class, id or role, of a node that is a region beside the content; what lies within _INNER is none.
_REGION_TAGS = frozenset("nav footer aside menu".split())
_REGION_NAMES = frozenset("ad ads advert advertisement sponsored nav navbar navigation menu sidebar footer breadcrumb breadcrumbs banner contentinfo complementary cookie cookies".split())
_INNER = frozenset(("article", "main"))


def leaves_and_tree(html: str) -> tuple[list[tuple[str, bool]], list[tuple[int, str, int]]]:
    """The text leaves of a page as (text, whether a block begins before it), and its nodes in document order as (depth, label, leaf or -1).

    Comments, scripts, styles and the like are no nodes. A label is the tag with its class, id and
    role. Elements that a start tag closes by rule are closed; stray end tags are dropped. White
    space is collapsed. A page may be as deep as it likes.
    """
    leaves: list[tuple[str, bool]] = []
    nodes: list[tuple[int, str, int]] = [(0, "#root", -1)]
    stack: list[str] = []
    block = True
    for m in _TOKEN.finditer(html):
        _, tag, rest, end, text = m.groups()
        if text is not None:
            text = " ".join(entities.unescape(text).split())
            if text:
                nodes.append((len(stack) + 1, "#text", len(leaves)))
                leaves.append((text, block))
                block = False
        elif tag:
            tag = tag.lower()
            if tag in _BLOCK:
                block = True
            if tag in _BLOCK and "p" in stack[-3:] and tag not in ("br", "hr"):
                while stack.pop() != "p":
                    pass
            if shut := _CLOSES.get(tag):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] in shut:
                        del stack[k:]
                        break
                    if stack[k] in _SCOPE:
                        break
            named = ".".join(f"{a[0].lower()}={a[1] or a[2] or a[3]}" for a in _NAME.findall(rest)) if "=" in rest else ""
            nodes.append((len(stack) + 1, f"{tag}.{named}" if named else tag, -1))
            if tag not in _VOID and not rest.endswith("/"):
                stack.append(tag)
        elif end:
            end = end.lower()
            if end in _BLOCK:
                block = True
            if stack and stack[-1] == end:
                stack.pop()
            elif end in stack:
                while stack.pop() != end:
                    pass
    return leaves, nodes


@lru_cache(65536)
def is_region(label: str) -> bool:
    """Whether a label names a region beside the content: nav, footer, aside, menu, or such a class, id or role."""
    tag, _, named = label.partition(".")
    return tag in _REGION_TAGS or bool(named) and tag not in ("html", "body") and not _REGION_NAMES.isdisjoint(re.split(r"[\s.=]+", named.lower()))


def regions(nodes: list[tuple[int, str, int]]) -> list[bool]:
    """For each node whether it is a region that lies in no article and no main part."""
    none = float("inf")
    out, inner = [], none
    for depth, label, _ in nodes:
        if depth <= inner:
            inner = depth if label.partition(".")[0] in _INNER else none
        out.append(inner == none and is_region(label))
    return out


def packed(html: str) -> bytes:
    """The tree of a page in some 2 bytes a node and 8 a leaf and a kind of label.

    The numbers of nodes and of different labels; the 64-bit hash of each label; of each node the number of its label and
    its depth, both in 1, 2 or 4 bytes as they need; whether it is a region, in bits; the 64-bit hashes of the texts.
    """
    leaves, nodes = leaves_and_tree(html)
    number: dict[str, int] = {}
    labels = np.array([number.setdefault(label, len(number)) for _, label, _ in nodes])
    depths = np.array([d for d, _, _ in nodes])
    wide = [np.dtype(np.min_scalar_type(int(x.max()))) for x in (labels, depths)]
    return b"".join(
        [
            np.array([len(nodes), len(number), number.get("#text", -1), wide[0].itemsize, wide[1].itemsize], "<i4").tobytes(),
            np.array([xxhash.xxh3_64_intdigest(x) for x in number], "<u8").tobytes(),
            labels.astype(wide[0]).tobytes(), depths.astype(wide[1]).tobytes(),
            np.packbits(regions(nodes)).tobytes(),
            np.array([xxhash.xxh3_64_intdigest(leaves[k][0]) | 1 for _, _, k in nodes if k >= 0], "<u8").tobytes(),
        ]
    )


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the hash of its label, its depth, whether it is a region, and the hash of its text, 0 if it is no leaf."""
    n, kinds, leaf, a, b = np.frombuffer(raw, "<i4", 5).tolist()
    at = 20
    hashes = np.frombuffer(raw, "<u8", kinds, at)
    at += 8 * kinds
    labels = np.frombuffer(raw, f"<u{a}", n, at)
    at += a * n
    depths = np.frombuffer(raw, f"<u{b}", n, at).astype(np.int64)
    at += b * n
    region = np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
    text = np.zeros(n, np.uint64)
    text[labels == leaf] = np.frombuffer(raw, "<u8", offset=at + (n + 7) // 8)
    return hashes[labels], depths, region, text


class Shapes:
    """Numbers for tree shapes (labels without texts), and the simple tree matching score of any two."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.parts: list[tuple[int, tuple[int, ...], int]] = []
        self.known: dict[tuple[int, int], int] = {}

    def of(self, label: int, kids: tuple[int, ...]) -> int:
        key = (label, kids)
        if key not in self.number:
            self.number[key] = len(self.parts)
            self.parts.append((label, kids, 1 + sum(self.parts[k][2] for k in kids)))
        return self.number[key]

    def score(self, a: int, b: int) -> int:
        """Nodes of the greatest matching of two shapes that keeps order, parents and labels."""
        if a == b:
            return self.parts[a][2]
        if self.parts[a][0] != self.parts[b][0]:
            return 0
        key = (a, b) if a < b else (b, a)
        if key not in self.known:
            x, y = self.parts[a][1], self.parts[b][1]
            lo, hi = trimmed(x, y)
            inner = self.rows(x[lo : len(x) - hi], y[lo : len(y) - hi])[-1][-1] if len(x) > lo + hi and len(y) > lo + hi else 0
            self.known[key] = 1 + int(inner) + sum(self.parts[k][2] for k in x[:lo]) + sum(self.parts[k][2] for k in x[len(x) - hi :])
        return self.known[key]

    def rows(self, x: tuple[int, ...], y: tuple[int, ...], last: bool = True) -> np.ndarray:
        """Scores of the alignments of the prefixes of two child lists; with last only the last row of them."""
        kinds, codes = np.unique(np.array(y), return_inverse=True)
        weights: dict[int, np.ndarray] = {}
        out = np.zeros((1 if last else len(x) + 1, len(y) + 1), np.int64)
        row = np.zeros(len(y) + 1, np.int64)
        for i, a in enumerate(x):
            if a not in weights:
                weights[a] = np.array([self.score(a, int(b)) for b in kinds], np.int64)[codes]
            new = row.copy()
            np.maximum(new[1:], row[:-1] + weights[a], out=new[1:])
            row = np.maximum.accumulate(new)
            if not last:
                out[i + 1] = row
        if last:
            out[0] = row
        return out

    def aligned(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int]]:
        """Index pairs of a best alignment of two child lists, in space that stays small for long lists."""
        lo, hi = trimmed(x, y)
        out = [(i, i) for i in range(lo)] + [(len(x) - k, len(y) - k) for k in range(hi, 0, -1)]
        todo = [(lo, len(x) - hi, lo, len(y) - hi)]
        while todo:
            a0, a1, b0, b1 = todo.pop()
            if a0 >= a1 or b0 >= b1:
                continue
            if a1 - a0 == 1:
                w = [self.score(x[a0], y[j]) for j in range(b0, b1)]
                if max(w) > 0:
                    out.append((a0, b0 + w.index(max(w))))
                continue
            if (a1 - a0 + 1) * (b1 - b0 + 1) > 2_000_000:
                mid = (a0 + a1) // 2
                left = self.rows(x[a0:mid], y[b0:b1])[0]
                right = self.rows(x[mid:a1][::-1], y[b0:b1][::-1])[0][::-1]
                cut = b0 + int(np.argmax(left + right))
                todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
                continue
            m = self.rows(x[a0:a1], y[b0:b1], last=False)
            i, j = a1 - a0, b1 - b0
            while i and j:
                if m[i, j] == m[i - 1, j]:
                    i -= 1
                elif m[i, j] == m[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((a0 + i, b0 + j))
        return sorted(out)


def trimmed(x: tuple, y: tuple) -> tuple[int, int]:
    """Lengths of the equal beginnings and, beyond them, equal ends; some best alignment pairs both."""
    n, lo, hi = min(len(x), len(y)), 0, 0
    while lo < n and x[lo] == y[lo]:
        lo += 1
    while hi < n - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    return lo, hi


class Tree:
    """A packed tree with children, shapes and leaf numbers."""

    def __init__(self, raw: bytes, shapes: Shapes):
        labels, depths, self.region, self.text = (x.tolist() for x in unpacked(raw))
        self.kids: list[list[int]] = [[] for _ in labels]
        path: list[int] = []
        for i, d in enumerate(depths):
            while path and depths[path[-1]] >= d:
                path.pop()
            if path:
                self.kids[path[-1]].append(i)
            path.append(i)
        self.shape = [0] * len(labels)
        for i in range(len(labels) - 1, -1, -1):
            self.shape[i] = shapes.of(labels[i], tuple(self.shape[k] for k in self.kids[i]))
        self.leaf = {i: k for k, i in enumerate(j for j, t in enumerate(self.text) if t)}

    def leaves(self, node: int) -> list[int]:
        """The leaves below a node."""
        out, todo = [], [node]
        while todo:
            i = todo.pop()
            if self.text[i]:
                out.append(self.leaf[i])
            todo += self.kids[i]
        return sorted(out)


def same_leaves(page: Tree, seed: Tree, shapes: Shapes) -> list[tuple[int, int]]:
    """(leaf of page, leaf of seed) with equal texts that simple tree matching pairs; and (leaf of page, -1 - node of seed)
    for all leaves of a region of the page that it pairs with a region of the seed."""
    out, todo = [], [(0, 0)]
    while todo:
        a, b = todo.pop()
        if page.text[a]:
            if page.text[a] == seed.text[b]:
                out.append((page.leaf[a], seed.leaf[b]))
            continue
        x, y = page.kids[a], seed.kids[b]
        if page.region[a] and seed.region[b]:
            out += [(k, -1 - b) for k in page.leaves(a)]
        if x and y:
            pairs = shapes.aligned(tuple(page.shape[k] for k in x), tuple(seed.shape[k] for k in y))
            todo += [(x[i], y[j]) for i, j in pairs]
    return out


def layout(raw: bytes) -> list[int]:
    """Hashes of the paths of labels that a packed tree has down to LAYOUT_DEPTH, without leaves."""
    labels, depths, _, text = unpacked(raw)
    upper = (depths <= LAYOUT_DEPTH) & (text == 0)
    path, out = [0] * (LAYOUT_DEPTH + 2), set()
    for d, label in zip(depths[upper].tolist(), labels[upper].tolist()):
        path[d + 1] = (path[d] * 1_000_003 + label + 1) % 2_147_483_647
        out.add(path[d + 1])
    return sorted(out)


def _pack(batches):
    for batch in batches:
        trees = [packed(h) for h in batch.column("html").to_pylist()]
        paths = [layout(t) for t in trees]
        keys = [xxhash.xxh3_64_intdigest(np.array(p, np.int32).tobytes()) - (1 << 63) for p in paths]
        yield pa.record_batch([batch.column("page_id"), batch.column("rk"), batch.column("host"), pa.array(keys, pa.int64()), pa.array(paths, pa.list_(pa.int32())), pa.array(trees, pa.binary())], names=["page_id", "rk", "host", "layout", "paths", "tree"])


def _clusters(batches):
    """The layouts of a host in order of their first pages: each joins the first one that leads a cluster and is most like it, or leads a new one."""
    for group in grouped(batches, "host"):
        leaders: list[tuple[int, set[int]]] = []
        lead = []
        for key, paths in zip(group.column("layout").to_pylist(), group.column("paths").to_pylist()):
            mine, best, most = set(paths), key, 0.0
            for other, theirs in leaders:
                both = len(mine & theirs)
                if (like := both / (len(mine) + len(theirs) - both)) >= LIKE and like > most:
                    best, most = other, like
            if not most:
                leaders.append((key, mine))
            lead.append(best)
        yield pa.record_batch([group.column("host").combine_chunks().cast(pa.string()), group.column("layout").combine_chunks(), pa.array(lead, pa.int64())], names=["host", "layout", "lead"])


def _match(batches):
    sys.setrecursionlimit(1_000_000)  # as deep as pages go; calls among Python functions take no stack of the machine
    shapes = Shapes()
    seeds = lru_cache(256)(lambda raw: Tree(raw, shapes))
    for batch in batches:
        if len(shapes.parts) + len(shapes.known) > 2_000_000:
            shapes = Shapes()
            seeds = lru_cache(256)(lambda raw, shapes=shapes: Tree(raw, shapes))
        found, at = [], []
        for raw, seed in zip(batch.column("tree").to_pylist(), batch.column("seed").to_pylist()):
            pairs = same_leaves(Tree(raw, shapes), seeds(seed), shapes)
            at.append([a for a, _ in pairs])
            found.append([b for _, b in pairs])
        yield pa.record_batch([batch.column("page_id"), batch.column("rk"), batch.column("host"), pa.array(at, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int32()))], names=["page_id", "rk", "host", "leaf", "same"])


def _mask(batches):
    for batch in batches:
        gone = []
        for leaf, same, fixed in zip(batch.column("leaf"), batch.column("same"), batch.column("fixed")):
            keep = np.isin(np.array(same.values), np.array(fixed.values)) if fixed.is_valid else np.zeros(len(same.values), bool)
            gone.append(np.array(leaf.values)[keep].tolist())
        yield pa.record_batch([batch.column("page_id"), batch.column("rk"), pa.array(gone, pa.list_(pa.int32()))], names=["id", "key", "gone"])


def _extract(batches):
    for batch in batches:
        texts, n, cut = [], [], []
        for page, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist()):
            leaves, _ = leaves_and_tree(page or "")
            drop = set(gone or ())
            out: list[str] = []
            for k, (text, block) in enumerate(leaves):
                if k in drop:
                    continue
                out.append(("\n" if block or k - 1 in drop else " ") * bool(out) + text)
            texts.append("".join(out))
            n.append(len(leaves))
            cut.append(len(drop))
        yield pa.record_batch([batch.column("page_id"), batch.column("host"), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(cut, pa.int32())], names=["page_id", "host", "content", "leaves", "template_leaves"])


def host_of(url) -> F.Column:
    """The host of a URL in lower case; '' if the URL is null or has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, host, content, leaves, template_leaves) for every row of pages.

    The pages of a host are clustered by layout, the paths of labels down to LAYOUT_DEPTH: the page of
    least page_id (rows without page_id last, then by a hash of the page) leads the first cluster, and
    a page that shares less than LIKE of the paths with every leader leads a new one. The leader is
    the seed of its cluster, and every other page of the cluster, below just "the other pages", is
    aligned with it by simple tree matching. A leaf of the seed is
    template if at least CONSTANT of the other pages have its text at the aligned place; a leaf of a
    page is template if it has the text of such a leaf at that place. Where texts vary, the labels of
    aligned nodes tell: a region of the seed (nav, footer, aside, an ad and the like by tag, class, id
    or role, outside of article and main) is template if at least CONSTANT of the other pages have a
    region with text at the aligned place, and all leaves of such a region of a page are template.
    All other leaves are content, whole: constant parts of a leaf whose text varies stay.

    Pages are joined with their seeds in a few bytes a node, so a host with most of the pages is no
    heavier than its share, and Spark can split it. The distinct layouts of a host are clustered in one
    task, in time that grows with the number of layouts times that of clusters.

    A null or empty html gives an empty content, a null url has host ''. A cluster of one page has no
    template. Identical rows count and are extracted each. An empty table gives no rows. Malformed
    markup is read as leaves_and_tree() says. Other columns are not read.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64(F.col("page_id").cast("long"), F.col("url"), F.col("html")).alias("rk"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    trees = slim.where("html is not null and html <> ''").mapInArrow(_pack, "page_id long, rk long, host string, layout long, paths array<int>, tree binary")
    first = F.struct(F.col("page_id").isNull().alias("null"), "page_id", "rk")
    layouts = written(trees.groupBy("host", "layout").agg(F.min(first).alias("first"), F.min_by(F.struct("tree", "paths"), first).alias("s"), F.count("*").alias("n")), "layouts")
    clusters = written(
        layouts.select("host", "layout", "first", F.col("s.paths").alias("paths")).repartition("host").sortWithinPartitions("host", "first").select("host", "layout", "paths")
        .mapInArrow(_clusters, "host string, layout long, lead long"),
        "clusters",
    )
    sizes = clusters.join(layouts.select("host", "layout", "n"), ["host", "layout"]).groupBy("host", "lead").agg(F.sum("n").alias("n")).where("n > 1")
    seeds = clusters.join(sizes.select("host", "lead"), ["host", "lead"]).join(layouts.select("host", F.col("layout").alias("lead"), F.col("s.tree").alias("seed")), ["host", "lead"])
    placed = trees.select("page_id", "rk", "host", "layout", "tree").join(seeds, ["host", "layout"]).select("page_id", "rk", F.concat_ws(" ", "host", F.col("lead")).alias("host"), "tree", "seed")
    matched = written(placed.mapInArrow(_match, "page_id long, rk long, host string, leaf array<int>, same array<int>"), "matched")
    votes = matched.select("host", "rk", F.explode(F.array_distinct("same")).alias("place")).groupBy("host", "place").agg(F.count("*").alias("with"))
    sizes = matched.groupBy("host").agg(F.count("*").alias("n"))
    fixed = votes.join(sizes, "host").where((F.col("with") - 1) >= CONSTANT * (F.col("n") - 1)).groupBy("host").agg(F.collect_list("place").alias("fixed"))
    masks = matched.join(fixed, "host").select("page_id", "rk", "leaf", "same", "fixed").mapInArrow(_mask, "id long, key long, gone array<int>").where(F.size("gone") > 0).dropDuplicates(["id", "key"])
    return (
        slim.join(masks, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("rk") == F.col("key")), "left")
        .select("page_id", "host", "html", "gone")
        .mapInArrow(_extract, "page_id long, host string, content string, leaves int, template_leaves int")
    )
