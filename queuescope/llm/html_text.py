"""Main text of pages by wrapper induction: same-host DOM trees are aligned, constant nodes are template, varying ones content.

A page's skeleton is the tree of its containers; runs of equal siblings fold into one node. Skeletons of a host are aligned
with its most frequent one by simple tree matching. A node whose text is the same on all pages of the host is template, if these
are several pages and not copies or near copies of one article. Of the others, nodes that are mostly links are left out, and
those that are no part of an article by tag, role or class (menus, adverts, comments, ...), unless the host's texts say otherwise:
see :func:`left_out`. What remains are the slots that hold content; each page gives the text blocks of its slots.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from queuescope.llm import simhash
from queuescope.llm.components import components
from queuescope.session import materialize

MIN_PAGES = 3  # different pages a node must be on before equal texts make it template; near copies are one page
LINK_SHARE = 0.5  # a slot whose text is links beyond this share is a menu

# Fixed values of HTML: what has no end tag, what is never shown, what nests other blocks, what starts a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg head title iframe object select textarea".split())
RAW = frozenset("script style textarea title iframe noscript".split())
CONTAINERS = frozenset(
    "html body div section article main nav header footer aside form ul ol dl table menu dialog fieldset figure details".split()
)
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote tr td th thead tbody tfoot caption figcaption address center hr summary legend".split()
)
CLOSES_P = BLOCKS - frozenset("tr td th thead tbody tfoot caption".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"},
              "option": {"option"}}
# What is no part of an article, by tag, role, or a word of the class or id.
LEFT_OUT = frozenset("nav footer aside form menu dialog fieldset button".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "aside widget footer header masthead cookie cookies consent notice notices alert popup modal newsletter subscribe login search "
    "comment comments disqus reply replies discussion share sharing social related recommended pagination pager toolbar skip".split()
)
VARY_BY_NATURE = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo comment comments disqus reply replies".split()
)  # hints at what differs from page to page and is no article all the same
IN_ARTICLE = frozenset(["header"])  # hints that mean something else within article and main: their own head
NEARLY_ALL = 0.9  # share of the text from which on a node is the wrapper of it, whatever its class
BODY_TAGS = frozenset(["article", "main"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"\d+")


def host_of(url: str | None) -> str:
    """Host of a URL in lower case, without port; empty if there is none."""
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


class Page:
    """Container tree and text blocks of a page. ``nodes`` holds (parent, label); ``blocks`` (node, text, link characters)."""

    def __init__(self, source: str):
        self.nodes: list[tuple[int, str]] = [(-1, "root")]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack: list[tuple[str, int]] = [("root", 0)]  # open elements and the container each is in
        self._parts: list[str] = []
        self._link = self._links = 0
        at, end = 0, len(source)
        hidden = 0
        for token in iter(lambda: _TOKEN.search(source, at), None):
            if token.start() > at and not hidden:
                self._text(source[at : token.start()])
            at = token.end()
            name = token[2] or token[5]
            if name is None:
                continue
            name = name.lower()
            if token[1] or token[4]:
                if name in HIDDEN:
                    hidden = max(0, hidden - 1)
                elif not hidden:
                    self._close(name)
                continue
            if name in HIDDEN:
                if (token[3] or token[6] or "").rstrip().endswith("/"):
                    continue
                if name in RAW:
                    stop = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(source, at)
                    at = stop.end() if stop else end
                else:
                    hidden += 1
            elif not hidden or name == "body":  # a head that is never closed ends with the body's start
                hidden = 0
                self._open(name, token[3] or token[6] or "")
        if at < end and not hidden:
            self._text(source[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self._parts.append(text)
        if self._link:
            self._links += len(text)

    def _flush(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.blocks.append((self._stack[-1][1], text, min(self._links, len(text))))
        self._parts.clear()
        self._links = 0

    def _pop(self, to: int) -> None:
        for name, _ in self._stack[to:]:
            self._link -= name == "a"
        del self._stack[to:]

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCKS or name == "br":
            self._flush()
        if name in VOID:
            return
        stops = SAME_LEVEL.get(name)
        if stops or name in CLOSES_P:
            for i in range(len(self._stack) - 1, 0, -1):
                open_ = self._stack[i][0]
                if (stops and open_ in stops) or (name in CLOSES_P and open_ == "p"):
                    self._pop(i)
                    break
                if open_ in CONTAINERS:
                    break
        inside = self._stack[-1][1]
        if name in CONTAINERS:
            self.nodes.append((inside, self._label(name, attributes)))
            inside = len(self.nodes) - 1
        self._stack.append((name, inside))
        self._link += name == "a"

    @staticmethod
    def _label(name: str, attributes: str) -> str:
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        words = re.split(r"[\s_-]+", f"{found.get('class', '')} {found.get('id', '')}".lower())
        words = [_DIGITS.sub("", w) for w in words]
        role = found.get("role", "").lower()
        return ".".join([name, *sorted({w for w in words if re.fullmatch(r"[a-z]+", w)}), *([f"@{role}"] if role else [])])

    def _close(self, name: str) -> None:
        if name in BLOCKS or name == "br":
            self._flush()
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == name:
                self._pop(i)
                return
            if self._stack[i][0] in CONTAINERS and name not in CONTAINERS:
                return

    def skeleton(self) -> tuple[str, list[int]]:
        """The folded container tree as text, and the folded node (in reading order) of each container."""
        children = defaultdict(list)
        for i, (parent, _) in enumerate(self.nodes):
            children[parent].append(i)
        texts: dict[int, str] = {}
        groups: dict[int, list[list[int]]] = {}
        for i in range(len(self.nodes) - 1, -1, -1):  # children come after their parent
            folded: list[list[int]] = []
            for child in children[i]:
                if folded and texts[folded[-1][0]] == texts[child]:
                    folded[-1].append(child)
                else:
                    folded.append([child])
            groups[i] = folded
            texts[i] = f"{self.nodes[i][1]}({' '.join(texts[g[0]] for g in folded)})"
        place = [0] * len(self.nodes)
        number = 0
        todo = [[0]]
        while todo:  # depth first; the members of a fold share their places, position by position
            members = todo.pop()
            for m in members:
                place[m] = number
            number += 1
            for position in range(len(groups[members[0]]) - 1, -1, -1):
                todo.append([c for m in members for c in groups[m][position]])
        return texts[0], place


@lru_cache(maxsize=4096)
def parse_skeleton(text: str) -> tuple[tuple[str, int, tuple[int, ...]], ...]:
    """(label, parent, children) of each node of a skeleton's text, in reading order."""
    labels, parents, children, stack = [], [], [], []
    for label, sign in re.findall(r"([^() ]+)?([()])", text):
        if sign == "(":
            if stack:
                children[stack[-1]].append(len(labels))
            parents.append(stack[-1] if stack else -1)
            stack.append(len(labels))
            labels.append(label)
            children.append([])
        else:
            stack.pop()
    return tuple(zip(labels, parents, map(tuple, children)))


def match_trees(left: str, right: str) -> list[int]:
    """Simple tree matching: for each node of ``right`` the node of ``left`` it is aligned with, or -1.

    Roots match if their labels are equal; children match in order, so that as many nodes as possible are matched.
    """
    a, b = parse_skeleton(left), parse_skeleton(right)
    sizes: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    # Children have larger numbers than their parents, so going backwards every pair finds its children's pairs done.
    by_label = defaultdict(list)
    for i, (label, _, _) in enumerate(a):
        by_label[label].append(i)
    for j in range(len(b) - 1, -1, -1):
        label, _, kids_b = b[j]
        for i in by_label.get(label, ()):
            kids_a = a[i][2]
            best = [[0] * (len(kids_b) + 1) for _ in range(len(kids_a) + 1)]
            for x, p in enumerate(kids_a, 1):
                for y, q in enumerate(kids_b, 1):
                    inner = sizes.get((p, q))
                    best[x][y] = max(best[x - 1][y], best[x][y - 1], best[x - 1][y - 1] + (inner[0] if inner else 0))
            pairs, x, y = [], len(kids_a), len(kids_b)
            while x and y:
                if best[x][y] == best[x - 1][y]:
                    x -= 1
                elif best[x][y] == best[x][y - 1]:
                    y -= 1
                else:
                    x, y = x - 1, y - 1
                    pairs.append((kids_a[x], kids_b[y]))
            sizes[i, j] = (best[-1][-1] + 1, pairs)
    matched = [-1] * len(b)
    todo = [(0, 0)] if (0, 0) in sizes else []
    while todo:
        i, j = todo.pop()
        matched[j] = i
        todo += sizes[i, j][1]
    return matched


def left_out(skeleton: str, text: Sequence[float] = (), varies: Sequence[bool] = ()) -> list[bool]:
    """For each node whether it, or a node around it, is no part of an article by its tag, role or class.

    ``text`` holds the varying text of each node on its host, in characters a page and without links; ``varies`` whether its
    texts are known to differ. A mark does not count on a node around an article (or main) with half the text of the largest
    or more, or on one with most of the text of the article, main or, without these, the page. Within an article a word of
    the class or id does not count if the text varies. What varies by nature, like comments, is kept only if it is nearly all.
    """
    nodes = parse_skeleton(skeleton)
    tags = [label.split(".")[0] for label, _, _ in nodes]
    words = [set(label.split(".")[1:]) for label, _, _ in nodes]
    inside = list(text) or [0.0] * len(nodes)
    differs = list(varies) or [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parent
        inside[nodes[i][1]] += inside[i]
        differs[nodes[i][1]] |= differs[i]
    foreign, in_body, around = [], [], []
    for i, (_, parent, _) in enumerate(nodes):
        own = bool(words[i] & VARY_BY_NATURE) and inside[i] <= NEARLY_ALL * inside[0]
        foreign.append(own or (parent >= 0 and foreign[parent]))
        in_body.append(tags[i] in BODY_TAGS or (parent >= 0 and in_body[parent]))
    for tag in ("article", "main"):
        around = around or [i for i in range(len(nodes)) if tags[i] == tag and not foreign[i]]
    most = max((inside[i] for i in around), default=0.0)
    bodies = {i for i in around if 2 * inside[i] >= most}
    holds = set()
    for i in bodies:
        while i >= 0:
            holds.add(i)
            i = nodes[i][1]
    out, scope = [], []  # scope: the article or main around a node, or the page if it has none
    for i, (_, parent, _) in enumerate(nodes):
        scope.append(i if i in bodies else scope[parent] if parent >= 0 else -1 if bodies else 0)
        by_tag = tags[i] in LEFT_OUT or (tags[i] == "header" and not in_body[i])
        by_role = any(w[:1] == "@" and w[1:] in ROLES for w in words[i])
        hints = words[i] & HINTS - (IN_ARTICLE if in_body[i] else frozenset())
        if tags[i] in ("html", "body", "root", "article", "main"):  # a class of the whole page says nothing
            by_tag = by_role = hints = False
        if scope[i] >= 0 and tags[scope[i]] == "article" and differs[i] and not words[i] & VARY_BY_NATURE:
            hints = False
        heavy = scope[i] >= 0 and 2 * inside[i] > inside[scope[i]]
        if words[i] & VARY_BY_NATURE:
            heavy = heavy and inside[i] > NEARLY_ALL * inside[scope[i]]
        bad = bool(by_tag or by_role or hints) and i not in holds and not heavy
        out.append(bad or (parent >= 0 and out[parent]))
    return out


def candidates(skeleton: str, text: Sequence[float] = (), varies: Sequence[bool] = ()) -> tuple[list[int], bool]:
    """Nodes that may be part of an article, and whether they are the ones inside article and main tags."""
    nodes = parse_skeleton(skeleton)
    out = left_out(skeleton, text, varies)
    in_body = []
    for label, parent, _ in nodes:
        in_body.append(label.split(".")[0] in BODY_TAGS or (parent >= 0 and in_body[parent]))
    may = [i for i in range(len(nodes)) if not out[i]]
    if any(in_body[i] for i in may):
        return [i for i in may if in_body[i]], True
    return may, False


def _varying(marked: Sequence[bool], text: Sequence[float]) -> list[float]:
    """The text of the nodes that are not marked as constant; of all, if there is no other text."""
    rest = [0.0 if m else t for m, t in zip(marked, text)]
    return rest if any(rest) else list(text)


def slots(skeleton: str, template: Sequence[bool], text: Sequence[float] = (), varies: Sequence[bool] = ()) -> list[int]:
    """Nodes whose blocks are content, given which nodes are template.

    If nothing is left, all nodes that may be part of an article are taken: copies of one page have no varying node.
    """
    may, _ = candidates(skeleton, _varying(template, text), varies)
    return [i for i in may if not template[i]] or may


def telling(skeleton: str, constant: Sequence[bool], text: Sequence[float] = (), varies: Sequence[bool] = ()) -> list[int]:
    """Nodes whose text tells pages apart: the article with all its parts, or else what varies on the host."""
    may, marked = candidates(skeleton, _varying(constant, text), varies)
    return may if marked else [i for i in may if not constant[i]] or may


_PARTIAL = "host string, skeleton string, node int, pages long, low long, high long, chars long, links long"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host, skeleton and node: pages, smallest and largest text hash, characters, link characters; summed per batch."""
    for batch in batches:
        rows: dict[tuple[str, str, int], list[int]] = {}
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page(source or "")
            skeleton, place = page.skeleton()
            host = host_of(url)
            texts: dict[int, list[str]] = defaultdict(list)
            links: dict[int, int] = defaultdict(int)
            for node, text, linked in page.blocks:
                texts[place[node]].append(text)
                links[place[node]] += linked
            for node in set(place):
                joined = "\n".join(texts[node])
                digest = _signed(xxhash.xxh64_intdigest(joined))
                row = rows.get((host, skeleton, node))
                if row is None:
                    rows[host, skeleton, node] = [1, digest, digest, len(joined), links[node]]
                else:
                    row[0] += 1
                    row[1], row[2] = min(row[1], digest), max(row[2], digest)
                    row[3] += len(joined)
                    row[4] += links[node]
        keys, values = list(zip(*rows)) or [()] * 3, list(zip(*rows.values())) or [()] * 5
        names = ["host", "skeleton", "node", "pages", "low", "high", "chars", "links"]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5]
        yield pa.record_batch({n: pa.array(c, type=t) for n, c, t in zip(names, [*keys, *values], kinds)})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _aligned(references: pd.Series, skeletons: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], list[int]] = {}
    for pair in set(zip(references, skeletons)):
        known[pair] = match_trees(*pair)
    return pd.Series([known[pair] for pair in zip(references, skeletons)], dtype=object)


def _chosen(choose, *columns: pd.Series) -> pd.Series:
    return pd.Series([list(choose(*row)) for row in zip(*columns)], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _slots(skeletons: pd.Series, templates: pd.Series, texts: pd.Series, varies: pd.Series) -> pd.Series:
    return _chosen(slots, skeletons, templates, texts, varies)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _telling(skeletons: pd.Series, constants: pd.Series, texts: pd.Series, varies: pd.Series) -> pd.Series:
    return _chosen(telling, skeletons, constants, texts, varies)


def _per_skeleton(judged: DataFrame, marked: Column, choose, out: str) -> DataFrame:
    """(host, skeleton, out): the nodes ``choose`` takes, given which are marked and the texts of all, in reading order."""
    menu = F.col("all_links") > LINK_SHARE * F.col("all_chars")
    text = F.when(menu, 0.0).otherwise((F.col("all_chars") - F.col("all_links")) / F.col("all_pages"))
    facts = F.struct(
        "node", F.coalesce(marked, F.lit(False)).alias("marked"), text.alias("text"), (~F.col("constant") & ~menu).alias("varies")
    )
    rows = judged.groupBy("host", "skeleton").agg(F.sort_array(F.collect_list(facts)).alias("facts"))
    return rows.select("host", "skeleton", choose("skeleton", *[f"facts.{c}" for c in ("marked", "text", "varies")]).alias(out))


_BLOCKS = "page_id long, url string, host string, skeleton string, blocks array<struct<node int, text string>>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        hosts, skeletons, blocks = [], [], []
        for url, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            page = Page(source or "")
            skeleton, place = page.skeleton()
            hosts.append(host_of(url))
            skeletons.append(skeleton)
            blocks.append([{"node": place[node], "text": text} for node, text, _ in page.blocks])
        yield pa.record_batch({
            "page_id": batch.column(0).cast(pa.int64()), "url": batch.column(1), "host": hosts,
            "skeleton": pa.array(skeletons, type=pa.string()), "blocks": pa.array(blocks, type=kind),
        })


def _text_of(nodes: str) -> Column:
    """Text of the blocks whose node is in the given array column."""
    return F.array_join(
        F.transform(F.filter("blocks", lambda b: F.array_contains(nodes, b["node"])), lambda b: b["text"]), "\n"
    )


def _different(pages: DataFrame, judged: DataFrame) -> DataFrame:
    """(host, own, at, different) for every judged node: on how many different pages it is, counted up to MIN_PAGES or more.

    Copies and near copies, by the fingerprint of the text that tells pages apart, are one page.
    """
    same = F.col("constant") & (F.col("all_pages") >= MIN_PAGES)
    known = materialize(_per_skeleton(judged, same, _telling, "telling"))
    parsed = pages.select(F.lit(0).cast("long").alias("page_id"), "url", "html").mapInArrow(_blocks, _BLOCKS)
    prints = materialize(
        parsed.join(known, ["host", "skeleton"])
        .select("host", "skeleton", simhash.fingerprint_column(_text_of("telling")).alias("fp"))
        .distinct()
    )
    roots = components(simhash.links(materialize(prints.select("fp").distinct())))
    kinds = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "host", "skeleton", F.coalesce("root", "fp").alias("kind")
    ).distinct()
    place = F.row_number().over(W.partitionBy("host", "skeleton").orderBy("kind"))
    few = kinds.withColumn("place", place).where(F.col("place") <= MIN_PAGES)  # enough to see whether there are so many
    return few.join(judged.select("host", "skeleton", "own", "at").distinct(), ["host", "skeleton"]).groupBy(
        "host", "own", "at"
    ).agg(F.count_distinct("kind").alias("different"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, skeleton, slots) for every host and skeleton of ``pages``, from statistics over all pages."""
    pages = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    nodes = materialize(
        pages.mapInArrow(_statistics, _PARTIAL)
        .groupBy("host", "skeleton", "node")
        .agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "links")], F.min("low").alias("low"), F.max("high").alias("high"))
    )
    shapes = nodes.where("node = 0").select("host", "skeleton", "pages")
    reference = shapes.groupBy("host").agg(F.max_by("skeleton", F.struct("pages", "skeleton")).alias("reference"))
    aligned = shapes.join(reference, "host").withColumn("match", _aligned("reference", "skeleton"))
    aligned = materialize(aligned.select("host", "skeleton", F.posexplode("match").alias("node", "matched")))
    joined = nodes.join(aligned, ["host", "skeleton", "node"])
    # A node without a counterpart in the reference is judged on the pages of its own skeleton.
    place = F.when(F.col("matched") >= 0, F.lit("")).otherwise(F.col("skeleton")).alias("own")
    key = F.when(F.col("matched") >= 0, F.col("matched")).otherwise(F.col("node")).alias("at")
    placed = joined.select("*", place, key)
    judged = placed.groupBy("host", "own", "at").agg(
        *[F.sum(c).alias(f"all_{c}") for c in ("pages", "chars", "links")],
        (F.min("low") == F.max("high")).alias("constant"),
    )
    judged = materialize(placed.join(judged, ["host", "own", "at"]))
    template = (F.col("constant") & (F.col("different") >= MIN_PAGES)) | (
        F.col("all_links") > LINK_SHARE * F.col("all_chars")
    )
    return _per_skeleton(judged.join(_different(pages, judged), ["host", "own", "at"]), template, _slots, "slots")


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars.

    Null and empty html give an empty text. Pages without a host share one. Repeated rows give repeated results; a host whose
    pages are all copies of one page keeps that page's article. Only page_id, url and html are read.
    """
    found = materialize(wrappers(pages))
    parsed = pages.select(
        "page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).mapInArrow(_blocks, _BLOCKS)
    return parsed.join(found, ["host", "skeleton"], "left").select(
        "page_id", "url", F.coalesce(_text_of("slots"), F.lit("")).alias("text")
    ).withColumn("n_chars", F.length("text").cast("long"))
