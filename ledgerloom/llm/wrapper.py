"""Main text of pages by wrapper induction.

Pages of a host and a layout share a template; a layout is known by the classes of its
larger elements. A few pages of every layout serve as its samples; each page is aligned
with them by simple tree matching, which maps nodes of two DOM trees onto each other in
order, level by level. A block whose text stands in the matched place of the samples is
constant, so part of the template; what varies is content. Elements that never hold an
article (menus, headers, footers, forms, scripts, comments and the like) are left out by
name and by class. Where that would leave nothing of a page, the outermost forms and
classes around it are not taken for marks. Trees of any depth are worked on in loops.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.common import written

# Samples of a layout: its pages with the least hashes.
SAMPLES = 5
# Elements whose classes tell layouts apart.
LAYOUT = r"""(?i)<(?:div|section|main|article|nav|header|footer|aside|form)\b[^>]*?\bclass\s*=\s*["']?([\w\x20-]+)"""

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select option button iframe svg canvas audio video title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag of these ends an open p; li, dt, dd, tr, td, th and option end one of their own kind.
CLOSES_P = BLOCKS - frozenset("body html caption li dd dt legend summary tbody td tfoot th thead tr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"},
}
SCOPES = frozenset("ul ol dl table td th div section article aside nav body html form blockquote".split())

#: Elements and words of class or id that mark what is no part of an article.
BOILERPLATE = frozenset("nav header footer aside form menu dialog search address".split()) | RAW
MARKS = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|widget\w*|footer\w*|"
    r"(?:site|page|top)[_-]?header|masthead|topbar|cookies?\w*|consent|gdpr|notices?|newsletter|subscri\w*|sign-?up|login|popup\w*|modal\w*|overlay|"
    r"comments?|disqus|replies|respond|share\w*|sharing|social\w*|related\w*|recommend\w*|pagination|pager|toolbar|copyright)(?:$|[_-])",
    re.I,
)
#: Classes that only say that a page has such a part.
ABOUT = re.compile(r"^(?:has|with|without|no|hide|show)[_-]", re.I)
OF_ARTICLES = re.compile(r"(?:^|[_-])(?:comments?|replies|related\w*|recommend\w*|promo\w*|ads?|advert\w*|sponsor\w*|teasers?)(?:$|[_-])", re.I)
PLAIN = frozenset("div section p ul ol dl table tbody tr td blockquote span main article".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SPACE = re.compile(r"\s+")


#: Marks that hold nothing but what they say, however much of it there is.
NEVER = re.compile(r"(?:^|[_-])(?:comments?|disqus|replies|respond|cookies?\w*|consent|gdpr|popup\w*|modal\w*|overlay|breadcrumbs?)(?:$|[_-])", re.I)


class Node:
    __slots__ = ("tag", "mark", "soft", "children", "text", "parent", "key")

    def __init__(self, tag: str, mark: bool = False, parent: Node | None = None, soft: bool = False):
        self.tag, self.mark, self.parent, self.soft = tag, mark, parent, soft
        self.children: list[Node] = []
        self.text, self.key = "", None


class _Builder(HTMLParser):
    """A tree of block elements; a run of inline content becomes a #text leaf of the block it stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")
        self.words: list[str] = []
        self.skip: list[str] = []
        # How many elements of a name are open.
        self.open: Counter = Counter()

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.words)).strip()
        self.words = []
        if text:
            leaf = Node("#text", False, self.at)
            leaf.text = text
            self.at.children.append(leaf)

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.append(tag)
            return
        if tag in RAW:
            if tag in BLOCKS:
                self.flush()
            self.skip.append(tag)
            return
        if tag == "br":
            self.words.append(" ")
            return
        if tag in VOID and tag != "hr":
            return
        if tag in BLOCKS or self._marked(tag, attrs):
            self.flush()
            if tag in CLOSES_P:
                self._close({"p"})
            if tag in CLOSES:
                self._close(CLOSES[tag])
            if tag == "hr" or tag in ("html", "body"):
                return
            marked = self._marked(tag, attrs)
            mark = tag in BOILERPLATE or marked
            node = Node(tag, mark, self.at, mark and tag in ("form", *PLAIN) and not self._never(attrs))
            self.at.children.append(node)
            self.at = node
            self.open[tag] += 1

    def _never(self, attrs) -> bool:
        """Whether a mark is more than a form or a class."""
        for name, value in attrs:
            if name in ("hidden", "role", "aria-hidden") or name == "style" and HIDDEN.search(value or ""):
                return True
            if name in ("class", "id") and any(NEVER.search(token) for token in (value or "").split()):
                return True
        return False

    def _leave(self, node: Node) -> None:
        """Close the elements from the open one up to ``node``."""
        at = self.at
        while at is not node.parent:
            self.open[at.tag] -= 1
            at = at.parent
        self.at = at

    def _marked(self, tag, attrs) -> bool:
        if tag in ("body", "html"):
            return False
        marks = OF_ARTICLES if tag in ("article", "main") else MARKS
        for name, value in attrs:
            if name == "hidden":
                return True
            if name in ("class", "id") and any(marks.search(token) and not ABOUT.match(token) for token in (value or "").split()):
                return True
            if name == "role" and value in ROLES or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and HIDDEN.search(value or ""):
                return True
        return False

    def _close(self, tags: set[str]) -> None:
        stops = SCOPES | tags
        while True:
            node = self.at
            while node.parent is not None and node.tag not in stops:
                node = node.parent
            if node.tag not in tags or node.parent is None:
                return
            self._leave(node)
            if self.at.tag not in tags:
                return

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            elif tag in ("body", "html") and self.skip[-1] not in ("script", "style"):
                self.skip = []
            return
        if self.open[tag]:
            node = self.at
            while node.tag != tag:
                node = node.parent
            self.flush()
            self._leave(node)
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    # What the parser still holds is an unfinished tag or plain text.
    if builder.rawdata and not builder.skip and not builder.rawdata.startswith("<"):
        builder.handle_data(unescape(builder.rawdata))
    builder.flush()
    return builder.root


def _key(node: Node) -> int:
    """Hash of the whole subtree, for the equality of subtrees."""
    if node.key is None:
        order, stack = [], [node]
        while stack:
            at = stack.pop()
            order.append(at)
            stack += [c for c in at.children if c.key is None]
        for at in reversed(order):
            at.key = hash((at.tag, at.text, tuple([c.key for c in at.children])))
    return node.key


def _middle(a: Node, b: Node) -> tuple[int, int]:
    """How many children at the begin and at the end are equal, one by one."""
    x, y = a.children, b.children
    lo, hi, least = 0, 0, min(len(x), len(y))
    while lo < least and _key(x[lo]) == _key(y[lo]):
        lo += 1
    while hi < least - lo and _key(x[-1 - hi]) == _key(y[-1 - hi]):
        hi += 1
    return lo, hi


class Matching:
    """Simple tree matching of two trees: the weight of every pair of nodes that may be mapped onto each other.

    The weight is the number of nodes mapped below and at the pair, leaves of equal text
    double. Pairs are found from the roots down and worked out from the leaves up.
    """

    def __init__(self, a: Node, b: Node):
        self.known: dict[tuple[int, int], int] = {}
        todo, seen = [(a, b)], {(id(a), id(b))}
        for x, y in todo:
            lo, hi = _middle(x, y)
            below = y.children[lo : len(y.children) - hi]
            for c in x.children[lo : len(x.children) - hi]:
                for d in below:
                    if c.tag == d.tag and c.children and d.children and (id(c), id(d)) not in seen:
                        seen.add((id(c), id(d)))
                        todo.append((c, d))
        for x, y in reversed(todo):
            self.known[id(x), id(y)] = 1 + sum(w for _, _, w in self.pairs(x, y))

    def weight(self, a: Node, b: Node) -> int:
        if a.tag != b.tag:
            return 0
        if not a.children or not b.children:
            return 1 + (a.text == b.text and a.tag == "#text")
        return self.known[id(a), id(b)]

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node, int]]:
        """The children mapped onto each other, in order, so that the most nodes are mapped; equal ends first."""
        lo, hi = _middle(a, b)
        x, y = a.children, b.children
        found = [(c, d, 1) for c, d in zip(x[:lo], y[:lo])] + [(c, d, 1) for c, d in zip(x[len(x) - hi :], y[len(y) - hi :])]
        x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
        weights = [[self.weight(c, d) for d in y] for c in x]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            row, below, own = best[i], best[i + 1], weights[i]
            for j in range(len(y) - 1, -1, -1):
                value = below[j] if below[j] >= row[j + 1] else row[j + 1]
                if own[j] and below[j + 1] + own[j] > value:
                    value = below[j + 1] + own[j]
                row[j] = value
        i = j = 0
        while i < len(x) and j < len(y):
            if best[i][j] == best[i + 1][j]:
                i += 1
            elif best[i][j] == best[i][j + 1]:
                j += 1
            else:
                found.append((x[i], y[j], weights[i][j]))
                i, j = i + 1, j + 1
        return found


def constant_leaves(page: Node, sample: Node) -> set[int]:
    """Text leaves of the page that are mapped onto leaves of the sample with the same text."""
    matching = Matching(page, sample)
    found: set[int] = set()
    todo = [(page, sample)]
    while todo:
        a, b = todo.pop()
        if _key(a) == _key(b):
            found.update(id(leaf) for leaf in leaves(a))
        elif a.tag == b.tag:
            todo += [(c, d) for c, d, _ in matching.pairs(a, b)]
    return found


def leaves(node: Node) -> list[Node]:
    found, stack = [], [node]
    while stack:
        at = stack.pop()
        if at.tag == "#text":
            found.append(at)
        stack += reversed(at.children)
    return found


def blocks(page: Node) -> list[Node]:
    """Text leaves outside boilerplate, in order; only those of articles if the page marks articles.

    An article inside boilerplate counts if there is no other: the boilerplate around
    it was not closed then. A page that is empty so is looked at again without the
    outermost of its forms and marked classes, as often as there are such.
    """
    while True:
        found = _unmarked(page)
        if found or not _lift(page):
            return found


def _lift(page: Node) -> bool:
    """Take the mark from the outermost elements that are marked as a form or by class only; whether there were any."""
    lifted, stack = False, [page]
    while stack:
        node = stack.pop()
        if node.mark and node.soft:
            node.mark, lifted = False, True
        elif not node.mark:
            stack += node.children
    return lifted


def _unmarked(page: Node) -> list[Node]:
    articles, open_marks, stack = [], set(), [(page, False)]
    while stack:
        node, marked = stack.pop()
        marked = marked or node.mark
        if node.tag in ("article", "main") and not node.mark:
            articles.append((node, marked))
        stack += [(c, marked) for c in reversed(node.children)]
    if articles and all(marked for _, marked in articles):
        node = articles[0][0]
        while node is not None:
            open_marks.add(id(node))
            node = node.parent
    found, stack = [], [(page, not articles)]
    while stack:
        node, inside = stack.pop()
        if node.mark and id(node) not in open_marks:
            continue
        inside = inside or node.tag in ("article", "main")
        if node.tag == "#text" and inside:
            found.append(node)
        stack += [(c, inside) for c in reversed(node.children)]
    return found


class Sample:
    def __init__(self, html: str):
        self.tree = parse(html)
        self.texts = {leaf.text for leaf in leaves(self.tree)}


def main_text(page: Node, samples: list[Sample]) -> tuple[str, int]:
    """(text, number of blocks left out as template).

    A block is template if it is constant with every sample that is not the same page,
    two or more of them; of four or more, one may differ. Trees without a common text
    have no constant leaf and need no alignment.
    """
    own = blocks(page)
    others = [s for s in samples if _key(s.tree) != _key(page)]
    needed = len(others) - (len(others) >= 4)
    votes = {id(n): 0 for n in own} if needed > 1 else {}
    for sample in others:
        if any(n.text in sample.texts for n in own) and votes:
            for leaf in constant_leaves(page, sample.tree):
                if leaf in votes:
                    votes[leaf] += 1
    constant = {leaf for leaf, n in votes.items() if n >= needed}
    kept = [n.text for n in own if id(n) not in constant]
    return "\n\n".join(kept), len(own) - len(kept)


def host(url: Column) -> Column:
    """The host of an address in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", samples: int = SAMPLES) -> DataFrame:
    """(key, url, text, n_chars, n_template): the main text of every page.

    Null html counts as empty and gives an empty text; pages without a host are a host
    of their own. The samples of a host's layout are those of its pages whose html has the
    least hashes, distinct ones. Layouts of more pages than an average task are dealt into
    shards, and the samples go along with every shard. Repeated rows are pages of their own; an empty
    table gives an empty result; other columns are left out.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    layout = F.xxhash64(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(LAYOUT), F.lit(1)))))
    rows = rows.withColumn("host", F.concat(host(F.col("url")), F.lit(" "), layout.cast("string"))).withColumn("h", F.xxhash64("html"))
    # Least hashes of every host: from every task the least ones only, then of those.
    counts = rows.groupBy("host").agg(F.count("*").alias("n"))
    salted = rows.filter("html <> ''").select("host", "h", F.pmod("h", F.lit(64)).alias("salt")).distinct()
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("host", "salt").orderBy("h"))).filter(F.col("r") <= samples)
    chosen = first.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy("h"))).filter(F.col("r") <= samples)
    chosen = written(chosen.select("host", "h"), "samples")
    sample_pages = rows.join(chosen, ["host", "h"], "left_semi").dropDuplicates(["host", "h"]).select("host", "h", "html")
    # Hosts with more pages than an average shuffle partition are split: fewer hosts than partitions.
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = written(counts, "hosts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    split = F.broadcast(counts.filter(F.col("n") * partitions > total).select("host", F.ceil(F.col("n") * partitions / F.lit(max(total, 1))).cast("int").alias("shards")))
    sharded = lambda df: df.join(split, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    along = sharded(sample_pages).select("host", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "html")
    dealt = sharded(rows).withColumn("shard", F.pmod(F.xxhash64("key", "h"), F.col("shards")).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    kind = pages.schema[key].dataType.simpleString()
    along = along.select("host", "shard", F.lit(0).alias("side"), none(kind).alias("key"), none("string").alias("url"), "html")
    every = along.unionByName(dealt.select("host", "shard", F.lit(1).alias("side"), "key", "url", "html"))
    ordered = every.repartition("host", "shard").sortWithinPartitions("host", "shard", "side")

    def run(batches):
        now, trees = None, []
        for batch in batches:
            out = []
            for name, shard, side, page, address, source in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if now != (name, shard):
                    now, trees = (name, shard), []
                if side == 0:
                    trees.append(Sample(source))
                    continue
                text, template = main_text(parse(source), trees)
                out.append((page, address, text, len(text), template))
            if out:
                columns = list(zip(*out))
                kinds = (batch.schema.field(3).type, pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[key, "url", "text", "n_chars", "n_template"])

    return ordered.mapInArrow(run, f"`{key}` {kind}, url string, text string, n_chars bigint, n_template bigint")
