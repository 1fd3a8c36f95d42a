"""Main-text extraction with site template removal (operator 7).

Pages are parsed into element trees.  Every container subtree with text is
hashed; Spark counts, per host, the distinct pages a subtree occurs on, and
subtrees that recur on ``min_pages`` pages of the host, however many it has,
are deleted.  Menus, headers, footers, sidebars,
notices, adverts, forms, comments and the like are also recognised by tag,
role, class and id, so a page alone on its host loses them too.  What is
left of the article (else of ``main``, else of the body) is the text: one
line a block, white space folded, character references decoded.

Copies of a page count once, plain paragraphs inside an article are content
however often they recur, and a subtree that holds the article is never
template.  A page counts for a subtree that is at most half of its text; a
template found so also goes on pages where it is more.  Null or empty html gives empty text; a
null url has the empty host.  Rows keep their multiplicity; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import scratch_path

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
             "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_DROP = set("head script style template nav aside footer form button select option textarea input iframe menu title noembed noframes".split())
#: dropped around the article, kept in it
_DROP_OUTSIDE = set("noscript label fieldset object svg canvas math audio video map dialog datalist xmp".split())
_PLAIN = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th figure figcaption b i em strong a span code sub sup small u q cite abbr time br".split())
# elements whose start ends an open one, up to the named containers
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
           "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
_P_SCOPE = {"table", "td", "th", "caption", "object", "button", "html", "body", "article", "section", "div", "li", "blockquote"}
_WORDS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification popup "
             "modal sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments disqus reply replies respond".split())
# names of reader comments, dropped even where they hold articles or headings of their own
_COMMENTS = re.compile(r"(?:^|\s)(?:user-?|reader-?)?(?:comments?(?:-?(?:list|section|area|thread|wrapper|block|container))?|disqus\S*|repl(?:y|ies)(?:-\S*)?|respond)(?=\s|$)", re.I)
_OUTSIDE_ARTICLE = set("header footer top bottom copyright legal overlay newsletter subscribe subscription signup share sharing social related recommended widget masthead toolbar "
                       "skip paywall login".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "hash", "size", "holds_main")

    def __init__(self, tag: str, attrs: str, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.hash, self.size, self.holds_main = b"", 0, False


#: scopes that a start tag asks: tags counted, and tags inside which counting begins anew
_SCOPES = {"p": ({"p"}, _P_SCOPE), **_CLOSES}
_AFFECTS = {tag: [(name, tag in stop, tag in ends) for name, (ends, stop) in _SCOPES.items() if tag in stop or tag in ends]
            for tag in set().union(*(ends | stop for ends, stop in _SCOPES.values()))}
_OUTER = ("article", "main", "body", "html")


class _Open:
    """Open elements of a page.  Counts per scope tell whether a tag ends anything, so a stray tag costs
    nothing, and elements are only walked over to be closed."""

    def __init__(self, root: Node):
        self.path = [root]
        self.counts: dict[str, list[int]] = {name: [0] for name in _SCOPES}
        self.total: dict[str, int] = {}
        self.in_block: list[dict[str, int]] = [{}]  # inline elements since the last block
        self.in_article: list[dict[str, int]] = [{}]  # elements since the last article or main

    def push(self, node: Node) -> None:
        tag = node.tag
        self.path.append(node)
        for name, stop, ends in _AFFECTS.get(tag, ()):
            if ends:
                self.counts[name][-1] += 1
            if stop:
                self.counts[name].append(0)
        self.total[tag] = self.total.get(tag, 0) + 1
        self.in_article[-1][tag] = self.in_article[-1].get(tag, 0) + 1
        if tag in ("article", "main"):
            self.in_article.append({})
        if tag in _BLOCK:
            self.in_block.append({})
        else:
            self.in_block[-1][tag] = self.in_block[-1].get(tag, 0) + 1

    def pop(self) -> Node:
        node = self.path.pop()
        tag = node.tag
        for name, stop, ends in _AFFECTS.get(tag, ()):
            if stop:
                self.counts[name].pop()
            if ends:
                self.counts[name][-1] -= 1
        self.total[tag] -= 1
        if tag in ("article", "main"):
            self.in_article.pop()
        self.in_article[-1][tag] -= 1
        if tag in _BLOCK:
            self.in_block.pop()
        else:
            self.in_block[-1][tag] -= 1
        return node

    def end_tag(self, tag: str) -> None:
        """An inline end tag does not close a block, and only its own end closes an article."""
        seen = self.total if tag in _OUTER else self.in_article[-1] if tag in _BLOCK else self.in_block[-1]
        if seen.get(tag):
            while self.pop().tag != tag:
                pass

    def start_tag(self, name: str, outermost: bool) -> None:
        """Close what the start of an element of this scope ends."""
        if self.counts[name][-1]:
            left = 0 if outermost else self.counts[name][-1] - 1
            while self.counts[name][-1] > left:
                self.pop()


def parse(page: str) -> Node:
    """Element tree of a page; unclosed and stray tags are mended as browsers mostly do."""
    root = Node("#root", "", None)
    opened = _Open(root)
    pos, n, low, last = 0, len(page), None, page.rfind(">")
    while pos < n:
        cur = opened.path[-1]
        lt = page.find("<", pos)
        if lt < 0:
            cur.children.append(page[pos:])
            break
        if lt > pos:
            cur.children.append(page[pos:lt])
        m = None if lt > last and page[lt + 1:lt + 2].isalpha() else _TAG.match(page, lt)  # without a ">" to come no tag ends
        if not m:
            cur.children.append("<")
            pos = lt + 1
            continue
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, attrs, closing = name.lower(), m[3] or m[6] or "", bool(m[1] or m[4])
        if closing:
            opened.end_tag(tag)
            continue
        if tag in _BLOCK:
            opened.start_tag("p", False)
        if tag in _CLOSES:
            opened.start_tag(tag, True)
        cur = opened.path[-1]
        child = Node(tag, attrs, cur)
        cur.children.append(child)
        if tag in _VOID:
            continue
        if tag in _RAW:
            if low is None:
                low = page.lower() if len(page.lower()) == n else page
            end = low.find("</" + tag, pos)
            child.children.append(page[pos:end if end >= 0 else n])
            if end < 0:
                break
            gt = page.find(">", end)
            pos = gt + 1 if gt >= 0 else n
        elif not attrs.rstrip().endswith("/") or tag in _BLOCK or tag in ("b", "i", "em", "strong", "span", "a"):
            opened.push(child)
    return root


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw else {}


def _is_boilerplate(node: Node, in_article: bool) -> bool:
    if node.tag in _DROP or (not in_article and not node.holds_main and node.tag in _DROP_OUTSIDE):
        return True
    if node.tag == "header" and not in_article:
        return True
    if not node.attrs or node.tag in ("html", "body", "main"):
        return False
    a = _attributes(node.attrs)
    if _COMMENTS.search(a.get("class", "")) or _COMMENTS.search(a.get("id", "")):
        return True
    if node.holds_main:
        return False
    if not in_article and ("hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""))):
        return True
    if a.get("role", "").lower() in _ROLES:
        return True
    words = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", a.get("class", "") + " " + a.get("id", "")).lower()))
    return bool(words & _WORDS) or (not in_article and bool(words & _OUTSIDE_ARTICLE) and "article" not in words)


def _is_main(node: Node) -> bool:
    return node.tag == "main" or ("main" in node.attrs.lower() and _attributes(node.attrs).get("role", "").lower() == "main")


def _walk(root: Node) -> list[Node]:
    """Nodes parents first."""
    out = [root]
    for node in out:
        out.extend(c for c in node.children if isinstance(c, Node))
    return out


def annotate(root: Node) -> list[Node]:
    """Set hash, text size and holds_main of every node, leaves first; the nodes parents first."""
    nodes = _walk(root)
    for node in reversed(nodes):
        h = hashlib.blake2b(digest_size=8)
        h.update(node.tag.encode())
        if node.attrs and node.tag not in ("a", "img", "link"):
            a = _attributes(node.attrs)
            h.update(repr((a.get("class"), a.get("id"), a.get("role"))).encode())
        for c in node.children:
            if isinstance(c, Node):
                h.update(b"<" + c.hash)
                node.size += c.size
                if c.holds_main or c.tag in ("article", "main", "h1") or (c.attrs and "articleBody" in c.attrs):
                    node.holds_main = True
            else:
                t = " ".join(c.split())
                if t:
                    h.update(b"\0" + t.encode("utf-8", "replace"))
                    node.size += len(t)
        if node.tag in ("script", "style"):
            node.size = 0
        node.hash = h.digest()
    return nodes


def template_candidates(root: Node) -> tuple[list[bytes], list[bytes]]:
    """Hashes of subtrees that may be templates: containers with text that are not plain article content.

    First those with at most half of the page's text, which are evidence for a
    template; then the larger ones, which go only if other pages show that.
    """
    nodes = annotate(root)
    minor, major, inside = set(), set(), {id(root): False}
    for node in nodes:
        within = inside[id(node)] or node.tag in ("article", "main")
        for c in node.children:
            if isinstance(c, Node):
                inside[id(c)] = within
        if node is root or not node.size or node.holds_main or node.tag in ("html", "body", "head", "article", "main", "title", "script", "style"):
            continue
        if node.tag in _PLAIN and (inside[id(node)] or node.tag not in ("ul", "ol", "table", "p")):
            continue
        (minor if 2 * node.size <= root.size else major).add(node.hash)
    return sorted(minor), sorted(major - minor)


def main_text(page: str | None, templates: frozenset[bytes] = frozenset()) -> str:
    """The article's blocks of a page, without boilerplate and the given subtrees."""
    if not page:
        return ""
    root = parse(page)
    annotate(root)
    articles, mains, stack = [], [], [(root, False)]
    while stack:  # in the order of the page
        node, in_main = stack.pop()
        if node.tag == "article":
            articles.append(node)
            continue
        if not in_main and _is_main(node):
            mains.append(node)
            in_main = True
        for c in reversed(node.children):
            if isinstance(c, Node) and not _is_boilerplate(c, False) and not (c.hash in templates and not c.holds_main and c.tag not in ("article", "main")):
                stack.append((c, in_main))
    tops = articles or mains or [root]
    blocks, words = [], []

    def flush():
        line = " ".join("".join(words).split())
        if line:
            blocks.append(line)
        words.clear()

    in_article = tops[0] is not root
    for top in tops:
        work: list = [top]
        while work:
            x = work.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                words.append(html.unescape(x))
            elif x is top or not (_is_boilerplate(x, in_article) or (x.hash in templates and x.tag not in ("article", "main") and not x.holds_main
                                                                   and not (in_article and x.tag in _PLAIN))):
                if x.tag == "br":
                    words.append(" ")
                    continue
                block = x.tag in _BLOCK
                if block:
                    flush()
                    work.append(None)
                work.extend(reversed(x.children))
        flush()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    m = re.match(r"[^:/?#]*://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for first in range(0, len(pdf), 200):
            part = pdf.iloc[first:first + 200]
            rows = []
            for url, page in zip(part["url"], part["html"]):
                if page:
                    root = parse(page)
                    minor, major = template_candidates(root)
                    rows.append((host_of(url), root.hash, minor, major))
                else:
                    rows.append((host_of(url), None, [], []))
            yield pd.DataFrame({"page": part["page"].array, **{c: [r[i] for r in rows] for i, c in enumerate(("host", "body", "trees", "larger"))}})


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for first in range(0, len(pdf), 200):
            part = pdf.iloc[first:first + 200]
            texts = [main_text(p, frozenset(t) if t is not None else frozenset()) for p, t in zip(part["html"], part["templates"])]
            yield pd.DataFrame({"page_id": part["page_id"].array, "url": part["url"].array, "text": texts, "n_chars": [len(t) for t in texts]})


#: tables of (page, template hashes) with up to this many pages and hashes in all (some 30 bytes each) are broadcast, larger ones are joined by a shuffle
BROADCAST_HASHES = 1_000_000


def extract_pages(pages: DataFrame, min_pages: int = 8) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark = pages.sparkSession
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = src.withColumn("page", F.xxhash64("page_id", "url", "html"))
    path = scratch_path(spark, "page-trees")
    keyed.select("page", "url", "html").mapInPandas(_subtrees, "page long, host string, body binary, trees array<binary>, larger array<binary>").write.parquet(path)
    trees = spark.read.parquet(path)
    minor = trees.select("host", "body", F.explode("trees").alias("tree"))
    each = trees.select("page", "host", F.explode(F.concat("trees", "larger")).alias("tree"))
    recurring = (minor.select("host", "tree", "body").distinct().groupBy("host", "tree").agg(F.count("*").alias("on"))
                 .where(F.col("on") >= min_pages).select("host", "tree"))
    path = scratch_path(spark, "page-templates")
    (each.join(recurring, ["host", "tree"]).groupBy("page").agg(F.collect_set("tree").alias("templates"))  # at most a page's elements
     .write.parquet(path))
    found = spark.read.parquet(path)
    size = found.agg(F.sum(F.size("templates") + 1)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_HASHES else found
    return (keyed.join(found, "page", "left").select("page_id", "url", "html", "templates")
            .mapInPandas(_extract, "page_id long, url string, text string, n_chars long"))
