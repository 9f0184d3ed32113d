"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf tag path. Per path, text length and punctuation are summed over its
nodes and divided by their number; the ratios are smoothed over paths that are near each other in the tree
of paths, fused to one score, and thresholded by the scores' spread over the page. The content
node is the deepest container that holds all paths above the threshold, or the article around it; all its
text is content, and so are headings that stand before it in the containers around it, but for elements that are never main text: menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments, known by element or by class and id.

Defined results: a null page is empty; a page without any main text gives an empty string; tag soup is
read as browsers do (a block ends an open paragraph, an unmatched end tag is ignored, a page may stop
anywhere); an empty table gives no rows; further columns are never read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without a text of their own, elements and words in class or id that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title object select".split())
BOILERPLATE = frozenset("head nav header footer aside form button dialog menu fieldset label".split()) | RAW
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr
    notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs
    sidebar side aside widget widgets header masthead topbar footer bottom copyright legal comment comments reply replies respond disqus
    related recommended recommendations share sharing social tags pagination pager search skip toolbar""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
CONTAINERS = frozenset("article main section div body html td center".split())
BLOCKS = CONTAINERS | frozenset(
    """p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr th caption figure figcaption address hr details summary
    header footer nav aside form fieldset hgroup dir menu""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
#: Start tags that end an open element of these names, up to the named ancestors.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？¿¡؟،।]")
TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<slash>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<bogus>[!?/][^>]*+(?:>|\Z))|(?P<rough>[a-zA-Z][^>]*+(?:>|\Z)))""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TOKEN = re.compile(r"[a-z]+")
NUMBER = re.compile(r"&#(?=[0-9])0*+([0-9]*+)(;?)")
# Elements of other languages, and the elements of HTML that end them where they stand.
FOREIGN = frozenset("svg math".split())
FOREIGN_TAG = re.compile(r"""<(?P<slash>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: What a step between two paths leaves of their closeness.
NEAR = 0.55


class Page:
    """Text nodes of a page (path, block number, text) and the tree of its tag paths.

    A path is a number: ``parent`` and ``element`` tell its way from the root, path 0. Parents come before their children, so
    one pass over the numbers, up or down, sees the whole tree: reading and scoring are linear in the page, however deep it is.
    """

    def __init__(self, source: str):
        self.parent, self.element = [-1], [""]
        self._known: dict[tuple[int, str], int] = {}
        self.nodes: list[tuple[int, int, str]] = []
        self._read(source)

    def _step(self, path: int, element: str) -> int:
        """The path one element on."""
        found = self._known.get((path, element))
        if found is None:
            found = self._known[path, element] = len(self.parent)
            self.parent.append(path)
            self.element.append(element)
        return found

    def _read(self, source: str) -> None:
        paths, marks = [0], [False]  # of the open elements, and whether all from here on down is boilerplate
        names = [""]
        open_at: dict[str, list[int]] = {}  # where in the stack elements of a name are
        block, at = 0, 0
        search = TAG.search

        def cut(depth: int) -> None:
            for name in reversed(names[depth:]):
                open_at[name].pop()
            del paths[depth:], marks[depth:], names[depth:]

        def last(of: Iterable[str]) -> int:
            return max((open_at[x][-1] for x in of if open_at.get(x)), default=0)

        while True:
            tag = search(source, at)
            text = source[at : tag.start()] if tag else source[at:]
            if text and not marks[-1]:
                self.nodes.append((paths[-1], block, text))
            if not tag:
                return
            at = tag.end()
            name = tag["name"] or (re.match(r"[a-zA-Z][^\s/>]*", tag["rough"])[0] if tag["rough"] else None)
            if name is None:
                continue
            name = name.lower()
            if name in BLOCKS:
                block += 1
            if tag["slash"]:
                if open_at.get(name):
                    cut(open_at[name][-1])
                continue
            if name == "br":
                if not marks[-1]:
                    self.nodes.append((paths[-1], block, " "))
                continue
            if name in VOID:
                continue
            attrs = tag["attrs"] or ""
            if name in FOREIGN:
                if not SELF_CLOSED.search(attrs):
                    at = _end_of_foreign(source, at, name)
                continue
            if name in RAW:  # its content isn't markup
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if name in ENDS_PARAGRAPH and open_at.get("p"):
                cut(open_at["p"][-1])
            if name in ENDS:
                ended, limit = ENDS[name]
                if last(ended) > last(limit):
                    cut(last(ended))
            element, marked = name, name in BOILERPLATE
            if attrs and not marked:
                words: set[str] = set()
                for kind, a, b, c in ATTRIBUTE.findall(attrs):
                    value = (a or b or c).lower()
                    if kind.lower() == "role":
                        marked |= value.strip() in ROLES
                    elif kind.lower() in ("class", "id"):
                        words.update(TOKEN.findall(value))
                if words and name not in ("html", "body", "article", "main", "p"):
                    marked |= not words.isdisjoint(MARKS)
                if words and name in CONTAINERS and name not in ("html", "body"):
                    element = f"{name}#{' '.join(sorted(words))}"
            open_at.setdefault(name, []).append(len(paths))
            paths.append(self._step(paths[-1], element))
            marks.append(marked or marks[-1])
            names.append(name)


def _end_of_foreign(source: str, at: int, name: str) -> int:
    """Where an svg or math element ends: at its end tag, or before an HTML element that can't be in it."""
    depth = 1
    for tag in FOREIGN_TAG.finditer(source, at):
        found = tag["name"].lower()
        if found == name:
            depth += -1 if tag["slash"] else not SELF_CLOSED.search(tag["attrs"])
            if not depth:
                return tag.end()
        elif found == "foreignobject":
            end = re.compile(rf"</{name}\s*>", re.I).search(source, tag.end())
            return end.end() if end else len(source)
        elif not tag["slash"] and found in BREAKS_OUT:
            return tag.start()
    return len(source)


def path_scores(page: Page) -> dict[int, tuple[float, int, int]]:
    """Per path with text: the smoothed and fused ratio, text length and number of nodes.

    Smoothing takes weighted means of both ratios over all paths of the page; a path's weight is the root of its number of nodes,
    times NEAR for every step between the two in the tree. Sums go up the tree once and down once.
    """
    sums: dict[int, list[int]] = {}
    for path, _, text in page.nodes:
        length = len(text) if text.strip() else 0
        if length:
            entry = sums.setdefault(path, [0, 0, 0])
            entry[0] += length
            entry[1] += len(PUNCTUATION.findall(text))
            entry[2] += 1
    n = len(page.parent)
    below = [(0.0, 0.0, 0.0)] * n
    for p, (length, marks, k) in sums.items():
        w = math.sqrt(k)
        below[p] = w, w * length / k, w * marks / k
    for p in range(n - 1, 0, -1):
        up = page.parent[p]
        if below[p][0]:
            below[up] = tuple(x + NEAR * y for x, y in zip(below[up], below[p]))
    around = below[:]
    for p in range(1, n):
        around[p] = tuple(x + NEAR * (y - NEAR * x) for x, y in zip(below[p], around[page.parent[p]]))
    out = {}
    for p, (length, _, k) in sums.items():
        total, text, marks = around[p]
        text, marks = max(text / total, 0.0), max(marks / total, 0.0)
        out[p] = text * math.log1p(marks) + math.log1p(text), length, k
    return out


def content_root(page: Page, spread: float = 0.5) -> int | None:
    """The path of the deepest container of all paths whose score passes the threshold, or of the article that it is in."""
    scores = path_scores(page)
    if not scores:
        return None
    n = sum(k for _, _, k in scores.values())
    mean = sum(s * k for s, _, k in scores.values()) / n
    deviation = math.sqrt(sum(k * (s - mean) ** 2 for s, _, k in scores.values()) / n)
    best = max(s for s, _, _ in scores.values())
    least = min(best, spread * (deviation or best))
    chosen = [0] * len(page.parent)
    for p, (s, _, _) in scores.items():
        chosen[p] = int(s >= least)
    total = sum(chosen)
    for p in range(len(chosen) - 1, 0, -1):
        chosen[page.parent[p]] += chosen[p]
    root = max(p for p, k in enumerate(chosen) if k == total)  # those with all chosen paths below are one way down
    bare = lambda p: page.element[p].partition("#")[0]
    way = root
    while way > 0 and bare(way) != "article":
        way = page.parent[way]
    if way > 0:  # all of an article is its text, short parts too
        return way
    while root > 0 and bare(root) not in CONTAINERS:
        root = page.parent[root]
    return root


def main_text(source: str) -> str:
    page = Page(source)
    root = content_root(page)
    if root is None:
        return ""
    around = {0}  # the containers around the root
    way = page.parent[root]
    while way > 0:
        around.add(way)
        way = page.parent[way]
    inside, heads = [root == 0], [False]
    for p in range(1, len(page.parent)):
        up = page.parent[p]
        inside.append(p == root or inside[up])
        heads.append(heads[up] or page.element[p] in HEADINGS and up in around)
    blocks: dict[int, list[str]] = {}
    begun = False
    for path, block, text in page.nodes:
        begun |= inside[path] and bool(text.strip())
        if inside[path] or not begun and heads[path]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(html.unescape(NUMBER.sub(_short_number, "".join(parts))).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _short_number(reference: re.Match) -> str:
    """A decimal character reference beyond any code point is the replacement character; its digits are never converted."""
    return f"&#{reference[1] or '0'}" if len(reference[1]) <= 7 else "�" + reference[2] * 0


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; no shuffle."""
    source = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [main_text(value.as_py()) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
