"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags and text. Text belongs to the root-to-leaf path of its open
elements, a path being their tags with class and id, so that div.ad and div.story are different
paths; elements that only style text aren't part of it. Per path, text length and punctuation are summed
and divided by the number of its text nodes, and the length by that of all paths; the three ratios are fused by multiplication. The
ratios of the text nodes in page order are smoothed, and the blocks that reach a share of the text's mean ratio are content.

Menus, headers, footers, sidebars, dialogs and forms go before that, by tag or role, and reader comments by
name too, as their ratios are those of prose. Any other name (an advert's class, say) only divides the
ratio by a constant, outside of article and main, whose own ratio is multiplied by one.

Inline parts of a block that is content go with it; a heading right before a content block, and a
block between two of one element, go with their neighbours if nothing speaks against them.

Defined results: a null or empty html, or one without content, gives an empty text; unclosed and
stray tags are tolerated; character references are decoded; a page of any length is read whole;
repeated rows each keep their row; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(  # possessive throughout: an unclosed tag fails at once
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/<>]*+)"
    r"(?P<attrs>(?:[\s/]++|[^\s\"'<>=/]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>]++))?+)*+)[^<>]*+>", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>=/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：·¿¡]")
#: Elements whose content is text of a kind of its own.
RAW = frozenset("script style textarea title template iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag of a kind ends when they are still open: (opening, ended, not beyond).
_ENDS = {x: ("p", frozenset(("button", "table", "td", "th"))) for x in BLOCK - frozenset("body br caption head html tbody td tfoot th thead tr".split())}
_SELF = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
BOILERPLATE_TAGS = frozenset("nav footer aside button select menu dialog head".split()) | RAW
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Names (whole words of a class or id) of reader comments, and of adverts, notices and the like.
_COMMENTS = re.compile(r"(?:(?:reader|user|post|article|fb|facebook)[_-])?comments?(?:[_-](?:list|area|section|wrap|wrapper|thread|body|form|container|box|block))?|commentlist|disqus(?:_thread)?|respond|replies", re.I)
_DOUBTED = re.compile(
    r"ads?|ad[_-]\w+|adverts?|advertisements?|adsense|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|side-?bar\w*|has-sidebar|footer\w*|masthead|topbar|toolbar|header|cookies?|cookie[_-]\w+|consent|gdpr|notices?|alert|banner\w*|popup|modal"
    r"|newsletter\w*|subscri\w*|signup|login|share|sharing|social\w*|related(?:[_-](?:posts?|articles?|stories|links?|news|content))?|recommend\w*|widget\w*|pager|pagination|skip-link|copyright|legal",
    re.I,
)
#: A block is content if its smoothed ratio (a logarithm) is at most DROP below the text's mean. A doubted name takes AGAINST off it, more
#: where the page has under SCANT characters of text, from which ratios say little; article and main add FOR.
DROP, AGAINST, SCANT, FOR = 2.5, 1.0, 300, 1.0
SMOOTH = (0.15, 0.7, 0.15)
#: Elements that only style the text of their block, and so have its path.
_STYLES = frozenset("abbr b bdi bdo big cite code del dfn em font i ins kbd mark q ruby rb rt rp s samp small strike strong sub sup tt u var wbr".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_ROOTS = frozenset(("article", "main"))
#: Block elements that have no say about what belongs together.
_PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd br hr table caption tbody thead tfoot tr td th blockquote pre figure figcaption hgroup address summary legend center".split())


class _Node:
    """An open element; a text belongs to the innermost one."""

    __slots__ = ("tag", "path", "against", "doubt", "home", "root", "heading", "link")

    def __init__(self, tag="", path=0, against=False, doubt=0, home=0, root=0, heading=False, link=False):
        self.tag, self.path, self.against, self.doubt = tag, path, against, doubt
        self.home, self.root, self.heading, self.link = home, root, heading, link


class _Page:
    """The texts of a page: for each its node, its block (a run without a block's edge) and what stands in it."""

    def __init__(self) -> None:
        self.paths: dict[tuple[int, str], int] = {}
        self.texts: list[tuple[_Node, int, str]] = []
        self.doubts: list[tuple[int, str]] = [(0, "")]  # (the doubted element around it, what is doubted)
        self.block = 0

    def doubt(self, node: _Node, why: str) -> None:
        self.doubts.append((node.doubt, why))
        node.doubt = len(self.doubts) - 1

    def path(self, parent: int, label: str) -> int:
        return self.paths.setdefault((parent, label), len(self.paths) + 1)


def _label(tag: str, names: dict[str, str]) -> str:
    """An element's part of a path; digits don't count, so that numbered elements share it."""
    return tag + "".join(mark + re.sub(r"\d+", "0", names[k]) for k, mark in (("class", "."), ("id", "#")) if names.get(k))


def _names(attrs: str) -> dict[str, str]:
    if "=" not in attrs:
        return {}
    return {k: v for k, v in ((name.lower(), a or b or c) for name, a, b, c in _ATTRIBUTE.findall(attrs)) if k in ("class", "id", "role")}


def _open(page: _Page, parent: _Node, number: int, tag: str, attrs: str) -> _Node:
    names = _names(attrs)
    node = _Node(tag, parent.path if tag in _STYLES else page.path(parent.path, _label(tag, names)), parent.against, parent.doubt, parent.home, parent.root)
    node.heading, node.link = parent.heading or tag in _HEADINGS, parent.link or tag == "a"
    if tag in _ROOTS:
        node.root = number
    if tag in BLOCK and tag not in _PARTS:
        node.home = number
    if tag in BOILERPLATE_TAGS or tag == "header" and not parent.root or names.get("role", "").lower() in BOILERPLATE_ROLES:
        node.against = True
    called = [x for k in ("class", "id") for x in names.get(k, "").split()] if tag not in ("html", "body", "article", "main") else []
    if tag == "form" or names.get("role", "").lower() == "form":
        page.doubt(node, "form")
    if any(_COMMENTS.fullmatch(x) for x in called):
        page.doubt(node, "comments")
    elif not node.root and any(_DOUBTED.fullmatch(x) for x in called):
        page.doubt(node, "name")
    return node


def read(html: str) -> _Page:
    page, base = _Page(), _Node(tag="#")
    stack, opened = [base], Counter()
    at, number = 0, 0

    def text(piece: str) -> None:
        if piece:
            page.texts.append((stack[-1], page.block, entities.unescape(piece)))

    def close(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]

    def end(ended: tuple[str, ...], limit) -> None:
        """Close the innermost open element of these, unless one of limit lies within."""
        if any(opened[x] for x in ended):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    close(i)
                    break
                if stack[i].tag in limit:
                    break

    while m := _TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        tag = (m["name"] or "").lower()
        if not tag:
            continue
        page.block += tag in BLOCK
        if m["close"]:
            if opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if tag not in BLOCK and stack[i].tag in BLOCK:
                        break  # an inline end tag never closes a block
            continue
        if tag in _ENDS:
            end((_ENDS[tag][0],), _ENDS[tag][1])
        if tag in _SELF:
            ended, limit = _SELF[tag]
            end(ended, limit)
        if tag == "body" and stack[-1].tag == "head":
            close(len(stack) - 1)
        if tag in VOID or m["attrs"].rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            done = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = done.end() if done else len(html)
            continue
        number += 1
        stack.append(_open(page, stack[-1], number, tag, m["attrs"] or ""))
        opened[tag] += 1
    text(html[at:])
    return page


#: What evidence says of a text.
CUT, DOUBTED, FREE = 2, 1, 0


def evidence(page: _Page) -> list[int]:
    """Per text, whether its element or one around it cuts it out, only speaks against it, or neither.

    A form, or an element known by class or id, that holds most of the page's text or of its
    articles' text is the page's frame and says nothing; comments are no frame unless they hold most of both.
    """
    held, rooted = [0] * len(page.doubts), [0] * len(page.doubts)
    every = roots = 0
    for node, _, piece in page.texts:
        n = len(piece.strip())
        article = n if node.root else 0
        every, roots = every + n, roots + article
        held[node.doubt] += n
        rooted[node.doubt] += article
    for d in range(len(held) - 1, 0, -1):  # an element stands after those around it
        held[page.doubts[d][0]] += held[d]
        rooted[page.doubts[d][0]] += rooted[d]
    said = [FREE] * len(held)
    for d in range(1, len(held)):
        around, why = page.doubts[d]
        frame = 2 * rooted[d] > every if why == "comments" else 2 * rooted[d] > roots or 2 * held[d] > every
        said[d] = max(said[around], FREE if frame else DOUBTED if why == "name" else CUT)
    return [CUT if node.against else said[node.doubt] for node, _, _ in page.texts]


def _smooth(values: list[float]) -> list[float]:
    n = len(values)
    return [sum(w * values[min(n - 1, max(0, i + d))] for d, w in zip((-1, 0, 1), SMOOTH)) for i in range(n)]


def path_ratios(texts: list[tuple[int, str]]) -> list[float]:
    """Per text (path, piece), in page order: the fused and smoothed ratios of its path, as a logarithm."""
    length, marks, nodes = Counter(), Counter(), Counter()
    for path, piece in texts:
        bare = piece.strip()
        length[path] += len(bare)
        marks[path] += len(_PUNCTUATION.findall(bare))
        nodes[path] += 1
    total = sum(length.values())
    fused = {p: math.log1p(length[p] / nodes[p]) + math.log1p(marks[p] / nodes[p]) + math.log(max(1, length[p]) / max(1, total)) for p in nodes}
    return _smooth([fused[p] for p, _ in texts])


def main_text(html: str) -> str:
    page = read(html)
    said = [x + (names,) for x, names in zip(page.texts, evidence(page)) if x[2].strip() and names != CUT]
    ratios = path_ratios([(node.path, piece) for node, _, piece, _ in said])
    blocks: dict[int, list] = {}  # weight, weighted ratio, whether a name speaks against it, home, heading, characters of links, root
    free = [0, 0.0]  # weight and weighted ratio of all that nothing speaks against
    for (node, block, piece, names), ratio in zip(said, ratios):
        n = len(piece.strip())
        b = blocks.setdefault(block, [0, 0.0, False, node.home, node.heading, 0, node.root])
        ratio += FOR * (node.root > 0)
        b[0], b[1], b[2], b[5] = b[0] + n, b[1] + n * ratio, b[2] or names == DOUBTED, b[5] + n * node.link
        if names == FREE:
            free[0], free[1] = free[0] + n, free[1] + n * ratio
    if not free[0]:
        return ""
    limit = free[1] / free[0] - DROP
    against = AGAINST * (1 + SCANT / free[0])
    good = {k for k, b in blocks.items() if b[1] / b[0] - against * b[2] >= limit}
    good |= _lent(list(blocks), blocks, good)
    out, last = [], None
    for (_, block, piece), names in zip(page.texts, evidence(page)):
        if block in good and names != CUT:
            if block != last:
                out.append(" ")
            out.append(piece)
            last = block
    return " ".join("".join(out).split())


def _lent(order: list[int], blocks: dict[int, list], good: set[int]) -> set[int]:
    """Blocks that go with content beside them: a heading before it and, where content stands on both
    sides in the same element, article or main, what isn't mostly links. Nothing that a name speaks against."""
    out: set[int] = set()
    homes: dict[int, list[int]] = {}
    for i, k in enumerate(order):
        if k in good:
            for home in {blocks[k][3], blocks[k][6] or blocks[k][3]}:
                homes.setdefault(home, [i, i])[1] = i
    after = False
    for i in range(len(order) - 1, -1, -1):
        k = order[i]
        b = blocks[k]
        between = any(home in homes and homes[home][0] < i < homes[home][1] for home in {b[3], b[6] or b[3]})
        if b[4] and after or between and 2 * b[5] < b[0]:
            out.add(k)
        after = not b[2] and (k in good or k in out)
    return {k for k in out if not blocks[k][2]}


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars."""

    def rows(batches):
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(rows, "page_id long, url string, text string, n_chars long")
