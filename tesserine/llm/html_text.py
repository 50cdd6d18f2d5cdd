"""Main text of web pages by tree scoring.

A page becomes a tree. What is never article text (menus, forms, scripts, boxes that their class, id or role names as boilerplate)
is cut first. Then every paragraph passes points for its length and commas to its ancestors, less with each level, and a
container's points are discounted by its link density. The best container, with the siblings that score well, is the article.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import query, small_batches, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
#: Elements that hold no article text, roles that say so, and words in class or id that name such boxes.
DROPPED = frozenset(("script style noscript template svg math iframe object embed canvas audio video map form button select textarea input "
                     "label fieldset nav header footer aside menu dialog head title").split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NAMED = frozenset(("ad ads adv advert advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
                   "notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars aside rail menu "
                   "nav navbar navigation breadcrumb breadcrumbs footer masthead header topbar toolbar share sharing social related recommended "
                   "recommendations comment comments commentlist disqus replies respond discussion login search pagination pager widget widgets skip header toc").split())
#: Of an article element only these say that it is none; beside these, a header belongs to the article; words that start or end so tell a state.
OTHER_ARTICLES = frozenset("comment comments reply related recommended promo teaser sponsored".split())
OWN_HEADERS = frozenset("post entry article content story".split())
#: Words that also name what an article is about: beside another word that is no plain name of a box they say nothing.
TOPICS = frozenset("login search discussion skip alert rail promotion".split())
PLAIN = frozenset(" box form bar panel area block wrapper wrap container content link links button btn site page top bottom left right main inner outer section list item slot unit field".split(" "))
_STATES = re.compile(r"(?:has|with|without|no|is|js)-|.*-(?:open|closed|active|enabled|disabled|status)$")
#: A start tag closes these open elements.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"tbody", "thead", "tr", "td", "th"}}
#: An implied end does not reach out of these.
FENCES = frozenset("table ul ol dl div section article main body aside nav blockquote".split())
_TAG = re.compile(r"""<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*>?|(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>)""", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAMES = re.compile(r"[^a-z0-9]+")
_COMMAS = re.compile("[,、،，]")


class Node:
    __slots__ = ("tag", "parent", "items", "boxed", "chars", "linked", "links", "points")

    def __init__(self, tag: str, parent: Node | None, boxed: bool) -> None:
        self.tag, self.parent, self.boxed = tag, parent, boxed
        self.items: list[Node | str] = []
        self.chars = self.linked = self.links = 0
        self.points = 0.0


def _boxed(tag: str, attributes: str) -> bool:
    """Whether an element's name or attributes say that it holds no article text."""
    if tag in DROPPED:
        return True
    if not attributes.strip() or tag in ("html", "body", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for word in value.split():
                parts = set() if _STATES.match(word) else {p.rstrip("0123456789") for p in _NAMES.split(word)}
                found = parts & (OTHER_ARTICLES if tag == "article" else NAMED)
                if found <= TOPICS and parts - NAMED - PLAIN:
                    continue  # the article's own subject, as in login-steps
                if found and not (found == {"header"} and parts & OWN_HEADERS):
                    return True
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def tree(html: str) -> Node:
    root = at = Node("", None, False)
    pos, end = 0, len(html)
    while pos < end:
        lt = html.find("<", pos)
        if lt < 0:
            at.items.append(html[pos:])
            break
        if lt > pos:
            at.items.append(html[pos:lt])
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            at.items.append("<")
            pos = lt + 1
            continue
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            open_ = at
            while open_ is not root and open_.tag != tag:
                open_ = open_.parent
            if open_ is not root:
                at = open_.parent
            continue
        if tag in BLOCKS or tag in CLOSES:
            closes = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
            open_, last = at, None
            while open_ is not root and open_.tag not in FENCES:
                if open_.tag in closes:
                    last = open_
                open_ = open_.parent
            at = last.parent if last else at
        node = Node(tag, at, _boxed(tag, m[3]))
        at.items.append(node)
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, pos)
            pos = end if not close else (html.find(">", close.end()) + 1 or end)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            at = node
    return root


def _in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.items) if not isinstance(x, str)]
    return out


def _prune(root: Node) -> list[Node]:
    """Cut boilerplate boxes unless they hold the article itself; then the nodes left, parents first."""
    order = _in_order(root)
    holds = set()
    for node in order:
        if node.tag in ("article", "main") and not node.boxed:
            up = node.parent
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    todo, left = [root], []
    while todo:
        node = todo.pop()
        left.append(node)
        node.items = [x for x in node.items if isinstance(x, str) or not x.boxed or id(x) in holds]
        todo += [x for x in reversed(node.items) if not isinstance(x, str)]
    return left


def _measure(order: list[Node]) -> None:
    """Characters, characters in links and number of links of every subtree, children before parents."""
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, str):
                node.chars += len(x.strip())
            else:
                node.chars, node.linked, node.links = node.chars + x.chars, node.linked + x.linked, node.links + x.links
        if node.tag == "a":
            node.linked, node.links = node.chars, 1


def _link_list(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.links >= 2 and node.linked > 0.6 * node.chars


def _paragraph(node: Node) -> str:
    """Text of a paragraph: what lies in the element outside blocks of its own."""
    parts, todo = [], list(reversed(node.items))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag not in BLOCKS and x.tag != "a":
            todo += reversed(x.items)
    return " ".join("".join(parts).split())


def _article(order: list[Node]) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    containers = []
    for node in order:
        if node.tag not in BLOCKS or node.tag in ("ul", "ol", "table", "tbody", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        text = _paragraph(node)
        if not text:
            continue
        points = 1 + len(_COMMAS.findall(text)) + len(text) / 100
        up = node.parent if node.tag in ("p", "li", "td", "th", "dd", "dt", "pre", "blockquote") and node.parent is not None else node
        level = 1.0
        while up is not None and level < 6:
            if not up.points:
                containers.append(up)
            up.points += points / level
            level += 1
            up = up.parent
    best, most = None, 0.0
    for node in containers:
        if node.tag in ("", "html") and len(containers) > 1:
            continue
        score = (node.points + (25 if node.tag in ("article", "main") else 0)) * (1 - node.linked / max(node.chars, 1))
        node.points = score
        if score > most:
            best, most = node, score
    if best is None:
        return order[:1]
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        best, most = up, max(most, up.points)
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * most)
    kept: list[Node] = []
    headings: list[Node] = []  # those that stand right before the best container are its titles
    for x in best.parent.items:
        if not isinstance(x, str) and x.tag in ("h1", "h2", "h3") and not x.links:
            headings.append(x)
        elif x is best:
            kept += [*headings, x]
        elif isinstance(x, str) and x.strip() or not isinstance(x, str) and x.chars:
            headings = []
        if isinstance(x, str) or x is best:
            continue
        if x.tag in ("h1", "h2", "h3"):
            continue
        if not _link_list(x):
            text = _paragraph(x) if x.tag == "p" else ""
            if x.tag not in ("main", "html") and x.points >= least or len(text) > 80 and x.linked < 0.25 * x.chars:
                kept.append(x)
    return kept


def _blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = "".join(run)
        run.clear()
        if "&" in text:
            text = unescape(text)
        if text := " ".join(text.split()):
            out.append(text)

    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag in BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(x.items)
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article of a page, blocks joined by one newline; empty for a null or empty page and for one without article text."""
    if not html:
        return ""
    order = _prune(tree(html))
    _measure(order)
    return "\n".join(_blocks(_article(order)))


def _texts(html: pd.Series) -> pd.Series:
    return html.map(main_text)


def extracted(html: Column) -> Column:
    """Main text of every page of the column, whatever else the rows hold; see `main_text` for nulls."""
    return F.pandas_udf(_texts, "string")(F.coalesce(html, F.lit("")))


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """`pages` with the main text added. Pages are independent: null ids, repeated rows and empty tables need no care."""
    return small_batches(pages).withColumn(out, extracted(F.col(html_col)))


@query("op2_tree_scored_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
