"""Main text of a web page by tree scoring.

A small tree is built from the tags (forgiving unclosed and stray ones).
Paragraphs pass points, for their length and commas, to their ancestors; an
element's points are discounted by its link density.  The best container is
kept with the rest of its article, or, on pages without one, with the blocks
around it that score well or read as prose; navigation, forms, adverts,
comments and other furniture are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import ids_as_text, pick, ship

#: fixed values: HTML's element kinds
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section "
                   "summary table tbody td tfoot th thead tr ul caption").split())
SKIP = frozenset(("script style noscript template head title iframe object embed svg math canvas audio video map "
                  "nav footer aside form button input select textarea option datalist menu dialog").split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: which open element an opening tag ends, and where the search for it stops
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: what may stand in a head; anything else ends one that was not closed
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: names of page furniture in class, id and role (a "with-sidebar" frame is none)
FURNITURE = re.compile(
    r"(?:^|(?<!with)(?<!has)(?<!no)[\s_-])(?:ad(?:s|box|slot|unit|space)?|adsby\w*|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|breadcrumbs?|footer|foot|header|masthead|"
    r"comments?|comment-?list|disqus|respond|replies|reply|cookie\w*|consent|notice|notification|alert|popup|modal|overlay|newsletter|"
    r"subscribe|signup|share|sharing|social|related|recommend\w*|widget|pagination|pager|toolbar|complementary|"
    r"contentinfo|navigation|search)(?:$|[\s_-])", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: names that make even an article furniture
ASIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|disqus|repl(?:y|ies)|related|teaser)(?:$|[\s_-])", re.I)
#: whole names of comment threads and consent boxes: furniture however much text they hold
THREAD = re.compile(
    r"(?:comments?|disqus|repl(?:y|ies)|respond)(?:[_-]?(?:area|list|thread|section|box|container|wrapper|block|body|content|form))*|"
    r"cookies?[_-]?(?:notice|banner|consent|bar|popup|modal|overlay)", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: what stays between two parts of an article
BETWEEN = HEADINGS | frozenset("ul ol dl blockquote pre table figure".split())
#: headings that lead to other pages
ELSEWHERE = re.compile(r"\b(?:more|latest|popular|trending|next|previous|read|see also)\b", re.I)
#: how a sentence ends
SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"')\]\u201d\u2019\u00bb]*$")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "score", "length", "linked", "core", "text", "link_text")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None") -> None:
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.score, self.length, self.linked = 0.0, 0, 0
        self.core = False  # holds an article or a main part
        self.text, self.link_text = 0, 0  # characters before furniture goes, and those inside links


class Tree(HTMLParser):
    """Elements and strings under ``root``; nothing is raised for bad markup.

    The open elements form a stack, and the places of every name in it are
    kept, so that an end tag finds its element without walking up the tree."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)
        self.stack: list[Node] = [self.root]
        self.places: dict[str, list[int]] = {}

    def _last(self, tags: set | frozenset) -> int:
        """Place of the innermost open element with one of the names, or 0."""
        places = self.places
        return max((places[t][-1] for t in (tags & places.keys()) if places[t]), default=0)

    def _close(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()
        self.at = self.stack[-1]

    def _pop_to(self, tags: set | frozenset, stop: set | frozenset) -> None:
        found = self._last(tags)
        if found and found > self._last(stop):
            self._close(found)

    def _end_head(self) -> None:
        if self.at.tag == "head":
            self._close(len(self.stack) - 1)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` opens a comment up to the next ``>``, whatever stands in it."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if tag in CLOSES_P:
            self._pop_to({"p"}, {"td", "th", "table", "button", "caption", "object", "template"})
        if tag in ENDS:
            self._pop_to(*ENDS[tag])
        node = Node(tag, dict(attrs), self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node
            self.places.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # outside foreign elements the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        if self.at.tag == tag and len(self.stack) > 1:
            self._close(len(self.stack) - 1)
        elif self.places.get(tag):
            self._pop_to({tag}, frozenset() if tag in BLOCK else BLOCK)  # an inline one ends nothing outside its block

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        self.at.kids.append(data)


def _names(node: Node, *kinds: str) -> str:
    return " ".join(str(node.attrs.get(k) or "") for k in kinds)


def _named_furniture(node: Node, inside: bool) -> bool:
    """Whether the names of an element make it furniture.

    Inside an article a name is only a hint: it counts if most of the text is
    links, or there is little text.  Ids are often slugs of headings
    (``related-work``), so they never count for a heading, and for a part that
    holds prose only if they name a comment thread."""
    if FURNITURE.search(_names(node, "role")):
        return True
    kinds = _names(node, "class")
    by_class = bool(FURNITURE.search(kinds))
    slug = str(node.attrs.get("id") or "").strip()
    if not by_class and not (slug and FURNITURE.search(slug)):
        return False
    plain = node.text - node.link_text
    if node.tag in HEADINGS:  # always of little text
        return by_class and (not inside or node.link_text > plain)
    if any(THREAD.fullmatch(n) for n in [*kinds.split(), slug]):
        return True
    if by_class:
        return not (inside and plain >= 100 and 4 * node.link_text < node.text)
    return not ((inside or node.tag == "section") and plain >= 25 and 3 * node.link_text < node.text)


def _furniture(node: Node, inside: bool = False, homed: bool = True) -> bool:
    """``inside`` an article (or a main part without one); ``homed``: any article or main part stands around it."""
    if "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
        return True
    if HIDDEN_STYLE.search(str(node.attrs.get("style") or "")):
        return True
    if node.tag == "form" and node.core:  # a form around the whole page
        return False
    if node.tag in SKIP:
        return True
    if node.tag in ("article", "main"):
        return bool(ASIDE.search(_names(node, "class", "id", "role")))
    if node.tag in ("html", "body"):
        return False
    if node.tag == "header" and not homed:  # a page's header; an article's own holds its headline
        return True
    return not node.core and _named_furniture(node, inside)


def _walk(root: Node) -> list[Node]:
    """Elements that are no furniture, parents first (no recursion: pages may nest deep)."""
    every, todo = [], [root]
    while todo:
        node = todo.pop()
        every.append(node)
        todo += [k for k in node.kids if not isinstance(k, str)]
    for node in reversed(every):  # children first
        node.core = any(not isinstance(k, str) and (k.core or k.tag in ("article", "main") and not _furniture(k))
                        for k in node.kids) and node.tag not in ("nav", "aside", "footer", "dialog")
        if node.tag not in SKIP or node.core:
            for k in node.kids:
                node.text += len(k.strip()) if isinstance(k, str) else k.text
                node.link_text += 0 if isinstance(k, str) else k.link_text
            if node.tag == "a":
                node.link_text = node.text
    out, todo = [], [(root, False, False)]
    while todo:
        node, inside, homed = todo.pop()
        out.append(node)
        inside = inside or node.tag == "article" or node.tag == "main" and not node.core
        homed = homed or node.tag in ("article", "main")
        node.kids = [k for k in node.kids if isinstance(k, str) or not _furniture(k, inside, homed)]
        todo += [(k, inside, homed) for k in reversed(node.kids) if not isinstance(k, str)]
    return out


def _score(nodes: list[Node]) -> None:
    own: dict[int, list[str]] = {}
    for node in reversed(nodes):  # children first
        linked = node.linked
        for k in node.kids:
            if isinstance(k, str):
                n = len(_SPACE.sub(" ", k).strip())
                node.length += n
            else:
                node.length += k.length
                linked += k.length if k.tag == "a" else k.linked
        node.linked = linked
        own[id(node)] = []
    nearest: dict[int, Node] = {}
    for node in nodes:  # parents first; a string counts for the nearest block
        up = node.parent
        block = nearest[id(node)] = node if node.tag in BLOCK or up is None else nearest[id(up)]
        own[id(block)] += [k for k in node.kids if isinstance(k, str) and k.strip()]
    for node in nodes:
        text = _SPACE.sub(" ", "".join(own[id(node)])).strip()
        if len(text) < 25 or node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
        up, share = node if node.tag not in ("p", "pre", "li", "td", "dd", "blockquote") else node.parent, 1.0
        while up is not None and share >= 0.1:
            up.score += points * share
            up, share = up.parent, share / 2
    for node in nodes:
        node.score *= 1 - (node.linked / node.length if node.length else 0.0)


def _blocks(node: Node, out: list[str]) -> None:
    """Texts of the blocks under a node, in page order."""
    part: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(part)).strip()
        part.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        k = todo.pop()
        if k is None:
            end()
        elif isinstance(k, str):
            part.append(k)
        elif k.tag == "br":
            part.append(" ")
        else:
            if k.tag in BLOCK:
                end()
                todo.append(None)
            todo += reversed(k.kids)
    end()


def extract(html: str | None) -> str:
    """The main text: blocks with their white space folded, joined by blank
    lines; empty for null or empty html, or where no text is left."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html.replace("\x00", ""))
    tree.close()
    nodes = _walk(tree.root)
    _score(nodes)
    scored = [n for n in nodes if n.score > 0 and n.tag in BLOCK | {"html"}]
    out: list[str] = []
    if not scored:
        _blocks(tree.root, out)
        return "\n\n".join(out)
    best = max(scored, key=lambda n: n.score)  # the outermost of equals
    _blocks(_lift(best), out)
    return "\n\n".join(out)


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _home(node: Node) -> Node | None:
    """The article that an element stands in (or is), or else the main part that holds no article."""
    up, main = node, None
    while up is not None:
        if up.tag == "article":
            return up
        if up.tag == "main" and not up.core and main is None:
            main = up
        up = up.parent
    return main


def _has_h1(node: Node) -> bool:
    todo = [node]
    while todo:
        node = todo.pop()
        if node.tag == "h1":
            return True
        todo += [k for k in node.kids if not isinstance(k, str)]
    return False


def _reads_on(kid: Node, least: float, near: bool) -> bool:
    """Whether a block outside the article (or beside the container, where there is none) belongs to it."""
    density, plain = _density(kid), kid.length - kid.linked
    if kid.score >= least and (density < 0.5 or kid.score >= 10):
        return True
    if kid.tag == "p":
        return kid.length > 80 and density < 0.25 or 0 < kid.length <= 80 and density == 0
    return near and kid.score > 0 and plain >= 80 and density < 0.25


def _text(node: Node) -> str:
    out: list[str] = []
    _blocks(node, out)
    return " ".join(out)


def _headed(node: Node, before: Node | str | None) -> bool:
    """Whether a part made of links stands under a heading, its own first or
    the one before it, that does not name furniture."""
    todo, heading = [node], None
    while todo and heading is None:
        k = todo.pop()
        heading = k if k.tag in HEADINGS else None
        todo += [x for x in reversed(k.kids) if not isinstance(x, str)]
    if heading is None and isinstance(before, Node) and before.tag in HEADINGS:
        heading = before
    named = _text(heading) if heading is not None else ""
    return bool(named) and not FURNITURE.search(named) and not ELSEWHERE.search(named)


def _closing(kid: Node) -> bool:
    """Whether a short block without links reads as a sentence."""
    return kid.tag in BLOCK and not kid.linked and bool(SENTENCE_END.search(_text(kid)))


def _lift(best: Node) -> Node:
    """The root, with all taken out around the container but its article's text.

    Inside an article (or a main part) only parts made of links go, those under
    a heading of the article excepted.  Sentences right after a container
    without an article stay.  Around it,
    and around a container without one, blocks stay that score well or are
    prose, the headline, and what stands between them: headings, lists, quotes,
    code and tables of low link density."""
    home, node, least, headline = _home(best), best, 0.2 * best.score, None
    inside = home is not None and node is not home
    while node.parent is not None:
        up, kids = node.parent, node.parent.kids
        if inside:
            parts = [k for k in kids if not isinstance(k, str) or k.strip()]
            before = {id(k): p for p, k in zip(parts, parts[1:])}
            up.kids = [k for k in kids if isinstance(k, str) or k is node or k.tag in HEADINGS or
                       _density(k) < 0.5 or k.score >= least or _headed(k, before.get(id(k)))]
            node, inside = up, up is not home
            continue
        keep = [not isinstance(k, str) and (k is node or _reads_on(k, least, home is None)) for k in kids]
        if home is None and node is best:
            for i in range(next(i for i, k in enumerate(kids) if k is node) + 1, len(kids)):
                if not isinstance(kids[i], str) and not keep[i]:
                    keep[i] = _closing(kids[i])
                    if not keep[i]:
                        break
        at = [i for i, kept in enumerate(keep) if kept]
        first, last = at[0], at[-1]
        while first and (isinstance(kids[first - 1], str) and not kids[first - 1].strip() or
                         not isinstance(kids[first - 1], str) and kids[first - 1].tag in HEADINGS):
            first -= 1  # headings right above
        for i, k in enumerate(kids):
            if isinstance(k, str) or keep[i]:
                continue
            if first <= i <= last and k.tag in BETWEEN:
                keep[i] = k.tag in HEADINGS or _density(k) < 0.33
            elif k.tag in ("h1", "header"):  # the headline beside the container
                if headline is None:
                    headline = _has_h1(node)
                keep[i] = node is best or node is home or not headline
                headline = headline or keep[i]
        up.kids = [k for k, kept in zip(kids, keep) if kept]
        node = up
    return node


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; repeated rows
    get a row each, null ids and urls stay null, other columns are not read."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [extract(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text,
                                "n_chars": [len(t) for t in text]})

    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    return rows.select(ids_as_text("page_id"), F.col("url").cast("string"), F.col("html").cast("string")
                       ).mapInPandas(run, "page_id string, url string, text string, n_chars bigint").withColumn("page_id", F.col("page_id").cast("bigint"))
