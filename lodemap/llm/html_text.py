"""Main text of web pages by scoring the tree: paragraphs pass points to their ancestors, the best container is kept.

A paragraph has points for being there, for its commas and for its length. Its parent gets all of them, the
grandparent half, ancestors further up less. A container's points are discounted by the share of its letters that
are in links. The best container is kept, with such siblings as score a fifth of it at least.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.llm.common import python_batches, table, with_fields

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never part of an article.
DROPPED = frozenset("head script style noscript template svg math canvas iframe object nav footer aside form button select textarea dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"html", "body"}
PARAGRAPHS = frozenset("p pre blockquote li td dd h1 h2 h3 h4 h5 h6 figcaption".split())
#: Words in class, id or role that name what is no part of an article: menus, headers, footers, sidebars, notices, adverts, comments.
_SURROUNDINGS = """menu navbar navigation nav breadcrumb breadcrumbs toolbar header footer sidebar notice notices cookie cookies consent banner
ad ads advert adverts advertisement advertising sponsor sponsored promo promotion newsletter subscribe comment comments commentlist disqus replies popup share social"""
UNLIKELY = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(_SURROUNDINGS.split())})(?:$|[\s_-])", re.I)
#: Names are words put together with blanks, hyphens, underscores or capitals.
JOINT = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Words that say what a layout has beside something, not what it is.
BESIDE = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with|without)[_-][\w-]+", re.I)
#: Classes of an article's own containers.
CONTENT = frozenset("article article-body article-content body-content content entry entry-content main main-content page-content post post-body post-content story story-body".split())
#: Such words as a section's id may be its subject: only those poor in paragraph text are dropped for it.
SUBJECTS = frozenset("ads advertising banner cookies header menu navigation notice notices promotion replies share social toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
POOR_LETTERS = 140
#: Where less text than LITTLE letters is left and TIMES as much without the words, they have hit the article.
LITTLE, TIMES = 25, 10
SIBLING_SHARE = 0.2


class _Node:
    __slots__ = ("tag", "parent", "parts", "drop", "points", "letters", "linked", "unlikely", "held", "kind", "flow", "commas")

    def __init__(self, tag: str, parent: _Node | None, drop: bool):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.parts: list[_Node | str] = []
        self.points, self.letters, self.linked, self.held = 0.0, 0, 0, 0.0
        self.unlikely: str | None = None
        self.kind = ""
        self.flow = self.commas = 0


def _unlikely(tag: str, attrs: list[tuple[str, str | None]]) -> str | None:
    """Whether words mark a node as no part of an article: "name", "subject" where only its id does and could be a section's, or None."""
    if tag in HEADINGS or tag in ("article", "main"):
        return None
    values = {name: BESIDE.sub("", JOINT.sub("-", value)) for name, value in attrs if value and name in ("class", "id", "role", "aria-label")}
    if CONTENT & {word.lower() for name, value in attrs if name == "class" and value for word in (*value.split(), *JOINT.sub("-", value).split())}:
        return None
    hits = [name for name, value in values.items() if UNLIKELY.search(value)]
    if hits == ["id"] and values["id"].strip().lower() in SUBJECTS:
        return "subject"
    return "name" if hits else None


#: What a stray inline end tag does not reach across.
REGIONS = ("article", "main", "nav", "aside", "footer", "form", "table")


class _Tree(HTMLParser):
    """Builds nodes from tags as browsers would: open paragraphs and list items end where another block begins.

    The places of open tags are kept by name, so a tag costs the same however deep it stands; a node is closed once.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("html", None, False)
        self.open: list[_Node] = [self.root]
        self.places: dict[str, list[int]] = {}
        self.marked: list[_Node] = []

    def _deepest(self, tags) -> int:
        """The place of the innermost open tag among `tags`; 0, the root's, for none."""
        return max((places[-1] for t in tags if (places := self.places.get(t))), default=0)

    def _close(self, place: int) -> None:
        """Close the node at a place and all within it."""
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()

    def _end(self, tags, stop) -> None:
        if (place := self._deepest(tags)) > self._deepest(stop):
            self._close(place)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P:
            self._end(("p",), ("td", "th", "button", "article", "section", "div", "table"))
        if tag in ("td", "th"):
            self._end(("td", "th"), ("tr", "table"))
        elif tag in ("dd", "dt"):
            self._end(("dd", "dt"), ("ul", "ol", "dl", "table", "select"))
        elif tag in ("li", "tr", "option"):
            self._end((tag,), ("ul", "ol", "dl", "table", "select"))
        drop = tag in DROPPED
        for name, value in attrs:
            drop |= name == "hidden" or (name == "aria-hidden" and value == "true")
        if tag == "header":
            drop |= not self._deepest(("article", "main"))
        node = _Node(tag, self.open[-1], drop)
        node.kind = " ".join(value for name, value in attrs if name == "class" and value)
        if not drop and (word := _unlikely(tag, attrs)):
            node.unlikely = word
            self.marked.append(node)
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and len(self.open) > 1 and self.open[-1].tag == tag:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        place = self._deepest((tag,))
        if place and (tag in BLOCKS or tag in DROPPED or place >= self._deepest(REGIONS)):
            self._close(place)

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def _blocks(top: _Node) -> list[str]:
    """Texts of the blocks below a node, in page order, without what is dropped."""
    found: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if text := " ".join("".join(line).split()):
                found.append(text)
            line.clear()

    stack: list[_Node | str | None] = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif not x.drop or x is top:
            if x.tag == "br":
                line.append(" ")
                continue
            if x.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(x.parts))
    flush()
    return found


def _score(root: _Node) -> list[_Node]:
    """Set letters, linked letters and points of every node that is not dropped; the containers with points."""
    order: list[tuple[_Node, bool]] = []
    stack = [(root, False)]
    while stack:
        node, linked = stack.pop()
        if node.drop:
            continue
        order.append((node, linked))
        stack.extend((x, linked or x.tag == "a") for x in node.parts if not isinstance(x, str))
    containers: dict[int, _Node] = {}
    for node, linked in reversed(order):  # children before parents
        own, commas, lone = 0, 0, node.tag in PARAGRAPHS  # text of its own and of what is inline in it
        for x in node.parts:
            if isinstance(x, str):
                n = len(" ".join(x.split()))
                own += n
                commas += x.count(",")
                node.linked += n * linked
        node.letters += own
        own, commas = own + node.flow, commas + node.commas
        if node.parent is not None and node.tag not in BLOCKS:
            node.parent.flow += own
            node.parent.commas += commas
        if node.parent is not None:
            node.parent.letters += node.letters
            node.parent.linked += node.linked
        if node.letters and (lone or own and node.tag in BLOCKS):
            points = (1 + commas + min(3.0, node.letters / 100)) * (1 - node.linked / node.letters)
            node.held += points
            up = node.parent if lone and node.parent is not None else node
            share, depth = 1.0, 0
            while up is not None and depth < 6:
                up.points += points * share
                containers[id(up)] = up
                depth += 1
                share = 1 / 2 if depth == 1 else 1 / (3 * depth)
                up = up.parent
        if node.parent is not None:
            node.parent.held += node.held
    return list(containers.values())


def _cleared(root: _Node) -> None:
    """Forget what `_score` set."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.points, node.letters, node.linked, node.held, node.flow, node.commas = 0.0, 0, 0, 0.0, 0, 0
        stack.extend(x for x in node.parts if not isinstance(x, str))


def _drop_unlikely(tree: _Tree) -> None:
    """Drop the marked nodes but those that hold most of the page's points, and sections rich in text that only an id marks."""
    _score(tree.root)
    for node in tree.marked:
        poor = node.unlikely == "name" or node.letters - node.linked < POOR_LETTERS
        node.drop = poor and 2 * node.held <= tree.root.held
    _cleared(tree.root)


def main_text(html: str | None) -> str:
    """The blocks of the article joined by two line ends; empty for null and for a page without text.

    All of the page is read. Character references are decoded, white space inside a block becomes one space.
    """
    if not html:
        return ""
    tree = _Tree()
    if html.rfind("<!--") > html.rfind("-->"):
        html += "-->"  # a comment that never ends hides the rest of the page
    tree.feed(html.replace("<![", "<!-["))
    tree.close()
    if not tree.marked:
        return _main(tree)
    _drop_unlikely(tree)
    text = _main(tree)
    if len(text) < LITTLE:
        for node in tree.marked:
            node.drop = False
        _cleared(tree.root)
        if len(whole := _main(tree)) >= TIMES * max(LITTLE, len(text)):
            return whole
    return text


def _holds(top: _Node, tag: str) -> bool:
    stack = [top]
    while stack:
        node = stack.pop()
        if node.tag == tag and not node.drop:
            return True
        stack.extend(x for x in node.parts if not isinstance(x, str))
    return False


def _main(tree: _Tree) -> str:
    """The blocks of the best container of a tree and of its siblings."""
    found = _score(tree.root)
    if not found:
        return "\n\n".join(_blocks(tree.root))
    worth = lambda n: n.points * (1 - n.linked / n.letters if n.letters else 1)
    best = max(reversed(found), key=worth)
    region = best  # an article or main around the best container is the container
    while region is not None and region.tag not in ("article", "main"):
        region = region.parent
    best = region or best
    if best.parent is None:
        return "\n\n".join(_blocks(best))
    kept, least = [], SIBLING_SHARE * worth(best)
    titled, before = _holds(best, "h1"), True
    for x in best.parent.parts:
        if isinstance(x, str) or x.drop:
            continue
        before = before and x is not best
        if before and x.tag == "h1" and not titled:
            kept += _blocks(x)  # the title of a container that has none
        elif x is best or (worth(x) >= least and x.points > 0 and (region is None or x.tag == best.tag)):
            kept += _blocks(x)
        elif x.tag == best.tag and (x.tag == "section" or x.kind and x.kind == best.kind) and 2 * x.linked <= x.letters:
            kept += _blocks(x)  # sections of one article, however short
        elif region is None and x.tag == "p" and x.letters > 80 and x.linked < 0.25 * x.letters:
            kept += _blocks(x)
    return "\n\n".join(kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with main_text added (a column of this name in `pages` is replaced), by `main_text`.

    Rows, repeated ones too, stay as they are. Null, empty and textless pages have an empty text. A page is read whole,
    in time in proportion to its length, however deep or unclosed its tags. Of containers with equal points the first stands.
    """

    @F.pandas_udf("main_text string")
    def texts(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"main_text": pd.Series([main_text(x) for x in column], dtype="object")})

    return with_fields(pages, texts(F.col(html)), ["main_text"])


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    python_batches(spark)
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
