"""Main text of web pages, by scoring the element tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCK - frozenset("body html legend option optgroup tbody td tfoot th thead tr".split()) | {"table"}
#: What an element's start ends, up to the container that keeps it apart.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no text of a page: code, media and the controls of forms.
DROPPED = frozenset(
    "head script style noscript template button select textarea input iframe object svg canvas audio video menu label datalist".split()
)
#: Elements around a main text.
OUTER = frozenset("nav footer aside form dialog fieldset".split())
#: Words of class, id and role names that mark what surrounds a text, and those that mark what readers say.
AROUND = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices alert modal popup overlay nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar side aside rail widget "
    "widgets footer masthead toolbar share sharing social related recommended newsletter subscribe subscription signup login "
    "search skip complementary contentinfo".split()
)
#: Those of them that no points overrule, unless the element holds the page's heading or main element; and such elements at all.
FIXED = frozenset("footer contentinfo nav navbar navigation menu breadcrumb breadcrumbs pagination pager".split())
NEVER = frozenset("nav footer dialog".split())
READERS = frozenset("comment comments respond reply replies disqus discussion".split())
#: Elements that hold points; and those that mark the article itself.
KEPT_WHOLE = frozenset("html body article main".split())
ARTICLES = frozenset(("article", "main"))
CONTAINERS = KEPT_WHOLE | {"div", "section"}
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
COMMA = re.compile("[,،、，]")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
#: So many ancestors get points of a block: all of them, half, then a share that falls with the level.
SHARES = (1.0, 1 / 2, 1 / 6, 1 / 9, 1 / 12)
#: Marked surroundings stay in if they hold so many times the points of all that is unmarked.
OVERRULED = 4.0


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "mark", "title", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, drop: bool, mark: str = ""):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.mark = mark  # "around", "fixed", "never", "readers" or none
        self.title = False  # whether it holds the page's heading or its main element
        self.children: list[Node | str] = []
        self.score, self.chars, self.linked = 0.0, 0, 0


def _marked(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> str:
    if tag in NEVER:
        return "never"
    if tag in OUTER or tag == "header" and not inside_article:
        return "around"
    if tag in KEPT_WHOLE:
        return ""
    found = ""
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            words = {w.lower() for w in SPLIT.split(value)}
            if words & READERS:
                return "readers"
            if words & AROUND:
                found = "fixed" if words & FIXED else found or "around"
        if name in ("hidden", "aria-hidden") and value != "false" or name == "style" and HIDDEN.search(value or ""):
            found = found or "around"
    return found


class Tree(HTMLParser):
    """An element tree; missing end tags are supplied as browsers do for paragraphs, list items and cells.

    For each tag the depths of its open elements are kept, so that what a start or end tag closes is
    found without going through all open elements.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None, False)
        self.open = [self.root]
        self.depths: dict[str, list[int]] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and self.depths.get(tag):
            return
        if tag in ENDS_P:
            self._close({"p"}, {"td", "th", "button", "table", "caption"})
        if tag in ENDS:
            while self._close(*ENDS[tag]):
                pass
        at = self.open[-1]
        if tag == "br":
            at.children.append(" ")
        inside = bool(self.depths.get("article") or self.depths.get("main"))
        node = Node(tag, at, at.drop or tag in DROPPED, _marked(tag, attrs, inside))
        at.children.append(node)
        if tag in ("h1", "main"):
            above: Node | None = node
            while above and not above.title:
                above.title = True
                above = above.parent
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in ("html", "body"):
            self._close({tag}, {"td", "th"} if tag not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot") else set())

    def handle_data(self, data: str) -> None:
        if not self.open[-1].drop:
            self.open[-1].children.append(data)

    # What the page's end cuts off is dropped, as browsers do; the base class would look for its end at each "<" again.

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find("-->", i + 2)
        return len(self.rawdata) if end < 0 else end + 3

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Browsers read ``<![...`` as a comment up to the next ``>``; the base class raises on unknown ones."""
        end = self.rawdata.find(">", i)
        return len(self.rawdata) if end < 0 else end + 1

    def parse_html_declaration(self, i: int) -> int:
        end = super().parse_html_declaration(i)
        return len(self.rawdata) if end < 0 else end

    def parse_pi(self, i: int) -> int:
        end = super().parse_pi(i)
        return len(self.rawdata) if end < 0 else end

    def parse_starttag(self, i: int) -> int:
        end = -1 if self.rawdata.find(">", i) < 0 else super().parse_starttag(i)
        return len(self.rawdata) if end < 0 else end

    def parse_endtag(self, i: int) -> int:
        end = -1 if self.rawdata.find(">", i) < 0 else super().parse_endtag(i)
        return len(self.rawdata) if end < 0 else end

    def _close(self, tags: set[str], barriers: set[str]) -> bool:
        """Closes the innermost open element of ``tags`` with all inside it, unless one of ``barriers`` stands between."""
        depth = max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)
        if not depth or any(d[-1] > depth for t in barriers if (d := self.depths.get(t))):
            return False
        for node in self.open[depth:]:
            self.depths[node.tag].pop()
        del self.open[depth:]
        return True


def _blocks(root: Node) -> list[tuple[Node, str, int]]:
    """The text blocks below ``root`` in page order: the block element of each, its text, and letters in links."""
    out: list[tuple[Node, str, int]] = []
    held: list[str] = []
    linked = [0]
    owner = [root]

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((owner[0], text, min(linked[0], len(text))))
            held.clear()
        linked[0] = 0

    todo: list[tuple[Node | str | None, Node, bool, bool]] = [(root, root, False, False)]
    while todo:
        item, block, link, closing = todo.pop()
        if closing:
            flush()
            owner[0] = block
        elif isinstance(item, str):
            owner[0] = block
            held.append(item)
            if link:
                linked[0] += len(" ".join(item.split()))
        elif item is not None and not item.drop:
            # what is marked stands apart from the text beside it
            own = item.tag in BLOCK or bool(item.mark)
            if own:
                flush()
                todo.append((None, block, link, True))
            inner, in_link = (item if own else block), link or item.tag == "a"
            todo.extend((c, inner, in_link, False) for c in reversed(item.children))
    flush()
    return out


def _points(owner: Node, text: str, linked: int) -> float:
    """1, 1 for each comma and up to 3 for the length, discounted by the share of links; headings get none."""
    return 0.0 if owner.tag in HEADINGS else (1 + len(COMMA.findall(text)) + min(len(text) / 100, 3)) * (1 - linked / len(text))


def _parents_first(root: Node) -> list[Node]:
    order = [root]
    for node in order:
        order += [c for c in node.children if isinstance(c, Node)]
    return order


def _without_surroundings(root: Node, blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks outside of marked elements, but for marks that the points overrule.

    A mark may sit on the page's own frame. An element whose points outside of marks within it are
    ``OVERRULED`` times those of all that is unmarked counts as unmarked, with those around it. What
    readers say does so only if it holds the page's heading or main element, or if no good paragraph
    stands outside of readers' marks, and this mark isn't within another one of them and has
    ``OVERRULED`` times the points of all others. Footers and menus never do, but for elements that are only
    called so and hold that heading.
    """
    under: dict[int, Node | None] = {}  # the innermost mark that each element stands in
    said: dict[int, int] = {}  # of each mark, how many of it and those around it are of readers
    fixed: dict[int, bool] = {}
    for node in _parents_first(root):
        above = under[id(node.parent)] if node is not root else None
        under[id(node)] = node if node.mark else above
        if node.mark:
            said[id(node)] = (node.mark == "readers" and not node.title) + (said[id(above)] if above is not None else 0)
            fixed[id(node)] = node.mark == "never" or node.mark == "fixed" and not node.title or above is not None and fixed[id(above)]
    held: dict[int, float] = {}
    marks: dict[int, Node] = {}
    free, good = 0.0, False
    for owner, text, linked in blocks:
        mark = under[id(owner)]
        points = _points(owner, text, linked)
        if mark is None or not (said[id(mark)] or fixed[id(mark)]):
            good = good or bool(points) and len(text) > 80 and 4 * linked < len(text)
        if mark is None:
            free += points
        else:
            marks[id(mark)] = mark
            held[id(mark)] = held.get(id(mark), 0.0) + points
    talk = sum(points for key, points in held.items() if said[key])
    for key in sorted(held, key=lambda k: -held[k]):
        mark: Node | None = marks[key]
        if held[key] <= OVERRULED * free:
            break
        if fixed[key] or said[key] and (good or said[key] > 1 or held[key] <= OVERRULED * (talk - held[key])):
            continue
        while mark is not None and mark.mark:  # those around one that gave way did, too
            mark.mark = ""
            free += held.get(id(mark), 0.0)
            mark = under[id(mark.parent)] if mark.parent is not None else None
    out_of = {id(root): False}
    for node in _parents_first(root)[1:]:
        out_of[id(node)] = bool(node.mark) or out_of[id(node.parent)]
    return [b for b in blocks if not out_of[id(b[0])]]


def main_text(html: str | None) -> str:
    """The main text: blocks of the best container and of those beside it that belong to it, one a line.

    A block passes 1 point, 1 for each comma and up to 3 for its length to its container, half to the
    next and less to those above, five at most; a container's points are discounted by its link
    density. Elements that are marked as surroundings, by their tag or names, take no part, unless
    nearly all points of the page lie in them. The best container is taken, or an ``article`` or
    ``main`` around it if less than half of what that adds is links; siblings are kept that score a
    fifth of its points, that hold a good paragraph, or that are its headings. Null, empty and
    textless pages give an empty string, and any markup gives some result: unknown declarations are
    comments, as in browsers. Time grows with the length of the page, whatever the depth.
    """
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    blocks = _without_surroundings(tree.root, _blocks(tree.root))
    if not blocks:
        return ""
    for owner, text, linked in blocks:
        owner.chars += len(text)
        owner.linked += linked
        points = _points(owner, text, linked)
        node: Node | None = owner if owner.tag in CONTAINERS else owner.parent or owner
        for share in SHARES:
            if node is None:
                break
            node.score += share * points
            node = node.parent
    order = _parents_first(tree.root)
    for node in reversed(order[1:]):
        node.parent.chars += node.chars
        node.parent.linked += node.linked
    worth = {id(n): n.score * (1 - n.linked / n.chars) for n in order if n.chars}
    within = {id(n) for n in order if n.chars and (n.tag in CONTAINERS or n.score)}
    best = max((n for n in order if id(n) in within), key=lambda n: worth[id(n)])
    inner, above = best, best
    while above is not None:
        chars, linked = above.chars - inner.chars, above.linked - inner.linked
        if above.tag in ARTICLES and 2 * linked <= chars:
            best = above
        above = above.parent
    chosen = [best]
    if best.parent is not None:
        limit = max(10.0, 0.2 * worth[id(best)])
        for other in best.parent.children:
            if not isinstance(other, Node) or other is best or not other.chars:
                continue
            density = other.linked / other.chars
            good = other.tag == "p" and (other.chars > 80 and density < 0.25 or density == 0)
            if worth[id(other)] >= limit or good or other.tag in HEADINGS or other.tag in ARTICLES:
                chosen.append(other)
    kept = {id(n) for top in chosen for n in _parents_first(top)}
    return "\n".join(text for owner, text, _ in blocks if id(owner) in kept)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars`` (code points) of each page's main text; one row per row.

    Nulls in the kept columns stay as they are, repeated ids keep their rows; other columns may have any name.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [main_text(h.as_py()) for h in batch.column(len(keep))]
            cols = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html_col).mapInArrow(batches, f"{kinds}, text string, n_chars long")
