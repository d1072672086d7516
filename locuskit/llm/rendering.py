"""Layout-aware text of HTML pages.

A tokenizer's events build a tree with implied start and end tags; visibility rules drop
what a browser would not show; the rest is written as blocks, list items and aligned cells.
Tree building and writing use loops with their own stacks, so depth is not limited.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from locuskit.llm.common import prepare

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary
    table ul""".split())
SPACED = frozenset("article blockquote dl figure h1 h2 h3 h4 h5 h6 menu ol p pre section table ul".split())
HIDDEN = frozenset("""area audio base canvas datalist embed head iframe link meta noembed noframes noscript object
    param script source style svg template textarea title track video""".split())
#: An open element of these ends when one of those starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
        "tr": {"tr", "thead", "tbody", "tfoot"}, "td": {"td", "th", "tr", "thead", "tbody", "tfoot"},
        "th": {"td", "th", "tr", "thead", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"},
        "tbody": {"tbody", "tfoot"}, "tfoot": {"tbody"}, "caption": {"tr", "thead", "tbody", "tfoot", "colgroup"},
        "colgroup": {"tr", "thead", "tbody", "tfoot"}}
#: An implied end does not reach beyond these.
WALLS = frozenset(["ul", "ol", "menu", "dl", "table", "select", "div", "body"])
#: What starts a tag's implied end looks no further than these for an open paragraph.
PARAGRAPH_WALLS = ("td", "th", "caption", "table", "button")
#: tag: the open elements it ends.
ENDED_BY = {t: [h for h, ends in ENDS.items() if t in ends] for t in set().union(*ENDS.values())}
#: Largest spans of a cell.
COLSPAN, ROWSPAN = 1000, 65534
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!important\s*)?(?:;|$)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\s*(?:!important\s*)?(?=;|$)", re.I)
_SELECTOR = re.compile(r"^([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+)*)$", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class Tree(HTMLParser):
    """Builds ``root``; never raises on broken markup."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open, self.at, self.styles = [self.root], {"html": [0]}, []

    def _pop(self) -> None:
        self.at[self.open.pop().tag].pop()

    def _push(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(node)

    def _last(self, tags) -> int:
        """Where the innermost open element of these tags is; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _close_for(self, tag: str) -> None:
        if tag in BLOCK and self._last(["p"]) > self._last(PARAGRAPH_WALLS):  # a block ends an open paragraph
            self.handle_endtag("p")
        while self._last(ENDED_BY.get(tag, ())) > self._last(WALLS):
            upto = self._last(ENDED_BY[tag])
            while len(self.open) > upto:
                self._pop()

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            self.open[0].attrs.update(attrs)
            while tag == "body" and self.at.get("head"):
                self._pop()
            return
        self._close_for(tag)
        top = self.open[-1].tag
        if tag == "tr" and top == "table":
            self._push("tbody", {})
        elif tag in ("td", "th") and top in ("table", "thead", "tbody", "tfoot"):
            if top == "table":
                self._push("tbody", {})
            self._push("tr", {})
        if tag in VOID:
            self.open[-1].children.append(Node(tag, dict(attrs)))
        else:
            self._push(tag, dict(attrs))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
        if tag in ("html", "body") or not self.at.get(tag):
            return
        while self.open[-1].tag != tag:
            self._pop()
        self._pop()

    def handle_data(self, data):
        if self.open[-1].tag == "style":
            self.styles.append(data)
        self.open[-1].children.append(data)


def _rules(sheet: str) -> list[tuple[str, frozenset, frozenset, str]]:
    """(tag or empty, classes, ids, declarations) of a sheet's plain rules.

    Selectors of a tag, classes and ids are known; those with combinators, attributes or
    pseudo-classes, and whole at-rules (they hold under conditions), are passed over.
    """
    out, depth, start, head = [], 0, 0, ""
    sheet = re.sub(r"/\*.*?(?:\*/|$)", " ", sheet, flags=re.S)
    for at, c in enumerate(sheet):
        if c == "{":
            if depth == 0:
                head, start = sheet[start:at].strip(), at + 1
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                if not head.startswith("@"):
                    for one in head.split(","):
                        found = _SELECTOR.match(one.strip())
                        if found and one.strip():
                            names = re.findall(r"[.#][\w-]+", found[2])
                            out.append(((found[1] or "").lower().replace("*", ""), frozenset(n[1:] for n in names if n[0] == "."),
                                        frozenset(n[1:] for n in names if n[0] == "#"), sheet[start:at]))
                start = at + 1
        elif c == ";" and depth == 0:  # an at-rule without a block
            start = at + 1
    return [r for r in out if _GONE.search(r[3]) or _VISIBILITY.search(r[3])]


class Sight:
    """Which elements a page shows, by its attributes, style attributes and style sheets."""

    def __init__(self, sheets: list[str]):
        self.rules = [r for sheet in sheets for r in _rules(sheet)]

    def _styles(self, node: Node) -> list[str]:
        """Declarations that hold for the element, its own last."""
        a, out = node.attrs, []
        if self.rules:
            classes, own = frozenset((a.get("class") or "").split()), frozenset([a.get("id") or ""])
            out = [d for tag, cs, ids, d in self.rules if tag in ("", node.tag) and cs <= classes and ids <= own]
        return [*out, a.get("style") or ""]

    def gone(self, node: Node) -> bool:
        """Not shown, and nothing inside either."""
        a = node.attrs
        return (node.tag in HIDDEN or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true"
                or (node.tag == "dialog" and "open" not in a) or any(_GONE.search(s) for s in self._styles(node))
                or (node.tag == "input" and (a.get("type") or "").lower() == "hidden"))

    def seen(self, node: Node, around: bool) -> bool:
        """Whether its text is visible; inherited unless it says otherwise."""
        for style in self._styles(node):
            for word in _VISIBILITY.findall(style):
                around = word.lower() == "visible"
        return around

    def children(self, node: Node) -> list:
        """Its children; of a closed ``details`` the summary only."""
        if node.tag == "details" and "open" not in node.attrs:
            first = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
            return first
        return node.children


class _Page:
    """Lines of text with collapsed blanks and pending breaks."""

    def __init__(self):
        self.parts, self.line, self.gap, self.raw = [], [], 0, False

    def text(self, data: str, pre: bool) -> None:
        if pre:
            self.raw = True
            first, *rest = data.split("\n")
            self._add(first)
            for r in rest:
                self.end(1, True)
                self._add(r)
            return
        self._add(_BLANKS.sub(" ", data))

    def _add(self, data: str) -> None:
        if data and not (data == " " and not self.line):
            self.line.append(data)

    def end(self, gap: int, forced: bool = False) -> None:
        now = "".join(self.line)
        self.line = []
        now = now.rstrip() if self.raw else re.sub(" {2,}", " ", now).strip(" ")
        self.raw = self.raw and forced
        if now.strip():
            if self.parts:
                self.parts.append("\n" * max(self.gap, 1))
            self.parts.append(now)
            self.gap = 0
        elif forced and self.parts:
            self.gap = min(max(self.gap, 1) + 1, 2)
        self.gap = max(self.gap, gap)

    def block(self, text: str) -> None:
        self.end(1)
        if text:
            if self.parts:
                self.parts.append("\n" * max(self.gap, 1))
            self.parts.append(text)
            self.gap = 0


#: A column with a longer cell holds running text: it ends its line and is not padded.
RUNNING = 200


def _aligned(rows: list[list[tuple[int, str]]]) -> str:
    """Cells (column, text) padded to their column's width, two blanks apart."""
    width: dict[int, int] = {}
    for row in rows:
        for column, c in row:
            width[column] = max(width.get(column, 0), len(c))
    order = {column: i for i, column in enumerate(sorted(width))}  # columns in which a cell begins
    size = [width[c] for c in sorted(width)]
    lines = []
    for row in rows:
        line, at = [], 0
        for column, c in row:
            for i in range(at, order[column]):
                line.append(" " * (size[i] if size[i] <= RUNNING else 0))
            at = order[column] + 1
            if size[at - 1] <= RUNNING:
                line.append(c.ljust(size[at - 1]))
            else:
                line.append(c)
                lines.append("  ".join(line).rstrip())
                line = []
        lines.append("  ".join(line).rstrip())
    return "\n".join(x for x in lines if x)


def _span(cell: Node, name: str, most: int, none: int) -> int:
    """A span attribute as browsers read it; ``none`` where it is 0."""
    found = re.match(r"\s*\+?(\d{1,9})", cell.attrs.get(name) or "")
    n = int(found[1]) if found else 1
    return min(n, most) if n else none


def _cells(table: Node, sight: Sight, seen: bool) -> tuple[list, list[list[tuple[int, Node, bool]]]]:
    """What stands outside of cells, and the cells (column, node, visible) row by row.

    A cell takes the next column that no cell above still reaches into.
    """
    outside, rows, todo = [], [], [(c, seen) for c in reversed(table.children)]
    reach: list[tuple[int, int, int]] = []  # (first column, behind the last, rows left)
    while todo:
        x, vis = todo.pop()
        if isinstance(x, str):
            if x.strip():
                outside.append((x, vis))
        elif sight.gone(x):
            continue
        elif x.tag == "tr":
            vis, row, column, taken = sight.seen(x, vis), [], 0, sorted(reach)
            reach = [(a, b, n - 1) for a, b, n in reach if n > 1]
            at = 0
            for c in x.children:
                if not (isinstance(c, Node) and c.tag in ("td", "th")):
                    if not (isinstance(c, str) and not c.strip()):
                        outside.append((c, vis))
                    continue
                if sight.gone(c):
                    continue
                while at < len(taken) and taken[at][0] <= column:
                    column, at = max(column, taken[at][1]), at + 1
                behind = column + _span(c, "colspan", COLSPAN, 1)
                down = _span(c, "rowspan", ROWSPAN, ROWSPAN)
                if down > 1:
                    reach.append((column, behind, down - 1))
                row.append((column, c, sight.seen(c, vis)))
                column = behind
            rows.append(row)
        elif x.tag in ("thead", "tbody", "tfoot"):
            reach = []  # a cell does not reach out of its group
            todo += [(c, sight.seen(x, vis)) for c in reversed(x.children)]
        else:
            outside.append((x, vis))
    return outside, rows


def _numbers(ol: Node) -> dict[int, int]:
    """The number of each item of an ordered list, by its identity."""
    def whole(text: str | None, other: int) -> int:
        found = re.match(r"\s*([+-]?\d{1,9})", text or "")
        return int(found[1]) if found else other
    items = [c for c in ol.children if isinstance(c, Node) and c.tag == "li"]
    step = -1 if "reversed" in ol.attrs else 1
    n, out = whole(ol.attrs.get("start"), len(items) if step < 0 else 1), {}
    for li in items:
        n = whole(li.attrs.get("value"), n)
        out[id(li)], n = n, n + step
    return out


def _written(children: list, sight: Sight, seen: bool) -> str:
    """Visible text of nodes; nested tables are written before the table around them."""
    # a frame: page, stack of (node or text, entering, preformatted, visible), and where its text goes
    results: list[str] = []
    frames = [(_Page(), [(c, True, False, seen) for c in reversed(children)], None)]
    numbers: dict[int, int] = {}
    while frames:
        page, todo, done = frames[-1]
        if not todo:
            page.end(1)
            frames.pop()
            text = "".join(page.parts)
            (results.append if done is None else done)(text)
            continue
        x, entering, pre, vis = todo.pop()
        if isinstance(x, str):
            if vis:
                page.text(x, pre)
            continue
        if not entering:
            if x.tag == "#table":
                grid = x.attrs["grid"]
                page.block(_aligned([[(column, " ".join(c.split())) for column, c in row] for row in grid]))
                page.end(2)
            else:
                page.end(2 if x.tag in SPACED and pre is not None else 1)
            continue
        if sight.gone(x):
            continue
        vis = sight.seen(x, vis)
        if x.tag == "br":
            page.end(1, True)
        elif x.tag == "img":
            if vis:
                page.text(x.attrs.get("alt") or "", False)
        elif x.tag == "table":
            page.end(2)
            outside, rows = _cells(x, sight, vis)
            grid = [[(column, "") for column, _, _ in row] for row in rows]
            todo.append((Node("#table", {"grid": grid}), False, pre, vis))
            todo += [(c, True, pre, v) for c, v in reversed(outside)]
            for i, row in enumerate(rows):
                for j, (column, cell, v) in enumerate(row):
                    frames.append((_Page(), [(c, True, False, v) for c in reversed(cell.children)],
                                   lambda t, i=i, j=j, c=column, grid=grid: grid[i].__setitem__(j, (c, t))))
        elif x.tag in BLOCK:
            page.end(2 if x.tag in SPACED else 1)
            if x.tag == "ol":
                numbers.update(_numbers(x))
            if x.tag == "li" and vis:
                page.text(f"{numbers[id(x)]}. " if id(x) in numbers else "- ", False)
            todo.append((x, False, pre, vis))
            todo += [(c, True, pre or x.tag == "pre", vis) for c in reversed(sight.children(x))]
        else:
            todo += [(c, True, pre, vis) for c in reversed(x.children)]
    return results[0]


def render(html: str | None) -> str:
    """The visible text of a page; null and empty pages have none."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    sight = Sight(tree.styles)
    return "" if sight.gone(tree.root) else _written(tree.root.children, sight, sight.seen(tree.root, True))


def rendered(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(*keep, rendered_text) of every page; no shuffle.

    Null and empty pages give an empty text; repeated rows and null ids pass through, and an
    empty table gives an empty result. Very long pages are written whole; neither depth, width
    nor the number of cells is limited. Of other columns only those in ``keep`` are returned.
    """
    prepare(pages.sparkSession)
    shape = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            texts = [render(h) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(texts, pa.string())],
                                             names=[*keep, "rendered_text"])
    return pages.select(*[f"`{c}`" for c in keep], html).mapInArrow(run, f"{shape}, rendered_text string")
