"""Layout-aware HTML rendering: a tree builder with implied tags, visibility rules, and block layout.

Tasks parse whole pages in one pass over their tags. The builder supplies what authors leave out (ends of ``p``,
``li``, ``dt``/``dd``, ``option`` and table parts, ``tbody`` and ``tr``, everything open at the end) and ignores end
tags without a start. Text is visible unless an ancestor is a script, style, template or the like, has ``hidden``,
``aria-hidden="true"``, or an inline style that hides it. Options, text areas, SVG and formula text, the fallback of
``object`` and open dialogs are visible. Layout holds at any depth. The renderer keeps a line of its own for every block, a blank
line around paragraphs, headings, lists and tables, markers and indentation for list items, line ends of ``br`` and
``pre``, and pads the cells of a table so that its columns stand under each other, ``colspan`` and ``rowspan`` included.
The tags of a page are found in one pass that never looks at a character more than a few times, whatever is left open.

Defined results: null and empty pages give an empty text. Broken markup never fails: what cannot be a tag is text, an
unclosed comment ends the page. Tables within tables are laid out on their own inside their cell; what stands in a table but in no cell goes before its rows. Repeated rows are
rendered each on its own. A cell spans at most 1000 columns. Extra columns aren't read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What browsers hide. ``noscript`` is hidden by choice (as where scripts run); so is what a closed ``dialog`` holds.
UNSEEN = frozenset("head title script style template noscript noframes noembed iframe canvas audio video datalist defs desc metadata symbol annotation annotation-xml".split())
RAW = frozenset("script style textarea title template noscript iframe xmp".split())
#: Raw elements that are shown, and elements that keep their line ends.
SHOWN_RAW, PRE = frozenset("textarea xmp".split()), frozenset("pre textarea xmp".split())
#: What may stand in ``head``; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
_RAW_END = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in RAW}
#: Lines of their own that leave an open ``p`` open.
CONTROLS = frozenset("select optgroup option textarea text".split())
BLOCK = CONTROLS | frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main nav ol p pre section summary table ul xmp caption thead tbody tfoot tr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
#: A start tag of the key ends, group by group, the nearest open element of the group, unless one of ``SCOPE`` stands between.
_CELL, _PART = ("td", "th", "caption"), ("tbody", "thead", "tfoot")
ENDS = {"li": (("li",),), "dt": (("dt", "dd"),), "dd": (("dt", "dd"),), "option": (("option",),), "optgroup": (("option",), ("optgroup",)), "td": (_CELL,), "th": (_CELL,), "tr": (_CELL, ("tr",)),
        **dict.fromkeys(_PART, (_CELL, ("tr",), _PART))}
SCOPE = frozenset("table ul ol dl select body html".split())
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)
_OPENS, _NAME_END, _EVENT = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])"), re.compile(r"[\s/>]"), re.compile(r"[>\"']")
#: Nearly all tags: short names and attributes, at a bounded cost where it fails.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]{0,31}+)(?=[\s/>])((?:[^>\"']{1,200}+|\"[^\"]{0,200}+\"|'[^']{0,200}+'){0,16}+)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_LONG = re.compile(r"&#([0-9]{9,})")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "kids", "seen", "start", "across", "down")

    def __init__(self, tag: str, seen: bool, start: int = 1, across: int = 1, down: int = 1):
        self.tag, self.seen, self.start, self.across, self.down = tag, seen, start, across, down
        self.kids: list[Node | str] = []


def _unescaped(text: str) -> str:
    """Character references resolved; numbers too long for any character become the replacement character."""
    return html.unescape(_LONG.sub(lambda m: f"&#{m[1].lstrip('0')[:9] or 0}", text)) if "&" in text else text


def _number(text: str, other: int = 1) -> int:
    return int(text) if text.isascii() and text.isdigit() and len(text) < 9 else other


class _Ahead:
    """The first match of a pattern from a position on, found once for all positions before it."""

    def __init__(self, pattern: re.Pattern, page: str):
        self.pattern, self.page, self.since, self.match = pattern, page, 0, -1

    def __call__(self, at: int) -> int:
        if not self.since <= at <= self.match:
            found = self.pattern.search(self.page, at)
            self.since, self.match = at, found.start() if found else len(self.page)
        return self.match


def _tags(page: str):
    """(start, end, slash, name, attributes) of every tag, and (start, end, None, "", "") of comments and declarations.

    The sender may skip text by sending the position to go on from. A quote that opens outside of quotes and leads to
    no tag end is remembered, so another tag that runs into it is known to be text."""
    name_end, event, dead = _Ahead(_NAME_END, page), _Ahead(_EVENT, page), set()
    last, at = page.rfind(">"), 0
    while m := _OPENS.search(page, at):
        start, at = m.start(), m.end()
        if page.startswith("<!--", start):
            end = page.find("-->", at)
            at = (yield start, len(page) if end < 0 else end + 3, None, "", "") or (len(page) if end < 0 else end + 3)
            continue
        if start > last:
            return
        if page[start + 1] in "!?":
            end = page.find(">", at) + 1
            at = (yield start, end, None, "", "") or end
            continue
        if plain := _PLAIN.match(page, start):
            at = (yield start, plain.end(), bool(plain[1]), plain[2].lower(), plain[3]) or plain.end()
            continue
        name = name_end(at)
        look, quotes, end = name, [], -1
        while (e := event(look)) < len(page) and e not in dead:
            if page[e] == ">":
                end = e
                break
            quotes.append(e)
            if (shut := page.find(page[e], e + 1)) < 0:
                break
            look = shut + 1
        if end < 0:
            dead.update(quotes)
            continue
        slash = page[start + 1] == "/"
        at = (yield start, end + 1, slash, page[start + 1 + slash:name].lower(), page[name:end]) or end + 1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): _unescaped(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def build(page: str) -> Node:
    """The tree of a page."""
    root = Node("html", True)
    stack = [root]
    #: Positions of the open elements in the stack, by tag.
    opened: dict[str, list[int]] = defaultdict(list)

    def cut(at: int) -> None:
        for node in reversed(stack[at:]):
            opened[node.tag].pop()
        del stack[at:]

    def deepest(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def close(tags: tuple[str, ...], scope: frozenset[str]) -> None:
        """End the nearest open element of ``tags``, unless one of ``scope`` is open inside it."""
        at = deepest(tags)
        if at and at >= deepest(scope):
            cut(at)

    def begin(tag: str, text: str) -> None:
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            cut(len(stack) - 1)
        if tag in ("html", "body"):
            return
        if tag in ENDS:
            for group in ENDS[tag]:
                close(group, SCOPE)
        elif opened.get("p") and tag in BLOCK and tag not in CONTROLS:
            close(("p",), SCOPE | {"td", "th", "li", "div", "article", "section"})
        # Table parts that authors leave out.
        if tag == "tr" and stack[-1].tag == "table":
            begin("tbody", "")
        elif tag in ("td", "th"):
            if stack[-1].tag == "table":
                begin("tbody", "")
            if stack[-1].tag in ("tbody", "thead", "tfoot"):
                begin("tr", "")
        given = _attributes(text)
        seen = tag not in UNSEEN and (tag != "dialog" or "open" in given) and "hidden" not in given and given.get("aria-hidden") != "true" and not HIDING.search(given.get("style", ""))
        node = Node(tag, seen, _number(given.get("start", "")), min(max(_number(given.get("colspan", "")), 1), 1000), max(_number(given.get("rowspan", "")), 1))
        stack[-1].kids.append(node)
        # A form straight inside a table holds nothing.
        if tag not in VOID and not text.rstrip().endswith("/") and not (tag == "form" and stack[-1].tag in ("table", "tr", *_PART)):
            opened[tag].append(len(stack))
            stack.append(node)

    def put(text: str) -> None:
        if stack[-1].tag == "head" and text.strip():
            cut(len(stack) - 1)
        stack[-1].kids.append(text)

    at, skip, tags = 0, None, _tags(page)
    while True:
        try:
            start, end, slash, tag, text = tags.send(skip)
        except StopIteration:
            break
        skip = None
        if start > at:
            put(_unescaped(page[at:start]))
        at = end
        if slash:
            close((tag,), frozenset() if tag in ("table", "div", "article", "section", "body") else frozenset({"table", "td", "th"}) - {tag})
        elif tag:
            begin(tag, text)
            if tag in RAW and stack[-1].tag == tag:
                found = _RAW_END[tag].search(page, at)
                # Raw text is never markup.
                start, at = at, found.start() if found else len(page)
                if tag in SHOWN_RAW:
                    raw = page[start:at].removeprefix("\n")
                    stack[-1].kids.append(_unescaped(raw) if tag == "textarea" else raw)
                cut(len(stack) - 1)
                if found:
                    close_at = page.find(">", at)
                    at = len(page) if close_at < 0 else close_at + 1
                skip = at
    if at < len(page):
        put(_unescaped(page[at:]))
    return root


def _width(text: str) -> int:
    """Columns a text takes; wide characters take two."""
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


class Page:
    """Lines of one rendered region."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        #: Parts of the line that is being filled.
        self.line: list[str] = []
        self.gap = self.blank = False

    def text(self, text: str) -> None:
        pieces = _SPACE.split(text)
        if self.line and not pieces[0]:
            self.gap = True
        words = list(filter(None, pieces))
        if words:
            if self.gap:
                self.line.append(" ")
            self.line.append(" ".join(words))
            self.gap = not pieces[-1]

    def end(self, spaced: bool = False) -> None:
        if self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.lines.append("".join(self.line))
            self.blank = False
        self.line, self.gap = [], False
        self.blank = self.blank or spaced

    def put(self, lines: list[str]) -> None:
        if lines:
            if self.blank and self.lines:
                self.lines.append("")
            self.lines += lines
            self.blank = False

    def nodes(self, node: Node):
        """Put the children of ``node``. Whatever needs a region of its own is yielded, and its lines are sent back."""
        # Open elements: children, keep, next number, spacing at the end (None: not a block).
        stack: list[list] = [[node, iter(node.kids), False, node.start, None]]
        while stack:
            top = stack[-1]
            kid = next(top[1], None)
            if kid is None:
                stack.pop()
                if top[4] is not None:
                    self.end(top[4])
            elif isinstance(kid, str):
                if top[2]:
                    first, *rest = kid.split("\n")
                    self.line += [first] if first else []
                    for part in rest:
                        self.put(["".join(self.line)])
                        self.line = [part] if part else []
                else:
                    self.text(kid)
            elif kid.seen:
                tag, marker = kid.tag, f"{top[3]}. " if top[0].tag == "ol" else "- "
                top[3] += tag == "li"
                if tag == "br":
                    if self.line:
                        self.end()
                    else:
                        self.blank = True
                elif tag == "hr":
                    self.end()
                    self.put(["---"])
                elif tag == "table":
                    self.end(True)
                    self.put((yield _table(kid)))
                    self.end(True)
                elif tag in ("li", "dd", "blockquote"):
                    self.end(tag == "blockquote")
                    lead = marker if tag == "li" else "    " if tag == "dd" else "> "
                    inner = yield _lines(kid)
                    self.put([(lead if k == 0 or tag == "blockquote" else " " * len(lead) if x else "") + x for k, x in enumerate(inner)])
                    self.end(tag == "blockquote")
                elif tag in BLOCK:
                    # A list inside an item stays with it.
                    spaced = tag in SPACED and not (tag in ("ul", "ol") and self.lines and not self.blank and self.nested)
                    self.end(spaced)
                    stack.append([kid, iter(kid.kids), top[2] or tag in PRE, kid.start, spaced])
                else:
                    stack.append([kid, iter(kid.kids), top[2], kid.start, None])

    nested = False


def _lines(node: Node):
    page = Page()
    page.nested = node.tag == "li"
    yield from page.nodes(node)
    page.end()
    return page.lines


def _region(node: Node) -> list[str]:
    """Regions within regions, by a stack of their own: pages may be nested to any depth."""
    stack, sent = [_lines(node)], None
    while stack:
        try:
            stack.append(stack[-1].send(sent))
            sent = None
        except StopIteration as end:
            stack.pop()
            sent = end.value
    return sent


def _around(node: Node) -> Node:
    """A region with this one child, so that the child's own layout holds."""
    region = Node("div", True)
    region.kids.append(node)
    return region


def _table(table: Node):
    """Caption, then rows whose cells are padded to the width of their column."""
    rows, caption, todo = [], [], list(reversed(table.kids))
    while todo:
        kid = todo.pop()
        if isinstance(kid, str):
            if kid.strip():
                caption.append(" ".join(kid.split()))
        elif kid.seen:
            if kid.tag == "tr":
                row = []
                for c in kid.kids:
                    # What stands in a row but in no cell goes before the table, as in browsers.
                    if isinstance(c, str):
                        caption += [" ".join(c.split())] if c.strip() else []
                    elif c.seen and c.tag in ("td", "th"):
                        row.append(((yield _lines(c)) or [""], c.across, c.down))
                    elif c.seen:
                        caption += (yield _lines(_around(c)))
                rows.append(row)
            elif kid.tag in ("thead", "tbody", "tfoot"):
                todo += reversed(kid.kids)
            else:
                caption += (yield _lines(kid if kid.tag == "caption" else _around(kid)))
    placed = _placed(rows)
    widths: dict[int, int] = {}
    # Cells of one column first; a wider cell then widens the last column it spans.
    for row in placed:
        for k, across, cell in row:
            if across == 1:
                widths[k] = max(widths.get(k, 0), *map(_width, cell))
    for row in placed:
        for k, across, cell in row[:-1]:
            if across > 1:
                held = sum(widths.get(j, 0) for j in range(k, k + across)) + 2 * (across - 1)
                last = k + across - 1
                widths[last] = widths.get(last, 0) + max(0, max(map(_width, cell)) - held)
    starts = {0: 0}
    for k in range(1, 1 + max((row[-1][0] for row in placed if row), default=0)):
        starts[k] = starts[k - 1] + widths.get(k - 1, 0) + 2
    lines = list(caption)
    for row in placed:
        for n in range(max((len(cell) for _, _, cell in row), default=0)):
            line, filled = [], 0
            for k, _, cell in row:
                if n < len(cell) and cell[n]:
                    line += [" " * (starts[k] - filled), cell[n]]
                    filled = max(filled, starts[k]) + _width(cell[n])
            lines.append("".join(line).rstrip())
    return lines


def _placed(rows: list[list[tuple]]) -> list[list[tuple]]:
    """(column, columns spanned, lines) of the cells of each row; columns that a cell above still covers are passed over."""
    done, covered = [], {}
    for row in rows:
        out, k = [], 0
        for cell, across, down in row:
            while covered.get(k, 0) > 0:
                k += 1
            out.append((k, across, cell))
            for j in range(k, k + across):
                covered[j] = max(covered.get(j, 0), down)
            k += across
        covered = {j: n - 1 for j, n in covered.items() if n > 1}
        done.append(out)
    return done


def rendered(page: str | None) -> str:
    return "\n".join(line.rstrip() for line in _region(build(page or ""))).strip("\n")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [rendered(p) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines for ``pages`` (page_id, html)."""
    done = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_render, "page_id long, text string")
    return done.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
