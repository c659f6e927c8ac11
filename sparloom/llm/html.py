"""Layout-aware text of HTML pages: a tree with implied tags, visibility rules, and a renderer of blocks, lists and tables.

Hidden are elements that browsers don't draw, `hidden` ones, and what `display` and
`visibility` say in style attributes and in style elements' rules of one compound
selector (names, classes, ids) outside at-rules or for all screens; a child may be visible again within
one whose visibility is hidden. Closed `details` and all options are drawn, as a click
shows them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import as_text, out_batch, slices

# Element names by what the HTML standard says of them.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object canvas audio video datalist progress meter rp".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
_SPACED = frozenset("blockquote dl h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
_CLOSES_P = _BLOCK - {"html", "body", "dd", "dt", "li", "legend", "option", "optgroup"} | {"dd", "dt", "li"}
#: A start tag ends open elements of these names, no farther up than the second set.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The next attribute of a tag (name, value), or the tag's end; every part is read once, forwards.
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?)""")
#: Settings of display and visibility in a style, with a mark of importance.
_SETTING = re.compile(r"(?:^|[;{])\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
#: Strings and bracketed values of a style, which hold no settings.
_STRING = re.compile(r""""(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?""", re.S)
#: Media whose rules hold on a screen, whatever its size.
_SCREEN = re.compile(r"@media\s+(?:(?:only\s+)?(?:screen|all)\s*(?:,|$)|.*,\s*(?:only\s+)?(?:screen|all)\s*(?:,|$))", re.I | re.S)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_BRACKET = re.compile("[{}]")
_COMPOUND = re.compile(r"(?:[a-zA-Z][\w-]*|\*)?(?:[.#][\w-]+)*")
#: Inputs whose value is drawn.
_DRAWN = frozenset("button email number reset search submit tel text url".split())
#: What a head holds; anything else ends it.
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Parts of tables; between them, other elements and text go before the table.
_PARTS = frozenset("table tbody thead tfoot tr td th caption colgroup col".split())
_BETWEEN = frozenset("table tbody thead tfoot tr colgroup".split())
_STAY = frozenset("script style template".split())
#: Parts of drawings and formulas that aren't shown.
_UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())


def _tag(page: str, at: int) -> tuple[dict[str, str], int, bool] | None:
    """Attributes, end, and whether a slash ends it, of the tag whose name ends at `at`; None where the page ends within it."""
    out: dict[str, str] = {}
    while m := _ATTRIBUTE.match(page, at):
        at = m.end()
        if m[1]:
            return out, at, page[at - 2] == "/"
        out.setdefault(m[2].lower(), html.unescape(m[3] or m[4] or m[5] or ""))
    return None


def _past(page: str, mark: str, at: int) -> int:
    """The place behind the next `mark`, or the end of the page."""
    found = page.find(mark, at)
    return len(page) if found < 0 else found + len(mark)


@dataclass
class Node:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings


def tree(page: str) -> Node:
    root = Node("#root")
    stack = [root]
    opened: Counter[str] = Counter()  # names in the stack
    begun = False  # the head is over
    at = 0

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.name] += 1

    def cut(i: int) -> None:
        opened.subtract(n.name for n in stack[i:])
        del stack[i:]

    def body() -> None:
        nonlocal begun
        begun = True
        if stack[-1].name == "head":
            cut(len(stack) - 1)

    def add(child) -> None:
        """Puts a child into the open element, or before the table where that can't hold it."""
        if stack[-1].name in _BETWEEN and (child.name not in _PARTS | _STAY if isinstance(child, Node) else not _BLANK.fullmatch(child)):
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == "table"), 0)
            if i:
                siblings = stack[i - 1].children
                k = next(k for k in range(len(siblings) - 1, -1, -1) if siblings[k] is stack[i])
                siblings.insert(k, child)
                return
        stack[-1].children.append(child)

    def text(s: str) -> None:
        if s:
            s = html.unescape(s) if "&" in s else s
            if stack[-1].name in ("#root", "html", "head") and not _BLANK.fullmatch(s):
                body()
            add(s)

    def close(names, limits) -> None:
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in limits or stack[i].name == "template":
                return
            if stack[i].name in names:
                cut(i)
                if names & {"tr", "td", "th", "tbody", "dt", "li"}:  # more than one may be open: a cell, its row, its body
                    close(names, limits)
                return

    def to_table() -> None:
        """Ends what was opened between the parts of a table."""
        if opened["table"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ("td", "th", "caption", "template"):
                    return
                if stack[i].name in _BETWEEN:
                    cut(i + 1)
                    return

    lower, shown = None, 0  # text from `shown` on isn't in the tree yet
    while (begin := page.find("<", at)) >= 0:
        at = begin + 1
        closing = page.startswith("/", at)
        found = _NAME.match(page, at + closing)
        if not found and not page.startswith(("!", "?", "/"), at):
            continue  # a sign of its own
        if not found and page.startswith("/", at) and at + 1 == len(page):
            continue
        text(page[shown:begin])
        if not found:
            if page.startswith("!--", at):
                at = begin + 5 if page.startswith(">", begin + 4) else begin + 6 if page.startswith("->", begin + 4) else _past(page, "-->", begin + 4)
            elif page.startswith("![CDATA[", at) and (opened["svg"] or opened["math"]):
                end = page.find("]]>", begin)
                add(page[begin + 9 : len(page) if end < 0 else end])
                at = _past(page, "]]>", begin)
            else:
                at = _past(page, ">", at)
            shown = at
            continue
        tag = _tag(page, found.end())
        if tag is None:
            return root  # a page that ends within a tag doesn't show it
        attributes, at, slash = tag
        shown = at
        if closing:
            name = found[0].lower()
            for i in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[i].name == name:
                    cut(i)
                    break
                if stack[i].name == "template":
                    break
                if stack[i].name in ("table", "td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break  # what opened outside a cell doesn't close in it
            begun = begun or name == "head"
        else:
            name = found[0].lower()
            if name == "head":
                if begun or opened["head"]:
                    continue
            elif name != "html" and stack[-1].name in ("#root", "html", "head") and name not in _HEAD:
                body()
            if name in _PARTS and name != "table":
                to_table()
            if name in _IMPLIED:
                close(*_IMPLIED[name])
            if name in _CLOSES_P:
                close({"p"}, {"table", "td", "th", "button", "object", "caption"})
            if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
                stack[-1].children.append(row := Node("tr"))
                push(row)
            node = Node(name, attributes)
            if name in _UNDRAWN and (opened["svg"] or opened["math"]):
                node.attributes["hidden"] = ""
            between = stack[-1].name in _BETWEEN
            add(node)
            if name in _RAW:
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{name}", at)
                end = len(page) if end < 0 else end
                raw = page[at:end]
                if name == "textarea":
                    raw = raw.removeprefix("\n")
                node.children.append(html.unescape(raw) if name in ("title", "textarea") else raw)
                at = shown = _past(page, ">", end)
            elif name not in _VOID and name != "col" and not (name == "form" and between) and not (slash and (opened["svg"] or opened["math"])):
                push(node)
                if name in ("pre", "listing") and page.startswith("\n", at):
                    at = shown = at + 1  # a line end right after the tag isn't part of the text
    text(page[shown:])
    return root


def _rules(css: str):
    """(selector, settings) of the rules outside at-rules, or within those for every screen."""
    css, at = _STRING.sub('""', _COMMENT.sub(" ", css)), 0
    while (brace := css.find("{", at)) >= 0:
        head = css[at:brace].rpartition(";")[2].lstrip("} \t\r\n\f").strip()  # an at-rule without a block ends with a semicolon
        end = brace + 1
        if _SCREEN.match(head):
            at = end  # its rules are as those outside; the bracket that ends it stands before a selector
            continue
        if head.startswith("@"):
            depth = 1
            for m in _BRACKET.finditer(css, end):
                depth += 1 if m[0] == "{" else -1
                if not depth:
                    break
            end = m.end() if not depth else len(css)
        else:
            end = _past(css, "}", end)
            yield head, css[brace:end]
        at = end


class Styles:
    """What a page's style elements say of display and visibility, by the last name, class or id of a selector."""

    def __init__(self, sheets: list[str]):
        self.by_key: dict[str, list[tuple]] = {}
        n = 0
        for sheet in sheets:
            for heads, body in _rules(sheet):
                settings = [(k.lower(), v.lower(), bool(i)) for k, v, i in _SETTING.findall(body)]
                for head in heads.split(",") if settings else ():
                    head = head.strip()
                    if head and _COMPOUND.fullmatch(head):
                        parts = re.findall(r"[.#]?[\w*-]+", head)
                        name = parts[0].lower() if parts[0][0] not in ".#" else "*"
                        classes, ids = {x[1:] for x in parts if x[0] == "."}, {x[1:] for x in parts if x[0] == "#"}
                        n += 1
                        rank = (len(ids), len(classes), name != "*", n)
                        self.by_key.setdefault(parts[-1] if parts[-1][0] in ".#" else name, []).append((rank, name, classes, ids, settings))

    def of(self, n: "Node") -> dict[str, str]:
        """The settings that hold for an element: of a style attribute, else of the most special rule, the last one on ties."""
        a = n.attributes
        own = a.get("style")
        if not self.by_key and not own:
            return {}
        best: dict[str, tuple] = {}
        if self.by_key:
            classes, ids = set(a.get("class", "").split()), {a["id"]} if "id" in a else set()
            for key in [n.name, "*", *(f".{c}" for c in classes), *(f"#{i}" for i in ids)]:
                for rank, name, cs, i, settings in self.by_key.get(key, ()):
                    if name in ("*", n.name) and cs <= classes and i <= ids:
                        for k, v, important in settings:
                            best[k] = max(best.get(k, ((),)), ((important, 0, *rank), v))
        for k, v, important in _SETTING.findall(_STRING.sub('""', own) if own else ""):
            best[k.lower()] = max(best.get(k.lower(), ((),)), ((bool(important), 1), v.lower()))
        return {k: v for k, (_, v) in best.items()}


def _drawn(n: Node, styles: dict[str, str]) -> bool:
    """Whether an element has a place on the page; what its visibility hides keeps its place."""
    a = n.attributes
    if n.name in _HIDDEN or (n.name == "input" and a.get("type", "").lower() == "hidden") or (n.name == "dialog" and "open" not in a):
        return False
    return styles["display"] != "none" if "display" in styles else "hidden" not in a


def _seen(before: bool, styles: dict[str, str]) -> bool:
    """Whether an element's own text is seen, where `before` says so of its parent's."""
    v = styles.get("visibility")
    return before if v in (None, "inherit") else v not in ("hidden", "collapse")


_WHITE = re.compile(r"[ \t\n\r\f]+")
_BLANK = re.compile(r"[ \t\n\r\f]*")


def _run(steps):
    """What a generator returns that yields generators for their results: recursion on a list in place of the call stack."""
    stack, result = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(result))
            result = None
        except StopIteration as e:
            stack.pop()
            result = e.value
    return result


class _Lines:
    """Lines of text; white space collapses, blocks start lines, spaced blocks keep an empty line between."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []  # pieces of the line
        self.prefix = ""
        self.blank = False

    def write(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self.now.append(first)
            for line in rest:
                self.end(True)
                self.now.append(line)
            return
        s = _WHITE.sub(" ", s)
        last = next((x for x in reversed(self.now) if x), " ")
        if last.endswith(" "):
            s = s.lstrip(" ")
        if s:
            self.now.append(s)

    def end(self, keep_empty: bool = False) -> None:
        line = "".join(self.now)
        self.now = []
        if line.strip(" ") or keep_empty:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append((self.prefix + line).rstrip(" "))
            self.prefix = " " * len(self.prefix)

    def gap(self) -> None:
        self.end()
        self.blank = True


def _number(cell: Node, key: str, most: int) -> int:
    value = cell.attributes.get(key, "").strip()
    return min(max(int(value[:9]), 1), most) if value.isascii() and value.isdigit() else 1


def _table(n: Node, styles: Styles, seen: bool):
    """Rows with cells padded to their columns' widths; a cell over several columns or rows is written once."""
    rows: list[list[str]] = []
    until: dict[int, int] = {}  # the row at which a column is free again
    captions: list[str] = []

    def walk(x: Node, seen: bool):
        for c in x.children:
            if isinstance(c, str):
                continue
            how = styles.of(c)
            if not _drawn(c, how):
                continue
            here = _seen(seen, how)
            if c.name == "tr":
                r, row = len(rows), []
                for cell in (y for y in c.children if not isinstance(y, str) and y.name in ("td", "th")):
                    own = styles.of(cell)
                    if not _drawn(cell, own):
                        continue
                    while until.get(len(row), 0) > r:
                        row.append("")
                    text = " ".join(x for x in (yield _render(cell, styles, _seen(here, own))).split("\n") if x)
                    width, height = _number(cell, "colspan", 1000), _number(cell, "rowspan", 65534)  # the standard's bounds
                    if height > 1:
                        until.update({len(row) + k: r + height for k in range(width)})
                    row += [text] + [""] * (width - 1)
                rows.append(row)
            elif c.name == "caption":
                captions.append((yield _render(c, styles, here)))
            else:
                yield walk(c, here)

    yield walk(n, seen)
    widths = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(max(map(len, rows), default=0))]
    lines = []
    for r in rows:
        full = max((k + 1 for k, c in enumerate(r) if c), default=0)  # empty cells at the end aren't written
        lines.append(" | ".join(c.ljust(w) for c, w in zip(r[:full], widths)).rstrip(" "))
    return [c for c in captions if c] + [x for x in lines if x]


def render(root: Node) -> str:
    sheets, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.name == "style":
            sheets.append("".join(c for c in n.children if isinstance(c, str)))
        elif n.name != "template":
            stack += [c for c in reversed(n.children) if not isinstance(c, str)]
    return _run(_render(root, Styles(sheets), True))


def _render(root: Node, styles: Styles, seen: bool):
    out = _Lines()

    def walk(n: Node, pre: bool, depth: int, counter: list[int] | None, seen: bool):
        for c in n.children:
            if isinstance(c, str):
                if seen:
                    out.write(c, pre)
                continue
            how = styles.of(c)
            if not _drawn(c, how):
                continue
            name, here = c.name, _seen(seen, how)
            if name == "br":
                out.end(True)
            elif name == "hr":
                out.gap()
            elif name == "img":
                if here:
                    out.write(f" {c.attributes.get('alt', '')} ", False)
            elif name == "input":
                if here and c.attributes.get("type", "text").lower() in _DRAWN:
                    out.write(f" {c.attributes.get('value', '')} ", False)
            elif name == "table":
                out.gap()
                for line in (yield _table(c, styles, here)):
                    out.now = [line]
                    out.end()
                out.gap()
            elif name == "li":
                out.end()
                outer, mark = out.prefix, "- "
                if counter:
                    mark, counter[0] = f"{counter[0]}. ", counter[0] + 1
                out.prefix = "  " * max(0, depth - 1) + mark
                yield walk(c, pre, depth, None, here)
                out.end()
                out.prefix = outer
            elif name in ("ul", "ol", "menu", "dir"):
                (out.end if depth else out.gap)()
                start = c.attributes.get("start", "1")
                yield walk(c, pre, depth + 1, [int(start[:9]) if start.isascii() and start.isdigit() else 1] if name == "ol" else None, here)
                (out.end if depth else out.gap)()
            elif name in _BLOCK:
                (out.gap if name in _SPACED else out.end)()
                yield walk(c, pre or name == "pre", depth, counter, here)
                (out.gap if name in _SPACED else out.end)()
            else:
                yield walk(c, pre or name == "textarea", depth, counter, here)
                if name in ("td", "th"):
                    out.write(" ", False)

    yield walk(root, False, 0, None, seen)
    out.end()
    return "\n".join(out.lines)


def extract(page: str) -> tuple[str, str]:
    """(title, visible text)."""
    root = tree(page)
    title, stack = "", [root]
    while stack and not title:
        n = stack.pop()
        if n.name == "title":
            title = _WHITE.sub(" ", "".join(c for c in n.children if isinstance(c, str))).strip(" ")
        elif n.name not in ("svg", "math", "body"):
            stack += [c for c in reversed(n.children) if not isinstance(c, str)]
    return title, render(root)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with title and text in place of the HTML; null pages have null for both, empty ones empty strings.

    Input columns of these names are replaced, others carried.
    """
    carry = [c for c in pages.columns if c not in (html_col, "title", "text")]

    def run(batches):
        for batch in slices(batches, html_col):
            null = batch.column(batch.schema.get_field_index(html_col)).is_null().to_pylist()
            found = [(None, None) if n else extract(p) for p, n in zip(as_text(batch, html_col), null)]
            yield out_batch(batch, carry, {"title": pa.array([f[0] for f in found], pa.string()), "text": pa.array([f[1] for f in found], pa.string())})

    return pages.mapInArrow(run, T.StructType([pages.schema[c] for c in carry] + [T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """All pages with title and text in place of the HTML.

    Null pages: null title and text; empty ones: empty strings. Repeated rows are
    rendered each for itself; an empty table gives no rows.
    """
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
