"""The top-level blocks of a markdown text with their lines, by a stack of open containers.

Each line is first matched against the containers that are open (quotes, list items); what is left of it may go on with
the open leaf, begin blocks, or go on with an open paragraph of containers that it does not match.  Only
what decides the extent of top-level blocks is kept: the stack, the open leaf, and the block in progress.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# How blocks begin and end in CommonMark, and tables of GitHub's dialect.
HEADING = re.compile(r"#{1,6}(?: |$)")
FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
RULE = re.compile(r"(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$")
SETEXT = re.compile(r"(?:=+|-+) *$")
ITEM = re.compile(r"(?:([-+*])|(\d{1,9})([.)]))(?= |$)")
DELIMITERS = re.compile(r"\|? *:?-+:? *(?:\| *:?-+:? *)*\|? *$")
DEFINITION = re.compile(
    r"""\[(?=[^\]]*[^\s\]])(?:[^\[\]\\]|\\.){1,999}\]:\s*(<(?:[^<>\\\n]|\\.)*>|(?!<)\S+)"""
    r"""(?:\s+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|\Z)""",
    re.S,
)
HTML_BLOCKS = """address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset
figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol
optgroup option p param search section summary table tbody td tfoot th thead title tr track ul""".split()
ATTRIBUTE = r"""\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^"'=<>`\x00-\x20]+|'[^']*'|"[^"]*"))?"""
# the start of each of the seven kinds of HTML blocks, and what ends it; the last two end before a blank line
HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(HTML_BLOCKS)})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*(?:{ATTRIBUTE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), None),
]


@dataclass
class Item:
    """An open list item: how far its content is indented, its line, and whether nothing but blanks was in it."""

    width: int
    line: int
    empty: bool


QUOTE = None


@dataclass
class Leaf:
    """The open leaf: ``paragraph`` with its lines, ``fence``, ``html``, ``code`` or ``table``, and the pattern that ends it."""

    kind: str
    end: re.Pattern | None = None
    lines: list[str] = field(default_factory=list)


@dataclass
class Block:
    kind: str
    start: int
    end: int
    list_key: str | None = None
    last: Item | None = None


def _pad(s: str, at: int) -> int:
    return len(s) - at - len(s[at:].lstrip(" "))


def _cells(line: str) -> int:
    """Cells of a table row: pipes part them, those that are escaped do not, and outer ones do not count."""
    bare = re.sub(r"\\.", "xx", line.strip())
    return len(bare.removeprefix("|").removesuffix("|").split("|")) if bare else 0


def table_begins(header: str, below: str) -> bool:
    """Whether two lines are the head of a table."""
    if max(_pad(header, 0), _pad(below, 0)) > 3 or "|" not in header:
        return False
    below = below.strip(" ")
    # a dash before a blank would be a list item
    if not DELIMITERS.match(below) or len(below) < 2 or below[:2] == "- " or below[1] not in "|-: ":
        return False
    return _cells(header) == _cells(below)


def definitions(lines: list[str]) -> int:
    """How many lines at a paragraph's start are link definitions."""
    text, at = "\n".join(x.strip(" ") for x in lines), 0
    while m := DEFINITION.match(text, at):
        head, _, rest = m[0].partition("]:")
        if rest.count("\n\n") or not m[1].startswith("<") and re.sub(r"\\.", "", m[1]).count("(") != re.sub(r"\\.", "", m[1]).count(")"):
            break
        at = m.end()
    return len(lines) if at >= len(text) else text.count("\n", 0, at)


class Blocks:
    """Reads lines in order; ``done`` has the top-level blocks."""

    def __init__(self, lines: list[str]):
        # tab stops are absolute, and beyond the indentation blanks do as well
        self.lines = [x.expandtabs(4) for x in lines]
        self.stack: list[Item | None] = []
        self.leaf: Leaf | None = None
        self.top: Block | None = None
        self.done: list[Block] = []
        for k, s in enumerate(self.lines):
            self.read(k, s)
        self.finish(len(self.lines))

    # the block in progress

    def finish(self, line: int) -> None:
        """Ends the top-level block in progress, where another one begins or the text ends."""
        self.close_leaf()
        if self.top and self.top.kind.endswith("_list"):
            # a list has the blank lines behind it, but only one behind an item without content
            last = self.top.last
            self.top.end = min(line, last.line + 2) if last and last.empty else line
        if self.top:
            self.done.append(self.top)
        self.top = None

    def close_leaf(self) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf and leaf.kind == "paragraph" and not self.stack and self.top:
            self.top.start += definitions(leaf.lines)
            if self.top.start >= self.top.end:
                self.top = None

    def begin(self, kind: str, line: int, key: str | None = None) -> None:
        """Notes that a block begins at a line; inside a container it belongs to that."""
        if not self.stack:
            self.finish(line)
            self.top = Block(kind, line, line + 1, key)

    def close(self, depth: int) -> None:
        """Closes the containers beyond a depth, and the leaf with them."""
        if len(self.stack) > depth:
            # a leaf of a container has no block of its own
            self.leaf = None
            del self.stack[depth:]

    def touch(self, line: int) -> None:
        if self.top:
            self.top.end = line + 1

    # lines

    def match(self, s: str) -> tuple[int, int]:
        """How many open containers a line goes on with, and where the rest of it begins."""
        at = depth = 0
        for c in self.stack:
            pad = _pad(s, at)
            if c is QUOTE:
                if pad > 3 or s[at + pad : at + pad + 1] != ">":
                    break
                at += pad + 1
                at += s[at : at + 1] == " "
            elif at + pad == len(s):
                if c.empty:
                    break
            elif pad >= c.width:
                at += c.width
            else:
                break
            depth += 1
        return depth, at

    def read(self, k: int, s: str) -> None:
        depth, at = self.match(s)
        blank = not s[at:].strip(" ")
        whole = depth == len(self.stack)
        if depth and self.stack[0] is QUOTE:
            self.touch(k)
        if blank:
            self.read_blank(k, depth, whole)
            return
        for c in self.stack[:depth]:
            if c is not QUOTE:
                c.empty = False
        if whole and self.goes_on(k, s, at):
            return
        # new blocks; the first one closes the containers that the line does not match
        while s[at:].strip(" "):
            pad, paragraph = _pad(s, at), self.leaf is not None and self.leaf.kind == "paragraph"
            t, whole = s[at + pad :], depth == len(self.stack)
            if pad > 3:
                if not paragraph:
                    self.close(depth)
                    self.begin("code_block", k)
                    self.leaf = Leaf("code")
                    return
                break
            if paragraph and whole and self.underlined(k, t):
                return
            paragraph = self.leaf is not None and self.leaf.kind == "paragraph"
            if not (depth or whole and paragraph and self.stack) and self.table_ahead(k, s, at, depth):
                return
            if t[0] == ">":
                self.close(depth)
                self.begin("blockquote", k)
                self.leaf = None
                self.stack.append(QUOTE)
                depth += 1
                at += pad + 1
                at += s[at : at + 1] == " "
                continue
            if self.starts_leaf(k, t, depth, paragraph):
                return
            m = ITEM.match(t)
            rest = t[m.end() :] if m else ""
            if not m or paragraph and (not rest.strip(" ") or m[2] and int(m[2]) != 1) and whole:
                break
            self.close(depth)
            at += pad + m.end()
            gap = _pad(s, at)
            gap = gap if 1 <= gap <= 4 and rest.strip(" ") else 1
            item = Item(pad + m.end() + gap, k, not rest.strip(" "))
            self.item(k, m[1] or m[3], item)
            self.leaf = None
            self.stack.append(item)
            depth += 1
            at += gap
        else:
            return
        self.text(k, s[at:], depth)

    def read_blank(self, k: int, depth: int, whole: bool) -> None:
        """A line that is blank behind its containers."""
        leaf = self.leaf
        if not whole:
            self.close(depth)
        elif leaf and (leaf.kind == "fence" or leaf.kind == "html" and leaf.end):
            if not self.stack:
                self.touch(k)
            return
        elif leaf and leaf.kind == "code":
            return
        if self.leaf:
            self.close_leaf()

    def goes_on(self, k: int, s: str, at: int) -> bool:
        """Whether the open leaf, other than a paragraph, takes the line."""
        leaf, pad = self.leaf, _pad(s, at)
        if leaf is None or leaf.kind == "paragraph":
            return False
        if leaf.kind == "code" and pad < 4 or leaf.kind == "table" and (pad > 3 or self.interrupts(s[at + pad :])):
            self.leaf = None
            return False
        if leaf.kind == "fence" and pad < 4 and leaf.end.match(s, at + pad) or leaf.kind == "html" and leaf.end and leaf.end.search(s, at):
            self.leaf = None
        if not self.stack:
            self.touch(k)
        return True

    @staticmethod
    def interrupts(t: str) -> bool:
        """Whether a line ends a table."""
        return t[0] == ">" or any(p.match(t) for p in (HEADING, FENCE, RULE, ITEM)) or any(p.match(t) for p, _ in HTML[:6])

    def underlined(self, k: int, t: str) -> bool:
        """Whether a line turns the open paragraph into a heading; one of nothing but definitions ends here."""
        if not SETEXT.match(t):
            return False
        if definitions(self.leaf.lines) == len(self.leaf.lines):
            self.finish(k) if not self.stack else self.close_leaf()
            return False
        self.close_leaf()
        if not self.stack:
            self.top.kind = "heading"
            self.touch(k)
        return True

    def table_ahead(self, k: int, s: str, at: int, depth: int) -> bool:
        """Whether a table begins here outside of containers, which the next line tells."""
        if k + 1 >= len(self.lines) or not table_begins(s[at:], self.lines[k + 1]):
            return False
        self.close(depth)
        self.begin("table", k)
        self.leaf = Leaf("table")
        return True

    def starts_leaf(self, k: int, t: str, depth: int, paragraph: bool) -> bool:
        """Whether a heading, fence, rule or HTML block begins with the rest of a line."""
        html = next(((n, end) for n, (p, end) in enumerate(HTML) if p.match(t)), None) if t[0] == "<" else None
        if html and html[0] == 6 and paragraph:
            html = None
        if m := FENCE.match(t):
            mark = m[1] or m[2]
            kind, leaf = "fence", Leaf("fence", re.compile(rf"{re.escape(mark[0])}{{{len(mark)},}} *$"))
        elif HEADING.match(t):
            kind, leaf = "heading", None
        elif RULE.match(t):
            kind, leaf = "hr", None
        elif html:
            kind, leaf = "html_block", None if html[1] and html[1].search(t) else Leaf("html", html[1])
        else:
            return False
        self.close(depth)
        self.begin(kind, k)
        self.leaf = leaf
        return True

    def item(self, k: int, mark: str, item: Item) -> None:
        """A list item begins; at the top it goes on with a list of its mark."""
        if not self.stack:
            if self.top is None or self.top.list_key != mark:
                self.begin("bullet_list" if mark in "-+*" else "ordered_list", k, mark)
            self.top.last = item
            self.leaf = None

    def text(self, k: int, t: str, depth: int) -> None:
        """A line of a paragraph: the open one, also of containers that the line does not match, or a new one."""
        if self.leaf and self.leaf.kind == "paragraph":
            whole = depth == len(self.stack)
            if whole and self.stack and table_begins(self.leaf.lines[-1], t):
                # inside a container the head of a table was taken for text
                self.leaf = Leaf("table")
            else:
                # a line that only goes on with the text is no table's head
                self.leaf.lines.append(t if whole else "")
            self.touch(k)
            return
        self.close(depth)
        self.begin("paragraph", k)
        self.leaf = Leaf("paragraph", lines=[t])


def markdown_lines(text: str | None) -> list[str]:
    """The lines of a text with their ends: line feeds, carriage returns, or both together."""
    return re.findall(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+", text or "")


def markdown_nodes(text: str | None, all_breaks: bool = False) -> list[tuple[str, int, int]]:
    """(type, start, end) of the top-level blocks of a markdown text; containers are one node each, link definitions and blank lines none.

    An end takes in the line break of its last line; a list has the blank lines behind it.  ``all_breaks`` counts places by
    lines that end at any of Unicode's line breaks, as published, though only line feeds and carriage returns end
    a block's line: texts with other breaks get other places.
    """
    lines = markdown_lines(text)
    at = [0]
    for line in (text or "").splitlines(keepends=True) if all_breaks else lines:
        at.append(at[-1] + len(line))
    return [(b.kind, at[b.start], at[b.end]) for b in Blocks([x.rstrip("\r\n") for x in lines]).done]
