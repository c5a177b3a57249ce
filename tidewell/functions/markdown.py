"""The block structure of Markdown, as far as it decides what is a section and what is a packing unit.

A fold over a document's lines with a stack of open containers (quotes and list items) and one open leaf
(paragraph, fenced or indented code, HTML). Only blocks at the top matter to the caller: headings
begin sections; each item of a list is a unit of its own, any other block is one unit. What lies
deeper only tells how far a block goes: nested lists, lazy lines, fences within items, multi-line
headings with an underline, link definitions (which leave nothing).

A unit is the whole source lines from the first to the last that hold its content; code and HTML
lines hold their line end too, and so reach into the next line. A fenced block at the top is written
anew between three backticks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_ALL_CLOSING = re.compile(r"#+$")
_FENCE = re.compile(r"(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_UNDER = re.compile(r"(=+|-+)[ \t]*$")
_ITEM = re.compile(r"([-+*]|(\d{1,9})[.)])(?= |$)")
_DEFINITION = re.compile(
    r"""[ ]{0,3}\[(?:[^\[\]\\]|\\.)*[^\s\[\]\\](?:[^\[\]\\]|\\.)*\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)"""
    r"""(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)"""
)
#: How HTML blocks begin and what ends them (None: a blank line).
_HTML = (
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (
        re.compile(
            r"</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html"
            r"|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:\s|/?>|$)",
            re.I,
        ),
        None,
    ),
)
_TAG = re.compile(r"""(?:<[A-Za-z][\w-]*(?:\s+[\w:.@-]+(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)\s*$""")


@dataclass
class Block:
    kind: str
    low: int = -1
    high: int = -1
    level: int = 0
    text: str | None = None

    def reach(self, low: int, high: int) -> None:
        self.low, self.high = low if self.low < 0 else min(self.low, low), max(self.high, high)


@dataclass
class Container:
    kind: str
    block: Block
    width: int = 0
    #: An item whose first line has nothing else; a second blank line ends it.
    bare: bool = False


@dataclass
class Leaf:
    kind: str
    block: Block
    lines: list[int] = field(default_factory=list)
    mark: str = ""
    info: str = ""
    indent: int = 0
    end: re.Pattern | None = None


def _indent(text: str) -> int:
    return len(text) - len(text.lstrip(" "))


class _Fold:
    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.blocks: list[Block] = []
        self.stack: list[Container] = []
        self.leaf: Leaf | None = None
        for i, raw in enumerate(self.lines):
            self.line(i, raw, raw.expandtabs(4))
        self.close(0)

    def begin(self, kind: str) -> Block:
        """The top block that what begins now belongs to."""
        if self.stack:
            return self.stack[0].block
        self.blocks.append(Block(kind))
        return self.blocks[-1]

    def close(self, depth: int) -> None:
        """End the leaf and all containers from this depth on."""
        leaf, self.leaf = self.leaf, None
        at_top = not self.stack
        if leaf and leaf.kind == "paragraph":
            left = self.undefined(leaf.lines)
            if left:
                leaf.block.reach(left[0], left[-1])
        elif leaf and leaf.kind == "fence" and at_top:
            body = [self.lines[i] for i in leaf.lines]
            body = [x[min(leaf.indent, _indent(x)) :] for x in body]
            leaf.block.text = f"```{leaf.info}\n" + "\n".join(body).rstrip("\n") + "\n```"
        elif leaf and leaf.kind != "paragraph" and leaf.lines:
            while leaf.kind == "code" and leaf.lines and not self.lines[leaf.lines[-1]].strip():
                leaf.lines.pop()
            leaf.block.reach(leaf.lines[0], min(leaf.lines[-1] + 1, len(self.lines) - 1))
        del self.stack[depth:]

    def undefined(self, lines: list[int]) -> list[int]:
        """A paragraph's lines without the link definitions that it begins with."""
        text = "\n".join(re.sub(r"^[ \t]*(?:>[ \t]?)*[ \t]*", "", self.lines[i]) if k else self.lines[i].lstrip(" \t>-+*0123456789.)") for k, i in enumerate(lines))
        at = 0
        while (m := _DEFINITION.match(text, at)) and m.end() > at:
            at = m.end()
        return lines[text.count("\n", 0, at) + (at == len(text) and at > 0 and not text.endswith("\n")) :] if at else lines

    def matched(self, line: str) -> tuple[int, int]:
        """How many containers the line goes on with, and where their marks end in it."""
        at = depth = 0
        for c in self.stack:
            rest = line[at:]
            indent = _indent(rest)
            if c.kind == "quote":
                if indent > 3 or rest[indent : indent + 1] != ">":
                    break
                at += indent + 1
                at += line[at : at + 1] == " "
            elif not rest.strip():
                if c.bare:
                    break
                at += min(indent, c.width)
            elif indent >= c.width:
                at += c.width
            else:
                break
            depth += 1
        return depth, at

    def line(self, i: int, raw: str, line: str) -> None:
        depth, at = self.matched(line)
        whole, leaf = depth == len(self.stack), self.leaf
        rest = line[at:]
        if leaf and whole and leaf.kind == "fence":
            if _indent(rest) <= 3 and re.fullmatch(re.escape(leaf.mark[0]) + "{%d,}[ \t]*" % len(leaf.mark), rest.strip()):
                self.close(len(self.stack))
            else:
                leaf.lines.append(i)
            return
        if leaf and whole and leaf.kind == "html" and (leaf.end or rest.strip()):
            if leaf.end and leaf.end.search(rest):
                self.close(len(self.stack))  # the line that ends it isn't among its own
            else:
                leaf.lines.append(i)
            return
        fresh = False  # whether the line has opened a container
        while True:
            rest = line[at:]
            indent, inner = _indent(rest), rest.strip()
            paragraph = self.leaf is not None and self.leaf.kind == "paragraph" and not fresh
            if not inner:
                self.blank(i, depth, whole, fresh)
                return
            if indent >= 4:
                if paragraph:
                    self.leaf.lines.append(i)
                else:
                    self.code(i, depth, whole and not fresh)
                return
            if inner[0] == ">":
                self.close(depth)
                self.stack.append(Container("quote", self.begin("quote")))
                at += indent + 1
                at += line[at : at + 1] == " "
            elif (m := _ITEM.match(inner)) and not _RULE.match(inner) and not (paragraph and whole and (m.end() == len(inner) or m[2] not in (None, "1"))):
                gap = _indent(inner[m.end() :] + "x") if m.end() < len(inner) else 1
                width = m.end() + (gap if gap <= 4 else 1)
                self.close(depth)
                self.stack.append(Container("item", self.begin("item"), indent + width, m.end() == len(inner)))
                at += indent + width
            else:
                break
            depth, fresh, whole = len(self.stack), True, True
        for c in self.stack[:depth]:
            c.bare = False
        self.begins(i, raw, rest, inner, depth, whole, paragraph)

    def blank(self, i: int, depth: int, whole: bool, fresh: bool) -> None:
        if fresh:
            return
        if self.leaf and self.leaf.kind == "code" and whole:
            self.leaf.lines.append(i)
        elif self.leaf or not whole:
            self.close(depth)

    def code(self, i: int, depth: int, goes_on: bool) -> None:
        if not (goes_on and self.leaf and self.leaf.kind == "code"):
            self.close(depth)
            self.leaf = Leaf("code", self.begin("code"))
        self.leaf.lines.append(i)

    def begins(self, i: int, raw: str, rest: str, inner: str, depth: int, whole: bool, paragraph: bool) -> None:
        """What the rest of a line is that opens no container and isn't indented as code."""
        if m := _ATX.match(rest.rstrip()):
            self.close(depth)
            block = self.begin("heading")
            if not self.stack:
                m = _ATX.match(raw.rstrip())
                title = (m[2] or "").strip()
                block.level, block.text = len(m[1]), "" if _ALL_CLOSING.match(title) else title
            if (m[2] or "").strip():
                block.reach(i, i)
        elif m := _FENCE.match(inner):
            self.close(depth)
            self.leaf = Leaf("fence", self.begin("fence"), mark=m[1], info=m[2], indent=_indent(rest))
        elif (start := next(((a, b) for a, b in _HTML if a.match(inner)), None)) or (not paragraph and _TAG.match(inner)):
            self.close(depth)
            end = start[1] if start else None
            self.leaf = Leaf("html", self.begin("html"), [i], end=end)
            if end and end.search(inner, start[0].match(inner).end() if start[0].pattern != "<!--" else 4):
                self.close(len(self.stack))
        elif paragraph and whole and (m := _UNDER.match(inner)) and self.undefined(self.leaf.lines):
            lines, block = self.undefined(self.leaf.lines), self.leaf.block
            if not self.stack:
                block.kind, block.level = "heading", 1 if m[1][0] == "=" else 2
                block.text = "\n".join(self.lines[k].strip() for k in lines)
            self.close(depth)
        elif _RULE.match(inner):
            self.close(depth)
        elif paragraph:
            self.leaf.lines.append(i)  # lazily, where a container doesn't go on
        else:
            self.close(depth)
            self.leaf = Leaf("paragraph", self.begin("paragraph"), [i])


def sections(text: str) -> list[tuple[int, str, list[str], list[tuple[str, bool]]]]:
    """(level, title, path, units) of each section, units being (text, tight); the first one is what comes before any heading."""
    fold, out, open_ = _Fold(text), [(0, "", [], [])], []
    for b in fold.blocks:
        if b.kind == "heading":
            while open_ and open_[-1][0] >= b.level:
                open_.pop()
            open_.append((b.level, b.text))
            out.append((b.level, b.text, [t for _, t in open_ if t], []))
            continue
        own = b.text if b.kind == "fence" else "\n".join(fold.lines[b.low : b.high + 1]).rstrip(" \t\n") if b.low >= 0 else ""
        if own:
            out[-1][3].append((own, b.kind == "item"))
    return out
