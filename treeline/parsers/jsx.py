"""Elements in JavaScript and TypeScript, as expressions that the plain grammars read.

An outermost element becomes an array of the expressions inside it, however deep: its first and
last characters are the brackets, each expression's closing brace a comma, tags and text are blank.
Every character keeps its place, so lines and offsets stay as they were.
"""

from __future__ import annotations

import re

from treeline.parsers import classes

_TOKEN = re.compile(rf"(?P<c>//[^\n]*+|/\*[\s\S]*?\*/)|(?P<s>{classes._DQ}|{classes._SQ}|{classes._TEMPLATE}|{classes._REGEX})|(?P<w>[^\W\d][\w$]*+|\$[\w$]*+)|(?P<d>\.?\d[\w.]*+)|(?P<o>=>|[^\s\w])")
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:[.:-][\w$]+)*-?")
_SPACE = re.compile(r"(?:\s|//[^\n]*+|/\*[\s\S]*?\*/)*+")
_TEXT = re.compile(r"[^<{]*+")
# An element, not a list of type parameters.
_BEGINS = re.compile(r"<(?:>|[A-Za-z_$](?![\w$]*\s*(?:,|extends\b)))")
#: What an expression may follow.
_BEFORE = frozenset(("", "(", "[", "{", "}", ",", ";", ":", "?", "=", "=>", "!", "&", "|", "+", "return", "default", "case", "yield", "await", "else", "typeof", "void"))


class Broken(ValueError):
    """What looked like an element isn't one."""


class _Reader:
    def __init__(self, text: str) -> None:
        self.text = text
        self.out = list(text)

    def blank(self, a: int, b: int) -> None:
        for k in range(a, b):
            if self.text[k] != "\n":
                self.out[k] = " "

    def code(self, at: int, inside: bool) -> int:
        """Reads code; inside braces up to the one that closes them. The place after it."""
        depth, last = 0, "{" if inside else ""
        while m := _TOKEN.search(self.text, at):
            at = m.end()
            if m.lastgroup == "c":
                continue
            t = m.group()
            if t == "<" and last in _BEFORE and _BEGINS.match(self.text, m.start()):
                at = self.element(m.start())
                self.out[m.start()], self.out[at - 1] = "[", "]"
                last = "]"
                continue
            if t == "{":
                depth += 1
            elif t == "}":
                if inside and depth == 0:
                    return at
                depth -= 1
            last = t
        if inside:
            raise Broken("a brace is open")
        return at

    def braces(self, at: int) -> int:
        """An expression in braces, kept for the array. The place after it."""
        end = self.code(at + 1, True)
        self.out[at] = " "
        empty = _SPACE.fullmatch(self.text, at + 1, end - 1)
        self.out[end - 1] = " " if empty else ","
        return end

    def element(self, at: int) -> int:
        """The place after an element that begins here."""
        text, k = self.text, at + 1
        name = ""
        if text[k : k + 1] != ">":
            m = _NAME.match(text, k)
            if not m:
                raise Broken("no name")
            name, k = m.group(), m.end()
        while True:
            k = _SPACE.match(text, k).end()
            c = text[k : k + 1]
            if c == "{":
                self.blank(at, k)
                k = at = self.braces(k)
            elif c == ">":
                k += 1
                break
            elif text.startswith("/>", k):
                self.blank(at, k + 2)
                return k + 2
            elif c in "\"'" and c:
                k = self.quoted(k)
            elif c == "=":
                k += 1
            elif c == "<":
                self.blank(at, k)
                k = at = self.element(k)
            else:
                m = _NAME.match(text, k)
                if not m:
                    raise Broken("no attribute")
                k = m.end()
        self.blank(at, k)
        while True:
            stop = _TEXT.match(text, k).end()
            self.blank(k, stop)
            k = stop
            if text.startswith("</", k):
                end = text.find(">", k)
                if end < 0 or "".join(text[k + 2 : end].split()) != name:
                    raise Broken("another element is closed")
                self.blank(k, end + 1)
                return end + 1
            if not text[k : k + 1]:
                raise Broken("an element is open")
            k = self.element(k) if text[k] == "<" else self.braces(k)

    def quoted(self, at: int) -> int:
        end = self.text.find(self.text[at], at + 1)
        if end < 0:
            raise Broken("a value is open")
        return end + 1


def without_elements(text: str) -> str:
    """The text with arrays for elements; as it is where they aren't well formed."""
    if "<" not in text:
        return text
    r = _Reader(text)
    try:
        r.code(0, False)
    except (Broken, RecursionError):
        return text
    return "".join(r.out)
