"""Source text to one canonical syntax tree for many languages.

A tree is made of ``Node(type, line, attributes, children)``. Types: Root, Block,
FunctionDecl, Return, TryCatch, CatchClause, If, For, Foreach, While, Do, Assign (PHP) and
Other with an attribute ``kind``. An else-if is always an If directly below an If.

Three readers cover everything: one for languages with braces, one for languages whose
blocks end with a word (Lua, Ruby), and Python's own parser. They are tolerant: what isn't
understood becomes Other. Where a grammar exists (``grammar.py``) it decides whether the
text parses; elsewhere balanced brackets do.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from treeline.parsers import classes, grammar, jsx


class Node:
    """One node of the canonical tree."""

    __slots__ = ("attributes", "children", "extra", "line", "type")

    def __init__(self, type: str, line: int, children: list[Node] | None = None, extra: dict | None = None, **attributes: object) -> None:  # noqa: A002
        self.type, self.line, self.children, self.attributes, self.extra = type, line, children or [], attributes, extra

    def walk(self) -> Iterator[Node]:
        """Itself and all below, in pre-order, without recursion."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def body(self) -> Node | None:
        return next((c for c in self.children if c.type == "Block"), None)


@dataclass(frozen=True)
class Language:
    """How a language is read."""

    name: str
    extensions: tuple[str, ...]
    reader: str = "brace"  # brace, end, python
    functions: frozenset[str] = frozenset()  # words that introduce a function
    typed_functions: bool = False  # functions without such a word: type name(...) {
    newline_ends: bool = False  # a line break may end a statement
    bare_conditions: bool = False  # no parentheses needed around conditions
    foreach: str = ""  # what makes a for a Foreach: "always", or a mark inside its head
    catches: bool = True
    do_catch: bool = False  # do { } catch { }
    comments_count: bool = True  # comments are nodes
    grammar: str | None = None
    hash_comments: bool = False
    wrap_bodies: bool = False  # a body without braces becomes a Block


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


# Extensions of each language, in the order in which a file's language is decided.
LANGUAGES = (
    Language("PHP", (".php",), functions=_set("function"), foreach="", comments_count=False, grammar="php", hash_comments=True, wrap_bodies=True),
    Language("NyxilumLang", (".nx",), functions=_set("func fn"), newline_ends=True, bare_conditions=True, comments_count=False),
    Language("JavaScript", (".js", ".jsx", ".mjs", ".cjs"), functions=_set("function"), newline_ends=True, foreach=r"\b(?:of|in)\b", comments_count=False, grammar="js"),
    Language("TypeScript", (".ts", ".tsx"), functions=_set("function"), newline_ends=True, foreach=r"\b(?:of|in)\b", comments_count=False, grammar="ts"),
    Language("C", (".c", ".h"), typed_functions=True, catches=False, grammar="c"),
    Language("C++", (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"), typed_functions=True, foreach=r"[^:]:[^:]"),
    Language("C#", (".cs",), typed_functions=True),
    Language("Java", (".java",), typed_functions=True, foreach=":", grammar="java"),
    Language("Python", (".py",), reader="python"),
    Language("Rust", (".rs",), functions=_set("fn"), bare_conditions=True, foreach="always", catches=False),
    Language("Swift", (".swift",), functions=_set("func"), newline_ends=True, bare_conditions=True, do_catch=True),
    Language("Go", (".go",), functions=_set("func"), newline_ends=True, bare_conditions=True, catches=False),
    Language("Kotlin", (".kt", ".kts"), functions=_set("fun"), newline_ends=True),
    Language("Ruby", (".rb",), reader="end"),
    Language("Dart", (".dart",), typed_functions=True),
    Language("Zig", (".zig",), functions=_set("fn"), catches=False),
    Language("Objective-C", (".m", ".mm"), typed_functions=False, foreach=""),
    Language("Solidity", (".sol",), functions=_set("function constructor modifier")),
    Language("Lua", (".lua",), reader="end", grammar="lua"),
)


def language_for(file: str) -> Language | None:
    """The first language whose extension the path ends with (case counts)."""
    return next((la for la in LANGUAGES if file.endswith(la.extensions)), None)


# tokens -------------------------------------------------------------------------------


class Token:
    __slots__ = ("end", "kind", "line", "start", "text")

    def __init__(self, kind: str, text: str, line: int, start: int, end: int) -> None:
        self.kind, self.text, self.line, self.start, self.end = kind, text, line, start, end


_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*+"', r"'(?:[^'\\\n]|\\[\s\S])*+'"
_JS_REGEX = classes._REGEX


@lru_cache(maxsize=None)
def _token_rx(name: str) -> re.Pattern:
    comment = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\Z)"
    string = rf'"""[\s\S]*?"""|{_DQ}|{_SQ}'
    word = r"[A-Za-z_$@][\w$]*+|[^\W\d]\w*+"
    if name == "PHP":
        comment = r"(?://|\#(?!\[))(?:(?!\?>)[^\n])*+|/\*[\s\S]*?(?:\*/|\Z)"
        string = r'"(?:[^"\\]|\\[\s\S])*+"|\'(?:[^\'\\]|\\[\s\S])*+\'|<<<[ \t]*(?P<q>["\']?)(?P<h>\w+)(?P=q)\r?\n[\s\S]*?\n[ \t]*(?P=h)\b|\?>(?:(?!<\?)[\s\S])*+(?:<\?(?:php\b|=)?|\Z)'
        word = r"\$*\\?[A-Za-z_\x80-￿][\w\\]*+"
    elif name in ("JavaScript", "TypeScript"):
        string = rf"{_DQ}|{_SQ}|{classes._TEMPLATE}|{_JS_REGEX}"
        word = r"#?[A-Za-z_$\x80-￿][\w$]*+"
    elif name == "Lua":
        comment = r"--\[(?P<la>=*)\[[\s\S]*?(?:\](?P=la)\]|\Z)|--[^\n]*+"
        string = rf"{_DQ}|{_SQ}|\[(?P<lb>=*)\[[\s\S]*?\](?P=lb)\]"
        word = r"[A-Za-z_]\w*+"
    elif name == "Ruby":
        comment = r"#[^\n]*+|^=begin\b[\s\S]*?^=end\b"
        string = r'"(?:[^"\\]|\\[\s\S])*+"|\'(?:[^\'\\]|\\[\s\S])*+\''
        word = r"[@:]{0,2}[A-Za-z_]\w*+[?!]?|:\"[^\"\n]*\""
    elif name in ("C", "C++", "Objective-C"):
        comment = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\Z)|^[ \t]*#(?:[^\n\\]|\\[\s\S])*+"
        string = rf"@?{_DQ}|{_SQ}|R\"(?P<d>[^(\s]*)\([\s\S]*?\)(?P=d)\""
    elif name == "Rust":
        string = rf"r#*\"[\s\S]*?\"#*|{_DQ}|'(?:[^'\\\n]|\\[^\n]+?)'"
        word = r"'?[A-Za-z_]\w*+!?"
    elif name == "Go":
        string = rf"{_DQ}|{_SQ}|`[^`]*+`"
    elif name == "C#":
        string = rf'"""[\s\S]*?"""|[$@]{{1,2}}"(?:[^"]|"")*+"|{_DQ}|{_SQ}'
    return re.compile(rf"(?P<C>{comment})|(?P<S>{string})|(?P<W>{word})|(?P<D>\d[\w.]*+)|(?P<L>\n)|(?P<O>=>|->|::|\?\.|\.\.\.?|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|:=|[^\s\w])", re.M)


def tokens(text: str, lang: Language) -> list[Token]:
    rx = _token_rx(lang.name)
    out, line, at, start = [], 1, 0, 0
    if lang.name == "PHP":
        m = re.search(r"<\?(?:php\b|=)?", text)
        start = m.end() if m else len(text)
    for m in rx.finditer(text, start):
        k = m.lastgroup
        line += text.count("\n", at, m.start())
        at = m.start()
        kind = "C" if k == "C" else "S" if k == "S" else "W" if k == "W" else "D" if k == "D" else "L" if k == "L" else "O"
        if k == "C" and lang.name in ("C", "C++", "Objective-C") and m.group().lstrip()[:1] == "#":
            continue
        out.append(Token(kind, m.group(), line, m.start(), m.end()))
    return out


# braces -------------------------------------------------------------------------------

_TYPE_WORDS = _set("class struct interface enum namespace union impl trait extension contract object protocol mod library record module")
_CLOSER = {"(": ")", "[": "]", "{": "}"}
_CONTINUES = _set(". , + - * / % & | ^ = == != <= >= && || ? : -> => :: ?. += -= *= /= < >")
_TYPES = _set("void string number boolean any unknown never undefined object bigint symbol Promise Array Record Map Set")
_JUMPS = _set("return break continue throw")


class BraceReader:
    """Languages whose blocks stand in braces."""

    def __init__(self, text: str, lang: Language) -> None:
        self.text, self.lang = text, lang
        self.all = tokens(text, lang)
        self.t = [x for x in self.all if x.kind not in "L" and (x.kind != "C" or lang.comments_count)]
        self.after_break = set()
        if lang.newline_ends:
            pend = False
            keep = {id(x) for x in self.t}
            for x in self.all:
                if x.kind == "L":
                    pend = True
                elif id(x) in keep:
                    if pend:
                        self.after_break.add(id(x))
                    pend = False
        self.p = 0

    def more(self) -> bool:
        return self.p < len(self.t)

    def peek(self, k: int = 0) -> str:
        i = self.p + k
        return self.t[i].text if i < len(self.t) else ""

    def kind(self) -> str:
        return self.t[self.p].kind if self.more() else ""

    def line(self) -> int:
        return self.t[self.p].line if self.more() else (self.t[-1].line if self.t else 1)

    def root(self) -> Node:
        stmts = self.statements(top=True)
        if self.lang.name in ("PHP", "JavaScript", "TypeScript"):
            return Node("Root", 1, [Node("Block", 1, stmts)])
        return Node("Root", 1, stmts)

    def statements(self, top: bool = False) -> list[Node]:
        out: list[Node] = []
        while self.more():
            if self.peek() == "}" and self.kind() == "O":
                if not top:
                    break
                self.p += 1
                continue
            at = self.p
            out += self.statement()
            if self.p == at:
                self.p += 1
        return out

    def block(self) -> Node:
        n = Node("Block", self.line())
        self.p += 1
        n.children = self.statements()
        if self.peek() == "}":
            self.p += 1
        return n

    def expression_group(self) -> list[Node]:
        close = _CLOSER[self.peek()]
        self.p += 1
        out: list[Node] = []
        while self.more() and self.peek() != close:
            if self.kind() == "O" and self.peek() in ")]}":
                break
            out += self.expression_part()
        if self.peek() == close:
            self.p += 1
        return out

    def expression_part(self) -> list[Node]:
        """One token or group of an expression, with the functions that stand in it."""
        t = self.t[self.p]
        if t.kind == "W" and t.text in self.lang.functions and self.lang.name not in ("Kotlin",):
            return self.function(anonymous=True)
        if t.kind == "O" and t.text == "=>" and self.peek(1) == "{" and self.lang.name in ("JavaScript", "TypeScript", "C#", "Dart"):
            line = t.line
            self.p += 1
            return [Node("FunctionDecl", line, [self.block()], name="{closure}")]
        if t.kind == "O" and t.text == "=>" and self.lang.name in ("JavaScript", "TypeScript"):
            self.p += 1
            # after the parameters of a type stands a type
            if self.lang.name == "TypeScript" and self.peek() in _TYPES:
                return []
            return [Node("FunctionDecl", t.line, self.arrow_body(), name="{closure}")]
        if t.kind == "O" and t.text == "->" and self.peek(1) == "{" and self.lang.name == "Java":
            self.p += 1
            return [Node("Other", t.line, [self.block()], kind="lambda_expression")]
        if t.kind == "O" and t.text in "([{":
            if t.text == "{" and self.lang.name in ("JavaScript", "TypeScript"):
                return self.object_literal()
            return self.expression_group()
        self.p += 1
        return []

    def arrow_body(self) -> list[Node]:
        """An expression that is a function's whole body: up to what ends it."""
        out: list[Node] = []
        start = self.p
        while self.more() and not (self.kind() == "O" and self.peek() in (",", ")", "]", "}", ";")):
            t = self.t[self.p]
            if self.p > start and id(t) in self.after_break and t.text not in _CONTINUES and self.t[self.p - 1].text not in _CONTINUES:
                break
            out += self.expression_part()
        return out

    def object_literal(self) -> list[Node]:
        """Methods of an object literal are functions."""
        self.p += 1
        out: list[Node] = []
        while self.more() and self.peek() != "}":
            if self.kind() in "WS" and self.peek(1) == "(":
                name, line = self.peek(), self.line()
                self.p += 1
                inner = self.expression_group()
                out += inner if self.peek() != "{" else [Node("FunctionDecl", line, [self.block()], name=name)]
                continue
            out += self.expression_part()
        self.p += 1
        return out

    def condition(self) -> list[Node]:
        """What stands between a word like if and its body."""
        if self.peek() == "(" and not self.lang.bare_conditions:
            return self.expression_group()
        out: list[Node] = []
        while self.more() and self.peek() != "{":
            if self.peek() == "}" or self.peek() == ";" and self.lang.name != "Go":
                break
            if self.peek() in ("(", "["):
                out += self.expression_group()
            elif self.peek() in self.lang.functions:
                out += self.function(anonymous=True)
            else:
                self.p += 1
        return out

    def head_text(self, a: int, b: int) -> str:
        return " ".join(x.text for x in self.t[a:b] if x.kind != "C")

    def controlled(self) -> list[Node]:
        """The body of a control structure."""
        while self.kind() == "C":
            self.p += 1
        if self.peek() == "{":
            return [self.block()]
        if self.peek() == ";" or self.peek() == "}" or not self.more():
            self.p += self.peek() == ";"
            return []
        line = self.line()
        body = self.statement()
        return [Node("Block", line, body)] if self.lang.wrap_bodies else body

    def if_statement(self) -> Node:
        n = Node("If", self.line())
        self.p += 1
        if self.lang.name == "PHP" and self.alternative("if"):
            return self.alternative_if(n)
        n.children = [*self.condition(), *(self.payload()), *self.controlled()]
        at = self.p
        while self.kind() == "C":
            self.p += 1
        if self.peek() == "else" and self.peek(1) == "if" and self.kind() == "W":
            self.p += 1
            n.children.append(self.if_statement())
        elif self.peek() == "elseif":
            n.children.append(self.if_statement())
        elif self.peek() == "else" and self.kind() == "W":
            self.p += 1
            body = self.payload() + self.controlled()
            if body and body[0].type != "Block":
                body = [Node("Block", body[0].line, body)] if self.lang.wrap_bodies else body
            n.children += body
        else:
            self.p = at
        return n

    def payload(self) -> list[Node]:
        """Zig's |value| after a condition."""
        if self.lang.name == "Zig" and self.peek() == "|":
            self.p += 1
            while self.more() and self.peek() != "|":
                self.p += 1
            self.p += 1
        return []

    # PHP's alternative syntax: if (...): ... endif;
    def alternative(self, word: str) -> bool:
        depth = 0
        for k in range(self.p, len(self.t)):
            x = self.t[k].text
            if x == "(":
                depth += 1
            elif x == ")":
                depth -= 1
                if depth == 0:
                    return k + 1 < len(self.t) and self.t[k + 1].text == ":"
            elif depth == 0:
                return False
        return False

    def until(self, *words: str) -> list[Node]:
        out: list[Node] = []
        while self.more() and self.peek() not in words:
            at = self.p
            out += self.statement()
            if self.p == at:
                self.p += 1
        return out

    def alternative_if(self, n: Node) -> Node:
        self.condition()
        self.p += 1
        n.children = [Node("Block", self.line(), self.until("elseif", "else", "endif"))]
        if self.peek() == "elseif":
            m = Node("If", self.line())
            self.p += 1
            n.children.append(self.alternative_if(m))
            return n
        if self.peek() == "else":
            self.p += 2
            n.children.append(Node("Block", self.line(), self.until("endif")))
        self.p += 1
        if self.peek() == ";":
            self.p += 1
        return n

    def loop(self, word: str) -> Node:
        n = Node({"foreach": "Foreach", "while": "While"}.get(word, "For"), self.line())
        self.p += 1
        if self.peek() == "await":
            self.p += 1
        a = self.p
        head = self.condition()
        mark = self.lang.foreach
        if word == "for" and mark and (mark == "always" or ";" not in self.head_text(a, self.p) and re.search(mark, self.head_text(a, self.p))):
            n.type = "Foreach"
        self.payload()
        if self.lang.name == "Zig" and self.peek() == ":":
            self.p += 1
            self.expression_group()
        if self.lang.name == "PHP" and self.peek() == ":":
            self.p += 1
            n.children = [*head, Node("Block", self.line(), self.until("end" + word))]
            self.p += 1
            if self.peek() == ";":
                self.p += 1
            return n
        n.children = head + self.controlled()
        return n

    def do_statement(self) -> list[Node]:
        line = self.line()
        self.p += 1
        body = self.controlled()
        if self.lang.do_catch:
            catches = self.catches()
            if catches:
                return [Node("TryCatch", line, body + catches)]
            if self.peek() != "while":
                return body
        inner: list[Node] = []
        if self.peek() == "while":
            self.p += 1
            inner = self.condition() if self.peek() == "(" else []
            if self.peek() == ";":
                self.p += 1
        return [Node("Do", line, body + inner)]

    def catches(self) -> list[Node]:
        out: list[Node] = []
        while True:
            at = self.p
            while self.kind() == "C":
                self.p += 1
            w = self.peek()
            if w in ("catch", "@catch") or w == "on" and self.lang.name == "Dart":
                c = Node("CatchClause", self.line())
                self.p += 1
                while self.more() and self.peek() != "{":
                    if self.peek() == "(":
                        self.expression_group()
                    else:
                        self.p += 1
                if self.peek() == "{":
                    c.children = [self.block()]
                out.append(c)
            elif w in ("finally", "@finally"):
                self.p += 1
                if self.peek() == "{":
                    out.append(self.block())
            else:
                self.p = at
                return out

    def try_statement(self) -> list[Node]:
        n = Node("TryCatch", self.line())
        self.p += 1
        if self.peek() == "(":
            self.expression_group()
        elif self.peek() != "{":  # Solidity: try f() returns (...) { }
            while self.more() and self.peek() != "{" and self.peek() not in ";}":
                if self.peek() in "([":
                    self.expression_group()
                else:
                    self.p += 1
        if self.peek() != "{":
            return self.expression_statement()
        n.children = [self.block(), *self.catches()]
        return [n]

    def function(self, anonymous: bool = False) -> list[Node]:
        """A function introduced by a word."""
        start = self.t[self.p]
        word = start.text
        self.p += 1
        name = "constructor" if word == "constructor" else ""
        if self.peek() in ("&", "*"):
            self.p += 1
        if self.lang.name == "Go" and self.peek() == "(" and not anonymous:
            at = self.p
            self.expression_group()
            if self.kind() != "W":
                self.p = at
        if self.kind() == "W" and not name:
            name = self.peek()
            self.p += 1
            while self.peek() in (".", ":") and self.lang.name == "Kotlin":
                self.p += 1
                name = self.peek()
                self.p += 1
        if self.peek() == "<":
            self.angle()
        inner: list[Node] = []
        after_params = self.p
        if self.peek() == "(":
            inner = self.expression_group()
            after_params = self.p
        ends_line = self.lang.newline_ends
        while self.more() and self.peek() not in ("{", ";", "}", ")", ",") and not (self.peek() == "=" and self.lang.name == "Kotlin"):
            if ends_line and id(self.t[self.p]) in self.after_break and self.peek() not in ("->", ":", "where", "throws"):
                break
            if self.peek() in "([":
                self.expression_group()
            elif self.lang.name == "Go" and self.peek() in ("interface", "struct") and self.peek(1) == "{":
                self.p += 1
                self.expression_group()
            else:
                self.p += 1
        n = Node("FunctionDecl", start.line, name=name or "{closure}")
        if self.lang.name == "PHP":
            n.extra = {"start": start.start, "named": bool(name), "head": (start.start, self.t[self.p].start if self.more() else len(self.text)), "params": after_params}
        if self.peek() == "{":
            a = self.p
            n.children = [self.block()]
            if n.extra is not None:
                n.extra["body"] = (a, self.p)
        elif self.peek() == "=" and self.lang.name == "Kotlin":
            self.expression_statement()
        elif self.peek() == ";":
            self.p += 1
        if self.lang.name == "PHP" and anonymous and n.attributes["name"] != "{closure}":
            n.attributes["name"] = "{closure}"
        return [*inner, n]

    def angle(self) -> None:
        depth = 0
        while self.more():
            x = self.peek()
            depth += x == "<"
            depth -= x == ">"
            self.p += 1
            if depth <= 0:
                return

    def statement(self) -> list[Node]:
        t = self.t[self.p]
        w = t.text
        if t.kind == "C":
            self.p += 1
            return [Node("Other", t.line, kind="comment")]
        if t.kind == "O":
            if w == "{":
                return [self.block()]
            if w == ";":
                self.p += 1
                return []
        if t.kind == "W" and self.peek(1) != ":" or w in ("else",):
            if w == "if":
                return [self.if_statement()]
            if w in ("for", "while") or w == "foreach" and self.lang.name in ("PHP", "C#"):
                return [self.loop(w)]
            if w == "loop" and self.lang.name == "Rust" and self.peek(1) == "{":
                self.p += 1
                return [Node("Other", t.line, [self.block()], kind="loop_expression")]
            if w == "do" and (self.peek(1) == "{" or not self.lang.do_catch):
                return self.do_statement()
            if w == "repeat" and self.lang.name == "Swift":
                return self.do_statement()
            if w in ("try", "@try") and self.lang.catches and (self.peek(1) in ("{", "(") or self.lang.name == "Solidity"):
                return self.try_statement()
            if w == "return":
                return [self.return_statement()]
            if w in ("switch", "match", "when") and self.switch_like():
                return [self.switch()]
            if w in ("case", "default"):
                return self.case()
            if w in self.lang.functions and not (self.lang.name == "Solidity" and self.peek(1) == "="):
                return self.function()
        return self.expression_statement()

    def switch_like(self) -> bool:
        """Whether a block follows before the statement ends."""
        depth = 0
        for k in range(self.p + 1, min(len(self.t), self.p + 200)):
            x = self.t[k].text
            depth += x in "(["
            depth -= x in ")]"
            if depth == 0 and x == "{":
                return True
            if depth == 0 and x in (";", "}", "="):
                return False
        return False

    def switch(self) -> Node:
        n = Node("Other", self.line(), kind=f"{self.peek()}_statement")
        self.p += 1
        n.children = self.condition()
        if self.peek() == "{":
            if self.lang.name == "PHP":
                # what a switch holds isn't looked into, only its closures are
                inner = self.block()
                n.children += [x for x in inner.walk() if x.type == "FunctionDecl"]
            else:
                self.p += 1
                n.children += self.statements()
                self.p += 1
        return n

    def case(self) -> list[Node]:
        n = Node("Other", self.line(), kind="case_clause")
        self.p += 1
        while self.more() and self.peek() not in (":", "->", "=>", "{", "}", ";"):
            if self.peek() in "([":
                n.children += self.expression_group()
            else:
                self.p += 1
        if self.peek() in (":", "->", "=>"):
            self.p += 1
        while self.more() and self.peek() not in ("case", "default", "}"):
            at = self.p
            n.children += self.statement()
            if self.p == at:
                self.p += 1
        return [n]

    def return_statement(self) -> Node:
        n = Node("Return", self.line())
        word = self.t[self.p]
        self.p += 1
        if self.lang.newline_ends and self.more() and id(self.t[self.p]) in self.after_break:
            return n
        n.children = self.rest(word)
        return n

    def rest(self, first: Token) -> list[Node]:
        """Up to the end of an expression statement."""
        out: list[Node] = []
        last = first
        while self.more():
            t = self.t[self.p]
            if t.kind == "O" and t.text in (";", "}", ")", "]"):
                self.p += t.text == ";"
                break
            if t.kind == "C":
                if self.lang.newline_ends and id(t) in self.after_break and last.text not in _CONTINUES:
                    break
                self.p += 1
                continue
            if self.lang.newline_ends and id(t) in self.after_break and last is not first and last.text not in _CONTINUES and t.text not in _CONTINUES:
                break
            if self.lang.newline_ends and id(t) in self.after_break and last is first and first.text not in _CONTINUES and t.text not in _CONTINUES and (first.kind in "SD" or first.kind == "W" and first.text not in _JUMPS):
                break
            out += self.expression_part()
            last = self.t[self.p - 1]
        return out

    def expression_statement(self) -> list[Node]:
        """Everything else: declarations of types and functions, assignments, calls."""
        start = self.p
        t = self.t[self.p]
        words: list[str] = []
        paren_end = -1
        paren_name = ""
        seen_equals = False
        out: list[Node] = []
        last = t
        while self.more():
            x = self.t[self.p]
            if x.kind == "O" and x.text in (";", "}", ")", "]"):
                self.p += x.text == ";"
                break
            if self.lang.newline_ends and x is not t and id(x) in self.after_break and last.text not in _CONTINUES and x.text not in _CONTINUES and x.text != "{":
                break
            if x.kind == "C":
                self.p += 1
                continue
            if x.kind == "O" and x.text == "{":
                is_type = any(w in _TYPE_WORDS for w in words[:6]) and not seen_equals or self.lang.name == "Objective-C" and t.text.startswith("@")
                if is_type and not (paren_end >= 0 and self.lang.typed_functions and not any(w in ("class", "interface", "enum", "record", "namespace") for w in words)):
                    return [self.type_body(t, words, out)]
                if not seen_equals and paren_end >= 0 and (self.lang.typed_functions or self.lang.name in ("JavaScript", "TypeScript")) and paren_name and paren_name not in ("if", "while", "switch", "catch"):
                    name = paren_name
                    ctor = self.lang.name in ("C#", "Java") and sum(w == name for w in words) == 1 and words[-1:] == [name] and not self.has_type(words)
                    return [Node("FunctionDecl", t.line, [*out, self.block()], name="constructor" if ctor else name)]
                if not seen_equals and words and (self.lang.typed_functions or self.lang.name in ("Rust", "Swift", "Kotlin", "Solidity", "NyxilumLang", "PHP", "JavaScript", "TypeScript", "Zig", "Objective-C")) and not (self.lang.name == "Kotlin" and paren_end >= 0):
                    body = self.block()
                    return [Node("Other", t.line, [*out, body], kind="block_statement")]
                if self.lang.name in ("Kotlin", "Swift") and last.text not in ("=",):
                    out += self.block_as_lambda()
                else:
                    out += self.expression_part()
                last = self.t[self.p - 1]
                continue
            if x.kind == "W":
                words.append(x.text)
            elif x.kind == "O" and x.text in ("=", "+=", "-=", "*=", "/=", ":=", "=>"):
                seen_equals = True
            if x.kind == "O" and x.text == "(":
                name = last.text if last.kind == "W" else ""
                out += self.expression_group()
                if paren_end < 0 or not seen_equals and self.lang.typed_functions and name and name not in ("throws", "noexcept"):
                    paren_end, paren_name = self.p, name if paren_end < 0 else paren_name or name
                last = self.t[self.p - 1]
                continue
            if x.kind == "W" and x.text in self.lang.functions and x is not t and self.lang.name not in ("Kotlin",) and (seen_equals or self.lang.name in ("JavaScript", "TypeScript", "PHP")):
                prior = self.t[self.p - 1].text
                modifiers = {"public", "private", "protected", "static", "abstract", "final", "export", "default", "async", "pub", "override", "readonly"}
                named_member = prior in modifiers and not seen_equals
                got = self.function(anonymous=not named_member)
                if named_member:
                    return out + got
                out += got
                last = self.t[self.p - 1]
                continue
            if x.kind == "W" and x.text in self.lang.functions and x is not t:
                return out + self.function()
            out += self.expression_part()
            last = self.t[self.p - 1]
        if self.p == start:
            return []
        if self.lang.name == "PHP" and t.kind == "W" and t.text.startswith("$") and start + 1 < len(self.t) and seen_equals:
            return [Node("Assign", t.line, out)]
        return [Node("Other", t.line, out, kind="expression_statement")]

    def has_type(self, words: list[str]) -> bool:
        plain = [w for w in words if w not in ("public", "private", "protected", "internal", "static", "final", "override", "virtual", "abstract", "async", "sealed", "unsafe", "extern", "new", "throws")]
        return len(plain) > 1

    def block_as_lambda(self) -> list[Node]:
        b = self.block()
        return [Node("Other", b.line, b.children, kind="lambda_literal")]

    def type_body(self, t: Token, words: list[str], before: list[Node]) -> Node:
        if self.lang.name == "PHP":
            line = self.line()
            return Node("Block", t.line, [*before, Node("Block", line, self.block().children)])
        body = self.block()
        kind = next((w for w in words if w in _TYPE_WORDS), "type")
        if kind == "enum" and self.lang.name not in ("Java", "Kotlin", "Swift", "Rust"):
            return Node("Other", t.line, kind="enum_declaration")
        return Node("Other", t.line, [*before, Node("Other", body.line, body.children, kind="declaration_list")], kind=f"{kind}_declaration")


# blocks that end with a word ----------------------------------------------------------


class EndReader:
    """Lua and Ruby."""

    def __init__(self, text: str, lang: Language) -> None:
        self.lang, self.lua = lang, lang.name == "Lua"
        self.t = tokens(text, lang)
        self.p = 0

    def skip_lines(self) -> None:
        while self.p < len(self.t) and self.t[self.p].kind == "L":
            self.p += 1

    def peek(self) -> str:
        return self.t[self.p].text if self.p < len(self.t) else ""

    def line(self) -> int:
        return self.t[self.p].line if self.p < len(self.t) else (self.t[-1].line if self.t else 1)

    def root(self) -> Node:
        out = []
        while self.p < len(self.t):
            out += self.statements(())
            if self.p < len(self.t):
                self.p += 1
        return Node("Root", 1, out)

    def statements(self, ends: tuple[str, ...]) -> list[Node]:
        out: list[Node] = []
        while True:
            self.skip_lines()
            if self.p >= len(self.t):
                return out
            t = self.t[self.p]
            if t.kind == "W" and (t.text in ends or not ends and t.text == "end"):
                return out
            at = self.p
            out += self.statement()
            if self.p == at:
                self.p += 1

    def to(self, *words: str) -> list[Node]:
        """Skips up to one of the words or, in Ruby, the end of the line; functions inside count."""
        out: list[Node] = []
        depth = 0
        while self.p < len(self.t):
            t = self.t[self.p]
            if depth == 0 and t.kind == "W" and t.text in words:
                self.p += 1
                return out
            if not self.lua and depth == 0 and (t.kind == "L" or t.text == ";"):
                self.p += 1
                return out
            depth += t.kind == "O" and t.text in "([{"
            depth -= t.kind == "O" and t.text in ")]}"
            if self.lua and t.text == "function" and t.kind == "W":
                out += self.function(False)
                continue
            self.p += 1
        return out

    def close(self) -> None:
        if self.peek() == "end":
            self.p += 1

    def block(self, line: int, *ends: str) -> Node:
        return Node("Block", line, self.statements(ends))

    def function(self, local: bool) -> list[Node]:
        line = self.line()
        self.p += 1
        name = ""
        if self.lua:
            while self.p < len(self.t) and self.peek() != "(":
                name += self.peek()
                self.p += 1
            self.parens()
        else:
            while self.p < len(self.t) and self.t[self.p].kind != "L" and self.peek() not in ("(", ";"):
                name += self.peek()
                self.p += 1
            name = name.split(".")[-1]
            if self.peek() == "(":
                self.parens()
        out = Node("FunctionDecl", line, name=name or "{closure}")
        if not self.lua and self.peek() == "=":
            self.to()
            out.children = [Node("Block", line)]
            return [out]
        if self.lua:
            out.children = [self.block(line, "end")]
        else:
            out.children = self.guarded(line)
        self.close()
        return [out]

    def guarded(self, line: int) -> list[Node]:
        """A Ruby body with optional rescue parts."""
        body = self.block(line, "rescue", "ensure", "else", "end")
        catches = self.rescues()
        return [Node("Block", line, [Node("TryCatch", line, [body, *catches])])] if catches else [body]

    def rescues(self) -> list[Node]:
        out: list[Node] = []
        while self.peek() in ("rescue", "ensure", "else"):
            w, line = self.peek(), self.line()
            self.p += 1
            if w == "rescue":
                self.to("then")
                out.append(Node("CatchClause", line, [self.block(line, "rescue", "ensure", "else", "end")]))
            else:
                self.statements(("rescue", "ensure", "else", "end"))
        return out

    def parens(self) -> None:
        depth = 0
        while self.p < len(self.t):
            x = self.t[self.p]
            depth += x.kind == "O" and x.text in "([{"
            depth -= x.kind == "O" and x.text in ")]}"
            self.p += 1
            if depth <= 0:
                return

    def if_statement(self) -> Node:
        n = Node("If", self.line())
        self.p += 1
        n.children = self.to("then")
        n.children.append(self.block(self.line(), "elseif", "elsif", "else", "end"))
        if self.peek() in ("elseif", "elsif"):
            n.children.append(self.if_statement())
            return n
        if self.peek() == "else":
            self.p += 1
            n.children.append(self.block(self.line(), "end"))
        self.close()
        return n

    def statement(self) -> list[Node]:
        t = self.t[self.p]
        w = t.text
        if t.kind == "C":
            self.p += 1
            return [Node("Other", t.line, kind="comment")]
        if t.kind == "W":
            if w in ("if", "unless"):
                return [self.if_statement()]
            if w in ("while", "until") and (self.lua is False or w == "while"):
                self.p += 1
                head = self.to("do")
                n = Node("While", t.line, [*head, self.block(self.line(), "end")])
                self.close()
                return [n]
            if w == "for":
                self.p += 1
                a = self.p
                head = self.to("do")
                generic = any(x.text == "in" for x in self.t[a : self.p])
                n = Node("Foreach" if generic and self.lua else "For", t.line, [*head, self.block(self.line(), "end")])
                self.close()
                return [n]
            if w == "repeat" and self.lua:
                self.p += 1
                n = Node("Do", t.line, [self.block(t.line, "until")])
                self.p += 1
                n.children += self.expression()
                return [n]
            if w == "do" and self.lua:
                self.p += 1
                b = self.block(t.line, "end")
                self.close()
                return [Node("Other", t.line, [b] if b.children else [], kind="do_statement")]
            if w == "function" and self.lua or w == "def":
                return self.function(False)
            if w == "local" and self.lua and self.p + 1 < len(self.t) and self.t[self.p + 1].text == "function":
                self.p += 1
                return self.function(True)
            if w == "begin":
                self.p += 1
                body = self.block(t.line, "rescue", "ensure", "else", "end")
                n = Node("TryCatch", t.line, [body, *self.rescues()])
                self.close()
                return [n]
            if w in ("class", "module") and not self.lua:
                self.p += 1
                self.to()
                n = Node("Other", t.line, [Node("Block", t.line, self.statements(("end",)))], kind=w)
                self.close()
                return [n]
            if w == "case" and not self.lua:
                self.p += 1
                self.to()
                n = Node("Other", t.line, kind="case")
                while self.peek() in ("when", "in", "else"):
                    self.p += 1
                    self.to("then")
                    n.children += self.statements(("when", "in", "else", "end"))
                    self.skip_lines()
                self.close()
                return [n]
            if w == "return":
                self.p += 1
                a = self.p
                n = Node("Return", t.line, self.expression())
                if not self.lua and any(x.kind == "W" and x.text in ("if", "unless", "while", "until") for x in self.t[a : self.p]):
                    return [Node("Other", t.line, [n], kind="if_modifier")]  # returns only sometimes
                return [n]
        return [Node("Other", t.line, self.expression(), kind="expression_statement")]

    def expression(self) -> list[Node]:
        """Up to the end of the statement; functions and blocks inside are read."""
        out: list[Node] = []
        depth = 0
        start = self.p
        last = ""
        while self.p < len(self.t):
            t = self.t[self.p]
            if t.kind == "L":
                if depth == 0 and self.p > start and last not in _CONTINUES and last not in ("and", "or", "not", "..") and self.next_text() not in _CONTINUES and self.next_text() not in ("and", "or", "..", ")", "]", "}"):
                    return out
                if depth == 0 and self.p == start:
                    return out
                self.p += 1
                continue
            if t.kind == "C":
                if depth == 0 and self.p > start and self.p and self.t[self.p - 1].kind == "L":
                    return out
                self.p += 1
                continue
            if depth == 0 and t.kind == "O" and t.text == ";":
                self.p += 1
                return out
            if depth == 0 and t.kind == "W" and (t.text in ("end", "else", "elseif", "elsif", "until", "rescue", "ensure", "when") if self.lua else t.text in ("end", "rescue", "ensure")):
                return out
            if depth == 0 and self.lua and self.p > start and t.kind == "W" and t.text in ("local", "if", "for", "while", "return", "repeat", "break"):
                return out
            if self.lua and t.kind == "W" and t.text == "function":
                out += self.function(False)
                last = "end"
                continue
            if not self.lua and t.kind == "W" and t.text == "do":
                self.p += 1
                b = self.statements(("end",))
                self.close()
                out.append(Node("Other", t.line, b, kind="do_block"))
                last = "end"
                continue
            depth += t.kind == "O" and t.text in "([{"
            depth -= t.kind == "O" and t.text in ")]}"
            if depth < 0:
                return out
            last = t.text
            self.p += 1
        return out

    def next_text(self) -> str:
        k = self.p
        while k < len(self.t) and self.t[k].kind == "L":
            k += 1
        return self.t[k].text if k < len(self.t) else ""


# Python -------------------------------------------------------------------------------


def _python_comments(text: str) -> list[tuple[int, int]]:
    try:
        return [tok.start for tok in tokenize.generate_tokens(io.StringIO(text).readline) if tok.type == tokenize.COMMENT]
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return []


class PythonReader:
    def __init__(self, text: str) -> None:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            self.tree = ast.parse(text)
        self.comments = _python_comments(text)
        self.lines = text.count("\n") + 1

    def root(self) -> Node:
        last = self.lines
        return Node("Root", 1, self.with_comments(self.statements(self.tree.body), 1, last, 0, self.tree.body))

    def with_comments(self, nodes: list[Node], first: int, last: int, col: int, body: list) -> list[Node]:
        """Comments at the block's own indentation are statements of it."""
        taken = [(s.lineno, s.end_lineno) for s in body]
        own = [Node("Other", line, kind="comment") for line, c in self.comments if first <= line <= last and c == col and not any(a <= line <= b for a, b in taken)]
        return sorted(nodes + own, key=lambda n: n.line)

    def block(self, body: list, header: int, drop_pass: bool = False) -> Node:
        kept = [s for s in body if not (drop_pass and isinstance(s, ast.Pass))]
        line, col = body[0].lineno, body[0].col_offset
        end = body[-1].end_lineno
        # comments after the last statement belong here as long as they are as deep
        k = end
        deep = {a for a, c in self.comments if c == col}
        while k + 1 in deep:
            k += 1
        return Node("Block", line, self.with_comments(self.statements(kept), header, k, col, body))

    def statements(self, body: list) -> list[Node]:
        return [self.statement(s) for s in body]

    def branch(self, s: ast.If) -> Node:
        n = Node("If", s.lineno, [self.block(s.body, s.lineno)])
        if s.orelse:
            first = s.orelse[0]
            if len(s.orelse) == 1 and isinstance(first, ast.If) and first.col_offset == s.col_offset:
                n.children.append(self.branch(first))
            else:
                n.children.append(self.block(s.orelse, s.body[-1].end_lineno))
        return n

    def statement(self, s: ast.stmt) -> Node:
        line = s.lineno
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            return Node("FunctionDecl", line, [self.block(s.body, line)], name=s.name)
        if isinstance(s, ast.Return):
            return Node("Return", line)
        if isinstance(s, ast.If):
            return self.branch(s)
        if isinstance(s, (ast.For, ast.AsyncFor)):
            return Node("Foreach", line, [self.block(s.body, line), *([self.block(s.orelse, s.body[-1].end_lineno)] if s.orelse else [])])
        if isinstance(s, ast.While):
            return Node("While", line, [self.block(s.body, line), *([self.block(s.orelse, s.body[-1].end_lineno)] if s.orelse else [])])
        if isinstance(s, (ast.Try, ast.TryStar)):
            n = Node("TryCatch", line, [self.block(s.body, line)])
            n.children += [Node("CatchClause", h.lineno, [self.block(h.body, h.lineno, drop_pass=True)]) for h in s.handlers]
            for part in (s.orelse, s.finalbody):
                if part:
                    n.children.append(self.block(part, part[0].lineno - 1))
            return n
        if isinstance(s, (ast.With, ast.AsyncWith, ast.ClassDef)):
            return Node("Other", line, [self.block(s.body, line)], kind=type(s).__name__)
        if isinstance(s, ast.Match):
            return Node("Other", line, [Node("Other", c.pattern.lineno, [self.block(c.body, c.pattern.lineno)], kind="case") for c in s.cases], kind="Match")
        return Node("Other", line, kind=type(s).__name__)


# PHP facts -----------------------------------------------------------------------------

_DOC_RETURN = re.compile(r"@return\s+(\S+)")


def php_facts(reader: BraceReader, node: Node) -> dict | None:
    """What the PHP rules ask of a named function: variables, assignments, exempt names,
    whether it has a return type, its doc comment's type and where one could be inserted."""
    x = node.extra
    if not x or not x["named"] or node.attributes["name"] == "{closure}":
        return None
    t, text = reader.t, reader.text
    counts: dict[str, int] = {}
    assigns: list[tuple[str, int]] = []
    exempt: list[str] = []
    dynamic = False
    if "body" in x:
        a, b = x["body"]
        for k in range(a, b):
            tok = t[k]
            if tok.kind == "W" and re.fullmatch(r"\$[A-Za-z_]\w*", tok.text) and t[k - 1].text not in ("::",):
                name = tok.text[1:]
                counts[name] = counts.get(name, 0) + 1
                if k + 1 < b and t[k + 1].text == "=":
                    assigns.append((name, tok.line))
            elif tok.kind == "S" and tok.text[:1] == '"':
                for name in re.findall(r"(?<!\\)\$\{?([A-Za-z_]\w*)", tok.text):
                    counts[name] = counts.get(name, 0) + 1
            elif tok.kind == "W" and k + 1 < b and t[k + 1].text == "(" and tok.text.lower().lstrip("\\") in ("compact", "extract", "get_defined_vars"):
                if tok.text.lower().endswith("get_defined_vars"):
                    dynamic = True
                depth, j = 0, k + 1
                while j < b:
                    depth += t[j].text == "("
                    depth -= t[j].text == ")"
                    if t[j].kind == "S":
                        exempt.append(t[j].text[1:-1])
                    if depth == 0:
                        break
                    j += 1
    head = text[x["head"][0] : x["head"][1]]
    close, depth = -1, 0
    for k, c in enumerate(head):
        depth += c == "("
        depth -= c == ")"
        if c == ")" and depth == 0:
            close = k
            break
    native = close >= 0 and head[close + 1 :].lstrip().startswith(":")
    before = text[: x["start"]]
    m = re.search(r"/\*\*(?:(?!\*/)[\s\S])*\*/\s*(?:#\[[^\]]*\]\s*)*(?:(?:abstract|final|public|protected|private|static)\s+)*\Z", before)
    doc = _DOC_RETURN.search(m.group()) if m else None
    modifiers = re.search(r"(?:(?:abstract|final|public|protected|private|static)\s+)+\Z", before)
    line = node.line - (modifiers.group().count("\n") if modifiers else 0)
    return {
        "variables": [{"name": n, "n": c} for n, c in counts.items()] if "body" in x else [], "assigns": [{"name": n, "line": la} for n, la in assigns], "exempt": exempt, "dynamic": dynamic,
        "native_return": native, "doc_return": doc.group(1) if doc else None, "start_line": line, "insert_at": len(text[: x["head"][0] + close + 1].encode("utf-8", "surrogatepass")) if close >= 0 else -1,
    }


# entry ----------------------------------------------------------------------------------


class ParseError(ValueError):
    """The text isn't valid; the message says where."""


def balanced(text: str, lang: Language) -> bool:
    stack = []
    for t in tokens(text, lang):
        if t.kind == "O" and t.text in "([{":
            stack.append(_CLOSER[t.text])
        elif t.kind == "O" and t.text in ")]}":
            if not stack or stack.pop() != t.text:
                return False
    return not stack


# Operators that need something after them, and what can't come after them.
_NEEDS = _set("= + - / % == != <= >= += -= *= /= ||")
_ENDS = _set("; ) }")


def complete(text: str, lang: Language) -> bool:
    """Whether every assignment and binary operator has an operand after it.

    For languages without a grammar of their own. Operators may be named (``operator +``) or handed over (Swift's
    ``reduce(0, +)``); a Rust text with macros may repeat with them."""
    if lang.name == "Rust" and "macro_rules" in text:
        return True
    before = last = ""
    for t in tokens(text, lang):
        if t.kind in "CL":
            continue
        here = t.text if t.kind == "O" else ""
        if last in _NEEDS and before != "operator" and (here in _ENDS or here == "=" == last) and not (lang.name == "Swift" and here == ")"):
            return False
        before, last = (t.text if t.kind == "W" else last), here
    return True


# Words of Ruby that an ``end`` always closes, and those that one may close.
_CLOSED = _set("def class module begin case")
_MAY_CLOSE = _set("if unless while until for do")


def ends_match(text: str, lang: Language) -> bool:
    """Whether a Ruby text has as many ``end`` as its words can do with, and its brackets match.

    Texts with here-documents or regular expressions aren't judged by their brackets, the former not at all."""
    text = re.split(r"^__END__$", text, maxsplit=1, flags=re.M)[0]
    if re.search(r"<<[-~]?[\"'`]?[A-Z]", text):
        return True
    ts = [t for t in tokens(text, lang) if t.kind != "C"]
    surely = maybe = ends = 0
    for k, t in enumerate(ts):
        if t.kind != "W" or k and ts[k - 1].text in (".", "&.", "::", "def") or k + 1 < len(ts) and ts[k + 1].text == ":" and ts[k + 1].start == t.end:
            continue
        if t.text == "end":
            ends += 1
        elif t.text == "def":
            line = []
            for x in ts[k + 1 :]:
                if x.kind == "L":
                    break
                line.append(x.text)
            short = "=" in line and line.index("=") > 0 and (")" in line[: line.index("=")] or line.index("=") == 1)
            surely += not short
            maybe += 1
        elif t.text in _CLOSED:
            surely += 1
            maybe += 1
        elif t.text in _MAY_CLOSE:
            maybe += 1
    if not surely <= ends <= maybe:
        return False
    return any(t.text in ("/", "%") for t in ts) or balanced(text, lang)


def parse(text: str, lang: Language, with_tree: bool = True, elements: bool = False) -> tuple[Node | None, BraceReader | None]:
    """The canonical tree (None if only validity was asked), and for PHP its reader. Raises ParseError.

    ``elements``: the text may hold elements (JSX), which count as arrays of the expressions in them."""
    if elements:
        text = jsx.without_elements(text)
    if lang.reader == "python":
        try:
            return PythonReader(text).root(), None
        except (SyntaxError, ValueError) as e:
            raise ParseError(f"{getattr(e, 'msg', e)} at line {getattr(e, 'lineno', 1) or 1}") from e
    if lang.grammar:
        if not grammar.parses(text.replace("\r\n", "\n"), lang.grammar):
            raise ParseError(f"not valid {lang.name}")
    elif lang.reader == "brace":
        if not balanced(text, lang):
            raise ParseError("brackets are not balanced")
        if not complete(text, lang):
            raise ParseError("an operator has nothing after it")
    elif not ends_match(text, lang):
        raise ParseError("a block or bracket is not closed")
    if not with_tree:
        return None, None
    if lang.reader == "end":
        return EndReader(text, lang).root(), None
    r = BraceReader(text, lang)
    return r.root(), r if lang.name == "PHP" else None


def genuinely_empty(source: bytes, line: int) -> bool:
    """Whether the braces of the construct on this line hold nothing, not even a comment."""
    if line < 1:
        return False
    at = 0
    for _ in range(line - 1):
        at = source.find(b"\n", at) + 1
        if at == 0:
            return False
    if at >= len(source):
        return False
    last = min(len(source), at + 400)
    # what stands between each pair of braces that opens in the window, by one pass
    found: dict[int, int] = {}
    open_: list[int] = []
    waiting = 0
    for m in re.finditer(rb"[{}]", source[at:]):
        k = at + m.start()
        if m.group() == b"{":
            open_.append(k)
            if k <= last:
                found[k] = -1
                waiting += 1
        elif open_:
            k = open_.pop()
            if k in found:
                found[k] = at + m.start()
                waiting -= 1
        if not waiting and at + m.start() > last:
            break
    for k, end in found.items():
        if end < 0:
            break
        inner = source[k + 1 : end].strip()
        if not inner or not _COMMENTS.sub(b"", inner).strip():
            return not inner
    return True


_COMMENTS = re.compile(rb"/\*[\s\S]*?\*/|//[^\n]*")
