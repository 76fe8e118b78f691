"""Syntax checks over token-class strings (see ``classes.py``).

Bracket groups are reduced innermost first. The content of a group is read by the
local grammar of its language in every role it may play (expression, arguments,
parameters, loop header; statements, object, class body ...); the group is then
replaced by one character that says which roles hold. Contents and single
statements repeat all over a corpus, so each is read once and remembered. A text is
valid iff no bracket is left over and what remains is a valid list of top-level items.

Reduction is associative: any part of a text may be reduced on its own and the
reduced strings joined and reduced further, with the same outcome (``reduce``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from treeline.parsers.classes import WORD_CHARS, token_classes

PAREN, BRACKET, BRACE = 0x2000, 0x2100, 0x2200
IS_PAREN, IS_BRACKET, IS_BRACE = (frozenset(chr(b + m) for m in range(256)) for b in (PAREN, BRACKET, BRACE))
_GROUP = re.compile(r"\(([^()\[\]{}]*+)\)|\[([^()\[\]{}]*+)\]|\{([^()\[\]{}]*+)\}")
_LEFT = re.compile(r"[()\[\]{}]")
REMEMBERED = 300_000


class Bad(Exception):
    """The text isn't what the grammar wants here."""


class Grammar:
    """Shared reading of expressions; subclasses give each language's statements."""

    lang = ""
    #: roles in bit order for each kind of bracket
    paren_roles: tuple[str, ...] = ()
    bracket_roles: tuple[str, ...] = ()
    brace_roles: tuple[str, ...] = ()
    binary = "o+*&<>=?"
    prefix = "+!x*&"
    ends = re.compile("[;∀-⋿]")

    def __init__(self) -> None:
        self.w = WORD_CHARS[self.lang]
        self.seen: dict[str, str] = {}
        self.known: dict[tuple[str, str], str] = {}
        self.s, self.p, self.n = "", 0, 0
        self.k = {w: self.w[w] for w in self.w}
        self.setup()

    def setup(self) -> None: ...

    def chars(self, words: str) -> frozenset[str]:
        return frozenset(self.w[x] for x in words.split() if x in self.w)

    # reading
    def peek(self) -> str:
        return self.s[self.p] if self.p < self.n else ""

    def at(self, c: str) -> bool:
        return self.p < self.n and self.s[self.p] == c

    def word(self, w: str) -> bool:
        return self.p < self.n and self.s[self.p] == self.w[w]

    def take(self, c: str) -> bool:
        if self.p < self.n and self.s[self.p] == c:
            self.p += 1
            return True
        return False

    def takew(self, w: str) -> bool:
        return self.take(self.w[w])

    def need(self, c: str) -> None:
        if not self.take(c):
            raise Bad

    def role(self, base: int, roles: tuple[str, ...], name: str) -> bool:
        """Takes a group that may play the role."""
        if self.p < self.n:
            m = ord(self.s[self.p]) - base
            if 0 <= m < 256 and m >> roles.index(name) & 1:
                self.p += 1
                return True
        return False

    def paren(self, name: str) -> bool:
        return self.role(PAREN, self.paren_roles, name)

    def bracket(self, name: str) -> bool:
        return self.role(BRACKET, self.bracket_roles, name)

    def brace(self, name: str) -> bool:
        return self.role(BRACE, self.brace_roles, name)

    def must(self, ok: object) -> None:
        if not ok:
            raise Bad

    def tries(self, f: Callable[[], object]) -> bool:
        """Runs f; where it fails the position is as before."""
        at = self.p
        try:
            if f() is False:
                self.p = at
                return False
            return True
        except Bad:
            self.p = at
            return False

    def whole(self, s: str, f: Callable[[], object]) -> bool:
        """Whether f reads all of s."""
        kept = self.s, self.p, self.n
        self.s, self.p, self.n = s, 0, len(s)
        try:
            return f() is not False and self.p == self.n
        except (Bad, RecursionError):
            return False
        finally:
            self.s, self.p, self.n = kept

    def commas(self, item: Callable[[], object], trailing: bool = True, empty: bool = True, sep: str = ",") -> None:
        if self.p >= self.n:
            self.must(empty)
            return
        item()
        while self.take(sep):
            if trailing and self.p >= self.n:
                return
            item()

    # expressions
    def expr(self) -> None:
        self.operand()
        while self.p < self.n:
            c = self.s[self.p]
            if c == "?":
                self.p += 1
                if not self.take(":"):
                    self.expr()
                    self.need(":")
                self.operand()
            elif c in self.binary:
                self.p += 1
                self.operand()
            elif not self.more():
                return

    def more(self) -> bool:
        """Reads what may follow an operand besides binary operators."""
        return False

    def operand(self) -> None:
        while self.p < self.n and self.s[self.p] in self.prefix:
            self.p += 1
        self.primary()
        while self.p < self.n and self.postfix():
            pass

    def primary(self) -> None:
        raise NotImplementedError

    def postfix(self) -> bool:
        raise NotImplementedError

    def exprs(self) -> None:
        self.commas(self.expr, trailing=False, empty=False)

    def args(self) -> None:
        self.commas(self.expr, trailing=False)

    # groups
    def role_mask(self, roles: tuple[str, ...], kind: str, content: str) -> int:
        mask = 0
        for bit, name in enumerate(roles):
            if self.whole(content, getattr(self, f"{kind}_{name}")):
                mask |= 1 << bit
        return mask

    def group(self, m: re.Match) -> str:
        whole = m.group()
        got = self.seen.get(whole)
        if got is None:
            k = m.lastindex
            content = whole[1:-1]
            if k == 1:
                got = chr(PAREN + self.role_mask(self.paren_roles, "p", content.replace("N", "")))
            elif k == 2:
                got = chr(BRACKET + self.role_mask(self.bracket_roles, "b", content.replace("N", "")))
            else:
                got = chr(BRACE + self.role_mask(self.brace_roles, "c", content))
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            if len(whole) < 400:
                self.seen[whole] = got
        return got

    def reduce(self, s: str) -> str:
        """All balanced groups of s replaced; brackets without a partner stay."""
        while True:
            s, n = _GROUP.subn(self.group, s)
            if not n:
                return s

    # statements
    def statement(self, ctx: str) -> str:
        """Reads one statement and says what it is: . plain, I if, E else, T try, C catch, Y finally, D do, W a while with nothing to do."""
        raise NotImplementedError

    def statements(self, ctx: str) -> bool:
        s, n, known, kinds = self.s, self.n, self.known, []
        while self.p < n:
            m = self.ends.search(s, self.p)
            e = m.end() if m else n
            piece = s[self.p : e]
            kind = known.get((ctx, piece))
            if kind is None:
                kind = self.statement(ctx)
                if self.p == e:
                    if len(known) > REMEMBERED:
                        known.clear()
                    if len(piece) < 400:
                        known[ctx, piece] = kind
            else:
                self.p = e
            kinds.append(kind)
        return self.ordered("".join(kinds))

    def ordered(self, kinds: str) -> bool:
        """Whether else, catch, finally and while stand where they may."""
        raise NotImplementedError

    def top(self, s: str) -> bool:
        return self.whole(s, lambda: self.statements("top"))

    def valid(self, classes: str | None) -> bool:
        if classes is None:
            return False
        s = self.reduce(classes)
        return not _LEFT.search(s) and self.top(s)


class CGrammar(Grammar):
    lang = "c"
    paren_roles = ("E", "L", "M", "T", "F", "K")
    bracket_roles = ("E", "D")
    brace_roles = ("S", "O", "G", "Z")

    def setup(self) -> None:
        self.types = self.chars("char double float int long short signed unsigned void _Bool")
        self.quals = self.chars("auto const extern inline register restrict static volatile _Atomic typedef")
        self.prefix = "+!x*&"

    def specs(self) -> None:
        got = 0
        while self.p < self.n:
            c = self.s[self.p]
            if c in self.types:
                got = 2
            elif c in self.quals:
                pass
            elif c == "i" and not got:
                got = 1
            elif c in (self.k["struct"], self.k["union"]):
                self.p += 1
                named = self.take("i")
                self.must(self.brace("G") or named)
                got = 2
                continue
            elif c == self.k["enum"]:
                self.p += 1
                named = self.take("i")
                self.must(self.brace("Z") or named)
                got = 2
                continue
            else:
                break
            self.p += 1
        self.must(got)

    def declarator(self, abstract: bool = False) -> None:
        while self.p < self.n and (self.s[self.p] == "*" or self.s[self.p] in self.quals):
            self.p += 1
        if not self.take("i") and not self.paren("K"):
            self.must(abstract)
        while self.paren("M") or self.bracket("D"):
            pass

    def type_name(self) -> None:
        self.specs()
        self.declarator(True)

    def init(self) -> None:
        if not self.brace("O"):
            self.expr()

    def one_declarator(self) -> None:
        if not self.at(":"):
            self.declarator()
        if self.take(":"):
            self.expr()
        if self.take("="):
            self.init()

    def declaration(self) -> bool:
        """True for a function body, False after a ';'."""
        self.specs()
        if self.take(";"):
            return False
        while True:
            self.one_declarator()
            if self.brace("S"):
                return True
            if not self.take(","):
                self.need(";")
                return False

    def primary(self) -> None:
        c = self.peek()
        if c in ("i", "n"):
            self.p += 1
        elif c == "s":
            while self.take("s") or (self.at("i") and self.p + 1 < self.n and self.s[self.p + 1] == "s" and self.take("i")):
                pass
            self.take("i") if self.s[self.p - 1] == "s" and self.at("i") else None
        elif c == self.k["sizeof"]:
            self.p += 1
            if not self.paren("T"):
                self.operand()
        elif c in IS_PAREN:
            at = self.p
            if self.paren("T"):
                if self.brace("O"):
                    return
                nxt = self.peek()
                if nxt and (nxt in "ins+!x*&" or nxt in IS_PAREN or nxt == self.k["sizeof"]):
                    after = self.p
                    if self.tries(self.operand):
                        return
                    self.p = after
                self.p = at
            self.must(self.paren("E"))
        else:
            raise Bad

    def postfix(self) -> bool:
        c = self.s[self.p]
        if c == "x":
            self.p += 1
            return True
        if c in ".r":
            self.p += 1
            self.need("i")
            return True
        return self.paren("L") or self.bracket("E")

    def statement(self, ctx: str) -> str:
        c = self.peek()
        k = self.k
        if ctx == "top":
            if self.take(";"):
                return "."
            if c == k["extern"] and self.p + 1 < self.n and self.s[self.p + 1] == "s":
                self.p += 2
                self.must(self.brace("S"))
                return "."
            if c == k["_Static_assert"]:
                self.p += 1
                self.must(self.paren("L"))
                self.need(";")
                return "."
            if not self.tries(lambda: (self.declaration(),)):
                self.need("i")  # a macro used as a declaration
                self.must(self.paren("L"))
                self.need(";")
            return "."
        if self.brace("S") or self.take(";"):
            return "."
        if c == k["if"]:
            self.p += 1
            self.must(self.paren("E"))
            self.body()
            return "I"
        if c == k["else"]:
            self.p += 1
            if self.takew("if"):
                self.must(self.paren("E"))
                self.body()
                return "EI"
            self.body()
            return "E"
        if c == k["for"]:
            self.p += 1
            self.must(self.paren("F"))
            self.body()
            return "."
        if c == k["while"]:
            self.p += 1
            self.must(self.paren("E"))
            if self.take(";"):
                return "W"
            self.body()
            return "."
        if c == k["do"]:
            self.p += 1
            self.body()
            return "D"
        if c == k["switch"]:
            self.p += 1
            self.must(self.paren("E"))
            self.body()
            return "."
        if c == k["case"]:
            self.p += 1
            self.expr_no_colon()
            if self.take("e"):
                self.expr_no_colon()
            self.need(":")
            return "."
        if c == k["default"]:
            self.p += 1
            self.need(":")
            return "."
        if c == k["return"]:
            self.p += 1
            if not self.at(";"):
                self.exprs()
            self.need(";")
            return "."
        if c in (k["break"], k["continue"]):
            self.p += 1
            self.need(";")
            return "."
        if c == k["goto"]:
            self.p += 1
            self.need("i")
            self.need(";")
            return "."
        if c == "i" and self.p + 1 < self.n and self.s[self.p + 1] == ":":
            self.p += 2
            return "."
        if self.tries(lambda: self.must(self.declaration() is False)):
            return "."
        self.exprs()
        self.need(";")
        return "."

    def expr_no_colon(self) -> None:
        self.expr()

    def body(self) -> None:
        """One statement as the body of another; an if takes its else along."""
        kind = self.statement("in")
        while kind[-1] == "I" and self.p < self.n and self.s[self.p] == self.k["else"]:
            kind = self.statement("in")
            if kind == "E":
                return
        if kind == "D":
            self.must(self.statement("in") == "W")
        elif kind == "T":
            seen = False
            while self.p < self.n and self.peek() in (self.w.get("catch"), self.w.get("finally")):
                self.statement("in")
                seen = True
            self.must(seen)
        elif kind[0] in "ECY":
            raise Bad

    def ordered(self, kinds: str) -> bool:
        if not kinds.strip("."):
            return True
        # "EI" is an else-if; a body that took its own else may be followed by one more
        return bool(re.fullmatch(r"(?:[.W]|I(?:EI)*(?:E(?!I))?|T(?:C+Y?|Y)|DW)*", kinds))

    # groups
    def p_E(self) -> None:
        self.exprs()

    def p_L(self) -> None:
        def arg() -> None:
            if not self.tries(lambda: (self.expr(), self.must(self.p >= self.n or self.at(",")))):
                self.type_name()

        self.commas(arg, trailing=False)

    def p_T(self) -> None:
        self.type_name()

    def p_K(self) -> None:
        self.declarator()

    def p_M(self) -> None:
        def one() -> None:
            if self.take("e"):
                self.must(self.p >= self.n)
                return
            self.specs()
            self.declarator(True)

        self.commas(one, trailing=False)

    def p_F(self) -> None:
        if not self.take(";"):
            if not self.tries(lambda: self.declaration() is False or self.must(False)):
                self.exprs()
                self.need(";")
        if not self.at(";"):
            self.exprs()
        self.need(";")
        if self.p < self.n:
            self.exprs()

    def b_E(self) -> None:
        self.exprs()

    def b_D(self) -> None:
        while self.p < self.n and self.s[self.p] in self.quals:
            self.p += 1
        if self.p < self.n:
            self.expr()

    def c_S(self) -> bool:
        return self.statements("in")

    def c_O(self) -> None:
        def item() -> None:
            got = False
            while self.take(".") and self.take("i") or self.bracket("E"):
                got = True
            if got:
                self.need("=")
            self.init()

        self.commas(item)

    def c_G(self) -> None:
        while self.p < self.n:
            if self.take(";"):
                continue
            self.specs()
            if self.take(";"):
                continue
            self.one_declarator()
            while self.take(","):
                self.one_declarator()
            self.need(";")

    def c_Z(self) -> None:
        def item() -> None:
            self.need("i")
            if self.take("="):
                self.expr()

        self.commas(item)


class JsGrammar(Grammar):
    lang = "js"
    paren_roles = ("E", "L", "M", "F", "T")
    bracket_roles = ("E", "L", "T")
    brace_roles = ("S", "O", "K", "W", "Z", "T")
    binary = "o+*&<>="
    prefix = "+!x"
    ends = re.compile("[;N∀-⋿]")
    typed = False

    def setup(self) -> None:
        k = self.k
        self.soft = frozenset("i") | self.chars("of get set as from async static let await yield type namespace module declare abstract readonly keyof infer is satisfies unique asserts override private protected public")
        self.names = frozenset(self.w.values()) | {"i"}
        self.values = self.chars("this super")
        self.unary = self.chars("typeof void delete await")
        self.modifiers = self.chars("static async get set readonly abstract public private protected override declare")
        self.k = k

    def more(self) -> bool:
        c = self.s[self.p]
        if c == self.k["instanceof"] or c == self.k["in"] and not self.no_in:
            self.p += 1
            self.operand()
            return True
        if self.typed and c in (self.k["as"], self.k["satisfies"]):
            self.p += 1
            if not self.takew("const"):
                self.type()
            return True
        return False

    no_in = False

    def expr(self) -> None:
        self.operand()
        while self.p < self.n:
            c = self.s[self.p]
            if c == "?":
                self.p += 1
                self.expr()
                self.need(":")
                self.expr()
            elif c in self.binary:
                self.p += 1
                if c == ">":
                    while self.take(">"):
                        pass
                    self.take("=")
                self.operand()
            elif not self.more():
                return

    def operand(self) -> None:
        while self.p < self.n and (self.s[self.p] in self.prefix or self.s[self.p] in self.unary):
            c = self.s[self.p]
            if c == self.k["await"] and not self.starts_operand(self.p + 1):
                break
            self.p += 1
        self.primary()
        while self.p < self.n and self.postfix():
            pass

    def starts_operand(self, p: int) -> bool:
        if p >= self.n:
            return False
        c = self.s[p]
        return c in "inst+!x" or c in IS_PAREN or c in IS_BRACKET or c in IS_BRACE or c in self.names and c not in (self.k["in"], self.k["instanceof"], self.k["of"], self.k["as"])

    def fbody(self) -> None:
        self.must(self.brace("S"))

    def params(self) -> None:
        if self.typed and self.at("<"):
            self.type_params()
        self.must(self.paren("M"))
        if self.typed and self.take(":"):
            self.return_type()

    def arrow_rest(self) -> None:
        self.need("a")
        if not self.brace("S"):
            self.expr()

    def function(self) -> None:
        self.take("*")
        if self.peek() in self.soft and self.peek():
            self.p += 1
        self.params()
        self.fbody()

    def klass(self) -> None:
        self.decorators()
        self.need(self.k["class"])
        if self.peek() and self.peek() in self.soft:
            self.p += 1
        if self.typed and self.at("<"):
            self.type_params()
        if self.takew("extends"):
            self.operand()
            if self.typed and self.at("<"):
                self.type_args()
        if self.typed and self.take(self.w.get("implements", "\0")):
            self.type()
            while self.take(","):
                self.type()
        self.must(self.brace("K"))

    def decorators(self) -> None:
        while self.take("@"):
            if not self.paren("E"):
                self.must(self.peek() in self.names and self.peek())
                self.p += 1
                while self.take("."):
                    self.must(self.peek() in self.names and self.peek())
                    self.p += 1
                self.paren("L")
            self.take("N")

    def arrow(self) -> None:
        """( params ) [: type] => body, or name => body"""
        if self.typed and self.at("<"):
            self.type_params()
        if self.peek() and self.peek() in self.soft:
            self.p += 1
        else:
            self.must(self.paren("M"))
            if self.typed and self.take(":"):
                self.return_type()
        self.arrow_rest()

    def primary(self) -> None:
        c = self.peek()
        k = self.k
        if not c:
            raise Bad
        nxt = self.s[self.p + 1] if self.p + 1 < self.n else ""
        if c == k["async"] and nxt:
            if nxt == k["function"]:
                self.p += 2
                return self.function()
            at = self.p
            self.p += 1
            if self.tries(self.arrow):
                return None
            self.p = at
        if c == k["yield"] and (nxt == "*" or self.starts_operand(self.p + 1)):
            self.p += 1
            self.take("*")
            return self.expr()
        if c in self.soft:
            if nxt == "a":
                self.p += 1
                return self.arrow_rest()
            self.p += 1
            return None
        if c in "nst" or c in self.values:
            self.p += 1
            return None
        if c in IS_PAREN:
            if nxt == "a" or nxt == ":" and self.typed:
                if self.tries(self.arrow):
                    return None
            return self.must(self.paren("E"))
        if c in IS_BRACKET:
            return self.must(self.bracket("L"))
        if c in IS_BRACE:
            return self.must(self.brace("O"))
        if c == k["function"]:
            self.p += 1
            return self.function()
        if c == k["class"] or c == "@":
            return self.klass()
        if c == k["new"]:
            self.p += 1
            if self.take("."):
                return self.need("i")
            return self.operand()
        if c == k["import"]:
            self.p += 1
            if self.take("."):
                return self.need("i")
            return self.must(self.paren("L"))
        if c == "<" and self.typed:
            if self.tries(self.arrow):
                return None
            self.p += 1
            self.type()
            self.need(">")
            return self.operand()
        raise Bad

    def postfix(self) -> bool:
        c = self.s[self.p]
        if c == "x":
            self.p += 1
            return True
        if c == ".":
            self.p += 1
            self.must(self.peek() in self.names and self.peek())
            self.p += 1
            return True
        if c == "q":
            self.p += 1
            if not (self.paren("L") or self.bracket("E")):
                self.must(self.peek() in self.names and self.peek())
                self.p += 1
            return True
        if c == "t":
            self.p += 1
            return True
        if self.typed:
            if c == "!":
                self.p += 1
                return True
            if c == "<":
                return self.tries(lambda: (self.type_args(), self.must(self.p < self.n and (self.s[self.p] in IS_PAREN or self.s[self.p] == "t"))))
        return self.paren("L") or self.bracket("E")

    # types (TypeScript)
    def type_params(self) -> None:
        self.need("<")
        while True:
            while self.peek() in (self.k["const"], self.k["in"]):
                self.p += 1
            self.must(self.peek() and self.peek() in self.soft)
            self.p += 1
            if self.takew("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(",") or self.at(">"):
                break
        self.need(">")

    def type_args(self) -> None:
        self.need("<")
        self.type()
        while self.take(","):
            self.type()
        self.need(">")

    def return_type(self) -> None:
        if self.peek() == self.k["asserts"] and self.p + 1 < self.n and self.s[self.p + 1] in self.soft | self.values:
            self.p += 1
        if self.p + 1 < self.n and self.s[self.p + 1] == self.k["is"]:
            self.p += 2
        self.type()

    def type(self) -> None:
        if self.peek() in ("o", "&"):
            self.p += 1
        self.type_one()
        while self.p < self.n:
            c = self.s[self.p]
            if c in ("o", "&"):
                self.p += 1
                self.type_one()
            elif c == self.k["extends"]:
                at = self.p
                self.p += 1
                self.type_one()
                if not self.take("?"):
                    self.p = at
                    return
                self.type()
                self.need(":")
                self.type()
            else:
                return

    def type_one(self) -> None:
        c = self.peek()
        k = self.k
        if not c:
            raise Bad
        if c in (k["keyof"], k["readonly"], k["unique"], k["infer"], k["typeof"]) and self.p + 1 < self.n and (self.s[self.p + 1] in self.names or self.s[self.p + 1] in IS_PAREN or self.s[self.p + 1] in IS_BRACKET or self.s[self.p + 1] in IS_BRACE):
            self.p += 1
            return self.type_one()
        if c == k["new"] or c == k["abstract"]:
            self.p += 1
            return self.type_one()
        if c == "<":
            self.type_params()
            self.must(self.paren("M"))
            self.need("a")
            return self.return_type()
        if c in IS_PAREN and self.p + 1 < self.n and self.s[self.p + 1] == "a":
            self.must(self.paren("M"))
            self.p += 1
            return self.return_type()
        if c in self.soft or c in (k["void"], k["this"], k["import"]):
            self.p += 1
            if c == k["import"]:
                self.must(self.paren("L"))
            while self.take("."):
                self.must(self.peek() in self.names)
                self.p += 1
            if self.at("<"):
                self.type_args()
        elif c in "nst":
            self.p += 1
        elif c == "+" and self.p + 1 < self.n and self.s[self.p + 1] == "n":
            self.p += 2
        else:
            self.must(self.paren("T") or self.bracket("T") or self.brace("T"))
        while self.p < self.n and self.s[self.p] in IS_BRACKET:
            if not self.bracket("T"):
                break
        return None

    # patterns
    def pattern(self) -> None:
        if self.peek() and self.peek() in self.soft:
            self.p += 1
        else:
            self.must(self.bracket("L") or self.brace("O"))

    def binding(self) -> None:
        self.pattern()
        if self.typed:
            self.take("!")
            if self.take(":"):
                self.type()
        if self.take("="):
            self.expr()

    def end(self) -> None:
        if self.p < self.n and not (self.take(";") or self.take("N")):
            raise Bad

    def skip(self) -> None:
        while self.take("N"):
            pass

    def declare_var(self) -> None:
        self.p += 1
        self.binding()
        while self.take(","):
            self.take("N")
            self.binding()

    def statement(self, ctx: str) -> str:
        c = self.peek()
        k = self.k
        nxt = self.s[self.p + 1] if self.p + 1 < self.n else ""
        if c == ";" or c == "N":
            self.p += 1
            return "n" if c == "N" else "."
        if c in IS_BRACE and self.brace("S"):
            return "."
        if c in (k["var"], k["const"], k["let"]) and nxt and (c != k["let"] or nxt in self.soft or nxt in IS_BRACKET or nxt in IS_BRACE):
            if c == k["const"] and self.typed and nxt == k["enum"]:
                self.p += 1
                return self.statement(ctx)
            self.declare_var()
            self.end()
            return "."
        if c == k["function"] or c == k["async"] and nxt == k["function"]:
            self.p += 1 + (c == k["async"])
            self.take("*")
            self.must(self.peek() and self.peek() in self.soft)
            self.p += 1
            self.params()
            if not self.brace("S"):
                self.must(self.typed)
                self.end()
            return "."
        if c == k["class"] or c == "@":
            if c == "@":
                self.decorators()
                if self.takew("export"):
                    self.takew("default")
                self.typed and self.takew("abstract")
            self.klass()
            return "."
        if c == k["if"]:
            self.p += 1
            self.must(self.paren("E"))
            self.body()
            return "I"
        if c == k["else"]:
            self.p += 1
            self.skip()
            if self.takew("if"):
                self.must(self.paren("E"))
                self.body()
                return "EI"
            self.body()
            return "E"
        if c == k["for"]:
            self.p += 1
            self.takew("await")
            self.must(self.paren("F"))
            self.body()
            return "."
        if c == k["while"]:
            self.p += 1
            self.must(self.paren("E"))
            if self.take(";"):
                return "W"
            at = self.p
            if self.p >= self.n or self.at("N"):
                self.skip()
                if not self.tries(self.body):
                    self.p = at
                    self.take("N")
                    return "W"
                return "V"  # either the end of a do or a loop
            self.body()
            return "."
        if c == k["do"]:
            self.p += 1
            self.body()
            return "D"
        if c == k["switch"]:
            self.p += 1
            self.must(self.paren("E"))
            self.must(self.brace("W"))
            return "."
        if ctx == "switch" and c == k["case"]:
            self.p += 1
            self.exprs()
            self.need(":")
            return "."
        if ctx == "switch" and c == k["default"]:
            self.p += 1
            self.need(":")
            return "."
        if c == k["return"]:
            self.p += 1
            if self.p < self.n and self.s[self.p] not in ";N":
                self.exprs()
            self.end()
            return "."
        if c in (k["break"], k["continue"]):
            self.p += 1
            if self.peek() and self.peek() in self.soft:
                self.p += 1
            self.end()
            return "."
        if c == k["throw"]:
            self.p += 1
            self.exprs()
            self.end()
            return "."
        if c == k["debugger"]:
            self.p += 1
            self.end()
            return "."
        if c == k["try"]:
            self.p += 1
            self.must(self.brace("S"))
            return "T"
        if c == k["catch"]:
            self.p += 1
            self.paren("M")
            self.must(self.brace("S"))
            return "C"
        if c == k["finally"]:
            self.p += 1
            self.must(self.brace("S"))
            return "Y"
        if c == k["import"] and nxt not in IS_PAREN and nxt != ".":
            self.must(ctx == "top" or self.typed)
            self.p += 1
            self.typed and nxt == k["type"] and self.p + 1 < self.n and self.s[self.p + 1] != k["from"] and self.takew("type")
            if not self.take("s"):
                while True:
                    if self.take("*"):
                        self.need(k["as"])
                        self.need("i")
                    elif not self.brace("Z"):
                        self.must(self.peek() and self.peek() in self.soft)
                        self.p += 1
                    if not self.take(","):
                        break
                if self.typed and self.take("="):
                    self.expr()
                    self.end()
                    return "."
                self.need(k["from"])
                self.need("s")
            if self.peek() in (k["with"], "i") and nxt and self.p + 1 < self.n and self.s[self.p + 1] in IS_BRACE:
                self.p += 1
                self.must(self.brace("O"))
            self.end()
            return "."
        if c == k["export"]:
            self.must(ctx == "top" or self.typed)
            self.p += 1
            if self.takew("default"):
                if self.peek() in (k["function"], k["async"]) and self.tries(lambda: (self.takew("async"), self.need(k["function"]), self.function())):
                    return "."
                if self.peek() in (k["class"], "@") or self.typed and self.peek() == k["abstract"]:
                    self.typed and self.takew("abstract")
                    self.klass()
                    return "."
                if self.typed and self.peek() == k["interface"]:
                    return self.statement(ctx)
                self.expr()
                self.end()
                return "."
            if self.typed and self.take("="):
                self.expr()
                self.end()
                return "."
            if self.typed and self.at(k["type"]) and self.p + 1 < self.n and self.s[self.p + 1] in IS_BRACE:
                self.p += 1
            if self.at("*") or self.peek() in IS_BRACE:
                star = self.take("*")
                if star:
                    if self.takew("as"):
                        self.must(self.peek() in self.names)
                        self.p += 1
                else:
                    self.must(self.brace("Z"))
                if self.takew("from"):
                    self.need("s")
                else:
                    self.must(not star)
                self.end()
                return "."
            self.must(self.peek() in (k["var"], k["let"], k["const"], k["function"], k["async"], k["class"], "@") or self.typed and self.peek() in (k["interface"], k["type"], k["enum"], k["declare"], k["namespace"], k["module"], k["abstract"], k["import"]))
            return self.statement(ctx)
        if self.typed and (got := self.typed_statement(c, nxt, ctx)):
            return got
        if c in self.soft and nxt == ":":
            self.p += 2
            return "."
        if c in IS_BRACE:
            self.must(self.p + 1 < self.n and self.s[self.p + 1] == "=")
        self.exprs()
        self.end()
        return "."

    def typed_statement(self, c: str, nxt: str, ctx: str) -> str:
        return ""

    def body(self) -> None:
        self.skip()
        kind = self.statement("in")
        while kind[-1] == "I" and self.p < self.n:
            at = self.p
            self.skip()
            if not self.at(self.k["else"]):
                self.p = at
                return
            kind = self.statement("in")
            if kind == "E":
                return
        if kind == "D":
            self.skip()
            self.must(self.statement("in") in ("W", "V"))
        elif kind == "T":
            seen = False
            while True:
                at = self.p
                self.skip()
                if self.peek() in (self.k["catch"], self.k["finally"]) and self.peek():
                    self.statement("in")
                    seen = True
                else:
                    self.p = at
                    break
            self.must(seen)
        elif kind[0] in "ECY":
            raise Bad

    def ordered(self, kinds: str) -> bool:
        kinds = kinds.replace("n", "")
        if not kinds.strip("."):
            return True
        return bool(re.fullmatch(r"(?:[.WV]|I(?:EI)*(?:E(?!I))?|T(?:C+Y?|Y)|D[WV])*", kinds))

    # groups
    def spread(self) -> None:
        self.take("e")
        self.expr()

    def p_E(self) -> None:
        self.exprs()

    def p_L(self) -> None:
        self.commas(self.spread)

    def p_M(self) -> None:
        def one() -> None:
            if self.typed:
                self.decorators()
                while self.peek() in self.modifiers and self.p + 1 < self.n and (self.s[self.p + 1] in self.soft or self.s[self.p + 1] in IS_BRACE):
                    self.p += 1
            self.take("e")
            if self.typed and self.takew("this"):
                pass
            else:
                self.pattern()
            if self.typed:
                self.take("?")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.expr()

        self.commas(one)

    def p_T(self) -> None:
        self.must(self.typed)
        self.type()

    def p_F(self) -> None:
        self.no_in = True
        try:
            if not self.at(";"):
                if self.peek() in (self.k["var"], self.k["let"], self.k["const"]):
                    self.declare_var()
                else:
                    self.exprs()
                if self.peek() and self.peek() in (self.k["of"], self.k["in"]):
                    self.p += 1
                    self.no_in = False
                    self.exprs()
                    return
            self.no_in = False
            self.need(";")
            if not self.at(";"):
                self.exprs()
            self.need(";")
            if self.p < self.n:
                self.exprs()
        finally:
            self.no_in = False

    def b_E(self) -> None:
        self.exprs()

    def b_L(self) -> None:
        while self.p < self.n:
            if self.take(","):
                continue
            self.spread()
            if self.p < self.n:
                self.need(",")

    def b_T(self) -> None:
        self.must(self.typed)
        if self.p >= self.n:
            return

        def one() -> None:
            self.take("e")
            if self.peek() in self.soft and self.p + 1 < self.n and self.s[self.p + 1] in "?:":
                self.p += 1
                self.take("?")
                self.need(":")
            self.type()
            self.take("?")

        self.commas(one)

    def c_S(self) -> bool:
        return self.statements("in")

    def c_W(self) -> bool:
        self.skip()
        self.must(self.p >= self.n or self.peek() in (self.k["case"], self.k["default"]))
        return self.statements("switch")

    def key(self) -> None:
        if self.peek() and (self.peek() in self.names or self.peek() in "ns"):
            self.p += 1
        else:
            self.must(self.bracket("E"))

    def method_rest(self) -> None:
        self.params()
        self.fbody()

    def c_O(self) -> None:
        def item() -> None:
            self.skip()
            if self.take("e"):
                self.expr()
            else:
                at = self.p
                if not self.tries(lambda: self.plain_item()):
                    self.p = at
                    while self.peek() in (self.k["async"], self.k["get"], self.k["set"]) and self.peek():
                        self.p += 1
                    self.take("*")
                    self.key()
                    self.method_rest()
            self.skip()

        self.skip()
        self.commas(item)

    def plain_item(self) -> None:
        short = self.peek() in self.soft
        self.key()
        if self.take(":"):
            self.expr()
        elif self.peek() and self.s[self.p] in IS_PAREN or self.typed and self.at("<"):
            self.method_rest()
        elif short and self.take("="):
            self.expr()
        else:
            self.must(short and (self.p >= self.n or self.s[self.p] in ",N"))

    def c_K(self) -> None:
        while self.p < self.n:
            if self.take(";") or self.take("N"):
                continue
            self.decorators()
            if self.at(self.k["static"]) and self.p + 1 < self.n and self.s[self.p + 1] in IS_BRACE:
                self.p += 1
                self.must(self.brace("S"))
                continue
            while self.peek() in self.modifiers and self.peek() and self.p + 1 < self.n and (self.s[self.p + 1] in self.names or self.s[self.p + 1] in "sn*" or self.s[self.p + 1] in IS_BRACKET):
                self.p += 1
            self.take("*")
            if self.typed and self.peek() in IS_BRACKET and self.tries(lambda: (self.bracket("T") or self.must(False), self.need(":"), self.type(), self.end())):
                continue
            self.key()
            if self.typed:
                self.take("?") or self.take("!")
            if self.peek() and self.s[self.p] in IS_PAREN or self.typed and self.at("<"):
                self.params()
                if not self.brace("S"):
                    self.must(self.typed)
                    self.end()
                continue
            if self.typed and self.take(":"):
                self.type()
            if self.take("="):
                self.expr()
            self.end()

    def c_Z(self) -> None:
        def item() -> None:
            self.skip()
            if self.typed and self.at(self.k["type"]) and self.p + 1 < self.n and self.s[self.p + 1] in self.names and self.s[self.p + 1] != self.k["as"]:
                self.p += 1
            self.key()
            if self.takew("as"):
                self.must(self.peek() in self.names or self.at("s"))
                self.p += 1
            elif self.typed and self.take("="):
                self.expr()
            self.skip()

        self.skip()
        self.commas(item)

    def c_T(self) -> None:
        self.must(self.typed)
        while self.p < self.n:
            if self.p < self.n and self.s[self.p] in ";,N":
                self.p += 1
                continue
            while self.peek() in (self.k["readonly"], self.k["get"], self.k["set"], "+") and self.peek() and self.p + 1 < self.n and (self.s[self.p + 1] in self.names or self.s[self.p + 1] in "sn" or self.s[self.p + 1] in IS_BRACKET):
                self.p += 1
            self.takew("new") if self.p + 1 < self.n and self.s[self.p + 1] in IS_PAREN else None
            if self.peek() and self.s[self.p] in IS_PAREN or self.at("<"):
                self.params()
            else:
                if not (self.peek() in IS_BRACKET and self.bracket("T")):
                    self.key()
                self.take("+")
                self.take("?")
                if self.peek() and self.s[self.p] in IS_PAREN or self.at("<"):
                    self.params()
                elif self.take(":"):
                    self.type()
            self.must(self.p >= self.n or self.s[self.p] in ";,N")


class TsGrammar(JsGrammar):
    lang = "ts"
    typed = True

    def b_T(self) -> None:
        # an index signature or mapped type: [key: type], [K in type]
        if self.peek() in self.soft and self.p + 1 < self.n and self.s[self.p + 1] == self.k["in"]:
            self.p += 2
            self.type()
            if self.takew("as"):
                self.type()
            return
        super().b_T()

    def typed_statement(self, c: str, nxt: str, ctx: str) -> str:
        k = self.k
        if c == k["interface"] and nxt in self.soft:
            self.p += 2
            if self.at("<"):
                self.type_params()
            if self.takew("extends"):
                self.type()
                while self.take(","):
                    self.type()
            self.must(self.brace("T"))
            return "."
        if c == k["type"] and nxt and nxt in self.soft:
            self.p += 2
            if self.at("<"):
                self.type_params()
            self.need("=")
            self.type()
            self.end()
            return "."
        if c == k["enum"]:
            self.p += 1
            self.need("i")
            self.must(self.brace("Z"))
            return "."
        if c == k["declare"] and nxt and nxt in self.names:
            self.p += 1
            return self.statement(ctx)
        if c == k["abstract"] and nxt == k["class"]:
            self.p += 1
            self.klass()
            return "."
        if c in (k["namespace"], k["module"]) and nxt and (nxt in self.soft or nxt == "s"):
            self.p += 2
            while self.take("."):
                self.need("i")
            if not self.brace("S"):
                self.end()
            return "."
        return ""


class JavaGrammar(CGrammar):
    lang = "java"
    paren_roles = ("E", "L", "M", "T", "F", "R", "U")
    bracket_roles = ("E", "D")
    brace_roles = ("S", "O", "K", "W", "Z", "N")
    binary = "o+*&<>="

    def setup(self) -> None:
        k = self.k
        self.prim = self.chars("boolean byte char double float int long short void")
        self.mods = self.chars("abstract default final native private protected public static strictfp synchronized transient volatile sealed non")
        self.soft = frozenset("i") | self.chars("record sealed permits non yield var")
        self.prefix = "+!x"

    def name(self) -> None:
        self.must(self.peek() and self.peek() in self.soft)
        self.p += 1

    def annotations(self) -> None:
        while self.at("@") and not (self.p + 1 < self.n and self.s[self.p + 1] == self.k["interface"]):
            self.p += 1
            self.name()
            while self.take("."):
                self.name()
            self.paren("L")

    def modifiers(self) -> None:
        while True:
            self.annotations()
            c = self.peek()
            if c and c in self.mods:
                nxt = self.s[self.p + 1] if self.p + 1 < self.n else ""
                if c == self.k["non"]:
                    self.must(nxt == "+")
                    self.p += 3
                    continue
                if c == self.k["sealed"] and nxt in "=.;,":
                    return
                self.p += 1
            else:
                return

    def jtype(self) -> None:
        self.annotations()
        c = self.peek()
        if c and c in self.prim:
            self.p += 1
        else:
            self.name()
            if self.at("<"):
                self.type_args()
            while self.at(".") and self.p + 1 < self.n and self.s[self.p + 1] in self.soft:
                self.p += 2
                if self.at("<"):
                    self.type_args()
        while self.p < self.n and self.s[self.p] == chr(BRACKET + self.empty_bracket):
            self.p += 1
        self.annotations()

    @property
    def empty_bracket(self) -> int:
        return 2  # the empty group: a dimension, no index

    def type_args(self) -> None:
        self.need("<")
        if self.take(">"):
            return
        while True:
            self.annotations()
            if self.take("?"):
                if self.takew("extends") or self.takew("super"):
                    self.jtype()
            else:
                self.jtype()
                while self.take("&"):
                    self.jtype()
            if not self.take(","):
                break
        self.close()

    def close(self) -> None:
        """One '>' of a list; '>>' and '>>>' were lexed as operators and count for two or three."""
        if self.take(">"):
            return
        if self.at("o"):
            self.s = self.s[: self.p] + ">>" + self.s[self.p + 1 :]
            self.n += 1
            self.p += 1
            return
        raise Bad

    def type_params(self) -> None:
        self.need("<")
        while True:
            self.annotations()
            self.name()
            if self.takew("extends"):
                self.jtype()
                while self.take("&"):
                    self.jtype()
            if not self.take(","):
                break
        self.close()

    def more(self) -> bool:
        if self.take(self.k["instanceof"]):
            self.takew("final")
            self.jtype()
            if self.paren("M") or self.peek() and self.peek() in self.soft and (self.p + 1 >= self.n or self.s[self.p + 1] not in self.soft):
                if self.peek() and self.peek() in self.soft:
                    self.p += 1
            return True
        return False

    def expr(self) -> None:
        self.operand()
        while self.p < self.n:
            c = self.s[self.p]
            if c == "?":
                self.p += 1
                self.expr()
                self.need(":")
                self.expr()
            elif c in self.binary:
                self.p += 1
                while c == ">" and self.take(">"):
                    pass
                self.operand()
            elif not self.more():
                return

    def lambda_body(self) -> None:
        self.need("r")
        if not self.brace("S"):
            self.expr()

    def primary(self) -> None:
        c = self.peek()
        k = self.k
        nxt = self.s[self.p + 1] if self.p + 1 < self.n else ""
        if c == k["switch"]:
            self.p += 1
            self.must(self.paren("E"))
            return self.must(self.brace("W"))
        if c and c in self.soft:
            if nxt == "r":
                self.p += 1
                return self.lambda_body()
            at = self.p
            if nxt == "<" or nxt == chr(BRACKET + self.empty_bracket) or nxt == ".":
                if self.tries(lambda: (self.jtype(), self.need("d"), self.takew("new") or self.name())):
                    return None
                self.p = at
                if self.tries(lambda: (self.jtype(), self.must(self.s[self.p - 1] in IS_BRACKET), self.need("."), self.need(k["class"]))):
                    return None
                self.p = at
            self.p += 1
            return None
        if c in ("n", "s"):
            self.p += 1
            return None
        if c in (k["this"], k["super"]):
            self.p += 1
            return None
        if c and c in self.prim:
            self.jtype()
            if self.take("d"):
                return self.need(k["new"])
            self.need(".")
            return self.need(k["class"])
        if c == k["new"]:
            self.p += 1
            self.annotations()
            if self.peek() in self.prim:
                self.p += 1
            else:
                self.name()
                if self.at("<"):
                    self.type_args()
                while self.take("."):
                    self.name()
                    if self.at("<"):
                        self.type_args()
            if self.paren("L"):
                self.brace("K")
                return None
            dims = False
            while self.bracket("D"):
                dims = True
            self.must(dims)
            self.brace("O")
            return None
        if c in IS_PAREN:
            at = self.p
            if nxt == "r":
                self.must(self.paren("M"))
                return self.lambda_body()
            if self.paren("T"):
                n2 = self.peek()
                if n2 and (n2 in "ins!" or n2 in IS_PAREN or n2 in self.soft or n2 in (k["this"], k["super"], k["new"], k["switch"]) or n2 in "+x"):
                    if self.tries(self.operand):
                        return None
                self.p = at
            return self.must(self.paren("E"))
        raise Bad

    def postfix(self) -> bool:
        c = self.s[self.p]
        if c == "x":
            self.p += 1
            return True
        if c == ".":
            self.p += 1
            if self.at("<"):
                self.type_args()
            if self.peek() in (self.k["class"], self.k["this"], self.k["super"], self.k["new"]):
                new = self.peek() == self.k["new"]
                self.p += 1
                if new:
                    self.name()
                    self.must(self.paren("L"))
                    self.brace("K")
                return True
            self.name()
            return True
        if c == "d":
            self.p += 1
            if not self.takew("new"):
                self.name()
            return True
        return self.paren("L") or self.bracket("E")

    def local_var(self) -> None:
        self.modifiers()
        self.jtype()
        self.declarators()
        self.need(";")

    def declarators(self) -> None:
        while True:
            self.name()
            while self.bracket("D"):
                pass
            if self.take("="):
                self.init()
            if not self.take(","):
                return

    def init(self) -> None:
        if not self.brace("O"):
            self.expr()

    def type_decl(self) -> bool:
        self.modifiers()
        c = self.peek()
        k = self.k
        if c == k["class"]:
            self.p += 1
            self.name()
            if self.at("<"):
                self.type_params()
            if self.takew("extends"):
                self.jtype()
            if self.takew("implements"):
                self.types()
            if self.takew("permits"):
                self.types()
            self.must(self.brace("K"))
        elif c == k["interface"]:
            self.p += 1
            self.name()
            if self.at("<"):
                self.type_params()
            if self.takew("extends"):
                self.types()
            if self.takew("permits"):
                self.types()
            self.must(self.brace("K"))
        elif c == k["enum"]:
            self.p += 1
            self.name()
            if self.takew("implements"):
                self.types()
            self.must(self.brace("Z"))
        elif c == k["record"] and self.p + 1 < self.n and self.s[self.p + 1] == "i":
            self.p += 2
            if self.at("<"):
                self.type_params()
            self.must(self.paren("M"))
            if self.takew("implements"):
                self.types()
            self.must(self.brace("K"))
        elif c == "@":
            self.p += 1
            self.need(k["interface"])
            self.name()
            self.must(self.brace("N"))
        else:
            return False
        return True

    def types(self) -> None:
        self.jtype()
        while self.take(","):
            self.jtype()

    def statement(self, ctx: str) -> str:
        c = self.peek()
        k = self.k
        nxt = self.s[self.p + 1] if self.p + 1 < self.n else ""
        if ctx == "top":
            if self.take(";"):
                return "."
            if c == k["package"] or c == "@" and self.tries(lambda: (self.annotations(), self.must(self.at(k["package"])))):
                self.need(k["package"])
                self.name()
                while self.take("."):
                    self.name()
                self.need(";")
                return "."
            if c == k["import"]:
                self.p += 1
                self.takew("static")
                self.name()
                while self.take("."):
                    if self.take("*"):
                        break
                    self.name()
                self.need(";")
                return "."
            self.must(self.type_decl())
            return "."
        if self.take(";"):
            return "."
        if c in IS_BRACE:
            self.must(self.brace("S"))
            return "."
        if c in (k["if"], k["while"], k["switch"], k["synchronized"]) and c:
            self.p += 1
            self.must(self.paren("E"))
            if c == k["switch"]:
                self.must(self.brace("W"))
                return "."
            if c == k["synchronized"]:
                self.must(self.brace("S"))
                return "."
            if c == k["while"]:
                if self.take(";"):
                    return "W"
                self.body()
                return "."
            self.body()
            return "I"
        if c == k["else"]:
            self.p += 1
            if self.takew("if"):
                self.must(self.paren("E"))
                self.body()
                return "EI"
            self.body()
            return "E"
        if c == k["for"]:
            self.p += 1
            self.must(self.paren("F"))
            self.body()
            return "."
        if c == k["do"]:
            self.p += 1
            self.body()
            return "D"
        if c == k["try"]:
            self.p += 1
            res = self.paren("R")
            self.must(self.brace("S"))
            return "t" if res else "T"
        if c == k["catch"]:
            self.p += 1
            self.must(self.paren("U"))
            self.must(self.brace("S"))
            return "C"
        if c == k["finally"]:
            self.p += 1
            self.must(self.brace("S"))
            return "Y"
        if ctx == "switch" and c in (k["case"], k["default"]):
            self.p += 1
            if c == k["case"]:
                while True:
                    if not self.takew("default"):
                        if not self.tries(lambda: (self.jtype(), self.name() if not self.paren("M") else None, self.must(self.at("r") or self.at(":") or self.at("i")))):
                            self.case_label()
                    if self.take("i"):
                        self.expr()
                    if not self.take(","):
                        break
            if self.take(":"):
                return "."
            self.need("r")
            if not self.brace("S"):
                if self.at(k["throw"]):
                    self.statement("in")
                else:
                    self.expr()
                    self.need(";")
            return "."
        if c in (k["return"], k["throw"]) or c == k["yield"] and nxt not in "=.x" and nxt not in IS_PAREN:
            self.p += 1
            if not (c == k["return"] and self.at(";")):
                self.expr()
            self.need(";")
            return "."
        if c in (k["break"], k["continue"]):
            self.p += 1
            if self.peek() in self.soft:
                self.p += 1
            self.need(";")
            return "."
        if c == k["assert"]:
            self.p += 1
            self.expr()
            if self.take(":"):
                self.expr()
            self.need(";")
            return "."
        if c in self.soft and nxt == ":":
            self.p += 2
            return "."
        if self.tries(lambda: self.type_decl()):
            return "."
        if self.tries(self.local_var):
            return "."
        start = self.p
        self.expr()
        self.must(self.is_statement(self.s[start : self.p]))
        self.need(";")
        return "."

    def case_label(self) -> None:
        """A constant; '->' ends it."""
        while self.p < self.n and self.s[self.p] in self.prefix:
            self.p += 1
        self.must(self.peek() and (self.peek() in "ins" or self.peek() in self.soft or self.peek() in IS_PAREN))
        self.p += 1
        while self.p < self.n and (self.s[self.p] in ".o+*&" and self.p + 1 < self.n):
            self.p += 2

    def is_statement(self, e: str) -> bool:
        """Only assignments, calls, ++/-- and new may stand alone."""
        return "=" in e or "x" in e or e[-1] in IS_PAREN and len(e) > 1 or self.k["new"] in e or self.k["switch"] in e

    def ordered(self, kinds: str) -> bool:
        if not kinds.strip("."):
            return True
        return bool(re.fullmatch(r"(?:[.W]|I(?:EI)*(?:E(?!I))?|T(?:C+Y?|Y)|tC*Y?|DW)*", kinds))

    def body(self) -> None:
        kind = self.statement("in")
        if kind == "t":
            while self.peek() and self.peek() in (self.k["catch"], self.k["finally"]):
                self.statement("in")
            return
        while kind[-1] == "I" and self.at(self.k["else"]):
            kind = self.statement("in")
            if kind == "E":
                return
        if kind == "D":
            self.must(self.statement("in") == "W")
        elif kind == "T":
            seen = False
            while self.peek() and self.peek() in (self.k["catch"], self.k["finally"]):
                self.statement("in")
                seen = True
            self.must(seen)
        elif kind[0] in "ECY":
            raise Bad

    # groups
    def p_E(self) -> None:
        self.expr()

    def p_L(self) -> None:
        def one() -> None:
            if self.brace("O"):
                return
            self.expr()

        self.commas(one, trailing=False)

    def p_T(self) -> None:
        self.jtype()
        while self.take("&"):
            self.jtype()

    def p_M(self) -> None:
        def one() -> None:
            at = self.p

            def full() -> None:
                self.modifiers()
                self.jtype()
                self.annotations()
                self.take("e")
                if not self.takew("this"):
                    if self.paren("M"):
                        return
                    self.name()
                while self.bracket("D"):
                    pass
                self.must(self.p >= self.n or self.at(","))

            if not self.tries(full):
                self.p = at
                self.name()

        self.commas(one, trailing=False)

    def p_U(self) -> None:
        self.modifiers()
        self.jtype()
        while self.take("o"):
            self.jtype()
        self.name()

    def p_R(self) -> None:
        while self.p < self.n:
            if not self.tries(lambda: (self.modifiers(), self.jtype(), self.name(), self.need("="), self.expr())):
                self.expr()
            if not self.take(";"):
                return

    def p_F(self) -> None:
        def each() -> None:
            self.modifiers()
            self.jtype()
            self.name()
            self.need(":")
            self.expr()
            self.must(self.p >= self.n)

        if self.tries(each):
            return
        if not self.take(";"):
            if not self.tries(self.local_var):
                self.exprs()
                self.need(";")
        if not self.at(";"):
            self.expr()
        self.need(";")
        if self.p < self.n:
            self.exprs()

    def b_E(self) -> None:
        self.expr()

    def b_D(self) -> None:
        if self.p < self.n:
            self.expr()

    def c_O(self) -> None:
        self.commas(self.init)

    def c_W(self) -> bool:
        self.must(self.p >= self.n or self.peek() in (self.k["case"], self.k["default"]))
        return self.statements("switch")

    def member(self) -> None:
        if self.take(";"):
            return
        if self.brace("S"):
            return
        if self.at(self.k["static"]) and self.p + 1 < self.n and self.s[self.p + 1] in IS_BRACE:
            self.p += 1
            self.must(self.brace("S"))
            return
        if self.tries(lambda: self.type_decl()):
            return
        self.modifiers()
        if self.at("<"):
            self.type_params()
        self.annotations()
        if self.peek() in self.soft and self.p + 1 < self.n and (self.s[self.p + 1] in IS_PAREN or self.s[self.p + 1] in IS_BRACE):
            self.p += 1
            self.paren("M")
        else:
            self.jtype()
            if self.p + 1 < self.n and self.s[self.p + 1] in IS_PAREN:
                self.name()
                self.must(self.paren("M"))
                while self.bracket("D"):
                    pass
            else:
                self.declarators()
                self.need(";")
                return
        if self.takew("throws"):
            self.types()
        if self.takew("default"):
            self.init()
        if not self.brace("S"):
            self.need(";")

    def c_K(self) -> None:
        while self.p < self.n:
            self.member()

    def c_N(self) -> None:
        self.c_K()

    def c_Z(self) -> None:
        while self.p < self.n and self.peek() in self.soft | {"@"}:
            self.annotations()
            self.name()
            self.paren("L")
            self.brace("K")
            if not self.take(","):
                break
        if self.p < self.n:
            self.need(";")
            self.c_K()


class GoGrammar(Grammar):
    lang = "go"
    paren_roles = ("E", "L", "M", "G", "T")
    bracket_roles = ("E", "D", "P")
    brace_roles = ("S", "O", "T", "I", "W")
    binary = "o+*&<>"
    prefix = "+!*&"
    comp = True

    def setup(self) -> None:
        self.headers = False

    def gtype(self) -> None:
        k = self.k
        c = self.peek()
        if c == "i":
            self.p += 1
            if self.take("."):
                self.need("i")
            if self.peek() in IS_BRACKET:
                self.tries(lambda: self.bracket("P") or False)
        elif c == "*":
            self.p += 1
            self.gtype()
        elif c in IS_BRACKET and c:
            self.must(self.bracket("D"))
            self.gtype()
        elif c == k["map"]:
            self.p += 1
            self.must(self.bracket("P"))
            self.gtype()
        elif c == k["chan"]:
            self.p += 1
            self.take("+")
            self.gtype()
        elif c == "+" and self.p + 1 < self.n and self.s[self.p + 1] == k["chan"]:
            self.p += 2
            self.gtype()
        elif c == k["func"]:
            self.p += 1
            self.signature()
        elif c == k["struct"]:
            self.p += 1
            self.must(self.brace("T"))
        elif c == k["interface"]:
            self.p += 1
            self.must(self.brace("I"))
        else:
            self.must(self.paren("T"))

    def signature(self) -> None:
        self.must(self.paren("M"))
        if not self.paren("M"):
            self.tries(self.gtype)

    def primary(self) -> None:
        k = self.k
        c = self.peek()
        if not c:
            raise Bad
        if c == "i" or c in "ns":
            self.p += 1
            if c == "i" and self.comp:
                self.brace("O")
        elif c == k["func"]:
            self.p += 1
            self.signature()
            self.must(self.brace("S"))
        elif c in IS_PAREN:
            self.must(self.paren("E") or self.paren("T"))
        elif c in IS_BRACKET or c in (k["map"], k["struct"], k["chan"], k["interface"]):
            self.gtype()
            if not self.brace("O"):
                self.must(self.peek() in IS_PAREN or self.p >= self.n or self.at(","))
        else:
            raise Bad

    def postfix(self) -> bool:
        c = self.s[self.p]
        if c == ".":
            self.p += 1
            if self.take("i"):
                if self.comp:
                    self.brace("O")
            else:
                self.must(self.paren("T") or self.paren("E") or self.paren("Y"))
            return True
        if c in IS_BRACKET:
            if self.bracket("E") or self.bracket("P"):
                if self.comp:
                    self.brace("O")
                return True
            return False
        return self.paren("L")

    def expr(self) -> None:
        self.operand()
        while self.p < self.n and self.s[self.p] in self.binary:
            self.p += 1
            self.operand()

    def simple(self) -> str:
        """A simple statement; says whether it is an expression or something else."""
        if self.takew("range"):
            self.expr()
            return "range"
        self.exprs()
        if self.take("x"):
            return "inc"
        if self.take("="):
            if self.takew("range"):
                self.expr()
                return "range"
            self.exprs()
            return "set"
        return "expr"

    def header(self) -> None:
        """[simple ;] [simple] before a block."""
        self.comp = False
        try:
            if self.p < self.n and self.s[self.p] in IS_BRACE:
                return
            if not self.at(";"):
                self.simple()
            parts = 1
            while self.take(";"):
                parts += 1
                self.must(parts <= 3)
                if self.p < self.n and self.s[self.p] != ";" and self.s[self.p] not in IS_BRACE:
                    self.simple()
        finally:
            self.comp = True

    def end(self) -> None:
        if self.p < self.n:
            self.need(";")

    def value_spec(self) -> None:
        self.need("i")
        while self.take(","):
            self.need("i")
        if self.p < self.n and self.s[self.p] not in "=;":
            self.gtype()
        if self.take("="):
            self.exprs()

    def type_spec(self) -> None:
        self.need("i")
        if self.peek() in IS_BRACKET and self.p + 1 < self.n and self.s[self.p + 1] not in ";":
            if not self.tries(lambda: (self.bracket("P") or self.must(False), self.take("="), self.gtype(), self.must(self.p >= self.n or self.at(";")))):
                self.gtype()
            return
        self.take("=")
        self.gtype()

    def import_spec(self) -> None:
        self.take("i") or self.take(".")
        self.need("s")

    def decl(self, w: str) -> None:
        self.p += 1
        if not (self.peek() in IS_PAREN and self.paren("G")):
            {"import": self.import_spec, "type": self.type_spec}.get(w, self.value_spec)()
        self.end()

    def statement(self, ctx: str) -> str:
        k = self.k
        c = self.peek()
        if c == ";":
            self.p += 1
            return "."
        for w in ("const", "var", "type"):
            if c == k[w]:
                self.decl(w)
                return "."
        if ctx == "top":
            if c == k["package"]:
                self.p += 1
                self.need("i")
                self.end()
                return "P"
            if c == k["import"]:
                self.decl("import")
                return "."
            self.need(k["func"])
            self.paren("M")
            self.need("i")
            self.peek() in IS_BRACKET and self.must(self.bracket("P"))
            self.signature()
            self.brace("S")
            self.end()
            return "."
        if c in IS_BRACE:
            self.must(self.brace("S"))
            self.end()
            return "."
        if c == k["if"]:
            self.if_rest()
            self.end()
            return "."
        if c == k["for"]:
            self.p += 1
            self.header()
            self.must(self.brace("S"))
            self.end()
            return "."
        if c in (k["switch"], k["select"]):
            self.p += 1
            if c == k["switch"]:
                self.header()
            self.must(self.brace("W"))
            self.end()
            return "."
        if ctx == "switch" and c == k["case"]:
            self.p += 1
            if not self.tries(lambda: (self.simple(), self.need(":"))):
                self.gtype()
                while self.take(","):
                    self.gtype()
                self.need(":")
            return "."
        if ctx == "switch" and c == k["default"]:
            self.p += 1
            self.need(":")
            return "."
        if c == k["return"]:
            self.p += 1
            if self.p < self.n and not self.at(";"):
                self.exprs()
            self.end()
            return "."
        if c in (k["go"], k["defer"]):
            self.p += 1
            self.expr()
            self.end()
            return "."
        if c in (k["break"], k["continue"], k["goto"], k["fallthrough"]):
            self.p += 1
            self.take("i")
            self.end()
            return "."
        if c == "i" and self.p + 1 < self.n and self.s[self.p + 1] == ":":
            self.p += 2
            return "."
        self.simple()
        self.end()
        return "."

    def if_rest(self) -> None:
        self.p += 1
        self.header()
        self.must(self.brace("S"))
        if self.takew("else"):
            if self.at(self.k["if"]):
                self.if_rest()
            else:
                self.must(self.brace("S"))

    def ordered(self, kinds: str) -> bool:
        return "P" not in kinds

    def top(self, s: str) -> bool:
        m = re.match(f";*{self.k['package']}i(?:;|$)", s)
        return bool(m) and self.whole(s[m.end() :], lambda: self.statements("top"))

    # groups
    def p_E(self) -> None:
        self.expr()

    def p_L(self) -> None:
        def one() -> None:
            if not self.tries(lambda: (self.expr(), self.take("e"), self.must(self.p >= self.n or self.at(",")))):
                self.gtype()

        self.commas(one)

    def p_T(self) -> None:
        if not self.takew("type"):
            self.gtype()

    def p_M(self) -> None:
        def one() -> None:
            at = self.p

            def named() -> None:
                self.need("i")
                self.take("e")
                self.gtype()
                self.must(self.p >= self.n or self.at(","))

            if not self.tries(named):
                self.p = at
                self.take("e")
                self.gtype()

        self.commas(one)

    def p_G(self) -> None:
        for f in (self.import_spec, self.value_spec, self.type_spec):

            def all_of(f: Callable[[], None] = f) -> None:
                while self.p < self.n:
                    if self.take(";"):
                        continue
                    f()
                    self.end()

            if self.tries(lambda g=all_of: (g(), self.must(self.p >= self.n))):
                return
        raise Bad

    def b_E(self) -> None:
        def slice_() -> None:
            if self.p < self.n and not self.at(":"):
                self.expr()
            while self.take(":"):
                if self.p < self.n and not self.at(":"):
                    self.expr()

        self.must(self.p < self.n)
        slice_()

    def b_D(self) -> None:
        if self.p < self.n and not self.take("e"):
            self.expr()

    def b_P(self) -> None:
        """Type arguments or parameters."""

        def one() -> None:
            at = self.p
            if not self.tries(lambda: (self.need("i"), self.constraint(), self.must(self.p >= self.n or self.at(",")))):
                self.p = at
                self.gtype()

        self.commas(one, empty=False)

    def constraint(self) -> None:
        while True:
            self.take("+") or self.take("!")
            self.gtype()
            if not self.take("o"):
                return

    def c_S(self) -> bool:
        return self.statements("in")

    def c_W(self) -> bool:
        self.must(self.p >= self.n or self.peek() in (self.k["case"], self.k["default"]))
        return self.statements("switch")

    def c_O(self) -> None:
        def value() -> None:
            if not self.brace("O"):
                self.expr()

        def item() -> None:
            value()
            if self.take(":"):
                value()

        self.must(not self.s.endswith(";"))
        self.commas(item)

    def c_T(self) -> None:
        while self.p < self.n:
            if self.take(";"):
                continue

            def named() -> None:
                self.need("i")
                while self.take(","):
                    self.need("i")
                self.gtype()
                self.take("s")
                self.end()

            if not self.tries(named):
                self.take("*")
                self.gtype()
                self.take("s")
                self.end()

    def c_I(self) -> None:
        while self.p < self.n:
            if self.take(";"):
                continue
            if not self.tries(lambda: (self.need("i"), self.signature(), self.end())):
                self.constraint()
                self.end()


class PhpGrammar(CGrammar):
    lang = "php"
    paren_roles = ("E", "L", "M", "F", "A", "U", "V")
    bracket_roles = ("E", "L", "X")
    brace_roles = ("S", "K", "W", "Z", "V", "H")
    binary = "o+*&<>=."
    prefix = "+!x&"

    def setup(self) -> None:
        self.mods = self.chars("abstract final private protected public readonly static var")
        self.names = frozenset(self.w.values()) | {"i"}
        self.logic = self.chars("and or xor instanceof")
        self.unary = self.chars("new clone print include include_once require require_once throw")
        self.soft = frozenset("i") | self.chars("static array list callable match enum readonly")

    def more(self) -> bool:
        if self.peek() in self.logic:
            self.p += 1
            self.operand()
            return True
        return False

    def attributes(self) -> None:
        while self.at("#") and self.p + 1 < self.n and self.s[self.p + 1] in IS_BRACKET:
            self.p += 2

    def operand(self) -> None:
        while self.p < self.n:
            c = self.s[self.p]
            if c == self.k["yield"]:
                self.p += 1
                nxt = self.s[self.p + 1] if self.p + 1 < self.n else ""
                if self.at("i") and nxt and (nxt in "vins" or nxt in IS_BRACKET):  # yield from
                    self.p += 1
                if self.p < self.n and self.s[self.p] not in ";,":
                    self.expr()
                    if self.take("a"):
                        self.expr()
                return
            if c in self.prefix or c in self.unary and c != self.k["new"]:
                self.p += 1
            elif c in IS_PAREN and self.is_cast():
                self.p += 1
            else:
                break
        self.primary()
        while self.p < self.n and self.postfix():
            pass

    def is_cast(self) -> bool:
        """(int) and the like before an operand."""
        if not (ord(self.s[self.p]) - PAREN) >> self.paren_roles.index("V") & 1:
            return False
        nxt = self.s[self.p + 1] if self.p + 1 < self.n else ""
        return bool(nxt) and (nxt in "vins$" or nxt in IS_PAREN or nxt in self.unary)

    def primary(self) -> None:
        c = self.peek()
        k = self.k
        nxt = self.s[self.p + 1] if self.p + 1 < self.n else ""
        self.attributes()
        c = self.peek()
        if not c:
            raise Bad
        if c in "vns":
            self.p += 1
            return
        if c == "$":
            while self.take("$"):
                pass
            self.must(self.brace("V") or self.take("v"))
            return
        if c == k["static"] and nxt in (k["function"], k["fn"]):
            self.p += 1
            c = self.peek()
        if c == k["function"]:
            self.p += 1
            self.take("&")
            self.must(self.paren("M"))
            if self.takew("use"):
                self.must(self.paren("U"))
            if self.take(":"):
                self.ptype()
            self.must(self.brace("S"))
            return
        if c == k["fn"]:
            self.p += 1
            self.take("&")
            self.must(self.paren("M"))
            if self.take(":"):
                self.ptype()
            self.need("a")
            self.expr()
            return
        if c == k["new"]:
            self.p += 1
            self.attributes()
            self.takew("readonly")
            if self.takew("class"):
                self.paren("L")
                self.class_rest()
                return
            if self.at("v") or self.at("$"):
                self.take("$")
                self.need("v")
                while self.p < self.n and (self.s[self.p] in "rdq" or self.s[self.p] in IS_BRACKET):
                    if self.s[self.p] in IS_BRACKET:
                        self.p += 1
                    else:
                        self.p += 1
                        self.member_name()
            elif not self.paren("E"):
                self.must(self.peek() and (self.peek() == "i" or self.peek() == k["static"] or self.peek() in self.soft))
                self.p += 1
            self.paren("L")
            return
        if c == k["match"] and nxt in IS_PAREN and self.p + 2 < self.n and self.s[self.p + 2] in IS_BRACE:
            self.p += 1
            self.must(self.paren("E"))
            self.must(self.brace("H"))
            return
        if c in (k["isset"], k["empty"], k["exit"] if "exit" in k else k["isset"]):
            self.p += 1
            self.must(self.paren("L"))
            return
        if c in (k["array"], k["list"]) and nxt in IS_PAREN:
            self.p += 1
            self.must(self.paren("A"))
            return
        if c in self.soft:
            self.p += 1
            return
        if c in IS_PAREN:
            self.must(self.paren("E"))
            return
        if c in IS_BRACKET:
            self.must(self.bracket("L"))
            return
        raise Bad

    def member_name(self) -> None:
        c = self.peek()
        if c and (c in self.names or c == "v"):
            self.p += 1
        elif c == "$":
            self.p += 1
            self.must(self.brace("V") or self.take("v"))
        else:
            self.must(self.brace("V"))

    def postfix(self) -> bool:
        c = self.s[self.p]
        if c == "x":
            self.p += 1
            return True
        if c in "rdq":
            self.p += 1
            self.member_name()
            return True
        return self.paren("L") or self.bracket("E") or self.bracket("X")

    def ptype(self) -> None:
        self.take("?")
        while True:
            if not self.paren("E"):
                self.must(self.peek() and (self.peek() == "i" or self.peek() in self.soft))
                self.p += 1
            if self.at("o") or self.at("&") and self.p + 1 < self.n and self.s[self.p + 1] in self.soft | IS_PAREN:
                self.p += 1
            else:
                return

    def class_rest(self) -> None:
        if self.takew("extends"):
            self.name_list()
        if self.takew("implements"):
            self.name_list()
        self.must(self.brace("K"))

    def name_list(self) -> None:
        self.need("i")
        while self.take(","):
            self.need("i")

    def end(self) -> None:
        self.need(";")

    def until(self, *ends: str) -> None:
        """Statements of the alternative syntax up to one of the closing words."""
        stop = {self.k[w] for w in ends}
        kinds = []
        while self.peek() not in stop:
            self.must(self.p < self.n)
            kinds.append(self.statement("in"))
        self.must(self.ordered("".join(kinds)))

    def statement(self, ctx: str) -> str:
        k = self.k
        self.attributes()
        c = self.peek()
        nxt = self.s[self.p + 1] if self.p + 1 < self.n else ""
        if self.take(";"):
            return "."
        if c in IS_BRACE and c:
            self.must(self.brace("S"))
            return "."
        if c == k["if"]:
            self.p += 1
            self.must(self.paren("E"))
            if self.take(":"):
                self.until("elseif", "else", "endif")
                while self.takew("elseif"):
                    self.must(self.paren("E"))
                    self.need(":")
                    self.until("elseif", "else", "endif")
                if self.takew("else"):
                    self.need(":")
                    self.until("endif")
                self.need(k["endif"])
                self.end()
                return "."
            self.body()
            return "I"
        if c == k["elseif"] or c == k["else"] and nxt == k["if"]:
            self.p += 1 + (c == k["else"])
            self.must(self.paren("E"))
            self.body()
            return "EI"
        if c == k["else"]:
            self.p += 1
            self.body()
            return "E"
        for w, r in (("while", "E"), ("for", "F"), ("foreach", "F"), ("switch", "E"), ("declare", "L")):
            if c == k[w]:
                self.p += 1
                self.must(self.paren(r))
                if w == "while" and self.take(";"):
                    return "W"
                if w == "declare" and self.take(";"):
                    return "."
                if self.take(":"):
                    if w == "switch":
                        while self.peek() in (k["case"], k["default"]):
                            self.statement("switch")
                            while self.peek() not in (k["case"], k["default"], k["endswitch"]):
                                self.must(self.p < self.n)
                                self.statement("switch")
                    else:
                        self.until("end" + w)
                    self.need(k["end" + w])
                    self.end()
                    return "."
                if w == "switch":
                    self.must(self.brace("W"))
                else:
                    self.body()
                return "."
        if c == k["do"]:
            self.p += 1
            self.body()
            return "D"
        if c == k["try"]:
            self.p += 1
            self.must(self.brace("S"))
            return "T"
        if c == k["catch"]:
            self.p += 1
            self.must(self.paren("M"))
            self.must(self.brace("S"))
            return "C"
        if c == k["finally"]:
            self.p += 1
            self.must(self.brace("S"))
            return "Y"
        if ctx == "switch" and c in (k["case"], k["default"]):
            self.p += 1
            if c == k["case"]:
                self.expr()
            self.must(self.take(":") or self.take(";"))
            return "."
        if c in (k["break"], k["continue"], k["return"]):
            self.p += 1
            if not self.at(";"):
                self.expr()
            self.end()
            return "."
        if c == k["echo"]:
            self.p += 1
            self.exprs()
            self.end()
            return "."
        if c in (k["global"], k["unset"]):
            self.p += 1
            if c == k["unset"]:
                self.must(self.paren("L"))
            else:
                self.exprs()
            self.end()
            return "."
        if c == k["static"] and nxt == "v":
            self.p += 1
            self.exprs()
            self.end()
            return "."
        if c == k["goto"]:
            self.p += 1
            self.need("i")
            self.end()
            return "."
        if c == k["namespace"]:
            self.p += 1
            named = self.take("i")
            if not self.brace("S"):
                self.must(named)
                self.end()
            return "."
        if c == k["use"]:
            self.p += 1
            self.takew("function") or self.takew("const")
            while True:
                self.need("i")
                self.take("i")
                if self.takew("as"):
                    self.need("i")
                elif self.peek() in IS_BRACE:
                    self.must(self.brace("Z"))
                if not self.take(","):
                    break
            self.end()
            return "."
        if c == k["const"]:
            self.p += 1
            self.exprs()
            self.end()
            return "."
        if c == k["function"] and (nxt in self.names and nxt or nxt == "&" and self.p + 2 < self.n and self.s[self.p + 2] in self.names):
            self.p += 1
            self.take("&")
            self.p += 1
            self.must(self.paren("M"))
            if self.take(":"):
                self.ptype()
            self.must(self.brace("S"))
            return "."
        at = self.p
        while self.peek() in (k["abstract"], k["final"], k["readonly"]) and self.peek():
            self.p += 1
        c = self.peek()
        if c in (k["class"], k["trait"], k["interface"]) and c:
            self.p += 1
            self.must(self.peek() in self.soft and self.peek())
            self.p += 1
            self.class_rest()
            return "."
        if c == k["enum"] and self.p + 1 < self.n and self.s[self.p + 1] == "i":
            self.p += 2
            if self.take(":"):
                self.ptype()
            self.class_rest()
            return "."
        self.p = at
        if c == "i" and self.p + 1 < self.n and self.s[self.p + 1] == ":":
            self.p += 2
            return "."
        self.expr()
        self.end()
        return "."

    # groups
    def value(self) -> None:
        self.take("e")
        self.take("&")
        if self.p + 1 < self.n and self.peek() in self.names and self.s[self.p + 1] == ":":
            self.p += 2
        self.expr()

    def p_E(self) -> None:
        self.expr()

    def p_L(self) -> None:
        if self.s == "e":
            self.p = 1
            return
        self.commas(self.value)

    def p_V(self) -> None:
        self.must(self.p < self.n and self.s[self.p] in self.soft)
        self.p += 1

    def pair(self) -> None:
        self.take("e")
        self.take("&")
        self.expr()
        if self.take("a"):
            self.take("&")
            self.expr()

    def p_A(self) -> None:
        self.b_L()

    def p_M(self) -> None:
        def one() -> None:
            self.attributes()
            while self.peek() in self.mods and self.peek():
                self.p += 1
            if not (self.at("v") or self.at("&") or self.at("e")):
                self.ptype()
            self.take("&")
            self.take("e")
            self.take("v") or self.must(self.p >= self.n)
            if self.take("="):
                self.expr()

        self.commas(one)

    def p_U(self) -> None:
        def one() -> None:
            self.take("&")
            self.need("v")

        self.commas(one)

    def p_F(self) -> None:
        def each() -> None:
            self.expr()
            self.need(self.k["as"])
            self.take("&")
            self.expr()
            if self.take("a"):
                self.take("&")
                self.expr()
            self.must(self.p >= self.n)

        if self.tries(each):
            return
        for last in (False, False, True):
            if self.p < self.n and not self.at(";"):
                self.exprs()
            if not last:
                self.need(";")

    def b_E(self) -> None:
        self.expr()

    def b_X(self) -> None:
        self.must(self.p >= self.n)

    def b_L(self) -> None:
        while self.p < self.n:
            if self.take(","):
                continue
            self.pair()
            if self.p < self.n:
                self.need(",")

    def c_S(self) -> bool:
        return self.statements("in")

    def c_W(self) -> bool:
        self.take(";")
        self.must(self.p >= self.n or self.peek() in (self.k["case"], self.k["default"]))
        return self.statements("switch")

    def c_V(self) -> None:
        self.expr()

    def c_H(self) -> None:
        def arm() -> None:
            if not self.takew("default"):
                self.expr()
                while self.take(","):
                    if self.at("a"):
                        break
                    self.expr()
            self.need("a")
            self.expr()

        self.commas(arm)

    def c_Z(self) -> None:
        def one() -> None:
            self.takew("function") or self.takew("const")
            self.need("i")
            if self.takew("as"):
                self.need("i")

        self.commas(one)

    def c_K(self) -> None:
        while self.p < self.n:
            self.attributes()
            if self.takew("use"):
                self.name_list()
                if not self.brace("S"):
                    if self.peek() in IS_BRACE:
                        self.p += 1  # conflict rules of traits
                    else:
                        self.end()
                continue
            if self.takew("case"):
                self.must(self.peek() in self.names)
                self.p += 1
                if self.take("="):
                    self.expr()
                self.end()
                continue
            some = False
            while self.peek() in self.mods and self.peek():
                self.p += 1
                some = True
            if self.takew("const"):
                if self.p + 1 < self.n and self.s[self.p + 1] not in "=":
                    self.ptype()
                while True:
                    self.must(self.peek() in self.names)
                    self.p += 1
                    self.need("=")
                    self.expr()
                    if not self.take(","):
                        break
                self.end()
            elif self.takew("function"):
                self.take("&")
                self.must(self.peek() and self.peek() in self.names)
                self.p += 1
                self.must(self.paren("M"))
                if self.take(":"):
                    self.ptype()
                if not self.brace("S"):
                    self.end()
            else:
                self.must(some)
                if not self.at("v"):
                    self.ptype()
                while True:
                    self.need("v")
                    if self.take("="):
                        self.expr()
                    if not self.take(","):
                        break
                self.end()


class LuaGrammar(Grammar):
    """Blocks end by words here, so statements are read over the whole reduced string."""

    lang = "lua"
    paren_roles = ("E", "L", "M")
    bracket_roles = ("E",)
    brace_roles = ("O",)
    binary = "o+*&<>"
    prefix = "+!&"

    def setup(self) -> None:
        k = self.k
        self.values = frozenset("ns") | {k["nil"], k["true"], k["false"], "e"}
        self.logic = {k["and"], k["or"]}

    def operand(self) -> None:
        while self.p < self.n and (self.s[self.p] in self.prefix or self.s[self.p] == self.k["not"]):
            self.p += 1
        self.primary()
        while self.p < self.n and self.postfix():
            pass

    def more(self) -> bool:
        if self.peek() in self.logic:
            self.p += 1
            self.operand()
            return True
        return False

    call = False

    def primary(self) -> None:
        c = self.peek()
        if not c:
            raise Bad
        self.call = False
        if c == "i" or c in self.values:
            self.p += 1
        elif c in IS_PAREN:
            self.must(self.paren("E"))
        elif c in IS_BRACE:
            self.must(self.brace("O"))
        elif c == self.k["function"]:
            self.p += 1
            self.function_rest()
        else:
            raise Bad

    def postfix(self) -> bool:
        c = self.s[self.p]
        if c == ".":
            self.p += 1
            self.need("i")
            self.call = False
            return True
        if c == ":":
            self.p += 1
            self.need("i")
            self.must(self.paren("L") or self.take("s") or self.brace("O"))
            self.call = True
            return True
        if self.bracket("E"):
            self.call = False
            return True
        if self.paren("L") or self.take("s") or self.brace("O"):
            self.call = True
            return True
        return False

    def function_rest(self) -> None:
        self.must(self.paren("M"))
        self.block("end")

    def block(self, *ends: str) -> str:
        stop = {self.k[w] for w in ends}
        while True:
            c = self.peek()
            if not c:
                raise Bad
            if c in stop:
                self.p += 1
                return c
            if c == self.k["return"]:
                self.ret()
                self.must(self.peek() in stop)
                continue
            self.one()

    def ret(self) -> None:
        self.p += 1
        c = self.peek()
        if c and c != ";" and c not in (self.k["end"], self.k["else"], self.k["elseif"], self.k["until"]):
            self.exprs()
        self.take(";")

    def one(self) -> None:
        k = self.k
        c = self.peek()
        if c == ";":
            self.p += 1
        elif c == k["if"]:
            self.p += 1
            self.expr()
            self.need(k["then"])
            while True:
                end = self.block("elseif", "else", "end")
                if end == k["end"]:
                    return
                if end == k["elseif"]:
                    self.expr()
                    self.need(k["then"])
                else:
                    self.block("end")
                    return
        elif c == k["while"]:
            self.p += 1
            self.expr()
            self.need(k["do"])
            self.block("end")
        elif c == k["do"]:
            self.p += 1
            self.block("end")
        elif c == k["for"]:
            self.p += 1
            self.need("i")
            if self.take("="):
                self.expr()
                self.need(",")
                self.expr()
                if self.take(","):
                    self.expr()
            else:
                while self.take(","):
                    self.need("i")
                self.need(k["in"])
                self.exprs()
            self.need(k["do"])
            self.block("end")
        elif c == k["repeat"]:
            self.p += 1
            self.block("until")
            self.expr()
        elif c == k["function"]:
            self.p += 1
            self.need("i")
            while self.take(".") or self.take(":"):
                self.need("i")
            self.function_rest()
        elif c == k["local"]:
            self.p += 1
            if self.takew("function"):
                self.need("i")
                self.function_rest()
                return
            while True:
                self.need("i")
                if self.take("<"):
                    self.need("i")
                    self.need(">")
                if not self.take(","):
                    break
            if self.take("="):
                self.exprs()
        elif c == k["break"]:
            self.p += 1
        elif c == k["goto"]:
            self.p += 1
            self.need("i")
        elif c == "d":
            self.p += 1
            self.need("i")
            self.need("d")
        else:
            start = self.p
            self.must(c == "i" or c in IS_PAREN)
            self.operand()
            called = self.call
            if self.at("=") or self.at(","):
                self.must(not called)
                while self.take(","):
                    self.operand()
                    self.must(not self.call)
                self.need("=")
                self.exprs()
            else:
                self.must(called and self.p > start)

    def top(self, s: str) -> bool:
        def chunk() -> None:
            while self.p < self.n:
                if self.at(self.k["return"]):
                    self.ret()
                    self.must(self.p >= self.n)
                else:
                    self.one()

        return self.whole(s, chunk)

    def p_E(self) -> None:
        self.expr()

    def p_L(self) -> None:
        self.commas(self.expr, trailing=False)

    def p_M(self) -> None:
        def one() -> None:
            if self.take("e"):
                self.must(self.p >= self.n)
            else:
                self.need("i")

        self.commas(one, trailing=False)

    def b_E(self) -> None:
        self.expr()

    def c_O(self) -> None:
        while self.p < self.n:
            if self.bracket("E"):
                self.need("=")
                self.expr()
            elif self.at("i") and self.p + 1 < self.n and self.s[self.p + 1] == "=":
                self.p += 2
                self.expr()
            else:
                self.expr()
            if self.p < self.n:
                self.must(self.take(",") or self.take(";"))


_GRAMMARS: dict[str, Grammar] = {}
_CLASSES = {"c": CGrammar, "js": JsGrammar, "ts": TsGrammar, "java": JavaGrammar, "go": GoGrammar, "php": PhpGrammar, "lua": LuaGrammar}


def grammar(lang: str) -> Grammar:
    """The language's grammar with what this worker remembers of earlier texts."""
    if lang not in _GRAMMARS:
        _GRAMMARS[lang] = _CLASSES[lang]()
    return _GRAMMARS[lang]


def parses(text: str, lang: str) -> bool:
    """Whether the text is syntactically valid in the language."""
    return grammar(lang).valid(token_classes(text, lang))
