"""Source text as a string of token classes, one character per token.

Comments and white space vanish; every keyword has a character of its own. The
grammars in ``grammar.py`` read these strings. A text that can't be cut into
tokens (an unterminated string or comment, a foreign character) gives None.

Fixed characters: i name, n number, s string, t template, v PHP variable, N line
break that may end a statement (JavaScript family), o binary operator, + sign or
binary, ! prefix, x increment, = assignment, a ``=>``, r ``->``, d ``::``, e ``...``,
q ``?.``; brackets, ``. , ; : ? * & < > @ #`` stand for themselves.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Reserved words of each language (contextual words included where the grammar reads them).
WORDS = {
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Atomic _Static_assert",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while record sealed permits non yield var",
    "js": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with let static async await yield of get set as from",
    "ts": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with let static async await yield of get set as from interface type enum implements declare namespace module abstract public private protected readonly keyof infer is satisfies override unique asserts",
    "lua": "and break do else elseif end false for function goto if in local nil not or repeat return then true until while",
    "php": "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile enum extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield",
}
WORD_CHARS = {lang: {w: chr(0x1000 + k) for k, w in enumerate(words.split())} for lang, words in WORDS.items()}

_OPS = {
    **{x: "o" for x in "/ % ^ | << >> >>> == != === !== <= >= && || ?? ** <=> &^ ~= // .. <-".split()},
    **{x: "=" for x in "= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= .= &^= :=".split()},
    **{"+": "+", "-": "+", "!": "!", "~": "!", "++": "x", "--": "x", "=>": "a", "->": "r", "::": "d", "...": "e", "?.": "q"},
    **{x: x for x in "()[]{}.,;:?*&<>@#"},
}

_DQ = r'"(?:[^"\\\n]|\\[\s\S])*+"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*+'"
_LINE = r"//[^\n]*+"
_BLOCK = r"/\*[\s\S]*?\*/"
_NAME = r"[^\W\d]\w*+"
_NUM = r"\.?\d(?:[eEpP][+-]|[\w.])*+"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*+`"
_REGEX = r"(?:(?<=[(,=:\[!&|?{};>+])|(?<=[(,=:\[!&|?{};>+] )|(?<=return )|(?<=[\n ]{2}))/(?![*/ ])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"

# comment, string, other strings as (pattern, class), operators longest first
_LEX = {
    "c": (rf"{_LINE}|{_BLOCK}|(?<![^\n])[ \t]*#[ \t]*(?:include|define|if|ifdef|ifndef|else|elif|endif|undef|pragma|error|warning|line|import)\b(?:[^\n\\/]|\\[\s\S]|/(?!\*)|{_BLOCK})*+", rf"[LuU]?{_DQ}|[LuU]?{_SQ}", _NAME, _NUM,
          "<<= >>= ... -> ++ -- << >> <= >= == != && || += -= *= /= %= &= |= ^= + - * / % & | ^ ! ~ < > = ? : ; , . ( ) [ ] { }"),
    "go": (rf"{_LINE}|/\*[^\n]*?\*/", rf"{_DQ}|{_SQ}|`[^`]*+`", _NAME, _NUM,
           "&^= <<= >>= ... := <- ++ -- && || == != <= >= << >> &^ += -= *= /= %= &= |= ^= + - * / % & | ^ ! ~ < > = : ; , . ( ) [ ] { }"),
    "java": (rf"{_LINE}|{_BLOCK}", rf'"""[\s\S]*?"""|(?!"""){_DQ}|{_SQ}', r"[^\W\d]\w*+|\$[\w$]*+", _NUM,
             ">>>= <<= >>= ... -> :: ++ -- && || == != <= >= << += -= *= /= %= &= |= ^= + - * / % & | ^ ! ~ < > = ? : ; , . @ ( ) [ ] { }"),
    "js": (rf"{_LINE}|{_BLOCK}|\A#![^\n]*", rf"{_DQ}|{_SQ}|{_REGEX}", r"#?(?:[^\W\d]|\$)[\w$]*+", _NUM,
           ">>>= === !== **= <<= >>= >>> &&= ||= ??= ... => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= ** << >> + - * / % & | ^ ! ~ < > = ? : ; , . @ ( ) [ ] { }"),
    "ts": (rf"{_LINE}|{_BLOCK}|\A#![^\n]*", rf"{_DQ}|{_SQ}|{_REGEX}", r"#?(?:[^\W\d]|\$)[\w$]*+", _NUM,
           "=== !== **= <<= >>= &&= ||= ??= ... => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= ** << + - * / % & | ^ ! ~ < > = ? : ; , . @ ( ) [ ] { }"),
    "lua": (r"--\[(?P<la>=*)\[[\s\S]*?\](?P=la)\]|--(?!\[=*\[)[^\n]*+|\A#![^\n]*", rf"{_DQ}|{_SQ}|\[(?P<lb>=*)\[[\s\S]*?\](?P=lb)\]", _NAME, _NUM,
            "... .. == ~= <= >= << >> // :: + - * / % ^ # & ~ | < > = ( ) { } [ ] ; : , ."),
    "php": (rf"(?://|\#(?!\[))(?:(?!\?>)[^\n])*+|{_BLOCK}", r'[bB]?"(?:[^"\\]|\\[\s\S])*+"|[bB]?\'(?:[^\'\\]|\\[\s\S])*+\'|`[^`]*+`|<<<[ \t]*(?P<ha>["\']?)(?P<hb>[^\W\d]\w*)(?P=ha)\r?\n(?:[\s\S]*?\n)?[ \t]*(?P=hb)\b', r"\\?(?:[^\W\d]\w*+)(?:\\[^\W\d]\w*+)*+|\\", _NUM,
            "<<<= **= ... <=> === !== ??= ?-> <<= >>= :: -> => ++ -- && || ?? == != <> <= >= << >> ** += -= *= /= .= %= &= |= ^= + - * / % & | ^ ! ~ @ < > = ? : ; , . $ # ( ) [ ] { }"),
}

#: Classes after which a line break may end a statement, and before which it can't.
_JS_ENDERS = set("instvx)]}") | {WORD_CHARS["js"][w] for w in "break continue return this super debugger of get set as from async static let yield".split()}
_TS_ENDERS = set("instvx)]}!>") | {WORD_CHARS["ts"][w] for w in "break continue return this super debugger of get set as from async static let yield type namespace module declare abstract readonly is unique asserts override void".split()}
_JS_NEVER = set("o+*&<>=?:.,;)]}{qard") | {WORD_CHARS["js"][w] for w in ("in", "instanceof")}
_GO_ENDERS = set("insx)]}") | {WORD_CHARS["go"][w] for w in "break continue fallthrough return".split()}


@lru_cache(maxsize=None)
def _lexer(lang: str) -> tuple[re.Pattern, dict[str, str], dict[str, str]]:
    comment, string, name, num, ops = _LEX[lang]
    op = "|".join(re.escape(x) for x in sorted(ops.split(), key=len, reverse=True))
    parts = [("C", comment), ("S", string)]
    if lang in ("js", "ts"):
        parts.append(("T", _TEMPLATE))
    if lang == "php":
        parts += [("H", r"\?>(?:(?!<\?(?:php\b|=))[\s\S])*+(?:<\?php\b|<\?=|\Z)"), ("V", r"\$+[^\W\d]\w*+")]
    # an opening that nothing closes is no operator
    opening = r"(?!--\[=*\[|\[=*\[)" if lang == "lua" else r"(?!/\*|<<<[ \t]*[\"']?[^\W\d]\w*[\"']?\r?\n)" if lang == "php" else r"(?!/\*)"
    parts += [("I", name), ("D", num), ("O", f"{opening}(?:{op})")]
    parts.append(("L", r"\n"))
    parts.append(("B", r"[^\s\ufeff]"))
    space = r"[ \t\r\f\v\ufeff]*+" if lang in ("js", "ts", "go") else r"\s*+"
    out = [f"(?P<{k}>{p})" for k, p in parts]
    words = WORD_CHARS[lang]
    return re.compile(f"(?:{'|'.join(out)}){space}"), words, {x: _OPS.get(x, "o") for x in ops.split()} | ({"~": "+", "::": "d", "#": "!"} if lang == "lua" else {}) | ({"@": "!", "$": "$", "<>": "o", "?->": "q", "<<<=": "="} if lang == "php" else {}) | ({":=": "=", "<-": "+", "^": "+"} if lang == "go" else {}) | ({">>": ">"} if lang == "ts" else {})


_PHP_HEAD = re.compile(r"(?:(?!<\?(?:php\b|=))[\s\S])*+(?:<\?php\b|<\?=|\Z)\s*")


def token_classes(text: str, lang: str) -> str | None:
    """The class string of a whole text, or None where it can't be cut into tokens."""
    rx, words, ops = _lexer(lang)
    out: list[str] = []
    add = out.append
    pos = 0
    if lang == "php":
        pos = _PHP_HEAD.match(text).end()
    else:
        pos = re.compile(r"[\s\ufeff]*").match(text).end()
    word, op = words.get, ops.get
    if lang in ("js", "ts"):
        enders, broke = _JS_ENDERS if lang == "js" else _TS_ENDERS, False
        for m in rx.finditer(text, pos):
            k = m.lastgroup
            if k == "I":
                c = word(m["I"], "i")
            elif k == "O":
                c = op(m["O"])
            elif k == "L":
                broke = True
                continue
            elif k == "C":
                if not broke and "\n" in m["C"]:
                    broke = True
                continue
            elif k == "S":
                c = "s"
            elif k == "D":
                c = "n"
            elif k == "T":
                c = "t"
            else:
                return None
            if broke:
                if out and c not in _JS_NEVER and out[-1] in enders:
                    add("N")
                broke = False
            add(c)
        return "".join(out)
    if lang == "go":
        if "/*" in text:
            text = _go_blocks(text)
        for m in rx.finditer(text, pos):
            k = m.lastgroup
            if k == "I":
                add(word(m["I"], "i"))
            elif k == "O":
                add(op(m["O"]))
            elif k == "L":
                if out and out[-1] in _GO_ENDERS:
                    add(";")
            elif k == "S":
                add("s")
            elif k == "D":
                add("n")
            elif k != "C":
                return None
        if out and out[-1] in _GO_ENDERS:
            add(";")
        return "".join(out)
    php = lang == "php"
    for m in rx.finditer(text, pos):
        k = m.lastgroup
        if k == "I":
            w = m["I"]
            add(word(w.lower() if php else w, "i"))
        elif k == "O":
            add(op(m["O"]))
        elif k == "V":
            add("v")
        elif k == "S":
            add("s")
        elif k == "D":
            add("n")
        elif k == "H":
            add(";")
        elif k == "L" or k == "C":
            continue
        else:
            return None
    return "".join(out)


_GO_SCAN = re.compile(r'//[^\n]*+|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|`[^`]*+`|/\*([\s\S]*?)\*/')


def _go_blocks(text: str) -> str:
    """Block comments over several lines replaced by line breaks; other text as it is."""
    return _GO_SCAN.sub(lambda m: "\n" * m.group(1).count("\n") if m.group(1) and "\n" in m.group(1) else m.group(), text)
