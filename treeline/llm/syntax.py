"""Source files that do not parse in the language they claim.

A file is cut into chunks at line breaks, wherever those lie, and every chunk is summarised alone.
It doesn't know in which lexer state it begins, so its summary is a map: for each state (code, or
inside a comment, literal, template, heredoc, page text; for Python also how many brackets are
open) what the chunk comes to and the state at its end. Maps compose associatively: chunks are
composed to runs where the file is read, and runs of a file anywhere in the cluster.

* Seven languages: a chunk comes to a string of token classes in which every balanced bracket group
  is replaced by what the language's local grammar found it to be (``treeline.parsers.grammar``);
  brackets without a partner stay until a neighbour closes them. What is left of a whole file must be
  balanced and read as the language's top level.
* Python: a chunk comes to the open ends of the statements that begin before or end after it; the
  statements of the top level that lie inside are balanced and read one by one by the interpreter's
  grammar, as is each one that a composition completes.

Every file takes this way, whatever its length. Texts are read once; files that the results state to
be of another language than their extension are known by a bitmap of their ids, so no text is joined.

Defined results: a null or empty ``source`` is valid; a file whose language is none of
the eight is no source file and gives no row; of copies of a file_id the one loaded last counts (if
there is a ``loaded_at``), of equal ones that with the greatest digest; a null
file_id gives no row; the language is that of file_results' latest analysis when it
names one of the eight, else that of the extension; what is nested too deeply for the parser doesn't parse.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.cluster import cut, join_small
from treeline.llm.bits import Bits
from treeline.parsers import classes, jsx
from treeline.parsers.grammar import _LEFT, grammar
from treeline.parsers.spans import EXTENSIONS, PROGRAMMING, language_of

#: Least characters of a chunk, and chunks of a run.
CHUNK_CHARS = 2048
RUN_CHUNKS = 32

_AT_MARGIN = re.compile(r"^(?:return|yield|break|continue|await)\b", re.M)


def python_parses(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            if _AT_MARGIN.search(text):
                compile(text, "<text>", "exec", dont_inherit=True)
            else:
                ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    return True


def parses(text: str, lang: str) -> bool:
    text = text.replace("\r\n", "\n")
    if lang == "python":
        return python_parses(text)
    return grammar(lang).valid(classes.token_classes(text, lang))


def plain_source(text: str | None, file: str | None) -> str | None:
    """The text as the grammars read it: in .jsx and .tsx files elements are arrays of the expressions in them."""
    return jsx.without_elements(text) if text and file and file.lower().endswith((".jsx", ".tsx")) else text


# chunks ---------------------------------------------------------------------------------------

#: (broken, what the chunk comes to, for Python its other open end or None where no statement begins, the state at its end)
Entry = tuple[bool, str, "str | None", str]
Map = dict[str, Entry]


def cut_at_lines(text: str, size: int) -> list[str]:
    """Chunks of at least ``size`` characters that end with a line break. A line that goes on (a backslash) isn't
    cut, nor is one before a slash, which is a division or a literal by what stands before it."""
    out, at, look = [], 0, size
    while (end := text.find("\n", at + look - 1)) >= 0 and end + 1 < len(text):
        if text[end - 1] == "\\" or text[end + 1] == "/":
            look = end + 2 - at
            continue
        out.append(text[at : end + 1])
        at, look = end + 1, size
    out.append(text[at:])
    return out


#: How the constructs begin that may go on over lines; the opening is the name of the state. A template's states also say what is open in it.
_OPENING = {
    "c": re.compile(r"/\*"), "go": re.compile(r"/\*|`"), "java": re.compile(r'/\*|"""'), "js": re.compile(r"/\*|`"), "lua": re.compile(r"--\[=*\[|\[=*\["),
    "php": re.compile(r"/\*|[\"'`]|\?>|<<<[ \t]*[\"']?[^\W\d]\w*[\"']?\n"),
}
_OPENING["ts"] = _OPENING["js"]
_INSIDE = r"(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*+"
_TEXT = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{{_INSIDE}\}})*+"
_TEMPLATE = tuple((state, re.compile(_TEXT + rest + r"\Z")) for state, rest in (("`", ""), ("`${", rf"\$\{{{_INSIDE}"), ("`${{", rf"\$\{{{_INSIDE}\{{[^{{}}]*+"), ("`${`", rf"\$\{{{_INSIDE}`[^`]*+")))
_NO_PHP = re.compile(r"\?>(?:(?!<\?(?:php\b|=))[\s\S])*\Z")


def states_of(text: str, lang: str) -> list[str]:
    """The states that a chunk of this file may begin in."""
    if lang == "python":
        return ["", "'''", '"""']
    found = set(_OPENING[lang].findall(text))
    if "`" in found and lang in ("js", "ts"):
        found.update(state for state, _ in _TEMPLATE)
    if lang == "php" and not re.match(r"<\?(?:php\b|=)", text):
        found.add("?>")
    return ["", *sorted(found)]


def _begun(text: str, lang: str, state: str, first: bool) -> tuple[str, int]:
    """A chunk as the lexer of whole texts reads it in a state, and how many characters were put before it."""
    if first:
        return text, 0
    lead = {"php": "<?php ", "js": "\n", "ts": "\n", "lua": "\n"}.get(lang, "")
    lead = "" if state == "?>" else lead + state
    return lead + text, len(lead)


def _stuck(text: str, lang: str) -> int | None:
    """Where the lexer can't go on."""
    if lang == "go":
        at = 0
        for m in classes._GO_SCAN.finditer(text):
            if gap := _OPENING["go"].search(text, at, m.start()):
                return gap.start()
            at = m.end()
        gap = _OPENING["go"].search(text, at)
        return gap.start() if gap else None
    rx, _, _ = classes._lexer(lang)
    start = classes._PHP_HEAD.match(text).end() if lang == "php" else 0
    return next((m.start("B") for m in rx.finditer(text, start) if m.lastgroup == "B"), None)


def _unclosed(text: str, lang: str) -> tuple[str, int] | None:
    """(state, place) of the construct that the text leaves open."""
    at = _stuck(text, lang)
    if at is None:
        return None
    m = _OPENING[lang].match(text, at)
    if not m:
        return None
    if m.group() == "`" and lang in ("js", "ts"):
        return next(((state, at) for state, rx in _TEMPLATE if rx.match(text, at)), None)
    return m.group(), at


def scan(text: str, lang: str) -> tuple[str | None, str]:
    """(class string or None if broken, the state at the end) of a text that begins in code."""
    got = classes.token_classes(text, lang)
    if got is not None:
        if lang == "php" and ("<?php" not in text and "<?=" not in text or _NO_PHP.search(text) and _ends_in_page(text)):
            return got, "?>"
        return got, ""
    left = _unclosed(text, lang)
    if not left:
        return None, ""
    state, at = left
    if state[:2] in ("/*", "--"):
        return classes.token_classes(text[:at], lang), state
    # the literal itself is counted by the chunk that closes it; what stands before it is cut as if it were there
    before = classes.token_classes(text[:at] + ("``" if lang in ("js", "ts") else '""'), lang)
    return before and (before.rstrip(";") if lang == "go" else before)[:-1], state


def _ends_in_page(text: str) -> bool:
    rx, _, _ = classes._lexer("php")
    last = None
    for last in rx.finditer(text, classes._PHP_HEAD.match(text).end()):
        pass
    return last is not None and last.lastgroup == "H"


def summary(text: str, lang: str, first: bool, states: list[str]) -> Map:
    """The lexer-state map of a chunk."""
    if lang == "python":
        return _python_summary(text, first, states)
    out: Map = {}
    for state in ("",) if first else states:
        s, end = scan(_begun(text, lang, state, first)[0], lang)
        out[state] = (True, "", None, "") if s is None else (False, grammar(lang).reduce(s), None, end)
    return out


_PY = re.compile(
    r"""(?P<c>#[^\n]*+|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*+\"\"\"|(?!'''|\"\"\")(?:'(?:[^'\\\n]|\\[\s\S])*+'|"(?:[^"\\\n]|\\[\s\S])*+")|\\\n)"""
    r"""|(?P<t>'''|\"\"\")|(?P<o>[\[({])|(?P<e>[\])}])|(?P<n>\n(?=[^\s#)\]}]))"""
)
_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b")
_BEGINS = re.compile(r"(?:def|class|async)\b|@")


def _python_lines(text: str, state: str) -> tuple[list[tuple[int, int]], int, int, str]:
    """([(place, brackets open)] of the lines where a statement of the top level may begin, least and last number of open brackets, state at the end)."""
    lead = state or "\n"
    found: list[tuple[int, int]] = []
    depth = low = 0
    end = ""
    seen: dict[int, bool] = {}  # by depth: whether the line before is a decorator
    for m in _PY.finditer(lead + text):
        k = m.lastgroup
        if k == "o":
            depth += 1
        elif k == "e":
            depth -= 1
            low = min(low, depth)
        elif k == "t":
            end = m.group()
            break
        elif k == "n":
            at = m.end() - len(lead)
            begins = _BEGINS.match(text, at)
            # the line before the chunk may be a decorator
            if not (_GOES_ON.match(text, at) or seen.get(depth, bool(begins))):
                found.append((at, depth))
            seen[depth] = text[at] == "@"
    return found, low, depth, end


def _python_summary(text: str, first: bool, states: list[str]) -> Map:
    out: Map = {}
    known: dict[str, bool] = {}
    for state in ("",) if first else states:
        if state and state not in text:
            out[f"{state}|*"] = (False, text, None, f"{state}|0")
            continue
        found, low, last, end = _python_lines(text, state)
        for depth in range(1 if first else 1 - low):
            at = [a for a, d in found if d == -depth]
            there = f"{end}|{depth + last}"
            if not at:
                out[f"{state}|{depth}"] = (False, text, None, there)
                continue
            bad = False
            for a, b in zip(at, at[1:]):
                part = text[a:b]
                if part not in known:
                    known[part] = python_parses(part)
                bad = bad or not known[part]
            out[f"{state}|{depth}"] = (bad, text[: at[0]], text[at[-1] :], there)
        if not first:  # more brackets open than the chunk closes: no statement begins in it
            out[f"{state}|*"] = (False, text, None, f"{end}|{last}")
    return out


def compose(a: Map, b: Map, lang: str) -> Map:
    """The map of two neighbouring chunks from theirs."""
    if lang == "python":
        return _python_compose(a, b)
    out: Map = {}
    for state, (broken, s, _, end) in a.items():
        other, t, _, last = b.get(end, (True, "", None, ""))
        if broken or other:
            out[state] = (True, "", None, "")
            continue
        glue = ""
        if lang in ("js", "ts") and s and t and end in ("", "/*"):
            enders = classes._JS_ENDERS if lang == "js" else classes._TS_ENDERS
            tail = s[-1] if ord(s[-1]) < 0x2000 else ")"
            head = t[0] if ord(t[0]) < 0x2000 else "{" if ord(t[0]) >= 0x2200 else "i"
            glue = "N" if tail in enders and head not in classes._JS_NEVER else ""
        out[state] = (False, grammar(lang).reduce(s + glue + t), None, last)
    return out


def _joined(a: Entry, b: Entry, end: str) -> Entry:
    if a[2] is None:
        return a[0] or b[0], a[1] + b[1], b[2], end
    if b[2] is None:
        return a[0] or b[0], a[1], a[2] + b[1], end
    return a[0] or b[0] or not python_parses(a[2] + b[1]), a[1], b[2], end


def _python_compose(a: Map, b: Map) -> Map:
    out: Map = {}
    never: Entry = (True, "", None, "|0")
    for state, x in a.items():
        quote, _, depth = x[3].partition("|")
        beyond = b.get(f"{quote}|*", never)
        if not state.endswith("*"):
            y = b.get(x[3])
            if y is None:
                y = beyond
                q, _, more = y[3].partition("|")
                out[state] = _joined(x, y, f"{q}|{int(depth) + int(more)}")
            else:
                out[state] = _joined(x, y, y[3])
            continue
        # depths that only the second chunk comes back from
        for other, y in b.items():
            q, _, d = other.partition("|")
            if q == quote and d != "*" and (k := int(d) - int(depth)) >= 0 and f"{state[:-1]}{k}" not in a:
                out[f"{state[:-1]}{k}"] = _joined(x, y, y[3])
        q, _, more = beyond[3].partition("|")
        out[state] = _joined(x, beyond, f"{q}|{int(depth) + int(more)}")
    return out


def decided(whole: Map, lang: str) -> bool:
    """Whether the map of a whole file is that of a valid one."""
    if lang == "python":
        broken, head, tail, _ = whole["|0"]
        return not broken and python_parses(head) and (tail is None or python_parses(tail))
    broken, s, _, end = whole[""]
    return not broken and end in ("", "?>") and not _LEFT.search(s) and grammar(lang).top(s)


def folded(maps: list[Map], lang: str) -> Map:
    """The map of all chunks, in order."""
    whole = maps[0]
    for m in maps[1:]:
        whole = compose(whole, m, lang)
    return whole


def runs(text: str, lang: str, size: int = CHUNK_CHARS, many: int = RUN_CHUNKS) -> Iterator[tuple[int, Map]]:
    """(number, map) of every run of ``many`` chunks of a file."""
    text = text.replace("\r\n", "\n")
    parts = cut_at_lines(text, size)
    states = states_of(text, lang) if len(parts) > 1 else [""]
    for k in range(0, len(parts), many):
        yield k // many, folded([summary(part, lang, k + j == 0, states) for j, part in enumerate(parts[k : k + many])], lang)


_RUNS = "file_id long, repo string, file string, ext string, lang string, at timestamp, digest long, valid boolean, run struct<n:int,map:string>"


def _summaries(batches: Iterator[pd.DataFrame], relabelled: Bits | None, size: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for ident, repo, file, ext, text, at, digest, langs in asked_languages(pdf, relabelled, ["file_id", "repo", "file", "ext", "source", "at", "digest"]):
            text = plain_source(text, file)
            for lang in langs:
                got = list(runs(text, lang, size)) if text else []
                if len(got) < 2:  # nothing left to compose with
                    rows.append((ident, repo, file, ext, lang, at, digest, not got or decided(got[0][1], lang), None))
                else:
                    rows += [(ident, repo, file, ext, lang, at, digest, None, (n, json.dumps(m))) for n, m in got]
        yield pd.DataFrame(rows, columns=["file_id", "repo", "file", "ext", "lang", "at", "digest", "valid", "run"])


def _reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        valid = []
        for lang, known, parts in zip(pdf["lang"], pdf["valid"], pdf["runs"]):
            if parts is not None and len(parts):
                known = decided(folded([{k: tuple(v) for k, v in json.loads(x["map"]).items()} for x in sorted(parts, key=lambda x: x["n"])], lang), lang)
            valid.append(bool(known))
        yield pdf.drop(columns=["valid", "runs"]).assign(valid=valid)


def extension_language(file: Column) -> Column:
    ext = F.lower(F.regexp_extract(file, r"\.([^./]*)$", 1))
    known = F.create_map(*[F.lit(x) for e, la in EXTENSIONS.items() if la in PROGRAMMING for x in (e, la)])
    return known[ext]


# Names under which file_results.language gives the eight languages.
NAMES = {"php": "php", "javascript": "js", "typescript": "ts", "c": "c", "java": "java", "python": "python", "go": "go", "lua": "lua"}


def stated_language(results: DataFrame) -> DataFrame:
    """(file_id, stated): the language of the latest analysis where it is not the extension's."""
    known = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    rows = results.select("file_id", F.col("analyzed_at").alias("at"), known[F.lower(F.trim("language"))].alias("stated"), extension_language(F.col("file")).alias("ext"))
    last = rows.filter("stated is not null and file_id is not null").groupBy("file_id").agg(F.max_by(F.struct("stated", "ext"), F.struct("at", "stated")).alias("x"))
    return last.select("file_id", "x.*").filter("ext is null or stated != ext").select("file_id", "stated")


def with_languages(files: DataFrame, results: DataFrame | None) -> tuple[DataFrame, DataFrame | None, Broadcast]:
    """(rows with ``ext``, ``source``, ``at``, ``digest``, ``h``; stated languages; a bitmap of the ids that have one).

    A worker can't know a stated language, only that there may be one: see ``asked_languages`` and ``of_stated_language``."""
    at = F.col("loaded_at") if "loaded_at" in files.columns else F.lit(None)
    rows = files.select("file_id", "repo", "file", extension_language(F.col("file")).alias("ext"), F.col("source").cast("string").alias("source"), at.cast("timestamp").alias("at")).filter("file_id is not null")
    rows = rows.withColumn("digest", F.xxhash64("source")).withColumn("h", F.xxhash64("file_id"))
    stated, bits = None, None
    if results is None:
        rows = rows.filter("ext is not null")
    else:
        stated = cut(stated_language(results))
        # about 64 bits an id, up to 16 MB
        size = 1 << min(27, max(16, (64 * stated.count()).bit_length()))
        bits = Bits.of(stated.select(F.xxhash64("file_id").alias("h")), size, (5, 33))
    return rows, stated, files.sparkSession.sparkContext.broadcast(bits)


def asked_languages(pdf: pd.DataFrame, relabelled: Bits | None, columns: list[str]) -> Iterator[tuple]:
    """The columns' values and the languages to read each file in: its extension's, or all where another may be stated."""
    many = relabelled.has(pdf["h"].to_numpy(np.int64).view(np.uint64)) if relabelled else np.zeros(len(pdf), bool)
    for *row, ext, m in zip(*(pdf[c] for c in columns), pdf["ext"], many):
        langs = PROGRAMMING if m else (ext,) if ext else ()
        if langs:
            yield *row, langs


def of_stated_language(rows: DataFrame, stated: DataFrame | None) -> DataFrame:
    """Of rows(file_id, ext, lang) those in the language that counts; each file has eight rows at most."""
    if stated is None:
        return rows
    return join_small(rows, stated, ["file_id"], "left", even=True).filter(F.col("lang") == F.coalesce("stated", "ext"))


def syntax_verdicts(files: DataFrame, results: DataFrame | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(file_id, repo, file, lang, valid) of every source file of the eight languages."""
    rows, stated, shared = with_languages(files, results)
    per_run = rows.mapInPandas(lambda it: _summaries(it, shared.value, chunk_chars), _RUNS)
    # copies of one content first, then the content loaded last
    each = per_run.groupBy("file_id", "ext", "lang", "at", "digest").agg(F.max(F.struct("repo", "file")).alias("f"), F.max("valid").alias("valid"), F.collect_set("run").alias("runs"))
    last = each.groupBy("file_id", "lang").agg(F.max_by(F.struct("ext", "f", "valid", "runs"), F.struct("at", "digest")).alias("x"))
    flat = last.select("file_id", "lang", "x.ext", "x.f.repo", "x.f.file", "x.valid", "x.runs")
    done = flat.mapInPandas(_reduce, "file_id long, lang string, ext string, repo string, file string, valid boolean")
    return of_stated_language(done, stated).select("file_id", "repo", "file", "lang", "valid")


def broken_rates(verdicts: DataFrame) -> DataFrame:
    """Per repo and language: files, broken ones and their share."""
    return verdicts.groupBy("repo", "lang").agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("broken")).withColumn("rate", F.col("broken") / F.col("files"))


__all__ = ["broken_rates", "language_of", "parses", "syntax_verdicts"]
