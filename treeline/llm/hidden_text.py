"""Natural language in comments and string literals, and its language.

Each line of a comment or literal is encoded with one zstandard dictionary per
language and one of code; the shortest encoding names the language. A line is code, and left out,
if the code dictionary's encoding is shorter by a margin; others need the least number of words once
identifiers, paths, tags and numbers are taken away.

The dictionaries of languages hold own seed texts plus lines of a bounded labelled sample
(``labels.SAMPLE_ROWS`` documents) whose label the seed dictionaries confirm. That of code holds own
seeds (queries, commands) plus what stands outside comments and literals in ``labels.SAMPLE_FILES``
source files. The margin is fitted on lines of code that the dictionary doesn't hold.

Defined results: null or empty texts and files of unknown kinds give no rows; files whose
content is not of the kind that their extension names give no rows; copies of an id count
once; rows with null ids are left out; a line with two languages gives one row for each.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.kinds import content_kind
from treeline.llm.labels import LANGS, SEEDS
from treeline.parsers.spans import PROGRAMMING, language_of, span_lines, spans

#: Bytes of each dictionary, least words or characters of a text.
DICT_BYTES = 24_000
MIN_WORDS = 4
MIN_CHARS = 8
#: How many bytes a character the code dictionary's encoding must be shorter than the best language's for a line to
#: be code: the value without a sample of code, the bounds of the fitted one, and the share of code lines it lets pass.
CODE_MARGIN = 0.0
MARGINS = (0.01, 0.3)
CODE_PASSES = 0.05

CODE_SEED = """SELECT id, name FROM users WHERE created > 10 ORDER BY name DESC
SELECT id, total FROM orders
INSERT INTO items (id, name) VALUES (1, 'a')
UPDATE items SET name = 'b' WHERE id = 4
DELETE FROM items WHERE id = 7
SELECT id, kind FROM nodes LIMIT 5
git commit -m fix && git push origin main
docker run --rm -it -v /tmp:/data image:latest sh -c ls
npm install --save-dev left-pad
curl -X POST https://host.example/api/v1/items -H 'Accept: application/json'
make clean all test install
let count = total + 1; return count;
for (let i = 0; i < n; i++) { sum = sum + i; }
if (value > 10) { throw new Error("bad"); }
public static void main(String[] args) {
int total = sum(left, right); return total * 2;
def apply(self, value): return value + 1
var result = parse(input, 42);
const x = require('./file');
import { a, b } from './c';
/usr/local/bin/tool /var/log/app.log src/main/file.tmp
app.module.enabled=true key:%d;value [a-z]+_name X-header-name
Apache-2.0 MIT BSD GPL-3.0 v1.2.3 https://name.example/path
"""

_NOISE = re.compile(r"`[^`\n]*`|\b[a-z]+://\S+|\bwww\.\S+|\S+@\S+\.\w+")
_PATHS = re.compile(r"(?<!\S)\S*[/\\]\S*(?!\S)")
_TAG = re.compile(r"\A\s*(?:@\w+(?:\s+(?:\{[^}]*\}\s*)?\$?[\w.]+(?=\s+\S))?|(?:TODO|FIXME|XXX|HACK|NOTE)\b(?:\([^)]*\))?[:\s-]*)\s*", re.I)
# A word of letters only, not in camel case, with punctuation around it.
_WORD = re.compile(r"(?<!\S)[\"'(«„“‘¿¡\[*_>-]*+(?:[^\W\d_]+(?<![a-z](?=[A-Z]))(?:['’ʼ-](?=[^\W\d_]))?)++[.,;:!?…\"'»“”’)\]*_—–-]*+(?!\S)")
_CAMEL = re.compile(r"[a-z][A-Z]")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿々ー]")
_SQL = re.compile(r"\A\s*(?:SELECT\b.*\bFROM\b|INSERT\s+INTO\b|UPDATE\b.*\bSET\b|DELETE\s+FROM\b|CREATE\s+TABLE\b|ALTER\s+TABLE\b|DROP\s+TABLE\b)|-*(?:BEGIN|END) [A-Z ]*KEY-----")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_LATIN = re.compile(r"[a-zA-ZÀ-ſ]")
_HIGH = re.compile(r"[^\x00-\u2fff]")


def bare_text(line: str) -> str:
    """The line without tags, code spans and addresses."""
    c = line[:1]
    if c == "@" or c in "tTfFxXhHnN":
        line = _TAG.sub("", line, count=1)
    if "`" in line or "://" in line or "@" in line or "www." in line:
        line = _NOISE.sub(" ", line)
    if "/" in line or "\\" in line:
        line = _PATHS.sub(" ", line)
    return line.strip()


def enough(text: str) -> bool:
    """Whether enough natural words are left."""
    if _HIGH.search(text) and len(_CJK.findall(text)) >= MIN_CHARS:
        return True
    return sum(1 for w in _WORD.findall(text) if not _CAMEL.search(w)) >= MIN_WORDS


class Encoders:
    """One zstandard dictionary per language, and one of code."""

    def __init__(self, content: dict[str, bytes], margin: float = CODE_MARGIN) -> None:
        self.content = content
        self.margin = margin
        self.made: dict[str, zstandard.ZstdCompressor] | None = None

    def __getstate__(self) -> dict:
        return {"content": self.content, "margin": self.margin, "made": None}

    def compressors(self) -> dict[str, zstandard.ZstdCompressor]:
        if self.made is None:
            self.made = {}
            for name, data in self.content.items():
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                # matches of three bytes count: much of a short sentence is word endings
                how = zstandard.ZstdCompressionParameters(min_match=3, strategy=zstandard.STRATEGY_GREEDY, window_log=17, hash_log=15, chain_log=15, search_log=5, write_content_size=0, write_checksum=0, write_dict_id=0)
                self.made[name] = zstandard.ZstdCompressor(dict_data=d, compression_params=how)
        return self.made

    def sizes(self, text: str, names: Iterable[str]) -> dict[str, int]:
        data = (" " + text.lower()).encode("utf-8", "replace")
        made = self.compressors()
        return {x: len(made[x].compress(data)) for x in names}

    @staticmethod
    def candidates(text: str) -> tuple[str, ...]:
        """The languages written in the text's script."""
        if _HIGH.search(text) and len(_CJK.findall(text)) >= MIN_CHARS:
            return "zh", "ja"
        return ("uk", "ru") if len(_CYRILLIC.findall(text)) * 2 > len(_LATIN.findall(text)) else ("en", "de", "fr", "es", "pt", "pl")

    def language(self, text: str) -> str | None:
        """The language of the shortest encoding, or None for what looks like code."""
        best, lead = self.against_code(text)
        return best if lead >= -self.margin else None

    def against_code(self, text: str) -> tuple[str, float]:
        """(language of the shortest encoding, by how many bytes a character it is shorter than that by the code dictionary)."""
        names = self.candidates(text)
        sizes = self.sizes(text, (*names, "code"))
        code = sizes.pop("code")
        best = min(sizes, key=lambda x: (sizes[x], LANGS.index(x)))
        return best, (code - sizes[best]) / max(1, len(text))

    def lead(self, text: str, code: str) -> float:
        """How much shorter the encoding in ``code`` is than in any other language, as a share."""
        names = self.candidates(text)
        if code not in names:
            return -1.0
        sizes = self.sizes(text, names)
        own = sizes.pop(code)
        return 1 - own / max(1, min(sizes.values()))


def _even(groups: tuple[tuple[str, ...], ...] = (("en", "de", "fr", "es", "pt", "pl"), ("uk", "ru"), ("zh", "ja"))) -> dict[str, str]:
    """Seeds cut to one length within a script, as a longer dictionary finds more matches by chance."""
    return {k: SEEDS[k].lower()[: min(len(SEEDS[x]) for x in g)] + " " for g in groups for k in g}


EVEN_SEEDS = _even()


def seed_encoders() -> Encoders:
    return Encoders({k: v.encode() for k, v in EVEN_SEEDS.items()} | {"code": CODE_SEED.lower().encode()})


def code_lines(files: list[tuple[str, str]]) -> list[str]:
    """Distinct lines of code of programming languages, without comments and literals."""
    out: dict[str, None] = {}
    for file, text in files:
        lang = language_of(file)
        if lang not in PROGRAMMING:
            continue
        at, parts = 0, []
        for _, a, b in spans(text, lang):
            parts.append(text[at:a])
            at = b
        out |= dict.fromkeys(x for line in "".join([*parts, text[at:]]).split("\n") if len(x := line.strip()) >= MIN_CHARS)
    return list(out)


def fit(sample: list[tuple[str, str]], bytes_each: int = DICT_BYTES, code: list[tuple[str, str]] = ()) -> Encoders:
    """Dictionaries from the seed texts and the labelled lines that they confirm, and from code.

    A line counts for its label only if that language's encoding is clearly the shortest;
    a second pass asks the dictionaries of the first, as labels may be wrong."""
    enc = seed_encoders()
    lines: dict[str, list[str]] = defaultdict(list)
    held: dict[str, int] = defaultdict(int)
    for lang, text in sample:
        for line in text.split("\n") if held[lang] < 4 * bytes_each else ():
            bare = bare_text(line)
            if enough(bare):
                lines[lang].append(bare)
                held[lang] += len(bare.encode())
    source = code_lines(code)
    random.Random(1).shuffle(source)
    in_code, rest = _upto(source, bytes_each)
    code_text = (" ".join(x.lower() for x in in_code) + " " + CODE_SEED.lower()).encode()
    for least in (0.08, 0.2):
        content = {"code": code_text}
        for lang in LANGS:
            # distinct lines, the seed last: what stands at a dictionary's end is cheapest to refer to
            sure = [x for x in dict.fromkeys(lines[lang]) if enc.lead(x, lang) >= least]
            fresh, _ = _upto(sure, bytes_each)
            content[lang] = (" ".join(x.lower() for x in fresh) + " " + EVEN_SEEDS[lang]).encode()
        enc = Encoders(content)
    enc.margin = fitted_margin([enc.against_code(x)[1] for x in map(bare_text, rest) if enough(x)])
    return enc


def _upto(lines: list[str], size: int) -> tuple[list[str], list[str]]:
    """The first lines up to a size in bytes, and the others."""
    held = 0
    for k, x in enumerate(lines):
        if held >= size:
            return lines[:k], lines[k:]
        held += len(x.encode())
    return lines, []


def fitted_margin(code: list[float]) -> float:
    """The widest margin that lets at most CODE_PASSES of code lines pass, within MARGINS.

    Natural text needs the room: a short sentence of words that code uses too is no code."""
    return float(np.clip(-np.quantile(code, 1 - CODE_PASSES), *MARGINS)) if code else CODE_MARGIN


def text_lines(enc: Encoders, lines: Iterable[tuple[int, str]]) -> Iterator[tuple[int, str, int]]:
    """(line, language, characters) of the lines that are natural language."""
    for number, raw in lines:
        if len(raw) < MIN_CHARS or _SQL.match(raw):
            continue
        bare = bare_text(raw)
        if enough(bare) and (lang := enc.language(bare)):
            yield number, lang, len(bare)


def _scan_files(batches: Iterator[pd.DataFrame], enc: Encoders) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for ident, file, text in zip(pdf["file_id"], pdf["file"], pdf["source"]):
            lang = language_of(file)
            if not text or not lang or not content_kind(text, lang):
                continue
            found: dict[tuple[int, str], int] = {}
            for number, natural, size in text_lines(enc, ((n, t) for _, n, t in span_lines(text, lang))):
                found[number, natural] = found.get((number, natural), 0) + size
            out += [(ident, n, la, size, len(text)) for (n, la), size in found.items()]
        yield pd.DataFrame(out, columns=["record_id", "line", "lang", "chars", "text_chars"])


def _scan_messages(batches: Iterator[pd.DataFrame], enc: Encoders) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for ident, text in zip(pdf["finding_id"], pdf["message"]):
            if text:
                out += [(ident, 1, la, size, len(text)) for _, la, size in text_lines(enc, [(1, text.replace("\n", " "))])]
        yield pd.DataFrame(out, columns=["record_id", "line", "lang", "chars", "text_chars"])


OUT = "record_id long, line int, lang string, chars int, text_chars int"


def source_text(files: DataFrame, enc: Encoders) -> DataFrame:
    """(record_id, line, lang, chars, text_chars) for every line of a source file with natural language."""
    rows = files.select("file_id", "file", F.col("source").cast("string").alias("source")).filter("file_id is not null and file is not null and source is not null")
    return rows.mapInPandas(lambda it: _scan_files(it, enc), OUT).dropDuplicates(["record_id", "line", "lang"])


def message_text(findings: DataFrame, enc: Encoders) -> DataFrame:
    rows = findings.select("finding_id", "message").filter("finding_id is not null and message is not null")
    return rows.mapInPandas(lambda it: _scan_messages(it, enc), OUT).dropDuplicates(["record_id", "line", "lang"])


def language_shares(found: DataFrame) -> DataFrame:
    """(record_id, lang, lines, share of the file's natural-language characters, share of all its characters)."""
    from pyspark.sql import Window

    per = found.groupBy("record_id", "lang").agg(F.count("*").alias("lines"), F.sum("chars").alias("chars"), F.max("text_chars").alias("all"))
    share = F.col("chars") / F.sum("chars").over(Window.partitionBy("record_id"))
    return per.select("record_id", "lang", "lines", share.alias("share"), (F.col("chars") / F.col("all")).alias("file_share"))


__all__ = ["Encoders", "fit", "language_shares", "message_text", "source_text"]
