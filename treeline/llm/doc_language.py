"""The language of documents and of each part of them, by language-bitmask n-gram filters.

A bit-sliced Bloom filter answers, for an n-gram, with a mask of all languages that hold
it: every slot is one integer with a bit per language, and the masks of an n-gram's slots
are ANDed. The bits are counted per language over a line; the counts are corrected by each
language's false positive rate (known from how full its bit slice is), and the largest
corrected share of n-grams decides. Confidence is how far it leads.

The filters are fitted on own seed texts and a bounded labelled sample; labelled lines
count only where filters fitted before confirm the label.

Defined results: null or empty texts have no prose; a line of code, log, title or fewer
than four words (eight characters of Chinese or Japanese) is no prose; rows with null ids
are left out; equal scores go to the language that stands first in ``LANGS``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.labels import LANGS, SEEDS, label_code

#: Slots of the filter (a power of two), n-gram lengths, least share of a line's n-grams that must be known.
SLOTS = 1 << 20
GRAM = 4
CJK_GRAM = 2
LEAST_SCORE = 0.15
#: The language of a document that can't be told; what its whole text counts where no prose line decides.
UNKNOWN = "und"
WHOLE_CONFIDENCE = 0.5
#: Characters whose n-grams are held in memory at once.
BLOCK_CHARS = 1_000_000
#: An n-gram belongs to a language if it is at least this frequent there against where it is most frequent.
DOMINANCE = 0.15

_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_TICKED = re.compile(r"`[^`\n]*`")
_IDENT = re.compile(r"[a-z][A-Z]|[_.\-/()$:=\d]")
_ADDRESS = re.compile(r"\b[a-z]+://\S+|(?<!\S)\S*[/\\]\S*|\S+@\S+\.\w+|(?<!\w)[@#]\w+")
_NAMES = re.compile(r"\w*(?:[a-z][A-Z]|_)\w*")
_NAMED = re.compile(r"[a-z][A-Z]|_")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿々ー]")
_FENCE = re.compile(r"\s*(?:```[^`]*\Z|~~~)")
_CODE = re.compile(r"[;{}]\s*\Z|\w\s*:?=\s*\w+[\w.]*\(|\A\s*(?:let|var|const|def|func|return|import)\s+\w+\s*[=(]|\w+\([^)]*\)\s*;?\s*\Z|\A\s*\$\w+\s*=")
_LOG = re.compile(r"\A\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\S+\.\w+:\d+(?::\d+)?\s|(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|TRACE)\b[\s:]|at [\w.$]+\()")
_TITLE = re.compile(r"\A\s*#{1,6}\s+\S[^.!?]*\Z|\A[=-]{3,}\s*\Z")


def bare(line: str) -> str:
    """The line's natural words in lower case, separated by single spaces."""
    if "`" in line:
        line = _TICKED.sub(lambda m: " " if _IDENT.search(m.group()[1:-1]) else f" {m.group()[1:-1]} ", line)
    if "/" in line or "@" in line or "#" in line or "\\" in line:
        line = _ADDRESS.sub(" ", line)
    if _NAMED.search(line):
        line = _NAMES.sub(" ", line)
    return _NOT_LETTER.sub(" ", line).strip().lower()


def prose_lines(text: str) -> list[tuple[int, str]]:
    """(1-based line, bare words) of the lines that may be prose."""
    out, fenced = [], False
    if _INVISIBLE.search(text):
        text = _INVISIBLE.sub("", text)
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if len(line) < 8 and not _FENCE.match(line):
            continue
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or _LOG.match(line) or ("=" in line or "(" in line or ";" in line or "{" in line or "}" in line) and _CODE.search(line):
            continue
        if line.lstrip()[:1] == "#" and _TITLE.match(line) and (k == 0 or not lines[k - 1].strip()) and (k + 1 >= len(lines) or not lines[k + 1].strip()):
            continue
        words = bare(line)
        if len(_CJK.findall(words)) >= 8 or len(_WORD.findall(words)) >= 4:
            out.append((k + 1, words))
    return out


def whole(text: str) -> str:
    """The bare words of all lines outside code fences, or of all lines where those have none."""
    outside, fenced = [], False
    lines = _INVISIBLE.sub("", text).split("\n")
    for line in lines:
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced:
            outside.append(bare(line))
    return " ".join(x for x in outside if x) or " ".join(x for x in map(bare, lines) if x)


def grams(texts: list[str], goes_on: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every n-gram, index of the text that it is from).

    A text that ``goes_on`` from the one before begins with that one's last GRAM - 1 characters."""
    joined = "\0".join(texts if goes_on is not None else [f" {t} " for t in texts]) + "\0\0\0\0"
    c = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    zero = c == 0
    owner = np.cumsum(zero)
    n = len(c) - GRAM
    m = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        two = (c[:n] * m + c[1 : n + 1]) * m
        four = ((two + c[2 : n + 2]) * m + c[3 : n + 3]) * m
    wide = ((c >= 0x3040) & (c <= 0x30FF)) | ((c >= 0x3400) & (c <= 0x9FFF))
    cjk = wide[:n] & wide[1 : n + 1]
    if goes_on is not None and any(goes_on):  # its first two-letter grams were counted before
        start = np.concatenate([[0], np.flatnonzero(zero)[: len(texts) - 1] + 1])[np.array(goes_on)]
        for k in range(GRAM - CJK_GRAM):
            cjk[start + k] = False
    four_ok = ~(zero[:n] | zero[1 : n + 1] | zero[2 : n + 2] | zero[3 : n + 3]) & ~(wide[:n] | wide[1 : n + 1] | wide[2 : n + 2] | wide[3 : n + 3])
    h = np.where(wide[:n] & wide[1 : n + 1], two ^ np.uint64(0xABCDEF), four)
    keep = cjk | four_ok
    return h[keep], owner[:n][keep]


def blocks(texts: list[str], chars: int = BLOCK_CHARS) -> Iterator[tuple[np.ndarray, list[str], list[bool]]]:
    """(index of the text of each piece, pieces, whether a piece goes on from the one before): all texts in blocks of about ``chars`` characters.

    Pieces of one text overlap, so that every n-gram lies in exactly one."""
    at: list[int] = []
    pieces: list[str] = []
    on: list[bool] = []
    size = 0
    for k, t in enumerate(texts):
        t = f" {t} "
        for a in range(0, len(t), chars):
            piece = t[max(0, a - GRAM + 1) : a + chars]
            at.append(k)
            pieces.append(piece)
            on.append(a > 0)
            size += len(piece)
            if size >= chars:
                yield np.array(at), pieces, on
                at, pieces, on, size = [], [], [], 0
    if pieces:
        yield np.array(at), pieces, on


def slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(SLOTS - 1)
    with np.errstate(over="ignore"):
        a = h ^ (h >> np.uint64(29))
        b = (a * np.uint64(0xBF58476D1CE4E5B9)) ^ (a >> np.uint64(32))
    return ((a >> np.uint64(17)) & mask).astype(np.int64), ((b >> np.uint64(23)) & mask).astype(np.int64)


class Filters:
    """The bit-sliced filter and each language's false positive rate."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.table = np.zeros(SLOTS, dtype=np.uint16)
        all_h = np.unique(np.concatenate([h for h, _ in counts.values()]))
        rates = np.zeros((len(LANGS), len(all_h)))
        for k, code in enumerate(LANGS):
            h, n = counts[code]
            rates[k, np.searchsorted(all_h, h)] = n / max(1, n.sum())
        held = (rates > 0) & (rates >= DOMINANCE * rates.max(axis=0))
        masks = (held * (1 << np.arange(len(LANGS)))[:, None]).sum(axis=0).astype(np.uint16)
        for s in slots(all_h):
            np.bitwise_or.at(self.table, s, masks)
        fill = np.array([np.mean((self.table >> k) & 1) for k in range(len(LANGS))])
        self.false_rate = fill**2

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of all languages that hold it."""
        a, b = slots(h)
        return self.table[a] & self.table[b]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Per text and language the corrected share of n-grams held."""
        total = np.zeros(len(texts))
        hits = np.zeros((len(texts), len(LANGS)))
        for at, pieces, on in blocks(texts):
            h, owner = grams(pieces, on)
            mask, whose = self.masks(h), at[owner]
            total += np.bincount(whose, minlength=len(texts))
            for k in range(len(LANGS)):
                hits[:, k] += np.bincount(whose, weights=(mask >> k) & 1, minlength=len(texts))
        share = (hits - total[:, None] * self.false_rate) / np.maximum(1.0, total)[:, None] / (1 - self.false_rate)
        return np.clip(share, 0, 1)

    def decide(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, its score, confidence) of each text."""
        s = self.scores(texts)
        if not len(s):
            return np.zeros(0, int), np.zeros(0), np.zeros(0)
        best = s.argmax(axis=1)
        top = s[np.arange(len(s)), best]
        s2 = s.copy()
        s2[np.arange(len(s)), best] = -1
        second = np.maximum(0, s2.max(axis=1))
        return best, top, (top - second) / np.maximum(top, 1e-9)


def _count(lines: dict[str, list[str]], least: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for code in LANGS:
        h, n = np.unique(grams(lines[code])[0], return_counts=True) if lines[code] else (np.zeros(0, np.uint64), np.zeros(0, int))
        seeds = np.unique(grams([bare(x) for x in SEEDS[code].split(". ")])[0])
        keep = (n >= least) | np.isin(h, seeds)
        out[code] = h[keep], n[keep]
    return out


def fit(sample: list[tuple[str, str]]) -> Filters:
    """Filters from the seed texts and the labelled lines that earlier filters confirm."""
    seeds = {code: [bare(x) for x in re.split(r"(?<=[.?。？])\s*", SEEDS[code]) if x] for code in LANGS}
    filters = Filters(_count(seeds, 1))
    labelled: dict[str, list[str]] = defaultdict(list)
    for code, text in sample:
        labelled[code] += [w for _, w in prose_lines(text)]
    for lead in (0.15, 0.3):
        lines = {}
        for k, code in enumerate(LANGS):
            best, _, conf = filters.decide(labelled[code])
            lines[code] = seeds[code] + [w for w, b, c in zip(labelled[code], best, conf) if b == k and c >= lead]
        filters = Filters(_count(lines, 2))
    return filters


def _rest(pdf: pd.DataFrame, done: set[int], filters: Filters) -> pd.DataFrame:
    """A row with line 0 for each document that no prose line decides."""
    left = [(i, label_code(label) or "", whole(t) if t else "") for i, label, t in zip(pdf["doc_id"], pdf["lang"], pdf["text"]) if i not in done]
    best, top, conf = filters.decide([w for _, _, w in left])
    rows = [(i, 0, LANGS[b] if ok else UNKNOWN, label, float(c) * WHOLE_CONFIDENCE if ok else 0.0, max(1, len(w))) for (i, label, w), b, c, ok in zip(left, best, conf, top >= LEAST_SCORE)]
    return pd.DataFrame(rows, columns=["doc_id", "line", "lang", "label", "confidence", "size"])


def _lines(batches: Iterator[pd.DataFrame], filters: Filters, every: bool = False) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, labels, numbers, words = [], [], [], []
        for i, label, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"]):
            code = label_code(label) or ""
            for number, w in prose_lines(text) if text else ():
                ids.append(i)
                labels.append(code)
                numbers.append(number)
                words.append(w)
        best, top, conf = filters.decide(words)
        ok = top >= LEAST_SCORE
        names = np.array(LANGS, dtype=object)
        if every:
            yield _rest(pdf, set(np.array(ids, dtype=np.int64)[ok].tolist()), filters)
        yield pd.DataFrame({"doc_id": np.array(ids, dtype=np.int64)[ok], "line": np.array(numbers, dtype=np.int32)[ok], "lang": names[best[ok]] if len(best) else np.array([], object), "label": np.array(labels, dtype=object)[ok], "confidence": conf[ok], "size": np.array([len(w) for w in words], dtype=np.int32)[ok]})


def prose_languages(documents: DataFrame, filters: Filters, every: bool = False) -> DataFrame:
    """(doc_id, line, lang, label, confidence, size): every prose line with its language and
    the code that the document's label names ('' for none).

    ``every``: documents without such a line have one row with line 0, the language of their
    whole bare text, or UNKNOWN."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text")).filter("doc_id is not null" if every else "doc_id is not null and text is not null")
    return rows.mapInPandas(lambda it: _lines(it, filters, every), "doc_id long, line int, lang string, label string, confidence double, size int")


def wrong_lines(lines: DataFrame) -> DataFrame:
    """Prose lines whose language isn't the one that the label names."""
    return lines.filter("lang != label").select("doc_id", "line", "lang")


def document_languages(lines: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, share, label_right): the main language of each document.

    UNKNOWN has confidence and share 0, and nothing says whether its label is right."""
    per = lines.groupBy("doc_id", "label", "lang").agg(F.sum("size").alias("size"), F.avg("confidence").alias("confidence"))
    return (
        per.groupBy("doc_id", "label")
        .agg(F.max_by(F.struct("lang", "confidence", "size"), F.struct("size", "lang")).alias("m"), F.sum("size").alias("all"))
        .select("doc_id", F.col("m.lang").alias("lang"), F.col("m.confidence").alias("confidence"), F.when(F.col("m.lang") == UNKNOWN, 0.0).otherwise(F.col("m.size") / F.col("all")).alias("share"), F.when(F.col("m.lang") != UNKNOWN, F.col("label") == F.col("m.lang")).alias("label_right"))
    )


def segments(lines: DataFrame) -> DataFrame:
    """(doc_id, first_line, last_line, lang, confidence): runs of prose lines in one language."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("line")
    runs = lines.withColumn("new", F.coalesce((F.lag("lang").over(w) != F.col("lang")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("doc_id", "run", "lang").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.avg("confidence").alias("confidence")).drop("run")
