"""Which source files are handwritten, generated, minified, vendored or data, by belief
propagation over directory trees.

Each file gives log evidence for the five labels from its text (density of white space,
share of literals, repetition of line shapes, banners) and its own name. Each directory has a
hidden label of the same kind, with evidence of its own from its name; a file's label is compatible
with its directory's, a directory's with its parent's, in both directions by a table of its own.
The tables are counted, over all data: how often files that are sure alone stand beside others, and
directories below others, against chance. The tree is exact for sum-product: messages go up level by
level (sums per directory, pre-aggregated before the shuffle), then down, and every file's
belief is its evidence times the message that its directory sends. Siblings speak to each
other through their directory.

Rows of files are only ever grouped by (repo, directory) into sums, so neither a repo
nor a directory with a third of all files is gathered in one task.

Defined results: null or empty texts give no evidence and are handwritten, as far as their directory
lets them; configuration files, unknown kinds and rows with null ids are left out; a null repo or path
counts as an empty one; of copies of a file_id the one loaded last counts (if there is a ``loaded_at``);
the language is the one that the results state, else that of the extension; files that don't parse keep
their label but are no findings; only files that may become findings are parsed, ``valid`` is null for others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.cluster import HOT_SHARE, cut, join_small
from treeline.llm.bits import Bits
from treeline.llm.syntax import asked_languages, of_stated_language, parses, plain_source, with_languages
from treeline.parsers.spans import spans

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: Prior of each label; least belief of a file that is sure alone; how far a compatibility may be from chance, and what is added to each count.
PRIOR = (0.80, 0.07, 0.04, 0.06, 0.03)
SURE = 0.95
MOST_RATIO = 6.0
SMOOTHING = 1.0
#: What a directory of a telling name says.
NAMED = 1.5

# Words of banners that tools write, in several languages.
_TOOL = re.compile(
    r"(?i)\bgenerated\b|produced automatically|machine[ -]?written|auto-?generated|(?:automatisch|maschinell) (?:erzeugt|erstellt|generiert)|wygenerowa|створено автоматично|згенеровано|создан\w* автоматически|сгенерирован|g[ée]n[ée]r[ée] (?:par|automatiquement)|generado (?:por|autom)|gerado (?:por|autom)|自动生成|自動生成"
)
_KEEP_OFF = re.compile(r"(?i)do not (?:edit|modify)|don't edit|edit the (?:template|source)|manual (?:edits|changes)|overwritten|will be lost|nicht von hand|nie zmieniaj|не редагуйте|не редактируйте|ne (?:pas|le) modifi|no (?:lo )?edit|não (?:o )?edite|请勿|編集しない|@generated")
_RELEASE = re.compile(r"\A\W*([A-Za-z][\w.-]*)\s+v?\d+\.\d+(?:\.\d+)?\b")
_LICENCE = re.compile(r"\b(?:MIT|BSD|Apache|ISC|GPL|LGPL|MPL)\b(?:-\d)?")
# Names of directories for third-party copies, and for what tools make.
_VENDOR_DIR = r"(?:^|/)(?:vendor|third[_-]?party|node_modules|ext|externals?|deps|bower_components|contrib)$"
_GEN_DIR = r"(?:^|/)(?:generated|gen|target)$"
_MIN_NAME = re.compile(r"[.\-](?:min|bundle|prod|packed)\.\w+$")
_GEN_NAME = re.compile(r"(?:\.pb|_pb2|\.gen|\.g|_generated|\.generated)\.\w+$")
_DATA_NAME = re.compile(r"_(?:table|data|blob|dump)\.\w+$")

_KEPT = frozenset("if for while return function def func int const class local let var try catch except raise throw import from use package static final export double void else in range then do print new".split())
_SHAPE = re.compile(r"[A-Za-z_$][\w$]*|\b\d[\w.]*|\s+")
_DEFINED = re.compile(r"\b(?:function|def|func|fn|fun|int|void|double|const|class|local|let|var)\s+\$?([A-Za-z_]\w+)|^\s*\$?([A-Za-z_]\w{3,})\s*:?=[^=]", re.M)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NUMBER = re.compile(r"\b\d[\w.]*")
_FRAME = frozenset(("", "{", "}", "end", "});", "};", ")", "]", "];", "else", "try:", "end,"))


def _shape(m: re.Match) -> str:
    w = m.group()
    if w.isspace():
        return ""
    return "0" if w[0].isdigit() else w if w in _KEPT else "i"


def features(text: str, lang: str) -> dict:
    """Measures of one text."""
    text = text.replace("\r\n", "\n")
    code: list[str] = []
    banner, literal, at, before = "", 0, 0, 0
    for kind, a, b in spans(text, lang):
        code.append(text[at:a])
        before += len(code[-1].strip()) if before < 40 else 0
        at = b
        if kind == "comment":
            if before < 40:
                banner += text[a:b] + "\n"
        else:
            body = text[a:b]
            if " " not in body.strip("\"'` "):
                literal += b - a
            code.append('"')
    code.append(text[at:])
    bare = "".join(code)
    ink = len("".join(bare.split()))
    numbers = sum(map(len, _NUMBER.findall(bare)))
    shapes = [s for line in bare.split("\n") if (x := line.strip()) not in _FRAME and (s := _SHAPE.sub(_shape, x))]
    top = Counter(shapes).most_common(1)[0][1] / len(shapes) if shapes else 0.0
    lines = bare.count("\n") + 1
    stems = Counter(tuple(x.lower() for x in _PARTS.findall(a or b)[:2]) for a, b in _DEFINED.findall(bare))
    defined = sum(stems.values())
    return {
        "ink": ink, "space": 1 - ink / max(1, len(bare)), "literal": (literal + numbers) / max(1, ink + literal), "shapes": len(shapes), "top": top,
        "distinct": len(set(shapes)) / max(1, len(shapes)), "long": len(text) / max(1, text.count("\n") + 1), "joins": (bare.count(";") + bare.count(",")) / lines, "banner": banner, "stem": stems.most_common(1)[0][1] / defined if defined >= 4 else 0.0,
    }


def evidence(text: str | None, lang: str, file: str) -> list[float]:
    """Log evidence of one file for each label."""
    hand = gen = small = vend = blob = 0.0
    if text:
        f = features(text, lang)
        dense = f["ink"] > 60 and (f["space"] < 0.10 and (f["long"] > 65 or f["joins"] > 4) or f["space"] < 0.14 and f["long"] > 150)
        if dense:
            small += 6
        elif f["space"] > 0.11:
            small -= 5
        if f["literal"] > 0.68 and not dense and f["ink"] > 20:
            blob += 6 if f["distinct"] < 0.6 or f["shapes"] < 12 or f["literal"] > 0.75 else 2
        else:
            blob -= 4
        # one line shape over and over, in a long file or under names of one stem
        alike = f["distinct"] <= 0.2 or f["distinct"] < 0.3 and f["shapes"] >= 30 or f["distinct"] < 0.5 and f["stem"] >= 0.8
        if f["shapes"] >= 8 and f["top"] >= 0.42 and alike and not dense and f["literal"] < 0.6:
            gen += 6
        elif not dense:
            gen -= 3
        banner = f["banner"]
        if banner:
            tool, off = bool(_TOOL.search(banner)), bool(_KEEP_OFF.search(banner))
            gen += 7.0 if tool and off else 6.0 if tool and re.search(r"@generated|(?i:code generated)", banner) else 2.5 if off else 0.5 if tool else 0
            for line in banner.split("\n"):
                bare = line.strip(" \t*/#!-;")
                m = _RELEASE.match(bare)
                if m:
                    vend += 5
                    name = m.group(1).lower()
                    if name in file.lower().split("/")[:-1] or name in file.lower().rsplit("/", 1)[-1]:
                        vend += 3
                    break
            if vend and _LICENCE.search(banner):
                vend += 2
        if not vend:
            vend -= 3
    if _MIN_NAME.search(file):
        small += 1.5
    if _GEN_NAME.search(file):
        gen += 1.5
    if _DATA_NAME.search(file):
        blob += 1.0
    return [math.log(p) + e for p, e in zip(PRIOR, (hand, gen, small, vend, blob))]


E = [f"e{k}" for k in range(len(LABELS))]
EVIDENCE_SCHEMA = "file_id long, repo string, dir string, ext string, lang string, at timestamp, digest long, valid boolean, " + ", ".join(f"{e} double" for e in E)


def _evidence(batches: Iterator[pd.DataFrame], relabelled: Bits | None) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for ident, repo, file, ext, at, digest, text, langs in asked_languages(pdf, relabelled, ["file_id", "repo", "file", "ext", "at", "digest", "source"]):
            for lang in langs:
                e = evidence(text, lang, file)
                # no directory can make more than this of a file; the others are surely handwritten
                ok = True if not text else parses(plain_source(text, file), lang) if e[0] <= max(e[1:]) + 2 * math.log(MOST_RATIO) else None
                rows.append((ident, repo, file.rpartition("/")[0], ext, lang, at, digest, ok, *e))
        yield pd.DataFrame(rows, columns=["file_id", "repo", "dir", "ext", "lang", "at", "digest", "valid", *E]).astype({"valid": object})


def file_evidence(files: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """(file_id, repo, dir, valid, e0 .. e4): one row per source file of a programming language."""
    path = F.replace(F.coalesce("file", F.lit("")), F.lit("\\"), F.lit("/"))
    rows, stated, shared = with_languages(files.withColumns({"repo": F.coalesce("repo", F.lit("")), "file": path}), results)
    each = rows.mapInPandas(lambda it: _evidence(it, shared.value), EVIDENCE_SCHEMA)
    last = each.groupBy("file_id", "lang").agg(F.max_by(F.struct("ext", "repo", "dir", "valid", *E), F.struct("at", "digest")).alias("x")).select("file_id", "lang", "x.*")
    return of_stated_language(last, stated).select("file_id", "repo", "dir", "valid", *E)


# compatibilities ------------------------------------------------------------------------------

Table = list[list[float]]
EVEN: Table = [[MOST_RATIO if a == b else 1.0 for b in range(len(LABELS))] for a in range(len(LABELS))]


def softmax(x: Column | str) -> Column:
    """Beliefs from log beliefs."""
    x = F.col(x) if isinstance(x, str) else x
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform(x, lambda v: F.exp(v - top) / total)


def ratios(counts: Table) -> Table:
    """How much likelier two labels stand together than by chance, within MOST_RATIO either way."""
    n = range(len(LABELS))
    c = [[counts[a][b] + SMOOTHING for b in n] for a in n]
    rows, cols = [sum(c[a]) for a in n], [sum(c[a][b] for a in n) for b in n]
    total = sum(rows)
    return [[min(MOST_RATIO, max(1 / MOST_RATIO, c[a][b] * total / (rows[a] * cols[b]))) for b in n] for a in n]


def _pairs(df: DataFrame, cell: Callable[[int, int], Column]) -> Table:
    """25 sums: one row comes to the driver."""
    n = range(len(LABELS))
    row = df.agg(*[F.coalesce(F.sum(cell(a, b)), F.lit(0.0)).alias(f"c{a}{b}") for a in n for b in n]).first()
    return [[float(row[f"c{a}{b}"]) for b in n] for a in n]


def compatibilities(local: DataFrame) -> tuple[Table, Table]:
    """(directory's label by file's, parent's by child's) from local(repo, dir, parent, n): how many files of each
    directory are sure alone, by label. A file's directory is known by its other files, each directory counts once."""
    size = F.aggregate("n", F.lit(0.0), lambda a, v: a + v)
    dirs = local.withColumn("size", size)
    file_table = _pairs(dirs.filter("size > 1"), lambda a, b: F.col("n")[a] * (F.col("n")[b] - (1 if a == b else 0)) / (F.col("size") * (F.col("size") - 1)))
    above = dirs.filter("size > 0").select("repo", F.col("dir").alias("parent"), F.col("n").alias("pn"), F.col("size").alias("ps"))
    below = dirs.filter("size > 0 and dir != ''").join(above, ["repo", "parent"])
    dir_table = _pairs(below, lambda a, b: F.col("pn")[a] * F.col("n")[b] / (F.col("ps") * F.col("size")))
    return ratios(file_table), ratios(dir_table)


def message(x: Column, table: Table, up: bool) -> Column:
    """Log message over a compatibility table (upper label by lower label), on arrays by label: to the upper
    end log(sum over lower labels of psi * exp(x)), or the other way round."""
    top = F.array_max(x)
    n = range(len(LABELS))
    p = F.transform(x, lambda v: F.exp(v - top))

    def cell(k: int) -> Column:
        out = F.lit(0.0)
        for j in n:
            out = out + F.lit(table[k][j] if up else table[j][k]) * p[j]
        return F.log(out) + top

    return F.array(*[cell(k) for k in n])


def summed(name: str) -> Column:
    """Sum of arrays, label by label."""
    return F.array(*[F.sum(F.col(name)[k]) for k in range(len(LABELS))])


def plus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _label(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.element_at(F.array(*[F.lit(la) for la in LABELS]), F.array_position(x, F.array_max(x)).cast("int"))


def _parent(d: str) -> Column:
    return F.when(F.contains(d, F.lit("/")), F.regexp_extract(d, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def propagate(evidence: DataFrame, tables: tuple[Table, Table] | None = None) -> DataFrame:
    """(file_id, label, confidence, alone, valid): every file's belief after exact sum-product, and its label without the tree.

    ``tables`` are the compatibilities of directories and files, and of parents and children; they are counted if not given."""
    zero = F.array(*[F.lit(0.0)] * len(LABELS))
    files = evidence.select("file_id", "repo", "dir", "valid", F.array(*E).alias("e"))
    if tables is None:
        sure = F.transform(softmax("e"), lambda p: F.when(p >= SURE, 1.0).otherwise(0.0))
        alone = cut(files.withColumn("sure", sure).groupBy("repo", "dir").agg(summed("sure").alias("n")).withColumn("parent", _parent("dir")))
        tables = compatibilities(alone)
    of_file, of_dir = tables
    files = files.withColumn("m", message(F.col("e"), of_file, True))
    local = cut(files.groupBy("repo", "dir").agg(summed("m").alias("s"), F.count("*").alias("n")))
    # directories without files of their own stand between others and the root
    parts = F.split("dir", "/")
    every = local.select("repo", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir")).distinct()
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    named = F.array(*[F.when(F.col("dir").rlike(rx), F.lit(NAMED)).otherwise(F.lit(0.0)) if rx else F.lit(0.0) for rx in (None, _GEN_DIR, None, _VENDOR_DIR, None)])
    dirs = cut(every.join(local, ["repo", "dir"], "left").select("repo", "dir", depth.alias("depth"), _parent("dir").alias("parent"), plus(F.coalesce("s", zero), named).alias("s"), "n"))
    deepest = dirs.agg(F.max("depth")).first()[0] or 0
    levels = {deepest: dirs.filter(F.col("depth") == deepest)}
    for d in range(deepest, 0, -1):  # up: what the children say is added to the parent
        sent = levels[d].select("repo", F.col("parent").alias("dir"), message(F.col("s"), of_dir, True).alias("m")).groupBy("repo", "dir").agg(summed("m").alias("m"))
        levels[d - 1] = cut(dirs.filter(F.col("depth") == d - 1).join(sent, ["repo", "dir"], "left").select("repo", "dir", "depth", "parent", plus("s", F.coalesce("m", zero)).alias("s"), "n"))
    beliefs = levels[0].select("repo", "dir", F.col("s").alias("b"), "n")
    out = beliefs
    for d in range(1, deepest + 1):  # down: the parent's belief without what this child said
        above = beliefs.select("repo", F.col("dir").alias("parent"), F.col("b").alias("p"))
        own = levels[d].select("repo", "dir", "parent", "s", "n", message(F.col("s"), of_dir, True).alias("m"))
        joined = own.join(above, ["repo", "parent"]).select("repo", "dir", "s", "n", minus("p", "m").alias("x"))
        beliefs = cut(joined.select("repo", "dir", plus("s", message(F.col("x"), of_dir, False)).alias("b"), "n"))
        out = out.unionByName(beliefs)
    most = local.agg((F.coalesce(F.sum("n"), F.lit(0)) / HOT_SHARE).alias("x")).first().x
    hot = local.filter(F.col("n") > most).select("repo", "dir")
    both = join_small(files, out.drop("n"), ["repo", "dir"], hot=hot).select("file_id", "valid", "e", minus("b", "m").alias("x"))
    final = both.select("file_id", "valid", "e", plus("e", message(F.col("x"), of_file, False)).alias("f"))
    return final.select("file_id", _label("f").alias("label"), F.array_max(softmax("f")).alias("confidence"), _label("e").alias("alone"), "valid")


def file_labels(files: DataFrame, results: DataFrame | None = None) -> DataFrame:
    return propagate(cut(file_evidence(files, results)))


def changes(labels: DataFrame) -> DataFrame:
    """(alone, label, files, findings): what the tree makes of what files are alone."""
    return labels.groupBy("alone", "label").agg(F.count("*").alias("files"), F.count_if(F.coalesce("valid", F.lit(False)) & (F.col("label") != "handwritten")).alias("findings"))


def not_handwritten(labels: DataFrame) -> DataFrame:
    """Valid files that nobody wrote by hand here."""
    return labels.filter("valid and label != 'handwritten'")
