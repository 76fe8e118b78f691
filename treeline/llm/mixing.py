"""Mixing sources to target weights with dependent rounding.

Every source gets an expected number of copies per document, the same for all of its
documents, so that token totals stand in the target ratio and no document exceeds its
source's cap. The whole part is certain; fractional parts are rounded by the pivotal
method: two documents pass probability to each other until one of them is decided, and so
on, which keeps the sum of the probabilities (hence the source's amount) and every
document's own probability. Neighbours in size are paired, so token totals hold too.
Chunks of a source are rounded on their own; the one open document that each leaves
goes up a reduction tree until one is left per source.

Sources may be any number: their plan is a table, made by sums over them, and one number a step
comes to the driver.

Defined results: source names are compared in lower case with '-' and blanks as '_';
documents of other or null sources, with null ids or without tokens get no copies; a source
without documents gets nothing and the others keep their mutual ratio; a target share or
cap that is null or not positive wants nothing; of targets of one name the shares add up and the
least cap holds; an empty table gives an empty mix.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.cluster import cut, join_small

#: Where the public tokenizers' vocabularies are, which one counts, and how many documents a chunk holds.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK_DOCS = 20_000
FAN_IN = 64
EPS = 1e-9

# Fixed value: the split pattern that belongs to the byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, object] = {}


def encoder(path: str):  # noqa: ANN201
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("mixing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def source_name(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")


def _count(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    enc = encoder(path)
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})


def token_sizes(documents: DataFrame, wanted: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of the documents of the wanted sources."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), F.col("text").cast("string").alias("text"))
    rows = join_small(rows.filter("doc_id is not null and source is not null"), wanted.select("source"), ["source"], "left_semi")
    return rows.mapInPandas(lambda it: _count(it, f"{tokenizer_dir}/{vocabulary}"), "doc_id long, source string, tokens long")


def read_targets(targets: DataFrame) -> DataFrame:
    """(source, share, cap) of the wanted sources, each once."""
    rows = targets.select(source_name(F.col("source")).alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)).alias("cap")).filter("source is not null")
    return rows.groupBy("source").agg(F.sum(F.greatest("share", F.lit(0.0))).alias("share"), F.min("cap").alias("cap"))


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, copies) expected per document, of the sources that get any, from sizes(source, tokens) and targets(source, share, cap).

    Without ``total`` the mix is as large as exact shares allow. With a larger total the
    sources that hit their cap stay there and the rest is shared by the others."""
    open_ = cut(targets.join(sizes.select("source", "tokens"), "source").filter("tokens > 0 and share > 0 and cap > 0"))
    most = F.col("tokens") * F.col("cap")
    if total is None:
        total = open_.agg(F.min(most / F.col("share")).alias("level"), F.sum("share").alias("weight")).select(F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0)).alias("t")).first().t
    left, done = float(total), open_.limit(0).select("source", F.lit(0.0).alias("copies"))
    while True:
        weight = open_.agg(F.sum("share").alias("w")).first().w
        if not weight:
            return done
        full = left / weight * F.col("share") > most * (1 + EPS)
        held = open_.filter(full).agg(F.sum(most).alias("t")).first().t
        if held is None:
            return done.unionByName(open_.select("source", F.least(F.col("cap").cast("double"), left / weight * F.col("share") / F.col("tokens")).alias("copies")))
        done = cut(done.unionByName(open_.filter(full).select("source", F.col("cap").cast("double").alias("copies"))))
        open_, left = cut(open_.filter(~full)), left - float(held)


def pivotal(p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """(rounded values, index of the one that is still open or -1).

    Values in order of size: the open one meets the next until one of the two is decided."""
    p = p.astype(float).copy()
    open_ = -1
    u = rng.random(len(p))
    for k in range(len(p)):
        if p[k] < EPS or p[k] > 1 - EPS:
            p[k] = round(p[k])
            continue
        if open_ < 0:
            open_ = k
            continue
        a, b = p[open_], p[k]
        if a + b <= 1:  # one of the two gives everything to the other
            keep = u[k] < b / (a + b)
            p[open_], p[k] = (0.0, a + b) if keep else (a + b, 0.0)
        else:  # one of the two is filled up
            fill = u[k] < (1 - a) / (2 - a - b)
            p[open_], p[k] = (a + b - 1, 1.0) if fill else (1.0, a + b - 1)
        still = [i for i in (open_, k) if EPS <= p[i] <= 1 - EPS]
        for i in (open_, k):
            if i not in still:
                p[i] = round(p[i])
        open_ = still[0] if still else -1
    return p, open_


_SCHEMA = "source string, node long, doc_id long, tokens long, whole int, p double, open boolean"


def _round(seed: int, level: int):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"]).reset_index(drop=True)
        key = int(pd.util.hash_array(np.array([pdf["source"].iloc[0]], dtype=object))[0])
        rng = np.random.default_rng([seed, level, int(pdf["node"].iloc[0]), key])
        p, open_ = pivotal(pdf["p"].to_numpy(), rng)
        pdf["p"] = p
        pdf["open"] = np.arange(len(pdf)) == open_
        return pdf

    return run


def mix(sized: DataFrame, planned: DataFrame, seed: int = 7, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """(doc_id, source, tokens, copies) of every document of sized(doc_id, source, tokens), by planned(source, copies, docs)."""
    of = cut(planned.select("source", F.col("copies").alias("x"), F.greatest(F.lit(1.0), F.ceil(F.col("docs") / chunk_docs)).cast("long").alias("chunks")))
    rows = join_small(sized, of, ["source"], "left")
    rest = rows.filter("tokens <= 0 or x is null").select("doc_id", "source", "tokens", F.lit(0).alias("copies"))
    whole = F.floor(F.col("x") + EPS)
    rows = rows.filter("tokens > 0 and x is not null").select(
        "source", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).alias("node"), "doc_id", "tokens", whole.cast("int").alias("whole"), F.greatest(F.lit(0.0), F.col("x") - whole).alias("p"), F.lit(False).alias("open")
    )
    done = []
    level, width = 0, of.agg(F.max("chunks").alias("n")).first().n or 1
    while True:
        rounded = cut(rows.groupBy("source", "node").applyInPandas(_round(seed, level), _SCHEMA))
        done.append(rounded.filter("not open"))
        rows = rounded.filter("open").withColumn("node", F.floor(F.col("node") / FAN_IN))
        if width == 1:
            break
        width, level = math.ceil(width / FAN_IN), level + 1
    # one open document a source is left: a last draw by its own probability
    last = rows.withColumn("p", (F.pmod(F.xxhash64("source", "doc_id", F.lit(seed)), F.lit(1_000_000)) < F.col("p") * 1_000_000).cast("double"))
    out = last
    for d in done:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "tokens", (F.col("whole") + F.round("p").cast("int")).alias("copies")).unionByName(rest)


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, tokens, copies) of every document of a wanted source."""
    wanted = cut(read_targets(targets))
    sized = cut(token_sizes(documents, wanted, tokenizer_dir))
    held = cut(sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))  # one row a source
    return mix(sized, plan(held, wanted, total).join(held, "source"))


def shares(chosen: DataFrame, targets: DataFrame, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """(source, target_share, docs, tokens, used_docs, mixed_tokens, most_copies, actual_share, wanted_share, share_error, error_bound): one row per wanted source.

    ``wanted_share`` is the target among the sources that got anything, ``share_error`` how far the actual share is
    from it. Rounding moves a source's tokens by less than two of its longest document a chunk (the open one and the
    one it meets), and the total by the sum of that: ``error_bound``, where no total was asked for."""
    per = chosen.groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.count_if(F.col("copies") > 0).alias("used_docs"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"),
        F.max("tokens").alias("_longest"),
    )
    out = read_targets(targets).select("source", F.col("share").alias("target_share")).join(per, "source", "left").fillna(0, ["docs", "tokens", "used_docs", "mixed_tokens", "most_copies", "_longest"])
    moved = 2 * F.col("_longest") * (1 + F.ceil(F.col("docs") / chunk_docs))
    out = cut(out.withColumn("_moved", F.when(F.col("mixed_tokens") > 0, moved).otherwise(F.lit(0))))
    total = out.agg(F.sum("mixed_tokens").alias("_all"), F.sum(F.when(F.col("mixed_tokens") > 0, F.col("target_share"))).alias("_live"), F.sum("_moved").alias("_any"))
    part = lambda a, b: F.when(F.col(b) > 0, a / F.col(b)).otherwise(0.0)
    wanted = part(F.when(F.col("mixed_tokens") > 0, F.col("target_share")).otherwise(0.0), "_live")
    out = out.join(F.broadcast(total)).withColumn("actual_share", part(F.col("mixed_tokens"), "_all")).withColumn("wanted_share", wanted)
    return out.withColumn("share_error", F.abs(F.col("actual_share") - F.col("wanted_share"))).withColumn("error_bound", part(F.col("_moved") + F.col("wanted_share") * F.col("_any"), "_all")).drop("_all", "_live", "_any", "_moved", "_longest")
