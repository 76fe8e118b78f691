"""Queries of the llm operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.cluster import table
from treeline.llm import credentials, doc_language, hidden_text, labels, leaks, mixing, provenance, shared_spans, syntax


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_verdicts(table(spark, d, "source_files"), table(spark, d, "file_results"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).filter(~F.col("valid")).select("file_id")


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_rates(_verdicts(spark, d))


def _encoders(spark: SparkSession, d: str) -> hidden_text.Encoders:
    return hidden_text.fit(labels.labelled_sample(table(spark, d, "documents")), code=labels.code_sample(table(spark, d, "source_files")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    enc = _encoders(spark, d)
    source = hidden_text.source_text(table(spark, d, "source_files"), enc).withColumn("origin", F.lit("source"))
    message = hidden_text.message_text(table(spark, d, "findings"), enc).withColumn("origin", F.lit("message"))
    return source.unionByName(message).select("origin", "record_id", "line", "lang")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return hidden_text.language_shares(hidden_text.source_text(table(spark, d, "source_files"), _encoders(spark, d))).withColumnRenamed("record_id", "file_id")


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    return provenance.file_labels(table(spark, d, "source_files"), table(spark, d, "file_results"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(p2_labels(spark, d)).select("file_id")


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    return provenance.changes(p2_labels(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    source = credentials.credential_lines(table(spark, d, "source_files"), "file_id", "source", "file").withColumn("origin", F.lit("source"))
    message = credentials.credential_lines(table(spark, d, "findings"), "finding_id", "message").withColumn("origin", F.lit("message"))
    return source.unionByName(message).select("origin", "record_id", "line")


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Files and messages that held credentials, with the redacted text."""
    source = credentials.redacted_texts(table(spark, d, "source_files"), "file_id", "source", "file", True).withColumn("origin", F.lit("source"))
    message = credentials.redacted_texts(table(spark, d, "findings"), "finding_id", "message", only_changed=True).withColumn("origin", F.lit("message"))
    return source.unionByName(message).select("origin", "record_id", "text", "redacted")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.line_rows(shared_spans.shared_lines(table(spark, d, "duplicate_facts")))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shares(table(spark, d, "duplicate_facts"))


def p6_components(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.file_components(table(spark, d, "duplicate_facts"))


def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.band_recall(table(spark, d, "duplicate_facts"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.item_report(p8_found(spark, d))


def p8_reworded(spark: SparkSession, d: str) -> DataFrame:
    return leaks.reworded_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_copies(spark, d), table(spark, d, "mix_targets"))


def _prose(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    documents = table(spark, d, "documents")
    return doc_language.prose_languages(documents, doc_language.fit(labels.labelled_sample(documents)), every)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return doc_language.wrong_lines(_prose(spark, d))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    return doc_language.document_languages(_prose(spark, d, every=True))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return doc_language.segments(_prose(spark, d))


_ALL = (
    p1_found, p1_shares, p2_found, p2_labels, p2_changes, p3_found, p3_redacted, p6_found, p6_shares, p6_components, p6_recall, p7_found, p7_rates,
    p8_found, p8_items, p8_reworded, p9_copies, p9_shares, p10_found, p10_documents, p10_segments,
)
QUERIES = {f.__name__: f for f in _ALL}

_P6 = """
WITH f AS (SELECT file_id, min_lines, lines, hashes FROM duplicate_facts
           WHERE file_id IS NOT NULL AND hashes IS NOT NULL AND lines IS NOT NULL AND min_lines > 0),
one AS (SELECT DISTINCT ON (file_id) * FROM f),
w AS (SELECT file_id, unnest(hashes) AS h, unnest(range(len(hashes))) AS pos FROM one),
b AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT file_id) > 1),
s AS (SELECT w.file_id, pos FROM w JOIN b USING (h)),
l AS (SELECT DISTINCT s.file_id, lines[pos + 1 + k] AS line FROM s JOIN one USING (file_id), LATERAL (SELECT unnest(range(min_lines)) AS k) WHERE lines[pos + 1 + k] IS NOT NULL)
"""
_P8 = r"""
WITH t AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM eval_items),
w AS (SELECT side, id, regexp_extract_all(lower(regexp_replace(nfc_normalize(regexp_replace(text,
        '[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{206a}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}]', '', 'g')),
        '(?m)^[ \t>*#/-]*\d{1,3}[.)][ \t]+', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM t WHERE id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT side, id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT side, id, w, unnest(range(1, len(w) - 10)) AS k FROM w WHERE len(w) >= 12)),
f AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.g = i.g AND d.side = 0 AND i.side = 1)
"""
SQL = {
    "p8_found": _P8 + "SELECT doc_id, item_id FROM f",
    "p8_items": _P8 + "SELECT item_id, count(*) AS documents FROM f GROUP BY 1",
    "p6_found": _P6 + "SELECT file_id, line FROM l",
    "p6_components": _P6.replace("WITH f", "WITH RECURSIVE f")
    + """, e AS (SELECT DISTINCT w.file_id AS a, min(w.file_id) OVER (PARTITION BY h) AS b FROM w JOIN b USING (h)), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      r AS (SELECT a AS file_id, a AS c FROM g UNION SELECT r.file_id, g.b FROM r JOIN g ON r.c = g.a) SELECT file_id, min(c) AS component FROM r GROUP BY 1""",
    "p6_shares": _P6
    + """SELECT file_id, max(len(lines)) AS code_lines, coalesce(max(n), 0) AS shared_lines, CASE WHEN max(len(lines)) > 0 THEN coalesce(max(n), 0) / max(len(lines)) ELSE 0.0 END AS share
      FROM (SELECT file_id, lines FROM duplicate_facts WHERE file_id IS NOT NULL AND lines IS NOT NULL) LEFT JOIN (SELECT file_id, count(*) AS n FROM l GROUP BY 1) USING (file_id) GROUP BY 1""",
}
