"""Host-level quality rules.

Each document gets counts over its whole text and the rules it fails. Failures are summed by host, each rule's rate per
host is shrunk towards the corpus with a beta prior fitted to the hosts themselves, and a host with a shrunk rate above
the limit loses all its documents. Only one row per rule (the prior) reaches the driver.

Null and empty texts have no words and fail the `short` rule. A null host is a host of its own. Repeated rows count each.
An empty table gives an empty result; columns of the input beyond id, text and host are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.columns import SPACE, let, words_of
from tagloom.llm.registry import query, table
from tagloom.session import cut_lineage

WINDOW = 5
MAX_HOST_RATE = 0.5
# Bounds of the prior's weight in documents: hosts that differ by chance alone give no finite weight.
PRIOR_WEIGHT = (2.0, 1e6)
SYMBOLS = "[#*$%&|<>]"


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of `size` words that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hash. Only texts with a repeated window sort their windows."""

    def covered(marks: Column) -> Column:
        gaps = F.transform(marks, lambda p, j: F.least(F.lit(size), F.coalesce(F.get(marks, j + 1) - p, F.lit(size))))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    def marked(rows: Column) -> Column:
        twin = lambda row, j: (F.get(rows, j - 1)["h"] == row["h"]) | F.coalesce(F.get(rows, j + 1)["h"] == row["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(rows, twin), lambda row: row["at"]))

    def count(hashes: Column) -> Column:
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(rows, lambda r: let(marked(r), covered)))

    window = lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, size)))
    starts = F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(0)))
    return let(F.transform(starts, window), count)


def text_counts(text: Column) -> Column:
    """Struct of the base counts, all long."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))

    def counts(words: Column, kept_lines: Column) -> Column:
        fields = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.length(full) - F.length(F.regexp_replace(full, SYMBOLS, "")),
            "n_lines": F.size(kept_lines),
            "n_dup_lines": F.size(kept_lines) - F.size(F.array_distinct(kept_lines)),
            "n_repeat_words": repeated_words(words),
        }
        return F.struct(*(value.cast("long").alias(name) for name, value in fields.items()))

    return let(words_of(text), lambda words: let(lines, lambda kept_lines: counts(words, kept_lines)))


# Rules that fail a document by themselves.
BASE_RULES = {
    "short": "n_words < 10",
    "repetitive": "n_repeat_words * 100 > n_words * 20",
}
# Rules that only speak about a host.
HOST_RULES = {
    "symbols": "n_symbols * 10 > word_chars",
    "dup_lines": "n_dup_lines * 10 > n_lines * 3",
}


def document_failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: Column | str = "source") -> DataFrame:
    """doc_id, host, the counts and one boolean per rule."""
    host = F.col(host) if isinstance(host, str) else host
    counted = docs.select(F.col(doc_id).alias("doc_id"), host.alias("host"), text_counts(F.col(text)).alias("c")).select("doc_id", "host", "c.*")
    return counted.select("*", *(F.expr(rule).alias(f"fails_{name}") for name, rule in (BASE_RULES | HOST_RULES).items()))


def host_verdicts(failures: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n_docs, failures and shrunk rate per rule, and `host_rejected`.

    The prior of a rule has the corpus rate as its mean; its weight follows from the variance of the hosts' rates beyond
    what their sizes explain."""
    rules = [c for c in failures.columns if c.startswith("fails_")]
    hosts = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(F.col(r).cast("long")).alias(r) for r in rules))
    hosts = cut_lineage(hosts, "host-failures")
    means = hosts.agg(*((F.sum(r) / F.sum("n_docs")).alias(r) for r in rules)).first()
    spread = hosts.agg(
        *(F.avg(F.pow(F.col(r) / F.col("n_docs") - F.lit(means[r]), 2) - F.lit(means[r]) * (1 - F.lit(means[r])) / F.col("n_docs")).alias(r) for r in rules)
    ).first()
    low, high = PRIOR_WEIGHT
    out, rejected = hosts, F.lit(False)
    for r in rules:
        mean, extra = means[r] or 0.0, spread[r] or 0.0
        weight = min(max(mean * (1 - mean) / extra - 1, low), high) if extra > 0 else high
        rate = (F.col(r) + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
        out = out.withColumn(r.replace("fails_", "rate_"), rate)
        rejected = rejected | (rate > max_rate)
    return out.withColumn("host_rejected", rejected)


def judged(failures: DataFrame, hosts: DataFrame) -> DataFrame:
    """Host verdicts joined back: base_failed and kept per document."""
    verdicts = hosts.select(F.col("host").alias("verdict_host"), "host_rejected")
    base = F.col("fails_short") | F.col("fails_repetitive")
    return (
        failures.join(verdicts, F.col("host").eqNullSafe(F.col("verdict_host")))
        .drop("verdict_host")
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & ~F.col("host_rejected"))
    )


_SQL = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), g AS (
  SELECT doc_id, p, array_to_string(words[p:p + 4], ' ') AS gram FROM (
    SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS p FROM w
  )
), r AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM r) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, [n_words < 10, n_repeat_words * 100 > n_words * 20, n_symbols * 10 > word_chars, n_dup_lines * 10 > n_lines * 3] AS fails FROM c
), long AS (
  SELECT source, k, count(*) AS n, count(*) FILTER (fails[k]) AS bad FROM f, (SELECT unnest([1, 2, 3, 4]) AS k) GROUP BY ALL
), m AS (
  SELECT k, sum(bad) / sum(n) AS mean FROM long GROUP BY k
), v AS (
  SELECT k, any_value(mean) AS mean, avg(pow(bad / n - mean, 2) - mean * (1 - mean) / n) AS extra FROM long JOIN m USING (k) GROUP BY k
), prior AS (
  SELECT k, mean, CASE WHEN extra > 0 THEN least(greatest(mean * (1 - mean) / extra - 1, 2.0), 1e6) ELSE 1e6 END AS weight FROM v
), hosts AS (
  SELECT source, bool_or((bad + mean * weight) / (n + weight) > 0.5) AS rejected FROM long JOIN prior USING (k) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails[1] OR fails[2] AS base_failed,
       NOT (fails[1] OR fails[2]) AND NOT rejected AS kept
FROM f JOIN hosts ON f.source IS NOT DISTINCT FROM hosts.source
"""


@query("op3_host_rules", _SQL)
def host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = cut_lineage(document_failures(table(spark, sf_dir, "documents")), "rule-failures")
    return judged(failures, host_verdicts(failures)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
