"""Quality rules with host-level verdicts.

Per document, rule counts come from one vectorised pass over the text. Failures are then aggregated by host; a host's
failure rate is shrunk towards the mean of all hosts with an empirical beta prior, and the host's verdict is joined back.
A host above the threshold is *strict*: its documents must pass the soft rules too. A document that passes all rules is kept
wherever it comes from.

The prior is fitted by moments, as beta-binomial: the spread of the hosts' rates around the mean m, weighted by documents,
is what binomial sampling alone would give plus what the hosts differ by; the share r of the latter gives a prior weight
of 1 / r - 1 documents. Where the spread is no more than sampling explains (r <= 0, and so for one host), every host takes
the mean; where hosts fail wholly or not at all (r >= 1), each takes its own rate.

Defined cases: a null text counts as empty (no words, so it fails); a null host is a host of its own; repeated rows are
judged row by row; an empty table gives an empty result. Kept columns that have the name of a measure give way to it; the
pipeline's stage returns all columns as they came.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .bytesplit import Words, covered, found_twice, mixed, rolling, seen_before, steps, table_of, whole
from .carry import ROW, measured, opened, quoted
from .scratch import staged

SYMBOL = table_of(lambda b: chr(b) in "#*$%&|<>")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def rule_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for each text of an Arrow column."""
    out: dict[str, list[np.ndarray]] = {k: [np.zeros(0, np.int64)] for k in COUNTS}
    for _, _, data, off in steps(texts):
        w, n = Words(data, off), len(off) - 1
        total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[off])  # noqa: B023, E731
        salt = mixed(np.arange(1, n + 1, dtype=np.uint64))
        newline = np.flatnonzero(data == 10)
        start, end = np.sort(np.concatenate([off[:-1], newline + 1])), np.sort(np.concatenate([newline, off[1:]]))
        in_line = np.concatenate([[0], np.cumsum(w.inside, dtype=np.int64)])
        worded = in_line[end] > in_line[start]
        line_doc = np.repeat(np.arange(n), total(data == 10) + 1)
        doc, key = line_doc[worded], w.span_hash(start[worded], end[worded])
        twice = seen_before(mixed(key ^ salt[doc]))
        three, word_doc = rolling(w.hashes(), 3), w.doc()
        ok = whole(w.off, 3, len(word_doc))
        hit = np.zeros(len(word_doc), bool)
        hit[np.flatnonzero(ok)] = found_twice(mixed(three[ok] ^ salt[word_doc[: len(ok)][ok]]))
        for k, v in (
            ("n_words", w.counts), ("word_chars", total(w.inside & ((data & 0xC0) != 0x80))), ("n_symbols", total(SYMBOL[data])),
            ("n_dup_lines", np.bincount(doc[twice], minlength=n)), ("n_repeat_words", np.bincount(word_doc[covered(hit, 3, len(word_doc))], minlength=n)),
            ("n_lines", np.bincount(doc, minlength=n)),
        ):
            out[k].append(np.asarray(v, np.int64))
    return {k: np.concatenate(v) for k, v in out.items()}


def _counted(docs: DataFrame, text_col: str, keep: list[str], host_col: str | None = None) -> DataFrame:
    """``_row`` and the counts (and ``_host``)."""

    def count(texts: pa.Array, more: dict[str, pa.Array]) -> list[pa.Array]:
        found = rule_counts(texts)
        return [pa.array(found[c]) for c in COUNTS] + ([more["host"]] if more else [])

    fields = [StructField(c, LongType()) for c in COUNTS]
    more = {}
    if host_col is not None:
        more = {"host": quoted(host_col)}
        fields.append(StructField("_host", docs.schema[host_col].dataType))
    return measured(docs, text_col, fields, count, keep, more)


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and the counts."""
    keep = docs.columns if keep is None else keep
    return opened(_counted(docs, text_col, keep), keep, list(COUNTS))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failed():
    """Looser signs of junk: many symbols, a third of the lines repeated, very short or long words."""
    return (
        (10 * F.col("n_symbols") > F.col("word_chars"))
        | (3 * F.col("n_dup_lines") > F.col("n_lines"))
        | (F.col("word_chars") > 15 * F.col("n_words"))
        | (5 * F.col("n_repeat_words") > F.col("n_words"))
    )


def host_verdicts(flags: DataFrame, host_col: str, failed: str, max_rate: float) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, strict. The prior is a few sums over hosts, whatever the input."""
    hosts = flags.groupBy(host_col).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    f, n = F.col("n_failed"), F.col("n_docs")
    sums = hosts.agg(F.sum(f).alias("f"), F.sum(n).alias("n"), F.sum(f * f / n).alias("f2"), F.sum(n * n).alias("n2"), F.count(F.lit(1)).alias("h"))
    mean = F.col("f") / F.col("n")
    spread = F.col("f2") - F.col("f") * mean  # sum of n (rate - mean)^2
    chance, reach = F.col("h") - 1, F.col("n") - F.col("n2") / F.col("n") - (F.col("h") - 1)
    share = F.when((mean > 0) & (mean < 1) & (reach > 0), (spread / (mean * (1 - mean)) - chance) / reach).otherwise(0.0)
    prior = sums.select(mean.alias("prior_mean"), F.least(share, F.lit(1.0)).alias("prior_share"))
    weight = 1 / F.col("prior_share") - 1
    shrunk = F.when(F.col("prior_share") > 1e-12, (f + F.col("prior_mean") * weight) / (n + weight)).otherwise(F.col("prior_mean"))
    return hosts.crossJoin(F.broadcast(prior)).select(host_col, "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_strict"))  # the prior is one row


def _judged(docs: DataFrame, host_col: str, text_col: str, keep: list[str], max_rate: float) -> DataFrame:
    own = _counted(docs, text_col, keep, host_col).withColumns({"base_failed": base_failed(), "soft_failed": soft_failed()})
    own = staged(own.withColumn("_any", F.col("base_failed") | F.col("soft_failed")), "quality")
    verdict = host_verdicts(own, "_host", "_any", max_rate).select(F.col("_host").alias("_h"), "host_rate", "host_strict")
    verdict = staged(verdict, "hosts")  # its size is then known: few hosts are broadcast, many are joined by a shuffle
    kept = ~F.col("base_failed") & ~(F.col("host_strict") & F.col("soft_failed"))
    return own.join(verdict, F.col("_host").eqNullSafe(F.col("_h"))).withColumn("kept", kept)


def judged(docs: DataFrame, host_col: str = "source", text_col: str = "text", keep: list[str] | None = None, max_rate: float = 0.3) -> DataFrame:
    """``keep`` columns, counts, base_failed, soft_failed, host_rate and kept, one row per input row."""
    keep = docs.columns if keep is None else keep
    return opened(_judged(docs, host_col, text_col, keep, max_rate), keep, [*COUNTS, "base_failed", "soft_failed", "host_rate", "kept"])


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judged(docs, keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


QUALITY_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
x AS (SELECT doc_id, unnest(range(len(w) - 2)) AS p, w FROM w WHERE len(w) >= 3),
k AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p + 1], w[p + 2], w[p + 3]) AS n FROM x),
r AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS i FROM k WHERE n > 1) GROUP BY doc_id),
c AS (SELECT d.doc_id, d.source, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l.l)::BIGINT AS n_lines,
        (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (doc_id) JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        10 * n_symbols > word_chars OR 3 * n_dup_lines > n_lines OR word_chars > 15 * n_words OR 5 * n_repeat_words > n_words AS soft FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft) AS f FROM f GROUP BY source),
s AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) - sum(f) * sum(f) / sum(n) AS v, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS reach, count(*) - 1 AS chance FROM h),
q AS (SELECT m, least(1.0, CASE WHEN m > 0 AND m < 1 AND reach > 0 THEN (v / (m * (1 - m)) - chance) / reach ELSE 0 END) AS share FROM s),
g AS (SELECT source, CASE WHEN share > 1e-12 THEN (f + m * (1 / share - 1)) / (n + 1 / share - 1) ELSE m END AS rate FROM h, q)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (rate > 0.3 AND soft) AS kept, round(rate, 9) AS host_rate
FROM f JOIN g ON f.source IS NOT DISTINCT FROM g.source
"""


def quality_stage(spark, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """The documents kept, in their own columns."""
    return _judged(docs, "source", "text", docs.columns, 0.3).filter("kept").select(f"{ROW}.*")
