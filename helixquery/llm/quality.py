"""Host-level quality rules.

Every document is measured by itself; per host (column `source`) the documents that fail each rule
are counted; a host's failure rate is shrunk towards the rate of all hosts with a beta prior that is
fitted to the hosts by the method of moments; the hosts' verdicts are joined back to the documents:

- a host whose shrunk rate of documents that fail any rule is over HOST_LIMIT is refused whole;
- elsewhere a document that fails a soft rule is refused, unless the host's shrunk rate of that rule
  says that the rule misfires there: TRUSTED failures or fewer per document.

Base rules (always refused): fewer than 50 words, or over half of the words inside repeated 3-word
windows. Soft rules: symbols, repeated lines, word length (see RULES).

Defined results: null text: no words, so refused; null host: one host of its own; repeated rows count
each; an empty table gives an empty result; columns with the names used here are kept out of the way
(only doc_id, text and source are read; `accepted` returns the columns it was given).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixquery.llm import scratch, text

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
HOST_LIMIT, TRUSTED = 0.7, 0.002
#: Hosts up to this number are broadcast (two short columns each); beyond it Spark chooses the join.
FEW_HOSTS = 100_000


def _measure(texts: pa.Array) -> list[np.ndarray]:
    texts = pc.fill_null(texts, "")
    flat, offsets = text.words(texts)
    n_words = np.diff(offsets)
    code, vocabulary = text.codes(flat)
    lengths = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    word_chars = text.per_row(lengths[code], offsets)
    symbols = pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)

    repeated = np.zeros(len(code), dtype=np.int64)
    row = text.rows_of(offsets)
    start = np.flatnonzero(row[2:] == row[:-2]) if len(code) > 2 else np.zeros(0, dtype=np.int64)
    if len(start):
        v = np.int64(len(vocabulary))
        pair = np.unique((row[start] * v + code[start]) * v + code[start + 1], return_inverse=True)[1]
        window = pair.astype(np.int64) * v + code[start + 2]
        by = np.argsort(window, kind="stable")
        same = window[by][1:] == window[by][:-1]
        again = np.zeros(len(start), dtype=bool)
        again[by[1:][same]] = True
        again[by[:-1][same]] = True
        for k in range(3):
            repeated[start[again] + k] = 1

    lines, line_offsets = text.flat_list(pc.split_pattern(texts, "\n"))
    line_code, distinct = text.codes(lines)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(distinct)), 0).to_numpy(zero_copy_only=False)
    keep = full[line_code]
    line_row = text.rows_of(line_offsets)[keep]
    n_lines = np.bincount(line_row, minlength=len(texts))
    distinct_in_row = np.unique(line_row * np.int64(max(1, len(distinct))) + line_code[keep])
    n_distinct = np.bincount(distinct_in_row // max(1, len(distinct)), minlength=len(texts))
    return [n_words, word_chars, symbols, n_lines - n_distinct, text.per_row(repeated, offsets)]


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in STATS]))
def measure(texts: pa.Array) -> pa.Array:
    text.lean()
    found = [_measure(texts.slice(a, b - a)) for a, b in text.steps(texts)]
    cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(len(STATS))]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in cols], STATS)


measure = measure.asNondeterministic()  # else Spark measures again wherever a measure is used


def base_failed(s: Column) -> Column:
    return (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)


#: Soft rules by name.
RULES = {
    "symbols": lambda s: 10 * s.n_symbols > s.n_words,
    "lines": lambda s: (s.n_dup_lines >= 5) & (20 * s.n_dup_lines > s.n_words),
    "length": lambda s: (s.word_chars < 2 * s.n_words) | (s.word_chars > 15 * s.n_words),
}


def shrunk(fails: Column, n: Column, a: float, b: float) -> Column:
    return (fails + a) / (n + a + b)


def beta_prior(hosts: DataFrame, fails: str) -> tuple[float, float]:
    """Moments of the hosts' rates as a beta distribution; the mean as one pseudo-document where hosts don't differ."""
    rate = F.col(fails) / F.col("n_docs")
    r = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("inv")).first()
    m = r.m if r.m is not None else 0.0
    if m <= 0 or m >= 1:
        return 0.5 + m * 0.5, 1.0 - m * 0.5
    between = (r.v or 0.0) - m * (1 - m) * r.inv  # without the part that counting alone makes
    strength = m * (1 - m) / between - 1 if between > 0 else 1000.0
    strength = min(max(strength, 1.0), 1000.0)
    return m * strength, (1 - m) * strength


def host_verdicts(measured: DataFrame) -> DataFrame:
    """Per host: refused, and per soft rule whether it is trusted to misfire. measured: columns host and s."""
    s = F.col("s")
    any_failed = base_failed(s)
    for rule in RULES.values():
        any_failed = any_failed | rule(s)
    counts = [F.count_if(any_failed).alias("f_any"), *(F.count_if(rule(s)).alias(f"f_{k}") for k, rule in RULES.items())]
    with scratch.small_batches(measured.sparkSession):
        hosts = scratch.written(measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *counts), "hosts")
    rate = {k: shrunk(F.col(f"f_{k}"), F.col("n_docs"), *beta_prior(hosts, f"f_{k}")) for k in ("any", *RULES)}
    out = hosts.select("host", rate["any"].alias("host_rate"), (rate["any"] > HOST_LIMIT).alias("host_refused"), *((rate[k] <= TRUSTED).alias(f"t_{k}") for k in RULES))
    return F.broadcast(out) if hosts.count() <= FEW_HOSTS else out


def judged(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """rows (host and s among their columns) with base_failed, host_rate and kept."""
    s = F.col("s")
    soft = F.lit(False)
    for k, rule in RULES.items():
        soft = soft | (rule(s) & ~F.col(f"t_{k}"))
    hosts = hosts.withColumnRenamed("host", "host_of")
    out = rows.join(hosts, F.col("host").eqNullSafe(F.col("host_of")), "left")
    return out.withColumn("base_failed", base_failed(s)).withColumn("kept", ~(F.col("base_failed") | F.col("host_refused") | soft))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, kept, host and its shrunk failure rate."""
    rows = scratch.written(docs.select("doc_id", F.col("source").alias("host"), measure("text").alias("s")), "quality")
    out = judged(rows, host_verdicts(rows))
    return out.select("doc_id", *(F.col(f"s.{x}") for x in STATS), "base_failed", "kept", "host", F.round("host_rate", 9).alias("host_rate"))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns.

    The hosts' rates need a pass of their own; the second pass measures again instead of writing all texts.
    """
    hosts = host_verdicts(docs.select(F.col("source").alias("host"), measure("text").alias("s")))
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    rows = packed.select("doc", F.col("doc.source").alias("host"), measure("doc.text").alias("s"))
    return judged(rows, hosts).where("kept").select("doc.*")
