"""Exact substring search over a table of texts, one row per file or record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixquery.operators.kmers import once

#: Bytes of a gram, and places of a text that one row explodes into.
GRAM, PLACES = 8, 8192
#: Bytes of indexed patterns that are broadcast to the places; beyond it they are joined.
FEW_BYTES = 32 << 20


def quoted(pattern: Column) -> Column:
    """The pattern as a regular expression that matches it alone."""
    return F.regexp_replace(pattern, r"([\\.\[\]{}()*+?^$|\-&~#])", r"\\$1")


def clean_query(q: Column) -> Column:
    """A typed query: bases only, upper case; null below four bases."""
    bases = F.regexp_replace(F.upper(q), "[^ACGT]", "")
    return F.when(F.length(bases) >= 4, bases)


def hits(docs: DataFrame, id_col: str, text: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """id_col, pattern, offset (bytes from 0) of all occurrences, overlapping ones too.

    A text is looked at every `step` bytes only: of patterns with `least` bytes or more, every occurrence covers a whole gram
    that begins at one of these places, if all grams in a pattern's first `step` places are indexed. Places meet the index in an
    equi-join on the gram, and the whole pattern is compared then. Patterns go by bands of like length, so that short ones
    don't make the grid finer for long ones. Null and empty texts and patterns have no occurrences.
    """
    size = F.octet_length("pattern")
    wanted = patterns.select(F.col(pattern).alias("pattern")).where(size > 0).distinct().withColumn("band", F.floor(F.log2(size)).cast("int"))
    bands = wanted.groupBy("band").agg(F.min(size).alias("least"), F.max(size).alias("most"), F.count(F.lit(1)).alias("n")).orderBy("band").collect()  # 31 at most
    texts = docs.select(F.col(id_col).alias("id"), once(F.col(text).cast("binary")).alias("bytes"))
    out = texts.select("id", F.lit("").alias("pattern"), F.lit(0).cast("long").alias("offset")).where(F.lit(False))
    for b in bands:
        out = out.unionByName(_band_hits(texts, wanted.where(F.col("band") == b["band"]), b["least"], b["most"], b["n"]))
    return out.select(F.col("id").alias(id_col), "pattern", "offset")


def _gram(n: int, least: int) -> int:
    """Bytes of a gram for n patterns of `least` bytes or more: so many that a place of a text of four letters meets few of
    their grams by chance, however many patterns there are."""
    gram = min(GRAM, least)
    while gram < least and 4 * n * (least - gram + 1) > 4**gram and gram >= GRAM:
        gram += 1
    return gram


def _band_hits(texts: DataFrame, wanted: DataFrame, least: int, most: int, n: int) -> DataFrame:
    gram = _gram(n, least)
    step = least - gram + 1
    index = wanted.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(step - 1))).alias("shift"))
    index = index.withColumn("gram", F.substr(F.col("pattern").cast("binary"), F.col("shift") + 1, F.lit(gram)))
    last = F.octet_length("bytes") - gram
    rows = texts.where(F.octet_length("bytes") >= least).select("id", "bytes", F.explode(F.sequence(F.lit(0), last, F.lit(step * PLACES))).alias("block"))
    rows = rows.select("id", "bytes", F.explode(F.sequence("block", F.least(F.col("block") + step * (PLACES - 1), last), F.lit(step))).alias("place"))
    rows = rows.withColumn("gram", F.substr("bytes", F.col("place") + 1, F.lit(gram)))
    if n * step * (most + 64) <= FEW_BYTES:
        index, rows = F.broadcast(index), rows.withColumn("start", F.lit(0))
    else:  # what a comparison needs of the text travels with its place
        start = F.greatest(F.col("place") - (step - 1), F.lit(0))
        rows = rows.select("id", "place", "gram", start.alias("start"), F.substr("bytes", start + 1, F.lit(step - 1 + most)).alias("bytes"))
    at = F.col("place") - F.col("shift")
    same = F.substr("bytes", at - F.col("start") + 1, F.octet_length("pattern")) == F.col("pattern").cast("binary")
    return rows.join(index, "gram").where((at >= 0) & same).select("id", "pattern", at.cast("long").alias("offset"))


def counts(docs: DataFrame, id_col: str, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """patterns with n (0 where a pattern never occurs)."""
    found = hits(docs, id_col, text, patterns, pattern).groupBy(F.col("pattern").alias("found")).agg(F.count(F.lit(1)).alias("n"))
    return patterns.join(found, F.col(pattern) == F.col("found"), "left").drop("found").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def apart(text: Column, pattern: Column) -> Column:
    """Occurrences of a column's pattern in a text that don't overlap, from the left."""
    return F.floor((F.octet_length(text) - F.octet_length(F.replace(text, pattern))) / F.octet_length(pattern)).cast("long")


def overlapping(text: Column, pattern: Column) -> Column:
    """Occurrences of a column's pattern in a text, overlapping ones too."""
    return F.when(F.contains(text, pattern), F.regexp_count(text, F.concat(F.lit("(?="), quoted(pattern), F.lit(")")))).otherwise(0)


def before(text: Column, offset: Column) -> Column:
    """The bytes of a text before an offset."""
    return F.substr(text.cast("binary"), F.lit(1), offset.cast("int"))


def line_and_column(text: Column, offset: Column) -> tuple[Column, Column]:
    """Both from 1; the column in bytes from the last newline."""
    lines = F.split(before(text, offset).cast("string"), "\n", -1)
    return F.size(lines), F.octet_length(F.element_at(lines, -1)) + 1


def context(text: Column, offset: Column, length: Column, around: int) -> Column:
    """The bytes from `around` before an occurrence to `around` after it, within its own text."""
    start = F.greatest(offset - around, F.lit(0))
    return F.substr(text.cast("binary"), (start + 1).cast("int"), (offset + length + around - start).cast("int"))


def first_hits(found: DataFrame, per: str, order: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(per).orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def scope_weight(path: Column) -> Column:
    generated = path.contains("generated") | path.contains("gen_")
    test = path.contains("/test") | path.contains("tests/") | path.endswith("_test.rs")
    return F.when(generated, 0.5).when(test, 0.8).otherwise(1.0)


def ranked_files(rows: DataFrame, alpha: float) -> DataFrame:
    """file, score, term_count, hit_count, line (the least), rank. rows: file, line, count."""
    score = F.sum(F.log1p(F.col("count").cast("double")) * scope_weight(F.col("file")))
    out = rows.groupBy("file").agg(score.alias("s"), F.count(F.lit(1)).alias("term_count"), F.sum("count").alias("hit_count"), F.min("line").alias("line"))
    return out.select("file", F.round(F.col("s") + alpha * F.col("term_count"), 6).alias("score"), "term_count", "hit_count", "line")
