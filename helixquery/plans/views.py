"""The driver's tables as the engine's inputs, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixquery.functions import codes as C
from helixquery.functions import sequences as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, seq: every document's letters as bases."""
    return documents(spark, sf_dir).select("doc_id", "lang", "source", F.arrow_udf(C.of_prose, "string")("text").alias("seq"))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, pattern: the text of every benchmark item."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("pattern"))


def guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, seq (whole item as bases), guide (20 bases)."""
    return table(spark, sf_dir, "benchmark").select("item_id", S.from_prose(F.col("text")).alias("seq")).withColumn("guide", F.left("seq", F.lit(20)))


def bases_sql(text: str) -> str:
    return f"translate(regexp_replace(lower(coalesce({text}, '')), '[^a-z]', '', 'g'), '{S.LETTERS}', '{S.AS_BASES}')"


GENOME = f"genome AS (SELECT doc_id, lang, source, {bases_sql('text')} AS seq FROM documents)"
GUIDES = f"guides AS (SELECT item_id, seq, left(seq, 20) AS guide FROM (SELECT item_id, {bases_sql('text')} AS seq FROM benchmark))"
PATTERNS = "patterns AS (SELECT item_id, text AS pattern FROM benchmark)"
RC = lambda s: f"translate(reverse({s}), 'ACGT', 'TGCA')"
PAM = lambda k: f"CASE WHEN {k} LIKE '%GG' THEN 'NGG' WHEN {k} LIKE 'TTT%' THEN 'TTTN' ELSE 'none' END"


def windows_sql(k: int, source: str = "genome") -> str:
    """A CTE w(doc_id, lang, pos, kmer)."""
    return f"w AS (SELECT doc_id, lang, source, i - 1 AS pos, substr(seq, i, {k}) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - {k} + 2)) AS i FROM {source} WHERE length(seq) >= {k}))"


HITS = f"""{PATTERNS},
hits AS (SELECT doc_id, pattern, text, i FROM (SELECT doc_id, text, pattern, unnest(range(1, length(text) - length(pattern) + 2)) AS i
         FROM documents JOIN (SELECT DISTINCT pattern FROM patterns) ON contains(text, pattern)) WHERE substr(text, i, length(pattern)) = pattern)"""
