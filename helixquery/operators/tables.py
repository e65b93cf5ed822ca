"""Operators of the interactive target table: filters, pages, joins for export, and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixquery.operators.kmers import top_per_group


def filtered(targets: DataFrame, pam: str | None = None, part: str | None = None, where: Column | None = None) -> DataFrame:
    out = targets if pam is None else targets.where(F.col("pam") == pam)
    out = out if part is None else out.where(F.contains(F.upper("kmer"), F.lit(part.upper())))
    return out if where is None else out.where(where)


def page(rows: DataFrame, by: str, descending: bool, key: str, number: int, size: int = 50) -> DataFrame:
    """Page `number` (from 0) of the rows by a column, of which nothing counts as 0; ties by key."""
    value = F.coalesce(by, F.lit(0))
    return rows.orderBy(value.desc() if descending else value.asc(), key).offset(number * size).limit(size)


def top_targets(rows: DataFrame, most: int) -> DataFrame:
    """NGG first, then by occurrences."""
    return rows.orderBy((F.col("pam") != "NGG").cast("int"), F.desc("occurrences"), "kmer").limit(most)


def symbol_bridge(genes: DataFrame, on: str) -> DataFrame:
    """on, key, symbol: lower-case symbols by themselves and by their genes' names. genes: on, symbol, name. Of several symbols the last counts."""
    full = genes.where(F.trim("symbol") != "").select(on, F.lower(F.trim("symbol")).alias("symbol"), F.lower(F.trim("name")).alias("name"))
    keys = full.select(on, F.explode(F.array("symbol", "name")).alias("key"), "symbol").where(F.col("key") != "")
    return keys.groupBy(on, "key").agg(F.max("symbol").alias("symbol"))


def by_gap(targets: DataFrame, gene: str, on: str, genes: DataFrame, scanned: DataFrame, studied: bool) -> DataFrame:
    """targets with `symbol`, whose gene (a symbol or a name, in any case) is among the studied genes of a scan, or the unstudied ones.
    scanned: on, gene, studied."""
    bridge = symbol_bridge(genes, on).withColumnRenamed("symbol", "bridged")
    named = targets.withColumn("key", F.lower(F.col(gene))).join(bridge, [on, "key"], "left").withColumn("symbol", F.coalesce("bridged", "key"))
    wanted = scanned.where(F.col("studied") == studied).select(on, F.lower("gene").alias("symbol")).distinct()
    return named.where(F.col("symbol") != "").join(wanted, [on, "symbol"], "left_semi").drop("key", "bridged")


def exported(targets: DataFrame, scores: DataFrame, reactivity: DataFrame) -> DataFrame:
    """targets with their scores, total_host_hits and host_specific (yes or no), where these are known."""
    hosts = reactivity.groupBy("kmer").agg(F.max("total_host_hits").alias("total_host_hits"))
    out = targets.join(scores.select("kmer", "score", "gc", "seed_gc", "max_homopolymer"), "kmer", "left").join(hosts, "kmer", "left")
    return out.withColumn("host_specific", F.when(F.col("total_host_hits") == 0, "yes").when(F.col("total_host_hits") > 0, "no"))


def panel(candidates: DataFrame, min_share: float, min_score: int) -> DataFrame:
    """One guide per pathogen: NGG, conserved and scored enough, without known host hits; guides that no other
    pathogen has come first. candidates: pathogen, kmer, pam, share, score, host_hits (null: unknown, which passes)."""
    fit = candidates.where((F.col("pam") == "NGG") & (F.col("share") >= min_share) & (F.col("score") >= min_score) & (F.coalesce("host_hits", F.lit(0)) == 0))
    shared = fit.groupBy("kmer").agg((F.count_distinct("pathogen") > 1).cast("int").alias("shared"))
    best = top_per_group(fit.join(shared, "kmer"), "pathogen", ["shared", F.desc("score"), F.desc("share"), "kmer"], 1)
    return best.drop("rank")
