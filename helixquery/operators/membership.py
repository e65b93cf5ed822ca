"""Which records hold which guides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixquery import storage
from helixquery.functions import sequences as S
from helixquery.operators import search
from helixquery.operators.kmers import top_per_group


def conservation(records: DataFrame, id_col: str, seq: str, guides: DataFrame) -> DataFrame:
    """guide_id, sequence, hits (records with the guide on either strand), total (records not empty), conservation_pct."""
    total = records.where(F.length(seq) > 0).count()
    asked = guides.select("guide_id", F.upper("sequence").alias("sequence"))
    probes = asked.select("guide_id", F.explode(F.array_distinct(F.array("sequence", S.reverse_complement(F.col("sequence"))))).alias("probe"))
    found = search.hits(records, id_col, seq, probes, "probe").select(id_col, "pattern").distinct()
    each = found.join(probes, F.col("pattern") == F.col("probe")).select("guide_id", id_col).distinct()
    n = each.groupBy("guide_id").agg(F.count(F.lit(1)).alias("hits"))
    out = asked.join(n, "guide_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long")).withColumn("total", F.lit(total).cast("long"))
    return out.withColumn("conservation_pct", F.when(F.col("total") > 0, F.round(100.0 * F.col("hits") / F.col("total"), 2)).otherwise(0.0))


def cross_reactivity(targets: DataFrame, hosts: DataFrame, host: str, seq: str, per_pathogen: int, pam: str = "NGG") -> DataFrame:
    """sequence, host, hits: exact occurrences on both strands of each pathogen's top targets in every host (long form,
    hosts without hits are left out), the sequence's total over hosts, and whether it is specific (no hit in any).

    targets: pathogen, kmer, pam, occurrences. pam: NGG, or TTTV for TTTN whose fourth base isn't T.
    """
    wanted = S.is_tttv(F.col("kmer"), F.col("pam")) if pam == "TTTV" else F.col("pam") == pam
    top = top_per_group(targets.where(wanted), "pathogen", [F.desc("occurrences"), "kmer"], per_pathogen).select("kmer").distinct()
    top = storage.stored(top, "top-targets")  # read three times; per_pathogen bounds it
    probes = top.select("kmer", F.explode(F.array_distinct(F.array("kmer", S.reverse_complement(F.col("kmer"))))).alias("probe"))
    found = search.hits(hosts, host, seq, probes, "probe")
    n = found.groupBy(host, "pattern").agg(F.count(F.lit(1)).alias("h"))
    hits = n.join(probes, F.col("pattern") == F.col("probe")).groupBy("kmer", host).agg(F.sum("h").alias("hits"))
    totals = hits.groupBy("kmer").agg(F.sum("hits").alias("total_host_hits"))
    out = top.join(hits, "kmer", "left").join(totals, "kmer", "left").withColumn("total_host_hits", F.coalesce("total_host_hits", F.lit(0)).cast("long"))
    return out.withColumn("specific", F.col("total_host_hits") == 0)


def host_summary(reactivity: DataFrame, hosts: DataFrame, host: str) -> DataFrame:
    """Per host, and for all (host null): guides tested, guides with a hit, hits, and the clean share in percent.

    reactivity: as cross_reactivity gives it. Hosts without any hit are rows as well.
    """
    tested = reactivity.select("kmer").distinct().agg(F.count(F.lit(1)).alias("guides"))
    each = reactivity.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("hit_guides"), F.sum("hits").alias("hits"))
    each = hosts.select(host).where(F.col(host).isNotNull()).distinct().join(each, host, "left")
    per_guide = reactivity.groupBy("kmer").agg(F.max("total_host_hits").alias("t"))
    total = per_guide.agg(F.count_if(F.col("t") > 0).alias("hit_guides"), F.sum("t").alias("hits")).select(F.lit(None).cast(hosts.schema[host].dataType).alias(host), "hit_guides", "hits")
    rows = each.unionByName(total).fillna(0, ["hit_guides", "hits"]).join(F.broadcast(tested))  # one row
    share = F.when(F.col("guides") > 0, F.round(100.0 * (F.col("guides") - F.col("hit_guides")) / F.col("guides"), 1)).otherwise(0.0)
    return rows.select(host, "guides", "hit_guides", "hits", share.alias("clean_pct"))
