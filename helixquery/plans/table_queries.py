"""Queries of literature evidence, priorities, enrichment joins and the target table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixquery.functions import codes as C
from helixquery.functions import sequences as S
from helixquery.operators import kmers, literature, membership, scoring, tables
from helixquery.plans import sequence_queries as Q
from helixquery.plans import views as V
from helixquery.storage import stored


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Orders as counts of publications by priority class; every seventh count failed."""
    o = V.table(spark, d, "orders")
    n = F.col("o_orderkey")
    failed = lambda k, c: F.when(n % k != 0, c)
    rows = o.select("o_orderkey", "o_orderpriority", failed(7, n % 3).alias("narrow"), failed(11, n % 8).alias("broad"), failed(13, n % 45).alias("epmc"), (n % 2).alias("corpus"))
    return rows.select("o_orderkey", "o_orderpriority", literature.confidence(F.col("narrow"), F.col("broad"), F.col("epmc"), F.col("corpus")).alias("confidence"), literature.patent_status(F.col("broad")).alias("patents"))


EVIDENCE = """SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 8 > 5 THEN 'FALSE'
WHEN o_orderkey % 8 > 0 OR o_orderkey % 2 > 0 OR o_orderkey % 45 > 30 THEN 'UNCERTAIN' WHEN o_orderkey % 3 > 0 THEN 'PROBABLE' ELSE 'CONFIRMED' END AS confidence,
CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' WHEN o_orderkey % 8 = 0 THEN 'clear' ELSE 'found' END AS patents FROM orders"""


def evidence_summary(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).groupBy("o_orderpriority", "confidence").agg(F.count(F.lit(1)).alias("n"))


EVIDENCE_SUMMARY = f"SELECT o_orderpriority, confidence, count(*) AS n FROM ({EVIDENCE}) GROUP BY ALL"


def synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Parts as genes: types are official names, brands symbols; asked by brand, brand with ` protein`, and type."""
    p = V.table(spark, d, "part").select("p_size", "p_brand", "p_type").distinct()
    known = p.select("p_size", F.col("p_brand").alias("symbol"), F.col("p_type").alias("name"))
    asked = p.select("p_size", F.explode(F.array(F.lower("p_brand"), F.concat("p_brand", F.lit(" protein")), F.upper("p_type"), F.lit("none"))).alias("gene")).distinct()
    out = literature.synonyms(asked, known, ["p_size"])
    out = out.withColumn("query", literature.boolean_query(literature.merged_terms(F.array("gene"), F.col("synonyms"))))
    both = literature.merged_terms(F.array("gene"), F.col("synonyms"))
    out = out.withColumn("query_epmc", literature.boolean_query(F.array(F.lit("Mpox OR Monkeypox")), both, "epmc"))
    return out.withColumn("synonyms", F.array_join("synonyms", "|"))


SYNONYMS = """WITH p AS (SELECT DISTINCT p_size, p_brand, p_type FROM part), a AS (SELECT DISTINCT p_size, unnest([lower(p_brand), p_brand || ' protein', upper(p_type), 'none']) AS gene FROM p),
s AS (SELECT p_size, lower(p_brand) AS k, max((p_brand, p_type)) AS h FROM p GROUP BY ALL), n AS (SELECT p_size, lower(p_type) AS k, max((p_brand, p_type)) AS h FROM p GROUP BY ALL),
m AS (SELECT a.p_size, gene, coalesce(s1.h, s2.h, n.h) AS h FROM a LEFT JOIN s s1 ON s1.p_size = a.p_size AND s1.k = lower(gene) LEFT JOIN s s2 ON s2.p_size = a.p_size AND s2.k = regexp_replace(lower(gene), ' protein$', '')
      LEFT JOIN n ON n.p_size = a.p_size AND n.k = lower(gene)),
y AS (SELECT p_size, gene, CASE WHEN h IS NULL THEN [] ELSE list_sort(list_distinct(list_filter([h[1], h[2]], lambda x: lower(x) <> lower(gene)))) END AS syn FROM m)
SELECT p_size, gene, array_to_string(syn, '|') AS synonyms, '(' || array_to_string(list_transform(list_prepend(gene, syn), lambda x: '"' || x || '"[Title/Abstract]'), ' OR ') || ') AND ' || '__PM__' AS query,
  '"Mpox" AND __EPMC__ AND (' || array_to_string(list_transform(list_prepend(gene, syn), lambda x: '"' || x || '"'), ' OR ') || ')' AS query_epmc FROM y"""
SYNONYMS = SYNONYMS.replace("__PM__", literature.METHOD["pubmed"]).replace("__EPMC__", literature.METHOD["epmc"])


def patents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as searches by three sources, of which each may have failed."""
    n = F.col("o_orderkey")
    got = literature.patents({"lens_api": F.when(n % 2 == 0, n % 3), "google_patents": F.when(n % 5 > 1, n % 4), "lens_web": F.when(n % 7 > 3, n % 2)})
    return V.table(spark, d, "orders").select("o_orderkey", got.alias("p")).select("o_orderkey", "p.*")


_PATENTS = """p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'lens_api' WHEN o_orderkey % 5 > 1 THEN 'google_patents' WHEN o_orderkey % 7 > 3 THEN 'lens_web' END AS source,
CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 WHEN o_orderkey % 5 > 1 THEN o_orderkey % 4 WHEN o_orderkey % 7 > 3 THEN o_orderkey % 2 END AS BIGINT) AS total FROM orders)"""
PATENTS = f"WITH {_PATENTS} SELECT *, CASE WHEN total IS NULL THEN 'unknown' WHEN total = 0 THEN 'clear' ELSE 'found' END AS status FROM p"


def evidence_lists(spark: SparkSession, d: str) -> DataFrame:
    """A scan of even orders that replaces those of an older one of all, by priority class: numbers and customers of each class."""
    items = V.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("item"))
    old = literature.with_items(evidence(spark, d).drop("patents"), items, ["o_orderkey"])
    new = old.where("o_orderkey % 2 = 0").withColumn("confidence", F.when(F.col("confidence") == "UNKNOWN", "CONFIRMED").otherwise(F.col("confidence")))
    return literature.scan_lists(literature.merged_scans(old, new, ["o_orderkey"]), "o_orderpriority", "item", "confidence")


EVIDENCE_LISTS = f"""WITH e AS ({EVIDENCE}), m AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 2 = 0 AND confidence = 'UNKNOWN' THEN 'CONFIRMED' ELSE confidence END AS confidence, 'c' || (o_custkey % 50) AS item FROM e JOIN orders USING (o_orderkey, o_orderpriority))
SELECT o_orderpriority, confidence, count(*) AS n, string_agg(DISTINCT item, '; ' ORDER BY item) AS items FROM m GROUP BY o_orderpriority, confidence"""


def gene_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Parts as targets whose gene is a brand or a type (its name); sizes as pathogens; brands with an even number are studied."""
    p = V.table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    genes = p.select("p_size", F.col("p_brand").alias("symbol"), F.concat("p_type", F.lit(" "), F.col("p_partkey")).alias("name"))
    targets = p.select("p_partkey", "p_size", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.concat("p_type", F.lit(" "), F.col("p_partkey"))).alias("gene"))
    scanned = p.select("p_size", F.col("p_brand").alias("gene"), F.col("p_brand").rlike("[02468]$").alias("studied")).distinct()
    return tables.by_gap(targets, "gene", "p_size", genes, scanned, False).select("p_partkey", "p_size", "gene", "symbol")


GENE_GAPS = """SELECT p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_type || ' ' || p_partkey END AS gene, lower(p_brand) AS symbol FROM part WHERE NOT regexp_matches(p_brand, '[02468]$')"""


def target_export(spark: SparkSession, d: str) -> DataFrame:
    """The target table with scores and host hits (sources as hosts) where they are known."""
    found = stored(Q.kmer_targets(spark, d), "export-targets")
    scores = scoring.guide_scores(found.select("kmer", "pam"), "kmer", "pam")
    return tables.exported(found, scores, Q.cross_reactivity(spark, d)).select("kmer", "pam", "occurrences", "score", "gc", "seed_gc", "max_homopolymer", "total_host_hits", "host_specific")


TARGET_EXPORT = f"""WITH s AS ({Q.GUIDE_SCORES}), n AS ({Q.KMER_TARGETS}), r AS (SELECT kmer, max(total_host_hits) AS total_host_hits FROM ({Q.CROSS_REACTIVITY}) GROUP BY kmer)
SELECT kmer, n.pam, occurrences, score, gc, seed_gc, max_homopolymer, total_host_hits, CASE WHEN total_host_hits = 0 THEN 'yes' WHEN total_host_hits > 0 THEN 'no' END AS host_specific FROM n LEFT JOIN s USING (kmer) LEFT JOIN r USING (kmer)"""


def corpus_matches(spark: SparkSession, d: str) -> DataFrame:
    papers = V.documents(spark, d).select("doc_id", "text", "source")
    return literature.corpus_matches(papers, "text", "source", ["LICENSE", "ción de la", "src1"])


CORPUS_MATCHES = "SELECT doc_id, left(text, 100) AS text, source FROM documents WHERE contains(lower(text || ' ' || source), 'license') OR contains(lower(text || ' ' || source), 'ción de la') OR contains(lower(text || ' ' || source), 'src1')"


def diagnostic_priority(spark: SparkSession, d: str) -> DataFrame:
    """Customers as pathogens, with the texts that the factors are read from."""
    c = V.table(spark, d, "customer")
    k = F.col("c_custkey")
    rows = c.select(
        "c_custkey",
        F.when(k % 4 == 0, "None").when(k % 4 == 1, "limited use").when(k % 4 == 2, "").otherwise("approved").alias("dx_status"),
        F.when(k % 5 == 0, F.concat(k % 9, F.lit("."), k % 7, F.lit("-"), k % 9 + 2, F.lit("M"))).when(k % 5 == 1, F.concat(k % 90, F.lit(",000-"), k % 90 + 50, F.lit(",000"))).when(k % 5 == 2, F.concat(F.lit("~"), k)).otherwise(F.concat(k, F.lit("k"))).alias("annual_deaths"),
        F.when(k % 3 > 0, F.concat(k % 30, F.lit("% or, untreated, "), k % 50, F.lit(".5 %"))).alias("fatality"),
        F.concat(F.element_at(F.array(F.lit("Pandemic"), F.lit("epidemic"), F.lit("Endemic"), F.lit("other")), (k % 4 + 1).cast("int")), F.lit(" threat")).alias("classification"),
        F.element_at(F.array(F.lit("none"), F.lit("RT-PCR"), F.lit("antigen")), (k % 3 + 1).cast("int")).alias("rapid_tests"),
    )
    return scoring.priority(rows).select("c_custkey", "dx_gap", "burden", "severity", "who", "rapid", "total_score")


DIAGNOSTIC_PRIORITY = """WITH x AS (SELECT c_custkey, c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN ((((k % 9) || '.' || (k % 7))::DOUBLE * 1e6) + (k % 9 + 2) * 1e6) / 2 WHEN c_custkey % 5 = 1 THEN (((k % 90) || '000')::DOUBLE + ((k % 90 + 50) || '000')::DOUBLE) / 2
  WHEN c_custkey % 5 = 2 THEN 0 ELSE k * 1000.0 END AS deaths, CASE WHEN k % 3 > 0 THEN greatest((k % 30)::DOUBLE / 100, ((k % 50) || '.5')::DOUBLE / 100) ELSE 0 END AS cfr FROM customer),
f AS (SELECT c_custkey, CASE k % 4 WHEN 0 THEN 30 WHEN 1 THEN 15 WHEN 2 THEN 30 ELSE 0 END AS dx_gap, CASE WHEN deaths > 100000 THEN 25 WHEN deaths > 10000 THEN 20 WHEN deaths > 1000 THEN 15 WHEN deaths > 100 THEN 10 ELSE 5 END AS burden,
  CASE WHEN cfr >= 0.25::DOUBLE THEN 15 WHEN cfr >= 0.05::DOUBLE THEN 10 WHEN cfr >= 0.01::DOUBLE THEN 5 ELSE 2 END AS severity, CASE k % 4 WHEN 0 THEN 15 WHEN 1 THEN 12 WHEN 2 THEN 8 ELSE 5 END AS who, CASE k % 3 WHEN 0 THEN 15 WHEN 1 THEN 10 ELSE 3 END AS rapid FROM x)
SELECT *, dx_gap + burden + severity + who + rapid AS total_score FROM f"""


def enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Customers with nation, region, orders and the largest order, all kept; counts of what is known."""
    t = lambda n: V.table(spark, d, n)
    orders = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("largest"))
    out = t("customer").select("c_custkey", "c_nationkey").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    out = out.join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.count("orders").alias("with_orders"), F.coalesce(F.sum("orders"), F.lit(0)).cast("long").alias("orders"), F.max("largest").alias("largest"))


ENRICHMENT = """WITH o AS (SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS largest FROM orders GROUP BY 1)
SELECT r_name, n_name, count(*) AS customers, count(o.orders) AS with_orders, CAST(coalesce(sum(o.orders), 0) AS BIGINT) AS orders, max(largest) AS largest
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON o_custkey = c_custkey GROUP BY r_name, n_name"""


def table_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of NGG targets with ACG in them, by occurrences."""
    return tables.page(tables.filtered(Q.kmer_targets(spark, d), "NGG", "acg"), "occurrences", True, "kmer", 1)


TABLE_PAGE = f"WITH {Q._COUNTED}, {Q._TOP} SELECT kmer, occurrences, f[1] AS first_record, f[2] AS first_pos, pam FROM t WHERE pam = 'NGG' AND contains(kmer, 'ACG') ORDER BY occurrences DESC, kmer LIMIT 50 OFFSET 50"


def top_targets(spark: SparkSession, d: str) -> DataFrame:
    return tables.top_targets(Q.kmer_targets(spark, d), 25).select("kmer", "pam", "occurrences")


TOP_TARGETS = f"WITH {Q._COUNTED}, {Q._TOP} SELECT kmer, pam, occurrences FROM t ORDER BY (pam <> 'NGG')::INTEGER, occurrences DESC, kmer LIMIT 25"


def panel(spark: SparkSession, d: str) -> DataFrame:
    """A guide per language; hosts are the documents of src1."""
    g = V.genome(spark, d)
    n = g.groupBy(F.col("lang").alias("pathogen")).agg(F.count(F.lit(1)).alias("genomes"))
    counted = kmers.top_by_group(g, "lang", "seq", Q.K, 200, C.of_pam("NGG", Q.K)).withColumnRenamed("lang", "pathogen").withColumn("pam", S.pam(F.col("kmer")))
    counted = stored(counted, "panel-targets")
    top = counted.join(n, "pathogen")
    top = top.withColumn("share", F.least("occurrences", "genomes") / F.col("genomes"))
    scored = scoring.guide_scores(top.select("kmer", "pam").distinct(), "kmer", "pam").select("kmer", "score")
    hits = membership.cross_reactivity(counted, g.where("source = 'src1'"), "source", "seq", 200).groupBy("kmer").agg(F.sum("hits").alias("host_hits"))
    both = top.join(scored, "kmer").join(hits, "kmer", "left")
    return tables.panel(both, 0.0, 40).select("pathogen", "kmer", "occurrences", "score", "shared")


PANEL = f"""WITH {V.GENOME}, {V.windows_sql(Q.K)}, g AS (SELECT lang, count(*) AS genomes FROM genome GROUP BY lang), c0 AS (SELECT lang, kmer, count(*) AS occurrences FROM w WHERE kmer LIKE '%GG' GROUP BY ALL),
c1 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY occurrences DESC, kmer) AS r FROM c0), t0 AS (SELECT lang, kmer, occurrences, least(occurrences, genomes)::DOUBLE / genomes AS share FROM c1 JOIN g USING (lang) WHERE r <= 200),
p AS (SELECT DISTINCT kmer, unnest([kmer, {V.RC("kmer")}]) AS probe FROM t0), hh AS (SELECT DISTINCT p.kmer FROM w JOIN p ON w.kmer = p.probe WHERE source = 'src1'),
t AS (SELECT DISTINCT kmer, 'NGG' AS pam FROM t0), {Q._SCORES.split(Q._TOP + ", ")[1]},
fit AS (SELECT t0.*, score FROM t0 JOIN scores USING (kmer) WHERE score >= 40 AND kmer NOT IN (SELECT kmer FROM hh)),
sh AS (SELECT kmer, (count(DISTINCT lang) > 1)::INTEGER AS shared FROM fit GROUP BY kmer)
SELECT pathogen, kmer, occurrences, score, shared FROM (SELECT lang AS pathogen, fit.*, shared, row_number() OVER (PARTITION BY lang ORDER BY shared, score DESC, share DESC, kmer) AS r FROM fit JOIN sh USING (kmer)) WHERE r = 1"""

QUERIES = {
    "evidence": (evidence, EVIDENCE),
    "evidence_summary": (evidence_summary, EVIDENCE_SUMMARY),
    "synonyms": (synonyms, SYNONYMS),
    "patents": (patents, PATENTS),
    "evidence_lists": (evidence_lists, EVIDENCE_LISTS),
    "gene_gaps": (gene_gaps, GENE_GAPS),
    "target_export": (target_export, TARGET_EXPORT),
    "corpus_matches": (corpus_matches, CORPUS_MATCHES),
    "diagnostic_priority": (diagnostic_priority, DIAGNOSTIC_PRIORITY),
    "enrichment": (enrichment, ENRICHMENT),
    "table_page": (table_page, TABLE_PAGE),
    "top_targets": (top_targets, TOP_TARGETS),
    "panel": (panel, PANEL),
}
