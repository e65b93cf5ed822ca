"""Synonyms, query strings and classes of literature evidence. Counts of publications are an input table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixquery.storage import stored


def confidence(narrow: Column, broad: Column, epmc: Column, corpus_hits: Column) -> Column:
    """Of a gap in the literature. A failed count is null, and then nothing is known."""
    return (
        F.when(narrow.isNull() | broad.isNull() | epmc.isNull(), "UNKNOWN")
        .when(broad > 5, "FALSE")
        .when((broad > 0) | (corpus_hits > 0) | (epmc > 30), "UNCERTAIN")
        .when(narrow > 0, "PROBABLE")
        .otherwise("CONFIRMED")
    )


def synonyms(genes: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """genes (on, gene) with the official symbol and name where they differ from it, sorted.

    A gene is known by its symbol, else by its symbol with " protein" added, else by its name. known: on, symbol, name.
    """
    k = known.select(*on, F.lower("symbol").alias("by_symbol"), F.lower("name").alias("by_name"), "symbol", "name")
    pick = lambda key, tag: k.where(F.col(key) != "").groupBy(*on, F.col(key).alias("key")).agg(F.max(F.struct("symbol", "name")).alias(tag))
    g = genes.withColumn("lower", F.lower("gene")).withColumn("stem", F.regexp_replace("lower", " protein$", ""))
    out = g.join(pick("by_symbol", "s1").withColumnRenamed("key", "lower"), [*on, "lower"], "left")
    out = out.join(pick("by_symbol", "s2").withColumnRenamed("key", "stem"), [*on, "stem"], "left")
    out = out.join(pick("by_name", "s3").withColumnRenamed("key", "lower"), [*on, "lower"], "left")
    hit = F.coalesce("s1", "s2", "s3")
    both = F.filter(F.array(hit["name"], hit["symbol"]), lambda x: x.isNotNull() & (x != "") & (F.lower(x) != F.col("lower")))
    return out.select(*on, "gene", F.sort_array(F.array_distinct(both)).alias("synonyms"))


def merged_terms(manual: Column, official: Column) -> Column:
    """Manual names first, then official ones that are new, whatever their case."""
    all_ = F.concat(F.coalesce(manual, F.array().cast("array<string>")), F.coalesce(official, F.array().cast("array<string>")))
    lower = F.transform(all_, lambda x: F.lower(x))
    return F.filter(all_, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


#: How queries ask for the method, by dialect: fixed values.
METHOD = {
    "pubmed": '(CRISPR[Title/Abstract] OR "guide RNA"[Title/Abstract] OR Cas9[Title/Abstract] OR Cas12[Title/Abstract] OR Cas13[Title/Abstract] OR "gene editing"[Title/Abstract])',
    "epmc": '(CRISPR OR "guide RNA" OR Cas9 OR Cas12 OR Cas13 OR "gene editing")',
}
FIELD = {"pubmed": "[Title/Abstract]", "epmc": ""}


def boolean_query(names: Column, extra: Column | None = None, dialect: str = "pubmed") -> Column:
    """(organism names) AND method [AND (terms)]; names joined by " OR " count as several. In the dialect `epmc` the organism is the
    first name alone and terms have no field."""
    each = F.flatten(F.transform(names, lambda x: F.split(x, " OR ")))
    quote = lambda x: F.concat(F.lit('"'), F.trim(x), F.lit(f'"{FIELD[dialect]}'))
    clause = lambda c: F.concat(F.lit("("), F.array_join(F.transform(c, quote), " OR "), F.lit(")"))
    who = clause(each) if dialect == "pubmed" else quote(F.get(each, F.lit(0)))
    out = F.concat(who, F.lit(f" AND {METHOD[dialect]}"))
    return out if extra is None else F.concat(out, F.lit(" AND "), clause(extra))


def corpus_matches(papers: DataFrame, title: str, journal: str, terms: list[str]) -> DataFrame:
    """Titles (100 characters) of papers that name one of the terms in title or journal, in any case."""
    hay = F.lower(F.concat_ws(" ", F.col(title), F.col(journal)))
    hit = F.exists(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(hay, t))
    return papers.where(hit).withColumn(title, F.left(F.col(title), F.lit(100)))


def patent_status(total: Column) -> Column:
    return F.when(total.isNull(), "unknown").when(total == 0, "clear").otherwise("found")


def patents(total_by_source: dict[str, Column]) -> Column:
    """source, total and status of the first source that gave a count; without any the status is unknown, never clear."""
    first = F.coalesce(*(F.when(c.isNotNull(), F.struct(F.lit(name).alias("source"), c.cast("long").alias("total"))) for name, c in total_by_source.items()))
    return F.struct(first.source.alias("source"), first.total.alias("total"), patent_status(first.total).alias("status"))


#: Rows of a side that a task of a join sorts in the mean.
PART_ROWS = 500_000


def _parts(rows: DataFrame) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))


def with_items(scan: DataFrame, items: DataFrame, on: list[str]) -> DataFrame:
    """The rows of a scan with the columns that a table has for their keys, written: by as many tasks as the table's rows ask for."""
    n = _parts(items)
    return stored(scan.repartition(n, *on).join(items.repartition(n, *on), on), "scan")


def merged_scans(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """The rows of a new scan, and those of the old one whose keys it hasn't. The keys meet in as many tasks as the rows ask for."""
    n = max(_parts(old), _parts(new))
    return new.unionByName(old.repartition(n, *on).join(new.select(*on).repartition(n, *on).distinct(), on, "left_anti"))


def scan_lists(scan: DataFrame, by: str, item: str, confidence_col: str) -> DataFrame:
    """by, confidence, n and items (distinct, sorted, joined by `; `): what a scan found in each class."""
    items = F.array_join(F.array_sort(F.collect_set(item)), "; ")
    return scan.groupBy(by, confidence_col).agg(F.count(F.lit(1)).alias("n"), items.alias("items"))
