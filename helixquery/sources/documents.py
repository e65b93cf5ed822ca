"""JSON inputs with fixed schemas and defaults, and writers of hits and one-document reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGION = "best_seq string, best_pos long, gene string, novelty_score double, region_start long, region_end long, window_count long, pam_types array<string>"
GUIDE = "id string, sequence string, paper string, pmid string, gene string, wuhan_hu1_pos long, length int"
#: Columns of a CSV of hits, in order: fixed values.
HIT_COLUMNS = ["guide_idx", "guide_seq", "chrom", "pos", "strand", "mismatches", "mm_positions"]


def _documents(spark: SparkSession, path: str, field: str, item: str) -> DataFrame:
    """source_path, item and corrupt: the items below `field` of every JSON document (a file each); corrupt for a file without them."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), "value")
    kind = f"`{field}` array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in item.split(','))}>>, corrupt string".replace(", ", ",")
    parsed = raw.select("source_path", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("d"), "value")
    found = F.col(f"d.{field}")
    error = F.when(F.col("d.corrupt").isNotNull() | found.isNull(), F.concat(F.lit(f"no list {field!r} in "), F.left("value", F.lit(60))))
    return parsed.select("source_path", error.alias("corrupt"), F.explode_outer(F.when(error.isNull(), found)).alias("item")).where("item is not null or corrupt is not null")


def _required(rows: DataFrame, fields: list[str]) -> DataFrame:
    missing = F.array_join(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)), ", ")
    return rows.withColumn("corrupt", F.coalesce("corrupt", F.when(missing != "", F.concat(F.lit("lacks "), missing))))


def novel_regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of documents with `regions`, and corrupt (what is wrong with a document or an item); novelty_score is 0 where it is left out."""
    rows = _documents(spark, path, "regions", REGION).select("source_path", "corrupt", "item.*")
    return _required(rows, ["best_seq", "best_pos", "gene"]).withColumn("novelty_score", F.when(F.col("corrupt").isNull(), F.coalesce("novelty_score", F.lit(0.0))))


def published_guides(spark: SparkSession, path: str) -> DataFrame:
    """Guides of documents with `guides`, and corrupt; texts are empty where they are left out, places null."""
    rows = _required(_documents(spark, path, "guides", GUIDE).select("source_path", "corrupt", "item.*"), ["id", "sequence", "length"])
    return rows.withColumns({c: F.when(F.col("corrupt").isNull(), F.coalesce(c, F.lit(""))) for c in ("paper", "pmid", "gene")})


def corpus_records(spark: SparkSession, path: str) -> DataFrame:
    """id, sequence and corrupt of JSON lines; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", "id string, sequence string, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("d"))
    return _required(parsed.select("d.id", "d.sequence", "d.corrupt"), ["id", "sequence"])


def write_hits(hits: DataFrame, path: str) -> None:
    """Hits as CSV with a header; mm_positions (an array) is joined by `;`. An empty list is an empty field."""
    hits.select(*(F.array_join(c, ";").alias(c) if c == "mm_positions" else c for c in HIT_COLUMNS)).write.option("header", "true").option("emptyValue", "").csv(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    kinds = "guide_idx int, guide_seq string, chrom string, pos long, strand string, mismatches int, mm_positions string"
    rows = spark.read.option("header", "true").schema(kinds).csv(path)
    places = F.transform(F.filter(F.split(F.coalesce("mm_positions", F.lit("")), ";"), lambda x: x != ""), lambda x: x.cast("int"))
    return rows.withColumn("mm_positions", places)


def write_document(rows: DataFrame, path: str, field: str, order: list[str]) -> None:
    """One JSON document with the number of rows and the rows as a list: for reports, whose rows are few."""
    items = F.array_sort(F.collect_list(F.struct(*order, *(c for c in rows.columns if c not in order))))
    one = rows.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("total"), items.alias(field)), {"ignoreNullFields": "false"}).alias("value"))
    one.write.text(path)


def write_markdown(rows: DataFrame, path: str, title: str, order: list[str]) -> None:
    """One Markdown table: for reports, whose rows are few. Nulls are empty cells, bars are escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, rows.columns)), F.lit(" |"))
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x.line), "\n")
    rows.agg(F.concat(F.lit(head), body).alias("value")).write.text(path)
