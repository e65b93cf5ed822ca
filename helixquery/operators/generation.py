"""Queries cut from records at seeded places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixquery.operators import ordered
from helixquery.storage import stored

#: Places that every task looks up by itself; more of them meet the records in a join that Spark chooses.
FEW_PLACES = 500_000


def seeded(seed: int, i: Column, what: str) -> Column:
    """48 bits that depend on a seed, a number and a word alone."""
    return F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), i.cast("string"), F.lit(f":{what}"))), F.lit(12)), 16, 10).cast("long")


def generated_queries(records: DataFrame, id_col: str, seq: str, length: int, n: int, seed: int) -> DataFrame:
    """query_id (from 0), pattern, origin and offset of n queries of `length` bases, each from a seeded record (of those long
    enough, by id) and place: the same ones however the records are dealt. Ids are unique; without a record that is long enough
    there are none."""
    sizes = stored(records.select(F.col(id_col).alias("origin"), F.length(seq).cast("long").alias("size")), "sizes")  # sequences may be made by Python
    numbered = ordered.placed(sizes.where(F.col("size") >= length), [F.col("origin").asc()])
    numbered = stored(ordered.plain(ordered.row_numbers(numbered, "no")), "numbered")
    total = numbered.count()
    i = F.col("id")
    asked = records.sparkSession.range(n if total else 0).select(i.alias("query_id"), (seeded(seed, i, "record") % max(total, 1)).alias("no"), seeded(seed, i, "place").alias("x"))
    places = asked.join(numbered, "no").select("query_id", "origin", (F.col("x") % (F.col("size") - length + 1)).alias("offset"))
    places = F.broadcast(places) if n <= FEW_PLACES else places
    texts = records.select(F.col(id_col).alias("origin"), F.col(seq).alias("text"))
    cut = F.substr("text", (F.col("offset") + 1).cast("int"), F.lit(length))
    return places.join(texts, "origin").select("query_id", cut.alias("pattern"), "origin", "offset")
