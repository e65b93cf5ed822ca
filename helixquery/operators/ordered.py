"""Running values over a whole table in order, without one task that sees it all.

Rows are sorted by range into parts of like size, written, and every part is scanned by itself; what a part hands on to the
later ones comes from a table with a row per part. A group (one contig, one language) may span any number of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixquery.storage import stored

PART, AT = "__part", "__at"


def placed(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """rows, written, with the part of the sort that they fell into and their place in it. Rows equal in `order` stand in
    some fixed order; parts are dealt by it too, so that many equal rows don't fill one."""
    n = parts or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*order, F.col("__tie").asc()]
    out = tied.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__tie").withColumn(AT, F.monotonically_increasing_id())
    return stored(out.withColumn(PART, F.shiftright(AT, 33)), "ordered")  # the other bits count a part's rows


def within() -> Window:
    return Window.partitionBy(PART).orderBy(AT)


def running_sum(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """placed rows with the sum of `value` over all rows before each (0 for the first)."""
    sums = rows.groupBy(PART).agg(F.sum(value).alias("__s"))
    before = sums.select(PART, (F.sum("__s").over(Window.orderBy(PART)) - F.col("__s")).alias("__before"))  # a row per part
    inner = F.coalesce(F.sum(value).over(within().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(name, inner).join(F.broadcast(before), PART).withColumn(name, F.col(name) + F.col("__before")).drop("__before")


def row_numbers(rows: DataFrame, name: str) -> DataFrame:
    return running_sum(rows, F.lit(1).cast("long"), name)


def last_seen(rows: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """placed rows with the last `value` that isn't null among the rows up to and with each, of the same `by` (rows are in its order)."""
    mark = F.when(value.isNotNull(), F.struct(F.col(by).alias("by"), value.alias("v")))
    ends = rows.groupBy(PART).agg(F.max_by(mark, F.when(value.isNotNull(), F.col(AT))).alias("__end"))
    w = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    carried = ends.select(PART, F.last("__end", ignorenulls=True).over(w).alias("__carried"))
    inner = F.last(mark, ignorenulls=True).over(within().rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn(name, inner).join(F.broadcast(carried), PART)
    found = F.coalesce(F.col(name), F.col("__carried"))
    return out.withColumn(name, F.when(found.by.eqNullSafe(F.col(by)), found.v)).drop("__carried")


def previous(rows: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """placed rows with the `value` of the row before each in the same `by`; null for the first."""
    mark = F.struct(F.col(by).alias("by"), value.alias("v"))
    ends = rows.groupBy(PART).agg(F.max_by(mark, F.col(AT)).alias("__end"))
    carried = ends.select(PART, F.lag("__end").over(Window.orderBy(PART)).alias("__carried"))  # a row per part; empty parts have none
    out = rows.withColumn(name, F.lag(mark).over(within())).join(F.broadcast(carried), PART)
    found = F.coalesce(F.col(name), F.col("__carried"))
    return out.withColumn(name, F.when(found.by.eqNullSafe(F.col(by)), found.v)).drop("__carried")


def plain(rows: DataFrame) -> DataFrame:
    return rows.drop(PART, AT)
