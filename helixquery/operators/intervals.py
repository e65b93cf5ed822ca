"""Joins of places with ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixquery.operators import ordered

#: Width of the cells that ranges and places share in an equi-join.
CELL = 256
#: Levels of a binary tree over the cells: places below CELL * 2^LEVELS.
LEVELS = 36


def overlaps(targets: DataFrame, regions: DataFrame, length: int, on: list[str] | None = None) -> DataFrame:
    """Pairs of targets [pos, pos + length) and regions [start, end) that share a place, once each.

    A region with end < start is circular: targets from `start` on or ending at `end` or before belong to it.
    Both sides are put into cells of CELL places and meet where a cell is the same; a pair counts in the first
    cell that it shares. A circular region is the range up to its end, and a cell from which all that follow belong to it:
    those are the places whose own first cell is larger, so its part behind `start` meets one cell a target at most.
    """
    on = on or []
    flat = regions.withColumn("circular", F.col("end") < F.col("start"))
    cells = lambda lo, hi: F.sequence(F.floor(lo / CELL), F.floor((hi - 1) / CELL))
    t = targets.withColumn("cell", F.explode(cells(F.col("pos"), F.col("pos") + length)))
    once = F.col("cell") == F.greatest(F.floor(F.col("pos") / CELL), F.floor(F.col("lo") / CELL))
    plain = flat.where("not circular and end > start").withColumn("lo", F.col("start")).withColumn("cell", F.explode(cells(F.col("start"), F.col("end"))))
    inside = (F.col("pos") < F.col("end")) & (F.col("pos") + length > F.col("start"))
    pairs = t.join(plain, [*on, "cell"]).where(inside & once)
    turn = flat.where("circular")
    head = turn.where("end > 0").withColumn("lo", F.lit(0).cast("long")).withColumn("cell", F.explode(cells(F.lit(0), F.col("end"))))
    pairs = pairs.unionByName(t.join(head, [*on, "cell"]).where((F.col("pos") + length <= F.col("end")) & once))
    if on:
        behind = targets.join(turn, on)
    else:  # the cells from the region's first on are it and whole subtrees of a binary tree; a cell has an ancestor a level
        level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")
        own = turn.select("*", F.lit(0).alias("level"), F.floor(F.col("start") / CELL).alias("node"))
        later = turn.select("*", level).where(F.expr(f"shiftright(floor(start / {CELL}), level) % 2 = 0")).withColumn("node", F.expr(f"shiftright(floor(start / {CELL}), level) + 1"))
        near = targets.select("*", level).withColumn("node", F.expr(f"shiftright(floor(pos / {CELL}), level)"))
        behind = near.join(own.unionByName(later), ["level", "node"]).drop("level", "node")
    behind = behind.where((F.col("pos") >= F.col("start")) & ~(F.col("pos") + length <= F.col("end")))
    return pairs.drop("cell", "lo", "circular").unionByName(behind.drop("circular"))


def without_overlap(targets: DataFrame, regions: DataFrame, length: int, keys: list[str], on: list[str] | None = None) -> DataFrame:
    """Targets that share no place with any region."""
    return targets.join(overlaps(targets, regions, length, on).select(*keys).distinct(), keys, "left_anti")


def merged(windows: DataFrame, by: str, length: int) -> DataFrame:
    """Runs of windows that touch or overlap: by, region_start, region_end, window_count. A record's windows may fill any number
    of tasks (see operators.ordered)."""
    rows = ordered.placed(windows.select(by, "pos").distinct(), [F.col(by).asc_nulls_first(), F.col("pos").asc()])
    rows = ordered.previous(rows, by, F.col("pos"), "before")
    new = F.coalesce((F.col("pos") > F.col("before") + length).cast("long"), F.lit(1).cast("long"))
    rows = ordered.running_sum(rows.withColumn("new", new), F.col("new"), "earlier").withColumn("run", F.col("earlier") + F.col("new"))
    return rows.groupBy(by, "run").agg(F.min("pos").alias("region_start"), (F.max("pos") + length).alias("region_end"), F.count(F.lit(1)).alias("window_count")).drop("run")


def latest_start(places: DataFrame, ranges: DataFrame, by: str, fields: list[str], wrap: bool = False) -> DataFrame:
    """places with the fields of the range that has the largest start <= pos, if pos <= its end; null otherwise.

    Ranges without both ends or with one of 0 or less don't count, turned ones are turned back. wrap: a place behind all ends of
    its record is looked up at its remainder by the largest end. Places and ranges are merged in the order of their positions,
    and the last range seen is carried forward, over parts of a record too.
    """
    ends = ranges.where("start > 0 and `end` > 0").withColumns({"start": F.least("start", "end"), "end": F.greatest("start", "end")})
    at = places.select(by, "pos", F.col("key").cast("string").alias("key"), F.col("pos").alias("probe"))
    if wrap:
        turn = ends.groupBy(by).agg(F.max("end").alias("turn"))
        at = at.join(turn, by, "left").withColumn("probe", F.when(F.col("pos") > F.col("turn"), F.col("pos") % F.col("turn")).otherwise(F.col("pos"))).drop("turn")
    r = ends.select(by, F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("key"), F.col("start").cast("long").alias("probe"), F.lit(0).alias("kind"), F.struct("start", "end", *fields).alias("range"))
    p = at.select(by, F.col("pos").cast("long").alias("pos"), "key", F.col("probe").cast("long").alias("probe"), F.lit(1).alias("kind"), F.lit(None).cast(r.schema["range"].dataType).alias("range"))
    rows = ordered.placed(r.unionByName(p), [F.col(by).asc_nulls_first(), F.col("probe").asc(), F.col("kind").asc(), F.col("range.end").asc()])
    seen = ordered.last_seen(rows, by, F.col("range"), "seen").where("kind = 1")
    inside = F.col("probe") <= F.col("seen.end")
    return seen.select(by, "pos", "key", *(F.when(inside, F.col(f"seen.{f}")).alias(f) for f in fields))


def annotation_counts(annotated: DataFrame, by: str, field: str) -> DataFrame:
    """by, annotated and total: how many places have a range."""
    return annotated.groupBy(by).agg(F.count(field).alias("annotated"), F.count(F.lit(1)).alias("total"))


def variant_tolerance(guides: DataFrame, variants: DataFrame, length: int, on: list[str], seed_end: int = 12) -> DataFrame:
    """guides (key columns, pos, conservation) with the variants that fall into them and the tolerant estimate."""
    spans = variants.withColumn("start", F.col("at")).withColumn("end", F.col("at") + 1)
    found = overlaps(guides, spans, length, on)
    seed = F.col("at") - F.col("pos") < seed_end
    keys = guides.columns
    sums = found.groupBy(*keys).agg(F.count_if(seed).alias("seed_variants"), F.count_if(~seed).alias("distal_variants"), F.max(F.when(seed, F.col("freq"))).alias("fs"), F.max(F.when(~seed, F.col("freq"))).alias("fd"))
    out = guides.join(sums, keys, "left").fillna(0, ["seed_variants", "distal_variants"])
    e = F.col("conservation")
    estimate = F.when(F.col("seed_variants") > 0, 1.0 - F.col("fs")).when(F.col("distal_variants") > 0, e + (1 - e) * F.col("fd")).otherwise(e)
    return out.withColumn("tolerant", F.bround(estimate, 4)).drop("fs", "fd")
