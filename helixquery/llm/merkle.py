"""Merkle manifest of a dataset: a tree of 8-ary runs per partition, and one over the partitions' roots.

A row's leaf is the digest of its fields, each with its length in front. The leaves of a partition (column `lang` in the
query) stand in the order of their ids and have gapless positions. A level's nodes are rows (tree, at, node): windows over
a run of FAN rows give every node its siblings by lags and leads of fixed offsets 1 to FAN - 1, masked by its slot in the
run and by the run's length; the first child of each run hashes the parent, which is a row of the next level. From the top
down every node's path is its siblings in front of its parent's path, so a leaf's proof is a join with the level above its own.

A window's group is one run, a level has an eighth of the rows of the one below, and positions come from a sort by range and
the sizes of its parts: no task sees a partition's rows together, whatever a partition's share of all rows.

Defined results: null fields are `-`; a null partition is one of its own and the first; rows with equal ids stand in the
order of their leaves (equal rows are interchangeable); a tree of one leaf has that leaf as its root; an empty table
gives no rows. Extra columns are not part of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixquery.llm import scratch

FAN = 8
#: Partitions (and parts of the sort) up to this number are broadcast, a few short columns each.
FEW_TREES = 10_000
PATH = "array<struct<l:string,r:string>>"
OFFSETS = range(1, FAN)


def field(c: Column) -> Column:
    """A value as `-` or its UTF-8 bytes with their number in front."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def in_order(rows: DataFrame, order: list[str], paths: list[str]) -> DataFrame:
    """rows, written, with `row_no`, gapless from 0 in the order of `order` (equal rows in any); nulls first."""
    dealt = rows.withColumn("mk_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [*order, "mk_tie"]]
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = dealt.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("mk_tie").withColumn("mk_at", F.monotonically_increasing_id())
    placed = scratch.written(placed, "in-order", paths)
    part = F.shiftright("mk_at", 33)  # the other bits count a part's rows
    sizes = placed.groupBy(part.alias("mk_part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("mk_part", (F.sum("n").over(Window.orderBy("mk_part")) - F.col("n")).alias("mk_before"))  # one row a part of the sort
    out = placed.withColumn("mk_part", part).join(F.broadcast(before) if n <= FEW_TREES else before, "mk_part")
    return out.withColumn("row_no", F.col("mk_before") + F.col("mk_at").bitwiseAND((1 << 33) - 1)).drop("mk_part", "mk_before", "mk_at")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """nodes (tree, at, n, node, ...; n: nodes of the level) with l and r, the joined siblings on either side."""
    out = nodes.selectExpr("*", f"floor(at / {FAN}) as run", f"at % {FAN} as slot")
    over = "over (partition by tree, run order by at)"
    moved = {f"{side}{o}": f"{side}(node, {o}) {over}" for side in ("lag", "lead") for o in OFFSETS}
    out = out.selectExpr("*", f"least({FAN}, n - run * {FAN}) as size", *(f"{x} as {name}" for name, x in moved.items()))
    left = ", ".join(f"if(slot >= {o}, lag{o}, '')" for o in reversed(OFFSETS))
    right = ", ".join(f"if(slot + {o} < size, lead{o}, '')" for o in OFFSETS)
    return out.selectExpr(*nodes.columns, "run", f"concat({left}) as l", f"concat({right}) as r")


def parents(level: DataFrame) -> DataFrame:
    """The next level: first children hash their runs. Trees with one node are over."""
    first = level.where((F.col("at") % FAN == 0) & (F.col("n") > 1))
    return first.select("tree", F.col("run").alias("at"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.sha2(F.concat("node", "r"), 256).alias("node"))


def grown(leaves: DataFrame, most: int, paths: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(tree, root) of all trees, and tree, at, path of the nodes just above the leaves (None: no tree has two leaves).

    leaves: tree, at, n, node. most: leaves of the largest tree.
    """
    levels: list[DataFrame] = []
    below, n = with_siblings(leaves), most
    tops = [leaves.where("n = 1").select("tree", F.col("node").alias("root"))]
    while n > 1:
        n = -(-n // FAN)
        level = parents(below)
        level = scratch.written(with_siblings(level) if n > 1 else level.selectExpr("*", "0L as run", "'' as l", "'' as r"), "level", paths)
        levels.append(level)
        tops.append(level.where("n = 1").select("tree", F.col("node").alias("root")))
        below = level
    above: DataFrame | None = None
    for level in reversed(levels):
        here = F.when(F.col("n") > 1, F.array(F.struct("l", "r"))).otherwise(F.array().cast(PATH))
        if above is None:
            up = level.select("tree", "at", here.alias("path"))
        else:
            up = level.join(above.select("tree", F.col("at").alias("run"), F.col("path").alias("rest")), ["tree", "run"], "left")
            up = up.select("tree", "at", F.concat(here, F.coalesce("rest", F.array().cast(PATH))).alias("path"))
        above = up
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    return roots, above


def manifest(leaves: DataFrame, tree_col: str, id_col: str) -> DataFrame:
    """leaves (tree_col, id_col, leaf, ...) with subroot, root and path: the siblings (l, r) of every level up to root."""
    paths: list[str] = []
    rows = in_order(leaves, [tree_col, id_col, "leaf"], paths)
    trees = scratch.written(rows.groupBy(F.col(tree_col).alias("key")).agg(F.min("row_no").alias("start"), F.count(F.lit(1)).alias("n")), "trees", paths)
    few, most = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    if not few:
        return rows.drop("row_no").select("*", F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(PATH).alias("path"))
    if few <= FEW_TREES:
        trees = trees.withColumn("tree", F.row_number().over(Window.orderBy(F.col("key").asc_nulls_first())).cast("long") - 1)
    else:
        trees = in_order(trees, ["key"], paths).withColumnRenamed("row_no", "tree")
    near = F.broadcast(trees) if few <= FEW_TREES else trees
    placed = rows.join(near, rows[tree_col].eqNullSafe(trees["key"])).withColumn("at", F.col("row_no") - F.col("start")).withColumnRenamed("leaf", "node").drop("key", "start")
    roots, above = grown(placed.select("tree", "at", "n", "node"), most, paths)
    # the trees' roots are the leaves of one more tree
    top = scratch.written(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(few).cast("long").alias("n"), F.col("root").alias("node")), "roots", paths)
    one, over = grown(top, few, paths)
    root = one.first()["root"]
    last = with_siblings(top)
    here = F.when(F.col("n") > 1, F.array(F.struct("l", "r"))).otherwise(F.array().cast(PATH))
    if over is not None:
        last = last.join(over.select("tree", F.col("at").alias("run"), "path"), ["tree", "run"], "left")
    else:
        last = last.withColumn("path", F.array().cast(PATH))
    ends = last.select(F.col("at").alias("tree"), F.col("node").alias("subroot"), F.concat(here, F.coalesce("path", F.array().cast(PATH))).alias("mk_last"))
    out = with_siblings(placed)
    if above is not None:
        out = out.join(above.select("tree", F.col("at").alias("run"), F.col("path").alias("mk_up")), ["tree", "run"], "left")
    else:
        out = out.withColumn("mk_up", F.array().cast(PATH))
    out = out.join(F.broadcast(ends) if few <= FEW_TREES else ends, "tree")
    path = F.concat(here, F.coalesce("mk_up", F.array().cast(PATH)), F.col("mk_last"))
    return out.withColumns({"path": path, "root": F.lit(root)}).drop("tree", "at", "n", "run", "l", "r", "mk_up", "mk_last", "row_no").withColumnRenamed("node", "leaf")


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, node, lambda x, p: F.sha2(F.concat(p.l, x, p.r), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p.l, p.r)), ""), 256)
