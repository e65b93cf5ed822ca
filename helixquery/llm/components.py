"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixquery.llm import scratch

#: Links that a task contracts at a time (two longs each).
AT_ONCE = 200_000


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) for all nodes of the links but the roots; root is the smallest node that these links reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (label[u] != label[v]).any():
        x, y = label[u], label[v]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # x and y are roots here
        while (label[label] != label).any():
            label = label[label]
    leaf = label != np.arange(len(nodes))
    return nodes[label[leaf]], nodes[leaf]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def contracted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        root, node = star_forest(table["a"].to_numpy(), table["b"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array(node, pa.int64())], ["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= AT_ONCE:
            yield contracted(held)
            held, rows = [], 0
    if rows:
        yield contracted(held)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest node it sees; may repeat edges."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its smaller neighbours and itself on the smallest of them. edges: a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    return edges.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node but the roots hangs on one root. edges: distinct."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("hangs")), F.struct(F.col("b").alias("node"), F.lit(1).alias("hangs")))
    each = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.hangs").alias("on"), F.min("e.hangs").alias("leaf"))
    return each.where("on > 1 or (on = 1 and leaf = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes but the roots; root is the smallest node of the component. links: columns a and b, longs.

    Each task first contracts the links that it reads, AT_ONCE at a time, to stars (a combiner: reach stays the same). Each round
    writes its edges; it ends when they are stars (O(log^2 n) rounds).
    """
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    paths: list[str] = []
    edges = scratch.written(ordered.mapInArrow(_stars, "a long, b long").distinct(), "edges", paths)
    while not _are_stars(edges):
        near = edges.mapInArrow(_stars, "a long, b long")
        edges = scratch.written(_small_star(_large_star(near)), "edges", paths)
        scratch.deleted(links.sparkSession, paths.pop(0))
    scratch.released(links.sparkSession)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
