"""Shards by a Feistel permutation of global row numbers.

Rows get gapless numbers 0..N-1 in a fixed order of their contents. A permutation of 0..N-1 then
gives each row its place in the shuffled order; the place alone tells shard (place mod shards) and
slot (place div shards), so shard sizes differ by one row at most, slots have no gaps, and anyone
who knows N and the seed can compute either way where a row number went.

The permutation is a Feistel network over pairs (l, r) with l < a, r < b, a = ceil(sqrt N),
b = ceil(N / a): the halves are added modulo their own size, which keeps the domain within
sqrt(N) of N. Images at or above N walk the cycle until they fall below N.

Defined results: null texts have size 16 and the checksum of the empty string; null and repeated
ids are rows like others (equal rows are interchangeable); an empty table gives an empty result;
more columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixquery.llm import scratch

#: Cells of the row numbering: one row each in the table of offsets, whatever the input.
CELLS = 4096
ROUNDS = 6
#: Steps of the cycle walk in one expression; a row that needs more fails the job.
WALKS = 64


def round_value(x: Column, r: Column, seed: int) -> Column:
    """48 pseudo-random bits of a half and a round."""
    return F.shiftrightunsigned(F.xxhash64(x, r, F.lit(seed).cast("long")), 16)


def feistel(x: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """A permutation of 0..n-1, or its inverse; n and seed are all it depends on."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    la, lb = F.lit(a).cast("long"), F.lit(b).cast("long")
    order = list(range(ROUNDS))[:: -1 if inverse else 1]
    sign = -1 if inverse else 1

    def step(s: Column, r: Column) -> Column:
        left, right = F.floor(s / lb).cast("long"), s % lb
        odd = r % 2 == 1
        new_left = F.when(odd, left).otherwise(F.pmod(left + sign * (round_value(right, r, seed) % la), la))
        new_right = F.when(odd, F.pmod(right + sign * (round_value(left, r, seed) % lb), lb)).otherwise(right)
        return new_left * lb + new_right

    rounds = F.array(*[F.lit(r).cast("long") for r in order])
    once = lambda s: F.aggregate(rounds, s, step)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(x), lambda s, _: F.when(s < n, s).otherwise(once(s)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk not ended")).cast("long"))


def numbered(rows: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """rows with gapless numbers from 0, fixed by the values of `order`, without one task seeing all rows.

    Rows fall into CELLS cells by a hash of `order`; a cell's rows are numbered by themselves, after
    the rows of all cells before it. Only the CELLS counts meet in one place.
    """
    h = F.xxhash64(*order)
    celled = rows.withColumn("__sh_h", h).withColumn("__sh_cell", F.pmod(F.col("__sh_h"), F.lit(CELLS)))
    counts = celled.groupBy("__sh_cell").agg(F.count(F.lit(1)).alias("__sh_n"))
    before = counts.select("__sh_cell", (F.sum("__sh_n").over(Window.orderBy("__sh_cell")) - F.col("__sh_n")).alias("__sh_before"))
    within = F.row_number().over(Window.partitionBy("__sh_cell").orderBy("__sh_h", *order)) - 1
    out = celled.withColumn("__sh_in", within).join(F.broadcast(before), "__sh_cell")  # CELLS rows at most
    return out.withColumn(name, F.col("__sh_before") + F.col("__sh_in")).drop("__sh_h", "__sh_cell", "__sh_in", "__sh_before")


def sharded(docs: DataFrame, shards: int = 40, seed: int = 1, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, size, text_crc32, row_number, place, shard, slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long")
    rows = scratch.written(docs.select(id_col, size.alias("size"), F.crc32(body).alias("text_crc32")), "shard-rows")
    n = rows.count()
    out = numbered(rows, [id_col, "size", "text_crc32"])
    out = out.withColumn("place", feistel(F.col("row_number"), n, seed) if n else F.lit(0).cast("long"))
    return out.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.floor(F.col("place") / shards).cast("long"))
