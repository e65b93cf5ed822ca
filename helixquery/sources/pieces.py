"""Plain FASTA of any size as pieces of records.

Spark's text source cuts files into blocks by bytes; a line belongs to the block in which it begins. A task reads a block's
lines and gives stretches of normalised bases, each with the header in the block that it follows (none: it goes on from
the block before). What a block carries over (its last record and that record's bases so far) is a running sum over a file's
blocks, a small table, and joins the stretches afterwards. So a record that is longer than a block is read by several
tasks, and no file or record is ever one row.

Files are read twice: once for the blocks' sums, once for the stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixquery.functions import codes as C
from helixquery.sources.files import FASTA

#: Bases of a piece without its overlap.
PIECE = 1 << 20
#: Upper case, U as T, ambiguity codes as N; the rest goes.
_KEPT = b"ACGTNURYSWKMBDHV"
_AS = bytes.maketrans(_KEPT + _KEPT.lower(), b"ACGTNTNNNNNNNNNN" * 2)
_GONE = bytes(b for b in range(256) if b not in _KEPT + _KEPT.lower())

BLOCK = "path string, block long, heads long, last_id string, lead string, lead_bases long, last_bases long"
STRETCH = "path string, block long, head_no long, id string, at long, sequence string, bases long, open boolean"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    glob = "*.{" + ",".join([*FASTA, *(x.upper() for x in FASTA)]) + "}"
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str | None, bytes]]:
    """(path, block, header or None, bases) in the order of the lines: a header, or bases up to the next one or the batch's end."""
    for batch in batches:
        values = pc.fill_null(pc.ascii_trim_whitespace(batch.column(2)), "")
        raw, offsets = C.flat(values)
        first = np.zeros(len(values), dtype=np.uint8)
        full = offsets[1:] > offsets[:-1]
        first[full] = raw[offsets[:-1][full]]
        blocks = batch.column(1).to_numpy()
        paths = batch.column(0).dictionary_encode()
        which = paths.indices.to_numpy()
        new = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (which[1:] != which[:-1]))) if len(blocks) else []
        cuts = sorted({*map(int, new), *np.flatnonzero((first == 62) | (first == 59)).tolist()})  # > and ;
        for a, b in zip(cuts, [*cuts[1:], len(values)], strict=True):
            path, block, start = paths.dictionary[which[a]].as_py(), int(blocks[a]), a
            if first[a] == 62:
                words = bytes(raw[offsets[a] + 1 : offsets[a + 1]]).decode(errors="replace").split()
                yield path, block, words[0] if words else "unknown", b""
            if first[a] in (62, 59):
                start += 1
            yield path, block, None, bytes(raw[offsets[start] : offsets[b]]).translate(_AS, _GONE)


def _sums(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[pa.RecordBatch]:
    """A row for every block."""
    names = ["path", "block", "heads", "last_id", "lead", "lead_bases", "last_bases"]
    now: list | None = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) if x is not None else pa.nulls(1, pa.string()) for x in now], names)

    for path, block, head, bases in _events(batches):
        if now is None or now[:2] != [path, block]:
            if now is not None:
                yield row()
            now = [path, block, 0, None, "", 0, 0]
        if head is not None:
            now[2:4], now[6] = [now[2] + 1, head], 0
        now[6] += len(bases)
        if not now[2]:
            now[4] += bases[: overlap - len(now[4])].decode() if len(now[4]) < overlap else ""
            now[5] += len(bases)
    if now is not None:
        yield row()


def _stretches(batches: Iterator[pa.RecordBatch], overlap: int, size: int) -> Iterator[pa.RecordBatch]:
    names = ["path", "block", "head_no", "id", "at", "sequence", "bases", "open"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    where: tuple | None = None
    head_no, name, at, held = 0, None, 0, bytearray()
    rows: list[tuple] = []

    def put(bases: int, seq: bytes, is_open: bool) -> None:
        rows.append((*where, head_no, name, at, seq.decode(), bases, is_open))

    def pack() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        rows.clear()
        return out

    for path, block, head, bases in _events(batches):
        if (path, block) != where:
            if where is not None:
                put(len(held), bytes(held), True)
            where, head_no, name, at, held = (path, block), 0, None, 0, bytearray()
        if head is not None:
            put(len(held), bytes(held), False)
            head_no, name, at, held = head_no + 1, head, 0, bytearray()
        held += bases
        while len(held) >= size + overlap:
            put(size, bytes(held[: size + overlap]), False)
            at += size
            del held[:size]
            if len(rows) >= 16:
                yield pack()
        if len(rows) >= 1000:
            yield pack()
    if where is not None:
        put(len(held), bytes(held), True)
    if rows:
        yield pack()


def sequence_pieces(spark: SparkSession, path: str, overlap: int = 0, size: int = PIECE, max_bases: int | None = None) -> DataFrame:
    """source_path, record (its number in the file), id, start, sequence, bases and corrupt of all records of all plain FASTA
    files below path.

    A piece has `bases` bases of its own from `start` of its record, and up to `overlap` that follow them (so windows of
    overlap + 1 bases begin in one piece each). max_bases: records with more are one row without a sequence, `corrupt` says so.
    Lines before a file's first header, blank ones and `;` lines are skipped; records without bases have no pieces.
    """
    lines = _lines(spark, path)
    sums = lines.mapInArrow(lambda it: _sums(it, overlap), BLOCK).where("heads > 0 or lead_bases > 0")  # others carry nothing
    order = Window.partitionBy("path").orderBy("block")
    sums = sums.withColumn("part", F.sum((F.col("heads") > 0).cast("long")).over(order)).withColumn("records", F.sum("heads").over(order))
    inner = Window.partitionBy("path", "part").orderBy("block")
    sums = sums.withColumn("so_far", F.sum("last_bases").over(inner)).withColumn("open_id", F.first("last_id").over(inner))
    follow = F.collect_list(F.struct("lead", (F.col("heads") > 0).alias("ended"))).over(order.rowsBetween(1, max(1, overlap)))
    joined = F.aggregate(follow, F.struct(F.lit("").alias("s"), F.lit(False).alias("ended")), lambda t, x: F.when(t.ended, t).otherwise(F.struct(F.concat(t.s, x.lead).alias("s"), x.ended.alias("ended"))), lambda t: F.left(t.s, F.lit(overlap)))
    carried = sums.select("path", "block", F.lag("open_id").over(order).alias("open_id"), F.coalesce(F.lag("so_far").over(order), F.lit(0)).alias("so_far"), F.coalesce(F.lag("records").over(order), F.lit(0)).alias("before"), joined.alias("tail"))
    each = lines.mapInArrow(lambda it: _stretches(it, overlap, size), STRETCH).where("bases > 0").join(carried, ["path", "block"])
    goes_on = F.col("head_no") == 0
    sequence = F.when(F.col("open"), F.concat("sequence", "tail")).otherwise(F.col("sequence"))
    out = each.select(
        F.col("path").alias("source_path"),
        (F.col("before") + F.col("head_no") - 1).alias("record"),
        F.when(goes_on, F.col("open_id")).otherwise(F.col("id")).alias("id"),
        F.when(goes_on, F.col("so_far") + F.col("at")).otherwise(F.col("at")).alias("start"),
        sequence.alias("sequence"),
        "bases",
        F.lit(None).cast("string").alias("corrupt"),
    ).where("record >= 0")
    if max_bases is None:
        return out
    long = out.groupBy("source_path", "record", "id").agg(F.sum("bases").alias("bases")).where(F.col("bases") > max_bases)
    errors = long.select("source_path", "record", "id", F.lit(None).cast("long").alias("start"), F.lit(None).cast("string").alias("sequence"), "bases", F.lit(f"more than {max_bases} bases").alias("corrupt"))
    return out.join(long, ["source_path", "record"], "left_anti").select(out.columns).unionByName(errors)
