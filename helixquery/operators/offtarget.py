"""Approximate matching of guides on both strands, and distances between guide sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixquery.functions import codes as C
from helixquery.functions import sequences as S
from helixquery.operators import ordered
from helixquery.operators.kmers import packed_windows, pieces
from helixquery.storage import stored

LENGTH, SEED, OFFSETS = 20, 5, [0, 5, 10, 15]
#: Different seeds of SEED bases.
SEEDS = 4**SEED
#: Guides up to this number travel with every task, 16 bytes each and 32 for their seeds.
FEW_GUIDES = 20_000
#: Pairs of windows and probes that are compared at once.
PAIRS = 1 << 21


def valid_guides(guides: DataFrame, seq: str) -> DataFrame:
    """guide (first 20 bases, upper case), each once; an error if no row has a valid one."""
    g = guides.select(F.upper(F.left(F.col(seq), F.lit(LENGTH))).alias("guide")).where(F.col("guide").rlike(f"^[ACGT]{{{LENGTH}}}$")).distinct()
    if g.isEmpty():
        raise ValueError("no valid guide: each needs 20 letters of ACGT")
    return g


def prepared_guides(guides: DataFrame, seq: str, order: str, most: int = 0) -> DataFrame:
    """guide, idx and valid: the first `most` rows by `order` (0: all), then each sequence once at its first place. idx counts those
    from 0; guides that aren't 20 bases of ACGT keep their number and aren't valid. An error if none is."""
    rows = guides.select(F.col(order).alias("at"), F.upper(F.left(F.col(seq), F.lit(LENGTH))).alias("guide"))
    rows = rows.orderBy("at", "guide").limit(most) if most else rows
    first = ordered.placed(rows.groupBy("guide").agg(F.min("at").alias("at")), [F.col("at").asc(), F.col("guide").asc()])
    out = ordered.plain(ordered.row_numbers(first, "idx")).select("guide", "idx", F.coalesce(F.col("guide").rlike(f"^[ACGT]{{{LENGTH}}}$"), F.lit(False)).alias("valid"))
    if out.where("valid").isEmpty():
        raise ValueError("no valid guide: each needs 20 letters of ACGT")
    return out


def _probes(guides: DataFrame) -> DataFrame:
    """guide, strand, probe, probe_bits: both strands of every guide."""
    both = guides.select("guide", F.lit("+").alias("strand"), F.col("guide").alias("probe"))
    both = both.union(guides.select("guide", F.lit("-"), S.reverse_complement(F.col("guide"))))
    return both.select("*", S.packed(F.col("probe")).alias("probe_bits"))


def _seed(code, o: int):
    return F.shiftright(code, 2 * (LENGTH - SEED - o)).bitwiseAND(SEEDS - 1)


def _found_in_tasks(records: DataFrame, id_col: str, seq: str, probes: DataFrame, max_mismatches: int, start: str | None) -> DataFrame:
    """Windows near a probe: id_col, pos, code, no. Every task has the probes, sorted by their seed of each offset."""
    kind = records.schema[id_col].dataType.simpleString()
    bits = np.array([r["probe_bits"] for r in probes.select("probe_bits", "no").orderBy("no").collect()], dtype=np.int64).view(np.uint64)  # FEW_GUIDES bounds it
    tables = {}
    for o in OFFSETS:
        seed = (bits >> np.uint64(2 * (LENGTH - SEED - o)) & np.uint64(SEEDS - 1)).astype(np.int64)
        tables[o] = np.argsort(seed, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(seed, minlength=SEEDS))))

    def near(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and probes within the distance, a pair at its first common seed."""
        found = []
        for o in OFFSETS:
            by, starts = tables[o]
            shift = np.uint64(2 * (LENGTH - SEED - o))
            seed = (code >> shift & np.uint64(SEEDS - 1)).astype(np.int64)
            n = starts[seed + 1] - starts[seed]
            until = np.cumsum(n)
            a = 0
            while a < len(code):  # PAIRS at a time
                b = max(a + 1, int(np.searchsorted(until, (until[a - 1] if a else 0) + PAIRS, side="right")))
                window = np.repeat(np.arange(a, b), n[a:b])
                probe = by[np.repeat(starts[seed[a:b]] - np.concatenate(([0], np.cumsum(n[a:b])[:-1])), n[a:b]) + np.arange(len(window))]
                x = code[window] ^ bits[probe]
                ok = np.flatnonzero(np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)) <= max_mismatches)
                for earlier in OFFSETS[: OFFSETS.index(o)]:
                    ok = ok[(x[ok] >> np.uint64(2 * (LENGTH - SEED - earlier)) & np.uint64(SEEDS - 1)) != 0]
                found.append((window[ok], probe[ok]))
                a = b
        return np.concatenate([w for w, _ in found]), np.concatenate([p for _, p in found])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = C.flat(batch.column(1))
            for a, _, code, clean in C.steps(raw, offsets, LENGTH):
                at = np.flatnonzero(clean)
                window, probe = near(code[at]) if len(at) else (at, at)
                if len(window):
                    row, pos = C.located(offsets, a + at[window])
                    pos = pos + batch.column(2).to_numpy()[row]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(pos), C.as_long(code[at[window]]), pa.array(probe)], names=[id_col, "pos", "code", "no"])

    return pieces(records, id_col, seq, start).mapInArrow(scan, f"`{id_col}` {kind}, pos long, code long, no long")


def off_targets(records: DataFrame, id_col: str, seq: str, guides: DataFrame, max_mismatches: int, start: str | None = None) -> DataFrame:
    """guide, strand, id_col, pos, mismatches, mm_positions of all windows within max_mismatches of a guide.

    Four seeds of five bases: three mismatches leave one of them whole. Up to FEW_GUIDES guides are in every task, which looks
    windows' seeds up and computes distances in numpy; more meet the windows in an equi-join on (offset, seed). guides: as
    valid_guides() gives them; start: as for kmers.packed_windows.
    """
    if not 0 <= max_mismatches <= 3:
        raise ValueError("max_mismatches must be 0 to 3")
    probes = _probes(guides)
    if guides.count() <= FEW_GUIDES:
        probes = probes.withColumn("no", F.row_number().over(Window.orderBy("guide", "strand")).cast("long") - 1)
        near = _found_in_tasks(records, id_col, seq, probes, max_mismatches, start).join(F.broadcast(probes), "no")
        near = near.withColumn("mismatches", S.hamming(F.col("code"), F.col("probe_bits")))
    else:
        seeds = lambda code: F.array(*(F.struct(F.lit(o).alias("offset"), _seed(code, o).alias("seed")) for o in OFFSETS))
        at = packed_windows(records, id_col, seq, LENGTH, start=start).select(id_col, "pos", "code", F.inline(seeds(F.col("code"))))
        at = at.join(probes.select("*", F.inline(seeds(F.col("probe_bits")))), ["offset", "seed"])
        near = at.withColumn("mismatches", S.hamming(F.col("code"), F.col("probe_bits"))).where(F.col("mismatches") <= max_mismatches)
        first = F.coalesce(*(F.when(_seed(F.col("code"), o) == _seed(F.col("probe_bits"), o), F.lit(o)) for o in OFFSETS))
        near = near.where(F.col("offset") == first)  # the pair once, at its first common seed: no shuffle to tell doubles
    return near.select("guide", "strand", id_col, "pos", "mismatches", S.mismatch_positions(S.unpacked(F.col("code"), LENGTH), F.col("probe"), LENGTH).alias("mm_positions"))


#: Bases of a target and of a published guide that the first step looks at: four seeds of four.
HEAD, HEAD_SEED = 16, 4
#: Targets and published guides of one block.
BLOCK = 2000


def _distance(a, b):
    """Differing bases of the common prefix, and what the longer has more."""
    n = F.least(F.length(a), F.length(b))
    same = F.zip_with(F.split(F.left(a, n), ""), F.split(F.left(b, n), ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) + F.abs(F.length(a) - F.length(b))


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("target").agg(F.min(F.struct("d", "id", "strand")).alias("b"))


def _block_minima(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Each target's nearest published guide of a block: distances of all pairs, a target at a time."""
    if not len(left) or not len(right):
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("target", "d", "id", "strand")})
    right = right.sort_values(["published_id", "strand"], kind="stable")
    sizes = right["seq"].str.len().to_numpy()
    width = int(sizes.max())
    table = np.frombuffer("".join(x.ljust(width, "\0") for x in right["seq"]).encode(), dtype=np.uint8).reshape(-1, width)
    ids, strands, out = right["published_id"].to_numpy(), right["strand"].to_numpy(), []
    inside = np.arange(width) < sizes[:, None]
    for target in left["target"]:
        t = np.frombuffer(target.encode(), dtype=np.uint8)[:width]
        m = len(t)
        d = ((table[:, :m] != t) & inside[:, :m]).sum(axis=1) + np.abs(sizes - len(target))
        k = int(d.argmin())  # the first of the least: ids and strands ascend
        out.append((target, int(d[k]), ids[k], strands[k]))
    return pd.DataFrame(out, columns=["target", "d", "id", "strand"])


def novelty(targets: DataFrame, published: DataFrame, max_mismatches: int) -> DataFrame:
    """Each target's least distance to the published guides on either strand, the first nearest, and whether it is new.

    targets: target; published: published_id, seq. Different lengths: the common prefix is compared and the rest of the
    longer counts as mismatches. Guides within three mismatches meet in an equi-join on seeds of their heads, and the
    targets that they settle leave; the others meet the published guides by blocks, of which each gives one row a target.
    """
    clean = published.select("published_id", F.translate("seq", "uU", "tT").alias("seq")).where(F.col("seq").rlike("^[ACGT]+$"))
    both = clean.select("published_id", "seq", F.lit("+").alias("strand")).union(clean.select("published_id", S.reverse_complement(F.col("seq")), F.lit("-")))
    both = stored(both, "published")
    good = targets.select(F.translate(F.upper("target"), "U", "T").alias("target")).where(F.col("target").rlike("^[ACGT]+$")).distinct()
    good = stored(good, "novelty-targets")
    head = lambda c: F.array(*(F.struct(F.lit(o).alias("o"), F.substr(c, F.lit(o + 1), F.lit(HEAD_SEED)).alias("seed")) for o in range(0, HEAD, HEAD_SEED)))
    near = good.where(F.length("target") >= HEAD).select("target", F.inline(head(F.col("target"))))
    near = near.join(both.where(F.length("seq") >= HEAD).select("*", F.inline(head(F.col("seq")))), ["o", "seed"])
    near = near.select("target", _distance(F.col("target"), F.col("seq")).alias("d"), F.col("published_id").alias("id"), "strand").where("d <= 3")
    settled = stored(_least(near), "settled")
    # shorter published guides may be as near without a whole head: a settled target meets them as well
    short = both.where(F.length("seq") < HEAD)
    open_ = good if not short.isEmpty() else good.join(settled, "target", "left_anti")
    kind = both.schema["published_id"].dataType.simpleString()
    n, m = open_.count(), both.count()
    a, b = max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))
    deal = lambda rows, key, own, others, mine, theirs: rows.withColumn(mine, F.pmod(F.xxhash64(*key), F.lit(own)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    left = deal(open_.select("target"), ["target"], a, b, "tb", "pb")
    right = deal(both, ["published_id", "strand", "seq"], b, a, "pb", "tb")
    pairs = left.groupBy("tb", "pb").cogroup(right.groupBy("tb", "pb")).applyInPandas(lambda x, y: _block_minima(x, y), f"target string, d int, id {kind}, strand string")
    found = settled.unionByName(_least(pairs)).groupBy("target").agg(F.min("b").alias("b"))
    out = good.join(found, "target", "left")
    return out.select("target", F.col("b.d").alias("distance"), F.col("b.id").alias("closest"), F.col("b.strand").alias("strand"), F.coalesce(F.col("b.d") > max_mismatches, F.lit(True)).alias("is_novel"))
