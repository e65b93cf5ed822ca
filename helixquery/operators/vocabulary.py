"""Vocabulary, and the graph of terms that occur together."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixquery.operators import ordered, sections
from helixquery.storage import dropped, released, small_batches, stored

#: Tokens of a block of a unit.
BLOCK = 256
#: Pairs that a task makes before it adds equal ones up.
PAIRS = 1_000_000
#: Pairs of all units that the heaviest terms may make at once; the terms after these follow by steps.
LEVEL = 64_000_000
#: Bits that tell tasks which terms are closed.
BITS = 1 << 24
#: Open edges of the greedy choice that one task ends, and the share of the open ones that is chosen among itself first.
FEW_EDGES, PREFIX = 2_000_000, 16

#: Words of questions that say nothing: fixed values.
STOPWORDS = ["how", "does", "where", "what", "which", "when", "why", "is", "are", "the", "a", "an", "to", "and", "or", "in", "on", "for", "with", "from", "of", "it", "this", "that"]
#: Hints added to every question where the caller gives none: fixed values.
HINTS = ["rabbit", "erlang", "gen_server", "handle_call", "handle_cast", "handle_info"]


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))


def subwords(token: Column) -> Column:
    """Of a name: its parts between underscores; without any, its parts that begin with a capital; in lower case."""
    camel = F.split(F.regexp_replace(token, "([A-Z])", "\n$1"), "\n")
    return F.transform(F.when(token.contains("_"), F.split(token, "_")).otherwise(camel), lambda x: F.lower(x))


def terms(docs: DataFrame, text: str) -> DataFrame:
    """The distinct terms of more than one character."""
    words = docs.select(F.explode(identifiers(F.col(text))).alias("token")).distinct()
    return words.select(F.explode(subwords(F.col("token"))).alias("term")).where(F.length("term") > 1).distinct()


def with_prefix(vocabulary: DataFrame, prefix: str, most: int) -> DataFrame:
    return vocabulary.where(F.col("term").startswith(prefix)).orderBy("term").limit(most)


def looked_up(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (column term, each once) with whether the vocabulary has each (exactly, in its case)."""
    return asked.select("term").distinct().join(vocabulary.select("term", F.lit(True).alias("found")), "term", "left").fillna(False, ["found"])


def section_tokens(text: Column) -> Column:
    """Distinct tokens of a section: whole names and their parts in lower case, of two bytes or more; Unicode letters count."""
    names = F.regexp_extract_all(text, F.lit(r"([\p{L}_][\p{L}\p{N}_]*)"), F.lit(1))
    parts = F.flatten(F.transform(names, lambda x: F.transform(F.concat(F.split(F.regexp_replace(x, r"(\p{Lu})", "\n$1"), "[\n_]"), F.array(x)), lambda y: F.lower(y))))
    return F.sort_array(F.array_distinct(F.filter(parts, lambda x: F.octet_length(x) >= 2)))


def pair_counts(units: DataFrame, tokens: str) -> DataFrame:
    """term_a < term_b and in how many units both occur (n).

    Tokens (sorted, distinct) are cut into blocks, and a unit gives a row for each two of its blocks, which are dealt over all
    tasks: a unit's pairs are made in as many tasks as it has pairs of blocks, and summed there before they are shuffled.
    """
    starts = F.sequence(F.lit(1), F.size("all"), F.lit(BLOCK))
    rows = units.where(F.size(tokens) > 1).select(F.explode(F.array(F.col(tokens))).alias("all"))
    rows = rows.select("all", F.explode(starts).alias("i")).select("*", F.explode(F.sequence("i", F.size("all"), F.lit(BLOCK))).alias("j"))
    rows = rows.select(F.slice("all", F.col("i"), F.lit(BLOCK)).alias("left"), F.slice("all", F.col("j"), F.lit(BLOCK)).alias("right"))
    rows = rows.repartition(F.xxhash64("left", "right"))
    rows = rows.select(F.explode("left").alias("term_a"), "right").select("term_a", F.explode("right").alias("term_b")).where("term_a < term_b")
    return rows.groupBy("term_a", "term_b").agg(F.count(F.lit(1)).alias("n"))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a batch's lists and the lists' lengths."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _dealt(units: DataFrame, buckets: int) -> DataFrame:
    """Of units (tokens, then counts): for each batch and each two buckets of numbers, the tokens that its units have in both."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths = _flat(batch.column(0))
            flat, n = flat.astype(np.int32), batch.num_rows
            unit = np.repeat(np.arange(n), lengths)
            counts = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:]], axis=1)
            at = [np.flatnonzero(flat % buckets == i) for i in range(buckets)]
            sizes = [np.bincount(unit[x], minlength=n) for x in at]
            for tile, (i, j) in enumerate(combinations_with_replacement(range(buckets), 2)):
                met = (sizes[i] > 0) & (sizes[j] > 0) if i < j else sizes[i] > 1
                if met.any():
                    sides = [(flat[at[x][met[unit[at[x]]]]], sizes[x][met].astype(np.int32)) for x in sorted({i, j})]
                    row = [y.tobytes() for side in sides for y in side] + [b""] * (4 - 2 * len(sides)) + [counts[met].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), *(pa.array([y], pa.binary()) for y in row)], ["tile", "left", "left_n", "right", "right_n", "counts"])

    return units.mapInArrow(deal, "tile int, left binary, left_n binary, right binary, right_n binary, counts binary")


def _tile_sums(rows: list[list[bytes]], kinds: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Both ends of a tile's pairs and the sums of their units' counts. Some `most` pairs at a time are made, those of the same left ends."""
    read = lambda c, kind: np.concatenate([np.frombuffer(r[c], dtype=kind) for r in rows])
    left, left_n = read(0, np.int32), read(1, np.int32)
    itself = not any(r[2] for r in rows)  # a bucket with itself: a unit's tokens are in order, and each meets those after it
    right, right_n = (left, left_n) if itself else (read(2, np.int32), read(3, np.int32))
    counts, count_of = np.unique(read(4, np.int64).reshape(-1, kinds), axis=0, return_inverse=True)
    unit, ends = np.repeat(np.arange(len(left_n), dtype=np.int32), left_n), np.cumsum(right_n, dtype=np.int32)
    first = np.arange(1, len(left) + 1, dtype=np.int32) if itself else (ends - right_n)[unit]
    meets = ends[unit] - first
    order = np.argsort(left, kind="stable").astype(np.int32)
    order = order[meets[order] > 0]
    b_of = np.unique(right)
    b_at = np.searchsorted(b_of, right).astype(np.int32)
    a_of, starts = np.unique(left[order], return_index=True)
    upto = np.concatenate([[0], np.cumsum(meets[order], dtype=np.int64)])
    starts = np.append(starts, len(order))
    k = len(counts)

    def summed(a: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys (left end's number beyond a, right end's number) and sums of the entries from begin to end."""
        part = order[begin:end]
        n = meets[part]
        a_at = np.searchsorted(a_of, left[part]) - a
        kind = np.uint32 if (int(a_at[-1]) + 1) * len(b_of) * k < 2**32 else np.int64
        place = np.repeat(first[part] - (np.cumsum(n, dtype=np.int64) - n), n)
        place += np.arange(len(place))
        keys = b_at[place].astype(kind)
        keys *= kind(k)
        keys += np.repeat((a_at * (len(b_of) * k) + count_of[unit[part]]).astype(kind), n)
        keys.sort()
        pair = keys // kind(k) if k > 1 else keys
        runs = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        if k == 1:
            return pair[runs].astype(np.int64), np.diff(np.append(runs, len(pair)))[:, None] * counts
        which = keys - pair * kind(k)
        return pair[runs].astype(np.int64), np.stack([np.add.reduceat(counts[which, c], runs) for c in range(kinds)], axis=1)

    a = 0
    while a < len(a_of):
        stop = max(int(np.searchsorted(upto[starts[1:]], upto[starts[a]] + most, side="right")), a + 1)
        cuts = [int(starts[a]), int(starts[stop])]
        if stop == a + 1:  # perhaps one left end that has more by itself
            steps = np.arange(upto[cuts[0]] + most, upto[cuts[1]], most)
            cuts = sorted({*cuts, *(cuts[0] + np.searchsorted(upto[cuts[0] : cuts[1]], steps)).tolist()})
        found, sums = summed(a, cuts[0], cuts[1])
        for begin, end in zip(cuts[1:], cuts[2:]):
            more, x = summed(a, begin, end)
            found, at = np.unique(np.concatenate([found, more]), return_inverse=True)
            both = np.zeros((len(found), kinds), dtype=np.int64)
            np.add.at(both, at, np.concatenate([sums, x]))
            sums = both
        yield a_of[a + found // len(b_of)].astype(np.int64), b_of[found % len(b_of)].astype(np.int64), sums
        a = stop


def number_pairs(units: DataFrame, tokens: str, weights: dict[str, float], least: float = 0.0, below: float = float("inf"), buckets: int = 8) -> DataFrame:
    """term_a < term_b and the sums of the units' columns in `weights`, of the pairs whose weight (each sum times the value beside its
    column's name) is `least` or more and less than `below`. Tokens (sorted, distinct) are numbers below 2^31.

    No row is shuffled or written for a pair of a unit: numbers fall into buckets, a task gets for two of them the tokens that each unit has
    there, and makes, sums and weighs their pairs by itself. A token travels once for each bucket, whatever it meets.
    """
    rows = _dealt(units.where(F.size(tokens) > 1).select(tokens, *weights), buckets)
    rows = rows.repartitionById(buckets * (buckets + 1) // 2, F.col("tile")).drop("tile")
    factors = np.array(list(weights.values()), dtype=np.float64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c[i].as_py() for c in batch.columns] for batch in batches for i in range(batch.num_rows)]
        for x, y, sums in _tile_sums(held, len(factors), PAIRS) if held else ():
            weight = sums @ factors
            kept = (weight >= least) & (weight < below)
            ends = [np.minimum(x, y)[kept], np.maximum(x, y)[kept]]
            columns = [*ends, *(np.ascontiguousarray(c) for c in sums[kept].T)]
            for i in range(0, len(ends[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], ["term_a", "term_b", *weights])

    return rows.mapInArrow(add, f"term_a long, term_b long, {', '.join(f'{w} long' for w in weights)}")


def cooccurrence(sections: DataFrame, files: DataFrame, min_weight: float = 1.0) -> DataFrame:
    """term_a, term_b, weight, section_count, file_count. Both inputs: a column `tokens` of sorted distinct tokens."""
    s = pair_counts(sections, "tokens").withColumnRenamed("n", "section_count")
    f = pair_counts(files, "tokens").withColumnRenamed("n", "file_count")
    both = s.join(f, ["term_a", "term_b"], "full").fillna(0, ["section_count", "file_count"])
    both = both.withColumn("weight", (3.0 * F.col("section_count") + F.col("file_count")).cast("double"))
    return both.where(F.col("weight") >= min_weight)


def _greedy(edges: pd.DataFrame, k: int) -> pd.DataFrame:
    """The plain choice over a bounded number of edges, with what their ends have kept before."""
    edges = edges.sort_values(["weight", "tie", "term_a", "term_b"], ascending=[False, True, True, True])
    ends, at = np.unique(np.concatenate([edges["term_a"], edges["term_b"]]), return_inverse=True)
    used = np.zeros(len(ends), dtype=np.int64)
    used[at] = np.concatenate([edges["used_term_a"], edges["used_term_b"]])
    left, n = (k - used).tolist(), len(edges)
    kept = []
    for i, (a, b) in enumerate(zip(at[:n].tolist(), at[n:].tolist(), strict=True)):
        if left[a] > 0 and left[b] > 0:
            left[a] -= 1
            left[b] -= 1
            kept.append(i)
    return edges[["term_a", "term_b"]].iloc[kept]


def _prefix(edges: DataFrame, left: int) -> DataFrame:
    """The first edges in the order of the choice: about a PREFIX-th of them, FEW_EDGES at least. Where the cut falls into edges of
    one weight, it is a value of their hash."""
    wanted = max(FEW_EDGES * 4 // 5, left // PREFIX)  # hashes are even only in the mean
    by = edges.groupBy("weight").agg(F.count(F.lit(1)).alias("n"))
    by = by.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("weight"))))  # a row per weight
    cut = by.where(F.col("upto") > wanted).orderBy(F.desc("weight")).first()
    if cut is None:
        return edges
    share = (wanted - (cut["upto"] - cut["n"])) / cut["n"]
    place = min(int(share * 2.0**64) - 2**63, 2**63 - 1)
    return edges.where((F.col("weight") > cut["weight"]) | ((F.col("weight") == cut["weight"]) & (F.col("tie") <= place)))


def _tied(edges: DataFrame) -> DataFrame:
    return edges.select("term_a", "term_b", "weight", F.xxhash64("term_a", "term_b").alias("tie"))


def _open(edges: DataFrame, used: DataFrame | None, k: int) -> DataFrame:
    """The edges between ends that are not full."""
    if used is not None:
        full = used.where(F.col("used") >= k)
        for end in ("term_a", "term_b"):
            edges = edges.join(full.select(F.col("at").alias(end)), end, "left_anti")
    return edges.select("term_a", "term_b", "weight")


def _used(used: DataFrame | None, kept: DataFrame) -> DataFrame:
    each = kept.select(F.explode(F.array("term_a", "term_b")).alias("at"), F.lit(1).alias("used"))
    each = each if used is None else each.union(used)
    out = stored(each.groupBy("at").agg(F.sum("used").cast("int").alias("used")), "used-terms")
    dropped(used)
    return out


def _in_one(edges: DataFrame, used: DataFrame | None, k: int) -> DataFrame:
    for end in ("term_a", "term_b"):
        known = edges.withColumn("used", F.lit(0)).select(F.col("term_a").alias(end), "used").where("false") if used is None else used.select(F.col("at").alias(end), "used")
        edges = edges.join(known.withColumnRenamed("used", f"used_{end}"), end, "left").fillna(0, [f"used_{end}"])
    kind = edges.schema["term_a"].dataType.simpleString()
    return stored(edges.groupBy(F.lit(0).alias("one")).applyInPandas(lambda x: _greedy(x, k), f"term_a {kind}, term_b {kind}"), "kept-edges")


def _one_round(edges: DataFrame, used: DataFrame | None, k: int) -> DataFrame:
    """The edges that are among the heaviest at both ends."""
    order = [F.desc("weight"), "tie", "term_a", "term_b"]
    ends = edges.select(F.col("term_a").alias("at"), *edges.columns).union(edges.select("term_b", *edges.columns))
    best = ends.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(*order))).where(F.col("rank") <= k)
    if used is not None:
        best = best.join(used, "at", "left").where(F.col("rank") <= k - F.coalesce("used", F.lit(0)))
    return stored(best.groupBy("term_a", "term_b").agg(F.count(F.lit(1)).alias("ends")).where("ends = 2").select("term_a", "term_b"), "kept-edges")


def _chosen(edges: DataFrame, used: DataFrame | None, k: int) -> tuple[list[DataFrame], DataFrame | None]:
    """What top_k keeps of written edges whose ends have kept as many as `used` has, and how many they have kept then."""
    open_, kept = edges, []
    while (left := open_.count()) > 0:
        tied = _tied(open_)
        now = tied if left <= FEW_EDGES else _prefix(tied, left)
        size = left if left <= FEW_EDGES else now.count()
        if not size:  # no hash below the cut
            now, size = tied, left
        whole = size == left
        last = None if whole else now.agg(F.min("weight").alias("w"), F.max_by("tie", F.struct(-F.col("weight"), "tie")).alias("t")).first()
        before = None
        while size > FEW_EDGES:
            kept.append(_one_round(now, used, k))
            used = _used(used, kept[-1])
            rest = stored(_open(now.join(kept[-1], ["term_a", "term_b"], "left_anti"), used, k), "prefix-edges")
            dropped(before)
            before, now, size = rest, _tied(rest), rest.count()
        if size:
            kept.append(_in_one(now, used, k))
            used = _used(used, kept[-1])
        dropped(before)
        if whole:
            break
        later = (F.col("weight") < last["w"]) | ((F.col("weight") == last["w"]) & (F.col("tie") > last["t"]))
        rest = stored(_open(tied.where(later), used, k), "open-edges")
        if open_ is not edges:
            dropped(open_)
        open_ = rest
    if open_ is not edges:
        dropped(open_)
    return kept, used


def top_k(edges: DataFrame, k: int) -> DataFrame:
    """The edges that a greedy choice keeps: heaviest first (ties by a hash of both ends: in the order of the terms, one choice
    would wait for another through the whole vocabulary), as long as both ends have fewer than k kept ones.

    By prefixes of that order: the first edges are chosen among themselves, since no later one can change that, and then the edges
    at full ends are closed, which are most of the rest. A prefix of more than FEW_EDGES goes by rounds: an edge that is among
    the heaviest open ones at both its ends, as many as these may still keep, is one that the greedy choice keeps, whatever else
    it does. Each round keeps all of those. A term's first k edges are found before the shuffle, so a term with very many edges
    is no task's work. The last FEW_EDGES open edges of a prefix are one task's work.
    """
    kept, _ = _chosen(stored(edges.select("term_a", "term_b", "weight"), "open-edges"), None, k)
    return edges.join(reduce(DataFrame.union, kept), ["term_a", "term_b"], "left_semi") if kept else edges


def _unit_texts(files: DataFrame) -> DataFrame:
    """text, section_count and file_count of each file's units, its sections and itself. Those of one text are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.int64()], strict=True)], ["text", "section_count", "file_count"])

        for batch in batches:
            rows, size = [], 0
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if content is None:
                    continue
                units: dict[str, list[int]] = {content: [0, 1]}
                for *_, text in sections.cut(path or "", content):
                    units.setdefault(text, [0, 0])[0] += 1
                for text, n in units.items():
                    rows.append((text, *n))
                    size += len(text)
                    if size > 1 << 20:
                        yield packed(rows)
                        rows, size = [], 0
            if rows:
                yield packed(rows)

    return files.select("path", "content").mapInArrow(run, "text string, section_count long, file_count long")


def _closed(used: DataFrame | None, terms: int, k: int) -> np.ndarray:
    """A bit for each term, set where it is full; beyond BITS terms some share one, which is set when all of these are."""
    bits = np.zeros(min(terms, BITS) // 32 + 1, dtype=np.uint32)
    if used is not None:
        full = used.where(F.col("used") >= k).groupBy((F.col("at") % BITS).alias("bit")).agg(F.count(F.lit(1)).alias("n"))
        full = full.where(F.col("n") == F.floor((F.lit(terms - 1) - F.col("bit")) / BITS) + 1)
        words = full.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits")).toArrow()
        bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return bits


def _still(tokens: np.ndarray, closed: np.ndarray, bits: int) -> np.ndarray:
    """Which tokens are not known to be full."""
    at = tokens % bits
    return (closed[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 0


def _volumes(known: DataFrame, closed: np.ndarray) -> dict[int, tuple[int, int]]:
    """For each level: the open tokens of all units at it or above, and the pairs that these make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (tokens, lengths), (levels, _) = _flat(batch.column(0)), _flat(batch.column(1))
            open_ = _still(tokens, closed, BITS)
            unit = np.repeat(np.arange(batch.num_rows), lengths)[open_]
            n = np.bincount(unit * 64 + levels[open_], minlength=batch.num_rows * 64).reshape(-1, 64)
            n = np.cumsum(n[:, ::-1], axis=1)[:, ::-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(n.sum(axis=0)), pa.array((n * (n - 1) // 2).sum(axis=0))], ["level", "tokens", "pairs"])

    found = known.select("tokens", "levels").mapInArrow(run, "level long, tokens long, pairs long").groupBy("level").agg(F.sum("tokens").alias("tokens"), F.sum("pairs").alias("pairs"))
    return {x["level"]: (x["tokens"], x["pairs"]) for x in found.collect()}  # 64 rows


def _candidates(known: DataFrame, closed: np.ndarray, level: int) -> DataFrame:
    """Units with their open tokens of a level or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (tokens, lengths), (levels, _) = _flat(batch.column(0)), _flat(batch.column(1))
            kept = _still(tokens, closed, BITS) & (levels >= level)
            sizes = np.bincount(np.repeat(np.arange(batch.num_rows), lengths)[kept], minlength=batch.num_rows)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens[kept])), *batch.columns[2:]], ["tokens", "section_count", "file_count"])

    return known.select("tokens", "levels", "section_count", "file_count").mapInArrow(run, "tokens array<int>, section_count long, file_count long")


def term_graph(files: DataFrame, min_weight: float = 1.0, k: int = 10) -> DataFrame:
    """term_a, term_b, weight, section_count, file_count: the pruned graph of the terms of files (path, content).

    Terms are numbered in their order, so that pairs are two numbers until the last step. A pair weighs no more than either of its
    terms would by its own numbers of sections and files, so terms below min_weight are left out before pairs are made. Units of
    the same terms (a file of one section, copies) make their pairs once.

    Pairs are made by levels of their weight, the heaviest first: those of a level are among the terms that may weigh as much and
    have fewer than k kept pairs by then. Most frequent terms are full by the time that rarer ones come in, so their pairs with
    these are never made. A level is half or a quarter as heavy as the one before, or as light as makes LEVEL pairs.
    """
    spark, weight = files.sparkSession, {"section_count": 3.0, "file_count": 1.0}
    sums = [F.sum(w).alias(w) for w in weight]
    with small_batches(spark):
        units = stored(_unit_texts(files).select(F.monotonically_increasing_id().alias("unit"), section_tokens(F.col("text")).alias("terms"), *weight), "units")
        each = units.select("unit", *weight, F.explode("terms").alias("term"))
        own = each.groupBy("term").agg(F.sum(3.0 * F.col("section_count") + F.col("file_count")).alias("most"))
        lightest = max(min_weight, 1.0)  # no pair weighs less
        level = F.least(F.greatest(F.floor(F.log2(F.col("most") / lightest) + 1e-9), F.lit(0)), F.lit(63))
        placed = ordered.placed(own.where(F.col("most") >= min_weight).select("term", level.cast("int").alias("level")), [F.col("term").asc()])
        numbers = stored(ordered.plain(ordered.row_numbers(placed, "no")), "term-numbers")
        terms = numbers.count()
        known = each.join(numbers, "term").groupBy("unit", *weight).agg(F.sort_array(F.collect_list(F.struct(F.col("no").cast("int").alias("no"), "level"))).alias("t"))
        known = known.where(F.size("t") > 1).groupBy(F.col("t.no").alias("tokens"), F.col("t.level").alias("levels")).agg(*sums)
        known = stored(known, "known-units")
        dropped(units)
        kept: list[DataFrame] = []
        used, upto, step = None, 64, 1
        while upto > 0:
            released(spark)
            closed = _closed(used, terms, k)
            volumes = _volumes(known, closed)
            if not volumes or not volumes[0][1]:
                break
            upto, above = min([*(x for x in range(upto) if volumes[x][1] <= LEVEL), max(0, upto - step)]), upto
            tokens, pairs = volumes[upto]
            buckets = max(min(8, math.isqrt(pairs // 500_000) + 1), math.isqrt(pairs // 32_000_000), tokens // 4_000_000)
            bounds = [lightest * 2.0**upto, lightest * 2.0**above if above < 64 else float("inf")]
            edges = number_pairs(_candidates(known, closed, upto), "tokens", weight, *bounds, buckets)
            edges = stored(edges.withColumn("weight", 3.0 * F.col("section_count") + F.col("file_count")), "edges")
            step = 1 if edges.count() > FEW_EDGES // 8 else 2
            now, used = _chosen(edges, used, k)
            if now:
                kept.append(stored(edges.join(reduce(DataFrame.union, now), ["term_a", "term_b"], "left_semi"), "kept"))
            dropped(edges, *now)
        dropped(known)
    found = reduce(DataFrame.union, kept) if kept else spark.createDataFrame([], f"term_a long, term_b long, {', '.join(f'{w} long' for w in weight)}, weight double")
    for end in ("term_a", "term_b"):
        found = found.join(numbers.select(F.col("no").alias(end), F.col("term").alias(f"{end}_text")), end)
    return found.select(F.col("term_a_text").alias("term_a"), F.col("term_b_text").alias("term_b"), "weight", "section_count", "file_count")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("term_a").alias("term"), F.col("term_b").alias("other"), "weight").union(edges.select("term_b", "term_a", "weight"))


def related(edges: DataFrame, term: str, most: int) -> DataFrame:
    return both_ways(edges).where(F.col("term") == term.lower()).select("other", "weight").orderBy(F.desc("weight"), "other").limit(most)


def enriched(edges: DataFrame, question: str, most: int, per_seed: int, hints: list[str] | None = None) -> DataFrame:
    """term, weight: the question's terms and hints, and the terms related to them, heaviest first."""
    import re

    asked = [w.lower() for w in re.split(r"[^A-Za-z0-9_]", question)]
    seeds = [w for w in asked if len(w) > 2 and w not in STOPWORDS] + [h.lower() for h in (HINTS if hints is None else hints)]
    seeds = list(dict.fromkeys(seeds))
    spark = edges.sparkSession
    given = spark.createDataFrame([(s,) for s in seeds], "term string")
    from helixquery.operators.kmers import top_per_group

    near = top_per_group(both_ways(edges).join(F.broadcast(given), "term", "left_semi"), "term", [F.desc("weight"), "other"], per_seed)
    all_ = given.select("term", F.lit(10000.0).alias("weight")).union(near.select("other", "weight"))
    best = all_.groupBy("term").agg(F.max("weight").alias("weight")).where(F.length("term") >= (3 if hints is None else 2))
    return best.orderBy(F.desc("weight"), "term").limit(most)
