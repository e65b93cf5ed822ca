"""Maximal periodic runs of words, by tiles of every scale.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) that no neighbouring word
extends, and that has at least max(LEAST, 2 * q) words.

Periods fall into octaves: 1 to 7, 8 to 15, 16 to 31 and so on. For every octave a document is cut into tiles of
consecutive boundaries with as many words on either side as the octave needs, so that a tile is solved by itself:

- words x with word x = word x + q form stretches; a run is such a stretch of at least max(q, LEAST - q) words plus q. With
  a boundary at every `stride` words, at most the octave's least period, each stretch holds one;
- at a boundary two Z-functions give, for all periods of the octave at once, how far the words behind it match
  those q later, and how far the words before it do. Both are followed for `reach` words (at least the longest period), so
  a stretch that goes on beyond that is found again from the next boundary, and the two touch;
- a period is kept only if the q words at the boundary aren't repetitions of a shorter block (a divisor of q by one of
  its primes tells, from the same Z-function): else a shorter period has the run.

The fragments of stretches are shuffled by document and period, and those that touch are stitched to one.
Tiles are made only around boundaries where some period of the octave can have a stretch: half of it lies on one side of the
boundary, so that a short hash of words next to the boundary must come again a period later (false hits cost time
only). A tile has TILE words at least, whatever the document's length; a tile's fragments of one period are stitched before
they leave it, so a document gives a row per tile and period at most.

Defined results: a null text, an empty one and one of blanks have no words and no runs; null and repeated ids and repeated
rows are rows like others; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixquery.llm import scratch, text

#: Words of the shortest run.
LEAST = 12
#: Words of a tile without its margins, at least.
TILE = 1 << 14
#: Rows of a batch that leaves a task: tiles and texts may be long.
BATCH = 256

Order = Callable[[object, int], "np.ndarray | None"]


def octaves(n: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(least period, longest period, stride, reach, words of the hash) of the octaves that n words can have runs of."""
    if n >= LEAST:
        yield 1, min(7, n // 2), 4, 16, 3
    q = 8
    while 2 * q <= n:
        yield q, min(2 * q - 1, n // 2), q, 2 * q, q // 2
        q *= 2


def z_function(s: list[int]) -> list[int]:
    """Of every place of s the length of the longest common prefix of s and what begins there."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(maxsize=1 << 16)
def primes(q: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return (*out, q) if q > 1 else tuple(out)


def at_boundary(codes: list[int], c: int, low: int, high: int, reach: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the stretches around a boundary before place c of codes, cut at `reach` words from it."""
    n = len(codes)
    ahead = z_function(codes[c : c + high + reach])
    before = codes[max(0, c - reach) : c][::-1]
    until = min(n, c + high)
    later = codes[max(0, c - reach) : until][::-1]
    behind = z_function([*before, -1, *later])
    skip = len(before) + 1
    for q in range(low, min(high, n - c) + 1):
        f = min(ahead[q], reach) if q < len(ahead) else 0
        b = min(behind[skip + until - c - q], reach) if before else 0
        if b + f >= max(q, LEAST - q) and not any(ahead[q // p] >= q - q // p for p in primes(q)):
            yield q, c - b, c + f


def solved(codes: list[int], boundaries: list[int], low: int, high: int, reach: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of a tile's stretches, those that touch as one."""
    open_: dict[int, list[int]] = {}
    out = []
    for c in boundaries:
        for q, a, b in at_boundary(codes, c, low, high, reach):
            if q in open_ and a <= open_[q][1]:
                open_[q][0] = min(a, open_[q][0])
                open_[q][1] = max(b, open_[q][1])
            else:
                if q in open_:
                    out.append((q, *open_[q]))
                open_[q] = [a, b]
    return out + [(q, a, b) for q, (a, b) in open_.items()]


def gram_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of twice as many words as those of h, which stand for `width` words each."""
    return text.mix(h[: max(0, len(h) - width)] * np.uint64(0x9E3779B97F4A7C15) + h[width:])


def suspects(codes: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(least period, longest, stride, reach, boundaries) of each octave where a stretch is possible."""
    n = len(codes)
    h1 = text.mix(codes.astype(np.uint64) + np.uint64(1))
    h2 = gram_hashes(h1, 1)
    grown, width = gram_hashes(h2, 2), 4
    for low, high, stride, reach, half in octaves(n):
        if half == 3:
            h = text.mix(h2[: max(0, n - 2)] * np.uint64(0x9E3779B97F4A7C15) + h1[2:]) if n > 2 else h2[:0]
        else:
            while width < half:
                grown, width = gram_hashes(grown, width), 2 * width
            h = grown
        bounds = np.arange(0, n, stride)
        hit = np.zeros(len(bounds), dtype=bool)
        for shift in (0, half):  # words behind the boundary, and before it
            own = bounds - shift
            ok = np.flatnonzero((own >= 0) & (own + low < len(h)))
            if not len(ok):
                continue
            if low >= 8:  # the places a period later are the next blocks of `low` places
                first = own[ok[0]]
                blocks = h[first + low :]
                blocks = np.concatenate([blocks, np.zeros(-len(blocks) % low, dtype=np.uint64)]).reshape(-1, low)[: len(ok)]
                hit[ok] |= (blocks == h[own[ok]][:, None]).any(axis=1)
            else:
                for q in range(low, high + 1):
                    ok = ok[own[ok] + q < len(h)]
                    hit[ok] |= h[own[ok]] == h[own[ok] + q]
        if hit.any():
            yield low, high, stride, reach, bounds[hit]


def tiles(codes: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """(least period, longest, reach, first word, words, boundaries within them) of all tiles of a document."""
    for low, high, _, reach, bounds in suspects(codes):
        span = max(TILE, 4 * low)
        for _, some in _groups(bounds, bounds // span):
            a, b = max(0, int(some[0]) - reach), min(len(codes), int(some[-1]) + high + reach)
            yield low, high, reach, a, codes[a:b], some - a


def _groups(values: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of values with one key (keys ascend)."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for part in np.split(np.arange(len(values)), cuts):
        if len(part):
            yield int(keys[part[0]]), values[part]


def repeated_grams(codes: np.ndarray, offsets: np.ndarray, width: int = 6) -> np.ndarray:
    """Of each row whether a gram of `width` words stands in it twice: without one it has no run."""
    n_rows = len(offsets) - 1
    out = np.zeros(n_rows, dtype=bool)
    if len(codes) < width:
        return out
    h = text.mix(codes.astype(np.uint64) + np.uint64(1))
    h = gram_hashes(gram_hashes(h, 1), 2)[: len(codes) - width + 1] * np.uint64(0x9E3779B97F4A7C15) + gram_hashes(h, 1)[4:]
    row = text.rows_of(offsets)
    inside = row[: len(h)] == row[width - 1 :]
    h, row = text.mix(h[inside]), row[: len(inside)][inside]
    by = np.lexsort((h, row))
    twice = (h[by][1:] == h[by][:-1]) & (row[by][1:] == row[by][:-1])
    out[row[by][1:][twice]] = True
    return out


CUT = pa.schema([("uid", pa.int64()), ("id", pa.string()), ("n_words", pa.int64()), ("words", pa.string()), ("collapsed_sha256", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("reach", pa.int64()), ("first", pa.int64()), ("codes", pa.binary()), ("bounds", pa.binary())])
CUT_SQL = "uid long, id string, n_words long, words string, collapsed_sha256 string, low long, high long, reach long, first long, codes binary, bounds binary"


def _cut(batches: Iterator[pa.RecordBatch], order: Order | None) -> Iterator[pa.RecordBatch]:
    """A row for every document (low is null) and one for every tile."""
    uid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    for batch in batches:
        text.lean()
        ids, texts = batch.column(0), batch.column(1)
        for a, b in text.steps(texts):
            flat, offsets = text.words(texts.slice(a, b - a))
            keys = ids.slice(a, b - a).to_pylist()
            orders = {}
            if order:
                for i, key in enumerate(keys):
                    got = order(key, int(offsets[i + 1] - offsets[i]))
                    if got is not None:
                        orders[i] = got
            if orders:
                take = np.arange(offsets[-1])
                for i, got in orders.items():
                    take[offsets[i] : offsets[i + 1]] = offsets[i] + got
                flat = flat.take(pa.array(take))
            codes, _ = text.codes(flat)
            some = repeated_grams(codes, offsets)
            rows: list[tuple] = []
            for i, key in enumerate(keys):
                x, y = int(offsets[i]), int(offsets[i + 1])
                joined = " ".join(flat.slice(x, y - x).to_pylist())
                found = list(tiles(codes[x:y])) if some[i] else []
                done = None if found else hashlib.sha256(joined.encode()).hexdigest()
                rows.append((uid, None if key is None else str(key), y - x, joined if found else None, done, *[None] * 6))
                for low, high, reach, first, part, bounds in found:
                    rows.append((uid, *[None] * 4, low, high, reach, first, part.astype(np.int32).tobytes(), bounds.astype(np.int32).tobytes()))
                uid += 1
                if len(rows) >= BATCH:
                    yield _batch(rows, CUT)
                    rows = []
            if rows:
                yield _batch(rows, CUT)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


FRAGMENT = pa.schema([("uid", pa.int64()), ("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            codes, bounds = np.frombuffer(r["codes"], dtype=np.int32).tolist(), np.frombuffer(r["bounds"], dtype=np.int32).tolist()
            rows = [(r["uid"], q, a + r["first"], b + r["first"]) for q, a, b in solved(codes, bounds, r["low"], r["high"], r["reach"])]
            if rows:
                yield _batch(rows, FRAGMENT)


def stitched(fragments: DataFrame) -> DataFrame:
    """uid, start, length, period of all runs: fragments of a document and period that touch are one stretch."""
    w = Window.partitionBy("uid", "period").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("part", F.sum("new").over(w))
    whole = parts.groupBy("uid", "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    return whole.select("uid", "start", length.alias("length"), "period").where(F.col("length") >= F.greatest(F.lit(LEAST), 2 * F.col("period")))


@F.arrow_udf(T.StringType())
def collapsed_sha256(words: pa.Array, runs: pa.Array) -> pa.Array:
    """sha256 of the words (joined by blanks) that no run has after its first period."""
    out = []
    for s, dropped in zip(words.to_pylist(), runs.to_pylist(), strict=True):
        if s is None:
            out.append(None)
            continue
        parts = s.split(" ") if s else []
        keep = np.ones(len(parts), dtype=bool)
        for r in dropped or ():
            keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
        out.append(hashlib.sha256(" ".join(np.array(parts, dtype=object)[keep]).encode()).hexdigest())
    return pa.array(out, pa.string())


collapsed_sha256 = collapsed_sha256.asNondeterministic()  # once a row


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: Order | None = None) -> DataFrame:
    """One row per document: the id, n_words, runs (start, length, period; by start, then period) and collapsed_sha256.

    order: which of its words stands at each place of a document, from its id and number of words (None: as they stand).
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    with scratch.small_batches(spark):
        cut = scratch.written(docs.select(id_col, text_col).mapInArrow(lambda it: _cut(it, order), CUT_SQL), "tiles")
    work = cut.where("low is not null").select("uid", "low", "high", "reach", "first", "codes", "bounds")
    dealt = work.repartition("uid", "low", "first")
    runs = stitched(dealt.mapInArrow(_solve, "uid long, period long, start long, end long"))
    lists = runs.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    rows = cut.where("low is null").select("uid", F.col("id").cast(kind).alias(id_col), "n_words", "words", "collapsed_sha256")
    found = rows.where("words is not null").join(lists, "uid", "left")
    sha = collapsed_sha256("words", "runs")
    found = found.select(id_col, "n_words", F.coalesce("runs", F.array().cast(lists.schema["runs"].dataType)).alias("runs"), sha.alias("collapsed_sha256"))
    rest = rows.where("words is null").select(id_col, "n_words", F.array().cast(lists.schema["runs"].dataType).alias("runs"), "collapsed_sha256")
    return found.unionByName(rest)


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period) and the digest of all runs of `periodic_runs`."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length, (-r.start).alias("a"), (-r.period).alias("p"))))
    line = lambda r: F.concat_ws(",", r.start, r.length, r.period)
    all_runs = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = rows.withColumn("best", best)
    start, length, period = -F.col("best.a"), F.col("best.length"), -F.col("best.p")
    milli: Column = F.floor(1000 * length / period).cast("long")
    return out.select(id_col, F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), F.sha2(all_runs, 256).alias("runs_sha256"), "collapsed_sha256")
