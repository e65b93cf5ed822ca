"""Benchmark decontamination by spaced-seed hashing.

An item leaks into a document if, at some shift, WINDOW consecutive places of the item (all of them, for a shorter item)
agree with the document in a share of at least AGREE. A seed is a fixed mask over consecutive words of which some are
ignored, so a substituted word spoils a seed only where the mask looks at it. The hashes of all masks at all places of the
benchmark meet the same hashes of the documents in a join, and around every hit the two word sequences are compared.

MASKS find every leak of items of eight words or more: wherever the substitutions that AGREE allows stand in a window, one
of the masks fits between them (`test_masks_find_every_leak` tries all). Shorter items have masks of their own: of five to
seven words one may differ, of fewer none, so all their words are one seed.

Places of a document are rows of the join only where one of the seeds (and, where all masks begin with two words, the pair
there) may be in the benchmark: a bitmap of at most 2^MOST_BITS bits, whatever the benchmark's size, tells most others
apart (it never refuses one that is). A run of agreeing seeds on a diagonal is compared once, at its first place.

The benchmark's side is broadcast if its words are at most FEW_WORDS. Beyond that documents' seeds shuffle without their
words, and only documents with hits meet the items' words.
Words are [^\\x20\\x09-\\x0D]+ in lower case, compared by 64-bit hash.

Defined results: null or empty texts have no leaks, null or empty items never leak; a repeated document gives the pair
(doc_id, item_id) once, a repeated item is one item; more columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks: the places in a span that a seed looks at, for items of eight words or more and of five to seven.
MASKS = [(0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7)]
SHORT_MASKS = [(0, 1, 2), (0, 1, 3)]
WINDOW, AGREE = 13, 0.8
BLANKS = " \t\n\x0b\x0c\r"
#: Benchmark words up to this number are broadcast (a few hundred bytes each with seeds and items).
FEW_WORDS = 200_000


def masks_of(length: int) -> list[tuple[int, ...]]:
    """The masks for items of so many words."""
    return MASKS if length >= 8 else SHORT_MASKS if length >= 5 else [tuple(range(length))]


def word_hashes(text: Column) -> Column:
    words = F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS)), "[ \t\n\x0b\x0c\r]+")
    return F.transform(words, lambda w: F.xxhash64(w))


#: Bits of the bitmap for each benchmark word, and its largest size as a power of two.
BITS_A_WORD, MOST_BITS = 64, 20


def _pair(h: Column, at: Column) -> Column:
    return F.xxhash64(F.get(h, at), F.get(h, at + 1))


def _probes(x: Column, bits: int) -> list[Column]:
    """Two places in the bitmap."""
    return [x.bitwiseAND((1 << bits) - 1), F.shiftrightunsigned(x, 64 - bits)]


def _bitmap(hashes: DataFrame, bits: int) -> Column:
    """The bitmap of a column `x` of hashes: a literal of 2^bits / 64 longs."""
    at = hashes.select(F.explode(F.array(*_probes(F.col("x"), bits))).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    found = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit).alias("set")).collect()
    words = [0] * ((1 << bits) // 64)
    for r in found:
        words[r["word"]] = r["set"]
    return F.lit(np.array(words, dtype=np.int64))


def _may_hold(bitmap: Column, x: Column, bits: int) -> Column:
    test = lambda at: F.get(bitmap, F.shiftright(at, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0
    one, two = _probes(x, bits)
    return test(one) & test(two)


def _seed(h: Column, at: Column, mask: tuple[int, ...]) -> Column:
    """The hash of a mask at a place; null where it reaches over the end."""
    seed = F.xxhash64(F.lit(",".join(map(str, mask))), *(F.get(h, at + o) for o in mask))
    return F.when(at + mask[-1] < F.size(h), seed)


def _seeds(rows: DataFrame, h: str, at: str, masks: list[tuple[int, ...]]) -> DataFrame:
    """A row per mask that fits, with columns mask (its number) and seed."""
    each = F.array(*(F.struct(F.lit(m).alias("mask"), _seed(F.col(h), F.col(at), mask).alias("seed")) for m, mask in enumerate(masks)))
    return rows.select("*", F.inline(each)).where("seed is not null")


def _agrees(h: Column, b: Column, at: Column, item_at: Column) -> Column:
    return F.coalesce(F.get(h, at) == F.get(b, item_at), F.lit(False))


def leaks(docs: DataFrame, benchmark: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """One row per document (`ids`) and item that leaks into it: ids, item_id, agreeing (most equal words in a window)."""
    items = benchmark.select(F.col("item_id"), word_hashes(F.col("text")).alias("b")).where(F.trim(F.col("text"), F.lit(BLANKS)) != "").distinct()
    lengths = items.groupBy(F.least(F.size("b"), F.lit(8)).alias("k")).agg(F.sum(F.size("b")).alias("n")).collect()  # eight rows at most
    words = sum(r["n"] for r in lengths)
    masks = sorted({m for r in lengths for m in masks_of(r["k"])}) or MASKS

    places = items.select("item_id", "b", F.explode(F.sequence(F.lit(0), F.size("b") - 1)).alias("item_at"))
    own_mask = reduce(Column.__or__, (F.size("b").between(low, high) & F.col("mask").isin([masks.index(m) for m in of if m in masks]) for low, high, of in [(8, 1 << 30, MASKS), (5, 7, SHORT_MASKS), *((k, k, masks_of(k)) for k in range(1, 5))]))
    item_seeds = _seeds(places, "b", "item_at", masks).where(own_mask).select("item_id", "item_at", "mask", "seed")
    paired = all(m[:2] == (0, 1) for m in masks)
    bits = min(MOST_BITS, max(12, (words * BITS_A_WORD).bit_length()))
    known = item_seeds.select(F.col("seed").alias("x"))
    bitmap = _bitmap(known.union(places.select(_pair(F.col("b"), F.col("item_at")))) if paired else known, bits)

    names = [f"dc_id_{i}" for i in range(len(ids))]
    own = [F.col(c).alias(n) for c, n in zip(ids, names, strict=True)]
    hashed = docs.select(*own, F.xxhash64(text).alias("dc_text"), word_hashes(F.col(text)).alias("h"))

    def likely(i: Column) -> Column:
        seeds = reduce(Column.__or__, (F.coalesce(_may_hold(bitmap, _seed(F.col("h"), i, m), bits), F.lit(False)) for m in masks))
        return _may_hold(bitmap, _pair(F.col("h"), i), bits) & seeds if paired else seeds

    shortest = min(m[-1] for m in masks) + 1
    starts = F.when(F.size("h") >= shortest, F.sequence(F.lit(0), F.size("h") - shortest))
    h, b = F.col("h"), F.col("b")
    if words <= FEW_WORDS:
        at = hashed.select(*names, "h", F.explode(F.filter(starts, likely)).alias("at"))
        hits = _seeds(at, "h", "at", masks).join(F.broadcast(item_seeds), ["mask", "seed"]).join(F.broadcast(items), "item_id")
        offsets = F.element_at(F.array(*(F.array(*map(F.lit, m)) for m in masks)), F.col("mask") + 1)
        before = F.forall(offsets, lambda o: _agrees(h, b, F.col("at") + o - 1, F.col("item_at") + o - 1))
        hits = hits.where((F.col("at") == 0) | (F.col("item_at") == 0) | ~before).withColumn("shift", F.col("at") - F.col("item_at"))
    else:
        at = hashed.select("dc_text", "h", F.explode(F.filter(starts, likely)).alias("at"))
        met = _seeds(at, "h", "at", masks).select("dc_text", "at", "mask", "seed").join(item_seeds, ["mask", "seed"])
        met = met.select("dc_text", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
        some = hashed.join(met.select("dc_text").distinct(), "dc_text", "left_semi")
        hits = met.join(some, "dc_text").join(items, "item_id")

    shift = F.col("shift")
    low = F.greatest(F.lit(0), -shift)
    high = F.least(F.size(b), F.size(h) - shift)
    width = F.least(F.lit(WINDOW), F.size(b))
    equal = F.transform(F.sequence(low, high - 1), lambda j: F.when(F.get(h, j + shift) == F.get(b, j), 1).otherwise(0))
    # exploding the one-element array makes `equal` a value of its own: else every reference below computes it again
    hits = hits.select(*names, "item_id", width.alias("width"), F.explode(F.array(equal)).alias("equal")).where(F.size("equal") >= F.col("width"))
    windows = F.sequence(F.lit(1), F.size("equal") - F.col("width") + 1)
    sums = F.transform(windows, lambda k: F.aggregate(F.slice("equal", k, F.col("width")), F.lit(0), lambda s, x: s + x))
    hits = hits.select(*names, "item_id", "width", F.explode(F.array(F.array_max(sums))).alias("agreeing"))
    found = hits.where(F.col("agreeing") >= AGREE * F.col("width"))
    found = found.groupBy(*names, "item_id").agg(F.max("agreeing").alias("agreeing"))
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, ids, strict=True)), "item_id", "agreeing")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents into which no item leaks, with their columns. Whether one does depends on its text alone, so
    documents are found again by their text's hash."""
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    bad = leaks(docs.select(key.alias("dc_key"), text), benchmark, ["dc_key"], text).select("dc_key").distinct()
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    return packed.withColumn("dc_key", F.xxhash64(F.coalesce(F.col(f"doc.{text}"), F.lit("")))).join(bad, "dc_key", "left_anti").select("doc.*")
