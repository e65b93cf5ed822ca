"""Quality classifier: interpolated modified Kneser-Ney models of byte n-grams, kept as tables.

Trusted documents (labelled quality 1 and not toxic) are dealt into two folds by a hash of their text; a document
is scored by the model of the other fold's trusted documents, so no document is judged by a model that saw its text
and the scores of trusted documents are comparable with all others. All trusted documents are counted.

A gram is ORDER bytes of a text in lower case (A-Z only), packed into a long, with ORDER - 1 bytes PAD before the text. For
each order from ORDER down to 1 the model holds the discounted share of every gram within its context and what every
context leaves to the lower order (orders below ORDER count in how many grams of the next order they stand).

Scoring joins grams with these tables, sharded by gram:

1. texts form blocks of about BLOCK bytes of one fold, of which the distinct grams are taken, so that a gram travels once
   per block and not once per document;
2. the distinct grams of all blocks meet the tables of each order, which gives every gram its probability;
3. (block, gram) meets the probabilities by gram, and each block's values meet the block's texts (compressed, so that they
   are shuffled once at half their size), where logarithms are summed per document.

Only tables of contexts of one and two bytes (at most 2 * 65,536 rows) are broadcast; nothing of the model is collected.

A document's perplexity per byte is compared with its language's threshold: the quantile QUANTILE of its n trusted
documents, shrunk towards the quantile of all trusted documents as if FEW of those were its own, and the error of a quantile
of so few: MARGIN * sqrt(FEW / (n + FEW)) times the quantile's distance from the median.

Defined results: texts without words (and null) have no perplexity and are not kept; a null language is one of its own;
repeated rows are scored alike and each counts in its language's quantile; a language without trusted documents has the
threshold of all; a fold without trusted documents gives no document of the other a perplexity, and without labels nothing
is kept; only doc_id, text and lang are read. Logarithms are whole numbers of 1 / UNIT, so no order of rows changes a result.
Blocks are made from `docs` twice, for their grams and for their texts: it must give the same rows in the same order each time
it is read, as a stored table does; a gram without a value fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixquery.llm import scratch, text

QUANTILE, MARGIN, FEW = 0.98, 4.0, 20
#: Trusted ids up to this number are broadcast (8 bytes each).
FEW_IDS = 500_000
#: Languages up to this number are broadcast (four short columns each).
FEW_LANGS = 10_000
ORDER, PAD = 5, 255
#: Bytes of texts in one block; a longer text is a block of its own.
BLOCK = 16 << 20
#: What a unit of log2 is divided into, and the bits of a value beside its gram in one long.
UNIT, VALUE_BITS = 1 << 17, 64 - 8 * ORDER

WORDLESS = r"^[\x20\x09-\x0D]*$"


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts, one for each byte, and where each text's begin (n + 1 offsets)."""
    raw = pc.ascii_lower(texts).cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    out = data.astype(np.int64)
    for back in range(1, ORDER):
        before = np.full(len(data), PAD, dtype=np.int64)
        before[back:] = data[: max(0, len(data) - back)]
        at = (ends[:-1, None] + np.arange(back)).ravel()  # the first bytes of a text have no byte so far back
        inside = at < np.repeat(ends[1:], back)
        before[at[inside]] = PAD
        out |= before << (8 * back)
    return out, ends


def _merged(keys: np.ndarray, sums: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, c = np.unique(new, return_counts=True)
    all_, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
    return all_, np.bincount(at, weights=np.concatenate([sums, c]), minlength=len(all_)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """side, gram, c of the texts (docs: side, text): each task's counts first, then their sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text.lean()
        none = np.zeros(0, dtype=np.int64)
        held = {0: (none, none), 1: (none, none)}
        for batch in batches:
            side = batch.column(0).to_numpy()
            for s in (0, 1):
                texts = pc.fill_null(batch.column(1).filter(pa.array(side == s)), "")
                for a, b in text.steps(texts):
                    held[s] = _merged(*held[s], grams(texts.slice(a, b - a))[0])
        for s, (keys, sums) in held.items():
            for at in range(0, len(keys), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), s)), pa.array(keys[part]), pa.array(sums[part])], ["side", "gram", "c"])
        text.lean()

    return docs.select("side", "text").mapInArrow(count, "side long, gram long, c long").groupBy("side", "gram").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> dict[int, list[float]]:
    """Of each side the discounts of counts 1, 2 and 3 or more (Chen and Goodman's estimates)."""
    n = counts.groupBy("side").agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).collect()  # two rows
    out = {0: [0.5, 1.0, 1.5], 1: [0.5, 1.0, 1.5]}
    for r in n:
        n1, n2, n3, n4 = (r[f"n{k}"] for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        found = [k - (k + 1) * y * b / a if a else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        out[r["side"]] = [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found, strict=True)]
    return out


def low(gram: Column, order: int) -> Column:
    """The last `order` bytes of a gram."""
    return gram.bitwiseAND(F.lit((1 << (8 * order)) - 1).cast("long"))


def models(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ORDER: (side, gram, own) and (side, context, left). trusted: side, text, where side tells whose model
    the text belongs to."""
    counts = scratch.written(gram_counts(trusted), f"grams-{ORDER}")
    out = []
    for order in range(ORDER, 0, -1):
        d = discounts(counts)
        pick = lambda i, d=d: F.when(F.col("side") == 0, d[0][i]).otherwise(d[1][i])
        rows = counts.withColumn("taken", F.when(F.col("c") == 1, pick(0)).when(F.col("c") == 2, pick(1)).otherwise(pick(2)))
        rows = rows.withColumn("context", F.shiftright("gram", 8))
        totals = rows.groupBy("side", "context").agg(F.sum("c").alias("total"), F.sum("taken").alias("all_taken"))
        totals = scratch.written(totals, f"contexts-{order}")
        own = rows.join(totals, ["side", "context"]).select("side", "gram", ((F.col("c") - F.col("taken")) / F.col("total")).alias("own"))
        out.insert(0, (scratch.written(own, f"shares-{order}"), totals.select("side", "context", (F.col("all_taken") / F.col("total")).alias("left"))))
        if order > 1:
            counts = scratch.written(counts.groupBy("side", low(F.col("gram"), order - 1).alias("gram")).agg(F.count(F.lit(1)).alias("c")), f"grams-{order - 1}")
    return out


def probabilities(wanted: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """side, gram, p of the wanted grams (side, gram), each once. Orders 1 and 2 and contexts of two bytes are broadcast: they
    have at most 2 * 65,536 rows."""
    levels = {ORDER: wanted}
    for order in range(ORDER - 1, 0, -1):
        levels[order] = levels[order + 1].select("side", low(F.col("gram"), order).alias("gram")).distinct()
    near = lambda df, bytes_: F.broadcast(df) if bytes_ <= 2 else df
    lower = None
    for order, (own, left) in enumerate(tables, 1):
        rows = levels[order].withColumn("context", F.shiftright("gram", 8)).withColumn("lower", low(F.col("gram"), order - 1))
        rows = rows.join(near(own, order), ["side", "gram"], "left").join(near(left, order - 1), ["side", "context"], "left")
        rest = F.lit(1 / 256)
        if lower is not None:
            rows = rows.join(near(lower.select("side", F.col("gram").alias("lower"), F.col("p").alias("lower_p")), order - 1), ["side", "lower"])
            rest = F.col("lower_p")
        lower = rows.select("side", "gram", (F.coalesce("own", F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * rest).alias("p"))
    return lower


#: What both readings of the documents take: the same columns, so that Spark plans them alike.
ROW = ["side", "part", "text", "doc_id", "lang"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[pa.RecordBatch]]]:
    """block, side and rows of a task's blocks, the same each time. Rows: side, part (number of the task), text, ..."""
    held: dict[int, list[pa.RecordBatch]] = {0: [], 1: []}
    size, part, done = {0: 0, 1: 0}, 0, 0
    for batch in batches:
        part = batch["part"][0].as_py() if batch.num_rows else part
        for side in (0, 1):
            own = batch.filter(pc.equal(batch["side"], side))
            for a, b in text.steps(own["text"], text.STEP_BYTES):
                rows = own.slice(a, b - a)
                held[side].append(rows)
                size[side] += pc.sum(pc.binary_length(rows["text"])).as_py()
                if size[side] >= BLOCK:
                    yield part << 24 | done, side, held[side]
                    held[side], size[side], done = [], 0, done + 1
    for side in (0, 1):
        if held[side]:
            yield part << 24 | done, side, held[side]
            done += 1


def _one(values: pa.Array) -> pa.Array:
    """An array of one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def block_grams(docs: DataFrame) -> DataFrame:
    """block, side, grams (distinct) of each block. docs: the columns ROW, no null text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text.lean()
        for block, side, rows in _blocks(batches):
            found = np.zeros(0, dtype=np.int64)
            for x in rows:
                found = np.union1d(found, grams(x["text"])[0])
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([side]), _one(pa.array(found))], ["block", "side", "grams"])
        text.lean()

    return docs.select(*ROW).mapInArrow(each, "block long, side long, grams array<long>")


def block_texts(docs: DataFrame) -> DataFrame:
    """block, ids, langs, sizes (bytes of each text), body (the texts, compressed) of each block. docs: the columns
    ROW."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        text.lean()
        for block, _, rows in _blocks(batches):
            packer = zstandard.ZstdCompressor(level=3).compressobj()
            body = [packer.compress(b"".join(x["text"].cast(pa.binary()).to_pylist())) for x in rows]
            lists = [_one(pa.concat_arrays([x[c] for x in rows])) for c in ("doc_id", "lang")]
            sizes = _one(pa.concat_arrays([pc.binary_length(x["text"]).cast(pa.int64()) for x in rows]))
            body = pa.array([b"".join([*body, packer.flush()])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([block]), *lists, sizes, body], ["block", "ids", "langs", "sizes", "body"])
        text.lean()

    return docs.select(*ROW).mapInArrow(each, "block long, ids array<long>, langs array<string>, sizes array<long>, body binary")


def score(left: pa.Table, right: pa.Table) -> pa.Table:
    """Perplexities of one block's texts. left: the block (one row); right: its grams with their values, in one long each."""
    import zstandard

    text.lean()
    out = {"doc_id": [], "lang": [], "perplexity": []}
    known = np.sort(right["packed"].to_numpy().view(np.uint64))
    keys, values = (known >> np.uint64(VALUE_BITS)).astype(np.int64), (known & np.uint64((1 << VALUE_BITS) - 1)).astype(np.int64)
    for row in range(left.num_rows):
        sizes = left["sizes"][row].values.to_numpy()
        ids, langs = left["ids"][row].values, left["langs"][row].values
        reader = zstandard.ZstdDecompressor().decompressobj()
        body = reader.decompress(left["body"][row].as_buffer())
        ends = np.concatenate(([0], np.cumsum(sizes)))
        bits = np.zeros(len(sizes), dtype=np.int64)
        first = 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + text.STEP_BYTES, side="right")) - 1)
            raw = body[ends[first] : ends[last]]
            offsets = (ends[first : last + 1] - ends[first]).astype(np.int32)
            texts = pa.Array.from_buffers(pa.string(), last - first, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            found, starts = grams(texts)
            at = np.searchsorted(keys, found)
            if len(found) and (not len(keys) or (keys[np.minimum(at, len(keys) - 1)] != found).any()):
                raise ValueError("a gram has no value: the documents changed between two readings")
            bits[first:last] = text.per_row(values[at], starts)
            first = last
        out["doc_id"].append(ids)
        out["lang"].append(langs)
        out["perplexity"].append(pa.array(np.exp2(bits / UNIT / np.maximum(sizes, 1))))
    return pa.table({k: pa.chunked_array(v) for k, v in out.items()})


def scores(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity (null: no words, or no model of the other fold) of every row. docs: doc_id, lang, text;
    trusted: text."""
    side = F.pmod(F.xxhash64("text"), F.lit(2))
    tables = models(trusted.where(F.col("text").isNotNull()).select((1 - side).alias("side"), "text"))
    sides = [r["side"] for r in tables[0][1].select("side").distinct().collect()]  # two at most
    full = F.col("text").isNotNull() & ~F.col("text").rlike(WORDLESS) & (side.isin(sides) if sides else F.lit(False))
    full = F.coalesce(full, F.lit(False))
    rest = docs.where(~full).select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"))
    if not sides:
        return rest
    with scratch.small_batches(docs.sparkSession):
        rows = docs.where(full).select("doc_id", "lang", side.alias("side"), F.spark_partition_id().cast("long").alias("part"), "text")
        each = scratch.written(block_grams(rows), "block-grams").select("side", "block", F.explode("grams").alias("gram"))
        wanted = scratch.written(each.select("side", "gram").distinct(), "grams-wanted")
        value = F.least(F.greatest(F.round(-F.log2("p") * UNIT), F.lit(0)), F.lit((1 << VALUE_BITS) - 1)).cast("long")
        p = probabilities(wanted, tables).select("side", "gram", F.shiftleft("gram", VALUE_BITS).bitwiseOR(value).alias("packed"))
        p = scratch.written(p, "gram-values")
        met = each.join(p.hint("merge"), ["side", "gram"]).select(F.col("block").alias("of_block"), "packed")
        found = block_texts(rows).groupBy("block").cogroup(met.groupBy("of_block")).applyInArrow(score, "doc_id long, lang string, perplexity double")
        return scratch.written(found, "perplexities").unionByName(rest)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, perplexity, threshold, kept."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col("doc_id").alias("trusted_id")).distinct()
    good = scratch.written(good, "trusted")
    near = F.broadcast(good) if good.count() <= FEW_IDS else good
    docs = docs.select("doc_id", "lang", "text")
    trusted = docs.join(near, F.col("doc_id") == F.col("trusted_id"), "left_semi").select("text")
    found = scores(docs, trusted)
    own = found.where("perplexity is not null").join(near, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    cut = lambda q: F.percentile_approx("perplexity", q, 10_000)
    stats = [F.count(F.lit(1)).alias("n"), cut(QUANTILE).alias("high"), cut(0.5).alias("middle")]
    by_lang = own.groupBy(F.col("lang").alias("of_lang")).agg(*stats)
    every = own.agg(*stats).first()
    if not every.n:
        return found.withColumn("perplexity", F.round("perplexity", 6)).withColumn("threshold", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    shrunk = lambda of, all_: (F.coalesce("n", F.lit(0)) * F.coalesce(of, F.lit(0.0)) + FEW * all_) / (F.coalesce("n", F.lit(0)) + FEW)
    high, middle = shrunk("high", every.high), shrunk("middle", every.middle)
    threshold = high + MARGIN * F.sqrt(FEW / (F.coalesce("n", F.lit(0)) + FEW)) * (high - middle)
    near_langs = F.broadcast(by_lang) if by_lang.count() <= FEW_LANGS else by_lang
    out = found.join(near_langs, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    kept = F.coalesce(F.col("perplexity") <= threshold, F.lit(False))
    return out.select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"), F.round(threshold, 6).alias("threshold"), kept.alias("kept"))
