"""Packing of tokenised documents into sequences by linear grouping.

Documents become ids plus one end id; only longer ones than a sequence are cut, so that every piece
but the first is a whole sequence. What is left to pack are lengths below the capacity, and the plan
needs their counts only (at most capacity - 1 numbers, whatever the input):

1. large lengths, sorted, fall into groups of equal cardinality and are rounded up to their group's
   largest;
2. for these few sizes, configurations that fill a sequence best are chosen one after another, each
   as often as the counts allow;
3. the slots get the groups' actual documents, in order; what rounding had lost is free again;
4. small lengths go, largest first, where they fit best.

The plan is a table of rank intervals per length. Documents learn their rank within their length from
counts per (length, cell), so that no task sees all documents of a length, and meet the plan by a
broadcast join (its size depends on the capacity and the number of groups alone).

Defined results: a null text is an empty one: one piece with the end id; repeated rows and null ids are
documents like others; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixquery.llm import scratch, text

CAPACITY, END_ID = 1024, 2
#: Lengths up to this are small; the large ones form so many groups; cells per length in the ranking.
SMALL, GROUPS, CELLS = 96, 128, 128

#: A blank that does not simply start the next word: then the text is encoded whole.
IRREGULAR = r"  | $| [\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Chunks of characters that every regular expression engine puts into the same classes.
PLAIN = r"^[\n\x20-\x7e\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]*$"
#: The pattern by which a byte-level vocabulary cuts texts: fixed by the vocabulary file's kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for
    themselves, U+0100 and on for the other bytes in order."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as `tokenizers` gives them.

    The vocabulary's pattern starts a new piece at a blank before a non-blank, so a text's ids are the ids of its
    chunks (a blank and what follows it) one after another: each distinct chunk of some texts is encoded once. Plain
    chunks go through `tiktoken` all at once, with the same vocabulary as ranks, where the file's merges are in the order
    of their ids; the ids' byte lengths tell where chunks end. All others go through `tokenizers`.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {token.content: i for i, token in self.tokenizer.get_added_tokens_decoder().items()}
        byte, vocabulary = byte_of(), self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in added}
        self.id_bytes = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in ranks.items():
            self.id_bytes[i] = len(token)
        for token, i in added.items():
            self.id_bytes[i] = len(token.encode())
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        into = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        self.fast = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added) if into == sorted(into) else None

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _joined(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain chunks without their first blanks, and the number of ids of each."""
        if self.fast is None or not len(chunks):
            return self._each([" " + x for x in chunks.to_pylist()])
        ends = np.cumsum(pc.binary_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), " ")[0].as_py()
        ids = self.fast.encode_to_numpy(" " + whole, allowed_special="all")
        reached = np.cumsum(self.id_bytes[ids])
        at = np.searchsorted(reached, ends)
        if at[-1] >= len(reached) or (reached[at] != ends).any():
            return self._each([" " + x for x in chunks.to_pylist()])
        return ids, np.diff(at + 1, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by the end id, and the offsets (n + 1)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, IRREGULAR)
        lists = pc.split_pattern(texts, " ")
        if pc.any(odd).as_py():
            whole = texts.filter(odd)
            lists = text.replaced(lists, odd, pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1, dtype=np.int32)), whole))
        parts, offsets = text.flat_list(lists)
        code, distinct = text.codes(parts)
        head, head_code = np.unique(code[offsets[:-1]], return_inverse=True)  # a text's first chunk has no blank
        behind = np.ones(len(code), dtype=bool)
        behind[offsets[:-1]] = False
        used = np.zeros(len(distinct), dtype=bool)
        used[code[behind]] = True  # as a chunk with a blank
        plain = pc.match_substring_regex(distinct, PLAIN).to_numpy(zero_copy_only=False) & used
        other = used & ~plain
        ids, sizes = zip(
            self._joined(distinct.filter(pa.array(plain))),
            self._each([" " + x for x in distinct.filter(pa.array(other)).to_pylist()]),
            self._each(distinct.take(pa.array(head)).to_pylist()),
            (np.array([END_ID], dtype=np.uint32), np.ones(1, dtype=np.int64)),
            strict=True,
        )
        store, sizes = np.concatenate(ids), np.concatenate(sizes)
        starts = np.cumsum(sizes) - sizes
        number_of = np.zeros(len(distinct), dtype=np.int64)
        number_of[plain] = np.arange(plain.sum())
        number_of[other] = plain.sum() + np.arange(other.sum())
        number = number_of[code]
        number[offsets[:-1]] = used.sum() + head_code
        number = np.insert(number, offsets[1:], len(sizes) - 1)
        each = sizes[number]
        ends = np.cumsum(each)
        at = np.repeat(starts[number] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
        return store[at], np.concatenate(([0], ends[offsets[1:] + np.arange(len(texts))]))


_encoders: dict[str, Encoder] = {}


def piece_sums(path: str, capacity: int):
    """A function on texts: the number of ids, and the checksum of each piece's ids."""

    @F.arrow_udf(T.StructType([T.StructField("n_ids", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType()))]))
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        text.lean()
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        for texts in batches:
            text.lean()
            n_ids, sums, ends = [], [], [0]
            for a, b in text.steps(texts):
                ids, offsets = encoder.encode(texts.slice(a, b - a))
                raw = memoryview(ids.astype("<u4").tobytes())
                for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    n_ids.append(e - s)
                    cut = s + ((e - s) % capacity or min(capacity, e - s))
                    sums.append(zlib.crc32(raw[4 * s : 4 * cut]))
                    sums.extend(zlib.crc32(raw[4 * x : 4 * (x + capacity)]) for x in range(cut, e, capacity))
                    ends.append(len(sums))
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(sums, type=pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(n_ids, type=pa.int64()), lists], ["n_ids", "crcs"])
        text.lean()

    return pieces


def best_configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Uses per size: the largest size that is left, and others that fill the sequence as far as they can."""
    uses = [0] * len(sizes)
    first = next(i for i, n in enumerate(left) if n)
    uses[first] = 1
    room = capacity - sizes[first]
    reached, layers, full = 1, [], (1 << (room + 1)) - 1
    for i, s in enumerate(sizes):
        for _ in range(min(left[i] - uses[i], room // s)):
            grown = (reached | reached << s) & full
            if grown == reached:
                break
            layers.append((i, reached))
            reached = grown
        if reached >> room & 1:
            break
    at = reached.bit_length() - 1
    for i, before in reversed(layers):
        if not before >> at & 1:
            uses[i] += 1
            at -= sizes[i]
    return uses


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): rank r of the length goes to first sequence + r - first rank."""
    out: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, sequences)
    large = sorted(((n, c) for n, c in counts.items() if n > small and c), reverse=True)
    each = max(1, -(-sum(c for _, c in large) // groups))
    sizes: list[int] = []
    left: list[int] = []
    items: list[list[list[int]]] = []  # per group: [length, next rank, documents]
    for n, c in large:
        rank = 0
        while rank < c:
            if not sizes or left[-1] == each:
                sizes.append(n)
                left.append(0)
                items.append([])
            take = min(c - rank, each - left[-1])
            items[-1].append([n, rank, take])
            left[-1] += take
            rank += take
    sequence = 0
    while any(left):
        uses = best_configuration(sizes, left, capacity)
        times = min(left[i] // u for i, u in enumerate(uses) if u)
        slots = [i for i, u in enumerate(uses) for _ in range(u)]
        done = 0
        taken: list[list[list[int]]] = []
        for i in slots:  # the next `times` documents of the slot's group, as runs of one length
            runs, need = [], times
            while need:
                head = items[i][0]
                t = min(need, head[2])
                runs.append([head[0], head[1], t])
                head[1] += t
                head[2] -= t
                need -= t
                if not head[2]:
                    items[i].pop(0)
            taken.append(runs)
            left[i] -= times
        while done < times:
            t = min(runs[0][2] for runs in taken)
            offset = 0
            for runs in taken:
                n, rank, _ = runs[0]
                out.append((n, rank, rank + t, sequence + done, offset))
                offset += n
                runs[0][1] += t
                runs[0][2] -= t
                if not runs[0][2]:
                    runs.pop(0)
            room.setdefault(capacity - offset, []).append((sequence + done, t))
            done += t
        sequence += times
    for n, c in sorted(((n, c) for n, c in counts.items() if n <= small and c), reverse=True):
        rank = 0
        while rank < c:
            fit = min((r for r, x in room.items() if r >= n and x), default=None)
            if fit is None:
                new = -(-(c - rank) // (capacity // n))
                room.setdefault(capacity, []).append((sequence, new))
                sequence += new
                continue
            start, many = room[fit].pop()
            t = min(many, c - rank)
            out.append((n, rank, rank + t, start, capacity - fit))
            room.setdefault(fit - n, []).append((start, t))
            if many > t:
                room[fit].append((start + t, many - t))
            rank += t
    return out


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", piece_sums(tokenizer, capacity)("text").alias("p")).select("doc_id", "p.*")
    first = F.when(F.col("n_ids") % capacity == 0, F.lit(capacity)).otherwise(F.col("n_ids") % capacity).cast("long")
    with scratch.small_batches(spark, 2000, "8m"):
        rows = scratch.written(rows.withColumn("first", first).withColumn("cell", F.pmod(F.xxhash64("doc_id", "n_ids", "crcs"), F.lit(CELLS))), "pieces")

    short = rows.where(F.col("first") < capacity)
    by_cell = scratch.written(short.groupBy("first", "cell").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["first"]: r["n"] for r in by_cell.groupBy("first").agg(F.sum("n").alias("n")).collect()}  # under `capacity` rows
    intervals = spark.createDataFrame(plan(counts, capacity), "first long, r0 long, r1 long, s0 long, offset long")
    before = by_cell.select("first", "cell", (F.sum("n").over(Window.partitionBy("first").orderBy("cell")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("first", "cell").orderBy("doc_id", "n_ids", "crcs")) - 1
    ranked = short.withColumn("rank", rank).join(F.broadcast(before), ["first", "cell"]).withColumn("rank", F.col("rank") + F.col("before"))
    inside = (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1"))
    placed = ranked.join(F.broadcast(intervals.withColumnRenamed("first", "first_of")), (F.col("first") == F.col("first_of")) & inside)
    placed = placed.withColumn("sequence_id", F.col("s0") + F.col("rank") - F.col("r0"))
    whole = rows.where(F.col("first") == capacity)

    def pieces(x: DataFrame) -> DataFrame:
        """Pieces after the first are whole sequences with numbers below zero."""
        x = x.select("doc_id", "n_ids", "first", "sequence_id", "offset", F.posexplode("crcs").alias("piece", "ids_crc32"))
        later = F.col("piece") > 0
        own = -1 - F.monotonically_increasing_id()
        return x.select(
            "doc_id",
            F.col("piece").cast("int").alias("piece"),
            F.when(later, F.col("first") + (F.col("piece") - 1) * capacity).otherwise(F.lit(0)).cast("long").alias("start"),
            F.when(later, F.lit(capacity)).otherwise(F.col("first")).cast("long").alias("length"),
            "ids_crc32",
            F.when(later | F.col("sequence_id").isNull(), own).otherwise(F.col("sequence_id")).alias("sequence_id"),
            F.when(later, F.lit(0)).otherwise(F.col("offset")).cast("long").alias("offset"),
        )

    none = F.lit(None).cast("long")
    one = placed.select("doc_id", "n_ids", "first", "crcs", "sequence_id", "offset")
    return pieces(one.unionByName(whole.select("doc_id", "n_ids", "first", "crcs", none.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))))
