"""k-mer windows, counts and target tables.

Counting ships super-k-mers: a task cuts sequences into runs of consecutive windows with one minimiser (the least hash of
the windows' M-mers), so that a run of w windows travels as w + k - 1 bytes once; equal runs of a batch travel once with
their number. A minimiser's runs meet in one task, which turns them into 2-bit codes and counts those with numpy, first
places beside the counts. A task whose different codes outgrow MOST_CODES hands what it has to a second sum, so memory is bounded
whatever a minimiser's share of the input is.

The most frequent k-mers and the number of different ones need no places: there, runs are cut to 32 bases, which travel as one
64-bit word and a byte, in a row for each counting task. The first places of the few k-mers that are left are looked up afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixquery.functions import codes as C
from helixquery.functions import sequences as S
from helixquery.storage import stored

#: Window starts per cut piece of a sequence: no row explodes into more, and no run has more windows.
CUT = 8192
#: Bases of a minimiser.
M = 9
#: Codes that a counting task holds before equal ones are added up, and different ones before it hands them on.
HELD_CODES, MOST_CODES = 1_000_000, 4_000_000
#: Bits of the map of wanted codes that windows are held against before a join: per wanted code, and at most (16 MB).
BITS, MOST_BITS = 64, 1 << 27
#: Bases of a word, windows that a counting task gets in the mean, and words that a task holds before it deals them out.
WORD, PART_WINDOWS, HELD_WORDS = 32, 4_000_000, 1_000_000
#: Wanted codes that every task looks up by itself.
FEW_WANTED = 1_000_000


def once(c: Column) -> Column:
    """A column computed once per row: exploding a one-element array makes it a value, which the generator above
    would otherwise compute again for each of its rows."""
    return F.explode(F.array(c))


def windows(records: DataFrame, id_col: str, seq: str, k: int) -> DataFrame:
    """id_col, pos (from 0) and kmer of all windows of k bases without other letters."""
    cut = records.select(id_col, once(F.col(seq).cast("binary")).alias("bytes")).where(F.octet_length("bytes") >= k)
    cut = cut.select(id_col, "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - k, F.lit(CUT))).alias("cut"))
    cut = cut.select(id_col, "cut", once(F.expr(f"substring(bytes, cut + 1, {CUT + k - 1})")).alias("piece"))
    clean = once(F.col("piece").cast("string").rlike("^[ACGT]+$")).alias("clean")  # then no window needs a look
    at = cut.select(id_col, "cut", "piece", clean).select("*", F.explode(F.sequence(F.lit(0), F.octet_length("piece") - k)).alias("i"))
    out = at.select(id_col, (F.col("cut") + F.col("i")).cast("long").alias("pos"), F.expr(f"cast(substring(piece, i + 1, {k}) as string)").alias("kmer"), "clean")
    return out.where(F.col("clean") | F.col("kmer").rlike("^[ACGT]+$")).drop("clean")


def _checked(k: int) -> None:
    if not 0 < k <= 32:
        raise ValueError("k must be 1 to 32")


def pieces(records: DataFrame, id_col: str, seq: str, start: str | None) -> DataFrame:
    """id_col, seq and start, without nulls in the last two."""
    at = F.lit(0) if start is None else F.col(start)
    return records.select(id_col, F.coalesce(seq, F.lit("")).alias("seq"), at.cast("long").alias("start"))


def _map_of(wanted: DataFrame) -> np.ndarray | None:
    """A bitmap of the hashes of the codes in `wanted`, of bounded size; None where it would hold back nothing."""
    n = wanted.count()
    size = 1 << max(10, (BITS * max(n, 1) - 1).bit_length())
    if size > MOST_BITS:
        return None
    bits = np.zeros(size, dtype=bool)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_place_of(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size)).astype(np.int64))], ["place"])

    for r in wanted.select("code").mapInArrow(marks, "place long").distinct().toLocalIterator():  # a bit for each wanted code at most
        bits[r["place"]] = True
    return bits


def _place_of(code: np.ndarray, size: int) -> np.ndarray:
    return (C.mixed(code) & np.uint64(size - 1)).astype(np.int64)


def packed_windows(records: DataFrame, id_col: str, seq: str, k: int, wanted: DataFrame | None = None, start: str | None = None) -> DataFrame:
    """id_col, pos and code (two bits a base, as functions.sequences.packed) of all windows of up to 32 bases without other
    letters. wanted: a table of codes that are asked for; windows that none of them can be are left out (some that aren't
    asked for may stay). start: a column with the place in the record at which a sequence begins (a piece of a long record)."""
    _checked(k)
    kind = records.schema[id_col].dataType.simpleString()
    bits = None if wanted is None else _map_of(wanted)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = C.flat(batch.column(1))
            for a, _, code, clean in C.steps(raw, offsets, k):
                at = np.flatnonzero(clean if bits is None else clean & bits[_place_of(code, len(bits))])
                for part in np.array_split(at, -(-len(at) // 100_000) or 1):
                    row, pos = C.located(offsets, a + part)
                    pos = pos + batch.column(2).to_numpy()[row]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(pos), C.as_long(code[part])], names=[id_col, "pos", "code"])

    return pieces(records, id_col, seq, start).mapInArrow(cut, f"`{id_col}` {kind}, pos long, code long")


def super_kmers(records: DataFrame, id_col: str, seq: str, k: int, start: str | None = None) -> DataFrame:
    """bucket, run, n, id_col, pos: stretches whose windows share a minimiser, how often they stand in a batch, and where first."""
    _checked(k)
    m = min(M, (k + 1) // 2)
    kind = records.schema[id_col].dataType.simpleString()
    names = ["bucket", "run", "n", id_col, "pos"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (raw, offsets) = batch.column(0), C.flat(batch.column(1))
            for a, digits, _, clean in C.steps(raw, offsets, k):
                lowest = C.least(C.mixed(C.codes(digits, m)) >> np.uint64(16), k - m + 1)
                at = np.flatnonzero(clean)
                if not len(at):
                    continue
                new = np.ones(len(at), dtype=bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (lowest[at[1:]] != lowest[at[:-1]])
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(at)))
                if size.max() > CUT:
                    more = -(-size // CUT)
                    inner = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
                    first, size = np.repeat(first, more) + inner * CUT, np.minimum(CUT, np.repeat(size, more) - inner * CUT)
                place = at[first]
                row, pos = C.located(offsets, a + place)
                pos = pos + batch.column(2).to_numpy()[row]
                width = size + k - 1
                ends = np.cumsum(width)
                taken = raw[a + np.repeat(place - (ends - width), width) + np.arange(ends[-1])]
                runs = pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(taken)])
                own = ids.take(pa.array(row))
                order = pc.sort_indices(pa.table([own, pa.array(pos)], ["i", "p"]), [("i", "ascending"), ("p", "ascending")], null_placement="at_start").to_numpy()
                _, found, n = np.unique(runs.dictionary_encode().indices.to_numpy()[order], return_index=True, return_counts=True)
                kept = pa.array(order[found])
                bucket = pa.array((lowest[place] & np.uint64(0x7FFFFFFF)).astype(np.int32)).take(kept)
                yield pa.RecordBatch.from_arrays([bucket, runs.take(kept), pa.array(n.astype(np.int64)), own.take(kept), pa.array(pos).take(kept)], names=names)

    return pieces(records, id_col, seq, start).mapInArrow(cut, f"bucket int, run binary, n long, `{id_col}` {kind}, pos long")


def _added(tables: list[pa.Table]) -> pa.Table:
    """code, n, id, pos with each code once: sums, and the first place."""
    t = pa.concat_tables(tables)
    t = t.take(pc.sort_indices(t, [("code", "ascending"), ("id", "ascending"), ("pos", "ascending")], null_placement="at_start"))
    code = t["code"].to_numpy()
    if not len(code):
        return t
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    n = np.add.reduceat(t["n"].to_numpy(), first)
    return pa.table([pa.array(code[first]), pa.array(n), t["id"].take(pa.array(first)), t["pos"].take(pa.array(first))], ["code", "n", "id", "pos"])


def _counted(batch: pa.RecordBatch, k: int) -> pa.Table:
    """code, n, id, pos of the windows of a batch of runs, each code once."""
    order = pc.sort_indices(pa.table([batch.column(3), batch.column(4)], ["i", "p"]), [("i", "ascending"), ("p", "ascending")], null_placement="at_start")
    raw, offsets = C.flat(batch.column(1).take(order))
    found = batch.column(2).take(order).to_numpy()
    codes, places = [], []
    for a, _, code, clean in C.steps(raw, offsets, k):
        at = np.flatnonzero(clean)
        codes.append(code[at])
        places.append(a + at)
    code = np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint64)
    row, inner = C.located(offsets, np.concatenate(places) if places else np.zeros(0, dtype=np.int64))
    weight = found[row]
    by = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.append(True, code[by][1:] != code[by][:-1])) if len(by) else by
    n = np.add.reduceat(weight[by], first) if len(by) else weight
    run = row[by[first]]
    pos = batch.column(4).take(order).to_numpy()[run] + inner[by[first]]
    return pa.table([pa.array(code[by[first]]), pa.array(n), batch.column(3).take(order).take(pa.array(run)), pa.array(pos)], ["code", "n", "id", "pos"])


def _placed_in_task(records: DataFrame, id_col: str, seq: str, k: int, start: str | None) -> DataFrame:
    """code, n, id, pos: a task's codes with sums and first places."""
    kind = records.schema[id_col].dataType.simpleString()

    def rows(t: pa.Table) -> Iterator[pa.RecordBatch]:
        out = pa.table([C.as_long(t["code"].to_numpy()), t["n"], t["id"], t["pos"]], ["code", "n", "id", "pos"])
        yield from out.combine_chunks().to_batches(max_chunksize=100_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(_counted(batch, k))
            size += len(held[-1])
            if size > HELD_CODES and size > 2 * len(held[0]):
                held = [_added(held)]
                size = len(held[0])
                if size > MOST_CODES:
                    yield from rows(held[0])
                    held, size = [], 0
        if held:
            yield from rows(_added(held))

    dealt = super_kmers(records, id_col, seq, k, start).repartition("bucket")
    return dealt.mapInArrow(count, f"code long, n long, id {kind}, pos long")


def _parts(records: DataFrame, seq: str) -> int:
    """Tasks to count in: by the bases, and for small inputs as many as there are partitions."""
    bases = records.agg(F.sum(F.octet_length(seq))).first()[0] or 0
    few = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-bases // PART_WINDOWS), min(few, -(-bases // (PART_WINDOWS // 8))))


def _words(records: DataFrame, seq: str, k: int, parts: int, group: str | None, kept: Callable | None) -> DataFrame:
    """part, group, words, sizes: all windows by the task that counts them. A word is a run of windows with one minimiser, its first
    base highest; sizes: a byte a word, how many windows. kept: of codes, which of them count (then a word is one window)."""
    _checked(k)
    m = min(M, (k + 1) // 2)
    kind = "string" if group is None else records.schema[group].dataType.simpleString()
    most = WORD - k + 1

    def runs(digits: np.ndarray, code: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, ...]:
        """place, word, size and part."""
        if kept is not None:
            at = np.flatnonzero(clean & kept(code))
            return at, code[at] << np.uint64(2 * (WORD - k)), np.ones(len(at), dtype=np.uint8), (C.mixed(code[at]) % np.uint64(parts)).astype(np.int32)
        lowest = C.least(C.mixed(C.codes(digits, m)) >> np.uint64(16), k - m + 1)
        at = np.flatnonzero(clean)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (lowest[at[1:]] != lowest[at[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        more = -(-size // most)
        inner = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        first, size = np.repeat(first, more) + inner * most, np.minimum(most, np.repeat(size, more) - inner * most)
        place = at[first]
        shift = (2 * (most - size)).astype(np.uint64)
        word = C.codes(np.append(digits, np.zeros(WORD - k, dtype=digits.dtype)), WORD)[place] >> shift << shift
        return place, word, size.astype(np.uint8), (lowest[place] % np.uint64(parts)).astype(np.int32)

    def dealt(held: list[tuple[np.ndarray, ...]], groups: pa.Array) -> Iterator[pa.RecordBatch]:
        part, own, word, size = (np.concatenate(x) for x in zip(*held, strict=True))
        key = own.astype(np.int64) * parts + part
        order = np.argsort(key, kind="stable")
        key, word, size = key[order], word[order], size[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(first, len(key))
        binary = lambda x, width: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(x)])
        names = ["part", "group", "words", "sizes"]
        yield pa.RecordBatch.from_arrays([pa.array((key[first] % parts).astype(np.int32)), groups.take(pa.array(key[first] // parts)), binary(word, 8), binary(size, 1)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = C.flat(batch.column(0))
            coded = batch.column(1).dictionary_encode(null_encoding="encode")
            groups, of_row = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            held, n = [], 0
            for a, digits, code, clean in C.steps(raw, offsets, k):
                place, word, size, part = runs(digits, code, clean)
                if len(place):
                    held.append((part, of_row[C.located(offsets, a + place)[0]], word, size))
                    n += len(place)
                if n > HELD_WORDS:
                    yield from dealt(held, groups)
                    held, n = [], 0
            if held:
                yield from dealt(held, groups)

    own = F.lit(None).cast("string") if group is None else F.col(group)
    return records.select(F.coalesce(seq, F.lit("")).alias("seq"), own.alias("group")).mapInArrow(cut, f"part int, group {kind}, words binary, sizes binary")


def _windows_of(words: pa.Array, sizes: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Codes of the windows of packed runs."""
    word, size = np.frombuffer(C.flat(words)[0].tobytes(), dtype=np.uint64), C.flat(sizes)[0]
    mask = np.uint64((1 << (2 * k)) - 1)
    for a in range(0, len(word), HELD_WORDS):
        w, n = word[a : a + HELD_WORDS], size[a : a + HELD_WORDS]
        yield np.concatenate([(w[n > j] >> np.uint64(2 * (WORD - k - j))) & mask for j in range(int(n.max()))])


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order, each once, and their sums."""
    code, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[first], np.add.reduceat(n, first)


def _in_task(records: DataFrame, seq: str, k: int, most: int | None, only_number: bool, group: str | None = None, kept: Callable | None = None) -> DataFrame:
    """group, code, n, whole: a task's codes with sums; whole: no other row of the group has that code.

    most: where all are whole, the most frequent of each group only (ties by code); only_number: one row a group without a code,
    n: how many there are.
    """
    kind = "string" if group is None else records.schema[group].dataType.simpleString()
    names = ["group", "code", "n", "whole"]

    def rows(own: pa.Scalar, code: np.ndarray, n: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
        if whole and only_number:
            yield pa.RecordBatch.from_arrays([pa.array([own.as_py()], own.type), pa.array([None], pa.int64()), pa.array([len(code)]), pa.array([True])], names)
            return
        if whole and most is not None and len(code) > most:  # codes are in order
            least = np.partition(n, len(n) - most)[len(n) - most]
            more, equal = np.flatnonzero(n > least), np.flatnonzero(n == least)
            at = np.append(more, equal[: most - len(more)])
            code, n = code[at], n[at]
        for a in range(0, len(code), 100_000):
            c = code[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.repeat(own, len(c)), C.as_long(c), pa.array(n[a : a + 100_000]), pa.array(np.full(len(c), whole))], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size, last, whole = 0, 0, True  # codes held, and how many of them were different when they were added up last
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(1)[i]
                for code in _windows_of(batch.column(2).slice(i, 1), batch.column(3).slice(i, 1), k):
                    held.setdefault(own, []).append((code, np.ones(len(code), dtype=np.int64)))
                    size += len(code)
                    if size > HELD_CODES and size > 2 * last:
                        held = {g: [_summed(x)] for g, x in held.items()}
                        size = last = sum(len(x[0][0]) for x in held.values())
                        if size > MOST_CODES:
                            whole = False
                            for g, x in held.items():
                                yield from rows(g, *x[0], whole)
                            held, size, last = {}, 0, 0
        for g, x in held.items():
            yield from rows(g, *_summed(x), whole)

    parts = _parts(records, seq)
    dealt = _words(records, seq, k, parts, group, kept).repartitionById(parts, "part")
    return dealt.select("part", "group", "words", "sizes").mapInArrow(count, f"group {kind}, code long, n long, whole boolean")


def top_by_group(records: DataFrame, group: str, seq: str, k: int, most: int, kept: Callable | None = None) -> DataFrame:
    """group, kmer, occurrences of each group's most frequent k-mers; ties by k-mer. kept: of codes (numpy), which of them count."""
    each = _in_task(records, seq, k, most, False, group, kept)
    sums = each.groupBy("group", "code").agg(F.sum("n").alias("occurrences")).select(F.col("group").alias(group), S.unpacked(F.col("code"), k).alias("kmer"), "occurrences")
    return top_per_group(sums, group, [F.desc("occurrences"), "kmer"], most).drop("rank")


def _first_in_tasks(records: DataFrame, id_col: str, seq: str, k: int, codes: np.ndarray, start: str | None) -> DataFrame:
    """code, first (id, pos) of the given codes (in order). A task sends a batch's first place of each code."""
    kind = records.schema[id_col].dataType.simpleString()
    bits = np.zeros(min(MOST_BITS, 1 << max(10, (BITS * max(len(codes), 1) - 1).bit_length())), dtype=bool)
    bits[_place_of(codes, len(bits))] = True
    none = np.iinfo(np.int64).max

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = C.flat(batch.column(1))
            rank = pc.rank(batch.column(0), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
            row_of = np.zeros(len(rank) + 1, dtype=np.int64)
            row_of[rank] = np.arange(len(rank))
            starts = batch.column(2).to_numpy()
            best = np.full(len(codes), none)  # rank, then 40 bits of the place
            for a, _, code, clean in C.steps(raw, offsets, k):
                at = np.flatnonzero(clean & bits[_place_of(code, len(bits))])
                i = np.minimum(np.searchsorted(codes, code[at]), len(codes) - 1)
                same = codes[i] == code[at]
                row, pos = C.located(offsets, a + at[same])
                np.minimum.at(best, i[same], (rank[row] << 40) | (pos + starts[row]))
            found = np.flatnonzero(best < none)
            for part in np.array_split(found, -(-len(found) // 100_000) or 1):
                row = row_of[best[part] >> 40]
                yield pa.RecordBatch.from_arrays([C.as_long(codes[part]), batch.column(0).take(pa.array(row)), pa.array(best[part] & ((1 << 40) - 1))], ["code", "id", "pos"])

    each = pieces(records, id_col, seq, start).mapInArrow(find, f"code long, id {kind}, pos long")
    return each.groupBy("code").agg(F.min(F.struct("id", "pos")).alias("first"))


def _apart(raw: np.ndarray, offsets: np.ndarray, k: int, codes: np.ndarray | None, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, code and n: occurrences of codes in each sequence that don't overlap, from the left. codes: those that are looked for, in
    order (all without); bits: a map of them."""
    rows, places, found = [], [], []
    for a, _, code, clean in C.steps(raw, offsets, k):
        at = np.flatnonzero(clean if bits is None else clean & bits[_place_of(code, len(bits))])
        if codes is not None:
            at = at[codes[np.minimum(np.searchsorted(codes, code[at]), len(codes) - 1)] == code[at]]
        row, pos = C.located(offsets, a + at)
        rows.append(row)
        places.append(pos)
        found.append(code[at])
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    row, pos, code = np.concatenate(rows), np.concatenate(places), np.concatenate(found)
    order = np.lexsort((pos, code, row))
    row, pos, code = row[order], pos[order], code[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(row)))
    close = np.flatnonzero(~new[1:] & (np.diff(pos) < k)) + 1
    for g in np.unique(np.searchsorted(first, close, side="right") - 1):
        own, at, size = pos[first[g] : first[g] + n[g]], 0, 0
        while at < len(own):
            at, size = int(np.searchsorted(own, own[at] + k)), size + 1
        n[g] = size
    return row[first], code[first], n


def _best(tables: list[pa.Table], most: int) -> pa.Table:
    """code, id, score: of each code the `most` rows with the highest scores; ties by id."""
    t = pa.concat_tables(tables)
    t = t.take(pc.sort_indices(t, [("code", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
    code = t["code"].to_numpy()
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    return t.filter(pa.array(rank < most))


def _best_in_tasks(records: DataFrame, id_col: str, seq: str, k: int, asked: DataFrame, most: int) -> DataFrame:
    """code, id, score: of each asked code the best `most` records of every task; of more than FEW_WANTED codes all their records."""
    kind = records.schema[id_col].dataType.simpleString()
    few = asked.count() <= FEW_WANTED
    codes = np.sort(asked.select("code").toArrow()["code"].to_numpy().view(np.uint64)) if few else None
    map_ = None if few else _map_of(asked)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = map_
        if few:
            bits = np.zeros(min(MOST_BITS, 1 << max(10, (BITS * max(len(codes), 1) - 1).bit_length())), dtype=bool)
            bits[_place_of(codes, len(bits))] = True
        held, size, last = [], 0, 0
        for batch in batches:
            raw, offsets = C.flat(batch.column(1))
            for a, b in C.row_ranges(offsets):
                row, code, n = _apart(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k, codes, bits)
                held.append(pa.table([C.as_long(code), batch.column(0).take(pa.array(a + row)), pa.array(n)], ["code", "id", "score"]))
                size += len(row)
                if size > HELD_CODES and size > 2 * last:
                    held = [_best(held, most)] if few else held
                    size = last = sum(map(len, held))
                    if not few or size > MOST_CODES:
                        yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=100_000)
                        held, size, last = [], 0, 0
        if size:
            yield from (_best(held, most) if few else pa.concat_tables(held)).combine_chunks().to_batches(max_chunksize=100_000)

    each = records.select(id_col, F.coalesce(seq, F.lit("")).alias("seq")).mapInArrow(find, f"code long, id {kind}, score long")
    return each if few else each.join(asked.select("code"), "code", "left_semi")


def best_records(records: DataFrame, id_col: str, seq: str, wanted: DataFrame, pattern: str, k: int, most: int) -> DataFrame:
    """pattern, id_col, score and rank (from 1): of every wanted pattern (k bases of ACGT; others have none) the `most` records with the
    most occurrences that don't overlap, counted from the left; ties by id.

    A window is one pattern at most, so tasks look their windows up in the wanted codes, and send no more than the best
    `most` records of each code, however many records hold it. More than FEW_WANTED codes meet the records' codes in a join.
    """
    _checked(k)
    code = F.when(F.length(pattern) == k, S.packed(F.col(pattern)))
    asked = stored(wanted.select(pattern).distinct().select(pattern, code.alias("code")).where("code is not null"), "asked-codes")
    best = top_per_group(_best_in_tasks(records, id_col, seq, k, asked, most), "code", [F.desc("score"), "id"], most)
    return best.join(asked, "code").select(pattern, F.col("id").alias(id_col), "score", "rank")


def packed_counts(records: DataFrame, id_col: str, seq: str, k: int, start: str | None = None) -> DataFrame:
    """code, occurrences, first_record, first_pos (the smallest record, then position) of all windows."""
    each = _placed_in_task(records, id_col, seq, k, start)
    out = each.groupBy("code").agg(F.sum("n").alias("occurrences"), F.min(F.struct("id", "pos")).alias("first"))
    return out.select("code", "occurrences", F.col("first.id").alias("first_record"), F.col("first.pos").alias("first_pos"))


def distinct_kmers(records: DataFrame, id_col: str, seq: str, k: int, start: str | None = None) -> DataFrame:
    """distinct_kmers: how many different windows there are. A task sends its number, not its codes."""
    each = _in_task(records, seq, k, None, True)
    rest = F.count_distinct("code")
    return each.agg((rest + F.coalesce(F.sum(F.when(F.col("code").isNull(), F.col("n"))), F.lit(0))).alias("distinct_kmers"))


def first_places(records: DataFrame, id_col: str, seq: str, k: int, wanted: DataFrame) -> DataFrame:
    """code, occurrences, first_record, first_pos of the given codes (of k bases) that occur."""
    asked = wanted.select("code").distinct()
    each = packed_windows(records, id_col, seq, k, asked).join(asked, "code", "left_semi")
    by_record = each.groupBy("code", id_col).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    out = by_record.groupBy("code").agg(F.sum("n").alias("occurrences"), F.min(F.struct(id_col, "pos")).alias("first"))
    return out.select("code", "occurrences", F.col(f"first.{id_col}").alias("first_record"), F.col("first.pos").alias("first_pos"))


def top_targets(records: DataFrame, id_col: str, seq: str, k: int, most: int, start: str | None = None) -> DataFrame:
    """The most frequent k-mers with first places and PAM class; ties by k-mer. start: as for packed_windows."""
    kmer, order = S.unpacked(F.col("code"), k), [F.desc("occurrences"), "kmer"]
    if most <= FEW_WANTED:
        sums = _in_task(records, seq, k, most, False).groupBy("code").agg(F.sum("n").alias("occurrences"))
        top = stored(sums.withColumn("kmer", kmer).orderBy(*order).limit(most), "top-codes")
        codes = np.sort(np.array([r["code"] for r in top.select("code").collect()], dtype=np.int64).view(np.uint64))  # `most` at most
        first = _first_in_tasks(records, id_col, seq, k, codes, start)
        top = top.join(first, "code").withColumns({"first_record": F.col("first.id"), "first_pos": F.col("first.pos")}).orderBy(*order)
    else:
        top = packed_counts(records, id_col, seq, k, start).withColumn("kmer", kmer).orderBy(*order).limit(most)
    return top.select("kmer", "occurrences", "first_record", "first_pos", S.pam(F.col("kmer")).alias("pam"))


def counts(records: DataFrame, id_col: str, seq: str, k: int) -> DataFrame:
    """kmer, occurrences, and the first place: the smallest record, then position."""
    return packed_counts(records, id_col, seq, k).select(S.unpacked(F.col("code"), k).alias("kmer"), "occurrences", "first_record", "first_pos")


def targets(counted: DataFrame, most: int) -> DataFrame:
    """The most frequent k-mers with their PAM class; ties by k-mer."""
    return counted.withColumn("pam", S.pam(F.col("kmer"))).orderBy(F.desc("occurrences"), "kmer").limit(most)


def recount(records: DataFrame, id_col: str, seq: str, wanted: DataFrame, k: int) -> DataFrame:
    """Exact counts and first places of the given k-mers (column kmer), and the first place's base: how many of ACGTN the
    record has before it. Those that never occur, and those that aren't k bases of ACGT, have 0."""
    each = wanted.select("kmer").distinct()
    each = each.withColumn("code", F.when(F.length("kmer") == k, S.packed(F.col("kmer"))))
    got = first_places(records, id_col, seq, k, each.where("code is not null"))
    place = got.select("code", F.col("first_record").alias(id_col), "first_pos").join(records.select(id_col, F.col(seq).alias("seq")), id_col)
    bases = F.length(F.regexp_replace(F.expr("cast(substring(cast(seq as binary), 1, cast(first_pos as int)) as string)"), "[^ACGTN]", "")).cast("long")
    place = place.groupBy("code").agg(F.min(bases).alias("first_base"))
    out = each.join(got, "code", "left").join(place, "code", "left")
    return out.select("kmer", F.coalesce("occurrences", F.lit(0)).cast("long").alias("occurrences"), "first_record", "first_pos", "first_base", S.pam(F.col("kmer")).alias("pam"))


def by_use(recounted: DataFrame) -> DataFrame:
    """Recounted k-mers sorted for use: NGG first, then by occurrences, place and k-mer."""
    return recounted.orderBy(F.when(F.col("pam") == "NGG", 0).otherwise(1), F.desc("occurrences"), F.asc_nulls_last("first_pos"), "kmer")


def distinct_share(number: DataFrame, top: int) -> DataFrame:
    """How many different k-mers there are (as distinct_kmers gives it), and the share (percent) of a table of `top`."""
    n = F.col("distinct_kmers")
    return number.select(n, F.round(F.least(F.lit(100.0), 100.0 * top / n), 1).alias("top_share"))


def top_per_group(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
