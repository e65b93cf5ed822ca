"""Token counts by rank-synchronous merging of arrays.

Texts are cut into pre-tokens: blanks (the vocabulary's mark U+2581) and the characters that follow
them. No entry of the vocabulary has a mark after another character, so merges never cross these
cuts and every distinct pre-token is counted once. New pre-tokens of a batch are held as one ragged
array of symbols; in each round every sequence finds its lowest-ranked pair and all sequences
merge theirs at once; what is left when no sequence has a pair is counted, with a symbol that the
vocabulary lacks as its UTF-8 bytes.

A sequence merges all places of its lowest rank in one round (leftmost first where they overlap)
unless that could differ from merging one place at a time: when a merge gives a pair of lower rank,
or when different entries share the rank. Then it merges the leftmost place alone.

Defined results: a null or empty text has no tokens; special strings are ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixquery.llm import text

MARK = "▁"
NONE = np.int64(1) << np.int64(60)


class MergeTable:
    """Which pairs of entries merge, into what and in which order, from a model file's entries and scores."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.size = np.int64(model.get_piece_size())
        scores = np.array([model.get_score(i) for i in range(model.get_piece_size())])
        ranks = np.searchsorted(np.unique(-scores), -scores)  # 0: best score
        left, right, into = [], [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    into.append(i)
        self.shared = np.bincount(ranks[plain], minlength=ranks.max() + 1) > 1
        keys = np.array(left, dtype=np.int64) * self.size + np.array(right, dtype=np.int64)
        self._fill(keys, np.array(into, dtype=np.int64), ranks)
        char = np.arange(0x110000)
        self.symbol = -(1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)).astype(np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, into: np.ndarray, ranks: np.ndarray) -> None:
        """A hash table in arrays: a key stands in its slot or, where that is taken, in one of the next `probes`."""
        self.bits, self.probes = max(8, int(len(keys)).bit_length() + 3), 0
        slots = 1 << self.bits
        self.slot_key, self.slot_into, self.slot_rank = np.full(slots, -1), np.zeros(slots, dtype=np.int64), np.full(slots, NONE)
        todo = np.arange(len(keys))
        while len(todo):
            at = (self._slot(keys[todo]) + self.probes) & (slots - 1)
            free = self.slot_key[at] < 0
            who = np.unique(at[free], return_index=True)[1]
            won = np.flatnonzero(free)[who]
            self.slot_key[at[won]], self.slot_into[at[won]], self.slot_rank[at[won]] = keys[todo[won]], into[todo[won]], ranks[into[todo[won]]]
            todo = np.delete(todo, won)
            self.probes += 1

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no such pair) and entry of each pair. Symbols below 0 never merge."""
        key = left * self.size + right
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        held = self.slot_key[at]
        rank, into = np.where(held == key, self.slot_rank[at], NONE), self.slot_into[at]
        for k in range(1, self.probes):
            open_ = np.flatnonzero((held != key) & (held >= 0)) if k == 1 else open_[(held != key[open_]) & (held >= 0)]
            if not len(open_):
                break
            there = (at[open_] + k) & ((1 << self.bits) - 1)
            held = self.slot_key[there]
            good = held == key[open_]
            rank[open_[good]], into[open_[good]] = self.slot_rank[there[good]], self.slot_into[there[good]]
        return rank, into


def merged_counts(table: MergeTable, symbols: np.ndarray, seq: np.ndarray, n: int) -> np.ndarray:
    """Symbols per sequence when nothing merges any more; a symbol -k counts k. seq: ascending, 0..n-1."""
    total = np.zeros(n, dtype=np.int64)
    single = np.zeros(n, dtype=bool)  # merge one place in the coming round

    def ranked(symbols: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and entry of the pair that begins at each symbol; NONE at a sequence's last."""
        rank, into = np.full(len(symbols), NONE), np.zeros(len(symbols), dtype=np.int64)
        rank[:-1], into[:-1] = table.pairs(symbols[:-1], symbols[1:])
        rank[:-1][seq[1:] != seq[:-1]] = NONE
        return rank, into

    rank, into = ranked(symbols, seq)
    while len(symbols):
        heads = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        lowest = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(seq))))
        ended = lowest == NONE
        if ended.any():  # these sequences leave the arrays
            total += np.bincount(seq[ended], weights=np.where(symbols[ended] < 0, -symbols[ended], 1), minlength=n).astype(np.int64)
            symbols, seq, rank, into, lowest = (x[~ended] for x in (symbols, seq, rank, into, lowest))
            if not len(symbols):
                break
        at = np.flatnonzero(rank == lowest)
        begins = np.concatenate(([True], np.diff(at) > 1))
        run = np.maximum.accumulate(np.where(begins, at, 0))
        at = at[(at - run) % 2 == 0]  # overlapping places: every other one
        alone = single[seq[at]] | table.shared[rank[at]]
        leading = np.concatenate(([True], seq[at][1:] != seq[at][:-1]))
        at = at[~alone | leading]
        out = symbols.copy()
        out[at] = into[at]
        stay = np.ones(len(symbols), dtype=bool)
        stay[at + 1] = False
        new, new_seq = out[stay], seq[stay]
        after, after_into = ranked(new, new_seq)
        lower = (after < lowest[stay]) & ~single[new_seq]
        single[:] = False
        if lower.any():  # take those sequences back and let them merge one place
            single[new_seq[lower]] = True
            done, undo = ~single[new_seq], single[seq]
            new, new_seq, after, after_into = (
                np.concatenate([x[done], y[undo]]) for x, y in ((new, symbols), (new_seq, seq), (after, rank), (after_into, into))
            )
            by = np.argsort(new_seq, kind="stable")
            new, new_seq, after, after_into = new[by], new_seq[by], after[by], after_into[by]
        symbols, seq, rank, into = new, new_seq, after, after_into
    return total


class TokenCounter:
    """Counts per text; pre-tokens that were counted are remembered, MOST characters of them."""

    MOST = 8 << 20

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0

    def _count(self, pretokens: list[str]) -> np.ndarray:
        pretokens = [MARK + x for x in pretokens]
        points = np.frombuffer("".join(pretokens).encode("utf-32-le"), dtype=np.uint32)
        symbols = self.table.symbol[points]
        seq = np.repeat(np.arange(len(pretokens)), [len(x) for x in pretokens])
        return merged_counts(self.table, symbols, seq, len(pretokens))

    def counts(self, texts: pa.Array) -> np.ndarray:
        if self.held > self.MOST:
            self.clear()
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        odd = pc.match_substring_regex(texts, "  |^ ")
        if pc.any(odd).as_py():  # several blanks belong to one pre-token: here only the last of them cuts
            marked = pc.replace_substring_regex(pc.replace_substring(texts.filter(odd), " ", MARK), f"([^{MARK}]){MARK}", "\\1 ")
            lists = text.replaced(lists, odd, pc.split_pattern(marked, " "))
        parts, offsets = text.flat_list(lists)
        code, distinct = text.codes(parts)
        names = distinct.to_pylist()
        new = [x for x in names if x not in self.known]
        self.known.update(zip(new, self._count(new).tolist(), strict=True))
        self.held += sum(map(len, new))
        each = np.fromiter(map(self.known.__getitem__, names), dtype=np.int64, count=len(names))[code]
        return text.per_row(each, offsets) * full


_counters: dict[str, TokenCounter] = {}


def token_count(path: str):
    """A function on texts: the number of tokens that the model file at `path` gives."""

    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        text.lean()
        if path not in _counters:
            _counters[path] = TokenCounter(path)
        counter = _counters[path]
        try:
            for texts in batches:
                found = [counter.counts(texts.slice(a, b - a)) for a, b in text.steps(texts, 2 * text.STEP_BYTES)]
                yield pa.array(np.concatenate(found) if found else [], type=pa.int64())
        finally:  # an idle worker keeps the model only
            counter.clear()
            text.lean()

    return count


def over_limit(n_tokens: Column, limit: int) -> Column:
    return n_tokens > limit
