"""N-gram Jaccard join with token-combination prefixes.

A text's set are its distinct k-word shingles, as 64-bit hashes. Two sets of n and m shingles can only
reach a similarity of 0.9 if each lacks at most a tenth of its own (slack = n // 10). Tokens (shingles)
are ordered rare class first, by hash within a class; a set's prefix is extended until losing `slack` of
its tokens cannot lose all its signatures:

- a rare token (in at most RARE sets' counted tokens) is a signature by itself;
- frequent tokens of one hash cell are indexed as combinations of two: a cell with c of them in the prefix
  survives until c - 1 are lost, so it adds c - 1 to the count that must exceed the slack.

Two similar sets share a signature: the one whose prefix ends first keeps one of its signatures whole in
the other, whose prefix holds all its tokens up to there. Cells depend on the set's size, so a set is also
indexed with the cells of the smallest partner it may have.

Any fixed division into rare and frequent gives exact results; a good one keeps the lists short. Tokens
are counted over all sets, but only within a window of each (its smallest hashes, a little more than the
prefix). Sets whose window has too few rare tokens are taken whole, and then all are counted once more.

Signatures with few sets have all their pairs verified. Others, such as the combinations of a family of near
copies, may have any number: their sets are compared with a few random pivots first and links become components. Then
signatures with the same first pivot form a group (a family's signatures have few first pivots), and the sets of a group
outside of its largest component are compared with all its others, block by block: a task gets two blocks of at most about
SETS sets, counts common tokens by an inverted list, and returns no more links than join components. No pair is a row.

Sets that are equal are one class from the start; every row of the result carries its class.

A signature of many sets is dealt over parts of about PART sets where its sets meet its pivots. Tables of a round
are deleted when the next one is written.

Defined results: null and empty texts, or texts without words, have an empty set and no links; repeated
rows are copies of each other; null ids are rows like others, but a component is named by ids that are not
null; only doc_id and text are read. A table without any pair (empty, one row, copies only, unlike texts only) has
no links. `percent` must be over 50: below, prefixes have no combinations to lose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixquery.llm import scratch, text
from helixquery.llm.components import components

#: Sets up to which a token is rare; tokens expected in a hash cell.
RARE, CELL = 32, 6
#: Random pivots of a signature, signatures before its own that a row knows, and sets and tokens in a block of a group, about.
PIVOTS, BEFORE, SETS, HELD = 12, 4, 1024, 4_000_000
#: Sets of one signature that one task handles, about.
PART = 20_000
#: Frequent tokens up to this number (8 bytes each) are sent to the tasks; beyond it they are joined.
FEW_TOKENS = 1_000_000
#: Tokens of sets or windows up to this number (8 bytes each) are broadcast to the pairs; beyond it they are joined.
FEW_COMPARED = 1_000_000
#: Ids up to this number (8 bytes each) are broadcast to find their texts again; beyond it they are joined.
FEW_IDS = 500_000

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
LONGS = T.ArrayType(T.LongType())


def slack(n: int, percent: int) -> int:
    """Tokens that a set of n may lack in a partner."""
    return n - -(-percent * n // 100)


def window_size(n: int, percent: int) -> int:
    s = slack(n, percent)
    return min(n, s + 1 + max(8, s // 4))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words: all of them as one."""
    flat, offsets = text.words(texts, lower=True)
    code, vocabulary = text.codes(flat)
    word = text.string_hashes(vocabulary)[code]
    weights = text.mix(np.arange(1, k + 1, dtype=np.uint64) * K3) | np.uint64(1)
    whole = np.zeros(max(0, len(word) - k + 1), dtype=np.uint64)
    for i in range(k):
        whole += word[i : len(word) - k + 1 + i] * weights[i] if len(whole) else whole
    whole = text.mix(whole)
    sets = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            short = np.full(1, b - a, dtype=np.uint64) * K2
            for i in range(a, b):
                short = short * K1 + word[i : i + 1]
            sets.append(text.mix(short))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64) if arrays else [], type=pa.int64()))


def _rows(lists: pa.Array) -> list[np.ndarray]:
    values, offsets = text.flat_list(lists)
    flat = values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def windows_of(k: int, percent: int, whole: bool):
    """A function on texts: n, a 128-bit hash of the set (hi, lo) and its smallest hashes (all of them: whole)."""
    import xxhash

    kind = T.StructType([T.StructField(x, T.LongType()) for x in ("n", "hi", "lo")] + [T.StructField("tokens", LONGS)])

    @F.arrow_udf(kind)
    def sets(texts: pa.Array) -> pa.Array:
        text.lean()
        done = []
        for a, b in text.steps(texts):
            n, hi, lo, tokens = [], [], [], []
            for s in shingle_sets(texts.slice(a, b - a), k):
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                hi.append((digest >> 64) - (1 << 63))
                lo.append((digest & ((1 << 64) - 1)) - (1 << 63))
                tokens.append(s if whole else s[: window_size(len(s), percent)])
            done.append(pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), _lists(tokens)], ["n", "hi", "lo", "tokens"]))
        return pa.concat_arrays(done) if done else pa.StructArray.from_arrays([pa.array([], pa.int64())] * 3 + [_lists([])], ["n", "hi", "lo", "tokens"])

    return sets.asNondeterministic()  # else Spark tests its fields for null below a semi-join: on every text


def level(n: int) -> int:
    """Cells are the values of this many first bits of a hash."""
    return max(0, (n // CELL).bit_length() - 1)


SIGNED = T.StructType([T.StructField("more", T.BooleanType()), T.StructField("singles", LONGS), T.StructField("combined", LONGS)])


def _combined(frequent: np.ndarray, need: int, bits: int) -> np.ndarray:
    """Pairs within cells over the shortest prefix of `frequent` that adds `need`."""
    cell = frequent >> np.uint64(64 - bits) if bits else np.zeros(len(frequent), dtype=np.uint64)
    adds = np.concatenate(([False], cell[1:] == cell[:-1]))
    enough = np.searchsorted(np.cumsum(adds), need) + 1
    out = []
    for c in np.split(frequent[:enough], np.flatnonzero(~adds[:enough])[1:]):
        i, j = np.triu_indices(len(c), 1)
        out.append(text.mix(c[i] * K1 + c[j] * K2 + np.uint64(bits)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _held(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which values of x are in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(x), dtype=bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _signed(n: pa.Array, sets: list[np.ndarray], often: list[np.ndarray], percent: int) -> pa.Array:
    """Whether more tokens must be known, single and combined signatures. often: which tokens of a set are frequent."""
    more, singles, pairs = [], [], []
    none = np.zeros(0, dtype=np.uint64)
    for size, all_, is_often in zip(n.to_pylist(), sets, often, strict=True):
        need = slack(size, percent) + 1
        rare = all_[~is_often]
        lacks = len(rare) < need
        more.append(bool(lacks and len(all_) < size))
        singles.append(none if more[-1] else rare[:need])
        found = none
        if lacks and not more[-1]:
            levels = {level(size), level(-(-percent * size // 100))}
            found = np.unique(np.concatenate([_combined(all_[is_often], need - len(rare), b) for b in levels]))
        pairs.append(found)
    return pa.StructArray.from_arrays([pa.array(more, pa.bool_()), _lists(singles), _lists(pairs)], SIGNED.names)


@F.arrow_udf(T.LongType())
def shared(a: pa.Array, b: pa.Array) -> pa.Array:
    """Size of the intersection of two sets, each given as an array of distinct hashes in ascending order."""
    text.lean()
    out = []
    for x, y in zip(_rows(a), _rows(b), strict=True):
        if len(x) > len(y):
            x, y = y, x
        at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
        out.append(int((y[at] == x).sum()) if len(y) else 0)
    return pa.array(out, pa.int64())


@F.arrow_udf(T.LongType())
def known_difference(n: pa.Array, a: pa.Array, m: pa.Array, b: pa.Array) -> pa.Array:
    """Tokens that one of two sets has and the other lacks, as far as their windows tell: up to the smaller of their last hashes
    (a window that holds all n tokens tells about all hashes)."""
    text.lean()
    out = []
    for k, x, l, y in zip(n.to_pylist(), _rows(a), m.to_pylist(), _rows(b), strict=True):
        if len(x) < k and (len(y) == l or x[-1] < y[-1]):
            y = y[: np.searchsorted(y, x[-1], side="right")]
        elif len(y) < l:
            x = x[: np.searchsorted(x, y[-1], side="right")]
        out.append(len(x) + len(y) - 2 * int(_held(x, y).sum()))
    return pa.array(out, pa.int64())


def joining_links(percent: int):
    """A function on two blocks of sets (cid, label, tokens): links that join different labels, as many as joins need."""

    def links(left: pa.Table, right: pa.Table) -> pa.Table:
        text.lean()
        out: list[tuple[int, int]] = []
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        if left.num_rows and right.num_rows:
            tokens, ends = text.flat_list(right["r_tokens"].combine_chunks())
            tokens, sizes = tokens.to_numpy(zero_copy_only=False).view(np.uint64), np.diff(ends)
            by = np.argsort(tokens, kind="stable")
            tokens, of = tokens[by], text.rows_of(ends)[by]
            cids, labels = right["r_cid"].to_numpy(), right["r_label"].to_numpy()
            mine = _rows(left["tokens"].combine_chunks())
            for cid, label, x in zip(left["cid"].to_pylist(), left["label"].to_pylist(), mine, strict=True):
                low, high = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(of[at], minlength=len(sizes))
                linked = np.flatnonzero((100 * both >= percent * (sizes + len(x) - both)) & (labels != label))
                for k in linked[np.unique(labels[linked], return_index=True)[1]].tolist():
                    a, b = find(label), find(int(labels[k]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((cid, int(cids[k])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return links


def part_of() -> Column:
    """The part of its signature that a row (cid, parts) falls into."""
    return F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")


def every_part() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")


def size_fits(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


class Join:
    """One run over a table of texts."""

    def __init__(self, docs: DataFrame, k: int = 3, percent: int = 90):
        if percent <= 50:
            raise ValueError("percent must be over 50")
        self.docs = docs.select("doc_id", "text")
        self.spark, self.k, self.percent = docs.sparkSession, k, percent
        self.sets = self.spark.createDataFrame([], "cid long, n long, tokens array<long>")
        self.no_links = self.spark.createDataFrame([], "a long, b long")

    def classes(self) -> None:
        """rows: uid, doc_id, n, hi, lo, tokens; reps: one row (cid) per distinct set."""
        sets = windows_of(self.k, self.percent, whole=False)
        rows = self.docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("text_key"), sets("text").alias("s"))
        self.rows = scratch.written(rows.select("uid", "doc_id", "text_key", "s.*"), "windows")
        full = self.rows.where("n > 0").select("uid", "hi", "lo", "doc_id")
        self.keys = scratch.written(full.groupBy("hi", "lo").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("least_id")), "classes")
        may_link = (100 - self.percent) * F.col("n") >= self.percent  # smaller sets have no partner of another size
        self.reps = self.rows.where(may_link).join(self.keys.select(F.col("cid").alias("uid")), "uid", "left_semi")

    def whole_sets(self, cids: DataFrame) -> DataFrame:
        """(cid, n, tokens) with all tokens, made again from the texts."""
        wanted = self.rows.select("uid", "doc_id", "hi", "lo").join(cids.select(F.col("cid").alias("uid")), "uid", "left_semi")
        wanted = scratch.written(wanted.withColumnRenamed("uid", "cid"), "wanted")
        if wanted.isEmpty():
            return wanted.select("cid", F.lit(0).cast("long").alias("n"), F.array().cast("array<long>").alias("tokens"))
        ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
        ids = F.broadcast(ids) if wanted.count() <= FEW_IDS else ids
        texts = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
        sets = texts.select(windows_of(self.k, self.percent, whole=True)("text").alias("s")).select("s.*")
        near = wanted.select("cid", "hi", "lo")
        near = F.broadcast(near) if wanted.count() <= FEW_IDS else near
        found = scratch.written(sets.join(near, ["hi", "lo"]).select("cid", "n", "tokens"), "sets")
        n = found.agg(F.count(F.lit(1)).alias("all"), F.count_distinct("cid").alias("each")).first()
        return found if n["all"] == n["each"] else scratch.written(found.dropDuplicates(["cid"]), "sets")

    def frequent(self, counted: DataFrame) -> DataFrame:
        each = counted.select(F.explode("tokens").alias("token"))
        return scratch.written(each.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > RARE).select("token"), "frequent")

    def signed(self, counted: DataFrame, frequent: DataFrame) -> DataFrame:
        """counted (cid, n, tokens) with its signatures under a division into frequent tokens and others."""
        percent = self.percent
        if frequent.count() <= FEW_TOKENS:
            known = self.spark.sparkContext.broadcast(np.sort(frequent.toPandas()["token"].to_numpy(dtype=np.int64)))

            @F.arrow_udf(SIGNED)
            def sign(n: pa.Array, tokens: pa.Array) -> pa.Array:
                sets = _rows(tokens)
                flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
                held = _held(flat.view(np.int64), known.value)
                ends = np.cumsum([len(x) for x in sets])
                return _signed(n, sets, np.split(held, ends[:-1]) if sets else [], percent)

            out = counted.select("cid", "n", sign("n", "tokens").alias("g"))
        else:

            @F.arrow_udf(SIGNED)
            def sign_with(n: pa.Array, tokens: pa.Array, frequent: pa.Array) -> pa.Array:
                sets = _rows(tokens)
                return _signed(n, sets, [_held(x, np.sort(y)) for x, y in zip(sets, _rows(frequent), strict=True)], percent)

            each = counted.select("cid", F.explode("tokens").alias("token")).join(frequent, "token")
            lists = each.groupBy("cid").agg(F.collect_set("token").alias("frequent"))
            joined = counted.join(lists, "cid", "left").withColumn("frequent", F.coalesce("frequent", F.array().cast("array<long>")))
            out = joined.select("cid", "n", sign_with("n", "tokens", "frequent").alias("g"))
        return scratch.written(out.select("cid", "n", "g.*"), "signatures")

    def index(self) -> None:
        """few (sig, cid, n) and many (sig, cid, n, parts): the signatures with few sets and with many."""
        used: list[str] = []
        counted = self.reps.select(F.col("uid").alias("cid"), "n", "tokens")
        frequent = self.frequent(counted)
        signed = self.signed(counted, frequent)
        more = signed.where("more").select("cid")
        if not more.isEmpty():  # count again with these sets whole
            self.sets = self.whole_sets(more)
            counted = counted.join(self.sets.select("cid"), "cid", "left_anti").unionByName(self.sets)
            frequent = self.frequent(counted)
            signed = self.signed(counted, frequent)
            more = signed.where("more").select("cid")
            if not more.isEmpty():
                sets = self.whole_sets(more)
                self.sets = self.sets.unionByName(sets)
                signed = signed.where("not more").unionByName(self.signed(sets, frequent))
        each = signed.select(F.explode(F.concat("singles", "combined")).alias("sig"), "cid", "n")
        lists = scratch.written(each.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "lists", used)
        shared_ = each.join(lists, "sig")
        shared_ = scratch.written(shared_, "postings")
        scratch.deleted(self.spark, *used)
        self.few = shared_.where(F.col("c") <= RARE).drop("c")
        self.many = shared_.where(F.col("c") > RARE).select("sig", "cid", "n", (1 + F.floor(F.col("c") / PART)).cast("int").alias("parts"))

    def compared(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """pairs (a, b) with n and tokens of both. sets: cid, n, tokens."""
        size = sets.agg(F.sum(F.size("tokens") + 4)).first()[0] or 0
        near = F.broadcast if size <= FEW_COMPARED else lambda x: x
        for x in ("a", "b"):
            pairs = pairs.join(near(sets.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))), x)
        return pairs

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b). Their windows show of most other pairs that they differ too much; whole sets are
        compared for the rest."""
        used: list[str] = []
        pairs = scratch.written(pairs, "candidates", used)
        n_pairs = pairs.count()
        if not n_pairs:
            return self.no_links
        ids = scratch.written(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "compared", used)
        near_ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
        windows = self.reps.join(near_ids, "uid", "left_semi").select(F.col("uid").alias("cid"), "n", "tokens")
        seen = self.compared(pairs, windows).withColumn("apart", known_difference("n_a", "t_a", "n_b", "t_b"))
        may = (100 + self.percent) * F.col("apart") <= (100 - self.percent) * (F.col("n_a") + F.col("n_b"))
        pairs = scratch.written(seen.where(may).select("a", "b"), "pairs", used)
        cids = scratch.written(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "compared", used)
        missing = cids.join(self.sets.select("cid"), "cid", "left_anti")
        if not missing.isEmpty():
            self.sets = self.sets.unionByName(self.whole_sets(missing))
        near_cids = F.broadcast(cids) if cids.count() <= FEW_IDS else cids
        both = self.compared(pairs, self.sets.join(near_cids, "cid", "left_semi")).withColumn("shared", shared("t_a", "t_b"))
        union = F.col("n_a") + F.col("n_b") - F.col("shared")
        links = scratch.written(both.where(100 * F.col("shared") >= self.percent * union).select("a", "b"), "links")
        scratch.deleted(self.spark, *used)
        return links

    def few_pairs(self) -> DataFrame:
        x, y = self.few.toDF("sig", "a", "n_a"), self.few.toDF("sig", "b", "n_b")
        found = x.join(y, "sig").where((F.col("a") < F.col("b")) & size_fits(F.col("n_a"), F.col("n_b"), self.percent))
        return found.select("a", "b").distinct()

    def random_pivots(self, active: DataFrame) -> DataFrame:
        """active with `pivot`: the first set in each of PIVOTS random orders, the same orders everywhere: signatures share
        their pivots."""
        first = [F.min(F.struct(F.xxhash64("cid", F.lit(p)).alias("order"), "cid")) for p in range(PIVOTS)]
        heads = active.groupBy("sig").agg(F.array(*first).alias("p"))
        heads = heads.select("sig", F.explode(F.array_distinct(F.transform("p", lambda x: x.cid))).alias("cid"), F.lit(True).alias("pivot"))
        return active.join(heads, ["sig", "cid"], "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))

    def many_links(self) -> DataFrame:
        """Links among the sets of each signature with many, enough of them for its components."""
        if self.many.isEmpty():
            return self.no_links
        own = Window.partitionBy("cid").orderBy("sig").rowsBetween(-BEFORE, -1)  # a set has few signatures
        rows = self.random_pivots(self.many)
        rows = rows.withColumn("met", F.collect_list("sig").over(own)).withColumn("led", F.collect_list(F.when(F.col("pivot"), F.col("sig"))).over(own))
        used: list[str] = []
        rows = scratch.written(rows, "active", used)
        heads = rows.where("pivot").select("sig", F.col("cid").alias("a"), F.col("n").alias("n_a"), "led", every_part())
        pairs = rows.drop("led").withColumn("part", part_of()).join(heads, ["sig", "part"])
        fits = (F.col("cid") != F.col("a")) & size_fits(F.col("n"), F.col("n_a"), self.percent) & ~F.arrays_overlap("met", "led")  # else they meet elsewhere
        pairs = pairs.where(fits).select(F.least("a", "cid").alias("a"), F.greatest("a", "cid").alias("b")).distinct()
        links = self.verified(pairs)

        first = self.many.groupBy("sig", "parts").agg(F.min(F.struct(F.xxhash64("cid", F.lit(0)).alias("order"), "cid")).alias("first"))
        members = self.many.withColumn("part", part_of()).join(first.select("sig", F.col("first.cid").alias("head"), every_part()), ["sig", "part"])
        members = members.select("head", "cid", "n").distinct().join(components(links).select(F.col("node").alias("cid"), F.col("root").alias("label")), "cid", "left")
        members = scratch.written(members.withColumn("label", F.coalesce("label", "cid")), "members", used)
        labels = members.groupBy("head", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
        largest = F.max(F.struct("c", "label", "t")).alias("largest")
        groups = labels.groupBy("head").agg(largest, F.sum("c").alias("size"), F.sum("t").alias("held"))
        blocks = lambda c, t: F.greatest(F.ceil(c / SETS), F.ceil(t / HELD)).cast("int")
        outside = blocks(F.col("size") - F.col("largest.c"), F.col("held") - F.col("largest.t"))
        groups = groups.where("largest.c < size").select("head", F.col("largest.label").alias("largest"), blocks(F.col("size"), F.col("held")).alias("blocks"), outside.alias("outside"))
        of = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
        rows = members.join(groups, "head").withColumn("block", F.when(F.col("label") != F.col("largest"), of("outside"))).withColumn("r_block", of("blocks"))
        rows = scratch.written(rows.drop("n"), "grouped", used)
        missing = rows.select("cid").distinct().join(self.sets.select("cid"), "cid", "left_anti")
        if not missing.isEmpty():
            self.sets = self.sets.unionByName(self.whole_sets(missing))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.where("block is not null").select("head", F.col("block").alias("i"), every("blocks").alias("j"), "cid", "label")
        right = rows.select("head", every("outside").alias("i"), F.col("r_block").alias("j"), "cid", "label")  # once for each block of outsiders
        sets = self.sets.join(rows.select("cid").distinct(), "cid", "left_semi").select("cid", "tokens")
        near = F.broadcast(sets) if (sets.agg(F.sum(F.size("tokens") + 4)).first()[0] or 0) <= FEW_COMPARED else sets
        key = ["head", "i", "j"]
        found = left.join(near, "cid").groupBy(*key).cogroup(right.join(near, "cid").select(*(F.col(c).alias(f"r_{c}") for c in (*key, "cid", "label", "tokens"))).groupBy(*(f"r_{c}" for c in key)))
        links = links.union(scratch.written(found.applyInArrow(joining_links(self.percent), "a long, b long"), "links"))
        scratch.deleted(self.spark, *used)
        return links

    def run(self) -> DataFrame:
        """doc_id, text_key, n_shingles, component_id, class_id (smallest id with the same set), root of every row; root is the
        component's own number (null: no words)."""
        with scratch.small_batches(self.spark, 1000, "4m"):  # all Python functions run in here
            self.classes()
            self.index()
            scratch.released(self.spark)
            links = self.many_links()
            scratch.released(self.spark)
            links = links.union(self.verified(self.few_pairs()))
        roots = components(links)
        keys = self.keys.join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
        keys = scratch.written(keys.select("hi", "lo", "least_id", "root"), "labelled")
        names = keys.groupBy("root").agg(F.min("least_id").alias("component_id"))
        named = keys.join(names, "root").select("hi", "lo", "component_id", "least_id", "root")
        out = self.rows.select("doc_id", "text_key", "n", "hi", "lo").join(named, ["hi", "lo"], "left")
        own = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id"))
        root = F.when(F.col("n") > 0, F.col("root")).alias("root")
        return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), own("component_id").alias("component_id"), own("least_id").alias("class_id"), root)


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every row."""
    return Join(docs, k, percent).run().drop("text_key", "root")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of every component, with its columns: the smallest id (null ids last), then the smallest hash of the text.
    Texts without words all stay. Rows are told apart by id and text; of rows that have both in common one stays."""
    found = scratch.written(Join(docs, k, percent).run().where("root is not null"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    first = scratch.written(found.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")), "first")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.key"))
    gone = found.join(first.where("rows > 1"), "root").where(~is_first).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    gone = scratch.written(gone.distinct(), "gone")
    near = F.broadcast(gone) if gone.count() <= FEW_IDS else gone
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    id_, key = F.col("doc.doc_id"), F.xxhash64("doc.text")
    kept = packed.join(near, id_.eqNullSafe(F.col("gone_id")) & (key == F.col("gone_key")), "left_anti")
    same = found.join(first.where("rows > 1"), "root").where(is_first)
    repeats = scratch.written(same.groupBy(F.col("doc_id").alias("re_id"), F.col("text_key").alias("re_key")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("re_id", "re_key"), "repeats")
    if not repeats.isEmpty():
        again = id_.eqNullSafe(F.col("re_id")) & (key == F.col("re_key"))
        some = kept.join(repeats, again, "left_semi").withColumn("id", id_).withColumn("key", key).dropDuplicates(["id", "key"])
        kept = kept.join(repeats, again, "left_anti").unionByName(some.select("doc"))
    return kept.select("doc.*")
