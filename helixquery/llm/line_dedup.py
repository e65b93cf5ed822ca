"""Line dedup with levelled sorted runs of line hashes.

Each batch of documents is counted: one row per distinct line key with the number of the batch's documents that hold it.
The batch merge-anti-joins the runs: keys that no run holds become the batch's own run at level 0, sorted by hash; keys
that one holds become additions to it. So every key stands in one run only, and a full level is compacted by merging its
runs into one sorted run of the next level, without counting anything again: a key is rewritten once per level and not once
per batch. A key's documents are its run's count and its additions; only keys with additions (few: most lines are found
once) are summed.

Lines go where the frequent keys are known: the most frequent HOTTEST keys are looked up in place, in an array of
buckets that goes to the tasks (8 bytes a key), so the very common lines are never the key of a shuffle; if there are
more frequent keys, the lines meet the others in a join, and the hits of a text travel back by its hash.

Keys are 64-bit hashes (xxhash64). Every step is a DataFrame or SQL function.

Defined results: a null or empty text is one empty line; an empty key is never dropped; the same
row given twice counts as two documents; the other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixquery.llm import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: Keys that are looked up in place.
HOTTEST = 20_000
#: Lines of a text that are compared with hits of their own.
SLICE = 1024
RUN = "line_hash long, n_docs long"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(lines: Column, min_chars: int) -> Column:
    """The hash of each line's key (the line without blanks at both ends, A-Z in lower case); null for keys that are too
    short to be counted. One array a step, so that no step is computed twice; pure ASCII lines take the faster lower()."""
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))
    keys = F.transform(bare, lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER)))
    return F.transform(keys, lambda x: F.when(F.length(x) >= min_chars, F.xxhash64(x)))


def distinct_hashes(text: Column, min_chars: int) -> Column:
    return F.array_compact(F.array_distinct(line_hashes(lines_of(text), min_chars)))


class LineRuns:
    """The levels of sorted runs (line_hash, n_docs), and the additions to their keys."""

    def __init__(self, spark: SparkSession, fanout: int = 4, min_chars: int = 1):
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        self.levels: list[list[str]] = []
        self.additions: list[str] = []
        self.compactions = 0

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def runs(self) -> DataFrame:
        """All runs; each key once."""
        return self._read([p for level in self.levels for p in level])

    def _run(self, counts: DataFrame, level: int) -> None:
        path = scratch.new_path(self.spark, f"line-run-{level}")
        counts.sortWithinPartitions("line_hash").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._run(self._read(old).repartitionByRange("line_hash"), level + 1)
            self.compactions += 1
            scratch.deleted(self.spark, *old)

    def counted(self, docs: DataFrame, text: str = "text", *more: Column) -> DataFrame:
        """line_hash, n_docs of documents, by `more`."""
        hashes = docs.select(*more, F.explode(distinct_hashes(F.col(text), self.min_chars)).alias("line_hash"))
        by = [c for c in hashes.columns if c != "line_hash"]
        return hashes.groupBy(*by, "line_hash").agg(F.count(F.lit(1)).alias("n_docs"))

    def add_counts(self, counts: DataFrame) -> None:
        """Adds a batch's counts: new keys as a run of its own, others as additions."""
        if any(self.levels):
            known = self.runs().select("line_hash").hint("merge")
            again = scratch.new_path(self.spark, "line-additions")
            counts.join(known, "line_hash", "left_semi").write.parquet(again)
            self.additions.append(again)
            counts = counts.join(known, "line_hash", "left_anti")
        self._run(counts, 0)

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Adds a batch of documents."""
        used: list[str] = []
        self.add_counts(scratch.written(self.counted(docs, text), "line-batch", used))
        scratch.deleted(self.spark, *used)

    def frequent(self, min_docs: int) -> DataFrame:
        """line_hash, n_docs of the keys that at least so many documents hold."""
        added = self._read(self.additions).groupBy("line_hash").agg(F.sum("n_docs").alias("more"))
        both = added.join(self.runs(), "line_hash").select("line_hash", (F.col("n_docs") + F.col("more")).alias("n_docs"))
        often = self.runs().where(F.col("n_docs") >= min_docs)
        alone = often.join(self._read(self.additions).select("line_hash"), "line_hash", "left_anti")
        return both.where(F.col("n_docs") >= min_docs).unionByName(alone)


def lookup(keys: list[int]):
    """A function on hashes that tells whether they are among the keys: buckets by the last bits, each a list of numbers in a
    string, which Spark parses once, when it makes the plan."""
    bits = max(0, len(keys).bit_length() - 1)
    buckets: list[list[str]] = [[] for _ in range(1 << bits)]
    for k in keys:
        buckets[k & ((1 << bits) - 1)].append(str(k))
    table = F.split(F.lit(";".join(",".join(b) for b in buckets)), ";")
    bucket = lambda h: F.get(table, h.bitwiseAND((1 << bits) - 1).cast("int"))
    return lambda h: F.coalesce(F.find_in_set(h.cast("string"), bucket(h)) > 0, F.lit(False))


def kept_lines(docs: DataFrame, runs: LineRuns, min_docs: int, text: str = "text") -> DataFrame:
    """docs with two more columns: `__ld_lines`, `__ld_kept` (arrays of lines)."""
    spark, used = docs.sparkSession, []
    frequent = scratch.written(runs.frequent(min_docs), "frequent-lines", used)
    hottest = [r["line_hash"] for r in frequent.orderBy(F.desc("n_docs"), "line_hash").limit(HOTTEST).select("line_hash").collect()]
    is_hot = lookup(hottest)
    lines = lines_of(F.col(text))
    pairs = F.arrays_zip(lines.alias("line"), line_hashes(lines, runs.min_chars).alias("hash"))
    if len(hottest) < HOTTEST:
        scratch.deleted(spark, *used)
        return docs.withColumn("__ld_lines", lines).withColumn("__ld_kept", F.filter(pairs, lambda x: ~is_hot(x.hash)).line)

    # the other keys: a text's lines in slices, so that no line is compared with more hits than a slice has
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / SLICE).cast("int")), lambda k: F.slice(lines, k * SLICE + 1, SLICE))
    each = docs.select(own.alias("__ld_key"), F.posexplode(slices).alias("__ld_slice", "__ld_part"))
    hashes = F.array_distinct(F.filter(line_hashes(F.col("__ld_part"), runs.min_chars), lambda h: h.isNotNull() & ~is_hot(h)))
    each = each.select("__ld_key", "__ld_slice", F.explode(hashes).alias("line_hash")).distinct()
    hits = each.join(frequent.select("line_hash"), "line_hash", "left_semi").groupBy("__ld_key", "__ld_slice").agg(F.collect_set("line_hash").alias("hits"))
    hits = hits.groupBy("__ld_key").agg(F.map_from_entries(F.collect_list(F.struct("__ld_slice", "hits"))).alias("__ld_hits"))
    out = docs.withColumn("__ld_key", own).join(hits.hint("shuffle_hash"), "__ld_key", "left")
    in_slice = lambda h, i: F.array_contains(F.element_at("__ld_hits", F.floor(i / SLICE).cast("int")), h)
    gone = lambda h, i: is_hot(h) | F.coalesce(in_slice(h, i), F.lit(False))
    return out.withColumn("__ld_lines", lines).withColumn("__ld_kept", F.filter(pairs, lambda x, i: ~gone(x.hash, i)).line).drop("__ld_key", "__ld_hits")


def runs_of(docs: DataFrame, batches: int | list[DataFrame] = 4, fanout: int = 2, min_chars: int = 1, text: str = "text") -> LineRuns:
    """The runs of a table that arrives in batches: the given ones, or as many as told, dealt by a hash of the rows and counted
    in one pass."""
    runs = LineRuns(docs.sparkSession, fanout, min_chars)
    if not isinstance(batches, int):
        for batch in batches:
            runs.add(batch, text)
        return runs
    batch = F.pmod(F.xxhash64(F.col(text)), F.lit(batches)).alias("__ld_batch")
    path = scratch.new_path(docs.sparkSession, "line-batches")
    runs.counted(docs, text, batch).write.partitionBy("__ld_batch").parquet(path)
    counts = docs.sparkSession.read.schema(f"{RUN}, __ld_batch int").parquet(path)
    for k in range(batches):
        runs.add_counts(counts.where(F.col("__ld_batch") == k).select("line_hash", "n_docs"))
    scratch.deleted(docs.sparkSession, path)
    return runs


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int | list[DataFrame] = 4, text: str = "text") -> DataFrame:
    """docs with `text` rid of all lines whose key at least `min_docs` documents hold; same columns.

    batches: how docs arrived. The counts cover all of them.
    """
    out = kept_lines(docs, runs_of(docs, batches, min_chars=min_chars, text=text), min_docs, text)
    new = F.when(F.col(text).isNull(), F.col(text)).otherwise(F.array_join("__ld_kept", "\n"))
    return out.withColumn(text, new).select(*docs.columns)
