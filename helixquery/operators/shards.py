"""Shards, manifests, sizes, and search over permuted bytes."""

from __future__ import annotations

import hashlib
import hmac
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixquery.functions import codes as C
from helixquery.operators import ordered
from helixquery.sources.files import FASTA, FASTQ
from helixquery.storage import small_batches, stored

#: Peak memory per corpus byte, margin on the peak, and the share of free memory that a peak may take: fixed values.
PEAK, MARGIN, FREE_SHARE = 6, 0.25, 0.70


def manifest(files: DataFrame, path: str, content: str, split: Column, source_url: str | None = None, license: str | None = None) -> DataFrame:
    """path, format (fasta or fastq by the name's end, packed or not; null for others), size (bytes), sha256, split, source_url
    and license of every file."""
    name = F.regexp_extract(F.lower(path), r"\.([a-z]+)(\.gz|\.xz)?$", 1)
    kind = F.when(name.isin(*FASTA), "fasta").when(name.isin(*FASTQ), "fastq")
    own = lambda x: F.lit(x).cast("string")
    return files.select(path, kind.alias("format"), F.octet_length(content).cast("long").alias("size"), F.sha2(F.col(content), 256).alias("sha256"), split.alias("split"), own(source_url).alias("source_url"), own(license).alias("license"))


def manifest_totals(entries: DataFrame) -> DataFrame:
    """split, format, total_files, total_bytes: by both, by either, and of all (nulls stand for any)."""
    return entries.cube("split", "format").agg(F.count(F.lit(1)).alias("total_files"), F.sum("size").alias("total_bytes"))


def shard_plan(files: DataFrame, path: str, size: str, target: int) -> DataFrame:
    """path, size, no (from 0, by path), start (bytes before it) and shard (from 0) of every file.

    Files keep their order; a shard ends before the file that would take it over `target` bytes, and a file larger than that
    is a shard of its own. Where the shard that a file begins would end is a range lookup in the running sizes; the shards'
    starts are what can be reached from the first file by such steps, found by doubling: with the steps of 2^k shards at
    once, each round doubles the known starts. No task sees all files.
    """
    rows = ordered.placed(files.select(F.col(path).alias("path"), F.col(size).cast("long").alias("size")), [F.col("path").asc()])
    rows = ordered.row_numbers(ordered.running_sum(rows, F.col("size"), "start"), "no")
    rows = stored(ordered.plain(rows), "files")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ends = rows.select((F.col("start") + F.col("size")).alias("x"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("no"))
    asked = rows.select((F.col("start") + target).alias("x"), F.lit(1).alias("kind"), "no")
    met = ordered.placed(ends.union(asked), [F.col("x").asc(), F.col("kind").asc()])
    met = ordered.running_sum(met, (F.col("kind") == 0).cast("long"), "ended")
    step = stored(met.where("kind = 1").select("no", F.least(F.greatest(F.col("no") + 1, F.col("ended")), F.lit(n)).alias("next")), "steps")
    steps, most = [step], min(n, 2 * total // max(target, 1) + 2)  # two neighbours exceed the target together
    while 1 << len(steps) < most:
        last = steps[-1]
        twice = last.join(last.select(F.col("no").alias("next"), F.col("next").alias("after")), "next", "left")
        steps.append(stored(twice.select("no", F.coalesce("after", F.lit(n)).alias("next")), "steps"))
    starts = rows.where("no = 0").select("no")
    for step in reversed(steps):
        starts = stored(starts.union(starts.join(step, "no").where(F.col("next") < n).select(F.col("next").alias("no"))), "starts")
    marked = rows.join(starts.withColumn("first", F.lit(1).cast("long")), "no", "left").fillna(0, ["first"])
    marked = ordered.running_sum(ordered.placed(marked, [F.col("no").asc()]), F.col("first"), "earlier")
    return ordered.plain(marked).select("path", "size", "no", "start", (F.col("earlier") + F.col("first") - 1).alias("shard"))


def shard_manifest(plan: DataFrame, files: DataFrame, path: str, content: str) -> DataFrame:
    """Per shard: its files, bytes, place in the whole (corpus_start, corpus_end) and the digest of its files' digests in order."""
    each = plan.join(files.select(F.col(path).alias("path"), F.sha2(F.col(content), 256).alias("sha256")), "path")
    digest = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "sha256"))), lambda x: x.sha256), ""), 256)
    return each.groupBy("shard").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("bytes"), F.min("start").alias("corpus_start"), F.max(F.col("start") + F.col("size")).alias("corpus_end"), digest.alias("sha256"))


def written_shards(plan: DataFrame, files: DataFrame, path: str, content: str, folder: str) -> None:
    """A folder per shard with its files, their digests, and `manifest` beside them."""
    bodies = files.select(F.col(path).alias("path"), F.col(content).alias("content"))
    rows = plan.join(bodies, "path").withColumn("sha256", F.sha2("content", 256))
    rows.repartition("shard").sortWithinPartitions("shard", "no").write.partitionBy("shard").parquet(f"{folder}/shards")
    shard_manifest(plan, files, path, content).write.parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str, shards: list[int] | None = None) -> DataFrame:
    """The files of shards (all without). Content that doesn't have its digest, and a shard that lacks files of the manifest, is an
    error and never an empty result."""
    rows, said = spark.read.parquet(f"{folder}/shards"), spark.read.parquet(f"{folder}/manifest")
    if shards is not None:
        rows, said = rows.where(F.col("shard").isin(shards)), said.where(F.col("shard").isin(shards))
        if said.count() != len(set(shards)):
            raise ValueError(f"the manifest lacks shards of {shards}")
    found = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    missing = said.join(found, "shard", "left").where(F.coalesce("n", F.lit(0)) != F.col("file_count")).select("shard").take(5)
    if missing:
        raise ValueError(f"shards {[r['shard'] for r in missing]} lack files")
    broken = F.raise_error(F.concat(F.lit("changed since it was written: "), F.col("path"))).cast("string")
    return rows.withColumn("content", F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(broken))


def memory_estimate(size: Column, free: int | None) -> Column:
    """Peak, margin and mode of an index over `size` bytes."""
    peak = size * PEAK
    mode = F.when(F.lit(free is not None) & (peak <= F.lit(int((free or 0) * FREE_SHARE))), "in_memory").otherwise("streaming")
    return F.struct(peak.alias("peak"), F.floor(peak * MARGIN).alias("margin"), mode.alias("mode"))


def byte_permutation(key: bytes) -> bytes:
    """256 bytes: a permutation derived from a key by HKDF-SHA256 and a shuffle."""
    info, stream, block = b"byte permutation v1", b"", b""
    prk = hmac.new(b"\x00" * 32, key, hashlib.sha256).digest()
    i = 1
    while len(stream) < 256:
        block = hmac.new(prk, block + info + bytes([i]), hashlib.sha256).digest()
        stream += block
        i += 1
    table = list(range(256))
    for i in range(255, 0, -1):
        j = stream[i] % (i + 1)
        table[i], table[j] = table[j], table[i]
    return bytes(table)


def permuted(table: bytes):
    """A function on texts: their bytes under a permutation. Equal texts stay equal: it hides letters, not frequencies."""
    other = np.frombuffer(table, dtype=np.uint8)

    @F.arrow_udf(T.BinaryType())
    def apply(texts: pa.Array) -> pa.Array:
        raw, offsets = C.flat(texts)
        hidden = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(other[raw])])
        return hidden if not texts.null_count else pc.if_else(texts.is_valid(), hidden, None)

    return apply


def _places(raw: np.ndarray, offsets: np.ndarray, pattern: bytes) -> int:
    """Occurrences (overlapping ones too) of a pattern within values laid end to end, found by stretches of C.STEP bytes."""
    p, n = np.frombuffer(pattern, dtype=np.uint8), 0
    if not len(p):
        return 0
    for a in range(0, len(raw) - len(p) + 1, C.STEP):
        part = raw[a : a + C.STEP + len(p) - 1]
        at = np.flatnonzero(part[: len(part) - len(p) + 1] == p[0])
        for j in range(1, len(p)):
            at = at[part[at + j] == p[j]]
        row, _ = C.located(offsets, a + at)
        n += int(np.count_nonzero(a + at + len(p) <= offsets[row + 1]))
    return n


def blind_counts(docs: DataFrame, id_col: str, text: str, patterns: list[str], key: bytes) -> DataFrame:
    """pattern_no, n: occurrences of permuted patterns in permuted texts (overlapping), without either in the clear. Texts travel
    in batches of bounded size, and a task sends a row for each pattern and batch."""
    table = byte_permutation(key)
    trapdoors = [p.encode().translate(table) for p in patterns]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = C.flat(batch.column(0))
            found = [(no, n) for no, p in enumerate(trapdoors) if (n := _places(raw, offsets, p))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int64())], ["pattern_no", "n"])

    hidden = docs.where(F.col(text).isNotNull()).select(permuted(table)(text).alias("bytes"))  # a filter on the bytes would make them twice
    with small_batches(docs.sparkSession):
        return stored(hidden.mapInArrow(scan, "pattern_no int, n long").groupBy("pattern_no").agg(F.sum("n").alias("n")), "blind-counts")


def encrypted(content: Column, key: bytes) -> Column:
    """AES-256-GCM of a column; the result holds nonce, ciphertext and tag."""
    return F.aes_encrypt(content, F.lit(bytearray(key)), F.lit("GCM"))


def decrypted(content: Column, key: bytes) -> Column:
    """The content; an error with a wrong key or changed bytes."""
    return F.aes_decrypt(content, F.lit(bytearray(key)), F.lit("GCM"))


def derived_key(passphrase: str, salt: bytes) -> bytes:
    """32 bytes by scrypt."""
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=32)


def given_key(spark: SparkSession) -> bytes:
    """32 bytes, given as 64 hex digits by the session's spark.helixquery.key or the environment's HELIXQUERY_KEY; without
    either a random key, with which only the run that made it can read what it hides."""
    given = spark.conf.get("spark.helixquery.key", None) or os.environ.get("HELIXQUERY_KEY")
    if not given:
        return os.urandom(32)
    if not re.fullmatch("[0-9A-Fa-f]{64}", given):
        raise ValueError("the key must have 64 hex digits")
    return bytes.fromhex(given)
