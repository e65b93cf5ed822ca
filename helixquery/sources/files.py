"""Readers of text corpora, sequence files, guide lists and pattern lists."""

from __future__ import annotations

import gzip
import io
import lzma
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixquery.functions import sequences as S

FASTA, FASTQ = ("fasta", "fa", "fna", "ffn"), ("fastq", "fq")
RECORD = "id string, sequence string, length long, source_path string"


def text_corpus(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """path, content of all UTF-8 files under root with one of the extensions (all without); files with a byte 0x01 are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if extensions:
        raw = raw.where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(extensions))
    text = raw.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("content"))
    return text.where(~F.contains("content", F.lit("\x01")))


def file_format(path: str) -> tuple[str, str] | None:
    """(fasta or fastq, compression) by the name's end; None for other files."""
    name, packing = path.lower(), ""
    for end, kind in ((".gz", "gzip"), (".xz", "xz")):
        if name.endswith(end):
            name, packing = name[: -len(end)], kind
    end = name.rsplit(".", 1)[-1]
    return ("fasta", packing) if end in FASTA else ("fastq", packing) if end in FASTQ else None


def fasta_records(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(id, raw sequence): the id is the header's first word or `unknown`; lines before a header, blank and `;` lines are skipped."""
    name, parts = None, []
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts)
            name, parts = (line[1:].split() or ["unknown"])[0], []
        elif line and not line.startswith(";") and name is not None:
            parts.append(line)
    if name is not None:
        yield name, "".join(parts)


def fastq_records(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(id, raw sequence) of strict four-line records; an error where a file breaks the rules."""
    it = (x.rstrip("\r\n") for x in lines)
    for head in it:
        if not head:
            continue
        seq, plus, quality = next(it, None), next(it, None), next(it, None)
        if not head.startswith("@") or quality is None or not plus.startswith("+") or len(quality) != len(seq):
            raise ValueError(f"bad FASTQ record at {head[:40]!r}")
        yield (head[1:].split() or ["unknown"])[0], seq


def sequence_records(spark: SparkSession, path: str, min_length: int = 1) -> DataFrame:
    """id, sequence (normalised), length, source_path, and corrupt (the error of a file that ends in one; its records before stay).

    A file is one task's work; its bytes are unpacked line by line. A truncated or broken archive is corrupt like any other.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "sequence", "source_path", "corrupt"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names)
        for batch in batches:
            for where, raw in zip(batch.column(0), batch.column(1), strict=True):
                kind = file_format(where.as_py())
                if kind is None:
                    continue
                rows = []
                try:
                    opened = {"gzip": gzip.open, "xz": lzma.open}.get(kind[1], lambda f: f)
                    lines = io.TextIOWrapper(opened(io.BytesIO(raw.as_buffer())), encoding="utf-8")  # unpacked as it is read
                    for name, seq in (fasta_records if kind[0] == "fasta" else fastq_records)(x.rstrip("\r\n") for x in lines):
                        rows.append((name, seq, where.as_py(), None))
                        if len(rows) >= 1000:
                            yield pack(rows)
                            rows = []
                except (ValueError, EOFError, OSError, lzma.LZMAError, zlib.error) as error:
                    rows.append((None, None, where.as_py(), str(error)))
                yield pack(rows)

    found = files.mapInArrow(parse, "id string, sequence string, source_path string, corrupt string")
    found = found.withColumn("sequence", F.explode(F.array(S.normalised(F.col("sequence"))))).withColumn("length", F.length("sequence").cast("long"))
    return found.where((F.col("length") >= min_length) | F.col("corrupt").isNotNull())


#: Accepted names of a guide list's sequence column, first match wins: fixed values.
GUIDE_COLUMNS = ["sequence_23mer", "sequence_20mer", "guide_sequence", "sequence", "spacer"]


def guide_list(spark: SparkSession, path: str) -> DataFrame:
    """guide (20 letters, upper case) and valid (ACGT alone) of a CSV, TSV or plain list of guides; an error if none is valid."""
    head = spark.read.text(path).limit(1).collect()
    first = head[0][0] if head else ""
    sep = "\t" if "\t" in first else "," if "," in first else None
    if sep:
        rows = spark.read.option("header", "true").option("sep", sep).csv(path)
        name = next((c for c in rows.columns if c.strip().lower() in GUIDE_COLUMNS), None)
        if name is None:
            raise ValueError(f"no column of {GUIDE_COLUMNS} in {rows.columns}")
        rows = rows.select(F.col(name).alias("g"))
    else:
        rows = spark.read.text(path).select(F.col("value").alias("g"))
    guides = rows.where(F.trim("g") != "").select(F.upper(F.left(F.trim("g"), F.lit(20))).alias("guide"))
    guides = guides.withColumn("valid", F.col("guide").rlike("^[ACGT]{20}$"))
    if guides.where("valid").isEmpty():
        raise ValueError(f"no valid guide in {path}")
    return guides


def guide_table(spark: SparkSession, path: str) -> DataFrame:
    """guide_id, sequence (upper case), target_gene and valid of a TSV with a header: its first three columns, whatever their names;
    rows with fewer than two fields are left out. An error if no row is valid (18 to 30 bases)."""
    rows = spark.read.option("header", "true").option("sep", "\t").csv(path)
    if len(rows.columns) < 2:
        raise ValueError(f"one column in {path}: not a table of guides")
    names = [F.col(f"`{c}`") for c in rows.columns[:3]]
    gene = names[2] if len(names) > 2 else F.lit(None).cast("string")
    out = rows.select(names[0].alias("guide_id"), F.upper(F.trim(names[1])).alias("sequence"), gene.alias("target_gene")).where("sequence is not null")
    out = out.withColumn("valid", F.col("sequence").rlike("^[ACGT]{18,30}$"))
    if out.where("valid").isEmpty():
        raise ValueError(f"no valid guide in {path}")
    return out


def pattern_list(spark: SparkSession, path: str) -> DataFrame:
    """pattern: the lines of a file without blanks around them, blank lines and `#` lines."""
    return spark.read.text(path).select(F.trim("value").alias("pattern")).where("pattern <> '' AND NOT startswith(pattern, '#')")
