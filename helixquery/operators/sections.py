"""Sections of files by language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window and of what two of them share, for files without any boundary.
WINDOW, OVERLAP = 50, 25
#: Which lines begin a section, by language; group 1 is the section's name. Unindented where the pattern has no blanks in front.
BOUNDARIES = {
    "rs": [r"\s*((?:pub )?mod .*)", r"\s*(impl[ <][^{]*)", r"((?:pub |pub\(crate\) )?fn [^{]*)", r"\s*(// (?:---|===).*)"],
    "py": [r"((?:class|def|async def) [^:]*)", r"\s*(# (?:---|===).*)"],
    "erl": [r"\s*(-module\(.*|%%---.*|%% ---.*)", r"([^\W\d_A-Z]\w*)\s*\("],
    "md": [r"\s*(#.*)"],
    "html": [r"\s*<[hH][123][^>]*>\s*([^<]*[^<\s])", r"\s*(<[hH][123].*)"],
}
LANGUAGES = {"rs": "rs", "py": "py", "erl": "erl", "hrl": "erl", "md": "md", "markdown": "md", "html": "html", "htm": "html"}
_COMPILED = {k: [re.compile(p) for p in v] for k, v in BOUNDARIES.items()}


def boundary(line: str, language: str) -> str | None:
    """The name of the section that a line begins; None if it begins none."""
    if not language:  # text: lines of capitals, blanks and hyphens alone
        name = line.strip()
        capital = all(c.isupper() or c in " -" for c in name) and any(c.isupper() for c in name)
        return name if capital and len(name.encode()) >= 3 else None
    for i, p in enumerate(_COMPILED[language]):
        m = p.match(line)
        if m:
            name = m[1].strip()
            if language == "erl" and i:
                return f"{name}()" if name[0].islower() else None
            return name
    return None


def cut(path: str, content: str) -> Iterator[tuple[str, int, int, str]]:
    """(name, start, end, text) of a file's sections, in bytes of the content; text before the first boundary is in none."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1], "")
    lines = content.split("\n")
    sizes = [len(x.encode()) + 1 for x in lines]
    starts = [(i, name) for i, x in enumerate(lines) if (name := boundary(x, language)) is not None]
    at, done, whole = 0, 0, sum(sizes) - 1
    if starts:
        for (i, name), (j, _) in zip(starts, [*starts[1:], (len(lines), None)], strict=True):
            at += sum(sizes[done:i])
            size = sum(sizes[i:j])
            yield name, at, min(at + size, whole), "\n".join(lines[i:j]) + ("\n" if j < len(lines) else "")
            at, done = at + size, j
        return
    for i in range(0, len(lines), WINDOW - OVERLAP):
        j = min(i + WINDOW, len(lines))
        yield f"lines {i + 1}-{j}", at, min(at + sum(sizes[i:j]), whole), "\n".join(lines[i:j])
        at += sum(sizes[i : i + WINDOW - OVERLAP])


def sections(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, section (from 0), name, start, end and text of every file's sections. Null contents have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "section", "name", "start", "end", "text"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for where, body in zip(batch.column(0), batch.column(1), strict=True):
                where, body = where.as_py(), body.as_py()
                rows = [] if body is None else [(where, i, *x) for i, x in enumerate(cut(where or "", body))]
                for a in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 1000], strict=True), kinds, strict=True)], names=names)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, "path string, section long, name string, start long, `end` long, text string")
