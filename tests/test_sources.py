"""Readers against files written here, and the stream."""

import gzip
import lzma

import pytest

from helixquery.operators import kmers
from helixquery.sources import documents, files, pieces
from helixquery.streaming.kmers import running_counts


def test_sequence_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text("lost\n>r1 first\nacg\n;no\n\nUNR\n>\nGG\n>empty\n")
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(b"@q1 x\nACGT\n+\nIIII\n@q2\nAC\n+\nI\n"))
    (tmp_path / "c.fna.xz").write_bytes(lzma.compress(b">x\nTTTT\n"))
    (tmp_path / "d.txt").write_text(">no\nACGT\n")
    rows = files.sequence_records(spark, str(tmp_path)).collect()
    assert {(r.id, r.sequence) for r in rows if r.corrupt is None} == {("r1", "ACGTNN"), ("unknown", "GG"), ("q1", "ACGT"), ("x", "TTTT")}
    assert [r.source_path.rsplit("/", 1)[1] for r in rows if r.corrupt] == ["b.fastq.gz"]


def test_truncated_archives_are_corrupt_and_the_others_stay(spark, tmp_path):
    text = "".join(f">r{i}\n{'ACGT' * 400}\n" for i in range(200)).encode()
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(text)[:-20])
    (tmp_path / "b.fa.xz").write_bytes(lzma.compress(text)[:-20])
    (tmp_path / "c.fa.gz").write_bytes(b"no archive")
    (tmp_path / "d.fa").write_bytes(b">ok\nAC\n")
    rows = files.sequence_records(spark, str(tmp_path)).collect()
    assert sorted(r.source_path.rsplit("/", 1)[1] for r in rows if r.corrupt) == ["a.fa.gz", "b.fa.xz", "c.fa.gz"]
    assert "ok" in {r.id for r in rows} and "r0" in {r.id for r in rows}


def test_text_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.rs").write_text("é")
    (tmp_path / "sub" / "b.py").write_text("b")
    (tmp_path / "c.rs").write_bytes(b"\xff")
    (tmp_path / "d.rs").write_bytes(b"a\x01")
    got = {r.path.rsplit("/", 1)[1]: r.content for r in files.text_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.rs": "é", "b.py": "b"}
    assert [r.content for r in files.text_corpus(spark, str(tmp_path), ["py"]).collect()] == ["b"]


def test_guides_and_patterns(spark, tmp_path):
    g = "ACGTACGTACGTACGTACGT"
    (tmp_path / "g.tsv").write_text(f"guide_id\tsequence\tgene\ng1\t{g.lower()}GG\tx, y\ng2\tNNN\tz\n")
    assert [(r.guide, r.valid) for r in files.guide_list(spark, str(tmp_path / "g.tsv")).collect()] == [(g, True), ("NNN", False)]
    (tmp_path / "g.txt").write_text("guide_1 not a sequence\n")
    with pytest.raises(ValueError):
        files.guide_list(spark, str(tmp_path / "g.txt"))
    (tmp_path / "p.txt").write_text(" a \n\n# no\nb.c\n")
    assert [r.pattern for r in files.pattern_list(spark, str(tmp_path / "p.txt")).collect()] == ["a", "b.c"]


def test_stream(spark, tmp_path):
    schema = "id long, seq string"
    spark.createDataFrame([(1, "ACGTAC")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(2, "ACGT")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = running_counts(stream, "id", "seq", 4).writeStream.outputMode("complete").format("memory").queryName("kmers").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.kmer, r.occurrences) for r in spark.table("kmers").collect()} == {("ACGT", 2), ("CGTA", 1), ("GTAC", 1)}


def _plain_fasta(r, files):
    """Files by name and their records (id, normalised bases)."""
    texts, wanted = {}, {}
    for f in range(files):
        lines, records = ["stray ACGT", "", "; note"], []
        for n in range(r.randrange(1, 6)):
            head = r.choice([f">r{n} text", ">", f">  s{n}"])
            lines.append(head)
            bases = ""
            for _ in range(r.choice([0, 1, 3, 60])):
                line = "".join(r.choice("ACGTacgtuUNnRy-*") for _ in range(r.choice([0, 7, 60])))
                lines.append(r.choice(["", "  "]) + line)
                bases += line
                if r.random() < 0.1:
                    lines.append(r.choice(["", ";comment ACGT"]))
            up = bases.upper()
            records.append(((head[1:].split() or ["unknown"])[0], "".join("T" if c == "U" else "N" if c in "RY" else c for c in up if c in "ACGTNURY")))
        texts[f"f{f}.fa"] = r.choice(["\n", "\r\n"]).join(lines) + r.choice(["", "\n"])
        wanted[f"f{f}.fa"] = records
    return texts, wanted


@pytest.mark.parametrize("block,size,overlap", [(97, 50, 22), (1000, 7, 3), (1 << 20, 1 << 20, 0), (61, 1 << 20, 31)])
def test_pieces_of_plain_fasta(spark, tmp_path, block, size, overlap):
    import random

    texts, wanted = _plain_fasta(random.Random(block), 4)
    for name, body in texts.items():
        (tmp_path / name).write_bytes(body.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        df = pieces.sequence_pieces(spark, str(tmp_path), overlap, size)
        rows = df.collect()
        cut = pieces.sequence_pieces(spark, str(tmp_path), overlap, size, max_bases=200).collect()
        top = {(x["kmer"], x["occurrences"]) for x in kmers.top_targets(df, "record", "sequence", overlap + 1, 10**6, "start").collect()} if overlap < 32 else None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {}
    for x in rows:
        got.setdefault((x["source_path"].rsplit("/", 1)[-1], x["record"], x["id"]), []).append((x["start"], x["bases"], x["sequence"]))
    want = {(f, n, name): seq for f, records in wanted.items() for n, (name, seq) in enumerate(records) if seq}
    assert set(got) == set(want)
    for key, parts in got.items():
        at = 0
        for start, bases, seq in sorted(parts):
            assert start == at and seq == want[key][start : start + bases + overlap]
            at += bases
        assert at == len(want[key])
    k = overlap + 1
    n = {}
    for seq in want.values():
        for i in range(len(seq) - k + 1):
            if set(seq[i : i + k]) <= set("ACGT"):
                n[seq[i : i + k]] = n.get(seq[i : i + k], 0) + 1
    assert top is None or top == set(n.items())
    assert {(x["record"], x["id"], x["bases"]) for x in cut if x["corrupt"]} == {(n, i, len(s)) for (f, n, i), s in want.items() if len(s) > 200}
    assert sum(x["bases"] for x in cut) == sum(map(len, want.values()))


def test_json_documents(spark, tmp_path):
    import json

    (tmp_path / "r.json").write_text(json.dumps({"title": "x", "regions": [{"best_seq": "ACGT", "best_pos": 5, "gene": "S", "pam_types": ["NGG"]}, {"best_seq": "AC", "gene": "N", "novelty_score": 0.5}]}, indent=1))
    (tmp_path / "s.json").write_text('{"other": 1}')
    rows = documents.novel_regions(spark, str(tmp_path)).collect()
    assert sorted((r.best_seq or "", r.novelty_score, (r.corrupt or "")[:12]) for r in rows) == [("", None, "no list 'reg"), ("AC", None, "lacks best_p"), ("ACGT", 0.0, "")]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "g.json").write_text(json.dumps({"guides": [{"id": "a", "sequence": "ACGU", "length": 4, "wuhan_hu1_pos": None}, {"id": "b"}]}))
    rows = {r.id: r for r in documents.published_guides(spark, str(tmp_path / "g")).collect()}
    assert (rows["a"].paper, rows["a"].wuhan_hu1_pos, rows["a"].corrupt, rows["b"].corrupt) == ("", None, None, "lacks sequence, length")
    (tmp_path / "c.jsonl").write_text('{"id": "1", "sequence": "AC", "more": 2}\n\n  \n{"id": "2"}\nbroken\n')
    rows = documents.corpus_records(spark, str(tmp_path / "c.jsonl")).collect()
    assert [(r.id, r.sequence, r.corrupt) for r in rows] == [("1", "AC", None), ("2", None, "lacks sequence"), (None, None, "broken")]


def test_written_reports(spark, tmp_path):
    import json

    hits = spark.createDataFrame([(0, "ACGT", "chr1", 7, "+", 2, [1, 3]), (1, 'a"b', "c,2", 0, "-", 0, [])], "guide_idx int, guide_seq string, chrom string, pos long, strand string, mismatches int, mm_positions array<int>")
    documents.write_hits(hits, str(tmp_path / "hits"))
    assert sorted(map(tuple, documents.read_hits(spark, str(tmp_path / "hits")).collect())) == sorted(map(tuple, hits.collect()))
    assert any("chr1,7,+,2,1;3" in p.read_text() for p in (tmp_path / "hits").glob("*.csv"))
    report = spark.createDataFrame([("b", None, 1.5), ("a", 2, 0.25)], "name string, n long, x double")
    documents.write_document(report, str(tmp_path / "doc"), "rows", ["name"])
    text = "".join(p.read_text() for p in (tmp_path / "doc").glob("*.txt"))
    assert json.loads(text) == {"total": 2, "rows": [{"name": "a", "n": 2, "x": 0.25}, {"name": "b", "n": None, "x": 1.5}]}
    documents.write_markdown(report, str(tmp_path / "md"), "Report", ["name"])
    assert "".join(p.read_text() for p in (tmp_path / "md").glob("*.txt")) == "# Report\n\n| name | n | x |\n|---|---|---|\n| a | 2 | 0.25 |\n| b |  | 1.5 |\n"


def test_guide_table_keeps_ids(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("guide_id\tsequence\ttarget_gene\ng1\tacgtacgtacgtacgtacgt\tS, spike\ng2\tNNN\tN\nonly\n")
    rows = files.guide_table(spark, str(tmp_path / "g.tsv")).collect()
    assert [(r.guide_id, r.sequence, r.target_gene, r.valid) for r in rows] == [("g1", "ACGTACGTACGTACGTACGT", "S, spike", True), ("g2", "NNN", "N", False)]
    (tmp_path / "h.tsv").write_text("guide_id\tsequence\ng1\tNN\n")
    with pytest.raises(ValueError):
        files.guide_table(spark, str(tmp_path / "h.tsv"))
