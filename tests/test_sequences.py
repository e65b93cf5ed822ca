"""Literal cases of the sequence functions and joins."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixquery.functions import codes as C
from helixquery.functions import sequences as S
from helixquery.operators import intervals, kmers, literature, membership, offtarget, scoring, search, shards, vocabulary


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def test_normalised(spark):
    assert one(spark, S.normalised(F.col("t")), t=">id\nacgu\n;c\n\nRYSWKMBDHV x-1\n") == "ACGTNNNNNNNNNN"


def test_pack_and_distance(spark):
    assert one(spark, S.unpacked(S.packed(F.col("s")), 5), s="ACGTA") == "ACGTA"
    assert one(spark, S.packed(F.col("s")), s="ACNT") is None
    assert one(spark, S.hamming(S.packed(F.col("a")), S.packed(F.col("b"))), a="AAAA", b="ATAG") == 2
    assert one(spark, S.mismatch_positions(F.col("a"), F.col("b"), 4), a="AAAA", b="ATAG") == [1, 3]


@pytest.mark.parametrize("kmer,pam", [("A" * 21 + "GG", "NGG"), ("TTT" + "A" * 18 + "GG", "NGG"), ("TTTA" + "A" * 19, "TTTN"), ("A" * 23, "none")])
def test_pam(spark, kmer, pam):
    assert one(spark, S.pam(F.col("k")), k=kmer) == pam


def test_windows(spark):
    df = spark.createDataFrame([(1, "A" * 28), (2, "ACGTNACGT"), (3, ""), (4, None)], "id long, seq string")
    assert kmers.windows(df, "id", "seq", 23).count() == 6
    assert {(r["id"], r["pos"], r["kmer"]) for r in kmers.windows(df, "id", "seq", 4).where("id = 2").collect()} == {(2, 0, "ACGT"), (2, 5, "ACGT")}


def test_windows_of_a_long_record(spark):
    n = 3 * kmers.CUT + 17
    seq = ("ACGTTGCA" * (n // 8 + 1))[:n]
    got = kmers.windows(spark.createDataFrame([(1, seq)], "id long, seq string"), "id", "seq", 23)
    rows = {(r["pos"], r["kmer"]) for r in got.collect()}
    assert rows == {(i, seq[i : i + 23]) for i in range(n - 22)} and got.count() == n - 22


GUIDE = "AAAACCCCGGGGTTTTAAAA"


def test_off_targets(spark):
    records = spark.createDataFrame([("c", "NNNNN" + GUIDE + "NNNNN"), ("d", "T" + GUIDE[1:]), ("e", "TTTTAAAACCCCGGGGTTTT")], "id string, seq string")
    guides = offtarget.valid_guides(spark.createDataFrame([(GUIDE.lower() + "ggg",), ("bad",)], ["g"]), "g")
    got = {(r["id"], r["pos"], r["strand"], r["mismatches"], tuple(r["mm_positions"])) for r in offtarget.off_targets(records, "id", "seq", guides, 3).collect()}
    assert {("c", 5, "+", 0, ()), ("d", 0, "+", 1, (0,)), ("e", 0, "-", 0, ())} <= got
    assert all(m <= 3 for *_, m, _ in got)
    with pytest.raises(ValueError):
        offtarget.valid_guides(spark.createDataFrame([("guide_1\tACGT",)], ["g"]), "g")
    with pytest.raises(ValueError):
        offtarget.off_targets(records, "id", "seq", guides, 4)


@pytest.mark.parametrize("few,pairs", [(100, 1 << 21), (100, 3), (0, 1)])
def test_off_targets_equal_all_distances(spark, monkeypatch, few, pairs):
    monkeypatch.setattr(offtarget, "FEW_GUIDES", few)
    monkeypatch.setattr(offtarget, "PAIRS", pairs)
    r = random.Random(4)
    guides = ["".join(r.choice("ACGT") for _ in range(20)) for _ in range(6)] + ["AC" * 10]

    def changed(g):
        g = list(g)
        for _ in range(r.randrange(6)):
            g[r.randrange(20)] = r.choice("ACGT")
        return "".join(g)

    texts = ["".join(r.choice([changed(r.choice(guides)), "N", "A" * r.randrange(9)]) for _ in range(12)) for _ in range(9)] + ["", None]
    records = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, seq string").repartition(3)
    table = spark.createDataFrame([(g,) for g in guides], ["guide"])
    got = {(x["guide"], x["strand"], x["id"], x["pos"], x["mismatches"], tuple(x["mm_positions"])) for x in offtarget.off_targets(records, "id", "seq", table, 3).collect()}
    rc = lambda g: g[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = set()
    for i, t in enumerate(texts):
        for p in range(len(t or "") - 19):
            w = t[p : p + 20]
            for g in guides:
                for strand, probe in (("+", g), ("-", rc(g))):
                    places = tuple(j for j in range(20) if w[j] != probe[j])
                    if len(places) <= 3 and set(w) <= set("ACGT"):
                        want.add((g, strand, i, p, len(places), places))
    assert got == want and len(want) > 20


@pytest.mark.parametrize("k", [1, 4, 23, 31, 32])
@pytest.mark.parametrize("held,most", [(1_000_000, 4_000_000), (5, 20)])
def test_kmer_counts_equal_brute_force(spark, monkeypatch, k, held, most):
    monkeypatch.setattr(kmers, "HELD_CODES", held)
    monkeypatch.setattr(kmers, "MOST_CODES", most)
    monkeypatch.setattr(kmers, "CUT", 16)
    r = random.Random(k)
    texts = ["".join(r.choice("ACGT" * 9 + "N0123") for _ in range(r.randrange(150))) for _ in range(30)] + ["T" * 300, "T" * 300, "", None, "acgt" * 20]
    texts += texts[:5]
    records = spark.createDataFrame([(f"r{i:02}", t) for i, t in enumerate(texts)], "id string, seq string").repartition(3)
    want = {}
    for i, t in enumerate(texts):
        for p in range(len(t or "") - k + 1):
            if set(t[p : p + k]) <= set("ACGT"):
                n, first = want.get(t[p : p + k], (0, (f"r{i:02}", p)))
                want[t[p : p + k]] = n + 1, min(first, (f"r{i:02}", p))
    got = {x["kmer"]: (x["occurrences"], (x["first_record"], x["first_pos"])) for x in kmers.counts(records, "id", "seq", k).collect()}
    assert got == want
    assert kmers.distinct_kmers(records, "id", "seq", k).first()[0] == len(want)
    top = [x["kmer"] for x in kmers.top_targets(records, "id", "seq", k, 7).orderBy(F.desc("occurrences"), "kmer").collect()]
    assert top == sorted(want, key=lambda x: (-want[x][0], x))[:7]
    asked = spark.createDataFrame([(x,) for x in [*sorted(want)[:5], "ACG", "A" * 40, "N" * k, None]], "kmer string")
    for x in kmers.recount(records, "id", "seq", asked, k).collect():
        n, first = want.get(x["kmer"], (0, (None, None)))
        assert (x["occurrences"], x["first_record"], x["first_pos"]) == (n, *first)


@pytest.mark.parametrize("kind", ["NGG", "TTTV"])
def test_top_by_group_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(kmers, "PART_WINDOWS", 400)
    r = random.Random(kind)
    rows = [(g, "".join(r.choice("TTTGGAC") for _ in range(300))) for g in ("x", "y", None)] * 2 + [("z", ""), ("x", None)]
    want = {}
    for g, t in rows:
        for p in range(len(t or "") - 6):
            w = t[p : p + 7]
            if w.endswith("GG") if kind == "NGG" else w.startswith("TTT") and w[3] != "T" and not w.endswith("GG"):
                want.setdefault(g, {})[w] = want.get(g, {}).get(w, 0) + 1
    got = kmers.top_by_group(spark.createDataFrame(rows, "g string, seq string"), "g", "seq", 7, 5, C.of_pam(kind, 7)).collect()
    assert {tuple(x) for x in got} == {(g, *x) for g, n in want.items() for x in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:5]}


def test_prose_in_arrays_equals_the_column_function(spark):
    df = spark.createDataFrame([("Aé İ K z\0Z ſß",), (None,), ("",), ("Σ ABC xyz 123",)], "text string")
    both = df.select(S.from_prose(F.col("text")).alias("a"), F.arrow_udf(C.of_prose, "string")("text").alias("b"))
    assert both.where("not a <=> b").count() == 0


def test_counting_ships_few_bytes_a_window(spark):
    r = random.Random(5)
    records = spark.createDataFrame([("".join(r.choice("ACGT") for _ in range(10_000)),) for _ in range(20)], "seq string")
    sent = kmers._words(records, "seq", 23, 4, None, None).selectExpr("sum(octet_length(words) + octet_length(sizes))").first()[0]
    assert sent < 2 * 200_000  # runs as text with their places took over 7


def test_windows_and_recount_take_bases_only(spark):
    df = spark.createDataFrame([(1, "ACGT12ACGT"), (2, "AAAAACG")], "id long, seq string")
    assert {(x["id"], x["kmer"]) for x in kmers.windows(df, "id", "seq", 4).collect()} == {(1, "ACGT"), (2, "AAAA"), (2, "AAAC"), (2, "AACG")}
    asked = spark.createDataFrame([("ACG",), ("AAACG",)], "kmer string")
    assert {x["kmer"]: x["occurrences"] for x in kmers.recount(df, "id", "seq", asked, 5).collect()} == {"ACG": 0, "AAACG": 1}
    with pytest.raises(ValueError):
        kmers.packed_counts(df, "id", "seq", 33)


def test_novelty_without_published(spark):
    got = offtarget.novelty(spark.createDataFrame([(GUIDE,)], ["target"]), spark.createDataFrame([], "published_id long, seq string"), 3).first()
    assert got["closest"] is None and got["is_novel"]


def test_conservation(spark):
    rc = GUIDE[::-1].translate(str.maketrans("ACGT", "TGCA"))
    records = spark.createDataFrame([(1, "GG" + GUIDE + rc), (2, rc), (3, "ACGT"), (4, "")], "id long, seq string")
    r = membership.conservation(records, "id", "seq", spark.createDataFrame([(7, GUIDE)], "guide_id long, sequence string")).first()
    assert (r["hits"], r["total"], r["conservation_pct"]) == (2, 3, 66.67)


def test_search(spark):
    docs = spark.createDataFrame([(1, "AAAA"), (2, "é\nñAA(.*)"), (3, None)], "id long, t string")
    asked = spark.createDataFrame([("AA",), ("(.*)",), ("",), (None,), ("AA",)], "pattern string")
    hits = {(r["id"], r["pattern"], r["offset"]) for r in search.hits(docs, "id", "t", asked).collect()}
    assert hits == {(1, "AA", 0), (1, "AA", 1), (1, "AA", 2), (2, "AA", 5), (2, "(.*)", 7)}
    assert one(spark, search.overlapping(F.col("t"), F.col("p")), t="AAAA", p="AA") == 3
    assert one(spark, search.overlapping(F.col("t"), F.col("p")), t="a.b.c(.*)", p="(.*)") == 1
    line, col = search.line_and_column(F.col("t"), F.lit(5))
    assert one(spark, F.array(line, col), t="é\nñAA") == [2, 3]
    assert one(spark, search.clean_query(F.col("q")), q="ac-gx t") == "ACGT" and one(spark, search.clean_query(F.col("q")), q="acg") is None


@pytest.mark.parametrize("few", [0, 1 << 25])
def test_search_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW_BYTES", few)
    monkeypatch.setattr(search, "PLACES", 3)
    r = random.Random(few)
    texts = ["".join(r.choice("abé") for _ in range(r.randrange(120))) for _ in range(40)] + ["", "a" * 400]
    patterns = {t[i : i + r.choice((1, 2, 5, 9, 17, 40))] for t in texts for i in r.sample(range(120), 3)} | {"a" * 30, "bé" * 20}
    docs = spark.createDataFrame(list(enumerate(texts)), "place long, pattern string")
    found = search.hits(docs, "place", "pattern", spark.createDataFrame([(p,) for p in patterns], "bytes string"), "bytes").collect()
    wanted = sorted((i, p, len(t[:k].encode())) for i, t in enumerate(texts) for p in patterns if p for k in range(len(t)) if t.startswith(p, k))
    assert sorted((x["place"], x["pattern"], x["offset"]) for x in found) == wanted
    assert search.hits(docs, "place", "pattern", spark.createDataFrame([], "pattern string")).count() == 0


def test_occurrences_apart(spark):
    assert [one(spark, search.apart(F.col("t"), F.col("p")), t=t, p=p) for t, p in (("AAAA", "AA"), ("AAAAA", "AA"), ("abcabcab", "abcab"), ("ééé", "é"), ("x", "y"))] == [2, 2, 1, 3, 0]


def test_given_key(spark, monkeypatch):
    monkeypatch.setenv("HELIXQUERY_KEY", "0f" * 32)
    assert shards.given_key(spark) == b"\x0f" * 32
    monkeypatch.setenv("HELIXQUERY_KEY", "0f")
    with pytest.raises(ValueError):
        shards.given_key(spark)
    monkeypatch.delenv("HELIXQUERY_KEY")
    assert len(shards.given_key(spark)) == 32 and shards.given_key(spark) != shards.given_key(spark)


def test_pair_counts(spark):
    units = spark.createDataFrame([(["a", "b", "c"],), (["b", "c"],), (["z"],), ([],), (None,)], "tokens array<string>")
    assert {tuple(r) for r in vocabulary.pair_counts(units, "tokens").collect()} == {("a", "b", 1), ("a", "c", 1), ("b", "c", 2)}


def test_intervals(spark):
    t = spark.createDataFrame([(0,), (90,), (100,), (500,), (990,)], "pos long")
    r = spark.createDataFrame([(1, 100, 101), (2, 950, 30)], "no long, start long, `end` long")
    got = {(x["pos"], x["no"]) for x in intervals.overlaps(t, r, 23).collect()}
    want = {(p, 1) for p in (90, 100)} | {(p, 2) for p in (0, 990)}
    assert got == want
    assert intervals.overlaps(t, r, 23).count() == len(want)


def test_vocabulary_and_pairs(spark):
    docs = spark.createDataFrame([("parseJSONFile snake_case _x a1",)], ["t"])
    assert {r[0] for r in vocabulary.terms(docs, "t").collect()} == {"parse", "file", "snake", "case", "a1"}
    assert one(spark, vocabulary.section_tokens(F.col("t")), t="fooBar é ab") == ["ab", "bar", "foo", "foobar", "é"]
    assert one(spark, vocabulary.section_tokens(F.col("t")), t="my_fooBar") == ["bar", "foo", "my", "my_foobar"]


def test_numbers(spark):
    for s, v in (("1.3-4M", 2650000.0), ("21,000-143,000", 82000.0), ("~40,000", 0.0), ("5k", 5000.0), ("", 0.0)):
        assert one(spark, scoring.number_range(F.col("s")), s=s) == v
    assert one(spark, scoring.highest_percentage(F.col("s")), s="2%, up to 50 %") == 0.5


def test_blind_and_encrypted(spark):
    docs = spark.createDataFrame([(1, "ananas"), (2, None)], "id long, t string")
    got = {r["pattern_no"]: r["n"] for r in shards.blind_counts(docs, "id", "t", ["ana", "x"], b"k").collect()}
    assert got == {0: 2}
    assert sorted(shards.byte_permutation(b"k")) == list(range(256))
    key = shards.derived_key("p", b"salt" * 4)
    assert one(spark, shards.decrypted(shards.encrypted(F.col("t").cast("binary"), key), key), t="secret") == b"secret"


def _plain_best(records, wanted, k, most):
    scores = {p: sorted((-x.count(p), i) for i, x in records if p in (x or "")) for p in wanted if len(p) == k and set(p) <= set("ACGT")}  # str.count: apart, from the left
    return {(p, i, -n, rank) for p, found in scores.items() for rank, (n, i) in enumerate(found[:most], 1)}


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_best_records_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(kmers, "FEW_WANTED", few)
    monkeypatch.setattr(kmers, "HELD_CODES", 20)
    monkeypatch.setattr(C, "STEP", 50)
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("ACGTN", [3, 3, 1, 1, 0.2], k=rnd.randrange(90))) for _ in range(60)] + ["A" * 70, "ACACACACACACA", "", "CGT" * 20, "CGT" * 20]
    records = list(enumerate(texts)) + [(99, None)]
    wanted = ["AAAA", "ACAC", "CGTC", "GTCG", "TTTT", "AANA", "AAA", "AAAA"] + ["".join(rnd.choices("ACGT", k=4)) for _ in range(40)]
    df = spark.createDataFrame(records, "id long, seq string").repartition(3)
    got = kmers.best_records(df, "id", "seq", spark.createDataFrame([(p,) for p in wanted], "p string"), "p", 4, 3).collect()
    assert {tuple(r) for r in got} == _plain_best(records, set(wanted), 4, 3) and len(got) == len({tuple(r) for r in got})


def test_a_pattern_in_all_records_is_a_few_rows(spark):
    """Ranking generated queries joined a row for every pair of a query and a record that holds it with the record's text."""
    records = spark.createDataFrame([(i, "ACGTTGCA" * 6) for i in range(2000)], "id long, seq string").coalesce(2)
    asked = spark.createDataFrame([("ACGTTGCA", 0), ("TTGCAACG", 0)], "p string, x int").select("p", S.packed(F.col("p")).alias("code"))
    each = kmers._best_in_tasks(records, "id", "seq", 8, asked, 5)
    assert each.count() <= 2 * 2 * 5
    assert {(r["rank"], r["id"], r["score"]) for r in kmers.best_records(records, "id", "seq", asked, "p", 8, 5).where("p = 'TTGCAACG'").collect()} == {(i + 1, i, 5) for i in range(5)}


def test_grams_grow_with_the_patterns(spark):
    """Places of four letters met more grams the more patterns there were."""
    for n, least in ((10, 8), (5_000, 24), (300_000, 24), (10**8, 100), (3, 5)):
        gram = search._gram(n, least)
        assert gram == least or 8 <= gram < least and 4 * n * (least - gram + 1) <= 4**gram
    assert search._gram(200, 30) <= 9 and search._gram(10, 4) == 4


def test_places_within_values(monkeypatch):
    monkeypatch.setattr(C, "STEP", 16)
    rnd = random.Random(4)
    texts = [bytes(rnd.choices(b"ab", k=rnd.randrange(60))) for _ in range(50)] + [b"", b"a" * 100]
    raw, offsets = C.flat(pa.array(texts, pa.binary()))
    for p in (b"a", b"ab", b"aba", b"aaaaaaaaaaaaaaaaaaaa", b"b" * 200, b""):
        want = sum(x.startswith(p, i) for x in texts for i in range(len(x) - len(p) + 1)) if p else 0
        assert shards._places(raw, offsets, p) == want


def test_blind_search_takes_long_texts_in_small_batches(spark, monkeypatch):
    """10,000 whole texts and two copies of them were in a Python worker at once."""
    plain = shards._places

    def places(raw, offsets, pattern):
        if len(raw) > 12 << 20:
            raise ValueError(f"a batch of {len(raw)} bytes")
        return plain(raw, offsets, pattern)

    monkeypatch.setattr(shards, "_places", places)
    docs = spark.range(300).coalesce(1).select("id", F.when(F.col("id") % 3 > 0, F.repeat(F.lit("ñandú ana "), 10_000)).alias("t"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = {r["pattern_no"]: r["n"] for r in shards.blind_counts(docs, "id", "t", ["ana", "ú", "a a", "q"], b"k").collect()}
    assert got == {0: 2_000_000, 1: 2_000_000}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_scans_merge_in_as_many_tasks_as_their_rows_ask_for(spark, monkeypatch):
    """Keys met in spark.sql.shuffle.partitions tasks, whose sorts grew with the input."""
    monkeypatch.setattr(literature, "PART_ROWS", 20)
    old = spark.range(400).select(F.when(F.col("id") != 7, F.col("id") % 200).alias("k"), F.lit("old").alias("c"))
    new = spark.createDataFrame([(2, "new"), (2, "new too"), (None, "new"), (500, "new")], "k long, c string")
    got = literature.merged_scans(old, new, ["k"])
    want = [(i % 200 if i != 7 else None, "old") for i in range(400) if i % 200 != 2] + [(2, "new"), (2, "new too"), (None, "new"), (500, "new")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert got._jdf.queryExecution().executedPlan().toString().count(", 20)") >= 2  # exchanges: 400 rows, 20 a task
    items = spark.createDataFrame([(5, "x"), (5, "y"), (None, "z")] + [(i, "w") for i in range(200, 300)], "k long, item string")
    assert sorted(map(tuple, literature.with_items(old.where("k = 5"), items, ["k"]).collect())) == [(5, "old", "x"), (5, "old", "x"), (5, "old", "y"), (5, "old", "y")]
