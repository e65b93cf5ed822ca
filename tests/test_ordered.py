"""Operators that scan, choose or cut in order, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from helixquery import storage
from helixquery.operators import intervals, offtarget, ordered, scoring, sections, shards, vocabulary


def plain_shards(sizes, target):
    out, shard, filled = [], 0, 0
    for i, n in enumerate(sizes):
        if i and filled + n > target and filled_any:
            shard, filled = shard + 1, 0
        filled, filled_any = filled + n, True
        out.append(shard)
    return out


@pytest.mark.parametrize("seed,target", [(1, 100), (2, 7), (3, 10**6), (4, 1)])
def test_shards_equal_a_plain_fold(spark, tmp_path, seed, target):
    r = random.Random(seed)
    bodies = ["x" * r.choice([0, 1, 5, 40, 99, 100, 101, 700]) for _ in range(60)]
    files = spark.createDataFrame([(f"f{i:03}", b) for i, b in enumerate(bodies)], "path string, content string").repartition(5)
    plan = shards.shard_plan(files.withColumn("size", F.length("content")), "path", "size", target)
    rows = sorted((x["path"], x["no"], x["start"], x["shard"]) for x in plan.collect())
    want, at = [], 0
    for i, (b, s) in enumerate(zip(bodies, plain_shards([len(b) for b in bodies], target), strict=True)):
        want.append((f"f{i:03}", i, at, s))
        at += len(b)
    assert rows == want
    folder = str(tmp_path / "out")
    shards.written_shards(plan, files, "path", "content", folder)
    assert {(x["path"], x["content"]) for x in shards.read_shards(spark, folder).collect()} == {(f"f{i:03}", b) for i, b in enumerate(bodies)}
    with pytest.raises(ValueError):
        shards.read_shards(spark, folder, [10**6])
    broken = spark.read.parquet(f"{folder}/shards").withColumn("content", F.when(F.col("path") == "f003", "changed").otherwise(F.col("content")))
    broken.write.partitionBy("shard").parquet(f"{folder}/b/shards")
    spark.read.parquet(f"{folder}/manifest").write.parquet(f"{folder}/b/manifest")
    with pytest.raises(Exception, match="changed since"):
        shards.read_shards(spark, f"{folder}/b").select(F.max("content")).collect()
    broken.where("path <> 'f004'").write.partitionBy("shard").parquet(f"{folder}/c/shards")
    spark.read.parquet(f"{folder}/manifest").write.parquet(f"{folder}/c/manifest")
    with pytest.raises(ValueError, match="lack files"):
        shards.read_shards(spark, f"{folder}/c")


def test_no_files_are_no_shards(spark):
    assert shards.shard_plan(spark.createDataFrame([], "path string, size long"), "path", "size", 10).count() == 0


def test_running_values_over_parts(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.randrange(30), r.choice([None, 1, 2, 3])) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, x long, v long").repartition(7)
    placed = ordered.placed(df, [F.col("g").asc_nulls_first(), F.col("x").asc(), F.col("v").asc_nulls_first()], parts=9)
    out = ordered.row_numbers(placed, "no")
    out = ordered.running_sum(out, F.coalesce("v", F.lit(0)), "sum")
    out = ordered.previous(ordered.last_seen(out, "g", F.col("v"), "last"), "g", F.col("x"), "before")
    got = sorted(map(tuple, out.select("no", "g", "x", "v", "sum", "last", "before").collect()))
    want, total, last, before = [], 0, {}, {}
    for no, (g, x, v) in enumerate(sorted(rows, key=lambda t: (t[0] is not None, t[0] or "", t[1], t[2] or 0))):
        last[g] = v if v is not None else last.get(g)
        want.append((no, g, x, v, total, last[g], before.get(g)))
        before[g], total = x, total + (v or 0)
    assert got == want


def test_circular_regions_without_records(spark):
    r = random.Random(6)
    targets = spark.createDataFrame([(i, r.randrange(5000)) for i in range(200)], "t long, pos long")
    regions = spark.createDataFrame([(i, r.randrange(5000), r.randrange(5000)) for i in range(40)], "no long, start long, `end` long")
    got = sorted((x["t"], x["no"]) for x in intervals.overlaps(targets, regions, 23).collect())
    inside = lambda p, a, b: (p >= a or p + 23 <= b) if b < a else (p < b and p + 23 > a)
    assert got == sorted((t["t"], g["no"]) for t in targets.collect() for g in regions.collect() if g["start"] != g["end"] and inside(t["pos"], g["start"], g["end"]))


@pytest.mark.parametrize("few,cells", [(10_000, 1024), (3, 4)])
def test_selection_equals_sorting(spark, monkeypatch, few, cells):
    monkeypatch.setattr(scoring, "FEW_VALUES", few)
    monkeypatch.setattr(scoring, "CELLS", cells)
    r = random.Random(7)
    values = {"a": [r.random() ** 9 * 1e6 for _ in range(300)], "b": [5.0] * 50, "c": [-1.5], "d": [r.choice([1.0, 2.0, -1e308, 1e308]) for _ in range(70)], "e": [None]}
    df = spark.createDataFrame([(g, x) for g, v in values.items() for x in v], "g string, x double")
    got = {x["g"]: (x["lo"], x["mid"], x["hi"]) for x in scoring.selected(df, "g", "x", {"lo": F.lit(0), "mid": F.floor(F.col("n") / 2), "hi": F.col("n") - 1}).collect()}
    want = {}
    for g, v in values.items():
        v = sorted(x for x in v if x is not None)
        if v:
            want[g] = (v[0], v[len(v) // 2], v[-1])
    assert got == want


@pytest.mark.parametrize("block", [2000, 7, 1])
def test_novelty_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(offtarget, "BLOCK", block)
    r = random.Random(8)
    seq = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    published = [(i, r.choice([seq(r.randint(12, 30)), seq(20)])) for i in range(40)] + [(99, "ACGU" * 5), (98, "nope")]
    targets = [seq(20) for _ in range(20)] + [p[:14] + seq(6) for _, p in published[:10]] + [p[:20] for _, p in published[10:20]] + ["acgu" * 5, "N" * 20]
    got = {x["target"]: (x["distance"], x["closest"], x["strand"], x["is_novel"]) for x in offtarget.novelty(spark.createDataFrame([(t,) for t in targets], ["target"]), spark.createDataFrame(published, "published_id long, seq string"), 3).collect()}
    want = {}
    for t in {t.upper().replace("U", "T") for t in targets if set(t.upper()) <= set("ACGTU")}:
        best = None
        for i, p in published:
            p = p.replace("U", "T")
            if not set(p) <= set("ACGT"):
                continue
            for strand, q in (("+", p), ("-", p[::-1].translate(str.maketrans("ACGT", "TGCA")))):
                d = sum(a != b for a, b in zip(t, q, strict=False)) + abs(len(t) - len(q))
                best = min(best or (d, i, strand), (d, i, strand))
        want[t] = (*best, best[0] > 3)
    assert got == want


@pytest.mark.parametrize("k,few", [(1, 0), (3, 0), (3, 40), (2, 10**6)])
def test_top_k_equals_a_plain_greedy_choice(spark, monkeypatch, k, few):
    monkeypatch.setattr(vocabulary, "FEW_EDGES", few)
    r = random.Random(k)
    edges = {tuple(sorted(r.sample(range(25), 2))): float(r.choice([1, 1, 1, 2, 5])) for _ in range(250)}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "term_a long, term_b long, weight double")
    ties = {(x[0], x[1]): x[2] for x in df.select("term_a", "term_b", F.xxhash64("term_a", "term_b")).collect()}
    used, want = dict.fromkeys(range(25), 0), set()
    for a, b in sorted(edges, key=lambda e: (-edges[e], ties[e], e)):
        if used[a] < k and used[b] < k:
            used[a], used[b] = used[a] + 1, used[b] + 1
            want.add((a, b))
    assert {(x["term_a"], x["term_b"]) for x in vocabulary.top_k(df, k).collect()} == want


def test_top_k_of_a_chain_takes_a_step_a_prefix(spark, monkeypatch):
    """Each edge waits for the one before it: by rounds alone, every second edge is a step."""
    steps = []
    monkeypatch.setattr(vocabulary, "FEW_EDGES", 20)
    monkeypatch.setattr(vocabulary, "stored", lambda df, name, put=vocabulary.stored: steps.append(name) or put(df, name))
    df = spark.createDataFrame([(i, i + 1, 100.0 - i) for i in range(60)], "term_a long, term_b long, weight double")
    assert {x["term_a"] for x in vocabulary.top_k(df, 1).collect()} == set(range(0, 60, 2))
    assert steps.count("kept-edges") <= 5


def test_term_graph_makes_no_pairs_of_terms_that_are_too_light(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(vocabulary, "number_pairs", lambda units, *a, put=vocabulary.number_pairs: seen.extend(units.collect()) or put(units, *a))
    files = [(f"{i}.txt", f"alpha beta only{'abc'[i]}") for i in range(3)]
    got = vocabulary.term_graph(spark.createDataFrame(files, "path string, content string"), 8.0, 10).collect()
    assert [(x["term_a"], x["term_b"], x["weight"], x["section_count"], x["file_count"]) for x in got] == [("alpha", "beta", 12.0, 3, 3)]
    assert [(len(x["tokens"]), x["section_count"], x["file_count"]) for x in seen] == [(2, 3, 3)]


@pytest.mark.parametrize("block,pairs", [(256, 4_000_000), (2, 3)])
def test_term_graph_equals_plain_counts(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(vocabulary, "BLOCK", block)
    monkeypatch.setattr(vocabulary, "PAIRS", pairs)
    files = [("a.md", "no section\n# One fooBar\nx1 alpha\n## Two\nalpha beta beta"), ("b.txt", "alpha beta\ngamma"), ("c.txt", None), ("d.txt", "")]
    got = {(x["term_a"], x["term_b"]): (x["section_count"], x["file_count"]) for x in vocabulary.term_graph(spark.createDataFrame(files, "path string, content string"), 1.0, 100).collect()}
    units = [(1, 0, {"one", "foo", "bar", "foobar", "x1", "alpha"}), (1, 0, {"two", "alpha", "beta"}), (0, 1, {"no", "section", "one", "foo", "bar", "foobar", "x1", "alpha", "two", "beta"}), (1, 1, {"alpha", "beta", "gamma"})]
    want = {}
    for s, f, terms in units:
        for a in terms:
            for b in terms:
                if a < b:
                    x, y = want.get((a, b), (0, 0))
                    want[a, b] = x + s, y + f
    assert got == want


@pytest.mark.parametrize("buckets,pairs", [(1, 1_000_000), (1, 3), (3, 3), (5, 40), (8, 1)])
def test_number_pairs_equal_plain_counts(spark, monkeypatch, buckets, pairs):
    monkeypatch.setattr(vocabulary, "PAIRS", pairs)
    r = random.Random(buckets)
    units = [(sorted({0, *r.sample(range(30), r.randint(0, 12))}), r.randint(0, 2), r.randint(1, 3)) for _ in range(40)] + [([], 1, 1), ([2**31 - 1, 7][::-1], 5, 5), ([7, 2**31 - 1], 1, 0)]
    want = {}
    for tokens, s, f in units:
        for i, a in enumerate(tokens):
            for b in tokens[i + 1 :]:
                x, y = want.get((a, b), (0, 0))
                want[a, b] = x + s, y + f
    df = spark.createDataFrame(units, "t array<int>, s long, f long")
    for least, below in ((0.0, float("inf")), (9.0, 30.0)):
        got = [tuple(x) for x in vocabulary.number_pairs(df, "t", {"s": 3.0, "f": 1.0}, least, below, buckets).collect()]
        assert sorted(got) == sorted((*e, *n) for e, n in want.items() if least <= 3 * n[0] + n[1] < below)


def _graph_of(spark, files, min_weight, k):
    """The graph by plain counts and a plain choice, and the pairs that all units make."""
    counts = {}
    for text in files:
        for a in (terms := sorted(set(text.split()))):
            for b in terms[terms.index(a) + 1 :]:
                counts[a, b] = counts.get((a, b), 0) + 1
    own = {}
    for text in files:
        for a in set(text.split()):
            own[a] = own.get(a, 0) + 4
    no = {a: i for i, a in enumerate(sorted(a for a in own if own[a] >= min_weight))}
    edges = [(no[a], no[b], a, b, 4.0 * n) for (a, b), n in counts.items() if 4.0 * n >= min_weight]
    df = spark.createDataFrame([e[:2] for e in edges], "a long, b long")
    ties = {(x[0], x[1]): x[2] for x in df.select("a", "b", F.xxhash64("a", "b")).collect()}
    used, want = dict.fromkeys(own, 0), set()
    for i, j, a, b, w in sorted(edges, key=lambda e: (-e[4], ties[e[:2]])):
        if used[a] < k and used[b] < k:
            used[a], used[b] = used[a] + 1, used[b] + 1
            want.add((a, b, w, counts[a, b], counts[a, b]))
    return want


@pytest.mark.parametrize("level,few,bits", [(0, 30, 7), (300, 2_000_000, 1 << 24)])
def test_term_graph_by_levels_equals_a_plain_choice(spark, monkeypatch, level, few, bits):
    for name, value in (("LEVEL", level), ("FEW_EDGES", few), ("BITS", bits)):
        monkeypatch.setattr(vocabulary, name, value)
    r = random.Random(level + few)
    words = [f"t{i:02d}" for i in range(60)]
    files = [" ".join(w for i, w in enumerate(words) if r.random() < 1.5 / (1 + i / 3)) for _ in range(50)]
    got = {tuple(x) for x in vocabulary.term_graph(spark.createDataFrame([(f"{i}.txt", x) for i, x in enumerate(files)], "path string, content string"), 8.0, 3).collect()}
    assert got == _graph_of(spark, files, 8.0, 3) and len(got) > 20


def test_term_graph_makes_no_pairs_of_full_terms(spark, monkeypatch):
    """Terms of every file are full among themselves before rarer ones come in; all pairs of all files were made and shuffled before."""
    made = []

    def counted(units, *a, put=vocabulary.number_pairs):
        made.extend(len(x["tokens"]) * (len(x["tokens"]) - 1) // 2 for x in units.collect())
        return put(units, *a)

    monkeypatch.setattr(vocabulary, "number_pairs", counted)
    monkeypatch.setattr(vocabulary, "LEVEL", 0, raising=False)
    files = [" ".join([f"of{i:02d}" for i in range(20)] + [f"rare{n // 2}"]) for n in range(64)]
    got = {tuple(x) for x in vocabulary.term_graph(spark.createDataFrame([(f"{i}.txt", x) for i, x in enumerate(files)], "path string, content string"), 8.0, 2).collect()}
    assert {x[2] for x in got} == {256.0}
    assert got == _graph_of(spark, files, 8.0, 2)
    assert sum(made) < 32 * 21 * 20 // 2  # each text is there twice


def test_term_graph_leaves_no_tables_of_pairs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "shared_folder", lambda session: str(tmp_path))
    files = [(f"{i}.txt", f"alpha beta gamma w{i // 2}") for i in range(8)]
    assert vocabulary.term_graph(spark.createDataFrame(files, "path string, content string"), 8.0, 10).count() == 15
    assert {x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir()} <= {"kept", "ordered", "term-numbers", "used-terms"}


@pytest.mark.parametrize("line,language,name", [
    ("  pub mod x;", "rs", "pub mod x;"), ("impl<T> Foo for T {", "rs", "impl<T> Foo for T"), ("pub(crate) fn f() {", "rs", "pub(crate) fn f()"), ("  fn f() {", "rs", None), ("// --- part", "rs", "// --- part"),
    ("async def f(x):", "py", "async def f(x)"), ("  def f():", "py", None), ("# === a", "py", "# === a"), ("-module(x).", "erl", "-module(x)."), ("handle_call(X) ->", "erl", "handle_call()"), ("two words(", "erl", None), ("Var(", "erl", None),
    ("  # Head", "md", "# Head"), (" <h2 class=x> Text <b>y</b></h2>", "html", "Text"), ("<h1></h1>", "html", "<h1></h1>"), ("<p>", "html", None), ("A TITLE - É", "", "A TITLE - É"), ("AB", "", None), ("A1B", "", None), ("---", "", None),
])
def test_boundaries(line, language, name):
    assert sections.boundary(line, language) == name


def test_windows_of_files_without_boundaries():
    lines = [str(i) for i in range(60)]
    parts = list(sections.cut("x", "\n".join(lines)))
    assert [p[0] for p in parts] == ["lines 1-50", "lines 26-60", "lines 51-60"]
    whole = "\n".join(lines)
    assert all(whole[a:b].rstrip("\n") == body for _, a, b, body in parts)
