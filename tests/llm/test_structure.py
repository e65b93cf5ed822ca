"""HTML extraction, Merkle manifests and periodic runs against brute force and planted pages."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixquery.llm import html_text, merkle, periodic_runs, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {k: 1 for k in ("uid", "period", "start", "end", "low", "runs", "words", "tree", "at", "n", "node", "run", "path", "row_no", "key", "l", "r", "leaf", "root")}


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 2 + 1):
        x = 0
        while x < len(w) - q:
            a = x
            while x < len(w) - q and w[x] == w[x + q]:
                x += 1
            s = w[a : x + q]
            if x - a >= q and len(s) >= max(periodic_runs.LEAST, 2 * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                out.append((a, q, len(s)))
            x += x == a
    return sorted(out)


def brute_periods(doc_id, body):
    w = re.findall(r"[^\x20\x09-\x0D]+", body or "")
    order = queries.planted(doc_id, len(w))
    w = w if order is None else [w[i] for i in order]
    runs = brute_runs(w)
    gone = {i for a, q, n in runs for i in range(a + q, a + n)}
    best = min(((-n, a, q) for a, q, n in runs), default=None)
    best = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{a},{n},{q}\n" for a, q, n in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_texts(seed=3):
    r = random.Random(seed)
    out = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "a b " * 6, "a b " * 700, "x" * 40_000, "é ñ " * 9 + "tail"]
    for _ in range(90):
        n, k = r.randint(0, 300), r.choice([1, 2, 3, 60])
        w = [f"w{r.randrange(k)}" for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            if n > 4:
                a = r.randrange(n)
                p = r.randint(1, max(1, (n - a) // 2))
                for i in range(a, min(n, a + int(p * r.uniform(1.5, 5)))):
                    w[i] = w[a + (i - a) % p]
        out.append(r.choice([" ", "\n", "  "]).join(w))
    return [*out, out[-1], out[-1]]


@pytest.mark.parametrize("tile", [1 << 14, 16])
def test_periodic_runs_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(periodic_runs, "TILE", tile)
    texts = periodic_texts()
    rows = [(i if i % 7 else None, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(3)
    got = periodic_runs.digests(periodic_runs.periodic_runs(df, order=queries.planted)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute_periods(i, t)) for i, t, *_ in rows)


def test_tiles_alone_give_the_runs_of_whole_documents(monkeypatch):
    r = random.Random(9)
    for tile in (8, 20, 1 << 14):
        monkeypatch.setattr(periodic_runs, "TILE", tile)
        for _ in range(60):
            w = [r.randrange(3) for _ in range(r.randint(12, 120))]
            p = r.randint(1, 40)
            w = w + [w[i % p % len(w)] for i in range(r.randint(0, 200))]
            codes, found = np.array(w, dtype=np.int64), {}
            for low, high, reach, first, part, bounds in periodic_runs.tiles(codes):
                for q, a, b in periodic_runs.solved(part.tolist(), bounds.tolist(), low, high, reach):
                    found.setdefault(q, []).append((a + first, b + first))
            runs = []
            for q, spans in found.items():
                end = start = None
                for a, b in sorted(spans):
                    if end is None or a > end:
                        runs += [] if end is None else [(start, q, end - start + q)]
                        start, end = a, b
                    end = max(end, b)
                runs.append((start, q, end - start + q))
            assert sorted(x for x in runs if x[2] >= max(12, 2 * x[1])) == brute_runs(w)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert periodic_runs.digests(periodic_runs.periodic_runs(docs)).count() == 0
    leaves = docs.select("doc_id", "lang", F.lit("x").alias("leaf"))
    assert merkle.manifest(leaves, "lang", "doc_id").count() == 0


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def enc(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def brute_tree(nodes):
    """Root, and the siblings (left, right) of each leaf by level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            a = at // 8 * 8
            paths[i].append((nodes[a:at], nodes[at + 1 : a + 8]))
        nodes, where = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [at // 8 for at in where]
    return nodes[0], paths


def brute_manifest(rows):
    groups = {}
    for d, t, lang, source, n in rows:
        groups.setdefault(lang, []).append((d, enc(d, source, lang, n, t), t, source, n))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    order = {g: sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in langs}
    trees = {g: brute_tree([x[1] for x in order[g]]) for g in langs}
    root, tops = brute_tree([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops, strict=True):
        for (d, leaf, t, source, n), path in zip(order[g], trees[g][1], strict=True):
            whole = path + top
            x = leaf
            if d is not None and zlib.crc32(str(d).encode()) % 3 == 0:
                low = None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
                x = enc(d, source, g, n, low)
            for left, right in whole:
                x = sha("".join([*left, x, *right]))
            out.append((d, leaf, trees[g][0], root, sha("".join("".join(a + b) for a, b in whole)), x, x == root))
    return sorted(map(repr, out))


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"en": 140, "de": 65, None: 7, "": 1, "é": 2, "fr": 16, "es": 1, "z": 3, "y": 9, "x": 1}])
def test_manifest_equals_brute_force(spark, tmp_path, sizes):
    r = random.Random(1)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((r.choice([None, *range(200)]), r.choice([None, "", "Text É", "a:1", "ABC" * r.randrange(9)]), lang, r.choice([None, "s", "S:2"]), r.choice([None, 5])))
    rows += rows[:3]
    spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(x)) for x in got) == brute_manifest(rows)


def test_many_trees_take_the_distributed_numbers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "FEW_TREES", 2)
    rows = [(i, f"T{i}", f"l{i % 11}", "s", i) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(x)) for x in got) == brute_manifest(rows)


WORDS = "several long words of an article that goes on "
PAGES = {
    "article": (f"<html><body><nav><a>Home</a></nav><div class='ad'>Buy this now</div><article><h1>The title</h1><p>{WORDS * 5}<br>more<p>Short.</p></article><footer>&copy; x</footer>", ["The title", WORDS * 5 + "more", "Short."]),
    "no article element": (f"<body><div id=top><a>Home</a> | <a>About</a></div><div id=page><div class=sidebar><ul><li><a>1</a><li><a>2</a><li><a>3</a></ul></div><div id=text><h1>Title</h1><p>{WORDS * 4}</p><p>Yes.</p><p>{WORDS * 3}</p></div><div class='comments'><p>{WORDS * 30}</p></div></div></body>", ["Title", WORDS * 4, "Yes.", WORDS * 3]),
    "notices and forms": (f"<main><div class='cookie-notice'><p>{WORDS * 3}</p></div><h1>T</h1><form><label>Name</label><input></form><p>{WORDS * 3}</p><section id='comments'><article class='comment'><p>{WORDS * 9}</p></article></section></main>", ["T", WORDS * 3]),
    "an advert longer than the article": (f"<div class='ad'>{WORDS * 4}</div><article><p>Tiny.</p></article>", ["Tiny."]),
    "scripts and comments": (f"<p>{WORDS}&amp; <script>if (a < b) x('</p>')</script><!-- <p>no</p> --><b>bold</b><i>er</i></p><style>p{{}}</style><noscript>no</noscript>", [WORDS + "& bolder"]),
    "cut off": (f"<article><p>{WORDS}&am</p><p>end <!-- never closed <p>no</p>", [WORDS + "&am", "end"]),
    "cut tag": ("<p>text &lt;b&gt; a < b</p><a hre", ["text <b> a < b"]),
    "plain": ("just \n text", ["just text"]),
    "odd declarations": ("<?xml version='1.0'?><!DOCTYPE html><![CDATA[x]]><p>ok</p><![foo[", ["ok"]),
    "hidden": (f"<div><p style='display:none'>no</p><p hidden>no</p><p>{WORDS}</p></div>", [WORDS]),
    "link list outside": (f"<body><ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul><h1>H</h1><p>{WORDS * 2}</p><p>{WORDS * 3}</p></body>", ["H", WORDS * 2, WORDS * 3]),
    "nested": ("<div>" * 3000 + f"<p>{WORDS}</p>", [WORDS]),
    "nothing": ("<div><img><script>x</script></div>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == "\n".join(" ".join(x.split()) for x in want)


def brute_article(page):
    """The article of pages like those of the test tables, by patterns."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    blocks = (html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def test_pages_of_the_tables(spark):
    df = queries.op11_html_extraction(spark, "/root/testdata/sf0.01").collect()
    pages = {r.page_id: r.html for r in queries.table(spark, "/root/testdata/sf0.01", "pages").collect()}
    assert len(df) == len(pages)
    for r in df:
        assert r.text == brute_article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_pages_null_repeated_and_clashing(spark, tmp_path):
    rows = [(1, "u", None), (1, "u", ""), (2, None, "<p>x</p>"), (2, None, "<p>x</p>"), (None, "v", "<p>" + "long " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("other"))
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.page_id or 0, r.n_chars) for r in queries.op11_html_extraction(spark, str(tmp_path)).collect())
    assert got == [(0, 999_999), (1, 0), (1, 0), (2, 1), (2, 1)]
