"""The training-data operators against brute force, exact round trips and the library they must equal."""

import base64
import bz2
import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from helixquery.llm import components, decontamination, jaccard, kneser_ney, line_dedup, packing, quality, queries, secrets, sharding, tokens, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
UPPER, LOWER = line_dedup.UPPER, line_dedup.LOWER
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


#: Nulls, empty and blank texts, repeated texts, one very long text and one very long word.
ODD = [None, "", " \n\t", "word", "word", "a b", "A  b\n", "x" * 30_000, "the same line\n" * 3000, "é ñ ß İ \u2003x\x1f y", "<s> </s> <|endoftext|> <unk>"]
#: Names that the operators use inside.
CLASH = {k: 1 for k in ("n_docs", "line_hash", "key", "host", "kept", "s", "doc", "shard", "h", "at", "sig", "cid", "uid", "tokens", "rank", "first", "cell", "share")}


def brute_components(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(str.maketrans(UPPER, LOWER)))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def families(seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]

    def changed(w, m):
        w = list(w)
        for _ in range(m):
            w[r.randrange(len(w))] = r.choice(words)
        return w

    base = [r.choice(words) for _ in range(170)]
    out = [changed(base, r.randint(0, 5)) for _ in range(60)]
    other = changed(base, 8)
    out += [changed(other, r.randint(0, 5)) for _ in range(45)]
    for n in (3, 5, 9, 12, 20, 60, 200):
        b = [r.choice(words) for _ in range(n)]
        out += [changed(b, r.randint(0, max(1, n // 25))) for _ in range(6)]
    passage = [r.choice(words) for _ in range(60)]
    out += [passage + [r.choice(words) for _ in range(r.choice([5, 20, 100]))] for _ in range(60)]
    out += [[r.choice(words[:4]) for _ in range(r.randint(1, 6))] for _ in range(25)]
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, k, percent):
    texts = families() + ODD[:8]
    df = table(spark, texts, **CLASH)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, k, percent).collect()}
    assert got == brute_components(list(enumerate(texts)), k, percent)


def test_jaccard_join_path_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW_TOKENS", 0)
    monkeypatch.setattr(jaccard, "FEW_IDS", 0)
    texts = families(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, texts)).collect()}
    assert got == brute_components(list(enumerate(texts)), 3, 90)


LONG = " ".join(f"w{i}" for i in range(40))


@pytest.mark.parametrize("texts", [[], ["", " \n", None], [LONG], [LONG] * 3, [LONG, LONG.replace("w", "x"), LONG.replace("w", "y")]])
def test_jaccard_without_pairs(spark, texts):
    df = table(spark, texts, **CLASH)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute_components(list(enumerate(texts)), 3, 90)
    assert jaccard.one_of_each(df).count() == len({t for t in texts if t and t.strip()}) + sum(not (t and t.strip()) for t in texts)


@pytest.mark.parametrize("sets,held", [(7, 4_000_000), (1024, 900)])
def test_jaccard_parts_of_a_signature(spark, monkeypatch, sets, held):
    monkeypatch.setattr(jaccard, "PART", 5)
    monkeypatch.setattr(jaccard, "SETS", sets)
    monkeypatch.setattr(jaccard, "HELD", held)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    texts = families(11)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, texts)).collect()}
    assert got == brute_components(list(enumerate(texts)), 3, 90)
    with pytest.raises(ValueError):
        jaccard.Join(table(spark, texts), 3, 50)


def test_one_of_each_with_null_and_repeated_ids(spark):
    near, other = LONG + " w", LONG.replace("w", "z")
    rows = [(None, LONG), (None, LONG), (None, near), (7, other), (7, "alone " + LONG.replace("w", "q")), (7, other), (8, other), (9, None), (9, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()), key=repr)
    of_first = [x for x in got if x[0] is None and x[1]]
    assert len(of_first) == 1 and of_first[0][1] in (LONG, near)
    assert [x for x in got if x not in of_first] == sorted([(7, other), rows[4], (9, None), (9, None), (None, "")], key=repr)


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = table(spark, [text, text + " x", "other words here are enough", None, ""], **CLASH)
    twice = df.union(df.where("doc_id = 0"))
    out = jaccard.one_of_each(twice)
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 3, 4] and out.columns == df.columns


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {95: 90, 100: 90}


def test_quality_measures(spark):
    texts = ODD + ["a b c a b c d", "l1 w\nl1 w\n\nl2", "#a *b &"]

    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        marked = {i + j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)

    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality_rules(table(spark, texts, **{k: v for k, v in CLASH.items()})).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_quality_verdicts(spark):
    clean = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(30)]
    junk = ["".join(f"{w}*** " for w in c.split()) for c in clean[:6]]
    df = table(spark, clean + junk + ["short"], **CLASH)
    out = quality.accepted(df)
    assert sorted(r.doc_id for r in out.collect()) == list(range(30)) and out.columns == df.columns
    assert quality.accepted(df.limit(0)).count() == 0


@pytest.mark.parametrize("hottest,slice_", [(20_000, 1024), (5, 4), (0, 1024)])
def test_line_dedup_equals_brute_force(spark, monkeypatch, hottest, slice_):
    monkeypatch.setattr(line_dedup, "HOTTEST", hottest)
    monkeypatch.setattr(line_dedup, "SLICE", slice_)
    r = random.Random(1)
    pool = [f"Line {i}" for i in range(30)]
    texts = ["\n".join(r.choice([" %s ", "%s", "%s\t"]) % r.choice(pool).swapcase() for _ in range(r.randint(0, 9))) for _ in range(80)] + ODD
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(UPPER, LOWER))
    df = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    want = {i: "\n".join(x for x in (t or "").split("\n") if not (key(x) and df[key(x)] >= 10)) for i, t in enumerate(texts)}
    docs = table(spark, texts, **CLASH)
    parts = [docs.where(F.col("doc_id") % 6 == k) for k in range(6)]
    for batches in (parts, 1, 7):
        out = line_dedup.dedup_lines(docs, 10, batches=batches)
        assert {x.doc_id: x.text or "" for x in out.collect()} == want and out.columns == docs.columns
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_runs_hold_each_key_once(spark):
    texts = [f"own {i}\nshared {i % 7}\n{i // 10}" for i in range(60)] + ["own 3"]
    docs = table(spark, texts)
    runs = line_dedup.runs_of(docs, [docs.where(F.col("doc_id") % 6 == k) for k in range(6)], fanout=2)
    assert runs.compactions >= 3 and sum(map(len, runs.levels)) <= 3 and len(runs.additions) == 5
    keys = [x.line_hash for x in runs.runs().collect()]
    want = Counter(line for t in texts for line in set(t.split("\n")))
    assert len(keys) == len(set(keys)) == len(want)
    assert sorted(x.n_docs for x in runs.frequent(2).collect()) == sorted(c for c in want.values() if c >= 2)


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(2)
    parts = ["a", "the", "  ", "   ", " ", "\n", "é", "①", "▁", "x" * 40, "ab" * 30, "<s>", "<0x0A>", "22", "\x00", "🙂", " " * 17]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(1500)] + [x or "" for x in ODD]
    got = tokens.TokenCounter(path).counts(pa.array(texts))
    assert got.tolist() == [len(model.encode(t)) for t in texts]
    out = table(spark, ODD).select("doc_id", tokens.token_count(path)("text").alias("n")).collect()
    assert {x.doc_id: x.n for x in out} == {i: len(model.encode(t or "")) for i, t in enumerate(ODD)}


SECRET = "hello password=abcdef123 x"


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(),
        lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
        lambda s: "".join(f"%{c:02x}" for c in s.encode()),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: "".join(f"&#{ord(c)};" for c in s),
        lambda s: "".join(f"%{c:02X}" for c in base64.b64encode(s.encode())),
    ],
)
def test_wrapped_secrets_are_found(wrap):
    head, inner = "é before ", wrap(SECRET)
    spans = [x for x in secrets.all_spans(f"{head}{inner} after") if x[1] == 0]
    assert spans and all(len(head) <= a < b <= len(head) + len(inner) for a, _, b in spans)


B64 = lambda b: base64.b64encode(b if isinstance(b, bytes) else b.encode()).decode()
URL = lambda b: "".join(f"%{c:02x}" for c in (b if isinstance(b, bytes) else b.encode()))


@pytest.mark.parametrize(
    "inner",
    [
        "https://h.example/cb/" + B64("token=abcdefghij"),
        "key_" + B64("token=abcdefghij"),
        "id-" + B64("token=abcdefghij") + "-v2",
        B64(b"\xff\xfe" + b"token=abcdefghij" + b"\x80"),
        "\n".join(re.findall(".{1,76}", B64("é some words before it, " * 4 + "token=abcdefghij and more " * 9))),
        "  \r\n  ".join(re.findall(".{1,64}", B64("words " * 30 + "token=abcdefghij"))).replace("  \r", "\r"),
        "%ff" + URL("token=abcdefghij"),
        "%e9" + URL("token=abcdefghij"),
        "".join(f"\\U{ord(c):08x}" for c in "token=abcdefghij"),
        "x/" + B64(b"\x00\x01\x02" + zlib.compress(b"token=abcdefghij")),
        "_" + B64("-" + B64("/" + B64("token=abcdefghij"))),
        URL("a/" + B64("token=abcdefghij")),
    ],
)
def test_secrets_are_found_beside_what_is_no_part_of_their_encoding(inner):
    for head, tail in (("", ""), ("é see: ", ", end"), ('"', '"'), ("<", ">"), ("(=", ")")):
        spans = [(a, b) for a, k, b in secrets.all_spans(head + inner + tail) if k == 0]
        assert spans and all(len(head) <= a < b <= len(head) + len(inner) for a, b in spans), (head, inner, spans)


def test_random_wraps_around_secrets():
    r = random.Random(12)
    wraps = [B64, URL, lambda x: B64(gzip.compress(x.encode() if isinstance(x, str) else x)), lambda x: "".join(f"&#{c};" for c in (x.encode() if isinstance(x, str) else x)), lambda x: B64(bytes(r.randrange(128, 192) for _ in range(r.randrange(4))) + (x.encode() if isinstance(x, str) else x))]
    noise = ["", "/", "_", "-", "a/", "id_", "q-", " ", "\n", '"', "é", "=", "%zz", "\\u12"]
    for _ in range(400):
        s = "token=" + "".join(r.choice("abcdef123") for _ in range(8))
        for _ in range(r.randint(1, 3)):
            s = r.choice(noise[:7]) + r.choice(wraps)(s)
        head, tail = r.choice(noise), r.choice(noise[1:])
        spans = [(a, b) for a, k, b in secrets.all_spans(head + s + " " + tail) if k == 0]
        assert any(len(head) <= a < b <= len(head) + len(s) for a, b in spans), (head, s, tail, spans)


def test_words_alone_hide_no_secrets():
    r = random.Random(13)
    for _ in range(300):
        s = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFG/_-") for _ in range(r.randrange(3, 60))) for _ in range(20))
        assert secrets.all_spans(s) == secrets.base_spans(s)


def test_null_empty_repeated_and_clashing_texts(spark):
    texts = [None, "", SECRET, SECRET, "x" * 300_000 + " " + SECRET]
    rows = {r.doc_id: r.spans for r in table(spark, texts, **CLASH, spans=1).select("doc_id", secrets.secrets("text").alias("f")).select("doc_id", "f.*").collect()}
    assert rows[0] == rows[1] == "" and rows[2] == rows[3] != "" and rows[4].startswith(f"assign:{300_001 + SECRET.index('password')}:")
    assert table(spark, []).select(secrets.secrets("text")).count() == 0


def test_equal_secrets_at_several_places_are_all_found():
    one, url = base64.b64encode(SECRET.encode()).decode(), "".join(f"%{c:02x}" for c in SECRET.encode())
    for parts in ([one] * 3, [url] * 3, [one, base64.b64encode(one.encode()).decode(), url]):
        s = "a " + " \n ".join(parts) + " z"
        spans = [(a, b) for a, k, b in secrets.all_spans(s) if k == 0]
        at = 0
        for part in parts:
            at = s.index(part, at)
            assert any(at <= a < b <= at + len(part) for a, b in spans), (parts, at, spans)
            at += len(part)


def test_shortest_encoded_secrets_pass_the_prefilter(spark):
    texts = ["dG9rZW49YWJjZGVm", "x c2VjcmV0PWFiY2RlZg== y", "cGFzc3dkPWh1bnRlcjI="]
    rows = table(spark, texts).select("doc_id", secrets.secrets("text").alias("s")).select("doc_id", "s.spans").collect()
    assert len(rows) == 3 and all(r.spans.startswith("assign:") for r in rows)


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, zstandard.compress])
def test_compressed_secrets_are_found_wherever_they_stand(monkeypatch, pack):
    wrap = lambda raw: "head " + base64.b64encode(raw).decode() + " tail"
    found = lambda raw: {(a, b) for a, k, b in secrets.all_spans(wrap(raw)) if k == 0}
    whole = lambda raw: {(5, len(wrap(raw)) - 5)}
    members = pack(b"nothing here\n" * 50) + pack(SECRET.encode())
    assert found(members) == whole(members)
    twice = pack(pack(b"plain") + pack(SECRET.encode()))
    assert found(twice) == whole(twice)
    monkeypatch.setattr(secrets, "PIECE", 64)
    for n in range(60, 70):  # a piece may end inside of any character or secret
        far = pack("é".encode() * n * 10 + b"," + SECRET.encode() + b"," * 700)
        assert found(far) == whole(far)
        blob = base64.b64encode(SECRET.encode() * 20)
        assert found(pack(b"." * n + b"\n" + blob)) == whole(pack(b"." * n + b"\n" + blob))


def test_secret_behind_64_mb_of_unpacked_bytes():
    run = base64.b64encode(gzip.compress(b"\n" * (65 << 20) + SECRET.encode(), 1)).decode()
    assert secrets.all_spans(run) == [(0, 0, len(run))]


def test_base_secrets(spark):
    texts = ["secret=token:abcdef12", "API-KEY apikey : 'abc_123' AKIA" + "B" * 16, "0123456789abcdef" * 2, "ſecret=abcdefgh", "password=abc"]
    rows = {r.doc_id: r for r in table(spark, texts + ODD).select("doc_id", secrets.secrets("text").alias("s")).select("doc_id", "s.*").collect()}
    assert [(rows[i].n_assign, rows[i].n_access, rows[i].n_hex) for i in range(5)] == [(0, 0, 0), (1, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0)]
    assert rows[2].base_sha256 == hashlib.sha256(b"hex:0:32").hexdigest() and rows[2].spans == "hex:0:32"
    assert all(rows[5 + i].spans == "" for i in range(len(ODD)))


def brute_templates(shapes):
    """Level by level over all depths, in plain Python. shapes: (host, segs, labelled, bad)."""
    rows = [[h, list(s), m, x] for h, s, m, x in shapes]
    depth = max(len(r[1]) for r in rows)

    def nodes(d):
        out = {}
        for r in rows:
            if len(r[1]) > d:
                out.setdefault((r[0], tuple(r[1][:d])), []).append(r)
        return out.values()

    for d in range(depth):
        for below in nodes(d):
            if len({r[1][d] for r in below}) > urls.BRANCHES:
                for r in below:
                    r[1][d] = "*"
    for d in reversed(range(depth)):
        for below in nodes(d):
            sums = {}
            for r in below:
                m, x = sums.get(r[1][d], (0, 0))
                sums[r[1][d]] = (m + r[2], x + r[3])
            mm, xx = sum(m for m, _ in sums.values()), sum(x for _, x in sums.values())
            p, k = (xx / mm if mm else 0), sum(m > 0 for m, _ in sums.values())
            chi = sum((x - m * p) ** 2 / (m * p * (1 - p)) for m, x in sums.values() if m) if 0 < p < 1 else 0
            if len(sums) > 1 and chi <= (k - 1) + 2 * (2 * max(k - 1, 0)) ** 0.5:
                for r in below:
                    r[1][d] = "*"
    return {(r[0], tuple(s[1])): "/" + "/".join(r[1]) for r, s in zip(rows, shapes, strict=True)}


def test_templates_equal_levels_in_plain_python(spark):
    r = random.Random(3)
    shapes = {}
    for _ in range(400):
        segs = tuple(r.choice("abcdefghijklmnopqrstuvwxyz"[: r.choice((2, 4, 26))]) for _ in range(r.randrange(6)))
        m = r.choice((0, 0, 5, 40))
        shapes[r.choice(("x", "y", "")), segs] = (m, round(m * r.choice((0, 0.1, 0.9))))
    shapes["deep", ("s",) * 1000] = shapes["deep", ("s",) * 999 + ("t",)] = shapes["deep", ("s",) * 500] = (3, 1)
    rows = [(h, list(s), m, x) for (h, s), (m, x) in shapes.items()]
    found = urls.templates(spark.createDataFrame(rows, "host string, segs array<string>, labelled long, bad long").repartition(3)).collect()
    assert len(found) == len(rows)
    assert {(f.host, tuple(f.segs)): f.template for f in found} == brute_templates([(h, s, m, x) for (h, s), (m, x) in shapes.items()])
    none = spark.createDataFrame([], "host string, segs array<string>, labelled long, bad long")
    assert urls.templates(none).count() == 0


def test_urls(spark):
    bad = [(i, f"http://spam.org/x{i}/p/{i}", "") for i in range(60)]
    good = [(100 + i, f"http://Good.org/en/{1000 + i}.html?q#f", "") for i in range(60)]
    odd = [(300, None, ""), (301, "nothing", ""), (302, "http://a.www.example.com/en/1", ""), (303, "http://example.com/en/1", ""), (304, "ftp://x.net/es/", ""), (305, "http://notcom/", ""), (306, "http://h?x://y", "")]
    pages = spark.createDataFrame(bad + good + odd, "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(60)] + [(1000 + i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urls.url_filter(pages, labels).collect()}
    assert len(got) == len(bad + good + odd)
    assert all(got[i].verdict == "block" for i in range(60)) and all(got[100 + i].verdict == "allow" for i in range(60))
    assert (got[100].host, got[100].path) == ("good.org", "/en/1000.html")
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(300, 307)] == [
        ("", "", None), ("", "", None), ("a.www.example.com", "/en/1", "www.example.com/en/"), ("example.com", "/en/1", "example.com/en/"), ("x.net", "/es/", "net/es/"), ("notcom", "/", None), ("h", "", None),
    ]
    assert urls.url_filter(pages.limit(0), labels.limit(0)).count() == 0


def test_kneser_ney(spark):
    r = random.Random(3)
    syllables = ["an", "the", "ing", "er", "on", "re", "tion", "st"]
    clean = [" ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(60)) for _ in range(80)]
    junk = ["".join(chr(r.randint(33, 126)) for _ in range(400)) for _ in range(10)]
    docs = table(spark, clean + junk + ODD[:3])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(i, 0, 0) for i in range(80, 85)], "doc_id long, quality int, toxic int")
    kept = {x.doc_id: x.kept for x in kneser_ney.classified(docs, labels).collect()}
    assert all(kept[i] for i in range(80)) and not any(kept[80 + i] for i in range(10)) and not any(kept[90 + i] for i in range(3))
    tables = kneser_ney.models(docs.where("doc_id < 50").select(F.lit(0).cast("long").alias("side"), "text"))
    for context in (b"the ", b"xyz!", bytes([kneser_ney.PAD] * 4)):  # every context is a distribution
        start = int.from_bytes(context, "big") << 8
        wanted = spark.range(start, start + 256).select(F.lit(0).cast("long").alias("side"), F.col("id").alias("gram"))
        assert kneser_ney.probabilities(wanted, tables).agg(F.sum("p")).first()[0] == pytest.approx(1, abs=1e-9)
    assert {x.kept for x in kneser_ney.classified(docs, labels.limit(0)).collect()} == {False}


def brute_perplexity(train, doc):
    """Interpolated modified Kneser-Ney of byte n-grams, written out."""
    n = kneser_ney.ORDER
    raw = lambda t: bytes([kneser_ney.PAD] * (n - 1)) + t.translate(str.maketrans(UPPER, LOWER)).encode()
    counts = [Counter(b[i : i + n] for t in train for b in [raw(t)] for i in range(len(b) - n + 1))]
    for _ in range(n - 1):
        counts.insert(0, Counter(g[1:] for g in counts[0]))

    def cuts(c):
        m = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1]) if m[0] else 0.5
        d = [k - (k + 1) * y * m[k] / m[k - 1] if m[k - 1] else k * 0.5 for k in (1, 2, 3)]
        d = [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d)]
        return lambda v: d[min(v, 3) - 1]

    cut = [cuts(c) for c in counts]
    by_context = [{} for _ in counts]
    for c, by in zip(counts, by_context):
        for g, v in c.items():
            by.setdefault(g[:-1], []).append(v)

    def p(g):
        if not g:
            return 1 / 256
        k = len(g) - 1
        own = by_context[k].get(g[:-1])
        if not own:
            return p(g[1:])
        c = counts[k][g]
        return ((c - cut[k](c)) if c else 0) / sum(own) + sum(map(cut[k], own)) / sum(own) * p(g[1:])

    b = raw(doc)
    return float(np.exp2(-sum(np.log2(p(b[i : i + n])) for i in range(len(b) - n + 1)) / (len(b) - n + 1)))


@pytest.mark.parametrize("block", [32 << 20, 100])
def test_kneser_ney_tables_equal_brute_force(spark, monkeypatch, block):
    r = random.Random(9)
    texts = [" ".join(r.choice(["a", "b", "c", "dd", "e", f"x{r.randint(0, 9)}"]) for _ in range(r.randint(1, 40))) for _ in range(40)]
    texts += [texts[3], "never seen", "a B\nc", "a a a a " * 50, "é ÿ \U0001f600", "z", "word " * 3000]
    docs = table(spark, [*texts, None, "", " \n"], **CLASH)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(kneser_ney, "BLOCK", block)
    monkeypatch.setattr(type(docs), "toPandas", None)  # the model stays in tables
    got = {x.doc_id: x.perplexity for x in kneser_ney.classified(docs, labels).collect()}
    fold = {x.doc_id: x.f for x in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("f")).collect()}
    assert len(got) == len(texts) + 3 and all(got[len(texts) + i] is None for i in range(3))
    for i, t in enumerate(texts):
        want = brute_perplexity([texts[j] for j in range(30) if fold[j] != fold[i]], t)
        assert got[i] == pytest.approx(want, rel=1e-5), (i, t)


def test_kneser_ney_languages_repeats_and_empty_tables(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["one", "two", "three", "four"]) for _ in range(30)), lang) for i, lang in enumerate(["en"] * 60 + [None] * 40 + ["xx"])]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, None) for i in range(100)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classified(docs, labels).collect()
    assert len(got) == 106 and len({x.threshold for x in got}) == 3 and all(x.threshold for x in got)
    assert len({(x.doc_id, x.perplexity) for x in got}) == 101
    assert kneser_ney.classified(docs.limit(0), labels).count() == 0


def test_threshold_is_near_the_quantile_and_refuses_junk_that_looks_like_prose(spark):
    r = random.Random(11)
    words = ["".join(r.choice("aeiou") + r.choice("nrst") for _ in range(r.randint(1, 3))) for _ in range(120)]
    after = {w: r.sample(words, 3) for w in words}

    def prose(n):
        out = [r.choice(words)]
        while len(out) < n:
            out.append(r.choice(after[out[-1]]))
        return out

    clean = [prose(r.randint(20, 120)) for _ in range(200)]
    junk = [w if k % 2 else [x if r.random() < 0.4 else r.choice(words) for x in w] for k, w in enumerate(map(prose, [80] * 20))]
    junk = [sorted(w, key=lambda _: r.random()) if k % 2 else w for k, w in enumerate(junk)]
    docs = table(spark, [" ".join(x) for x in clean + junk])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    rows = {x.doc_id: x for x in kneser_ney.classified(docs, labels).collect()}
    trusted = sorted(rows[i].perplexity for i in range(150))
    assert trusted[146] <= rows[0].threshold <= trusted[146] + 1.5 * (trusted[146] - trusted[74])
    assert not any(rows[200 + i].kept for i in range(20)) and sum(rows[150 + i].kept for i in range(50)) >= 46


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_feistel_is_a_permutation(spark, n):
    df = spark.range(n).withColumn("p", sharding.feistel(F.col("id"), n, 7)).withColumn("back", sharding.feistel(F.col("p"), n, 7, inverse=True))
    rows = df.collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_sharding(spark):
    df = table(spark, ODD * 20, **CLASH).union(table(spark, ["z"], **CLASH).withColumn("doc_id", F.lit(None).cast("long")))
    rows = sharding.sharded(df, 40).collect()
    n = Counter(r.shard for r in rows)
    assert max(n.values()) - min(n.values()) <= 1 and len(rows) == len(ODD) * 20 + 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    again = sharding.sharded(df.repartition(7), 40).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    by = {r.doc_id: r for r in rows}
    assert by[0].size == 16 and by[0].text_crc32 == 0 and by[9].text_crc32 == zlib.crc32(ODD[9].encode())
    assert sharding.sharded(df.limit(0)).count() == 0


def brute_leaks(docs, items):
    """All shifts compared, without seeds."""
    out = {}
    words = lambda t: WORD.findall((t or "").lower())
    for i, tb in items:
        b = words(tb)
        width = min(decontamination.WINDOW, len(b))
        for d, td in docs:
            h, best = words(td), 0
            for shift in range(-len(b) + 1, len(h) if width else 0):
                low, high = max(0, -shift), min(len(b), len(h) - shift)
                eq = [int(h[j + shift] == b[j]) for j in range(low, high)]
                best = max([best, *(sum(eq[k : k + width]) for k in range(len(eq) - width + 1))])
            if best and best >= decontamination.AGREE * width:
                out[(d, i)] = best
    return out


def test_masks_find_every_leak():
    for length in range(1, 30):
        width = min(decontamination.WINDOW, length)
        most = next(m for m in range(width, -1, -1) if width - m >= decontamination.AGREE * width)
        for bad in itertools.combinations(range(width), most):
            assert any(not {p + o for o in m} & set(bad) for m in decontamination.masks_of(length) for p in range(width - m[-1])), (length, bad)


@pytest.mark.parametrize("few_words", [0, 200_000])
def test_decontamination_of_short_items(spark, monkeypatch, few_words):
    monkeypatch.setattr(decontamination, "FEW_WORDS", few_words)
    r = random.Random(12)
    words = [f"s{i}" for i in range(60)]
    items = [(n, " ".join(r.choice(words) for _ in range(n))) for n in range(1, 16)] + [(30, "S1 s2"), (30, "S1 s2")]
    docs = [" ".join(r.choice(words) for _ in range(r.randint(0, 25))) for _ in range(20)]
    for _, t in items:
        for k in range(len(t.split())):
            w = t.split()
            w[k] = "other"
            docs += [" ".join(w), " ".join(["x", *w, "y"])]
    df, bench = table(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.agreeing for x in decontamination.leaks(df, bench, ["doc_id"]).collect()}
    assert got == brute_leaks(list(enumerate(docs)), items)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(4)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate([7, 8, 10, 13, 20, 40, 60])] + [(90, None), (91, "")]
    docs = list(ODD[:8])
    for _, t in items[:7]:
        for every in (0, 4, 6, 9):
            w = t.split()
            w = ["sub" if every and k % every == 2 else x for k, x in enumerate(w)]
            around = [r.choice(words) for _ in range(30)]
            docs.append(" ".join(around[:15] + w + around[15:]).upper())
        docs.append(" ".join(t.split()[: len(t.split()) // 2]))
    docs += [" ".join(r.choice(words) for _ in range(100)) for _ in range(30)]
    df, bench = table(spark, docs, **CLASH), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.agreeing for x in decontamination.leaks(df, bench, ["doc_id"]).collect()}
    want = brute_leaks(list(enumerate(docs)), items)
    assert got == want and len(want) > 10
    out = decontamination.clean(df, bench)
    assert {x.doc_id for x in out.collect()} == set(range(len(docs))) - {d for d, _ in want} and out.columns == df.columns
    assert decontamination.leaks(df, bench.limit(0), ["doc_id"]).count() == 0 and decontamination.clean(df.limit(0), bench).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "FEW_WORDS", 0)
    item = " ".join(f"q{i}" for i in range(20))
    df, bench = table(spark, ["x " + item, "y"]), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(x.doc_id, x.item_id) for x in decontamination.leaks(df, bench, ["doc_id"]).collect()] == [(0, 1)]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    r = random.Random(6)
    texts = ODD + ["".join(r.choice(["word ", "a\nb ", "  ", "x.", "\n ", "é", " <|endoftext|>"]) for _ in range(r.randint(0, 900))) for _ in range(60)]
    rows = packing.packed(table(spark, texts, **CLASH), path).toPandas()
    for i, t in enumerate(texts):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and own.piece.tolist() == list(range(len(own))) and (own.length.tolist()[1:] == [1024] * (len(own) - 1))
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[a : a + n], dtype="<u4").tobytes()) for a, n in zip(own.start, own.length)]
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    assert rows.groupby("sequence_id").length.sum().max() <= 1024
    assert packing.packed(table(spark, texts).limit(0), path).count() == 0


def test_packing_plan_is_tight():
    r = random.Random(8)
    counts = Counter(min(1023, max(1, int(r.expovariate(1 / 300)))) for _ in range(20_000))
    filled = Counter()
    placed = Counter()
    for n, a, b, s, offset in packing.plan(dict(counts)):
        placed[n] += b - a
        for i in range(b - a):
            filled[s + i] += n
    assert placed == counts and max(filled.values()) <= 1024
    assert len(filled) <= 1.01 * sum(n * c for n, c in counts.items()) / 1024 + 1
