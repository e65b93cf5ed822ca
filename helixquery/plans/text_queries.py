"""Queries of exact search, vocabulary, retrieval and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixquery.operators import generation, kmers, scoring, search, sections, shards, vocabulary
from helixquery.operators.kmers import top_per_group
from helixquery.plans import views as V
from helixquery.storage import stored


def batch_search(spark: SparkSession, d: str) -> DataFrame:
    return search.counts(V.documents(spark, d), "doc_id", "text", V.patterns(spark, d), "pattern")


BATCH_SEARCH = f"WITH {V.HITS} SELECT item_id, pattern, CAST(coalesce(n, 0) AS BIGINT) AS n FROM patterns LEFT JOIN (SELECT pattern, count(*) AS n FROM hits GROUP BY pattern) USING (pattern)"


def _located(spark: SparkSession, d: str) -> DataFrame:
    docs = V.documents(spark, d).select("doc_id", "text")
    return search.hits(docs, "doc_id", "text", V.patterns(spark, d))


def locate(spark: SparkSession, d: str) -> DataFrame:
    docs = V.documents(spark, d).select("doc_id", "text")
    found = _located(spark, d).join(docs, "doc_id")
    line, column = search.line_and_column(F.col("text"), F.col("offset"))
    around = search.context(F.col("text"), F.col("offset"), F.octet_length("pattern"), 40)
    return found.select("doc_id", "pattern", "offset", line.cast("long").alias("line"), column.cast("long").alias("col"), F.hex(around).alias("context"))


_HEAD = "substr(text, 1, i - 1)"
_AT = f"strlen({_HEAD})"
LOCATE = f"""WITH {V.HITS},
h AS (SELECT *, {_AT} AS off, {_HEAD} AS head, hex(encode(text)) AS x FROM hits)
SELECT doc_id, pattern, CAST(off AS BIGINT) AS "offset", CAST(len(string_split(head, chr(10))) AS BIGINT) AS line,
       CAST(strlen(string_split(head, chr(10))[-1]) + 1 AS BIGINT) AS col,
       substr(x, CAST(2 * greatest(off - 40, 0) + 1 AS BIGINT), CAST(2 * (off + strlen(pattern) + 40 - greatest(off - 40, 0)) AS BIGINT)) AS context FROM h"""


def _in_context(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """Occurrences with line, column and 40 bytes on either side, as hex."""
    docs = V.documents(spark, d).select("doc_id", "text")
    line, column = search.line_and_column(F.col("text"), F.col("offset"))
    around = search.context(F.col("text"), F.col("offset"), F.octet_length("pattern"), 40)
    return found.join(docs, "doc_id").select(*found.columns, line.cast("long").alias("line"), column.cast("long").alias("col"), F.hex(around).alias("context"))


def search_page(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 occurrences of all patterns, in context."""
    return _in_context(spark, d, _located(spark, d).orderBy("doc_id", "offset", "pattern").limit(20))


_CONTEXT = f"""h AS (SELECT *, {_AT} AS off, {_HEAD} AS head, hex(encode(text)) AS x FROM hits),
found AS (SELECT doc_id, pattern, CAST(off AS BIGINT) AS "offset", CAST(len(string_split(head, chr(10))) AS BIGINT) AS line, CAST(strlen(string_split(head, chr(10))[-1]) + 1 AS BIGINT) AS col,
  substr(x, CAST(2 * greatest(off - 40, 0) + 1 AS BIGINT), CAST(2 * (off + strlen(pattern) + 40 - greatest(off - 40, 0)) AS BIGINT)) AS context FROM h)"""
SEARCH_PAGE = f'WITH {V.HITS}, {_CONTEXT} SELECT * FROM found ORDER BY doc_id, "offset", pattern LIMIT 20'


def search_one(spark: SparkSession, d: str) -> DataFrame:
    """The first ten occurrences of the first eight characters of an item, in context."""
    asked = V.patterns(spark, d).where("item_id = 0").select(F.left("pattern", F.lit(8)).alias("pattern"))
    docs = V.documents(spark, d).select("doc_id", "text")
    return _in_context(spark, d, search.hits(docs, "doc_id", "text", asked).orderBy("doc_id", "offset").limit(10))


_ONE = V.HITS.replace(V.PATTERNS, "patterns AS (SELECT item_id, left(text, 8) AS pattern FROM benchmark WHERE item_id = 0)")
SEARCH_ONE = f'WITH {_ONE}, {_CONTEXT} SELECT * FROM found ORDER BY doc_id, "offset" LIMIT 10'


def search_multi(spark: SparkSession, d: str) -> DataFrame:
    """Up to three occurrences of each pattern."""
    return search.first_hits(_located(spark, d), "pattern", ["doc_id", "offset"], 3).withColumn("rank", F.col("rank").cast("long"))


SEARCH_MULTI = f"""WITH {V.HITS}, r AS (SELECT doc_id, pattern, CAST({_AT} AS BIGINT) AS "offset" FROM hits)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY doc_id, "offset") AS rank FROM r) WHERE rank <= 3"""


def rank_files(spark: SparkSession, d: str) -> DataFrame:
    docs = V.documents(spark, d)
    folder = F.when(F.col("doc_id") % 3 == 0, "gen_").when(F.col("doc_id") % 3 == 1, "tests/").otherwise("src/")
    rows = docs.select(F.concat(folder, F.lit("doc"), F.col("doc_id")).alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("at", "one"))
    n = search.overlapping(F.col("one"), F.lit("th"))
    return search.ranked_files(rows.select("file", (F.col("at") + 1).alias("line"), n.cast("long").alias("count")).where("count > 0"), 0.1)


RANK_FILES = """WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS one FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
c AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'gen_' WHEN 1 THEN 'tests/' ELSE 'src/' END || 'doc' || doc_id AS file, doc_id % 3 AS kind, line, CAST((length(one) - length(replace(one, 'th', ''))) / 2 AS BIGINT) AS n FROM l)
SELECT file, round(sum(ln(1 + n) * CASE kind WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 ELSE 1.0 END) + 0.1 * count(*), 6) AS score, count(*) AS term_count,
       CAST(sum(n) AS BIGINT) AS hit_count, CAST(min(line) AS INTEGER) AS line FROM c WHERE n > 0 GROUP BY file"""


def vocabulary_terms(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.terms(V.documents(spark, d), "text")


_TERMS = """t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM documents),
terms AS (SELECT DISTINCT term FROM (SELECT lower(unnest(CASE WHEN contains(token, '_') THEN string_split(token, '_')
          ELSE string_split(regexp_replace(token, '([A-Z])', chr(10) || '\\1', 'g'), chr(10)) END)) AS term FROM t) WHERE length(term) > 1)"""
VOCABULARY = f"WITH {_TERMS} SELECT term FROM terms"


def vocabulary_prefix(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.with_prefix(vocabulary_terms(spark, d), "th", 20)


VOCABULARY_PREFIX = f"WITH {_TERMS} SELECT term FROM terms WHERE starts_with(term, 'th') ORDER BY term LIMIT 20"


def vocabulary_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Which words of the benchmark's items (as they stand, and in lower case) are terms of the documents."""
    words = V.table(spark, d, "benchmark").select(F.explode(F.split("text", "[ \n]+")).alias("w")).select(F.explode(F.array("w", F.lower("w"))).alias("term"))
    return vocabulary.looked_up(vocabulary_terms(spark, d), words)


VOCABULARY_LOOKUP = f"WITH {_TERMS}, a AS (SELECT DISTINCT unnest([w, lower(w)]) AS term FROM (SELECT unnest(regexp_split_to_array(text, '[ \n]+')) AS w FROM benchmark)) SELECT a.term, terms.term IS NOT NULL AS found FROM a LEFT JOIN terms ON a.term = terms.term"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Of the benchmark's items as files and their sentences as sections."""
    items = V.table(spark, d, "benchmark")
    sections = items.select(F.explode(F.split("text", r"\. ?")).alias("text"))
    tokens = lambda x: x.select(vocabulary.section_tokens(F.col("text")).alias("tokens"))
    return vocabulary.cooccurrence(tokens(sections), tokens(items))


def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


_LETTER = r"\p{L}"


def _unit(name: str, source: str) -> str:
    return f"""{name}_n AS (SELECT uid, unnest(regexp_extract_all(text, '[{_LETTER}_][{_LETTER}\\p{{N}}_]*')) AS token FROM {source}),
{name} AS (SELECT DISTINCT uid, term FROM (SELECT uid, lower(token) AS term FROM {name}_n UNION ALL
  SELECT uid, lower(unnest(string_split(replace(regexp_replace(token, '(\\p{{Lu}})', chr(10) || '\\1', 'g'), '_', chr(10)), chr(10)))) FROM {name}_n)
  WHERE strlen(term) >= 2),
{name}_p AS (SELECT x.term AS term_a, y.term AS term_b, count(*) AS n FROM {name} x JOIN {name} y ON x.uid = y.uid AND x.term < y.term GROUP BY 1, 2)"""


_EDGES = f"""files AS (SELECT row_number() OVER () AS uid, text FROM benchmark),
sections AS (SELECT row_number() OVER () AS uid, text FROM (SELECT unnest(regexp_split_to_array(text, '\\. ?')) AS text FROM benchmark)),
{_unit("f", "files")},
{_unit("s", "sections")},
edges AS (SELECT term_a, term_b, CAST(coalesce(s_p.n, 0) AS BIGINT) AS section_count, CAST(coalesce(f_p.n, 0) AS BIGINT) AS file_count,
          CAST(3.0 * coalesce(s_p.n, 0) + coalesce(f_p.n, 0) AS DOUBLE) AS weight FROM s_p FULL JOIN f_p USING (term_a, term_b))"""
COOCCURRENCE = f"WITH {_EDGES} SELECT * FROM edges WHERE weight >= 1.0"


def related_terms(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.related(_edges(spark, d), "The", 20)


_BOTH = "b AS (SELECT term_a AS term, term_b AS other, weight FROM edges UNION ALL SELECT term_b, term_a, weight FROM edges)"
RELATED_TERMS = f"WITH {_EDGES}, {_BOTH} SELECT other, weight FROM b WHERE term = 'the' ORDER BY weight DESC, other LIMIT 20"

QUESTION = "Where is the ered that thint of ciones?"


def enriched_terms(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.enriched(_edges(spark, d), QUESTION, 40, 10, hints=["Que", "and"])


ENRICHED_TERMS = f"""WITH {_EDGES}, {_BOTH}, seeds AS (SELECT unnest(['ered', 'thint', 'ciones', 'que', 'and']) AS term),
n AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY weight DESC, other) AS r FROM b WHERE term IN (SELECT term FROM seeds)),
a AS (SELECT term, 10000.0::DOUBLE AS weight FROM seeds UNION ALL SELECT other, weight FROM n WHERE r <= 10)
SELECT term, max(weight) AS weight FROM a WHERE length(term) >= 2 GROUP BY term ORDER BY weight DESC, term LIMIT 40"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """Documents by occurrences (not overlapping) of each item's text."""
    found = _located(spark, d).select("doc_id", "pattern").distinct().join(V.patterns(spark, d), "pattern")
    found = found.join(V.documents(spark, d).select("doc_id", "text"), "doc_id").select("item_id", "doc_id", search.apart(F.col("text"), F.col("pattern")).alias("score"))
    return top_per_group(found, "item_id", [F.desc("score"), "doc_id"], 10).select(F.col("item_id").alias("query_id"), "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)


_RANKED = f"""{V.PATTERNS}, c AS (SELECT item_id AS query_id, doc_id, CAST((strlen(text) - strlen(replace(text, pattern, ''))) // strlen(pattern) AS BIGINT) AS score FROM documents JOIN patterns ON contains(text, pattern)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c) WHERE rank <= 10)"""
RANKING = f"WITH {_RANKED} SELECT * FROM ranked"


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A document is relevant for an item if it holds the item's whole text."""
    items = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    whole = _located(spark, d).select("doc_id", F.col("pattern").alias("text")).distinct()
    relevant = whole.join(items, "text").select("query_id", "doc_id").distinct()
    return scoring.retrieval_metrics(_ranked(spark, d), relevant, items, 5)


RETRIEVAL_METRICS = f"""WITH {_RANKED},
rel AS (SELECT DISTINCT item_id AS query_id, doc_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)),
f AS (SELECT query_id, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg FROM ranked JOIN rel USING (query_id, doc_id) WHERE rank <= 5 GROUP BY query_id),
z AS (SELECT query_id, count(*) AS size, sum(1 / log2(i + 1)) FILTER (WHERE i <= 5) AS ideal FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id) AS i FROM rel) GROUP BY query_id)
SELECT item_id AS query_id, CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, round(coalesce(found, 0) / 5, 6) AS precision,
       round(CASE WHEN size IS NULL THEN 1.0 ELSE coalesce(found, 0) / size END, 6)::DOUBLE AS recall, round(coalesce(dcg / ideal, 0), 6)::DOUBLE AS ndcg
FROM benchmark LEFT JOIN f ON f.query_id = item_id LEFT JOIN z ON z.query_id = item_id"""


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return scoring.latency(V.table(spark, d, "events").select("event_type", "event_id", "value"), "event_type", "event_id", "value")


_LATENCY = """e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS j, count(*) OVER (PARTITION BY event_type) AS n FROM e WHERE i > 1),
lat AS (SELECT event_type, count(*) AS warm_n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, max(value) FILTER (WHERE j = round(0.5 * (n - 1))) AS p50,
          max(value) FILTER (WHERE j = round(0.95 * (n - 1))) AS p95, max(value) FILTER (WHERE j = round(0.99 * (n - 1))) AS p99 FROM r GROUP BY event_type)"""
LATENCY_STATS = f"WITH {_LATENCY} SELECT event_type, c.value AS cold, lat.* EXCLUDE (event_type) FROM (SELECT event_type, value FROM e WHERE i = 1) c LEFT JOIN lat USING (event_type)"


def compare_reports(spark: SparkSession, d: str) -> DataFrame:
    """The latencies of even users as the baseline, of odd users as the candidate."""
    events = V.table(spark, d, "events")
    side = lambda k: scoring.latency(events.where(F.col("user_id") % 2 == k).select("event_type", "event_id", "value"), "event_type", "event_id", "value")
    return scoring.compared(side(0), side(1), "event_type", ["p50", "p95", "mean"])


def _side(k: int) -> str:
    return f"""e{k} AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events WHERE user_id % 2 = {k}),
r{k} AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS j, count(*) OVER (PARTITION BY event_type) AS n FROM e{k} WHERE i > 1),
s{k} AS (SELECT event_type, unnest(['p50', 'p95', 'mean']) AS metric, unnest([max(value) FILTER (WHERE j = round(0.5 * (n - 1))), max(value) FILTER (WHERE j = round(0.95 * (n - 1))), round(avg(value), 6)]) AS x FROM r{k} GROUP BY event_type)"""


COMPARE_REPORTS = f"WITH {_side(0)}, {_side(1)} SELECT event_type, metric, s0.x AS baseline, s1.x AS candidate, round(s1.x - s0.x, 6) AS delta, round(CASE WHEN s0.x <> 0 THEN (s1.x - s0.x) / s0.x END, 6) AS relative FROM s0 JOIN s1 USING (event_type, metric)"


QUERY_BASES, SEED = 24, 42


def _generated(spark: SparkSession, d: str) -> DataFrame:
    """A query for every ten documents, from the documents' bases."""
    g = V.genome(spark, d).select("doc_id", "seq")
    return generation.generated_queries(g, "doc_id", "seq", QUERY_BASES, -(-g.count() // 10), SEED)


def generated_queries(spark: SparkSession, d: str) -> DataFrame:
    return _generated(spark, d)


def _seeded(what: str) -> str:
    return f"('0x' || left(md5('{SEED}:' || i || ':{what}'), 12))::BIGINT"


_GENERATED = f"""{V.GENOME}, num AS (SELECT doc_id, seq, row_number() OVER (ORDER BY doc_id) - 1 AS no, count(*) OVER () AS total FROM genome WHERE length(seq) >= {QUERY_BASES}),
i AS (SELECT unnest(range((SELECT (count(*) + 9) // 10 FROM documents))) AS i), a AS (SELECT i, {_seeded("record")} % (SELECT any_value(total) FROM num) AS no, {_seeded("place")} AS x FROM i),
gen AS (SELECT i AS query_id, doc_id AS origin, x % (length(seq) - {QUERY_BASES} + 1) AS "offset", substr(seq, CAST(x % (length(seq) - {QUERY_BASES} + 1) + 1 AS BIGINT), {QUERY_BASES}) AS pattern FROM a JOIN num USING (no))"""
GENERATED_QUERIES = f'WITH {_GENERATED} SELECT query_id, pattern, origin, "offset" FROM gen'


def generated_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Hit, precision, recall and NDCG at 5 of ranking documents by a generated query's occurrences; its origin is relevant."""
    asked = stored(_generated(spark, d), "generated")
    g = V.genome(spark, d).select("doc_id", "seq")
    best = kmers.best_records(g, "doc_id", "seq", asked, "pattern", QUERY_BASES, 10)
    ranked = best.join(asked.select("query_id", "pattern"), "pattern").select("query_id", "doc_id", "score", "rank")
    return scoring.retrieval_metrics(ranked, asked.select("query_id", F.col("origin").alias("doc_id")), asked, 5)


GENERATED_RETRIEVAL = f"""WITH {_GENERATED}, c AS (SELECT query_id, origin, doc_id, (length(seq) - length(replace(seq, pattern, ''))) // {QUERY_BASES} AS score FROM genome JOIN gen ON contains(seq, pattern)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c), k AS (SELECT query_id, rank FROM r WHERE doc_id = origin AND rank <= 5)
SELECT query_id, CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS hit, CASE WHEN rank IS NULL THEN 0.0 ELSE 0.2 END::DOUBLE AS precision, CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS recall,
       round(coalesce(1 / log2(rank + 1), 0), 6)::DOUBLE AS ndcg FROM gen LEFT JOIN k USING (query_id)"""


def report_gates(spark: SparkSession, d: str) -> DataFrame:
    """Languages as systems: hit and recall of the benchmark's items at 5 and at 1 (the baseline), event times as latencies."""
    return scoring.gated(_measures(spark, d), "lang")


def _measures(spark: SparkSession, d: str) -> DataFrame:
    docs = V.documents(spark, d).select("doc_id", "lang")
    found = _ranked(spark, d).join(docs, "doc_id")
    items = V.table(spark, d, "benchmark").agg(F.count(F.lit(1)).alias("items"))
    hit = lambda k: F.count_distinct(F.when(F.col("rank") <= k, F.col("query_id")))
    by = docs.select("lang").distinct().join(found.groupBy("lang").agg(hit(5).alias("h5"), hit(1).alias("h1"), F.count(F.lit(1)).alias("n")), "lang", "left").join(F.broadcast(items))  # one row
    all_docs = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("items")
    return by.join(all_docs, "lang").select("lang", share("h5").alias("hit"), share("h1").alias("baseline_hit"), (F.col("n") / F.col("docs")).alias("recall"), (F.col("docs") * 2.0).alias("p95_ms"))


_GATES = f"""WITH {_RANKED}, f AS (SELECT lang, count(DISTINCT query_id) FILTER (WHERE rank <= 5) AS h5, count(DISTINCT query_id) FILTER (WHERE rank <= 1) AS h1, count(*) AS n FROM ranked JOIN documents USING (doc_id) GROUP BY lang),
m AS (SELECT lang, coalesce(h5, 0)::DOUBLE / items AS hit, coalesce(h1, 0)::DOUBLE / items AS base, n::DOUBLE / docs AS recall, docs * 2.0::DOUBLE AS p95
      FROM (SELECT lang, count(*) AS docs FROM documents GROUP BY lang) LEFT JOIN f USING (lang), (SELECT count(*) AS items FROM benchmark)),
g AS (SELECT lang, unnest(['hit', 'regression', 'recall', 'p95_ms']) AS gate, unnest([hit, hit - base, recall, p95]) AS value, unnest([0.8::DOUBLE, -0.05::DOUBLE, 0.7::DOUBLE, 500.0::DOUBLE]) AS threshold FROM m),
p AS (SELECT lang, gate, round(value, 6) AS value, threshold, coalesce(CASE WHEN gate = 'p95_ms' THEN value <= threshold ELSE value >= threshold END, false) AS passed FROM g)"""
REPORT_GATES = f"{_GATES} SELECT * FROM p"


def report_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.verdicts(report_gates(spark, d), "lang")


REPORT_VERDICTS = f"{_GATES}, v AS (SELECT lang, coalesce(string_agg(gate, ', ' ORDER BY gate) FILTER (WHERE NOT passed), '') AS failed FROM p GROUP BY lang) SELECT lang, failed, CASE WHEN failed = '' THEN 'PASS' ELSE 'FAIL' END AS verdict FROM v"


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as source files: languages by number, and in each every line whose length falls right begins a section."""
    docs = V.documents(spark, d)
    kind = F.element_at(F.array(*(F.lit(x) for x in ("rs", "py", "erl", "md", "html", "txt"))), (F.col("doc_id") % 6 + 1).cast("int"))
    heads = {"rs": ("pub fn ", "(x) {"), "py": ("class ", ":"), "erl": ("f_", "("), "md": ("## ", ""), "html": ("<h2>", "</h2>")}
    letters = lambda x: F.substr(F.regexp_replace(x, "[^a-z]", ""), F.lit(1), F.lit(9))
    head = lambda x: F.coalesce(*(F.when(kind == k, F.concat(F.lit(a), letters(x), F.lit(b))) for k, (a, b) in heads.items()), F.concat(F.upper(letters(x)), F.lit(" X-Y")))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.when(F.length(x) % 5 == 1, head(x)).otherwise(F.concat(F.lit(" "), x)))
    return docs.select("doc_id", F.concat(F.lit("d/"), "doc_id", F.lit("."), kind).alias("path"), F.array_join(lines, "\n").alias("content"))


def sections_by_language(spark: SparkSession, d: str) -> DataFrame:
    return sections.sections(_files(spark, d)).select("path", "section", "name", "start", "end", F.md5("text").alias("md5"))


SECTIONS_BY_LANGUAGE = r"""WITH l AS (SELECT doc_id, doc_id % 6 AS k, i, n, x, substr(regexp_replace(x, '[^a-z]', '', 'g'), 1, 9) AS w
  FROM (SELECT doc_id, len(a) AS n, unnest(range(len(a))) AS i, unnest(a) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))),
m AS (SELECT *, CASE WHEN length(x) % 5 <> 1 THEN ' ' || x WHEN k = 0 THEN 'pub fn ' || w || '(x) {' WHEN k = 1 THEN 'class ' || w || ':' WHEN k = 2 THEN 'f_' || w || '(' WHEN k = 3 THEN '## ' || w WHEN k = 4 THEN '<h2>' || w || '</h2>'
  ELSE upper(w) || ' X-Y' END AS line FROM l),
b AS (SELECT *, CASE WHEN k = 3 THEN CASE WHEN starts_with(trim(line), '#') THEN trim(line) END WHEN k = 5 THEN CASE WHEN regexp_full_match(trim(line), '[A-Z \-À-ÖØ-Þ]{3,}') AND regexp_matches(line, '[A-ZÀ-ÖØ-Þ]') THEN trim(line) END
  WHEN length(x) % 5 = 1 THEN CASE k WHEN 0 THEN 'pub fn ' || w || '(x)' WHEN 1 THEN rtrim('class ' || w) WHEN 2 THEN 'f_' || w || '()' WHEN 4 THEN CASE WHEN w = '' THEN '<h2></h2>' ELSE w END END END AS head,
  sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - strlen(line) - 1 AS pos, sum(strlen(line) + 1) OVER (PARTITION BY doc_id) - 1 AS whole FROM m),
s AS (SELECT *, count(head) OVER (PARTITION BY doc_id ORDER BY i) AS sec, count(head) OVER (PARTITION BY doc_id) AS all_heads FROM b),
heads AS (SELECT doc_id, k, sec - 1 AS section, first(head ORDER BY i) AS name, min(pos) AS start, max(pos + strlen(line) + 1) AS e, any_value(whole) AS whole, string_agg(line, chr(10) ORDER BY i) AS text FROM s WHERE all_heads > 0 AND sec > 0 GROUP BY doc_id, k, sec),
win AS (SELECT a.doc_id, a.k, a.i // 25 AS section, 'lines ' || (a.i + 1) || '-' || least(a.i + 50, a.n) AS name, a.pos AS start, max(y.pos + strlen(y.line) + 1) AS e, a.whole, string_agg(y.line, chr(10) ORDER BY y.i) AS text
  FROM s a JOIN s y ON a.doc_id = y.doc_id AND y.i >= a.i AND y.i < a.i + 50 WHERE a.all_heads = 0 AND a.i % 25 = 0 GROUP BY ALL)
SELECT 'd/' || doc_id || '.' || (['rs', 'py', 'erl', 'md', 'html', 'txt'])[k + 1] AS path, section, name, CAST(start AS BIGINT) AS start, CAST(least(e, whole) AS BIGINT) AS "end",
  md5(text || CASE WHEN kind = 'h' AND e <= whole THEN chr(10) ELSE '' END) AS md5 FROM (SELECT *, 'h' AS kind FROM heads UNION ALL SELECT *, 'w' FROM win)"""


def term_graph(spark: SparkSession, d: str) -> DataFrame:
    """Of all conversations as text files: pairs of weight 8 or more (two places at least), ten a term."""
    turns = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    files = turns.select(F.concat(F.lit("c/"), "conv_id", F.lit(".txt")).alias("path"), F.array_join(F.transform("t", lambda x: x.text), "\n").alias("content"))
    return vocabulary.term_graph(files, min_weight=8.0, k=10)


SHARD_BYTES = 1 << 16


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    files = V.documents(spark, d).select(path.alias("path"), F.col("text").alias("content"))
    return shards.shard_plan(files.select("path", (2 + F.octet_length("path") + F.coalesce(F.octet_length("content"), F.lit(0))).alias("size")), "path", "size", SHARD_BYTES), files


def shard_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)[0]


_SHARDED = f"""WITH RECURSIVE f AS (SELECT 'd/' || lpad(doc_id::VARCHAR, 12, '0') AS path, CAST(16 + coalesce(strlen(text), 0) AS BIGINT) AS size, text FROM documents),
o AS (SELECT path, size, text, row_number() OVER (ORDER BY path) - 1 AS no, CAST(sum(size) OVER (ORDER BY path) - size AS BIGINT) AS start FROM f),
w AS (SELECT no, size AS filled, 0::BIGINT AS shard FROM o WHERE no = 0
  UNION ALL SELECT o.no, CASE WHEN filled + size > {SHARD_BYTES} THEN size ELSE filled + size END, CASE WHEN filled + size > {SHARD_BYTES} THEN shard + 1 ELSE shard END FROM w JOIN o ON o.no = w.no + 1)"""
SHARD_PLAN = f"{_SHARDED} SELECT path, size, no, start, shard FROM o JOIN w USING (no)"


def shard_manifest(spark: SparkSession, d: str) -> DataFrame:
    plan, files = _plan(spark, d)
    return shards.shard_manifest(plan, files, "path", "content")


SHARD_MANIFEST = f"{_SHARDED} SELECT shard, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS bytes, min(start) AS corpus_start, max(start + size) AS corpus_end, sha256(string_agg(sha256(text), '' ORDER BY no)) AS sha256 FROM o JOIN w USING (no) GROUP BY shard"


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train")
    kind = F.when(F.col("doc_id") % 2 == 0, ".fa.gz").otherwise(".fastq")
    files = V.documents(spark, d).select(F.concat(F.lit("doc/"), F.col("doc_id"), kind).alias("path"), "doc_id", "text")
    return shards.manifest(files, "path", "text", split, "https://example.org/data", None)


def dataset_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d)


_MANIFEST = """m AS (SELECT 'doc/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.fa.gz' ELSE '.fastq' END AS path, CASE WHEN doc_id % 2 = 0 THEN 'fasta' ELSE 'fastq' END AS format, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256,
CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, 'https://example.org/data' AS source_url, NULL::VARCHAR AS license FROM documents)"""
DATASET_MANIFEST = f"WITH {_MANIFEST} SELECT * FROM m"


def manifest_totals(spark: SparkSession, d: str) -> DataFrame:
    return shards.manifest_totals(_manifest(spark, d))


MANIFEST_TOTALS = f"WITH {_MANIFEST} SELECT split, format, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_bytes FROM m GROUP BY CUBE (split, format)"


def memory_estimate(spark: SparkSession, d: str) -> DataFrame:
    sizes = V.documents(spark, d).groupBy("source").agg(F.sum(F.octet_length("text")).cast("long").alias("size"))
    return sizes.select("source", "size", shards.memory_estimate(F.col("size"), 1_000_000).alias("m")).select("source", "size", "m.*")


MEMORY_ESTIMATE = "SELECT source, CAST(size AS BIGINT) AS size, CAST(6 * size AS BIGINT) AS peak, CAST(floor(1.5 * size) AS BIGINT) AS margin, CASE WHEN 6 * size <= 700000 THEN 'in_memory' ELSE 'streaming' END AS mode FROM (SELECT source, sum(strlen(text)) AS size FROM documents GROUP BY source)"


def federated_search(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences by shard (source) in the order of shard and place."""
    docs = V.documents(spark, d).select("doc_id", "source")
    return _located(spark, d).join(docs, "doc_id").select("source", "doc_id", "offset", "pattern").orderBy("source", "doc_id", "offset", "pattern")


FEDERATED_SEARCH = f'WITH {V.HITS} SELECT source, hits.doc_id, CAST({_AT.replace("text", "hits.text")} AS BIGINT) AS "offset", pattern FROM hits JOIN documents USING (doc_id)'


def blind_search(spark: SparkSession, d: str) -> DataFrame:
    words = ["th", "ción", "der", "ent"]
    return shards.blind_counts(V.documents(spark, d), "doc_id", "text", words, shards.given_key(spark)).withColumn("pattern", F.get(F.array(*map(F.lit, words)), "pattern_no")).select("pattern", "n")


BLIND_SEARCH = """SELECT pattern, CAST(sum((length(text) - length(replace(text, pattern, ''))) / length(pattern)) AS BIGINT) AS n
FROM documents, (SELECT unnest(['th', 'ción', 'der', 'ent']) AS pattern) GROUP BY pattern HAVING n > 0"""


def encryption_round_trip(spark: SparkSession, d: str) -> DataFrame:
    key = shards.given_key(spark)
    hidden = V.documents(spark, d).select("doc_id", shards.encrypted(F.col("text").cast("binary"), key).alias("hidden"))
    return hidden.select("doc_id", F.sha2(shards.decrypted(F.col("hidden"), key), 256).alias("sha256"))


ENCRYPTION_ROUND_TRIP = "SELECT doc_id, sha256(text) AS sha256 FROM documents"

QUERIES = {
    "batch_search": (batch_search, BATCH_SEARCH),
    "locate": (locate, LOCATE),
    "search_page": (search_page, SEARCH_PAGE),
    "search_one": (search_one, SEARCH_ONE),
    "search_multi": (search_multi, SEARCH_MULTI),
    "rank_files": (rank_files, RANK_FILES),
    "vocabulary": (vocabulary_terms, VOCABULARY),
    "vocabulary_prefix": (vocabulary_prefix, VOCABULARY_PREFIX),
    "vocabulary_lookup": (vocabulary_lookup, VOCABULARY_LOOKUP),
    "cooccurrence": (cooccurrence, COOCCURRENCE),
    "related_terms": (related_terms, RELATED_TERMS),
    "enriched_terms": (enriched_terms, ENRICHED_TERMS),
    "ranking": (ranking, RANKING),
    "retrieval_metrics": (retrieval_metrics, RETRIEVAL_METRICS),
    "latency_stats": (latency_stats, LATENCY_STATS),
    "compare_reports": (compare_reports, COMPARE_REPORTS),
    "generated_queries": (generated_queries, GENERATED_QUERIES),
    "generated_retrieval": (generated_retrieval, GENERATED_RETRIEVAL),
    "report_gates": (report_gates, REPORT_GATES),
    "report_verdicts": (report_verdicts, REPORT_VERDICTS),
    "sections": (sections_by_language, SECTIONS_BY_LANGUAGE),
    "term_graph": (term_graph, None),
    "shard_plan": (shard_plan, SHARD_PLAN),
    "shard_manifest": (shard_manifest, SHARD_MANIFEST),
    "dataset_manifest": (dataset_manifest, DATASET_MANIFEST),
    "manifest_totals": (manifest_totals, MANIFEST_TOTALS),
    "memory_estimate": (memory_estimate, MEMORY_ESTIMATE),
    "federated_search": (federated_search, FEDERATED_SEARCH),
    "blind_search": (blind_search, BLIND_SEARCH),
    "encryption_round_trip": (encryption_round_trip, ENCRYPTION_ROUND_TRIP),
}
