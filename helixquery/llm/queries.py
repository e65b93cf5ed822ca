"""The operators as queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixquery.llm import decontamination, html_text, jaccard, kneser_ney, line_dedup, merkle, packing, periodic_runs, quality, secrets, sharding, tokens, urls

#: The folder of the public vocabulary files; None: where the package that brings them says.
TOKENIZER_DIR: str | None = None


def tokenizer(name: str) -> str:
    if TOKENIZER_DIR:
        return f"{TOKENIZER_DIR}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.kept_lines(docs, line_dedup.runs_of(docs, batches=4), min_docs=10)
    n_lines, n_kept = F.size("__ld_lines").cast("long"), F.size("__ld_kept").cast("long")
    return out.select("doc_id", n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"), F.sha2(F.array_join("__ld_kept", "\n"), 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    out = docs.select("doc_id", n_bytes.alias("n_bytes"), tokens.token_count(tokenizer("piece_bpe_32k.model"))("text").alias("n_tokens"))
    return out.withColumn("over_limit", tokens.over_limit(F.col("n_tokens"), 4096))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", secrets.secrets("text").alias("s")).select("doc_id", "s.*")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and an item that leaks into it."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "pages").select("page_id", "url", html_text.extracted("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = lambda body: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), body)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, fields(F.translate("text", line_dedup.UPPER, line_dedup.LOWER)))
    leaves = docs.select("doc_id", "lang", fields(F.col("text")).alias("leaf"), tampered.alias("tampered"))
    out = merkle.manifest(leaves, "lang", "doc_id")
    out = out.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place where op13's contract makes a document periodic; None elsewhere."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), order=planted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_ngram_jaccard_join,
        op2_quality_rules,
        op3_line_dedup,
        op4_token_counts,
        op5_secret_scans,
        op6_url_filters,
        op7_quality_classifier,
        op8_sharding,
        op9_benchmark_decontamination,
        op10_best_fit_packing,
        op11_html_extraction,
        op12_merkle_manifest,
        op13_periodic_runs,
    ]
    return {f.__name__: f for f in named}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{line_dedup.UPPER}', '{line_dedup.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, sh FROM (SELECT rid, unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: w[i:i + 2])) AS sh FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
g AS (SELECT min(rid) AS gid, list(rid) AS rids FROM (SELECT rid, list(sh ORDER BY sh) AS k FROM s GROUP BY rid) GROUP BY k),
r AS (SELECT s.rid, sh, n FROM s JOIN g ON rid = gid JOIN n USING (rid)),
p AS (SELECT x.rid AS a, y.rid AS b, count(*) AS i, any_value(x.n + y.n) AS t FROM r x JOIN r y ON x.sh = y.sh AND x.rid <> y.rid GROUP BY x.rid, y.rid),
l AS (SELECT a, b FROM p WHERE 100 * i >= 90 * (t - i)),
reach AS (SELECT gid AS a, gid AS b FROM g UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
ids AS (SELECT gid, min(doc_id) AS least_id FROM (SELECT gid, unnest(rids) AS rid FROM g) JOIN d USING (rid) GROUP BY gid),
c AS (SELECT a AS gid, min(least_id) AS component_id FROM reach JOIN ids ON b = ids.gid GROUP BY a),
m AS (SELECT unnest(rids) AS rid, component_id, least_id FROM g JOIN c USING (gid) JOIN ids USING (gid))
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id,
       CASE WHEN n > 0 THEN least_id ELSE doc_id END AS class_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {WORDS} AS w,
                  string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
win AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(lines) AS line FROM d)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
s AS (SELECT d.rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words AS symbols,
             n_dup_lines >= 5 AND 20 * n_dup_lines > n_words AS lines, word_chars < 2 * n_words OR word_chars > 15 * n_words AS length FROM s),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed OR symbols OR lines OR length) AS DOUBLE) AS f_any,
             CAST(count(*) FILTER (WHERE symbols) AS DOUBLE) AS f_symbols, CAST(count(*) FILTER (WHERE lines) AS DOUBLE) AS f_lines,
             CAST(count(*) FILTER (WHERE length) AS DOUBLE) AS f_length FROM f GROUP BY source),
r AS (SELECT source, n, unnest(['any', 'symbols', 'lines', 'length']) AS rule, unnest([f_any, f_symbols, f_lines, f_length]) AS x FROM h),
m AS (SELECT rule, avg(x / n) AS m, avg(x / n) * (1 - avg(x / n)) AS mm, coalesce(var_samp(x / n), 0) - avg(x / n) * (1 - avg(x / n)) * avg(1 / n) AS v FROM r GROUP BY rule),
k AS (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(mm / v - 1, 1), 1000) ELSE 1000 END AS s FROM m),
p AS (SELECT rule, CASE WHEN m <= 0 OR m >= 1 THEN 0.5 + m * 0.5 ELSE m * s END AS a, CASE WHEN m <= 0 OR m >= 1 THEN 1 - m * 0.5 ELSE (1 - m) * s END AS b FROM k),
v AS (SELECT source, max((x + a) / (n + a + b)) FILTER (WHERE rule = 'any') AS rate_any, max((x + a) / (n + a + b)) FILTER (WHERE rule = 'symbols') AS rate_symbols,
             max((x + a) / (n + a + b)) FILTER (WHERE rule = 'lines') AS rate_lines, max((x + a) / (n + a + b)) FILTER (WHERE rule = 'length') AS rate_length
      FROM r JOIN p USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR rate_any > {quality.HOST_LIMIT} OR (symbols AND rate_symbols > {quality.TRUSTED}) OR (lines AND rate_lines > {quality.TRUSTED})
            OR (length AND rate_length > {quality.TRUSTED})) AS kept, f.source AS host, round(rate_any, 9) AS host_rate
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
KEY = f"translate(trim(line, {BLANKS}), '{line_dedup.UPPER}', '{line_dedup.LOWER}')"

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, i, line, {KEY} AS key FROM (SELECT rid, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d)),
hot AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
k AS (SELECT rid, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM l WHERE key NOT IN (SELECT key FROM hot) GROUP BY rid)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(k.n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""


_LOWER_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')"


def _runs(key: str, source: str, k: int, where: str) -> str:
    """Places of all runs of k words."""
    return f"(SELECT {key}, p, w[p:p + {k - 1}] AS seed FROM (SELECT {key}, w, unnest(range(1, len(w) - {k - 2})) AS p FROM {source} WHERE {where}))"


#: Seeds of its own: three words in a row (one, for items under eight words) stand in every leak.
OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWER_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_LOWER_WORDS} AS w FROM benchmark),
hits AS (SELECT DISTINCT rid, item_id, x.p - y.p AS shift FROM {_runs("rid", "d", 3, "len(w) >= 3")} x JOIN {_runs("item_id", "b", 3, "len(w) >= 8")} y USING (seed)
   UNION SELECT DISTINCT rid, item_id, x.p - y.p AS shift FROM {_runs("rid", "d", 1, "len(w) > 0")} x JOIN {_runs("item_id", "b", 1, "len(w) BETWEEN 1 AND 7")} y USING (seed)),
e AS (SELECT doc_id, item_id, least({decontamination.WINDOW}, len(b.w)) AS width,
             list_transform(range(greatest(0, -shift), least(len(b.w), len(d.w) - shift)), lambda j: (d.w[j + shift + 1] = b.w[j + 1])::INTEGER) AS eq FROM hits JOIN d USING (rid) JOIN b USING (item_id)),
a AS (SELECT doc_id, item_id, width, list_max(list_transform(range(1, len(eq) - width + 2), lambda k: list_sum(eq[k:k + width - 1]))) AS agreeing FROM e WHERE len(eq) >= width)
SELECT doc_id, item_id, CAST(max(agreeing) AS INTEGER) AS agreeing FROM a WHERE agreeing >= {decontamination.AGREE} * width GROUP BY doc_id, item_id
"""


#: The unsigned crc32 of a decimal number's digits.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT)), "
    "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"
)


def _leaf(body: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')" for x in ("doc_id", "source", "lang", "n_chars", body)) + ")"


def _siblings(of: str) -> str:
    """The joined nodes before and after each in its run."""
    side = lambda frame: f"coalesce(string_agg(node, '') OVER (PARTITION BY {of} ORDER BY pos ROWS BETWEEN {frame}), '')"
    return f"{side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r"


OP12 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, lang, {_leaf("text")} AS leaf,
  CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{line_dedup.UPPER}', '{line_dedup.LOWER}')")} END AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT lang, 0 AS lev, pos, n, leaf AS node FROM p
  UNION ALL SELECT lang, lev + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, lev, pos // 8),
s AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
r AS (SELECT 0 AS lev, pos, n, subroot AS node FROM s
  UNION ALL SELECT lev + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(node, '' ORDER BY pos)) FROM r WHERE n > 1 GROUP BY lev, pos // 8),
w AS (SELECT lang, lev, pos, n, {_siblings("lang, lev, pos // 8")} FROM t),
v AS (SELECT lev, pos, n, {_siblings("lev, pos // 8")} FROM r),
x AS (SELECT rid, w.lev, l, r FROM p JOIN w ON p.lang IS NOT DISTINCT FROM w.lang AND p.pos // (8 ** w.lev)::BIGINT = w.pos WHERE w.n > 1
  UNION ALL SELECT rid, 100 + v.lev, l, r FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN v ON s.pos // (8 ** v.lev)::BIGINT = v.pos WHERE v.n > 1),
path AS (SELECT rid, list({{'l': l, 'r': r}} ORDER BY lev) AS path, string_agg(l || r, '' ORDER BY lev) AS proof FROM x GROUP BY rid),
f AS (SELECT rid, 0 AS k, coalesce(tampered, leaf) AS node, path FROM p LEFT JOIN path USING (rid)
  UNION ALL SELECT rid, k + 1, sha256(path[k + 1].l || node || path[k + 1].r), path FROM f WHERE k < len(path)),
top AS (SELECT node AS root FROM r WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
FROM p LEFT JOIN path USING (rid) JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN f ON f.rid = p.rid AND f.k = coalesce(len(f.path), 0) CROSS JOIN top
"""

#: All pairs of equal words of a document, half of it apart at most.
OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w0, {_CRC} AS h FROM documents),
g AS (SELECT *, len(w0) AS n, h // 10 AS g FROM d),
e AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
p AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_transform(range(n), lambda i: list_extract(w0, CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1)) END AS w FROM e),
o AS (SELECT rid, n, i, w[i + 1] AS x FROM (SELECT rid, n, w, unnest(range(n)) AS i FROM p)),
m AS (SELECT a.rid, a.n, b.i - a.i AS q, a.i FROM o a JOIN o b ON a.rid = b.rid AND a.x = b.x AND b.i > a.i AND 2 * (b.i - a.i) <= a.n),
s AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS part FROM m)
  GROUP BY rid, q, part HAVING count(*) >= greatest(q, {periodic_runs.LEAST} - q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.rid = s.rid AND y.q < s.q AND y.start <= s.start AND y.start + y.length >= s.start + s.length)),
l AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS t, min(struct_pack(a := -length, b := start, c := q)) AS best FROM r GROUP BY rid),
k AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS t FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = o.rid AND o.i >= r.start + r.q AND o.i < r.start + r.length) GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.b AS BIGINT) AS start, CAST(-best.a AS BIGINT) AS length, CAST(best.c AS BIGINT) AS period,
       CAST(1000 * -best.a // best.c AS BIGINT) AS exponent_milli, sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM p LEFT JOIN l USING (rid) LEFT JOIN k USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1, "op2_quality_rules": OP2, "op3_line_dedup": OP3, "op9_benchmark_decontamination": OP9, "op12_merkle_manifest": OP12, "op13_periodic_runs": OP13}
