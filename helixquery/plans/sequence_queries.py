"""Queries of sequences: primitives, k-mers, approximate matches, membership, intervals and scores.

The documents' letters stand for bases (plans.views.genome); the benchmark's items give guides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixquery import storage
from helixquery.functions import codes as C
from helixquery.functions import sequences as S
from helixquery.operators import intervals, kmers, membership, offtarget, scoring
from helixquery.plans import views as V

K = 23


def normalised_dna(spark: SparkSession, d: str) -> DataFrame:
    s = S.normalised(F.col("text"))
    return V.documents(spark, d).select("doc_id", F.explode(F.array(s)).alias("seq")).select("doc_id", F.length("seq").cast("long").alias("bases"), F.md5("seq").alias("md5"))


NORMALISED_DNA = """WITH l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE trim(line) <> '' AND NOT regexp_matches(trim(line), '^[>;]')),
s AS (SELECT doc_id, translate(regexp_replace(translate(string_agg(line, '' ORDER BY i), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGTNURYSWKMBDHV]', '', 'g'), 'URYSWKMBDHV', 'TNNNNNNNNNN') AS seq FROM l GROUP BY doc_id)
SELECT doc_id, length(coalesce(seq, '')) AS bases, md5(coalesce(seq, '')) AS md5 FROM documents LEFT JOIN s USING (doc_id)"""


def guide_primitives(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("guide")
    k23 = F.left("seq", F.lit(K))
    out = V.guides(spark, d).select("item_id", "guide", S.reverse_complement(g).alias("rc"), S.packed(g).alias("packed"), S.pam(k23).alias("pam"), S.is_tttv(k23, S.pam(k23)).alias("tttv"), *(S.longest_run(g, b).alias(f"run_{b.lower()}") for b in "ACGT"))
    return out.withColumn("unpacked", S.unpacked(F.col("packed"), 20))


def _run(b: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all(guide, '{b}+'), lambda x: length(x))), 0)::INTEGER AS run_{b.lower()}"


GUIDE_PRIMITIVES = f"""WITH {V.GUIDES}, k AS (SELECT *, left(seq, 23) AS k23, {V.PAM("left(seq, 23)")} AS pam FROM guides)
SELECT item_id, guide, {V.RC("guide")} AS rc, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(guide, ''), lambda c: (instr('ACGT', c) - 1)::BIGINT)), lambda a, b: a * 4 + b) AS packed,
       pam, pam = 'TTTN' AND substr(k23, 4, 1) <> 'T' AS tttv, {", ".join(_run(b) for b in "ACGT")}, guide AS unpacked FROM k"""


def guide_distances(spark: SparkSession, d: str) -> DataFrame:
    """Each item's guide against the next item's."""
    a = V.guides(spark, d).select("item_id", "guide")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("guide").alias("other"))
    both = a.join(b, "item_id").where((F.length("guide") == 20) & (F.length("other") == 20))
    return both.select("item_id", S.hamming(S.packed(F.col("guide")), S.packed(F.col("other"))).cast("long").alias("distance"), F.array_join(S.mismatch_positions(F.col("guide"), F.col("other"), 20), ";").alias("mm_positions"))


GUIDE_DISTANCES = f"""WITH {V.GUIDES}, p AS (SELECT a.item_id, a.guide, b.guide AS other FROM guides a JOIN guides b ON b.item_id = a.item_id + 1 WHERE length(a.guide) = 20 AND length(b.guide) = 20)
SELECT item_id, hamming(guide, other) AS distance, array_to_string(list_filter(range(0, 20), lambda i: guide[i + 1] <> other[i + 1]), ';') AS mm_positions FROM p"""


_COUNTED = f"""{V.GENOME}, {V.windows_sql(K)},
c AS (SELECT kmer, count(*) AS occurrences, min((doc_id, pos)) AS f FROM w GROUP BY kmer)"""


def kmer_targets(spark: SparkSession, d: str) -> DataFrame:
    return kmers.top_targets(V.genome(spark, d), "doc_id", "seq", K, 10_000)


_TOP = f"t AS (SELECT *, {V.PAM('kmer')} AS pam FROM c ORDER BY occurrences DESC, kmer LIMIT 10000)"
KMER_TARGETS = f"WITH {_COUNTED}, {_TOP} SELECT kmer, occurrences, f[1] AS first_record, f[2] AS first_pos, pam FROM t"


def pam_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return kmer_targets(spark, d).groupBy("pam").agg(F.count(F.lit(1)).alias("n"))


PAM_BREAKDOWN = f"WITH {_COUNTED}, {_TOP} SELECT pam, count(*) AS n FROM t GROUP BY pam"


def distinct_share(spark: SparkSession, d: str) -> DataFrame:
    return kmers.distinct_share(kmers.distinct_kmers(V.genome(spark, d), "doc_id", "seq", K), 10_000)


DISTINCT_SHARE = f"WITH {_COUNTED} SELECT count(*) AS distinct_kmers, round(least(100.0, 100.0 * 10000 / count(*)), 1)::DOUBLE AS top_share FROM c"


def recount(spark: SparkSession, d: str) -> DataFrame:
    wanted = V.guides(spark, d).select(F.left("seq", F.lit(K)).alias("kmer")).where(F.length("kmer") == K)
    return kmers.recount(V.genome(spark, d), "doc_id", "seq", wanted, K)


RECOUNT = f"""WITH {_COUNTED}, {V.GUIDES}, k AS (SELECT DISTINCT left(seq, 23) AS kmer FROM guides WHERE length(seq) >= 23)
SELECT kmer, coalesce(occurrences, 0) AS occurrences, f[1] AS first_record, f[2] AS first_pos, f[2] AS first_base, {V.PAM("kmer")} AS pam FROM k LEFT JOIN c USING (kmer)"""


def off_targets(spark: SparkSession, d: str) -> DataFrame:
    guides = offtarget.valid_guides(V.guides(spark, d), "guide")
    found = offtarget.off_targets(V.genome(spark, d), "doc_id", "seq", guides, 3)
    return found.withColumn("mm_positions", F.array_join("mm_positions", ";")).withColumn("mismatches", F.col("mismatches").cast("long"))


OFF_TARGETS = f"""WITH {V.GENOME}, {V.windows_sql(20)}, {V.GUIDES},
p AS (SELECT DISTINCT guide, '+' AS strand, guide AS probe FROM guides WHERE length(guide) = 20 UNION ALL SELECT DISTINCT guide, '-', {V.RC("guide")} FROM guides WHERE length(guide) = 20),
s AS (SELECT *, unnest([0, 5, 10, 15]) AS o FROM p), x AS (SELECT DISTINCT guide, strand, probe, doc_id, pos, kmer FROM w JOIN s ON substr(kmer, o + 1, 5) = substr(probe, o + 1, 5))
SELECT guide, strand, doc_id, pos, hamming(kmer, probe) AS mismatches, array_to_string(list_filter(range(0, 20), lambda i: kmer[i + 1] <> probe[i + 1]), ';') AS mm_positions
FROM x WHERE hamming(kmer, probe) <= 3"""


def prepared_guides(spark: SparkSession, d: str) -> DataFrame:
    """The first two bases of each document around eighteen fixed ones, so that guides repeat: the first 500, then each once."""
    g = V.genome(spark, d).select("doc_id", F.concat(F.left("seq", F.lit(1)), F.lit("ACGTACGTACGTACGTAC"), F.substr("seq", F.lit(2), F.lit(1))).alias("seq"))
    return offtarget.prepared_guides(g, "seq", "doc_id", 500)


PREPARED_GUIDES = f"""WITH {V.GENOME}, g AS (SELECT doc_id, left(seq, 1) || 'ACGTACGTACGTACGTAC' || substr(seq, 2, 1) AS guide FROM genome ORDER BY doc_id LIMIT 500),
f AS (SELECT guide, min(doc_id) AS at0 FROM g GROUP BY guide)
SELECT guide, row_number() OVER (ORDER BY at0) - 1 AS idx, regexp_full_match(guide, '[ACGT]{{20}}') AS valid FROM f"""


def novelty(spark: SparkSession, d: str) -> DataFrame:
    g = V.guides(spark, d)
    published = g.where("item_id % 2 = 1").select(F.col("item_id").alias("published_id"), F.substr("seq", F.lit(3), (F.lit(18) + F.col("item_id") % 13).cast("int")).alias("seq"))
    return offtarget.novelty(g.where("item_id % 2 = 0").select(F.col("guide").alias("target")), published, 3).withColumn("distance", F.col("distance").cast("long"))


NOVELTY = f"""WITH {V.GUIDES}, t AS (SELECT DISTINCT guide AS target FROM guides WHERE item_id % 2 = 0),
p AS (SELECT item_id, '+' AS strand, substr(seq, 3, 18 + item_id % 13) AS s FROM guides WHERE item_id % 2 = 1), q AS (SELECT * FROM p UNION ALL SELECT item_id, '-', {V.RC("s")} FROM p),
m AS (SELECT target, item_id, strand, hamming(left(target, least(length(target), length(s))), left(s, least(length(target), length(s)))) + abs(length(target) - length(s)) AS d FROM t, q)
SELECT target, CAST(d AS BIGINT) AS distance, item_id AS closest, strand, d > 3 AS is_novel FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY d, item_id, strand) AS r FROM m) WHERE r = 1"""


def conservation(spark: SparkSession, d: str) -> DataFrame:
    guides = V.guides(spark, d).select(F.col("item_id").alias("guide_id"), F.col("guide").alias("sequence"))
    return membership.conservation(V.genome(spark, d), "doc_id", "seq", guides)


CONSERVATION = f"""WITH {V.GENOME}, {V.GUIDES}, n AS (SELECT count(*) AS total FROM genome WHERE seq <> ''),
h AS (SELECT item_id, count(*) AS hits FROM guides JOIN genome ON contains(genome.seq, guide) OR contains(genome.seq, {V.RC("guide")}) GROUP BY item_id)
SELECT item_id AS guide_id, guide AS sequence, coalesce(hits, 0) AS hits, total, round(100.0 * coalesce(hits, 0) / total, 2)::DOUBLE AS conservation_pct FROM guides LEFT JOIN h USING (item_id), n"""


def cross_reactivity(spark: SparkSession, d: str, pam: str = "NGG") -> DataFrame:
    """Languages as pathogens, sources as hosts."""
    g = V.genome(spark, d)
    counted = kmers.top_by_group(g, "lang", "seq", K, 100, C.of_pam(pam, K)).withColumnRenamed("lang", "pathogen").withColumn("pam", S.pam(F.col("kmer")))
    return membership.cross_reactivity(counted, g, "source", "seq", 100, pam)


def _reactivity(kind: str) -> str:
    return f"""{V.GENOME}, {V.windows_sql(K)}, c AS (SELECT lang, kmer, count(*) AS n FROM w WHERE {kind} GROUP BY lang, kmer),
t AS (SELECT DISTINCT kmer FROM (SELECT kmer, row_number() OVER (PARTITION BY lang ORDER BY n DESC, kmer) AS r FROM c) WHERE r <= 100),
p AS (SELECT DISTINCT kmer, probe FROM (SELECT kmer, kmer AS probe FROM t UNION ALL SELECT kmer, {V.RC("kmer")} FROM t)),
h AS (SELECT p.kmer, source, count(*) AS hits FROM w JOIN p ON w.kmer = probe GROUP BY p.kmer, source),
x AS (SELECT kmer, source, hits, CAST(coalesce(sum(hits) OVER (PARTITION BY kmer), 0) AS BIGINT) AS total_host_hits FROM t LEFT JOIN h USING (kmer))"""


CROSS_REACTIVITY = f"WITH {_reactivity("kmer LIKE '%GG'")} SELECT *, total_host_hits = 0 AS specific FROM x"


def host_summary(spark: SparkSession, d: str) -> DataFrame:
    """Hosts' clean shares for targets of the second kind (TTTV)."""
    found = storage.stored(cross_reactivity(spark, d, "TTTV"), "reactivity")
    return membership.host_summary(found, V.genome(spark, d), "source")


HOST_SUMMARY = f"""WITH {_reactivity("kmer LIKE 'TTT%' AND kmer NOT LIKE '%GG' AND kmer[4] <> 'T'")}, n AS (SELECT count(DISTINCT kmer) AS guides FROM x),
s AS (SELECT source, count(hits) AS hit_guides, CAST(coalesce(sum(hits), 0) AS BIGINT) AS hits FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) LEFT JOIN x USING (source) GROUP BY source
  UNION ALL SELECT NULL, count(*) FILTER (WHERE t > 0), CAST(coalesce(sum(t), 0) AS BIGINT) FROM (SELECT kmer, max(total_host_hits) AS t FROM x GROUP BY kmer))
SELECT source, guides, hit_guides, hits, CASE WHEN guides > 0 THEN round(100.0 * (guides - hit_guides) / guides, 1)::DOUBLE ELSE 0 END AS clean_pct FROM s, n"""


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """The top k-mers by place: doc_id, pos, kmer, pam, occurrences. At most 10,000 rows, written for the queries' several uses."""
    t = storage.stored(kmer_targets(spark, d), "targets")
    return t.select(F.col("first_record").alias("doc_id"), F.col("first_pos").alias("pos"), "kmer", "pam", "occurrences")


_TARGETS = f"{_COUNTED}, {_TOP}, targets AS (SELECT f[1] AS doc_id, f[2] AS pos, kmer, pam, occurrences FROM t)"


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Four regions per document by rule; every fourth is circular."""
    g = V.documents(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("no"))
    start = (F.col("no") * 150 + F.col("doc_id") % 50).cast("long")
    return g.select("doc_id", F.col("no").cast("long").alias("no"), F.when(F.col("no") == 3, start + 200).otherwise(start).alias("start"), F.when(F.col("no") == 3, start - 400).otherwise(start + 60).alias("end"))


_REGIONS = """regions AS (SELECT doc_id, no, CASE WHEN no = 3 THEN s + 200 ELSE s END AS start, CASE WHEN no = 3 THEN s - 400 ELSE s + 60 END AS "end"
FROM (SELECT doc_id, no, no * 150 + doc_id % 50 AS s FROM (SELECT doc_id, unnest(range(0, 4)) AS no FROM documents)))"""
_INSIDE = """CASE WHEN r."end" < r.start THEN t.pos >= r.start OR t.pos + 23 <= r."end" ELSE t.pos < r."end" AND t.pos + 23 > r.start END"""


def resistance_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Targets per region: all, those with NGG, and the five most frequent (of NGG if there are any)."""
    found = intervals.overlaps(_targets(spark, d), _regions(spark, d), K, ["doc_id"])
    n = found.groupBy("doc_id", "no").agg(F.count(F.lit(1)).alias("guides"), F.count_if(F.col("pam") == "NGG").alias("ngg_guides"))
    ngg = found.join(n, ["doc_id", "no"]).where((F.col("ngg_guides") == 0) | (F.col("pam") == "NGG"))
    top = kmers.top_per_group(ngg.withColumn("key", F.struct("doc_id", "no")), "key", [F.desc("occurrences"), "kmer"], 5)
    best = top.groupBy("doc_id", "no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "kmer"))), lambda x: x.kmer), ";").alias("top"))
    return n.join(best, ["doc_id", "no"])


RESISTANCE_OVERLAP = f"""WITH {_TARGETS}, {_REGIONS}, o AS (SELECT t.doc_id, r.no, t.kmer, t.pam, t.occurrences FROM targets t JOIN regions r ON t.doc_id = r.doc_id AND {_INSIDE}),
n AS (SELECT doc_id, no, count(*) AS guides, count(*) FILTER (WHERE pam = 'NGG') AS ngg_guides FROM o GROUP BY doc_id, no),
k AS (SELECT o.*, row_number() OVER (PARTITION BY doc_id, no ORDER BY occurrences DESC, kmer) AS r FROM o JOIN n USING (doc_id, no) WHERE ngg_guides = 0 OR pam = 'NGG')
SELECT doc_id, no, guides, ngg_guides, string_agg(kmer, ';' ORDER BY r) AS top FROM k JOIN n USING (doc_id, no) WHERE r <= 5 GROUP BY ALL"""


def gene_annotation(spark: SparkSession, d: str) -> DataFrame:
    """The region with the latest start at or before a target, if the target's start lies in it; places behind all regions by their remainder."""
    genes = _regions(spark, d).where("no < 3").withColumn("end", F.col("start") + 100).withColumn("gene", F.concat(F.lit("g"), "no"))
    places = _targets(spark, d).select("doc_id", "pos", F.col("kmer").alias("key"))
    return intervals.latest_start(places, genes, "doc_id", ["gene"], wrap=True)


_ANNOTATED = f"""{_TARGETS}, {_REGIONS}, g AS (SELECT doc_id, start, start + 100 AS "end", 'g' || no AS gene FROM regions WHERE no < 3 AND start > 0),
turn AS (SELECT doc_id, max("end") AS turn FROM g GROUP BY doc_id), places AS (SELECT doc_id, pos, kmer, CASE WHEN pos > turn THEN pos % turn ELSE pos END AS probe FROM targets LEFT JOIN turn USING (doc_id)),
annotated AS (SELECT t.doc_id, t.pos, t.kmer AS key, CASE WHEN t.probe <= g."end" THEN g.gene END AS gene FROM places t ASOF LEFT JOIN g ON t.doc_id = g.doc_id AND t.probe >= g.start)"""
GENE_ANNOTATION = f"WITH {_ANNOTATED} SELECT * FROM annotated"


def annotation_counts(spark: SparkSession, d: str) -> DataFrame:
    return intervals.annotation_counts(gene_annotation(spark, d), "doc_id", "gene")


ANNOTATION_COUNTS = f"WITH {_ANNOTATED} SELECT doc_id, count(gene) AS annotated, count(*) AS total FROM annotated GROUP BY doc_id"


def exclude_overlap(spark: SparkSession, d: str) -> DataFrame:
    return intervals.without_overlap(_targets(spark, d), _regions(spark, d).where("no < 3"), K, ["doc_id", "pos"], ["doc_id"]).select("doc_id", "pos", "kmer")


EXCLUDE_OVERLAP = f"WITH {_TARGETS}, {_REGIONS} SELECT doc_id, pos, kmer FROM targets t WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE no < 3 AND t.doc_id = r.doc_id AND {_INSIDE})"


def merged_regions(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merged(_targets(spark, d), "doc_id", K)


MERGED_REGIONS = f"""WITH {_TARGETS}, a AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 23 THEN 0 ELSE 1 END AS x FROM (SELECT DISTINCT doc_id, pos FROM targets)),
b AS (SELECT doc_id, pos, sum(x) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM a)
SELECT doc_id, min(pos) AS region_start, max(pos) + 23 AS region_end, count(*) AS window_count FROM b GROUP BY doc_id, run"""


def variant_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Variants by rule on the documents; their frequency from the document's number."""
    guides = _targets(spark, d).select("doc_id", "pos", (0.9 + F.col("pos") % 10 / 100).alias("conservation"))
    variants = V.documents(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("no")).select("doc_id", (F.col("no") * 37 + F.col("doc_id") % 11).cast("long").alias("at"), ((F.col("doc_id") + F.col("no")) % 40 / 100).alias("freq"))
    return intervals.variant_tolerance(guides, variants, K, ["doc_id"])


VARIANT_TOLERANCE = f"""WITH {_TARGETS}, g AS (SELECT doc_id, pos, 0.9::DOUBLE + (pos % 10)::DOUBLE / 100 AS conservation FROM targets),
v AS (SELECT doc_id, no * 37 + doc_id % 11 AS place, ((doc_id + no) % 40)::DOUBLE / 100 AS freq FROM (SELECT doc_id, unnest(range(0, 61)) AS no FROM documents)),
s AS (SELECT g.doc_id, g.pos, count(*) FILTER (WHERE place - pos < 12) AS sv, count(*) FILTER (WHERE place - pos >= 12) AS dv, max(freq) FILTER (WHERE place - pos < 12) AS fs, max(freq) FILTER (WHERE place - pos >= 12) AS fd
      FROM g JOIN v ON g.doc_id = v.doc_id AND place >= pos AND place < pos + 23 GROUP BY g.doc_id, g.pos)
SELECT doc_id, pos, conservation, coalesce(sv, 0) AS seed_variants, coalesce(dv, 0) AS distal_variants,
       round_even(CASE WHEN sv > 0 THEN 1 - fs WHEN dv > 0 THEN conservation + (1 - conservation) * fd ELSE conservation END, 4) AS tolerant FROM g LEFT JOIN s USING (doc_id, pos)"""


def guide_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.guide_scores(kmer_targets(spark, d).select("kmer", "pam"), "kmer", "pam")


_SCORES = f"""{_COUNTED}, {_TOP}, sp AS (SELECT kmer, pam, CASE WHEN pam = 'TTTN' THEN substr(kmer, 4) ELSE left(kmer, 20) END AS s FROM t),
sq AS (SELECT *, {V.RC("s")} AS rc, length(regexp_replace(s, '[^GC]', '', 'g')) / 20.0::DOUBLE AS gc, length(regexp_replace(right(s, 12), '[^GC]', '', 'g')) / 12.0::DOUBLE AS seed,
   greatest({", ".join(f"coalesce(list_max(list_transform(regexp_extract_all(s, '{b}+'), lambda x: length(x))), 0)" for b in "ACGT")}) AS homo FROM sp),
sr AS (SELECT *, list_max(list_transform(range(4, 16), lambda o: len(list_filter(range(1, 21 - o), lambda i: s[i] = rc[i + o])))) / 20.0::DOUBLE AS comp FROM sq),
scores AS (SELECT kmer, pam, round_even(gc * 100, 1) AS gc, round_even(seed * 100, 1) AS seed_gc, contains(s, 'TTTT') AS poly_t, homo::INTEGER AS max_homopolymer, round_even(comp, 3) AS self_comp,
  round_even(((CASE WHEN gc BETWEEN 0.4::DOUBLE AND 0.7::DOUBLE THEN 1.0 WHEN gc BETWEEN 0.3::DOUBLE AND 0.8::DOUBLE THEN 0.6 WHEN gc BETWEEN 0.2::DOUBLE AND 0.9::DOUBLE THEN 0.3 ELSE 0.1 END)::DOUBLE * 0.25::DOUBLE
  + (CASE WHEN seed BETWEEN 0.3::DOUBLE AND 0.7::DOUBLE THEN 1.0 WHEN seed BETWEEN 0.2::DOUBLE AND 0.8::DOUBLE THEN 0.5 ELSE 0.2 END)::DOUBLE * 0.15::DOUBLE
  + (CASE WHEN contains(s, 'TTTT') THEN 0.2 ELSE 1.0 END)::DOUBLE * 0.2::DOUBLE + (CASE WHEN homo <= 3 THEN 1.0 WHEN homo = 4 THEN 0.5 ELSE 0.1 END)::DOUBLE * 0.15::DOUBLE
  + greatest(0.0::DOUBLE, 1.0::DOUBLE - comp * 3) * 0.1::DOUBLE + (CASE WHEN pam = 'NGG' THEN 1.0 ELSE 0.7 END)::DOUBLE * 0.15::DOUBLE) * 100, 0)::INTEGER AS score FROM sr)"""
GUIDE_SCORES = f"WITH {_SCORES} SELECT * FROM scores"


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_summary(guide_scores(spark, d))


SCORE_SUMMARY = f"WITH {_SCORES} SELECT count(*) AS n, round(avg(score), 4) AS mean_score, round(avg((score >= 70)::INTEGER), 6) AS good_share FROM scores"


def melting_temperature(spark: SparkSession, d: str) -> DataFrame:
    g = V.guides(spark, d).where(F.length("guide") == 20)
    return g.select("item_id", S.melting_temperature(F.col("guide")).alias("tm"), S.self_complementary_run(F.col("guide"), 20).cast("long").alias("self_run"))


def _map(t: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {float(v)}::DOUBLE" for k, v in t.items()) + "}"


MELTING_TEMPERATURE = f"""WITH {V.GUIDES}, s AS (SELECT item_id, guide AS g, {V.RC("guide")} AS rc, list_transform(range(1, 20), lambda i: substr(guide, i, 2)) AS pairs FROM guides WHERE length(guide) = 20),
x AS (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, list_transform(pairs, lambda p: ({_map(S.NN_DH)})[p])), lambda a, b: a + b) AS h, list_reduce(list_prepend(0.0::DOUBLE, list_transform(pairs, lambda p: ({_map(S.NN_DS)})[p])), lambda a, b: a + b) AS e FROM s)
SELECT item_id, round_even((({_map(S.INIT_DH)})[left(g, 1)] + ({_map(S.INIT_DH)})[right(g, 1)] + h) / ((({_map(S.INIT_DS)})[left(g, 1)] + ({_map(S.INIT_DS)})[right(g, 1)] + e) + 0.368::DOUBLE * 19 * ln(0.05::DOUBLE)
       + 1.987::DOUBLE * ln(CASE WHEN g = rc THEN 250e-9::DOUBLE ELSE 62.5e-9::DOUBLE END)) - 273.15::DOUBLE, 1) AS tm,
       CAST(list_max(list_transform(range(-19, 20), lambda o: coalesce(list_max(list_transform(regexp_extract_all(array_to_string(list_transform(range(greatest(0, o), least(20, 20 + o)), lambda i: CASE WHEN g[i + 1] = rc[i - o + 1] THEN '1' ELSE '0' END), ''), '1+'), lambda r: length(r))), 0))) AS BIGINT) AS self_run FROM x"""


def guide_mining(spark: SparkSession, d: str) -> DataFrame:
    """Runs of 18 to 30 bases in texts whose words are read as bases, with two or more of each, and where they first stand.
    A run ends where no letter (accented ones are letters), digit or underscore follows."""
    words = F.translate(F.lower("text"), S.LETTERS, S.AS_BASES)
    runs = V.documents(spark, d).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(words, F.lit(r"(?<![\p{L}\p{N}_])([ACGTU]{18,30})(?![\p{L}\p{N}_])"), F.lit(1)))).alias("run"))
    good = runs.where(" AND ".join(f"length(run) - length(replace(run, '{b}', '')) >= 2" for b in "ACGT") + " AND NOT startswith(run, 'AGATCGGAAG')")
    return good.groupBy("run").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("docs"))


GUIDE_MINING = f"""WITH r AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(translate(lower(text), '{S.LETTERS}', '{S.AS_BASES}'), '[^\\p{{L}}\\p{{N}}_]+')) AS run FROM documents)
SELECT run, min(doc_id) AS first_doc, count(*) AS docs FROM r WHERE regexp_full_match(run, '[ACGTU]{{18,30}}') AND {" AND ".join(f"length(run) - length(replace(run, '{b}', '')) >= 2" for b in "ACGT")} AND NOT starts_with(run, 'AGATCGGAAG') GROUP BY run"""

QUERIES = {
    "normalised_dna": (normalised_dna, NORMALISED_DNA),
    "guide_primitives": (guide_primitives, GUIDE_PRIMITIVES),
    "guide_distances": (guide_distances, GUIDE_DISTANCES),
    "kmer_targets": (kmer_targets, KMER_TARGETS),
    "pam_breakdown": (pam_breakdown, PAM_BREAKDOWN),
    "distinct_share": (distinct_share, DISTINCT_SHARE),
    "recount": (recount, RECOUNT),
    "off_targets": (off_targets, OFF_TARGETS),
    "prepared_guides": (prepared_guides, PREPARED_GUIDES),
    "novelty": (novelty, NOVELTY),
    "conservation": (conservation, CONSERVATION),
    "cross_reactivity": (cross_reactivity, CROSS_REACTIVITY),
    "host_summary": (host_summary, HOST_SUMMARY),
    "resistance_overlap": (resistance_overlap, RESISTANCE_OVERLAP),
    "gene_annotation": (gene_annotation, GENE_ANNOTATION),
    "annotation_counts": (annotation_counts, ANNOTATION_COUNTS),
    "exclude_overlap": (exclude_overlap, EXCLUDE_OVERLAP),
    "merged_regions": (merged_regions, MERGED_REGIONS),
    "variant_tolerance": (variant_tolerance, VARIANT_TOLERANCE),
    "guide_scores": (guide_scores, GUIDE_SCORES),
    "score_summary": (score_summary, SCORE_SUMMARY),
    "melting_temperature": (melting_temperature, MELTING_TEMPERATURE),
    "guide_mining": (guide_mining, GUIDE_MINING),
}
