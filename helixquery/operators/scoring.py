"""Guide, priority and retrieval scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixquery.functions import sequences as S
from helixquery.storage import stored


def spacer(kmer: Column, pam: Column) -> Column:
    after = F.when(F.length(kmer) >= 24, F.substr(kmer, F.lit(5), F.lit(20))).otherwise(F.substr(kmer, F.lit(4)))
    return F.when(pam == "TTTN", after).otherwise(F.left(kmer, F.lit(20)))


def self_complementarity(s: Column, n: int) -> Column:
    """Most equal places of a sequence of n bases and its reverse complement, over offsets from 4 to n - 5, as a share of n."""
    a, b = F.split(s, ""), F.split(S.reverse_complement(s), "")

    def matches(offset: int) -> Column:
        same = F.zip_with(F.slice(a, 1, n - offset), F.slice(b, offset + 1, n - offset), lambda x, y: (x == y).cast("int"))
        return F.aggregate(same, F.lit(0), lambda t, x: t + x)

    return F.greatest(*(matches(o) for o in range(4, n - 4))) / n


def guide_scores(guides: DataFrame, kmer: str, pam: str) -> DataFrame:
    """guides with gc, seed_gc, poly_t, max_homopolymer, self_comp, score (0-100). k-mers of 23 bases."""
    out = guides.withColumn("spacer", spacer(F.col(kmer), F.col(pam)))
    s = F.col("spacer")
    gc, seed = S.gc(s), S.gc(F.right(s, F.lit(12)))
    out = out.withColumn("x", F.explode(F.array(F.struct(gc.alias("gc"), seed.alias("seed"), S.longest_homopolymer(s).alias("homo"), self_complementarity(s, 20).alias("comp")))))
    gc, seed, homo, comp = (F.col(f"x.{f}") for f in ("gc", "seed", "homo", "comp"))
    gc_score = F.when(gc.between(0.4, 0.7), 1.0).when(gc.between(0.3, 0.8), 0.6).when(gc.between(0.2, 0.9), 0.3).otherwise(0.1)
    seed_score = F.when(seed.between(0.3, 0.7), 1.0).when(seed.between(0.2, 0.8), 0.5).otherwise(0.2)
    poly_t = s.contains("TTTT")
    homo_score = F.when(homo <= 3, 1.0).when(homo == 4, 0.5).otherwise(0.1)
    total = gc_score * 0.25 + seed_score * 0.15 + F.when(poly_t, 0.2).otherwise(1.0) * 0.20 + homo_score * 0.15
    total = total + F.greatest(F.lit(0.0), 1.0 - comp * 3) * 0.10 + F.when(F.col(pam) == "NGG", 1.0).otherwise(0.7) * 0.15
    return out.select(*guides.columns, F.bround(gc * 100, 1).alias("gc"), F.bround(seed * 100, 1).alias("seed_gc"), poly_t.alias("poly_t"), homo.alias("max_homopolymer"), F.bround(comp, 3).alias("self_comp"), F.bround(total * 100).cast("int").alias("score"))


def score_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.avg((F.col("score") >= 70).cast("double")), 6).alias("good_share"))


def number_range(s: Column) -> Column:
    """Midpoint of texts such as `1.3-4M` or `21,000-143,000`; a suffix counts at the text's end only, a number at its beginning only."""
    t = F.regexp_replace(F.lower(F.trim(s)), ",", "")
    times = F.when(t.endswith("m"), 1e6).when(t.endswith("k"), 1e3).otherwise(1.0)
    low = F.regexp_extract(t, r"^([\d.]+)", 1)
    high = F.regexp_extract(t, r"^[\d.]+\s*[-–]\s*([\d.]+)", 1)
    number = lambda x: F.nullif(x, F.lit("")).cast("double")
    return F.coalesce(F.when(high != "", (number(low) * times + number(high) * times) / 2), number(low) * times, F.lit(0.0))


def highest_percentage(s: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.lower(s), F.lit(r"([\d.]+)\s*%"), F.lit(1)), lambda x: x.cast("double") / 100)
    return F.coalesce(F.array_max(found), F.lit(0.0))


def priority(rows: DataFrame) -> DataFrame:
    """rows (dx_status, annual_deaths, fatality, classification, rapid_tests) with the five factors and total_score."""
    dx, rapid, kind = (F.lower(F.coalesce(c, F.lit(""))) for c in ("dx_status", "rapid_tests", "classification"))
    deaths, cfr = number_range(F.coalesce("annual_deaths", F.lit(""))), highest_percentage(F.coalesce("fatality", F.lit("")))
    out = rows.withColumns(
        {
            "dx_gap": F.when((dx == "") | dx.contains("none"), 30).when(dx.contains("limited") | dx.contains("research"), 15).otherwise(0),
            "burden": F.when(deaths > 100_000, 25).when(deaths > 10_000, 20).when(deaths > 1_000, 15).when(deaths > 100, 10).otherwise(5),
            "severity": F.when(cfr >= 0.25, 15).when(cfr >= 0.05, 10).when(cfr >= 0.01, 5).otherwise(2),
            "who": F.when(kind.contains("pandemic"), 15).when(kind.contains("epidemic"), 12).when(kind.contains("endemic"), 8).otherwise(5),
            "rapid": F.when((rapid == "") | rapid.contains("none"), 15).when(rapid.contains("limited") | rapid.contains("pcr"), 10).otherwise(3),
        }
    )
    return out.withColumn("total_score", F.col("dx_gap") + F.col("burden") + F.col("severity") + F.col("who") + F.col("rapid"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id with hit, precision, recall and ndcg at k. ranked: query_id, doc_id, rank (from 1); relevant: query_id, doc_id."""
    top = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "doc_id"], "left_semi")
    found = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    size = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    out = queries.select("query_id").join(found, "query_id", "left").join(size, "query_id", "left").fillna(0, ["found", "dcg", "size"])
    ideal = F.aggregate(F.when(F.col("size") > 0, F.sequence(F.lit(1), F.least(F.col("size"), F.lit(k)).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return out.select(
        "query_id",
        (F.col("found") > 0).cast("double").alias("hit"),
        F.round(F.col("found") / k, 6).alias("precision"),
        F.round(F.when(F.col("size") == 0, 1.0).otherwise(F.col("found") / F.col("size")), 6).alias("recall"),
        F.round(F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


#: Cells of a round of a selection, and values that are sorted where a cell has no more.
CELLS, FEW_VALUES = 1024, 10_000


def selected(rows: DataFrame, group: str, value: str, places: dict[str, Column]) -> DataFrame:
    """group and, by name, the values at places (from 0, by ascending value) of each group; places: columns of `n`, its size.

    Values are finite or null (which don't count). A round cuts the range that holds a wanted place into CELLS cells, counts
    them, and narrows the place to the least and greatest value of its cell, until these are equal or few are left, which
    are sorted. No group is sorted or gathered whole.
    """
    v = F.col(value).cast("double")
    keyed = rows.where(v.isNotNull()).select(group, v.alias("v"))
    sizes = keyed.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    each = F.array(*(F.struct(F.lit(k).alias("name"), c.cast("long").alias("left")) for k, c in places.items()))
    wanted = stored(sizes.select(group, "lo", "hi", F.col("n").alias("m"), F.explode(each).alias("w")).select(group, "lo", "hi", "m", "w.name", "w.left"), "selection")
    open_ = F.expr(f"lo < hi and m > {FEW_VALUES}")
    done = wanted.where(~open_)
    wanted = wanted.where(open_)
    while not wanted.isEmpty():
        ranges = wanted.select(group, "lo", "hi").distinct()
        inside = keyed.join(ranges, group).where(F.col("v").between(F.col("lo"), F.col("hi")))
        cell = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * CELLS)
        counts = inside.groupBy(group, "lo", "hi", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        w = Window.partitionBy(group, "lo", "hi").orderBy("cell")  # CELLS + 1 rows at most
        counts = counts.withColumn("before", F.sum("c").over(w) - F.col("c"))
        met = wanted.join(counts, [group, "lo", "hi"]).where((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("c")))
        wanted = stored(met.select(group, F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("c").alias("m"), "name", (F.col("left") - F.col("before")).alias("left")), "selection")
        done = done.unionByName(wanted.where(~open_))
        wanted = wanted.where(open_)
    flat = done.where("lo = hi").select(group, "name", F.col("lo").alias("found"))
    rest = done.where("lo < hi")
    near = keyed.join(rest.select(group, "lo", "hi").distinct(), group).where(F.col("v").between(F.col("lo"), F.col("hi")))
    near = near.withColumn("left", F.row_number().over(Window.partitionBy(group, "lo", "hi").orderBy("v")).cast("long") - 1)  # FEW_VALUES rows at most
    rest = rest.join(near, [group, "lo", "hi", "left"]).select(group, "name", F.col("v").alias("found"))
    return flat.unionByName(rest).groupBy(group).agg(*(F.max(F.when(F.col("name") == k, F.col("found"))).alias(k) for k in places))


def latency(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Per group the first value (cold) and statistics of the rest; a percentile is the value at round(p / 100 * (n - 1))."""
    first = rows.groupBy(group).agg(F.min(order).alias("cold_at"), F.min_by(value, order).alias("cold"))
    rest = rows.join(first.select(group, "cold_at"), group).where(F.col(order) > F.col("cold_at"))
    stats = rest.groupBy(group).agg(F.count(F.lit(1)).alias("warm_n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    at = lambda p: F.round(F.lit(p / 100.0) * (F.col("n") - 1))
    found = selected(rest, group, value, {f"p{p}": at(p) for p in (50, 95, 99)})
    return first.select(group, "cold").join(stats, group, "left").join(found, group, "left")


#: Gates of a comparison: fixed values.
GATES = {"hit": 0.80, "regression": -0.05, "recall": 0.70, "p95_ms": 500.0}


def compared(baseline: DataFrame, candidate: DataFrame, on: str, metrics: list[str]) -> DataFrame:
    """on, metric, baseline, candidate, delta, relative (null where the baseline is 0)."""
    b = baseline.select(on, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("baseline")) for m in metrics))))
    c = candidate.select(on, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("candidate")) for m in metrics))))
    out = b.join(c, [on, "metric"])
    delta = F.col("candidate") - F.col("baseline")
    return out.withColumn("delta", F.round(delta, 6)).withColumn("relative", F.round(F.when(F.col("baseline") != 0, delta / F.col("baseline")), 6))


def gated(measures: DataFrame, on: str) -> DataFrame:
    """on, gate, value, threshold, passed: the four gates of a candidate against its baseline. measures: on, hit, recall,
    baseline_hit, p95_ms. A value that is unknown fails its gate."""
    values = {"hit": F.col("hit"), "regression": F.col("hit") - F.col("baseline_hit"), "recall": F.col("recall"), "p95_ms": F.col("p95_ms")}
    each = F.array(*(F.struct(F.lit(k).alias("gate"), v.cast("double").alias("value"), F.lit(GATES[k]).alias("threshold")) for k, v in values.items()))
    out = measures.select(on, F.inline(each))
    good = F.when(F.col("gate") == "p95_ms", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return out.withColumn("passed", F.coalesce(good, F.lit(False))).withColumn("value", F.round("value", 6))


def verdicts(gates: DataFrame, on: str) -> DataFrame:
    """on, failed (gates that failed, by name) and verdict: PASS, or FAIL where one did."""
    failed = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ", ")
    return gates.groupBy(on).agg(failed.alias("failed")).withColumn("verdict", F.when(F.col("failed") == "", "PASS").otherwise("FAIL"))
