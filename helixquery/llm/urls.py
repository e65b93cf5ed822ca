"""URL filters with path-template trees.

Per host the paths form a tree of segments. Digits in segments are variable and become `#`; a node with
more than BRANCHES different children keeps one child `*` instead. Where the children of a node don't
differ in how much of their labelled pages is bad (chi-square of homogeneity), they are merged into `*`,
from the leaves up. Each remaining template has a share of bad pages, smoothed towards the share of all
pages by PRIOR pages; templates over LIMIT are rejected.

Explicit rules (host and path prefix, longest first) come before the templates.

A page is labelled through the document number that its path carries (labels.doc_id); bad means toxic or of
quality 0. Defined results: a null url or one without `://` has an empty host and path and is judged by the
template of the empty path; templates without labels get the share of all pages; without any label nothing
is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixquery.llm import scratch
from helixquery.llm.line_dedup import LOWER, UPPER

BRANCHES, PRIOR, LIMIT = 16, 20.0, 0.5
#: Templates up to this number are broadcast to the pages.
FEW_TEMPLATES = 50_000

#: (verdict, host, path): fixed by the task.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest]
    first = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True))) if rules else F.lit(None).cast("string")
    return first([h + p for _, h, p in longest]), first([v for v, _, _ in longest])


def segments(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/", -1), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "#"))


def templates(shapes: DataFrame) -> DataFrame:
    """host, segs (as given), template, share. shapes: host, segs, labelled, bad, one row each.

    Only nodes at which paths part are visited: a pass handles the next such node below every node of the last pass, however
    deep it lies, so that the number of passes is that of partings on a path and not of its segments.
    """
    spark = shapes.sparkSession
    total = shapes.agg(F.sum("labelled").alias("m"), F.sum("bad").alias("bad")).first()
    share = (total.bad or 0) / total.m if total.m else 0.0
    paths: list[str] = []
    visited: list[str] = []
    size, at = F.size("t"), F.col("at")
    starred = lambda: F.concat(F.slice("t", F.lit(1), at), F.array(F.lit("*")), F.slice("t", at + 2, F.greatest(size - at - 1, F.lit(0))))

    def rewritten(tree: DataFrame) -> DataFrame:
        out = scratch.written(tree, "tree", paths)
        scratch.deleted(spark, *paths[:-1])
        del paths[:-1]
        return out

    # t: the template so far; known: how many of its segments the node above has (null: no other path is below that node);
    # parted: the depths of the nodes where the path parted from others
    tree = rewritten(shapes.withColumns({"t": F.col("segs"), "known": F.lit(0), "parted": F.array().cast("array<int>")}))
    passes = 0
    while True:
        rows = tree.where("known is not null").withColumn("up", F.slice("t", F.lit(1), F.col("known")))
        nodes = rows.groupBy("host", "up").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
        differ = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), F.lit(False))  # 1 is the first segment
        nodes = nodes.select("host", "up", F.when(differ > 0, differ - 1).otherwise(F.size("lo")).cast("int").alias("at"))
        found = scratch.written(rows.join(nodes, ["host", "up"]).where(size > at).select("host", "up", "at", F.get("t", at).alias("child")).distinct().groupBy("host", "up", "at").agg((F.count(F.lit(1)) > BRANCHES).alias("wide")), "nodes", visited)
        if found.isEmpty():
            break
        marked = tree.withColumn("up", F.slice("t", F.lit(1), F.col("known"))).join(found, ["host", "up"], "left")
        below = F.coalesce(size > at, F.lit(False))
        t = F.when(below & F.col("wide"), starred()).otherwise(F.col("t"))
        tree = rewritten(marked.select("host", "segs", "labelled", "bad", t.alias("t"), F.when(below, at + 1).alias("known"), F.when(below, F.concat("parted", F.array(at))).otherwise(F.col("parted")).alias("parted")))
        passes += 1
    for k in reversed(range(passes)):
        rows = tree.withColumn("at", F.get("parted", F.lit(k))).withColumn("up", F.when(at.isNotNull(), F.slice("t", F.lit(1), at)))
        child = rows.where("at is not null").groupBy("host", "up", F.get("t", at).alias("child")).agg(F.sum("labelled").alias("m"), F.sum("bad").alias("x"))
        node = child.groupBy("host", "up").agg(F.count_if(F.col("m") > 0).alias("k"), F.sum("m").alias("mm"), F.sum("x").alias("xx"), F.sum(F.when(F.col("m") > 0, F.col("x") * F.col("x") / F.col("m"))).alias("s"), F.count(F.lit(1)).alias("n"))
        p = F.col("xx") / F.nullif(F.col("mm"), F.lit(0))
        # sum of (x - m p)^2 / (m p (1 - p)) over the children
        chi = F.when((p > 0) & (p < 1), (F.col("s") - F.col("mm") * p * p) / (p * (1 - p))).otherwise(0.0)
        alike = chi <= (F.col("k") - 1) + 2 * F.sqrt(2 * F.greatest(F.col("k") - 1, F.lit(0)))
        merged = node.where(F.coalesce(alike, F.lit(True)) & (F.col("n") > 1)).select("host", "up", F.lit(True).alias("star"))
        tree = rewritten(rows.join(merged, ["host", "up"], "left").withColumn("t", F.when(F.col("star"), starred()).otherwise(F.col("t"))).drop("up", "at", "star"))
    scratch.deleted(spark, *visited)
    sums = tree.groupBy("host", "t").agg(F.sum("labelled").alias("m"), F.sum("bad").alias("x"))
    sums = sums.withColumn("share", (F.col("x") + PRIOR * share) / (F.col("m") + PRIOR))
    return tree.select("host", "segs", "t").join(sums.select("host", "t", "share"), ["host", "t"]).select("host", "segs", F.concat(F.lit("/"), F.array_join("t", "/")).alias("template"), "share")


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, bad_share."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("segs", segments(F.col("path")))
    known = labels.groupBy("doc_id").agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("is_bad"))
    number = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') as bigint)")
    shapes = rows.withColumn("doc_id", number).join(known, "doc_id", "left").groupBy("host", "segs").agg(F.count("is_bad").alias("labelled"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad"))
    found = scratch.written(templates(shapes), "templates")
    near = F.broadcast(found) if found.count() <= FEW_TEMPLATES else found
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = rows.join(near, ["host", "segs"], "left")
    own = F.when(F.col("share") > LIMIT, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", F.round("share", 9).alias("bad_share"))
