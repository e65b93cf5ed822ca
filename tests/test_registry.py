"""Every query with SQL gives the rows of its SQL on the small tables."""

import os

import pytest

from helixquery.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
QUICK = """batch_search locate search_page search_one vocabulary vocabulary_lookup cooccurrence retrieval_metrics generated_queries generated_retrieval latency_stats compare_reports report_gates
report_verdicts sections shard_plan shard_manifest dataset_manifest manifest_totals guide_primitives kmer_targets distinct_share recount off_targets prepared_guides conservation host_summary
novelty resistance_overlap gene_annotation annotation_counts merged_regions melting_temperature evidence evidence_lists patents gene_gaps synonyms diagnostic_priority enrichment""".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DIR}/{t}'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    got = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    rel = duck.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == sorted(repr([r[i] for i in at]) for r in rel.fetchall())


def test_guide_mining_takes_accented_letters_as_letters(spark, duck, tmp_path):
    run = "abcd" * 5
    texts = [f"{run} {run[:-1]}a", f"é{run}", f"{run}ñ", f"x_{run}", f"¿{run}-{run}c.", f"{run}9", run * 2, None]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    got = {tuple(x) for x in registry.queries()["guide_mining"](spark, str(tmp_path)).select("run", "first_doc", "docs").collect()}
    con = duck.cursor()
    con.sql(f"CREATE TEMP VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert got == set(con.sql(registry.oracle_sql()["guide_mining"]).select("run, first_doc, docs").fetchall())
    plain = "ACGT" * 5
    assert got == {(plain, 0, 2), (plain[:-1] + "A", 0, 1), (plain + "G", 4, 1)}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
