from pyspark.sql import functions as F

from tessera.llm import queries, warc
from tests.llm.test_warc import pages


def test_the_query_reads_what_it_wrote(spark, tmp_path):
    pages(spark, 260).drop("leaf").write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.op7_warc_fixity_audit(spark, str(tmp_path)).collect()
    n = 260 + 44
    leaf = {x.position: x.leaf for x in out}
    gone, added = {p for p in range(n) if p % 103 == 7}, {n + p // 107 for p in range(n) if p % 107 == 21}
    want = {p for p in range(n) if p not in gone and (p % 97 == 13 or (p % 101 == 50 and leaf.get(p + 1) != leaf[p]))}
    whole = [p % 103 != 7 and p % 97 != 13 and p % 101 != 50 for p in range(n)] + [False]
    trades = {p for p in range(n) if p % 109 == 60 and whole[p] and whole[p + 1]}
    here = [p for p in range(n) if p not in gone | want]
    there = sorted(here, key=lambda p: p + (p in trades) - (p - 1 in trades))
    before = [dict(zip(x, [None, *x[:-1]], strict=True)) for x in (here, there)]
    moved = {p for p in here if before[0][p] != before[1][p]}
    found = {s: {x.position for x in out if x.status == s} for s in ("corrupt", "missing", "surplus", "intact", "moved")}
    assert (found["corrupt"], found["missing"], found["surplus"], found["moved"]) == (want, gone, added, moved) and len(moved) >= 3
    assert len(out) == n + len(added) and found["intact"] == set(range(n)) - gone - want - moved


def test_unlike_branches_only_are_read(spark):
    rows = spark.range(40_000).select(F.col("id").alias("page_id"), F.lit(9).cast("long").alias("length"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    levels = warc.tree(rows, 40_000, 16)
    plan = warc.inside(levels[0], [7, 9], 16)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(node,144)" in plan
    files = sorted((x.a, x.b) for x in levels[0].groupBy(F.input_file_name()).agg(F.min("node").alias("a"), F.max("node").alias("b")).collect())
    assert all(x[1] < y[0] for x, y in zip(files, files[1:], strict=False))
    assert warc.inside(levels[0], [7, 9], 16).where("node NOT BETWEEN 112 AND 127 AND node NOT BETWEEN 144 AND 159").count() == 0
    other = warc.tree(rows.withColumn("leaf", F.when(F.col("page_id") == 123, "x").otherwise(F.col("leaf"))), 40_000, 16)
    (one,) = warc.differences(levels, other, 16).collect()
    assert one.node == rows.where("page_id = 123").select(warc._bucket(40_000).alias("b")).first().b
