from pyspark.sql import functions as F

from tessera.llm import warc


def pages(spark, n=700):
    rows = [(i if i % 50 else None, f"http://h{i}/", f"<p>é{i}</p>" * (i % 7)) for i in range(n)]
    rows += [(5, "http://h5/", "<p>é5</p>" * 5)] * 40 + [(6, None, None), (7, "", ""), (8, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (9, "u", "long " * 60_000)]
    return spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, leaf int")


def test_audit_finds_exactly_what_differs(spark):
    table = pages(spark)
    own = spark.createDataFrame(warc.ordered(table).collect(), "page_id long, position long, length long, leaf string")
    n = own.count()
    assert sorted(x.position for x in own.collect()) == list(range(n)) == list(range(table.count()))
    last = own.orderBy("position").collect()
    assert [x.page_id for x in last] == sorted((x.page_id for x in last), key=lambda v: (v is not None, v or 0))
    altered = own.withColumn("leaf", F.when(F.col("position").isin(3, 300, 301), "x").otherwise(F.col("leaf")))
    for replica, want in (
        (own, {}),
        (altered, {3: "corrupt", 300: "corrupt", 301: "corrupt"}),
        (own.where(F.col("position") != n - 1), {n - 1: "missing"}),
        (own.unionByName(spark.createDataFrame([(1, n, 9, "z")], "page_id long, position long, length long, leaf string")), {n: "surplus"}),
    ):
        for per_file, fan in ((256, 16), (10, 3)):
            got = warc.fixity_audit(table, replica, per_file, fan).collect()
            assert {x.position: x.status for x in got if x.status != "intact"} == want
            assert len(got) == n + ("surplus" in want.values())
            at = {}
            for x in sorted(got, key=lambda x: x.position):
                if x.status != "surplus":
                    assert x.offset == at.get(x.file, 0) and x.file == x.position // per_file
                    at[x.file] = x.offset + x.length


def test_descends_only_into_branches_that_differ(spark):
    own = warc.with_offsets(spark.createDataFrame(warc.ordered(pages(spark)).collect()))
    other = own.withColumn("leaf", F.when(F.col("position") == 17, "x").otherwise(F.col("leaf")))
    a, b = warc.tree(own, own.count()), warc.tree(other, own.count())
    assert a[-1].count() == 1 and a[-1].first().hash != b[-1].first().hash
    changed = [x.select("node", "hash").exceptAll(y.select("node", "hash")).count() for x, y in zip(a, b, strict=True)]
    assert changed == [1] * len(a)


def test_a_longer_replica_and_an_empty_one(spark):
    table = pages(spark, 20)
    none = spark.createDataFrame([], "page_id long, position long, length long, leaf string")
    assert {x.status for x in warc.fixity_audit(table, none).collect()} == {"missing"}
    assert {x.status for x in warc.fixity_audit(table.limit(0), warc.ordered(table)).collect()} == {"surplus"}
    assert warc.fixity_audit(table.limit(0), none).collect() == []


def test_files_round_trip(spark, tmp_path):
    table = pages(spark, 60)
    warc.write_warc(table.repartition(3), f"{tmp_path}/w")
    back = warc.read_warc(spark, f"{tmp_path}/w")
    want = sorted((x.url or "", x.html or "") for x in table.collect())
    assert sorted((x.url, x.html) for x in back.collect()) == want
