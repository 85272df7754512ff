from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm import test_bpe, test_jaccard, test_spans


def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), before.schema)
        assert docs.columns == columns, name
        rows, old = docs.collect(), before.collect()
        assert len({x.doc_id for x in rows}) > 0 and {x.doc_id for x in rows} <= {x.doc_id for x in old}
        if name == "n-gram Jaccard join":
            best = [d for d, c, _ in test_jaccard.brute([(x.doc_id, x.text) for x in old]) if d == c]
            assert sorted(x.doc_id for x in rows) == sorted(best)
        if name == "substring dedup":
            want = [(d, t) for d, t, n in test_spans.brute([(x.doc_id, x.text) for x in old]) if t.strip() or not n]
            assert sorted((x.doc_id, x.text) for x in rows) == sorted(want)
            assert all(x.n_chars == len(x.text) for x in rows)
    out = corpus_pipeline.tokens(spark, docs, SF).collect()
    assert sorted((tuple(x) for x in out), key=str) == test_bpe.want([(x.doc_id, x.text) for x in docs.collect()])


def test_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label int"
    rows = [(1, None, None, None, None, 1), (None, "a b c d e f", "en", "s", 11, 0), (None, "a b c d e f", "en", "s", 11, 0), (2, "x y z " * 9, "en", "s", 54, 1), (2, "x y z " * 9, "en", "s", 54, 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            rows_out = out.collect()
            if name != "byte-level BPE":
                assert out.columns == docs.columns
            if name == "n-gram Jaccard join" and data:
                assert sum(x.doc_id == 2 for x in rows_out) == 1 and sum(x.doc_id is None for x in rows_out) == 2


def test_columns_with_the_names_of_the_operators_stay(spark):
    names = ["score", "tag", "size", "key", "row", "covered", "class_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    docs = docs.select("*", *(F.lit(-5.0).alias(n) for n in names), F.struct(F.lit(1).alias("d e")).alias("a b:c"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(x[n] == -5.0 for x in rows for n in names) and all(x["a b:c"]["d e"] == 1 for x in rows), name
