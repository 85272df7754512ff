"""char_tokenize against its SQL on odd texts."""

import duckdb
import pytest

from tessera.plans import text_plans as X


@pytest.mark.parametrize("together", [0, 1 << 22])
def test_char_tokenize_as_its_sql(spark, tmp_path, monkeypatch, together):
    monkeypatch.setattr(X, "TOGETHER", together, raising=False)
    rows = [(1, "a\x1cb\x1f c"), (2, ""), (3, None), (4, " \n"), (5, "two two"), (5, "two two"), (6, "b a"), (6, "b a c"), (6, ""), (None, "x\x85y"), (None, "x\x85y"), (7, "á\U0001f600\x1e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    # of doc_id 6 the empty token ties with a letter, which the SQL leaves open
    want = {x for x in con.execute(X.PLANS["char_tokenize"][1]).fetchall() if x[0] != 6}
    got = {tuple(x) for x in X.char_tokenize(spark, str(tmp_path)).collect()}
    assert {x for x in got if x[0] != 6} == want and {x[0] for x in want} == {1, 2, 5, None, 7}
    assert {x[0]: x[1] for x in got}[6] == 6
