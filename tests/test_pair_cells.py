"""Tables of pairs that are joined where they lie: whole results, and no exchange by a pair's own keys."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import pairs as P
from tessera.plans import pair_plans
from tessera.plans import views as V

KEYS = pair_plans.CELL_KEYS


@pytest.fixture(scope="module")
def tables(spark):
    """Pairs and scores of three in four of them, in small blocks; document 1 is there twice, so its keys repeat."""
    rows = [(d, i // 3, i % 3, i % 4, i) for d, n in ((1, 23), (1, 23), (2, 1), (3, 7)) for i in range(n)]
    placed = P.in_blocks(spark.createDataFrame(rows, "doc_id long, sentence_id int, token_id int, chain_id int, h int"), 4)
    pairs = P.mention_pairs(placed, carry=("h",), cells=P.joined_cells(placed)).select(*KEYS, "h1", "h2")
    return pairs.drop("h1", "h2"), pairs.where("(h1 + h2) % 4 <> 0").selectExpr(*KEYS, "double(h1) AS p")


def pair_exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\([^)]*s1#[^)]*\)", text)


@pytest.mark.parametrize("how", ["strict", "default", "missing"])
def test_joins_where_the_pairs_lie(spark, tables, how):
    pairs, scores = tables
    known = Counter(tuple(r)[:5] for r in scores.collect())
    all_of = Counter(tuple(r)[:5] for r in pairs.collect())
    assert all_of[1, 0, 0, 7, 1] == 4 and 0 < len(known) < len(all_of)
    with P.meeting_in_cells(spark):
        joined = P.join_scores(pairs, scores, KEYS, how)
        got = Counter(tuple(r[k] for k in pair_plans.KEYS) for r in joined.collect())
        assert not pair_exchanges(joined)
    want = {k: n * known[k] if how == "strict" or known[k] and how == "default" else n for k, n in all_of.items() if how == "default" or (how == "strict") == (known[k] > 0)}
    assert got == want


def test_gates_where_the_pairs_lie(spark, tables):
    pairs, scores = tables
    n = pairs.rdd.getNumPartitions()
    odd = spark.createDataFrame([(2, 0, 0, 0, 0, 0, 0, 0.5), (9, 0, 0, 1, 0, 0, 0, 0.5)], scores.schema).repartition(n, "doc_id", "block1", "block2")
    known, all_of = (Counter(tuple(r)[:5] for r in x.collect()) for x in (scores, pairs))
    with P.meeting_in_cells(spark):
        gates = P.score_gates(pairs, scores.unionByName(odd), KEYS)
        got = {r.kind: r.n for r in gates.collect()}
        assert not pair_exchanges(gates)
    repeated = lambda x: sum(k > 1 for k in x.values())
    assert got == {"duplicate_pair": repeated(all_of), "duplicate_score": repeated(known), "missing_score": sum(v for k, v in all_of.items() if not known[k]), "unknown_score": 2}


def test_texts_come_to_the_pairs(spark):
    rows = [(d, i // 3, i % 3, i % 4) for d, n in ((1, 23), (2, 1), (3, 7)) for i in range(n)]
    placed = P.in_blocks(spark.createDataFrame(rows, "doc_id long, sentence_id int, token_id int, chain_id int"), 4)
    docs = spark.createDataFrame([(d, f"text {d}") for d in (1, 2, 3, 4)], "doc_id long, text string")
    pairs = P.mention_pairs(placed, cells=5)
    joined = pairs.join(P.in_cells(docs, placed, 5), P.CELL).select(*pair_plans.KEYS, "text")
    got = sorted(map(tuple, joined.collect()))
    assert got == sorted((*tuple(r), f"text {r.doc_id}") for r in pairs.select(*pair_plans.KEYS).collect()) and len(got) == 23 * 11 + 21
    lines = joined._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not [x for x, below in zip(lines, lines[1:]) if "Exchange" in x and "s1#" in below and "s2#" in below]
    # joined by the document alone, the pairs would move


def exchanges(df):
    """The lines of the plan's exchanges, without reused ones."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [x.lstrip(" :+-") for x in lines if re.match(r"[ :+-]*Exchange ", x)]


def test_pairs_and_scores_share_what_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(pair_plans, "_placed", lambda s, d: (placed := P.in_blocks(s.createDataFrame([(1, i // 3, i % 3, i % 4) for i in range(23)], "doc_id long, sentence_id int, token_id int, chain_id int"), 4), P.joined_cells(placed)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for query in (pair_plans.score_join_strict, pair_plans.score_join_canonical, pair_plans.score_left_default):
            with P.meeting_in_cells(spark):
                found = query(spark, "")
                plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("ReusedExchange") >= 2, query
            assert {(r.s1, r.t1, r.s2, r.t2) for r in found.collect()} <= {(i // 3, i % 3, j // 3, j % 3) for i in range(23) for j in range(i + 1, 23)}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_partition_has_few_pairs(spark):
    # one lookup table of a partition holds thrice JOINED pairs in the worst case: 300 MB
    assert P.MET**2 <= P.JOINED // 8 and P.JOINED * 3 * 200 <= 320_000_000
    placed = P.in_blocks(spark.range(3000).selectExpr("1L AS doc_id", "int(id / 9) AS sentence_id", "int(id % 9) AS token_id", "1 AS chain_id"), P.MET)
    pairs = P.mention_pairs(placed, carry=(), cells=P.joined_cells(placed))
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 * 2999 // 2 and max(sizes) <= 3 * P.JOINED


def test_ends_of_scores_are_counted_before_they_move(spark, tables):
    pairs, scores = tables
    mentions = spark.range(20).selectExpr("1L AS doc_id", "int(id / 3) AS sentence_id", "int(id % 3) AS token_id")  # known to be small
    with P.meeting_in_cells(spark):
        gates = P.score_gates(pairs, scores, KEYS, mentions)
        lines = gates._jdf.queryExecution().optimizedPlan().toString().split("\n")
        got = {r.kind: r.n for r in gates.collect()}
    ends = {(r.doc_id, s, t) for r in scores.collect() for s, t in ((r.s1, r.t1), (r.s2, r.t2))}
    assert got["unknown_span"] == len(ends - {tuple(r) for r in mentions.collect()}) > 0
    # the rows of all pairs' ends go to an aggregate, not into a join
    names = [re.sub(r"^[ :+-]*", "", x) for x in lines]
    users = [next(y for y in reversed(names[:k]) if not y.startswith(("Project", "Filter"))) for k, x in enumerate(names) if x.startswith("Generate explode(array(")]
    assert users and all(x.startswith("Aggregate") for x in users)


def test_mentions_deal_texts_once(spark, tmp_path):
    spark.createDataFrame([(i, "Common phrase stands. Common phrase again, phrase.", "en") for i in range(3)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = V.mentions(spark, str(tmp_path))
    dealt = exchanges(found)
    assert len(dealt) == 1 and "REPARTITION" in dealt[0]
    assert found.count() == 3 * 5
