"""Assignment over components, slices and their gates, type maps, event folds and clusters, against brute force."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import events as E
from tessera.operators import metrics as M
from tessera.operators import slices as L
from tessera.operators import typemap as Y


def best_by_permutations(edges):
    gs, ps = sorted({g for g, *_ in edges}), sorted({p for _, p, _ in edges})
    weight = {(g, p): w for g, p, w in edges}
    a, b, turn = (gs, ps, False) if len(gs) <= len(ps) else (ps, gs, True)
    return max(sum(weight.get((y, x) if turn else (x, y), 0) for x, y in zip(a, order, strict=True)) for order in itertools.permutations(b, len(a)))


def test_assignment_of_sparse_graphs():
    r = random.Random(1)
    for _ in range(400):
        edges = [(g, p, r.choice([0.25, 0.5, r.random()]) + 0.01) for g in range(r.randrange(1, 6)) for p in range(r.randrange(1, 6)) if r.random() < 0.5]
        if edges:
            got = M.assign(*(np.array(x) for x in zip(*edges, strict=True)))
            assert abs(got - best_by_permutations(edges)) < 1e-9, edges


@pytest.mark.parametrize("most", [20_000, 0])
def test_assignments_match_permutations(spark, most):
    r = random.Random(2)
    docs = {}
    for d in range(60):
        docs[d] = [(g, p, round(r.random(), 3) + 0.01) for g in range(5) for p in range(5) if r.random() < r.choice([0.15, 0.4])]
    rows = [(d, *e) for d, edges in docs.items() for e in edges]
    got = M.assignments(spark.createDataFrame(rows, "doc_id long, g int, p int, phi double"), most).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    want = {d: best_by_permutations(e) for d, e in docs.items() if e}
    assert {x.doc_id for x in got} == set(want) and all(abs(x.n - want[x.doc_id]) < 1e-9 for x in got)


def test_a_large_document_is_cut_into_components(spark):
    n = 20_000
    rows = [(1, k, k // 2 * 2 + s, 0.5 + 0.1 * ((k + s) % 2)) for k in range(n) for s in (0, 1)]  # two by two blocks
    began = time.time()
    got = M.assignments(spark.createDataFrame(rows, "doc_id long, g int, p int, phi double"), 1000)
    assert abs(got.groupBy("doc_id").agg(F.sum("n").alias("n")).first().n - n * 0.6) < 1e-6
    assert got.count() == n // 2 and time.time() - began < 240


PARTS = "doc_id long, muc_rn long, muc_rd long, muc_pn long, muc_pd long"


def test_slices_add_up_and_come_in_order(spark):
    groupings = {"domain": ("x", "y", "none"), "phenomenon": ("p",)}
    parts = spark.createDataFrame([(1, 1, 2, 1, 1), (2, 0, 1, 0, 1), (3, 3, 3, 3, 4)], PARTS)
    meta = spark.createDataFrame([(1, "x", "p"), (2, "y", "p"), (3, "x", "p"), (9, "z", "q")], "doc_id long, domain string, phenomenon string")
    got = [(r.grouping, r.slice, r.n_docs, round(r.muc_r, 4), round(r.muc_p, 4)) for r in L.slice_scores(parts, meta, groupings).orderBy("place").collect()]
    assert got == [("all", "all", 3, 0.6667, 0.6667), ("domain", "x", 2, 0.8, 0.8), ("domain", "y", 1, 0.0, 0.0), ("domain", "none", 0, 0.0, 0.0), ("phenomenon", "p", 3, 0.6667, 0.6667)]
    for bad in ([(1, "x", "p"), (2, "other", "p"), (3, "x", "p")], [(1, "x", "p"), (2, "y", "p")], [(1, "x", "p"), (2, None, "p"), (3, "x", "p")]):
        with pytest.raises(Exception, match="documents"):
            L.slice_scores(parts, spark.createDataFrame(bad, "doc_id long, domain string, phenomenon string"), groupings).collect()


def test_slice_problems_of_every_kind(spark):
    docs = spark.createDataFrame([(k,) for k in range(1, 6)], "doc_id long")
    meta = spark.createDataFrame([(1, "x", "p", "test"), (2, "z", "p", "test"), (2, "x", "p", "test"), (3, "x", None, "test"), (4, "x", "p", "dev"), (8, "?", "?", "?")], "doc_id long, domain string, phenomenon string, split string")
    got = {tuple(r) for r in L.slice_problems(docs, meta, {"domain": ("x",), "phenomenon": ("p",)}, "test", 7).collect()}
    assert got == {(5, "no_metadata", None), (2, "repeated_metadata", "2"), (4, "other_split", "dev"), (2, "unknown_domain", "z"), (3, "unknown_phenomenon", None), (None, "total", "5")}
    assert L.slice_problems(docs.where("doc_id = 1"), meta, {"domain": ("x",)}, "test", 1).collect() == []


def test_type_map_spans_and_problems(spark):
    index = spark.createDataFrame([("d", s, t, (s - 1) * 3 + t) for s in (1, 2) for t in range(3)] + [("e", 1, 0, 0)], "doc_id string, sentence_id int, token_id int, idx int")
    rows = [("d", 2, 0, 1, "m1", "A"), ("d", 2, 1, 7, "m2", "A"), ("d", 1, 0, 0, "m3", "A"), ("d", 1, 0, 0, "m4", "B"), ("e", 1, 0, 0, "m5", "A"), ("e", 1, 0, 0, "m5", "A"), ("x", 1, 0, 0, "m6", "A")]
    types = spark.createDataFrame([(*r, "test", "with_zero") for r in rows] + [("d", 1, 1, 1, "m7", "A", "dev", "with_zero")], "doc_id string, sentence_id int, token_start int, token_end int, mention_id string, mention_type string, split string, mode string")
    placed = Y.with_global_spans(Y.of_mode(types, "test", "with_zero"), index)
    assert {tuple(r) for r in Y.span_types(placed).collect()} == {("d", 3, 4, "A"), ("e", 0, 0, "A")}
    want = {("d", "m2", "unaligned"), ("x", "m6", "unaligned"), ("d", "m3", "conflicting_type"), ("d", "m4", "conflicting_type"), ("e", "m5", "repeated_mention_id")}
    assert {tuple(r) for r in Y.span_problems(placed).collect()} == want
    events = spark.createDataFrame([("m1", "d"), ("m1", "e"), ("m9", "d"), ("m4", "d")], "event_id string, doc_id string")
    starts = index.groupBy("doc_id", "sentence_id").agg(F.min("idx").alias("start"))
    got = {tuple(r) for r in Y.event_spans(events, Y.by_sentence_start(types, starts), "A").collect()}
    assert got == {("m1", "d", 3, 4, None), ("m1", "e", 3, 4, "doc_mismatch"), ("m9", "d", None, None, "not_in_type_map"), ("m4", "d", 0, 0, "not_an_event_mention")}


def test_folds_are_linear_in_a_long_document(spark):
    n = 100_000
    events = spark.range(n).select(F.lit("d").alias("doc_id"), (F.col("id") * 2).cast("int").alias("start"), F.format_string("%06d", "id").alias("event_id"), F.lit("abc").alias("trigger"))
    began = time.time()
    assert E.drop_conflicts(events).count() == n // 2  # every other one overlaps the last kept
    text = "ab cd. " * n
    out = spark.createDataFrame([(text, ["ab cd."] * n + ["x", "ab"])], "t string, s array<string>").select(E.sentence_offsets(F.col("t"), F.col("s")).alias("o")).first().o
    assert out[:3] == [0, 7, 14] and out[n - 1] == 7 * (n - 1) and out[-2:] == [-1, -1] and time.time() - began < 60
    odd = spark.createDataFrame([("d", None, "a", "x"), ("d", 3, "b", None), ("d", 3, "c", "yy"), (None, 0, "d", "z")], "doc_id string, start int, event_id string, trigger string")
    assert sorted(map(tuple, E.drop_conflicts(odd).collect()), key=str) == [("d", "b"), ("d", "c"), (None, "d")]
    nulls = spark.createDataFrame([(None, ["a"]), ("a", None), ("aa", ["a", None, "a"])], "t string, s array<string>").select(E.sentence_offsets(F.col("t"), F.col("s")).alias("o")).collect()
    assert [r.o for r in nulls] == [[-1], None, [0, -1, -1]]


def plain_clusters(pairs, threshold, apart):
    """Clusters as sets, joined one pair after the other."""
    sets = {}
    against = [{a, b} for a, b, p in pairs if p < apart]
    for _, a, b in sorted((-p, a, b) for a, b, p in pairs if p >= threshold):
        x, y = sets.setdefault(a, {a}), sets.setdefault(b, {b})
        if x is not y and not any(len(n & x) == 1 and len(n & y) == 1 for n in against):
            x |= y
            for e in y:
                sets[e] = x
    return {e: min(own) for e, own in sets.items()}


@pytest.mark.parametrize("apart", [0.0, 0.3])
def test_greedy_clusters_match_a_plain_loop(spark, apart):
    r = random.Random(5)
    docs = {f"d{d}": [(f"e{a}", f"e{b}", r.choice([0.1, 0.4, 0.5, 0.9, round(r.random(), 2)])) for a, b in itertools.combinations(range(r.randrange(2, 9)), 2) if r.random() < 0.6] for d in range(60)}
    rows = [(d, *p) for d, pairs in docs.items() for p in pairs] + [("d0", None, "e1", 0.9), ("d0", "e0", "e1", None), ("d0", "e0", "e1", float("nan"))]
    got = {}
    for x in E.greedy_clusters(spark.createDataFrame(rows, "doc_id string, a string, b string, p double"), 0.5, apart).collect():
        got.setdefault(x.doc_id, {})[x.event_id] = x.cluster
    assert got == {d: want for d, pairs in docs.items() if (want := plain_clusters(pairs, 0.5, apart))}


def test_packed_labels_may_be_null(spark):
    packed = spark.createDataFrame([("a", 3, [0, 1, 0]), ("b", 1, None)], "doc_id string, n int, l array<int>")
    assert {r.doc_id: r.c for r in packed.select("doc_id", E.event_clusters("n", "l").alias("c")).collect()} == {"a": [0, 1, 0], "b": [0]}
