"""Draws of pairs that are each pair's own: MD5 of the whole key, held against hashlib."""

import hashlib
from collections import Counter
from itertools import combinations

import pytest

from tessera.plans import pair_plans
from tessera.plans import views as V

TEXTS = ["Planet and garden, meadow. " * 4 + "Planet again. Garden! Meadow? Window, window."] * 3 + ["Nothing here."] + ["Bridge garden. " * 9 + "Bridge."] * 4


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("draws")
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def scored(spark, table):
    """key, label, p, first and second mention of every pair."""
    docs = {}
    for m in sorted(V.mentions(spark, table).collect(), key=lambda m: (m.doc_id, m.sentence_id, m.token_id)):
        docs.setdefault(m.doc_id, []).append(m)
    out = []
    for d, ms in docs.items():
        for a, b in combinations(ms, 2):
            key, label = (d, a.sentence_id, a.token_id, b.sentence_id, b.token_id), a.chain_id == b.chain_id
            out.append((key, label, min(1.0, (draw(*key) % 1000 + 400 * label) / 1000), a, b))
    return out


def test_train_sample(spark, table, scored):
    train = [x for x in scored if x[3].split == "train"]
    positives = [x[0] for x in train if x[1]]
    negatives = sorted((x[0] for x in train if not x[1]), key=lambda k: (draw("seed", *k), k))
    assert 0 < len(positives) < len(negatives)
    assert sorted(tuple(r)[:5] for r in pair_plans.pair_train_sample(spark, table).collect()) == sorted(positives + negatives[: len(positives)])


def test_confusion(spark, table, scored):
    got = pair_plans.pair_confusion(spark, table).first()
    want = Counter((label, p >= 0.5) for _, label, p, _, _ in scored)
    assert (got.tp, got.fp, got.fn, got.tn) == tuple(want[k] for k in ((True, True), (False, True), (True, False), (False, False))) and min(want.values()) > 0


def test_type_diagnostics(spark, table, scored):
    want = Counter((kind, label, p >= 0.5) for _, label, p, a, b in scored for kind in {a.mention_type, b.mention_type})
    for x in pair_plans.pair_type_diagnostics(spark, table).collect():
        assert (x.tp, x.fp, x.fn, x.tn) == tuple(want[x.type, *k] for k in ((True, True), (False, True), (True, False), (False, False)))


def wrong(scored):
    """key, p, target and partner_type of every error."""
    for key, label, p, a, b in scored:
        for target, kind in pair_plans.TARGETS.items():
            if label != (p >= 0.5) and kind in (a.mention_type, b.mention_type):
                yield key, p, target, b.mention_type if a.mention_type == kind else a.mention_type


def test_first_false_negatives(spark, table, scored):
    want = sorted((p, *key, target) for key, p, target, _ in wrong(scored) if p < 0.5)[:30]
    assert [(x.p, x.doc_id, x.s1, x.t1, x.s2, x.t2, x.target) for x in pair_plans.error_fn_top30(spark, table).collect()] == want and want


def test_summary(spark, table, scored):
    want = Counter((target, "FP" if p >= 0.5 else "FN", partner) for _, p, target, partner in wrong(scored))
    assert {(x.target, x.error, x.value): x.n for x in pair_plans.error_summary(spark, table).collect() if x.dimension == "partner_type"} == want
