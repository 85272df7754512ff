"""The registered queries do the whole job: brute force on small tables with what a cap would cut."""

import re
from collections import Counter
from itertools import combinations

from tessera.operators import metrics as M
from tessera.operators import pairs as P
from tessera.plans import corpus_plans, pair_plans, text_plans
from tessera.plans import views as V


def folder(spark, path, texts):
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def far_apart():
    return ["Planet moves on. " + "It is so. " * 12 + "Planet again. Garden too. " + "We go. " * 5 + "Garden ends, planet stays.", "Nothing here."]


def all_pairs(mentions):
    docs = {}
    for m in sorted(mentions, key=lambda m: (m.doc_id, m.sentence_id, m.token_id)):
        docs.setdefault(m.doc_id, []).append(m)
    return {(d, a.sentence_id, a.token_id, b.sentence_id, b.token_id, a.chain_id == b.chain_id) for d, ms in docs.items() for a, b in combinations(ms, 2)}


def test_pairs_of_any_distance(spark, tmp_path):
    d = folder(spark, tmp_path, far_apart())
    want = all_pairs(V.mentions(spark, d).collect())
    assert max(x[3] - x[1] for x in want) > 10 and len(want) == 10
    assert sorted(map(tuple, pair_plans.mention_pairs(spark, d).collect())) == sorted(want)
    assert {tuple(x)[:5] for x in pair_plans.exact_string_scores(spark, d).collect()} == {x[:5] for x in want}
    stats = pair_plans.pair_stats(spark, d).first()
    assert stats.candidate_positive + stats.candidate_negative == len(want)
    seen = {(x.s2, x.t2): x.p for x in pair_plans.best_antecedent(spark, d).collect()}
    best = {}
    for x in pair_plans.scored(spark, d).collect():
        best[x.s2, x.t2] = max(best.get((x.s2, x.t2), 0), x.p)
    assert seen == {k: p for k, p in best.items() if p >= 0.5}


def test_blocks_give_each_pair_once(spark):
    rows = [(d, i // 3, i % 3, i % 4) for d, n in ((1, 23), (2, 1), (3, 5)) for i in range(n)] + [(3, 0, 1, 9)]
    m = spark.createDataFrame(rows, "doc_id long, sentence_id int, token_id int, chain_id int")
    want = sorted(tuple(x) for x in P.mention_pairs(m, 10**6).select(*pair_plans.KEYS, "c1", "c2", "label").collect())
    for block in (1, 2, 7, 512):
        assert sorted(tuple(x) for x in P.mention_pairs(m, block=block).select(*pair_plans.KEYS, "c1", "c2", "label").collect()) == want


def test_chains_of_any_size(spark, tmp_path):
    texts = ["Planet and garden. " * 9 + "Planet here, meadow. " * 3 + "Meadow.", "Window. " * 40, "Single mention, planet."]
    d = folder(spark, tmp_path, texts)
    got = V.mentions(spark, d).collect()
    want = Counter((i, w) for i, t in enumerate(texts) for w in re.findall("[a-z]{6,}", t.lower()))
    assert Counter((m.doc_id, m.tok.lower()) for m in got) == {k: n for k, n in want.items() if n > 1}
    assert len({(m.doc_id, m.chain_id) for m in got}) == 4
    at = lambda m: (m.doc_id, m.sentence_id, m.token_id)
    pred = {at(m): m.pred_id for m in V.predicted(spark, d).collect()}
    zeros = {at(m) for m in got if m.is_zero}
    rows = {at(m): m for m in got}
    detail = corpus_plans.zero_detail(spark, d).collect()
    assert {at(x) for x in detail} == zeros
    for x in detail:
        others = [k for k in rows if k[0] == x.doc_id and k not in zeros]
        gold = {k for k in others if rows[k].chain_id == rows[at(x)].chain_id}
        said = {k for k in others if k in pred and pred[k] == pred.get(at(x), -1)}
        assert (x.covered, x.gold_pairs, x.pred_pairs, x.correct_pairs) == (at(x) in pred, len(gold), len(said), len(gold & said))
    audit = M.literal_audit(V.mentions(spark, d), V.predicted(spark, d), V.mentions(spark, d).where("is_zero").select(*M.SPAN)).collect()
    assert {at(x) for x in audit} == zeros
    for x in audit:
        same = [k for k in rows if k[0] == x.doc_id and k != at(x) and rows[k].chain_id == rows[at(x)].chain_id]
        hit = [k for k in same if at(x) in pred and pred.get(k) == pred[at(x)]]
        assert (x.n_prior, x.antecedent_hit, x.co_cluster_hit) == (sum(k < at(x) for k in same), any(k < at(x) for k in hit), bool(hit))


def test_windows_of_298_tokens(spark, tmp_path):
    text = "Planet " + "is so " * 148 + "planet " + "we go " * 10 + "planet."
    d = folder(spark, tmp_path, [text])
    got = {(x.t1, x.t2): (x.w_start, x.w_stop, x.local1, x.local2) for x in pair_plans.pair_windows(spark, d).collect()}
    assert set(got) == {(0, 297), (297, 318)} and got[0, 297] == (0, 298, 0, 297)
    assert [tuple(x)[-1] for x in pair_plans.pair_rejected_long(spark, d).collect()] == [319]


def test_topics_up_to_the_quota(spark, tmp_path):
    d = folder(spark, tmp_path, ["One text."] * 650)
    target = {x.domain: x.target for x in text_plans.quota_targets(spark, d).collect()}
    got = Counter(x.domain for x in text_plans.topic_plan(spark, d).collect())
    assert max(target.values()) > 25 and got == {k: n for k, n in target.items() if n}
