"""Global token numbers against counting, in rows and in nested documents."""

import random

import numpy as np
import pytest

from tessera.operators import pairs as P
from tessera.operators import tokens as N


def test_rows_and_nested_documents_count_alike(spark):
    r = random.Random(2)
    docs = [(f"d{k}", [[f"t{k}{s}{t}" for t in range(r.choice([0, 1, 3]))] if r.random() < 0.9 else None for s in range(r.randrange(0, 6))]) for k in range(30)]
    want = {}
    for key, sentences in docs:
        idx = 0
        for s, own in enumerate(sentences):
            for t, tok in enumerate(own or []):
                want[key, s + 1, t] = (idx, tok)
                idx += 1
    nested = N.nested_tokens(spark.createDataFrame(docs, "doc_key string, sentences array<array<string>>")).collect()
    assert {(x.doc_key, x.sentence_id, x.token_id): (x.idx, x.tok) for x in nested} == want and len(nested) == len(want)
    rows = spark.createDataFrame([(*key, tok) for key, (_, tok) in want.items()], "doc_id string, sentence_id int, token_id int, tok string")
    assert {(x.doc_id, x.sentence_id, x.token_id): (x.idx, x.tok) for x in N.global_index(rows, "tok").collect()} == want
    starts = {(x.doc_id, x.sentence_id): x.start for x in N.sentence_starts(rows).collect()}
    assert starts == {(d, s): idx for (d, s, t), (idx, _) in want.items() if t == 0}


def test_gaps_in_token_ids(spark):
    rows = spark.createDataFrame([("d", 2, 5), ("d", 2, 9), ("d", 7, 0)], "doc_id string, sentence_id int, token_id int")
    assert sorted((x.sentence_id, x.token_id, x.idx) for x in N.global_index(rows).collect()) == [(2, 5, 0), (2, 9, 1), (7, 0, 2)]


def test_scores_as_many_as_pairs(spark):
    pairs = spark.createDataFrame([(1, 0.2), (2, 0.9)], "id int, x double").coalesce(1)
    got = {r.id: r.pred for r in P.score_pairs(pairs, lambda b: np.where(b.id == 1, np.nan, b.x)).collect()}
    assert got == {1: False, 2: True}
    with pytest.raises(Exception, match="1 scores for 2 pairs"):
        P.score_pairs(pairs, lambda b: b.x.to_numpy()[:1]).collect()
