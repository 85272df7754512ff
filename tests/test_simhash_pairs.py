"""SimHash pairs by document: what is shuffled, and doc_ids of several texts."""

import random

from tessera.functions import text as T
from tessera.operators import dedup as D
from tessera.plans import text_plans


def words(r, n):
    return " ".join("".join(r.choice("abcd") for _ in range(3)) for _ in range(n))


def rows_of(r, ids):
    base = [words(r, 30) for _ in range(6)]
    return [(k, " ".join([r.choice(base), words(r, r.choice([0, 1, 2]))]).strip()) for k in ids]


def near(reps):
    sig = {tuple(x.rep): x.s & (2**64 - 1) for x in reps.select("rep", T.simhash("text").alias("s")).collect()}
    out = {}
    for a in sig:
        for b in sig:
            if a[0] < b[0] and (n := bin(sig[a] ^ sig[b]).count("1")) <= 8:
                out[a[0], b[0]] = min(n, out.get((a[0], b[0]), 64))
    return out


def test_no_pair_is_shuffled(spark, tmp_path):
    spark.createDataFrame(rows_of(random.Random(5), range(60)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = text_plans.simhash_pairs(spark, str(tmp_path))
    above = got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in above and "Join" not in above
    want = near(D.representatives(spark.read.parquet(f"{tmp_path}/documents.parquet"))[1])
    assert {(x.doc_a, x.doc_b): x.hamming for x in got.collect()} == want and want and got.columns == ["doc_a", "doc_b", "hamming"]


def test_a_pair_of_several_texts_is_told_once(spark, tmp_path):
    spark.createDataFrame(rows_of(random.Random(6), [*range(40), *range(0, 40, 3), *range(0, 40, 9)]), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = text_plans.simhash_pairs(spark, str(tmp_path)).collect()
    want = near(D.representatives(spark.read.parquet(f"{tmp_path}/documents.parquet"))[1])
    assert {(x.doc_a, x.doc_b): x.hamming for x in got} == want and len(got) == len(want)
