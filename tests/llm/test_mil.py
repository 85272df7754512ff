import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import mil, textnp
from tests.conftest import SF


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_held_out_accuracy(spark):
    out = mil.quality_scores(table(spark, "documents"), table(spark, "labels")).join(table(spark, "labels"), "doc_id").toPandas()
    assert (out.held_out == out.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    held = out[out.held_out]
    assert len(held) > 60
    assert (held.predicted == held.quality).mean() > 0.93
    assert held[held.quality == 1].predicted.mean() > 0.95
    assert ((out.score >= 0.7).astype(int) == out.predicted).all()


def test_only_the_text_matters_and_odd_rows_are_defined(spark):
    docs = table(spark, "documents")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "x"), (4, "word " * 50_000), (5, "x" * 300_000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").limit(200).unionByName(odd).withColumn("label", F.lit("z"))
    got = mil.quality_scores(both, table(spark, "labels")).toPandas()
    assert len(got) == 206 and got.score.between(0, 1).all()
    model = mil.fit(docs, table(spark, "labels").select("doc_id", F.col("quality").alias("label")))
    blank = mil.score(odd.where("doc_id < 4"), model).toPandas().score
    assert blank.nunique() == 1


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [tuple(x)[1:] for x in mil.quality_scores(docs, labels).collect()] == [(False, 0.5, 0)]
    assert mil.quality_scores(docs.limit(0), table(spark, "labels")).collect() == []


def test_gradient_matches_differences():
    r = np.random.default_rng(0)
    bags = [r.normal(size=(n, mil.FEATURES)) for n in (1, 3, 7)]
    model = mil.train(bags, np.array([0.0, 1.0, 1.0]), epochs=1)
    x, bag, y = (np.concatenate(bags) - model.mean) * model.scale, np.array([0, 1, 4, 11]), np.array([0.0, 1.0, 1.0])
    loss = lambda: -np.mean(y * np.log(model.forward(x, bag)["y"]) + (1 - y) * np.log(1 - model.forward(x, bag)["y"]))
    g = model.gradient(x, bag, y, 0.0)
    for k in "wbvuac":
        at = tuple(0 for _ in model.weights[k].shape)
        kept = model.weights[k][at]
        model.weights[k][at] = kept + 1e-5
        up = loss()
        model.weights[k][at] = kept - 1e-5
        down = loss()
        model.weights[k][at] = kept
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-5, k


def test_attention_sees_every_passage():
    x, bag = mil.passages(*[(raw, off) for _, _, raw, off in textnp.batches(pa.array(["a " * 129, "", "b"]))][0])
    assert bag.tolist() == [0, 3, 4, 5] and len(x) == 5


def brute_features(text):
    """The features of each passage, word by word."""
    data = (text or "").encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    out = []
    for at in range(0, max(1, len(found)), mil.PASSAGE):
        own = found[at : at + mil.PASSAGE]
        row = [0.0] * mil.FEATURES
        if own:
            stop = found[at + mil.PASSAGE][0] if at + mil.PASSAGE < len(found) else len(data)
            body = data[own[0][0] : stop]
            classes = mil._byte_classes()
            for c, n in Counter(int(classes[b]) for b in body).items():
                row[c] = math.sqrt(n / len(body))
            words = [data[a:b] for a, b in own]
            size = [len(w) for w in words]
            mean = sum(size) / len(size)
            caps = sum(sum(65 <= c <= 90 for c in w) >= 2 and not any(97 <= c <= 122 for c in w) for w in words)
            row[-7:] = [
                mean / 10,
                math.sqrt(max(0.0, sum(n * n for n in size) / len(size) - mean**2)) / 10,
                math.log1p(max(size)) / 5,
                math.log1p(len(size)) / 5,
                (len(words) - len(set(words))) / len(words),
                caps / len(words),
                math.log1p(len(body)) / 8,
            ]
        out.append(row)
    return out


def brute_score(model, rows):
    p = {k: np.asarray(v).tolist() for k, v in model.weights.items()}
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    times = lambda v, m: [sum(a * b for a, b in zip(v, col, strict=True)) for col in zip(*m, strict=True)]
    hidden, gate = [], []
    for row in rows:
        x = [(v - m) * s for v, m, s in zip(row, model.mean, model.scale, strict=True)]
        h = [math.tanh(v + b) for v, b in zip(times(x, p["w"]), p["b"], strict=True)]
        hidden.append(h)
        gate.append(sum(math.tanh(t) * sigmoid(g) * a for t, g, a in zip(times(h, p["v"]), times(h, p["u"]), p["a"], strict=True)))
    weight = [math.exp(g - max(gate)) for g in gate]
    z = [sum(w * h[i] for w, h in zip(weight, hidden, strict=True)) / sum(weight) for i in range(mil.HIDDEN)]
    return sigmoid(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["d"])


def test_scores_match_brute_force(spark):
    docs = table(spark, "documents")
    model = mil.fit(docs, table(spark, "labels").select("doc_id", F.col("quality").alias("label")), sample=300)
    texts = [x.text for x in docs.orderBy("doc_id").limit(40).collect()] + [None, "", " \n", "A BC déf GH! 12 Ü ÜBER", "x " * 64, "x " * 65]
    got = [x.score for x in sorted(mil.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect())]
    for text, value in zip(texts, got, strict=True):
        rows = brute_features(text)
        raw, offsets = next((r, o) for _, _, r, o in textnp.batches(pa.array([text], pa.string())))
        x, _ = mil.passages(raw, offsets)
        first, last = mil.CLASSES, mil.CLASSES + mil.PAIR_BUCKETS
        assert np.allclose(x[:, :first], np.array(rows)[:, :first]) and np.allclose(x[:, last:], np.array(rows)[:, last:])
        full = [[*row[:first], *own[first:last], *row[last:]] for row, own in zip(rows, x.tolist(), strict=True)]
        assert abs(brute_score(model, full) - value) < 1e-9


def test_repeated_ids_and_bounds(spark):
    docs, labels = table(spark, "documents").select("doc_id", "text"), table(spark, "labels").select("doc_id", F.col("quality").alias("label"))
    twice = docs.unionByName(docs.select("doc_id", F.concat("text", F.lit(" MORE")).alias("text")))
    runs = [mil.fit(x, labels, sample=200) for x in (twice, twice.orderBy(F.desc("doc_id"), F.desc("text")).repartition(5))]
    assert all(np.array_equal(runs[0].weights[k], runs[1].weights[k]) for k in runs[0].weights)
    seen = {}
    mil_train = mil.train
    try:
        mil.train = lambda bags, y: seen.update(n=sum(map(len, bags)), docs=len(y))
        mil.fit(docs, labels, sample=200, most_passages=500)
    finally:
        mil.train = mil_train
    assert 450 < seen["n"] <= 500 and seen["docs"] < 200


def test_clashing_and_odd_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b.", -5.0, ("x",))], "doc_id long, text string, Score double, `a b:c` struct<`d e`: string>")
    model = mil.Model(np.array([0.9]), np.ones(1), {})
    row = mil.score(docs, model, "mine").first()
    assert row.Score == -5.0 and row.mine == 0.9 and row["a b:c"]["d e"] == "x"
