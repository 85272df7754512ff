import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm.mixing import mix, mixed_documents, random_key

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes):
    """Targets by resharing again and again until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = left - sum(capped.values())
        want = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if want[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return capped | want
        capped |= {s: 2.0 * sizes[s] for s in over}


def corpus(seed):
    r = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 40]))), r.choice(["a", "a", "a", "b", "B", "é", "c", None])) for i in range(300)]
    return [*rows, (300, None, "a"), (301, "x " * 9000, "long"), (7, rows[7][1], rows[7][2]), (None, "no id here", "a"), (302, "", "blank")]


def test_targets_and_budgets(spark):
    for seed in range(3):
        rows = corpus(seed)
        docs = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, source string, size int")
        got = mix(docs, ranges=16).collect()
        sizes, taken = defaultdict(int), defaultdict(int)
        for _, t, s in rows:
            sizes[s] += len(WORD.findall(t or ""))
        want = fill(sizes)
        assert len(got) == len(rows)
        for x in got:
            taken[x.source] += x.taken
            assert 0 <= x.taken <= 2 * x.size and x.source_size == sizes[x.source]
            assert abs(x.target - want[x.source]) < 1e-6
        for s in sizes:
            assert taken[s] == int(want[s] + 1e-9) or abs(taken[s] - want[s]) <= 1
        assert sorted(map(tuple, mix(docs, ranges=7).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_documents_of_the_mix(spark):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for x in out.collect():
        words[x.doc_id] += len(WORD.findall(x.text))
    expected = defaultdict(int)
    for x in mix(docs).collect():
        expected[x.doc_id] += x.taken
    assert words == {k: v for k, v in expected.items() if v}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(docs).collect() == [] and mixed_documents(docs).collect() == []


def test_keys_spread(spark):
    keys = [x.k for x in spark.range(500).select(random_key(F.col("id"), F.lit("t"), 0).alias("k")).collect()]
    assert len(set(keys)) == 500 and abs(sum(k < 1 << 59 for k in keys) - 250) < 60


def test_rows_without_doc_id_spread_and_ties_at_the_cut_rerun_alike(spark):
    rows = [(None, f"t {i}", "a", i) for i in range(300)] + [(7, "one two three", "b", i) for i in range(40)] + [(7, "one two four", "b", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, `x y` int")
    keys = table.where("doc_id IS NULL").select(random_key(F.col("doc_id"), F.col("text"), 0).alias("k"))
    assert keys.distinct().count() == 300
    first, again = (sorted(map(tuple, mixed_documents(t, share=0.5).collect()), key=str) for t in (table, table.orderBy(F.desc("x y")).repartition(7)))
    assert first == again and len(first) > 50
