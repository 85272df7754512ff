import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup
from tests.conftest import SF


def brute(rows, t=0.93):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and np.any(v) and l is not None and i is not None for i, v, l in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (i, v, l), o in zip(rows, ok, strict=True)]
    n = len(rows)
    near = [[b for b in range(n) if b != a and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= t] for a in range(n)]
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        root = rows[a][0] if rows[a][0] is None else min(rows[b][0] for b in seen)
        out.append((rows[a][0], len(near[a]), root, rows[a][0] is None or root == rows[a][0]))
    return sorted(out, key=str)


def vectors(seed):
    r = np.random.default_rng(seed)
    rows, n = [], 0
    for _ in range(60):
        base = r.normal(size=8)
        for _ in range(r.choice([1, 1, 3, 8])):
            rows.append((n, (base + r.normal(size=8) * r.choice([0, 0.02, 0.15])).astype(np.float32).tolist(), int(r.integers(0, 3))))
            n += 1
    hot = r.normal(size=8).astype(np.float32).tolist()
    rows += [(n + i, hot, 1) for i in range(40)] + [(n + 40 + i, [x * 2 for x in hot], 1) for i in range(3)]
    n += 50
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [1.0, 2.0]]
    return [*rows, *((n + i, v, 1) for i, v in enumerate(odd)), (n + 20, hot, None), (None, hot, 1), rows[0], (n + 21, [1e-30] * 8, 2), (n + 22, [1e30] * 8, 2)]


@pytest.mark.parametrize("seed", [0, 1])
def test_matches_brute_force_also_in_small_blocks(spark, monkeypatch, seed):
    rows = vectors(seed)
    table = spark.createDataFrame([(*x, 9) for x in rows], "vec_id long, embedding array<float>, label int, k1 int")
    for block, cell in ((2048, 1024), (7, 16)):
        monkeypatch.setattr(neardup, "CELL", cell)
        got = sorted((tuple(x) for x in neardup.embedding_near_dedup(table, block=block).collect()), key=str)
        assert got == brute(rows)


def test_large_cells_are_clustered_again(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows, n = [], 0
    for _ in range(25):
        base = r.normal(size=8)
        for _ in range(16):
            rows.append((n, (base + r.normal(size=8) * 0.12).astype(np.float32).tolist(), 1))
            n += 1
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(neardup, "CELL", 40)
    monkeypatch.setattr(neardup, "MOST_CELLS", 3)  # at most three cells a level, so that cells stay large
    monkeypatch.setattr(neardup, "SPLIT", 3)
    levels = []
    whole = neardup._set_blocks
    monkeypatch.setattr(neardup, "_set_blocks", lambda *a: levels.append(a) or whole(*a))
    got = sorted((tuple(x) for x in neardup.embedding_near_dedup(table, block=8).collect()), key=str)
    assert got == brute(rows) and sum(x[1] > 0 for x in got) > 100
    assert len(levels) > 2


def test_whole_table_has_every_link(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = neardup.embedding_near_dedup(spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("rep", F.lit(1)))
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert neardup.embedding_near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_one_vec_id_with_different_vectors_and_labels(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = lambda v: [c + 0.1 for c in v]
    rows = [(1, x, "a"), (1, y, "a"), (2, near(x), "a"), (3, near(y), "a"), (1, x, "b"), (4, near(x), "b"), (4, near(x), "b"), (1, x, "a")]
    got = neardup.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows)


def test_tight_clusters_visit_few_cells(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    x = np.repeat(base, 30, axis=0) + r.normal(size=(1200, 32)) * 0.02
    c = neardup.spherical_kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), 40)
    import pandas as pd

    part = pd.DataFrame({"vector": [v.astype("<f4").tobytes() for v in x], "dim": 32})
    (placed,) = neardup._place(c, 0.93, "<f4")(iter([part]))
    assert placed.visits.map(len).mean() < 20
