import random
import re
from collections import Counter

import corpus_pipeline

from tessera.llm.jaccard import jaccard_join, least_matches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, k=5):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, t=0.8):
    sets = [(d, grams(x)) for d, x in rows]
    links, root = Counter(), {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (di, a) in enumerate(sets):
        for j in range(i):
            dj, b = sets[j]
            if di is None or dj is None or not a or not b:
                continue
            s = len(a & b)
            if s >= t * (len(a) + len(b) - s):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y, key=lambda k: sets[k][0])] = min(x, y, key=lambda k: sets[k][0])
    out = []
    for i, (d, _) in enumerate(sets):
        members = [sets[k][0] for k in range(len(rows)) if find(k) == find(i)]
        out.append((d, min(members) if d is not None else None, links[i]))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 160))] for _ in range(60)]
    rows, n = [], 0
    for w in base:
        for _ in range(r.choice([1, 1, 2, 4])):
            v = list(w)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                v[r.randrange(len(v))] = r.choice(vocabulary)
            rows.append((n, r.choice([" ", "\n", "  "]).join(v)))
            n += 1
    hot = [r.choice(vocabulary) for _ in range(150)]
    for _ in range(120):
        v = list(hot)
        v[r.randrange(len(v))] = r.choice(vocabulary)
        rows.append((n, " ".join(v)))
        n += 1
    return [*rows, (n, ""), (n + 1, None), (None, "a b c d e f g"), (0, rows[0][1]), (n + 2, "word " * 30000), (n + 3, "é ü ñ 漢字 😀 ok")]


def test_matches_brute_force_also_with_split_cells(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, k1 string")
    for chunk in (1024, 16):
        got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(docs, chunk=chunk).collect()), key=str)
        assert got == brute(rows)


def test_empty_table(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pruning_keeps_pairs_at_the_threshold():
    from math import comb

    fewest = least_matches(0.8, 1e-7)
    for n in (32, 64, 96, 128):
        assert sum(comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(fewest[n])) < 1e-6


def test_one_doc_id_with_different_texts(spark):
    r = random.Random(9)
    words = [[f"{x}{r.randrange(9999)}" for _ in range(60)] for x in "ab"]
    near = [[*w[:30], "new", *w[31:]] for w in words]
    a, b, c, d = (" ".join(w) for w in (*words, *near))
    for rows in ([(1, a), (1, b), (2, c), (3, d)], [(1, a), (1, b), (1, c), (2, b), (2, d), (2, d)], [(5, a), (5, b), (4, d), (5, "alone in it"), (6, c), (4, c)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(((x.doc_id, x.class_id, x.n_links) for x in jaccard_join(docs).collect()), key=str) == brute(rows)
        kept = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()))
        first = {k: min(i for i, t in rows if t in pair) for k, pair in {"a": (a, c), "b": (b, d)}.items()}
        assert len(kept) == len({t for _, t in rows if t not in (a, b, c, d)}) + 2
        assert all(any((first[k], t) in kept for t in pair) for k, pair in {"a": (a, c), "b": (b, d)}.items())
