import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, x int"


def brute(rows, entries=256, rounds=4):
    """(vec_id, code, error, label_error) of each kept row, in Python's integers, and the codebooks' digest."""
    ok = [(i, v, l) for i, v, l in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v, _ in ok if v and len(v) % 4 == 0]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    whole = [[math.floor(Fraction(c) * 1024) for c in v] for _, v, _ in ok]
    first = sorted((ok[r][0], ok[r][1], r) for r in range(len(ok)) if dim and len(ok[r][1]) == dim and ok[r][0] is not None)[:entries]
    w = dim // 4
    cut = lambda r, p: whole[r][p * w : (p + 1) * w]
    books = [[cut(r, p) for *_, r in first] for p in range(4)]
    near = lambda r, p: min((sum((a - b) ** 2 for a, b in zip(cut(r, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    mine = [r for r in range(len(ok)) if first and len(ok[r][1]) == dim]
    for _ in range(rounds if first else 0):
        for p in range(4):
            groups = {}
            for r in mine:
                groups.setdefault(near(r, p)[1], []).append(cut(r, p))
            for k, own in groups.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for r, (i, _, l) in enumerate(ok):
        found = [near(r, p) for p in range(4)] if r in mine else None
        error = sum(d for d, _ in found) if found else None
        out.append([i, "".join(f"{k:02x}" for _, k in found) if found else None, error if error is None or error < 2**63 else None, l])
    sums = {}
    for _, _, error, label in out:
        if error is not None:
            sums[label] = sums.get(label, 0) + error
    sums = {label: s for label, s in sums.items() if s < 2**63}
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return sorted(((i, c, e, sums.get(l)) for i, c, e, l in out), key=str), digest


def run(spark, rows, partitions=5):
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA).repartition(partitions)
    found = codes.vector_codes(table).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found), key=str), {r.codebooks_sha256 for r in found}


def made(seed, n, scale=1.0):
    r = np.random.default_rng(seed)
    return [(int(i), (r.normal(size=8) * scale).tolist(), int(r.integers(0, 3))) for i in r.permutation(n)]


@pytest.mark.parametrize("scale", [0.01, 1.0, 1e6, 1e30])
def test_matches_brute_force_at_any_magnitude(spark, scale):
    rows = made(3, 300 if scale < 1e6 else 40, scale)
    want, digest = brute(rows)
    assert run(spark, rows) == (want, {digest})


def test_odd_rows(spark):
    base = made(5, 20)
    odd = [None, [], [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0, 3.0, 4.0], [1.0] * 6]
    rows = [*base, *((50 + k, v, 1) for k, v in enumerate(odd)), (None, [0.5] * 8, None), (70, [0.25] * 8, None), base[0], (base[1][0], [-0.001] * 8, 2)]
    want, digest = brute(rows)
    assert run(spark, rows) == (want, {digest})


def test_ties_go_to_the_lower_entry_and_unused_entries_stay(spark):
    rows = [(i, [0.0] * 8, 0) for i in range(300)]
    got, _ = run(spark, rows)
    assert {c for _, c, *_ in got} == {"00000000"}
    rows += [(900, [1.0] * 8, 0)]
    want, digest = brute(rows)
    assert run(spark, rows) == (want, {digest})


def test_no_vector_ids_and_empty(spark):
    assert [r.code for r in codes.vector_codes(spark.createDataFrame([(None, [1.0] * 8, 1)], "vec_id long, embedding array<float>, label int")).collect()] == [None]
    assert codes.vector_codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_decoding_is_within_the_error(spark):
    rows = made(7, 400)
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA)
    found, books = codes.compress(table, entries=16)
    vectors = {i: np.floor(np.array(v) * 1024) for i, v, _ in rows}
    for r in found.collect():
        assert round(float(np.sum((codes.decode(r.code, books) * 1024 - vectors[r.vec_id]) ** 2))) == r.error
