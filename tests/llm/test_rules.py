import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import rules
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    repeat = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), len(lines), sum("A" <= c <= "Z" for c in text))


def corpus():
    r = random.Random(4)
    rows = []
    for i in range(150):
        words = [r.choice(["aa", "é", "漢字", "B#", "x|y", "ok."]) for _ in range(r.choice([0, 5, 7, 8, 9, 15, 60]))]
        if i % 3 == 0:
            words += words[: r.choice([8, 9, 20])]
        rows.append((i, "".join(x + r.choice([" ", "\n", "\t ", "\n\n", " "]) for x in words), r.choice(["en", "fr", None])))
    return [*rows, (900, None, "en"), (901, "", "en"), (902, "same line\n" * 5000, "en"), (903, " ".join(map(str, range(30000))), "en"), (None, "a b", "en"), rows[3]]


def test_metrics_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, words int")
    got = rules.metrics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, *measured(t)) for d, t, _ in rows), key=str)


def tail(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_binomial_tail_is_exact(spark):
    rows = [(k, n) for n in (1, 10, 400, 3000) for k in (0, 1, 2, 7, 14) if k <= n]
    for p in (0.005, 0.05):
        got = spark.createDataFrame(rows, "k long, n long").select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), p).alias("p")).collect()
        for x in got:
            assert x.p == 1.0 if x.k >= x.n * p else abs(x.p - tail(x.k, x.n, p)) < 1e-9 * max(x.p, 1e-300) + 1e-15
    many = spark.createDataFrame([(9000, 2_000_000)], "k long, n long").select(rules.binomial_tail(F.col("k"), F.col("n"), 0.005).alias("p")).first().p
    fewer = spark.createDataFrame([(9000, 2_000_000)], "k long, n long").select(rules.binomial_tail(F.col("k"), F.col("n"), 0.005, 50).alias("p")).first().p
    assert 0 < many <= fewer * (1 + 1e-9)


def brute_levels(rows, labels, risk, delta):
    good = {d for d, q in labels if q == 1}
    above = defaultdict(list)
    for d, t, s in rows:
        n, chars, sym, dup, rep, lines, up = measured(t)
        if d in good and n >= 20 and 100 * rep <= 30 * n:
            value = {"symbols": (sym, chars), "upper": (up, chars), "dup_lines": (dup, lines), "repeats": (rep, n), "word_length": (chars, n)}
            above[s].append(max(sum(a / b > c for c in rules.RULES[k][1]) for k, (a, b) in value.items()))
    out = {}
    for s, v in above.items():
        for level in reversed(range(rules.LEVELS)):
            if tail(sum(x > level for x in v), len(v), risk) > delta / len(above):
                break
            out[s] = level
    return out


def test_levels_are_the_strictest_certified_ones(spark):
    r = random.Random(8)
    text = lambda sym: " ".join(r.choice(["word", "other", "more"]) + ("#" if r.random() < sym else "") + str(r.random())[2:6] for _ in range(40))
    rows = [(i, text(0.02 if i % 4 else 0.9), "en" if i % 5 else None if i % 3 else "fr") for i in range(1500)]
    labels = [(i, int(i % 4 > 0)) for i in range(1500)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    for risk in (0.02, 0.03, 0.2):
        got = {x.stratum: x.level for x in rules.levels(rules.metrics(docs), marks, risk, 0.05).collect()}
        assert got == brute_levels(rows, labels, risk, 0.05) and "en" in got
    out = rules.quality_rules(docs, marks, 0.03, 0.05).collect()
    assert all(x.doc_id % 4 or x.doc_id % 5 == 0 or not x.kept for x in out)
    assert sum(x.kept for x in out if x.doc_id % 4) >= 0.97 * 1125


def test_rules_decide_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(x) for x in docs.select("doc_id", "text", "lang").collect()]
    want = brute_levels(rows, [tuple(x) for x in labels.select("doc_id", "quality").collect()], rules.RISK, rules.DELTA)
    got = {x.stratum: x.level for x in rules.levels(rules.metrics(docs), labels).collect()}
    assert got == want and got
    assert any(not x.kept and not x.base_failed for x in rules.quality_rules(docs, labels).collect())


def test_without_labels_only_the_base_decides(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    out = rules.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(out) == len(corpus()) and all(x.kept != x.base_failed for x in out)
    assert rules.quality_rules(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect() == []
