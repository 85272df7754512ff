import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from tessera.llm.spans import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    """(start of the sentence in the text, its words)"""
    out, words = [], []
    found = list(WORD.finditer(text))
    for i, m in enumerate(found):
        if not words:
            start = m.start()
        words.append(m.group())
        gap = text[m.end() : found[i + 1].start()] if i + 1 < len(found) else "\n"
        bare = m.group()
        for _ in range(3):
            if len(bare) > 1 and bare[-1] in "\"')]}":
                bare = bare[:-1]
        if bare[-1] in ".!?…。！？,;:，、；：" or "\n" in gap:
            out.append((start, words))
            words = []
    return out


def tag(text):
    return int(np.uint64(xxhash.xxh64((text or "").encode(), seed=42).intdigest()).view(np.int64))


def brute(rows, k=2, least=30, long=50):
    parts = {(d, tag(t)): split(t or "") for d, t in rows if d is not None}
    seen = defaultdict(set)
    for d, s in parts.items():
        enough = lambda a, b: (b - a + 1 >= k and (w := sum(len(x[1]) for x in s[a : b + 1])) >= least) or sum(len(x[1]) for x in s[a : b + 1]) >= long
        for i in range(len(s)):
            for e in range(i, len(s)):
                if enough(i, e):
                    seen[tuple(w for x in s[i : e + 1] for w in x[1])].add((d, i, e))
                    break
            for b in range(i, -1, -1):
                if enough(b, i):
                    seen[tuple(w for x in s[b : i + 1] for w in x[1])].add((d, b, i))
                    break
    gone = defaultdict(set)
    for at in seen.values():
        first = min((d, a) for d, a, _ in at)  # d: (doc_id, tag)
        for d, a, e in at:
            if (d, a) != first:
                gone[d] |= set(range(a, e + 1))
    out = []
    for d, t in rows:
        own = gone[d, tag(t)]
        if d is None or not own:
            out.append((d, t, 0))
            continue
        s = parts[d, tag(t)]
        edge = [0, *(x[0] for x in s[1:]), len(t)]
        out.append((d, "".join(t[edge[i] : edge[i + 1]] for i in range(len(s)) if i not in own), len(own)))
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 6)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + r.choice([".", "!", "?", "…", '."', ",", ";", "，"])
    para = lambda m: r.choice([" ", "\n"]).join(sentence(r.randint(1, 14)) for _ in range(m))
    shared = [para(r.randint(1, 12)) for _ in range(8)] + [sentence(60), sentence(49)]
    rows = []
    for d in range(80):
        parts = [para(r.randint(0, 6)) for _ in range(2)]
        for _ in range(r.choice([0, 1, 2, 2])):
            parts.insert(r.randint(0, 2), r.choice(shared))
        rows.append((d, r.choice([" ", "\n", "\n\n", "  "]).join(parts)))
    return [*rows, (200, None), (201, ""), (202, " \n "), (None, shared[0]), (203, rows[3][1]), (204, "One two. " * 20000), (205, ("x" * 99 + " ") * 3000)]


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, hash int")
    got = sorted(((x.doc_id, x.text, x.n_removed) for x in substring_dedup(docs).collect()), key=str)
    assert got == brute(rows)
    assert sum(x[2] > 0 for x in got) > 20


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_passage_stays_once(spark):
    r = random.Random(1)
    passage = " ".join(" ".join(f"p{r.randrange(999)}" for _ in range(6)) + "." for _ in range(10))
    rows = [(i, " ".join(f"u{i}x{k}." for k in range(9)) + "\n" + passage) for i in range(30)]
    out = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [x.doc_id for x in out if passage in x.text] == [0]
    assert all(f"u{x.doc_id}x0." in x.text and f"u{x.doc_id}x8." in x.text for x in out)


def test_one_doc_id_with_different_texts(spark):
    r = random.Random(2)
    long = " ".join(" ".join(f"a{r.randrange(9999)}" for _ in range(6)) + "." for _ in range(9))
    other = " ".join(" ".join(f"b{r.randrange(9999)}" for _ in range(6)) + "." for _ in range(12))
    rows = [(1, long), (2, "Short."), (2, long), (2, other), (3, other + " " + long), (2, other), (4, None), (4, other)]
    got = sorted(((x.doc_id, x.text, x.n_removed) for x in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)
    assert sum(t == other for _, t, _ in got) == 2 and (2, "Short.", 0) in got


def test_passage_that_begins_and_ends_inside_sentences(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(10**6)}"
    clause = lambda n: " ".join(word() for _ in range(n)) + ","
    passage = " ".join([word(), word(), clause(3), clause(14), clause(15), clause(12), word(), word()])
    rows = [(i, f"{clause(9)} {word()} {passage} {word()} {clause(8)}") for i in range(3)]
    got = {x.doc_id: x for x in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_words_removed == 41 for i in (1, 2))


def test_odd_column_names_are_carried(spark):
    docs = spark.createDataFrame([(1, "a b.", ("x", 2), 5, 6)], "doc_id long, text string, `a b:c` struct<`d e`: string, `f:g`: int>, `tag` int, `x.y` int")
    row = substring_dedup(docs, carry=True).first()
    assert row.text == "a b." and row.row.asDict(True) == {"a b:c": {"d e": "x", "f:g": 2}, "tag": 5, "x.y": 6}
