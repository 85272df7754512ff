import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import private, textnp
from tests.conftest import SF

SCHEMA = "doc_id long, text string, term long, row int"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    doubled = [int(d) * 2 if k % 2 else int(d) for k, d in enumerate(digits[::-1])]
    return sum(sum(map(int, str(d))) for d in doubled) % 10 == 0


def patterns(text):
    """(start, kind, end, value) by the patterns as they are stated."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end(), m[0].lower()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), m[0]) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), digits(m[0])) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and plain_luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end(), digits(m[0])) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def hashed(term):
    raw = np.frombuffer(term.encode(), dtype=np.uint8)
    return int(textnp.word_hashes(raw, np.array([0]), np.array([len(raw)])).view(np.int64)[0])


def folded(term):
    return "".join(c.lower() if c.isascii() else c for c in term)


def brute(rows, alpha=private.ALPHA, contexts=private.CONTEXTS, window=private.WINDOW):
    """doc_id, counts, digest and spans of each row, and the terms that disclose, by counting in dictionaries."""
    found, occurrences, joint, seen, mass = [], defaultdict(int), defaultdict(int), defaultdict(set), defaultdict(int)
    for _, text in rows:
        text = text or ""
        base = patterns(text)
        terms = [(m.start(), m.end(), folded(m[0])) for m in re.finditer(r"[A-Za-z0-9_\x80-\U0010ffff]+", text)]
        for *_, t in terms:
            occurrences[t] += 1
        free = [t for t in terms if not any(t[0] < e and t[1] > s for s, _, e, _ in base)]
        beside = defaultdict(set)
        for s, kind, e, value in base:
            own = [t for t in free if t[1] <= s][-window:] + [t for t in free if t[0] >= e][:window]
            beside[kind, value] |= set(own)
            for t in {t[2] for t in own}:
                seen[(kind, value), t].add(min((hashed(o) for *_, o in own if o != t), default=0))
        for entity, own in beside.items():
            mass[entity] += len(own)
            for *_, t in own:
                joint[entity, t] += 1
        found.append((base, free))
    total = sum(occurrences.values())
    telling = set()
    for (entity, t), n in joint.items():
        p, k = mass[entity] / total, len(seen[entity, t])
        if k >= contexts and math.log2(k / (k + occurrences[t] - n) / p) >= -alpha * math.log2(p) - 1e-12:
            telling.add(t)
    out = []
    for (doc, _), (base, free) in zip(rows, found, strict=True):
        write = lambda spans: ",".join(f"{(*private.KINDS, 'term')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        own = [(s, k, e) for s, k, e, _ in base]
        counts = [sum(k == kind for _, k, _ in own) for kind in range(4)]
        out.append((doc, *counts, hashlib.sha256(write(own).encode()).hexdigest(), write(own + [(s, 4, e) for s, e, t in free if t in telling])))
    return sorted(out, key=str), telling


def run(spark, rows, partitions=4):
    table = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA).repartition(partitions)
    return sorted(map(tuple, private.personal_data(table).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()), key=str)


TRICKY = [
    "a@b.com_x@c.org..d@e", "@b.com x@@y.com x@y", "a@b.c.d.-.e@f.g", "%+-@-.-", "1.2.3.4.5.6.7.8.9", "256.1.1.1 0.0.0.0255 1.2.3", "1..2.3.4.5", "00000255.1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "41111111111111111111111", "4111  1111", "+1 (017) 555-7713", "++1 (017) 555-77139999999", "+1-----", "+12345", "+123456789012345. +1234567890",
    "１２３ +4420 7946 0958x", "é@ü.com ünd.x@y.zé", "a" * 5000 + "@", "1" * 5000, "1." * 3000, "a@" * 3000, "+1 " * 2000, "+" + "1-" * 4000, "- " * 100 + "4111111111111111",
]


def test_patterns_are_as_stated():
    r = random.Random(4)
    texts = TRICKY + ["".join(r.choice("12.@+- ()a.b_é4") for _ in range(r.randrange(0, 60))) for _ in range(4000)]
    for text in texts:
        assert [(a, k, b, v) for a, b, k, v in private.base_spans(text)] == patterns(text), text


def test_patterns_are_linear():
    for text in ("1" * 300_000, "1." * 150_000, "a@" * 150_000, "a" * 300_000 + "@", "+1" + "-" * 300_000, "1 " * 150_000):
        private.base_spans(text)


def made(seed):
    """Prose, a person whose name stands beside an address and elsewhere, and copies of one passage."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(150)] + ["the", "of", "Über", "x9"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(k, prose(r.randrange(0, 60))) for k in range(120)]
    rows += [(200 + k, f"{prose(12)} Zora, QUIRK, zora@mail.example.com {prose(12)} +1 (017) 555-7713.") for k in range(12)]
    rows += [(300 + k, f"{prose(9)} zora {prose(9)}") for k in range(2)] + [(310, "quirk and Quirk's the end")]
    copy = f"{prose(20)} rare17 copy@mail.example.com unusual {prose(20)}"
    rows += [(400 + k, copy) for k in range(30)]
    # a passage copied often, of which each copy has another word changed, against few occurrences of its word elsewhere
    parts = copy.replace("copy@", "near@").replace("rare17", "rare18").split()
    rows += [(700 + k, " ".join(r.choice(words) if j == k % len(parts) and "@" not in x and x != "rare18" else x for j, x in enumerate(parts))) for k in range(40)]
    rows += [(760 + k, f"{prose(5)} rare18 {prose(5)}") for k in range(12)]
    rows += [(500 + k, t) for k, t in enumerate(TRICKY)]
    return rows + [(None, "x zora"), (600, None), (601, ""), (602, " \n"), rows[125], rows[125], (603, "zora " * 4)]


@pytest.mark.parametrize("seed", [0, 1])
def test_matches_brute_force(spark, seed):
    rows = made(seed)
    want, telling = brute(rows)
    assert "quirk" in telling and "the" not in telling and not {"rare17", "rare18"} & telling
    assert run(spark, rows) == want


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want, _ = brute(rows)
    got = private.personal_data(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_sanitised_texts_show_neither_values_nor_names(spark):
    rows = [(k, f"so w{k} v{k} Quirk <zora@mail.example.com> u{k} t{k}") for k in range(9)] + [(20, "only quirk"), (21, "plain"), (22, None), (23, "other words " * 2000)]
    got = dict(map(tuple, private.sanitise(spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)).collect()))
    assert got[20].lower().find("quirk") < 0 and got[21] == "plain" and got[22] is None
    assert all("zora" not in got[k] and "[EMAIL]" in got[k] and f"w{k} v{k}" in got[k] for k in range(9))


def test_empty_table(spark):
    assert private.personal_data(spark.createDataFrame([], SCHEMA)).collect() == []
