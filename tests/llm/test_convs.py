import hashlib
import itertools
import random
import re
import zlib

import pytest

from tessera.llm import convs

SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int"


def damaged(rows):
    """(turn, role, text) of each conversation's rows after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        own += [(turn, "user" if rule == 4 else role, text)] * {0: 0, 3: 2}.get(rule, 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, own in out.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def relaxed(rows, found):
    """The least (cost, audit, repaired rows) by plain dynamic programming over states, three insertions at most at a place."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", ())}

    def inserted(best):
        for _ in range(3):
            more = dict(best)
            for q, (cost, audit, out) in best.items():
                for c, to in after[q].items():
                    if c in "ua":
                        way = cost + 2, audit + "I", (*out, ({"u": "user", "a": "assistant"}[c], ""))
                        more[to] = min(more.get(to, way), way)
            best = more
        return best

    for (_, role, text), fault in zip(rows, found, strict=True):
        best, new = inserted(best), {}
        for q, (cost, audit, out) in best.items():
            ways = [(q, (cost + 3, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                ways += [(after[q][c], (cost + 2 + more, audit + "R", (*out, (w, text)))) for c, w in (("u", "user"), ("a", "assistant")) if c in after[q]]
                if role[:1] in after[q]:
                    ways.append((after[q][role[:1]], (cost + more, audit + "K", (*out, (role, text)))))
            for to, way in ways:
                new[to] = min(new.get(to, way), way)
        best = new
    best = inserted(best)
    return min(best[q] for q in ("", "a") if q in best)


def brute(rows):
    out = []
    for conv, own in damaged(rows).items():
        found = faults(own)
        cost, audit, left = relaxed(own, found)
        turns = [t for t, *_ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        text = "\n".join(f"{r}:{t}" for r, t in left)
        out.append((conv, gaps if gaps < 2**63 else None, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, partitions=3, **how):
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA).repartition(partitions)
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, convs.repair(convs.damage(table), **how).select(columns).collect()), key=str)


def made(seed, n, longest=9):
    r = random.Random(seed)
    texts = ["One.", "Two!", "Three", "four?  ", "", " \t", "cinq …", "b.", "Ünd\nso"]
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, r.choice([turn, turn, turn, turn * 3, None]), role, r.choice([*texts, f"text {turn}.", f"text {r.random()}.", None])))
    return rows


def test_every_sequence_of_edits():
    """Against all sequences of edits of short conversations."""
    names = {"u": "user", "a": "assistant"}
    for seed in range(60):
        r = random.Random(seed)
        rows = [(r.choice("suat"), r.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(r.randrange(0, 4))]
        best = None
        kinds = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for _, f in rows]
        for marks in itertools.product(*kinds):
            for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
                cost, audit, roles = 0, "", ""
                for k, added in enumerate(inserts):
                    cost, audit, roles = cost + 2 * len(added), audit + "I" * len(added), roles + added
                    if k < len(rows):
                        mark = marks[k]
                        cost += {"D": 3, "K": 0}.get(mark, 2) + (mark != "D" and rows[k][1] == "truncated")
                        audit += mark[0]
                        roles += "" if mark == "D" else rows[k][0] if mark == "K" else mark[1]
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                    best = cost, audit, roles
        [(cost, audit)] = convs.edits(rows).values()
        assert (cost, audit) == best[:2], rows
        left = list(convs.repaired(audit, [(names.get(i, i), "") for i, _ in rows]))
        assert "".join(role[0] for role, _ in left) == best[2]


@pytest.mark.parametrize("how", [{}, {"segment": 1}, {"segment": 3}, {"segment_chars": 12}])
def test_matches_brute_force_however_it_is_cut(spark, how):
    rows = made(len(how) + 1, 150)
    assert run(spark, rows, **how) == brute(rows)


def test_one_long_conversation(spark):
    r = random.Random(9)
    rows = [(7, t // 2, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "no", f"text {t}.", f"cut {t}"])) for t in range(1200)]
    rows += [(8, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for t in range(5)]
    assert run(spark, rows, segment=50) == brute(rows)


def test_odd_rows(spark):
    same = [(5, 1, "user", "Same."), (5, 1, "user", "Same."), (5, 2, "user", "Same.")]
    nulls = [(None, None, None, None), (None, 3, "user", "Hi."), (6, None, "user", None), (6, None, "assistant", "x."), (6, 2**62, "user", "y."), (6, -(2**62) - 5, "user", "far.")]
    rows = [*same, *nulls, (9, 0, "user", "a" * 300_000 + "."), (9, 1, "", "No role.")]
    assert run(spark, rows) == brute(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert convs.conversation_repair(empty).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_small_list():
    assert convs.repair_rows([("user", "Hi."), ("user", "Hi."), ("assistant", "Yes")]) == ("KDK", [("user", "Hi."), ("assistant", "Yes")])
    assert convs.repair_rows([]) == ("", [])
