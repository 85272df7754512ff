"""Conversation structure repair: A* on the edit lattice, over segments of sorted conversations.

A conversation's rows, in order, are edited so that their role initials match
``(s?(ua)+)?``: keep (K, 0), rerole to user or assistant (R, 2), delete (D, 3; the
only edit of a blank or duplicate row), insert an empty user or assistant row
anywhere (I, 2); a truncated row that stays adds 1. Nodes of the lattice are
(rows consumed, state of the pattern). The heap's key is (cost plus heuristic,
audit), where the heuristic sums over the rows left the mandatory deletions and,
for truncated ones, the charge of 1 that keeping and deleting both exceed; it
never overestimates nor falls faster than the cost grows, so a node's first visit
has its least cost and of equal costs the ASCII-least audit.

A conversation may hold any share of the rows: rows are range-sorted by (conv_id,
turn, role, text), and a task cuts what it sees of a conversation into segments
of ``SEGMENT`` rows or ``SEGMENT_CHARS`` characters. A conversation that lies
inside one segment is finished there. Of the others each segment gives its
cheapest edits from every state to every state; a fold over these 4 x 4 costs, a
row of numbers per segment, picks the path, and the texts then stream through a
hash in order, so no task holds a conversation.

Defined results: a null conv_id, turn, role or text counts as one space in keys
and contents; null conv_ids are one conversation; null turns sort first and no
gap counts them; rows with equal turns come by role, then text; a role without
characters has no initial and can't be kept; gaps beyond a long are null;
repeated rows are duplicates of the first; a conversation without rows gives
zeros, an empty audit and the hash of nothing; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.scratch import materialize, ship, small_batches

ship(__name__)

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SEGMENT, SEGMENT_CHARS = 512, 4 << 20
#: White space, ends of sentences, and the one in how many keys that each damage hits.
BLANK, ENDS, DAMAGES = " \t\n\v\f\r", ".!?", 20
#: The pattern's states: nothing yet, after s, after u, after a. It may end in the first and the last.
STATES, FINAL = range(4), (0, 3)
#: Where a state goes on an initial, and the only role that an inserted or reroled row can have.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
DUE = ("user", "user", "assistant", "user")
LEGAL = {"su", "ua", "au"}
UNREACHED = 1 << 60


def edits(rows: list[tuple[str, str]], entry: int = 0, closing: bool = True) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the cheapest edits by the state that they end in; rows are (initial, fault).

    Closing, edits may insert after the last row and only the cheapest end that the pattern accepts is given.
    """
    n = len(rows)
    left = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + {"": 0, "truncated": TRUNCATED}.get(rows[i][1], DELETE)
    heap, seen, found = [(left[0], "", 0, entry)], set(), {}
    while heap:
        key, audit, i, q = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == n:
            if not closing or q in FINAL:
                found[q] = key, audit
                if closing:
                    break
                continue
        cost = key - left[i]
        due = NEXT[q, DUE[q][0]]
        heapq.heappush(heap, (cost + INSERT + left[i], audit + "I", i, due))
        if i < n:
            initial, fault = rows[i]
            steps = [("D", DELETE, q)]
            if fault not in ("blank", "duplicate"):
                charge = TRUNCATED if fault else 0
                steps.append(("R", REROLE + charge, due))
                if (q, initial) in NEXT:
                    steps.append(("K", KEEP + charge, NEXT[q, initial]))
            for mark, price, to in steps:
                heapq.heappush(heap, (cost + price + left[i + 1], audit + mark, i + 1, to))
    return found


def repaired(audit: str, rows: list[tuple[str, str]], entry: int = 0) -> Iterator[tuple[str, str]]:
    """(role, text) of each row that the edits leave; rows are (role, text)."""
    state, at = entry, 0
    for mark in audit:
        role, text = ("", "") if mark == "I" else rows[at]
        at += mark != "I"
        if mark != "D":
            role = role if mark == "K" else DUE[state]
            state = NEXT[state, role[0]]
            yield role, text


def damage(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows after damage by rule; dropped ones stay as gone, so that no conversation is lost."""

    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rule = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % DAMAGES
    text = F.when(F.col("rule") <= 1, "").when(F.col("rule") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return (
        table.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), rule.alias("rule"))
        .withColumn("copy", F.explode(F.when(F.col("rule") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", F.when(F.col("rule") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("rule") == 0).alias("gone"))
    )


def ordered(rows: DataFrame) -> DataFrame:
    """The rows sorted by (conv_id, turn, role, text) over ranges, with the range's number as part, and later: the role and text stand at an earlier turn."""
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    key = ["conv_id", "role", "digest"]
    repeated = (
        rows.where("NOT gone").groupBy(*key).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
        .select(*(F.col(c).alias(f"{c}_") for c in key), "first")
    )
    same = [rows[c].eqNullSafe(repeated[f"{c}_"]) for c in key]
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    by = ["conv_id", "turn", "role", "text"]
    return (
        rows.join(repeated, same, "left")
        .select(*by, "gone", later.alias("later"))
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .select(*by, "gone", "later", F.spark_partition_id().alias("part"))
    )


class Summary:
    """What is counted of a conversation's rows, taken up in order, row by row or segment by segment."""

    COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")

    def __init__(self) -> None:
        self.counts = dict.fromkeys(self.COUNTS, 0)
        self.first_turn = self.last_turn = self.first = self.last = None

    def add(self, first_turn: int | None, last_turn: int | None, first: str | None, last: str | None, counts: dict[str, int]) -> None:
        for name, n in counts.items():
            self.counts[name] += n
        if first_turn is not None:
            self.counts["turns"] -= first_turn == self.last_turn
            self.first_turn = first_turn if self.first_turn is None else self.first_turn
            self.last_turn = last_turn
        if first is not None:
            self.counts["illegal"] += self.last is not None and self.last + first not in LEGAL
            self.first = first if self.first is None else self.first
            self.last = last

    def gaps(self) -> int | None:
        if self.first_turn is None:
            return 0
        gaps = self.last_turn - self.first_turn + 1 - self.counts["turns"]
        return gaps if gaps < 1 << 63 else None


OWN = "first_turn long, last_turn long, first string, last string, blank long, duplicate long, truncated long, illegal long, turns long"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECE = "costs array<long>, audits array<string>, ranks array<int>, roles array<string>, texts array<string>"


class Segment:
    """Consecutive rows of one conversation."""

    def __init__(self, conv_id, part: int, number: int):
        self.conv_id, self.part, self.number = conv_id, part, number
        self.roles, self.texts, self.rows = [], [], []
        self.summary, self.chars = Summary(), 0

    def add(self, turn: int | None, role: str, text: str, duplicate: bool) -> None:
        solid = text.rstrip(BLANK)
        fault = "blank" if not solid else "duplicate" if duplicate else "" if solid[-1] in ENDS else "truncated"
        initial = role[:1]
        self.rows.append((initial, fault))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        counts = {"turns": int(turn is not None)}
        if fault:
            counts[fault] = 1
        self.summary.add(turn, turn, initial, initial, counts)

    def done(self) -> dict:
        """Of a whole conversation, its result."""
        [(cost, audit)] = edits(self.rows).values()
        text = "\n".join(f"{role}:{text}" for role, text in repaired(audit, list(zip(self.roles, self.texts, strict=True))))
        s = self.summary
        return {"whole": True, "gaps": s.gaps(), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(), **s.counts}

    def piece(self) -> dict:
        """Of a part of a conversation, its cheapest edits from each state to each state."""
        costs, audits, ranks = [], [], []
        for entry in STATES:
            found = edits(self.rows, entry, closing=False)
            in_order = sorted(audit for _, audit in found.values())
            for q in STATES:
                cost, audit = found.get(q, (UNREACHED, ""))
                costs.append(cost)
                audits.append(audit)
                ranks.append(in_order.index(audit) if q in found else len(STATES))
        s = self.summary
        own = {"first_turn": s.first_turn, "last_turn": s.last_turn, "first": s.first, "last": s.last, **s.counts}
        return {"whole": False, **own, "costs": costs, "audits": audits, "ranks": ranks, "roles": self.roles, "texts": self.texts}


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _segments(schema: pa.Schema, most: int, most_chars: int):
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[Segment, bool]]:
        """The segments in order, each with whether its conversation lies inside it and other ones stand on both sides."""
        now, before, edge = None, None, True
        for batch in parts:
            for conv, turn, role, text, gone, later, part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "later", "part")), strict=True):
                full = now and (len(now.rows) >= most or now.chars >= most_chars)
                if now is None or conv != now.conv_id or full:
                    other = now is None or conv != now.conv_id
                    if now:
                        yield now, other and not edge
                        edge = not other
                    now = Segment(conv, part, now.number + 1 if now else 0)
                    before = None if other else before
                if not gone:
                    now.add(turn, role, text, later or before == (turn, role, text))
                    before = turn, role, text
        if now:
            yield now, False

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for segment, whole in cut(parts):
            rows.append({"conv_id": segment.conv_id, "part": segment.part, "number": segment.number, **(segment.done() if whole else segment.piece())})
            chars += segment.chars
            if len(rows) >= 1024 or chars >= SEGMENT_CHARS:
                yield _arrow(rows, schema)
                rows, chars = [], 0
        if rows:
            yield _arrow(rows, schema)

    return run


def _choose(table: pa.Table) -> pa.Table:
    """conv_id, part, number, entry, exit, total: the states between the segments of one conversation on its cheapest edits."""
    table = table.sort_by([("part", "ascending"), ("number", "ascending")])
    costs, ranks = table.column("costs").to_pylist(), table.column("ranks").to_pylist()
    best, back = {0: (0, 0)}, []
    for cost, rank in zip(costs, ranks, strict=True):
        came = {}
        for to in STATES:
            ways = [(best[q][0] + cost[4 * q + to], best[q][1], q) for q in best if cost[4 * q + to] < UNREACHED]
            if ways:
                came[to] = min(ways)
        order = sorted(came, key=lambda to: (came[to][1], rank[4 * came[to][2] + to]))
        best = {to: (came[to][0], order.index(to)) for to in came}
        back.append({to: q for to, (_, _, q) in came.items()})
    # what is inserted after the last row can't change the order: no audit begins with another of as many rows
    total, _, exit_ = min((cost + INSERT * len(_closing(q)), rank, q) for q, (cost, rank) in best.items())
    exits = []
    for ways in reversed(back):
        exits.append(exit_)
        exit_ = ways[exit_]
    exits.reverse()
    return pa.table(
        {"part": table.column("part"), "number": table.column("number"), "entry": pa.array([0, *exits[:-1]], pa.int32()), "exit": pa.array(exits, pa.int32()), "total": pa.array([total] * len(exits), pa.int64())}
    )


def _closing(state: int) -> str:
    """The insertions after the last row that make a state final."""
    audit = ""
    while state not in FINAL:
        state, audit = NEXT[state, DUE[state][0]], audit + "I"
    return audit


def _finish(schema: pa.Schema):
    """The results of conversations whose segments come in order; their repaired texts stream through the hash."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def result() -> dict:
            conv, summary, audits, sha, total, state, rows = now
            end = _closing(state)
            for k, (role, _) in enumerate(repaired(end, [], state)):
                sha.update(("\n" * (rows + k > 0) + f"{role}:").encode())
            return {"conv_id": conv, "gaps": summary.gaps(), "cost": total, "audit": "".join([*audits, end]), "repaired_sha256": sha.hexdigest(), **summary.counts}

        for batch in parts:
            rows = []
            for r in batch.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now:
                        rows.append(result())
                    now = [r["conv_id"], Summary(), [], hashlib.sha256(), r["total"], 0, 0]
                now[1].add(r["first_turn"], r["last_turn"], r["first"], r["last"], {c: r[c] for c in Summary.COUNTS})
                audit = r["audits"][4 * r["entry"] + r["exit"]]
                now[2].append(audit)
                for role, text in repaired(audit, list(zip(r["roles"], r["texts"], strict=True)), r["entry"]):
                    now[3].update(("\n" * (now[6] > 0) + f"{role}:{text}").encode())
                    now[6] += 1
                now[5] = r["exit"]
            if rows:
                yield _arrow(rows, schema)
        if now:
            yield _arrow([result()], schema)

    return run


def repair(rows: DataFrame, segment: int = SEGMENT, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """conv_id, gaps, the faults, cost, audit and repaired_sha256 of each conversation; rows are conv_id, turn, role, text, gone, without nulls in role and text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    small_batches(spark)
    conv = rows.select("conv_id").schema.fields
    result = StructType([*conv, *StructType.fromDDL(RESULT).fields])
    names = [f.name for f in StructType.fromDDL(OWN).fields if f.name not in result.names]
    schema = StructType(
        [*conv, *StructType.fromDDL("part int, number int, whole boolean").fields, *result.fields[len(conv) :], *(f for f in StructType.fromDDL(OWN).fields if f.name in names), *StructType.fromDDL(PIECE).fields]
    )
    cut = materialize(ordered(rows).mapInArrow(_segments(to_arrow_schema(schema), segment, segment_chars), schema), "segments")
    pieces = cut.where("NOT whole")
    path = materialize(
        pieces.select("conv_id", "part", "number", "costs", "ranks").groupBy("conv_id").applyInArrow(_choose, "part int, number int, entry int, exit int, total long"), "path"
    )
    stream = pieces.join(path, ["part", "number"]).repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return cut.where("whole").select(result.names).unionByName(stream.mapInArrow(_finish(to_arrow_schema(result)), result))


def repair_rows(rows: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str]]]:
    """(audit, repaired rows) of one conversation's (role, text) rows in order: the operator on a small list."""
    whole, seen = Segment(None, 0, 0), set()
    for role, text in rows:
        whole.add(None, role, text, (role, text) in seen)
        seen.add((role, text))
    [(_, audit)] = edits(whole.rows).values()
    return audit, list(repaired(audit, rows))


def conversation_repair(table: DataFrame) -> DataFrame:
    return repair(damage(table))



#: The insertions that can precede a row (state, state after, audit, rows inserted).
_INSERTED = [(0, 2, "u"), (0, 3, "ua"), (1, 2, "u"), (1, 3, "ua"), (2, 3, "a"), (2, 2, "au"), (3, 2, "u"), (3, 3, "ua")]


def _sql() -> str:
    word = {"u": "'user:'", "a": "'assistant:'"}
    inserted = ", ".join(f"({a}, {b}, {INSERT * len(x)}, '{'I' * len(x)}', [{', '.join(word[c] for c in x)}]::VARCHAR[])" for a, b, x in _INSERTED)
    none = ", ".join(f"({q}, {q}, 0, '', []::VARCHAR[])" for q in STATES)
    kept = ", ".join(f"({q}, '{initial}', {to})" for (q, initial), to in NEXT.items())
    due = ", ".join(f"({q}, '{role}', {NEXT[q, role[0]]})" for q, role in zip(STATES, DUE, strict=True))
    return f"""
WITH RECURSIVE bits AS (SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS n)),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda a: ascii(a)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {DAMAGES} AS rule FROM conversations, crc),
hit AS (SELECT conv_id, turn, CASE WHEN rule = 4 THEN 'user' ELSE role END AS role,
  CASE rule WHEN 1 THEN '' WHEN 2 THEN translate(text, '{ENDS}', '') ELSE text END AS text, unnest(CASE WHEN rule = 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE rule <> 0),
r AS (SELECT conv_id, turn, role, text, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hit),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS last FROM r),
pre(q, p, cost, audit, words) AS (VALUES {none}, {inserted}),
keeps(q, ini, z) AS (VALUES {kept}), due(q, role, z) AS (VALUES {due}),
walk AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, struct_pack(cost := 0, audit := '', words := []::VARCHAR[]) AS b FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, q, min(b) FROM (
    SELECT w.conv_id, f.i, unnest([struct_pack(q := pre.p, b := struct_pack(cost := w.b.cost + pre.cost + {DELETE}, audit := w.b.audit || pre.audit || 'D', words := w.b.words || pre.words)),
        struct_pack(q := due.z, b := struct_pack(cost := w.b.cost + pre.cost + {REROLE} + CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END,
          audit := w.b.audit || pre.audit || CASE WHEN fault IN ('blank', 'duplicate') THEN NULL ELSE 'R' END, words := list_append(w.b.words || pre.words, due.role || ':' || text))),
        struct_pack(q := keeps.z, b := struct_pack(cost := w.b.cost + pre.cost + CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END,
          audit := w.b.audit || pre.audit || CASE WHEN keeps.z IS NULL OR fault IN ('blank', 'duplicate') THEN NULL ELSE 'K' END, words := list_append(w.b.words || pre.words, f.role || ':' || text)))], recursive := false) AS o
    FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN pre ON pre.q = w.q JOIN due ON due.q = pre.p LEFT JOIN keeps ON keeps.q = pre.p AND keeps.ini = f.ini
  ) AS s(conv_id, i, o), LATERAL (SELECT o.q AS q, o.b AS b) WHERE b.audit IS NOT NULL GROUP BY conv_id, i, q),
n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
  count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE i > 1 AND last || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ends AS (SELECT n.conv_id, min(struct_pack(cost := b.cost + pre.cost, audit := b.audit || pre.audit, words := b.words || pre.words)) AS b
  FROM walk w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i JOIN pre ON pre.q = w.q WHERE pre.p IN {FINAL} GROUP BY n.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.words, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = _sql()
