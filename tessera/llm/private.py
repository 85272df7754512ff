"""Personal data: patterns, and terms that reveal what the patterns found.

The patterns find e-mail addresses, IP addresses, card and phone numbers in every
whole text. Each distinct value is a protected entity. What else would reveal an
entity is estimated from the corpus: every occurrence of a term (a run of ASCII
letters, digits, underscores and non-ASCII characters, ASCII case folded) is a
trial, and it is joint with an entity where it stands among the ``WINDOW`` terms
before or after a mention. A term discloses an entity if the pointwise mutual
information of the two, log2(p(e|t) / p(e)), reaches the share ``ALPHA`` of the
entity's information content -log2 p(e); at 1 the term would occur nowhere else.
That is asked only of terms that stand beside the entity in ``CONTEXTS`` contexts
or more. Contexts count as one if the least hash of their other terms is the
same, as it is in copies, so that a passage copied a thousand times gives no
evidence of its own. Every occurrence of a disclosing term, anywhere in the
corpus, is a span: it is generalised to its class (number, code or word), or
removed where even the class discloses the entity by the same measure.

Texts are read three times (contexts, counts of the candidate terms, spans) and
what leaves a task is counts or hits: a Bloom filter of fixed size (``BITS``),
built by grouped bit_or, tells which terms are worth counting or marking, and an
exact join with the terms follows, so its false positives cost time only.

Defined results: null and empty texts have no spans; terms inside the patterns'
spans are no terms of a context and are never marked; repeated rows each keep
their row (their contexts count once); a null doc_id is kept; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textnp
from tessera.scratch import materialize, ship, small_batches

ship(__name__)

KINDS = ("email", "ip", "card", "phone")
WINDOW, CONTEXTS, ALPHA = 8, 3, 0.95
BITS = 1 << 23
CLASSES = ("number", "code", "word")

# The fixed patterns, with possessive repeats and bounds that make them linear and change no match.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")

#: Each byte of a term in lower case, every other one as a space.
_FOLD = np.full(256, 0x20, dtype=np.uint8)
for _c in range(256):
    if _c >= 0x80 or chr(_c).isalnum() or _c == 0x5F:
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 0x80 else _c


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and _LOCAL.match(text, begin - 1):
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            done = domain.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind's number, value) of what the patterns find, by start, then kind."""
    out = []
    if "@" in text:
        out += [(a, b, 0, text[a:b].lower()) for a, b in _emails(text)]
    if _DIGITS.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append((m.start(), m.end(), 1, m[0]))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2, digits))
        if "+" in text:
            for m in _PHONE.finditer(text):
                digits = "".join(_DIGITS.findall(m[0]))
                if 10 <= len(digits) <= 15:
                    out.append((m.start(), m.end(), 3, digits))
    return sorted(out, key=lambda s: (s[0], s[2]))


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte, hash and class of each term, and for each text the index of its first one."""
    folded = _FOLD[raw]
    starts, ends, first = textnp.words(folded, offsets)
    hashes = textnp.word_hashes(folded, starts, ends).view(np.int64)
    digits = np.concatenate(([0], np.cumsum((folded >= 0x30) & (folded <= 0x39))))
    n = digits[ends] - digits[starts]
    return starts, ends, hashes, np.where(n == ends - starts, 0, np.where(n > 0, 1, 2)), first


def _points(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte of a text, and all of them."""
    return np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))


def _outside(begin: np.ndarray, end: np.ndarray, spans: list) -> np.ndarray:
    """Which stretches of code points no span touches."""
    change = np.zeros((len(spans), 2), dtype=np.int64)
    if not spans:
        return np.ones(len(begin), dtype=bool)
    change[:] = [s[:2] for s in spans]
    reach = np.maximum.accumulate(change[:, 1])
    before = np.searchsorted(change[:, 0], end, "left")  # spans that start before the term ends
    return (before == 0) | (reach[np.maximum(before, 1) - 1] <= begin)


def _entity(kind: int, value: str) -> int:
    return int.from_bytes(blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "big", signed=True)


def near(text: str, spans: list) -> tuple[dict, set]:
    """({(entity, term, class): occurrences beside the entity}, {(entity, term, context)}) of one text."""
    raw = np.frombuffer(text.encode(errors="replace"), dtype=np.uint8)
    starts, ends, hashes, classes, _ = terms(raw, np.array([0, len(raw)]))
    points = _points(raw)
    begin, end = points[starts], points[ends]
    free = np.flatnonzero(_outside(begin, end, spans))
    places, contexts = defaultdict(set), set()
    for a, b, kind, value in spans:
        entity = _entity(kind, value)
        left = int(np.searchsorted(end[free], a, "right"))
        right = int(np.searchsorted(begin[free], b, "left"))
        beside = [*free[max(0, left - WINDOW) : left].tolist(), *free[right : right + WINDOW].tolist()]
        places[entity].update(beside)
        own = sorted({int(hashes[i]) for i in beside})
        contexts |= {(entity, t, (own[1] if len(own) > 1 else 0) if t == own[0] else own[0]) for t in own}
    counts = defaultdict(int)
    for entity, at in places.items():
        for i in at:
            counts[entity, int(hashes[i]), int(classes[i])] += 1
    return counts, contexts


def _contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entity, term, class, n (null context), and entity, term, context (null n)."""
    for part in parts:
        counts, contexts = defaultdict(int), set()
        for text in part.column(0).to_pylist():
            if text and (spans := base_spans(text)):
                own, places = near(text, spans)
                contexts |= places
                for key, n in own.items():
                    counts[key] += n
        rows = [(*key, n, None) for key, n in counts.items()] + [(e, t, None, None, c) for e, t, c in contexts]
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["entity", "term", "class", "n", "context"])


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each term in the filter."""
    bits = hashes.view(np.uint64)
    return (bits % np.uint64(BITS)).astype(np.int64), ((bits >> np.uint64(32)) % np.uint64(BITS)).astype(np.int64)


def term_filter(table: DataFrame) -> np.ndarray:
    """A Bloom filter of the column term, as BITS booleans; BITS / 64 rows at most come to the driver, whatever the table."""
    term = F.col("term")
    low, high = F.pmod(F.shiftrightunsigned(term, 32), F.lit(BITS)), F.pmod(term, F.lit(BITS))
    bit = F.explode(F.array(low, high))
    words = (
        table.select(bit.alias("bit"))
        .groupBy(F.expr("bit div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))
        .toPandas()
    )
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["mask"].to_numpy(dtype=np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    a, b = _slots(hashes)
    return (bits[a] & bits[b]).astype(bool)


def _occurrences(sent):
    """term, class, n: occurrences of the terms that pass the filter, and of each class (null term)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, dtype=np.uint8)
        bits = np.unpackbits(bits, bitorder="little")
        of_class = np.zeros(len(CLASSES), dtype=np.int64)
        for part in parts:
            for _, _, raw, offsets in textnp.batches(part.column(0)):
                _, _, hashes, classes, _ = terms(raw, offsets)
                of_class += np.bincount(classes, minlength=len(CLASSES))
                found, n = np.unique(hashes[_passes(bits, hashes)], return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.nulls(len(found), pa.int32()), pa.array(n.astype(np.int64))], names=["term", "class", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(CLASSES), pa.int64()), pa.array(range(len(CLASSES)), pa.int32()), pa.array(of_class)], names=["term", "class", "n"])

    return run


def disclosing(docs: DataFrame, alpha: float = ALPHA, contexts: int = CONTEXTS) -> DataFrame:
    """term, removed: the hash of each term that discloses an entity, and whether its class does too."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    seen = materialize(texts.mapInArrow(_contexts, "entity long, term long, class int, n long, context long"), "contexts")
    counted = seen.where("n IS NOT NULL").groupBy("entity", "term", "class").agg(F.sum("n").alias("joint"))
    entities = counted.groupBy("entity").agg(F.sum("joint").alias("mass"), *(F.coalesce(F.sum(F.expr(f"CASE WHEN class = {k} THEN joint END")), F.lit(0)).alias(f"joint_{k}") for k in range(len(CLASSES))))
    support = seen.where("n IS NULL").groupBy("entity", "term").agg(F.count_distinct("context").alias("support")).where(F.col("support") >= contexts)
    candidates = materialize(counted.join(support, ["entity", "term"]).join(entities, "entity"), "candidates")
    sent = spark.sparkContext.broadcast(np.packbits(term_filter(candidates), bitorder="little").tobytes())
    found = materialize(texts.mapInArrow(_occurrences(sent), "term long, class int, n long").groupBy("term", "class").agg(F.sum("n").alias("n")), "occurrences")
    sums = dict.fromkeys(range(len(CLASSES)), 0) | {r["class"]: r["n"] for r in found.where("term IS NULL").collect()}
    sent.destroy()
    total = F.lit(float(max(1, sum(sums.values()))))
    of_class = F.element_at(F.array(*(F.lit(float(max(1, n))) for _, n in sorted(sums.items()))), F.col("class") + 1)
    joint_class = F.element_at(F.array(*(F.col(f"joint_{k}") for k in range(len(CLASSES)))), F.col("class") + 1)
    information = -F.log2(F.col("mass") / total)

    def reveals(share: Column) -> Column:
        # both sides of PMI >= alpha * IC, with p(e) taken out; exact where the share is 1
        return F.log2(share) >= (alpha - 1) * information

    return (
        candidates.join(found.where("term IS NOT NULL").select("term", "n"), "term")
        .where(reveals(F.col("support") / (F.col("support") + F.col("n") - F.col("joint"))))
        .groupBy("term")
        .agg(F.coalesce(F.max(reveals(joint_class / of_class)), F.lit(False)).alias("removed"))
    )


def _marks(sent, texts: bool):
    """row's columns of every text: doc_id, counts, base spans, and the terms that pass the filter."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())])
    hit = pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("class", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(sent.value, dtype=np.uint8), bitorder="little")
        for part in parts:
            column = part.column("text")
            base = [base_spans(t) if t else [] for t in column.to_pylist()]
            hits = [[] for _ in base]
            for a, b, raw, offsets in textnp.batches(column):
                starts, ends, hashes, classes, first = terms(raw, offsets)
                passing = np.flatnonzero(_passes(bits, hashes))
                owners, at = np.unique(np.searchsorted(first, passing, "right") - 1, return_index=True)
                for k, own in zip(owners.tolist(), np.split(passing, at[1:]), strict=True) if len(passing) else ():
                    points = _points(raw[offsets[k] : offsets[k + 1]])
                    begin, end = points[starts[own] - offsets[k]], points[ends[own] - offsets[k]]
                    free = _outside(begin, end, base[a + k])
                    hits[a + k] = [
                        {"term": t, "start": s, "end": e, "class": c}
                        for t, s, e, c in zip(hashes[own][free].tolist(), begin[free].tolist(), end[free].tolist(), classes[own][free].tolist(), strict=True)
                    ]
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k, _ in found] for found in base]
            arrays = [part.column("doc_id"), pa.array(spans, pa.list_(span)), pa.array(hits, pa.list_(hit))]
            yield pa.RecordBatch.from_arrays([*arrays, *([column] if texts else [])], names=["doc_id", "base", "hits", *(["text"] if texts else [])])

    return run


def find(docs: DataFrame, alpha: float = ALPHA, contexts: int = CONTEXTS, texts: bool = False) -> DataFrame:
    """doc_id, base (array of start, end, kind's number), terms (array of start, end, class, removed), and text if asked, of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    known = materialize(disclosing(docs, alpha, contexts), "terms")
    sent = spark.sparkContext.broadcast(np.packbits(term_filter(known), bitorder="little").tobytes())
    schema = "doc_id long, base array<struct<start: int, end: int, kind: int>>, hits array<struct<term: long, start: int, end: int, class: int>>"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = materialize(source.mapInArrow(_marks(sent, texts), schema + ", text string" * texts).withColumn("row", F.monotonically_increasing_id()), "marked")
    sent.destroy()
    told = (
        marked.where(F.size("hits") > 0)
        .select("row", F.explode("hits").alias("hit"))
        .join(known, F.col("hit.term") == known["term"])
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("hit.start", "hit.end", "hit.class", "removed"))).alias("terms"))
    )
    own = ["doc_id", "base", *(["text"] if texts else [])]
    none = F.array().cast("array<struct<start: int, end: int, class: int, removed: boolean>>")
    with_hits = marked.where(F.size("hits") > 0).join(told, "row", "left").select(*own, F.coalesce("terms", none).alias("terms"))
    return marked.where(F.size("hits") == 0).select(*own, none.alias("terms")).unionByName(with_hits)


def _sanitised(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        out = []
        for text, base, own in zip(*(part.column(c).to_pylist() for c in ("text", "base", "terms")), strict=True):
            spans = [(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in base]
            spans += [(s["start"], s["end"], "" if s["removed"] else f"[{CLASSES[s['class']].upper()}]") for s in own]
            pieces, at = [], 0
            for a, b, put in sorted(spans):
                if b > at:
                    pieces += [text[at : max(at, a)], put if a >= at else ""]
                    at = b
            out.append(text if text is None else "".join(pieces) + text[at:])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])


def sanitise(docs: DataFrame, alpha: float = ALPHA, contexts: int = CONTEXTS) -> DataFrame:
    """doc_id and text of each row, with every span replaced by its kind or class, or removed; overlapping spans become the first one's."""
    return find(docs, alpha, contexts, texts=True).mapInArrow(_sanitised, "doc_id long, text string")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end, the method's kind being term) of each row."""
    names = F.array(*map(F.lit, (*KINDS, "term")))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    def keyed(kind: Column, s: Column) -> Column:
        return F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base = F.transform("base", lambda s: keyed(s["kind"], s))
    added = F.transform("terms", lambda s: keyed(F.lit(len(KINDS)), s))
    return find(docs).select("doc_id", *map(count, range(len(KINDS))), F.sha2(written(base), 256).alias("base_sha256"), written(F.array_sort(F.concat(base, added))).alias("spans"))
