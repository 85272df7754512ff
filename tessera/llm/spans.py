"""Substring dedup over sliding runs of consecutive sentences.

A sentence ends at a word that ends in . ! ? … 。 ！ ？ (closing quotes and
brackets may follow) or stands before a line break. A repeated passage may begin
and end inside long sentences, of which few are whole in it; so a clause end, a
word that ends in , ; : ， 、 ； or ：, closes a sentence too. A boundary depends
on its word alone, so equal words are cut alike wherever they stand. A run is the
shortest stretch of consecutive sentences, from each start forwards and from each
end backwards, that holds either ``sentences`` sentences and ``least_words`` words
or ``long_words`` words; so each sentence of a repeated passage that holds a run
lies in a run that repeats. Runs are hashed over their words (white space does
not count) and grouped over all documents; the first occurrence is the one with
the least (doc_id, hash of the text, position). Sentences covered by any other
occurrence go. As clauses count as sentences here, what remains may begin or end
inside a sentence in the ordinary sense, and a document that repeats a passage of
its own keeps it once.

Defined results: null and empty texts, and rows without doc_id, come back as
they are; rows of one doc_id with different texts are different documents; rows
of one doc_id with the same text are each other's first occurrence and stay
alike; a table without rows gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tessera.llm import textnp
from tessera.llm.names import quoted
from tessera.scratch import materialize, ship, small_batches

ship(__name__)

U64 = np.uint64
STOP = np.zeros(256, dtype=bool)
STOP[list(b".!?")] = True
CLOSING = np.zeros(256, dtype=bool)
CLOSING[list(b"\"')]}")] = True
CLAUSE = np.zeros(256, dtype=bool)
CLAUSE[list(b",;:")] = True
WIDE_STOPS = tuple(x.encode() for x in "…。！？，、；：")
#: Of a run: the least number of sentences and of words, and the number of words that is enough for any.
SENTENCES, LEAST_WORDS, LONG_WORDS = 2, 30, 50
INVERSE = U64(pow(int(textnp.BASE), -1, 1 << 64))


def sentences(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence, and for each text the index of its first sentence (one more entry than texts)."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    last = ends - 1
    for _ in range(3):
        step = CLOSING[raw[last]] & (last > starts)
        last = np.where(step, last - 1, last)
    over = STOP[raw[last]] | CLAUSE[raw[last]]
    wide = np.flatnonzero((raw[last] >= 0x80) & (last - starts >= 2))
    if len(wide):
        three = np.stack([raw[last[wide] - 2], raw[last[wide] - 1], raw[last[wide]]], axis=1)
        over[wide] |= np.any([(three == np.frombuffer(s, np.uint8)).all(axis=1) for s in WIDE_STOPS], axis=0)
    lines = np.concatenate(([0], np.cumsum(raw == 0x0A)))
    over[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    over[first[1:][first[1:] > first[:-1]] - 1] = True
    begin = np.concatenate(([0], np.flatnonzero(over)[:-1] + 1)) if over.any() else np.array([0])
    return begin, np.searchsorted(begin, first)


def runs(begin: np.ndarray, n_words: int, owner_first: np.ndarray, sentences_: int, least_words: int, long_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first sentence, last sentence) of each run; owner_first as from sentences()."""
    m = len(begin)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.append(begin[1:], n_words)
    at = np.arange(m)
    text = np.searchsorted(owner_first, at, "right") - 1
    stop = np.minimum(
        np.maximum(at + sentences_ - 1, np.searchsorted(end, begin + least_words)), np.searchsorted(end, begin + long_words)
    )
    ok = stop < owner_first[text + 1]
    start = np.maximum(
        np.minimum(at - sentences_ + 1, np.searchsorted(begin, end - least_words, "right") - 1),
        np.searchsorted(begin, end - long_words, "right") - 1,
    )
    back = start >= owner_first[text]
    back &= ~((start >= 0) & ok[np.maximum(start, 0)] & (stop[np.maximum(start, 0)] == at))  # the same run as forwards
    return np.concatenate([at[ok], start[back]]), np.concatenate([stop[ok], at[back]])


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unions of stretches a..b that overlap. Stretches of different texts never do."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    head = np.flatnonzero(np.concatenate(([True], a[1:] > reach[:-1])))
    return a[head], reach[np.append(head[1:], len(a)) - 1]


def run_hashes(words: np.ndarray, begin: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash over the words of sentences a..b of each run."""
    n = len(words)
    up, down = textnp.powers(n, textnp.BASE), textnp.powers(n, INVERSE)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(words * up, dtype=U64)))
    end = np.append(begin[1:], n)
    return textnp.mix((total[end[b]] - total[begin[a]]) * down[begin[a]] + (end[b] - begin[a]).astype(U64))


#: What tells documents apart: a doc_id may come with several texts.
IDENTITY = ["doc_id", "tag"]
#: Of each text: its different runs at their first places, and the stretches covered by runs that it had before.
SPAN_COLUMNS = ["hashes", "starts", "lengths", "again_starts", "again_lengths"]


def _list(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


def _spans(rule: tuple[int, int, int]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for x, y, raw, offsets in textnp.batches(part.column("text")):
                starts, ends, first = textnp.words(raw, offsets)
                begin, of_text = sentences(raw, offsets, starts, ends, first)
                a, b = runs(begin, len(starts), of_text, *rule)
                h = run_hashes(textnp.word_hashes(raw, starts, ends), begin, a, b) if len(a) else np.zeros(0, U64)
                text = np.searchsorted(of_text, a, "right") - 1
                order = np.lexsort((a, h, text))
                a, b, h, text = a[order], b[order], h[order], text[order]
                again = np.zeros(len(a), dtype=bool)
                again[1:] = (text[1:] == text[:-1]) & (h[1:] == h[:-1])
                a2, b2 = merged(a[again], b[again])
                a, b, h, text = a[~again], b[~again], h[~again], text[~again]
                columns = [_list(h.view(np.int64), np.bincount(text, minlength=y - x))]
                for p, q in ((a, b), (a2, b2)):
                    owner = np.searchsorted(of_text, p, "right") - 1
                    counts = np.bincount(owner, minlength=y - x)
                    columns += [_list((p - of_text[owner]).astype(np.int32), counts), _list((q - p + 1).astype(np.int32), counts)]
                ids = [part.column(c).slice(x, y - x) for c in IDENTITY]
                yield pa.RecordBatch.from_arrays([*ids, *columns], names=[*IDENTITY, *SPAN_COLUMNS])

    return run


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        texts, covered = part.column("text"), part.column("covered")
        n = part.num_rows
        out: list = texts.to_pylist() if covered.null_count < n else []
        total, gone, words_gone = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for x, y, raw, offsets in textnp.batches(texts):
            starts, ends, first = textnp.words(raw, offsets)
            begin, of_text = sentences(raw, offsets, starts, ends, first)
            total[x:y] = of_text[1:] - of_text[:-1]
            bounds = np.append(begin, len(starts))
            for i in range(x, y):
                if not covered[i].is_valid:
                    continue
                lo, hi = int(of_text[i - x]), int(of_text[i - x + 1])
                drop = np.zeros(hi - lo + 1, dtype=np.int64)
                pairs = np.array([(p["at"], p["n"]) for p in covered[i].as_py()], dtype=np.int64)
                np.add.at(drop, pairs[:, 0], 1)
                np.add.at(drop, pairs[:, 0] + pairs[:, 1], -1)
                drop = np.cumsum(drop[:-1]) > 0
                # a sentence reaches from its first word to the first word of the next
                edge = np.append(starts[begin[lo:hi]], offsets[i - x + 1])
                edge[0] = offsets[i - x]
                data = raw.tobytes() if y - x == 1 else raw[offsets[i - x] : offsets[i - x + 1]].tobytes()
                edge = edge - offsets[i - x]
                out[i] = b"".join(data[edge[s] : edge[s + 1]] for s in np.flatnonzero(~drop)).decode()
                gone[i] = drop.sum()
                words_gone[i] = (bounds[lo + 1 : hi + 1] - bounds[lo:hi])[drop].sum()
        kept = [c for c in part.schema.names if c not in ("tag", "text", "covered")]
        yield pa.RecordBatch.from_arrays(
            [
                *(part.column(c) for c in kept),
                pa.array(out, pa.string()) if covered.null_count < n else texts,
                pa.array(total),
                pa.array(gone),
                pa.array(words_gone),
            ],
            names=[*kept, "text", "n_sentences", "n_removed", "n_words_removed"],
        )


def _identified(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, the text's hash, the text, and more."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"), *more)


def covered_sentences(docs: DataFrame, sentences_: int = SENTENCES, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, tag, covered: array of (at, n)): the stretches of sentences that a non-first repeated run covers.

    A run that its own document had before is no first occurrence anywhere, so it
    needs no join; documents meet in their different runs only. All runs are
    shuffled by hash twice: to count them, without their places, and to find
    those that repeat; only these go on.
    """
    small_batches(docs.sparkSession)
    lists = "array<long>", "array<int>", "array<int>", "array<int>", "array<int>"
    spans = materialize(
        _identified(docs.where("doc_id IS NOT NULL")).mapInArrow(
            _spans((sentences_, least_words, long_words)),
            "doc_id long, tag long, " + ", ".join(f"{c} {kind}" for c, kind in zip(SPAN_COLUMNS, lists, strict=True)),
        ),
        "spans",
    )
    repeated = materialize(
        spans.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").select("hash"), "repeated"
    )
    each = spans.select(*IDENTITY, F.explode(F.arrays_zip(*SPAN_COLUMNS[:3])).alias("s")).select(
        *IDENTITY, F.col("s.hashes").alias("hash"), F.col("s.starts").alias("at"), F.col("s.lengths").alias("n")
    )
    common = materialize(each.join(repeated, "hash"), "common")
    first = materialize(  # a table of its own, so that the join's large partitions can be split
        common.groupBy("hash").agg(F.min(F.struct(*IDENTITY, "at")).alias("first")), "first"
    )
    later = (
        common.join(first, "hash")
        .where(F.struct(*IDENTITY, "at") != F.col("first"))
        .groupBy(*IDENTITY)
        .agg(F.collect_list(F.struct("at", "n")).alias("covered"))
    )
    pairs = F.zip_with("again_starts", "again_lengths", lambda at, n: F.struct(at.alias("at"), n.alias("n"))).alias("covered")
    own = spans.where(F.size("again_starts") > 0).select(*IDENTITY, pairs)
    return later.unionByName(own).groupBy(*IDENTITY).agg(F.flatten(F.collect_set("covered")).alias("covered"))


def substring_dedup(
    docs: DataFrame, sentences_: int = SENTENCES, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS, carry: bool = False
) -> DataFrame:
    """doc_id, text without the covered sentences, n_sentences, n_removed, n_words_removed; one row per document.

    With carry, also the struct ``row`` of all other columns of docs.
    """
    others = [F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    kept = [row.alias("row")] if carry else []
    own = _identified(docs, *kept)
    schema = StructType([f for f in own.schema.fields if f.name not in ("tag", "text")]).add("text", "string")
    for c in ("n_sentences", "n_removed", "n_words_removed"):
        schema = schema.add(c, LongType())
    return own.join(covered_sentences(docs, sentences_, least_words, long_words), IDENTITY, "left").mapInArrow(_cut, schema)

