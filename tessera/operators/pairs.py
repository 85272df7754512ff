"""Mention pairs: generation, windows, sampling, score joins.

A mention table has doc_id, sentence_id, token_id (or start and end) and chain_id.
All joins carry doc_id as an equi-key. All pairs of a document form in cells of
two blocks of its mentions, so a long document spreads over many tasks; with a
sentence gap a residual condition bounds them instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from tessera.scratch import ship

ship(__name__)

BLOCK = 512
#: Where tables of pairs are joined with each other: mentions of a block, and pairs of one partition. A partition is looked up
#: in memory, at some 200 bytes a pair, and may get thrice its share by chance; smaller cells even that out.
MET, JOINED = 256, 1 << 19
#: Where the pairs of two blocks of a document lie.
CELL = ["doc_id", "block1", "block2"]


def in_blocks(mentions: DataFrame, block: int = BLOCK) -> DataFrame:
    """Mentions with the number of their block in their document, _at, and of its last block, _last; rows of one place stand in one block."""
    doc = Window.partitionBy("doc_id")
    placed = mentions.withColumn("_at", F.floor((F.rank().over(doc.orderBy("sentence_id", "token_id")) - 1) / block).cast("int"))
    return placed.withColumn("_last", F.max("_at").over(doc))


def joined_cells(placed: DataFrame) -> int:
    """Partitions to deal the cells to, so that one has about JOINED pairs. placed: of in_blocks()."""
    n = F.count("*").cast("double")
    total = placed.groupBy("doc_id").agg((n * (n - 1) / 2).alias("n")).agg(F.sum("n")).first()[0]
    least = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, least, math.ceil((total or 0) / JOINED))


def in_cells(docs: DataFrame, placed: DataFrame, cells: int) -> DataFrame:
    """Each document's row once for each cell of its pairs, dealt as these are and to be looked up there. placed: of in_blocks()."""
    last = placed.groupBy("doc_id").agg(F.max("_last").alias("_last"))
    every = F.expr("flatten(transform(sequence(0, _last), x -> transform(sequence(x, _last), y -> struct(x AS block1, y AS block2))))")
    return docs.join(last, "doc_id").withColumn("_cell", F.explode(every)).drop("_last").select("*", "_cell.*").drop("_cell").repartition(cells, *CELL).hint("shuffle_hash")


@contextmanager
def meeting_in_cells(spark: SparkSession) -> Iterator[None]:
    """While this holds, tables that are dealt by some of a join's keys meet by these: pairs of equal cells aren't shuffled by all keys. For what runs within it."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mention_pairs(
    mentions: DataFrame,
    max_sentence_gap: int | None = None,
    carry: tuple[str, ...] = ("mention_type", "semantics"),
    block: int = BLOCK,
    cells: int | None = None,
    late: dict[str, Callable[[str, str, str], Column]] | None = None,
) -> DataFrame:
    """All unordered pairs of a document's mentions in (sentence, token) order, optionally within a sentence gap: doc_id, s1, t1, c1, s2, t2, c2, label.

    With a number of partitions, cells, the pairs lie in as many by doc_id, block1 and block2, which they keep: tables of
    pairs of the same mentions (of in_blocks()) that are joined on these as well, within meeting_in_cells(), meet where they lie: no pair is shuffled.
    late: like carry, but told by a mention's doc_id, sentence and token once it is in its cell, so tables that differ in these alone share what is dealt.
    """
    present = [c for c in carry if c in mentions.columns]
    mentions = mentions if max_sentence_gap is not None or "_at" in mentions.columns else in_blocks(mentions, block)

    def side(i: int, *more: str) -> DataFrame:
        return mentions.select(
            "doc_id",
            F.col("sentence_id").alias(f"s{i}"),
            F.col("token_id").alias(f"t{i}"),
            F.col("chain_id").alias(f"c{i}"),
            *(F.col(c).alias(f"{c}{i}") for c in present),
            *more,
        )

    after = (F.col("s2") > F.col("s1")) | ((F.col("s2") == F.col("s1")) & (F.col("t2") > F.col("t1")))
    label = F.col("c1") == F.col("c2")
    if max_sentence_gap is not None:
        near = side(1).withColumn("s2", F.explode(F.expr(f"sequence(s1, s1 + {max_sentence_gap})")))
        return near.join(side(2), ["doc_id", "s2"]).where(after).withColumn("label", label)

    def dealt(i: int, own: str, other: str, into: str) -> DataFrame:
        """Each row once for each cell that its block stands in; the first mention's block is never the later one."""
        out = side(i, F.col("_at").alias(own), "_last").withColumn(other, F.explode(F.expr(into)))
        out = out.select(*(c for c in out.columns if c not in (own, other, "_last")), "block1", "block2")
        out = out.repartition(cells, *CELL) if cells else out
        return out.withColumns({f"{name}{i}": told("doc_id", f"s{i}", f"t{i}") for name, told in (late or {}).items()})

    first = dealt(1, "block1", "block2", "sequence(block1, _last)")
    second = dealt(2, "block2", "block1", "sequence(0, block2)")
    found = first.join(second, CELL).where(after).withColumn("label", label)
    return found if cells else found.drop("block1", "block2")


def centered_window(n: Column, left: Column, right: Column, most: int) -> Column:
    """(start, stop) of at most ``most`` of n tokens around the tokens left..right; null where the pair is wider."""
    width = right - left + 1
    start = F.greatest(F.lit(0), left - F.floor((most - width) / 2).cast("int"))
    stop = F.least(n, start + most)
    start = F.when(stop - start < most, F.greatest(F.lit(0), stop - most)).otherwise(start)
    return F.when(width <= most, F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop")))


def pair_record(tokens: Column, window: Column, span1: Column, span2: Column, label: Column) -> Column:
    """The adapter record of a pair: text of the window, both targets with local indexes, and the label as text."""

    def piece(span: Column) -> Column:
        return F.array_join(F.slice(tokens, span["s"] + 1, span["e"] - span["s"] + 1), " ")

    return F.struct(
        F.array_join(F.slice(tokens, window["start"] + 1, window["stop"] - window["start"]), " ").alias("text"),
        F.struct(
            piece(span1).alias("span1_text"),
            F.array(span1["s"] - window["start"], span1["e"] - window["start"]).alias("span1_index"),
            piece(span2).alias("span2_text"),
            F.array(span2["s"] - window["start"], span2["e"] - window["start"]).alias("span2_index"),
        ).alias("target"),
        F.when(label, "true").otherwise("false").alias("label"),
    )


def kept_token_index(tokens: DataFrame, special: list[str]) -> DataFrame:
    """Tokens that aren't special, with old_idx and new_idx; tokens: doc_id, idx, tok."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    return (
        tokens.where(~F.col("tok").isin(special))
        .withColumn("new_idx", (F.row_number().over(w) - 1).cast("long"))
        .select("doc_id", F.col("idx").alias("old_idx"), "new_idx")
    )


def bad_tokens(tokens: DataFrame) -> DataFrame:
    """doc_id, idx, tok of the tokens that are null, empty or hold white space: a pair's text is split at blanks again."""
    return tokens.where(F.coalesce((F.col("tok") == "") | F.col("tok").rlike(r"(?U)\s"), F.lit(True))).select("doc_id", "idx", "tok")


def remap_spans(spans: DataFrame, kept: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end) in new indexes; status is touches_special or not_contiguous where a span can't be kept."""
    a = kept.select("doc_id", F.col("old_idx").alias("start"), F.col("new_idx").alias("new_start"))
    b = kept.select("doc_id", F.col("old_idx").alias("end"), F.col("new_idx").alias("new_end"))
    return (
        spans.join(a, ["doc_id", "start"], "left")
        .join(b, ["doc_id", "end"], "left")
        .withColumn(
            "status",
            F.when(F.col("new_start").isNull() | F.col("new_end").isNull(), "touches_special")
            .when(F.col("new_end") - F.col("new_start") != F.col("end") - F.col("start"), "not_contiguous")
            .otherwise("ok"),
        )
    )


def cluster_conflicts(spans: DataFrame) -> DataFrame:
    """Spans that stand in more than one cluster: doc_id, start, end, n_clusters."""
    return spans.groupBy("doc_id", "start", "end").agg(F.count_distinct("cluster").alias("n_clusters")).where("n_clusters > 1")


def sample_negatives(pairs: DataFrame, order: Column, ratio: float = 1.0) -> DataFrame:
    """All positives, and min(round-half-even(positives x ratio), negatives) negatives, the first by ``order``.

    The sample is a threshold on the order value, found by counting over ranges
    of it, so no task sorts all negatives.
    """
    marked = pairs.withColumn("_o", order)
    goal = marked.agg(F.bround(F.count_if("label") * ratio, 0).cast("long").alias("goal"))
    negatives = marked.where(~F.col("label"))
    bucket = F.shiftright("_o", 20)
    counts = negatives.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    # at most 4096 buckets of a 32-bit order value
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("b").orderBy("_o", *[c for c in pairs.columns if c != "label"]))
    taken = (
        negatives.withColumn("b", bucket)
        .join(F.broadcast(before.select("b", "before")), "b")
        .crossJoin(F.broadcast(goal))
        .where("before < goal")
        .withColumn("rank", rank + F.col("before"))
        .where("rank <= goal")
    )
    return marked.where("label").select(pairs.columns).unionByName(taken.select(pairs.columns))


def _looked_up(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """A partition of pairs in cells is of bounded size and looked up where it lies."""
    return pairs.hint("shuffle_hash") if "block1" in keys else pairs


def join_scores(pairs: DataFrame, scores: DataFrame, keys: list[str], how: str = "strict") -> DataFrame:
    """strict: only pairs with a score; default: pairs without one get p 0.0 and matched false; missing: the pairs without one, without p."""
    scores = _looked_up(scores, keys)
    if how == "missing":
        return pairs.join(scores, keys, "left_anti")
    if how == "strict":
        return pairs.join(scores, keys)
    return (
        pairs.join(scores.withColumn("matched", F.lit(True)), keys, "left")
        .withColumn("p", F.coalesce("p", F.lit(0.0)))
        .withColumn("matched", F.coalesce("matched", F.lit(False)))
    )


def canonical(df: DataFrame) -> DataFrame:
    """Swap the spans of pairs whose second span comes first."""
    one, two = (F.struct(F.col(f"s{i}").alias("s"), F.col(f"t{i}").alias("t")) for i in (1, 2))
    swapped = df.withColumn("_a", F.least(one, two)).withColumn("_b", F.greatest(one, two))
    spans = {"s1": "_a.s", "t1": "_a.t", "s2": "_b.s", "t2": "_b.t"}
    return swapped.select(*(F.col(spans[c]).alias(c) if c in spans else F.col(c) for c in df.columns))


def score_gates(pairs: DataFrame, scores: DataFrame, keys: list[str], mentions: DataFrame | None = None) -> DataFrame:
    """Violations of a strict 1:1 score join: kind (duplicate_pair, duplicate_score, missing_score, unknown_score), n.

    With the mentions (doc_id, sentence_id, token_id) also self_pair, scores of a
    span with itself, and unknown_span, ends of scores that are no mention.
    """

    def counted(df: DataFrame, kind: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")

    found = [
        counted(pairs.groupBy(*keys).count().where("count > 1"), "duplicate_pair"),
        counted(scores.groupBy(*keys).count().where("count > 1"), "duplicate_score"),
        counted(join_scores(pairs, scores, keys, "missing"), "missing_score"),
        counted(scores.join(_looked_up(pairs, keys), keys, "left_anti"), "unknown_score"),
    ]
    if mentions is not None:
        span = ["doc_id", "sentence_id", "token_id"]
        ends = F.explode(F.array(*(F.struct(F.col(f"s{i}").alias("sentence_id"), F.col(f"t{i}").alias("token_id")) for i in (1, 2))))
        # a span is looked up once, however many pairs it stands in
        spans = scores.select("doc_id", ends.alias("e")).select("doc_id", "e.*").distinct()
        # an anti join with few mentions would be pushed below distinct(), to every end of every pair
        known = spans.join(mentions.select(span).distinct().withColumn("_known", F.lit(True)), span, "left")
        found += [counted(self_pairs(scores), "self_pair"), counted(known.where("_known IS NULL"), "unknown_span")]
    return reduce(DataFrame.unionByName, found)


def resolve_doc_keys(keys: DataFrame, known: DataFrame, rule: str = "exact_or_stripped") -> DataFrame:
    """raw_key to doc_id (and part). Rules:

    exact_or_stripped: the key, else the key without its last _x; exact_or_part:
    the key with part 000, else _N as part %03d; numbered: must end in _digits,
    which are taken off. Unresolved keys have a null doc_id.
    """
    ids = known.select(F.col("doc_id").alias("known")).distinct()
    stem, tail = F.regexp_extract("raw_key", "^(.*)_([^_]*)$", 1), F.regexp_extract("raw_key", "^(.*)_([0-9]+)$", 2)
    numbered = F.regexp_extract("raw_key", "^(.*)_([0-9]+)$", 1)
    if rule == "numbered":
        out = keys.withColumn("_k", F.when(tail != "", numbered))
        return out.join(ids, F.col("_k") == F.col("known"), "left").select("raw_key", F.col("known").alias("doc_id"))
    cut = F.when(stem != "", stem) if rule == "exact_or_stripped" else F.when(tail != "", numbered)
    both = (
        keys.withColumn("_cut", cut)
        .join(ids.withColumnRenamed("known", "exact"), F.col("raw_key") == F.col("exact"), "left")
        .join(ids, F.col("_cut") == F.col("known"), "left")
    )
    resolved = both.select("raw_key", F.coalesce("exact", "known").alias("doc_id"), F.col("exact").isNotNull().alias("is_exact"))
    if rule == "exact_or_part":
        return resolved.select(
            "raw_key",
            "doc_id",
            F.when(F.col("doc_id").isNotNull(), F.when(F.col("is_exact"), "000").otherwise(F.format_string("%03d", tail.cast("int")))).alias("part"),
        )
    return resolved.select("raw_key", "doc_id")


def self_pairs(scores: DataFrame) -> DataFrame:
    """Scores of a span with itself (s1, t1, s2, t2), which no pair may be."""
    return scores.where((F.col("s1") == F.col("s2")) & (F.col("t1") == F.col("t2")))


def score_pairs(pairs: DataFrame, score: Callable[[pd.DataFrame], np.ndarray], threshold: float = 0.5) -> DataFrame:
    """pairs with p (probability of a link) and pred (p >= threshold), batch by batch in the workers.

    score: a batch of pairs to one probability a row, or to two logits a row (no link, link), of which the softmax is taken.
    A score that isn't a number links nothing (p stays as it is, pred is false); scores that aren't as many as the rows raise.
    """
    columns = pairs.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            raw = np.asarray(score(part), dtype="float64")
            if len(raw) != len(part):
                raise ValueError(f"{len(raw)} scores for {len(part)} pairs")
            p = raw if raw.ndim == 1 else 1 / (1 + np.exp(np.clip(raw[:, 0] - raw[:, 1], -700, 700)))
            yield part[columns].assign(p=p, pred=p >= threshold)

    return pairs.mapInPandas(run, StructType([*pairs.schema.fields, StructField("p", DoubleType()), StructField("pred", BooleanType())]))
