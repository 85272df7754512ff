"""Corpus totals, derived labels, audits and data-quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schemas import CATEGORY_PRIORITY, CHAIN_PRIORITY, EVENT_CHAIN, EVENT_MENTION


def priority(value: Column, order: list[str]) -> Column:
    """The place in an order; beyond its end for others."""
    return F.coalesce(F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)])[value], F.lit(len(order)))


def totals(sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    s = sentences.agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_sentences"))
    m = mentions.agg(F.count("*").alias("n_mentions"), F.count_distinct("doc_id", "chain_id").alias("n_chains"))
    return s.crossJoin(F.broadcast(m))  # one row each


def nested_totals(docs: DataFrame) -> DataFrame:
    """Totals of nested corpus documents."""
    mentions = F.aggregate("coreference_chains", F.lit(0), lambda a, c: a + F.size(c["mentions"]))
    return docs.agg(
        F.count("*").alias("n_docs"),
        F.sum(F.size("sentences")).alias("n_sentences"),
        F.sum(F.size("coreference_chains")).alias("n_chains"),
        F.sum(mentions).alias("n_mentions"),
    )


def counts_by_key(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts by each dimension on its own, from one scan: dimension, value, n."""
    stacked = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions)))
    return df.select(stacked.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def chain_types(mentions: DataFrame) -> DataFrame:
    """Per chain: its type (the first in priority among its members'), sentence range and size."""
    best = F.min_by("mention_type", priority(F.col("mention_type"), CHAIN_PRIORITY))
    return mentions.groupBy("doc_id", "chain_id").agg(
        best.alias("t"), F.min("sentence_id").alias("start_sentence"), F.max("sentence_id").alias("end_sentence"), F.count("*").alias("n_mentions")
    ).select("doc_id", "chain_id", F.when(F.col("t") == EVENT_MENTION, EVENT_CHAIN).otherwise(F.col("t")).alias("chain_type"), "start_sentence", "end_sentence", "n_mentions")


def doc_categories(chains: DataFrame) -> DataFrame:
    """Per document the most frequent chain type; of equals the first in priority."""
    n = chains.groupBy("doc_id", "chain_type").agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.max_by("chain_type", F.struct("n", -priority(F.col("chain_type"), CATEGORY_PRIORITY))).alias("category"))


def chain_semantics(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("doc_id", "chain_id").agg(F.count_distinct("semantics").alias("n_semantics"))


def test_view_audit(mentions: DataFrame) -> DataFrame:
    """Counters of the entity, event, overt-entity and zero-entity views. A view's chain counts with two members (one for zeros)."""
    entity, event = F.col("semantics") == "ENTITY", F.col("semantics") == "EVENT"
    overt, zero = entity & ~F.col("is_zero"), entity & F.col("is_zero")
    views = {"entity": (entity, 2), "event": (event, 2), "overt_entity": (overt, 2), "zero_entity": (zero, 1)}
    chain = mentions.groupBy("doc_id", "chain_id").agg(
        F.count("*").alias("full"), F.count_distinct("semantics").alias("kinds"), *(F.count_if(c).alias(v) for v, (c, _) in views.items())
    )
    return chain.agg(
        F.count_distinct("doc_id").alias("documents"),
        F.sum("full").alias("full_mentions"),
        F.count("*").alias("full_chains"),
        F.count_if(F.col("kinds") > 1).alias("mixed_chains"),
        *(x for v, (_, least) in views.items() for x in (F.sum(F.when(F.col(v) >= least, F.col(v)).otherwise(0)).alias(f"{v}_mentions"), F.count_if(F.col(v) >= least).alias(f"{v}_chains"))),
    )


def gold_violations(mentions: DataFrame, sentences: DataFrame, chains: DataFrame) -> DataFrame:
    """How many rows break each structural rule: rule, n_violations.

    mentions: doc_id, sentence_id, chain_id, text, char_start, char_end (inclusive),
    mention_type, semantics; sentences: doc_id, sentence_id, sent; chains as of
    chain_types(), but with the recorded values.
    """
    m = mentions.join(sentences, ["doc_id", "sentence_id"], "left")
    cut = F.substring(F.col("sent"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start") + 1)
    rules = {
        "sentence_missing": F.col("sent").isNull(),
        "offset_out_of_bounds": (F.col("char_start") < 0) | (F.col("char_end") < F.col("char_start")) | (F.col("char_end") >= F.length("sent")),
        "slice_differs": cut != F.col("text"),
        "zero_not_one_char": (F.col("text") == "Ø") & (F.col("char_start") != F.col("char_end")),
        "zero_of_other_type": (F.col("text") == "Ø") != (F.col("mention_type") == "零指代"),
    }
    flags = m.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()))
    derived = chain_types(mentions).join(chain_semantics(mentions), ["doc_id", "chain_id"])
    recorded = chains.select("doc_id", "chain_id", F.col("chain_type").alias("rt"), F.col("start_sentence").alias("rs"), F.col("end_sentence").alias("re"))
    c = derived.join(recorded, ["doc_id", "chain_id"], "full_outer").agg(
        F.count_if(F.coalesce(F.col("n_mentions") < 2, F.lit(True))).alias("chain_too_small"),
        F.count_if(F.coalesce(F.col("n_semantics") > 1, F.lit(False))).alias("chain_mixed_semantics"),
        F.count_if(~F.col("chain_type").eqNullSafe(F.col("rt"))).alias("chain_type_differs"),
        F.count_if(~(F.col("start_sentence").eqNullSafe(F.col("rs")) & F.col("end_sentence").eqNullSafe(F.col("re")))).alias("chain_range_differs"),
    )
    return _melt(flags).unionByName(_melt(c))


def _melt(row: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("n_violations")) for c in row.columns)))
    return row.select(pairs.alias("x")).select("x.*")


def event_zero_listing(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Zeros with EVENT semantics, their sentence, and their chain as text|type|semantics|sN joined by || in order."""
    member = F.concat_ws("|", "tok", "mention_type", "semantics", F.concat(F.lit("s"), "sentence_id"))
    chain = mentions.groupBy("doc_id", "chain_id").agg(F.array_sort(F.collect_list(F.struct("sentence_id", "token_id", member.alias("m")))).alias("c"))
    odd = mentions.where(F.col("is_zero") & (F.col("semantics") == "EVENT"))
    return odd.join(chain, ["doc_id", "chain_id"]).join(sentences, ["doc_id", "sentence_id"], "left").select(
        "doc_id", "chain_id", "sentence_id", "token_id", F.coalesce("sent", F.lit("")).alias("sentence"), F.array_join(F.transform("c", lambda x: x["m"]), " || ").alias("chain_mentions")
    )


def overlaps_of_splits(docs: DataFrame, names: list[str]) -> DataFrame:
    """How many doc_ids two splits share: pair, n_overlap."""
    per = docs.groupBy("doc_id").agg(F.collect_set("split").alias("s"))  # at most as many as there are splits
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return per.agg(*(F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}-{b}") for a, b in pairs)).select(
        F.explode(F.array(*(F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(f"`{a}-{b}`").alias("n_overlap")) for a, b in pairs))).alias("x")
    ).select("x.*")


# Gates ------------------------------------------------------------------------------------------------------------------


def expect(df: DataFrame, values: dict[str, int]) -> DataFrame:
    """Compare the one row of df with expected values: name, expected, actual, ok."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).cast("long").alias("expected"), F.col(n).cast("long").alias("actual")) for n, v in values.items())))
    return df.select(rows.alias("x")).select("x.*").withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))


def enforce(gate: DataFrame) -> None:
    """Raise if any row of a gate isn't ok. Gates have a row for each expectation."""
    failed = gate.where("NOT ok").take(20)
    if failed:
        raise ValueError("; ".join(f"{r.name}: expected {r.expected}, found {r.actual}" for r in failed))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(wanted: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.select(keys).distinct().join(known.select(keys).distinct(), keys, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str], names: tuple[str, str] = ("left_only", "right_only")) -> DataFrame:
    """kind, n: keys that only one side has."""
    left = a.select(keys).distinct().withColumn("l", F.lit(1))
    right = b.select(keys).distinct().withColumn("r", F.lit(1))
    both = left.join(right, keys, "full_outer").agg(F.count_if(F.col("r").isNull()).alias(names[0]), F.count_if(F.col("l").isNull()).alias(names[1]))
    return both.select(F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.col(n).alias("n")) for n in names))).alias("x")).select("x.*")


def alignment(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Tokens (doc_id, sentence_id, token_id, tok) that one side lacks or that differ: kind, n."""
    keys = ["doc_id", "sentence_id", "token_id"]
    j = gold.select(*keys, F.col("tok").alias("a")).join(pred.select(*keys, F.col("tok").alias("b")), keys, "full_outer")
    kinds = {"missing_in_response": F.col("b").isNull(), "missing_in_gold": F.col("a").isNull(), "text_differs": F.col("a") != F.col("b")}
    c = j.agg(*(F.count_if(F.coalesce(x, F.lit(False))).alias(k) for k, x in kinds.items()))
    return c.select(F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.col(n).alias("n")) for n in kinds))).alias("x")).select("x.*")


def order_problems(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id, gold_place, pred_place of the documents (doc_id, place) that don't stand in the same place; null where a side lacks one."""
    j = gold.select("doc_id", F.col("place").alias("gold_place")).join(pred.select("doc_id", F.col("place").alias("pred_place")), "doc_id", "full_outer")
    return j.where(~F.col("gold_place").eqNullSafe(F.col("pred_place")))


def zero_rows(mentions: DataFrame, tokens: DataFrame, semantics: str | None = None, mode: str = "with_zero") -> tuple[DataFrame, DataFrame]:
    """(exported zero mentions of the mode, those of them with the semantics if one is asked; what the two maps don't agree on).

    mentions: a mention map; tokens: a token map. The second frame has doc_id,
    sentence_id, token_id and kind: mention_only or token_only. It must be empty.
    """
    key = ["doc_id", "sentence_id", "token_id"]
    every = mentions.where((F.col("mode") == mode) & F.col("is_exported") & F.col("is_zero")).withColumn("token_id", F.col("token_start"))
    structural = tokens.where((F.col("mode") == mode) & (F.col("is_zero_token") == 1)).select(key).distinct()
    wanted = every if semantics is None else every.where(F.col("referent_semantics") == semantics)
    alone = every.select(key).distinct().join(structural, key, "left_anti").withColumn("kind", F.lit("mention_only"))
    return wanted, alone.unionByName(structural.join(every.select(key), key, "left_anti").withColumn("kind", F.lit("token_only")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
