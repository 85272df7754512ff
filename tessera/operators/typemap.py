"""Mention types by span: sentence-local token spans of a type map as document-global ones, and what doesn't fit as rows.

A type map has doc_id, sentence_id, token_start, token_end, mention_id,
mention_type and further columns of its mentions, of one split and mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["doc_id", "sentence_id"]


def of_mode(type_map: DataFrame, split: str, mode: str) -> DataFrame:
    """The rows of one split and mode, with whole numbers as such."""
    rows = type_map.where((F.col("split") == split) & (F.col("mode") == mode))
    return rows.withColumns({c: F.col(c).try_cast("int") for c in ("sentence_id", "token_start", "token_end")})


def with_global_spans(type_map: DataFrame, index: DataFrame) -> DataFrame:
    """type_map with g_start and g_end, null where no such token is. index: doc_id, sentence_id, token_id, idx of each token.

    A span's two ends lie in one sentence, so one join with the sentence's tokens
    gives both: the index is grouped by its keys once, and no row is doubled.
    """
    ends = type_map.select(*KEYS, F.explode(F.array("token_start", "token_end")).alias("token_id")).distinct()
    known = ends.join(index.select(*KEYS, "token_id", "idx"), [*KEYS, "token_id"])
    at = known.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("token_id", "idx"))).alias("at"))
    placed = type_map.join(at, KEYS, "left")
    return placed.withColumn("g_start", F.try_element_at("at", F.col("token_start"))).withColumn("g_end", F.try_element_at("at", F.col("token_end"))).drop("at")


def by_sentence_start(type_map: DataFrame, starts: DataFrame) -> DataFrame:
    """type_map with g_start and g_end as the sentence's start and the tokens' numbers, null without the sentence. starts: doc_id, sentence_id, start."""
    placed = type_map.join(starts.select(*KEYS, "start"), KEYS, "left")
    return placed.withColumn("g_start", F.col("start") + F.col("token_start")).withColumn("g_end", F.col("start") + F.col("token_end")).drop("start")


def span_types(placed: DataFrame, *carried: str) -> DataFrame:
    """doc_id, g_start, g_end, mention_type and carried columns of each span that has one type; of several mentions the greatest mention_id's."""
    span = ["doc_id", "g_start", "g_end"]
    own = placed.where("g_start IS NOT NULL AND g_end IS NOT NULL")
    last = own.groupBy(*span).agg(F.count_distinct("mention_type").alias("n"), F.max_by(F.struct("mention_type", *carried), "mention_id").alias("m"))
    return last.where("n <= 1").select(*span, "m.*")


def span_problems(placed: DataFrame) -> DataFrame:
    """doc_id, mention_id, problem: unaligned mentions, mentions whose span has more than one type, and repeated mention_ids (once each)."""
    span = ["doc_id", "g_start", "g_end"]
    lost = F.col("g_start").isNull() | F.col("g_end").isNull()
    unaligned = placed.where(lost).select("doc_id", "mention_id", F.lit("unaligned").alias("problem"))
    torn = placed.where(~lost).groupBy(*span).agg(F.count_distinct("mention_type").alias("n"), F.collect_list("mention_id").alias("ids")).where("n > 1")
    conflicting = torn.select("doc_id", F.explode("ids").alias("mention_id"), F.lit("conflicting_type").alias("problem"))
    twice = placed.groupBy("mention_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1")
    return unaligned.unionByName(conflicting).unionByName(twice.select("doc_id", "mention_id", F.lit("repeated_mention_id").alias("problem")))


def _problem(event_doc: Column, doc: Column, kind: Column, wanted: str) -> Column:
    return (
        F.when(doc.isNull(), "not_in_type_map")
        .when(~event_doc.eqNullSafe(doc), "doc_mismatch")
        .when(~F.coalesce(kind == wanted, F.lit(False)), "not_an_event_mention")
    )


def event_spans(events: DataFrame, placed: DataFrame, wanted: str) -> DataFrame:
    """event_id, doc_id, g_start, g_end, problem (null if none) of each event (event_id, doc_id), whose id is its mention's.

    The first of: not in the type map, there in another document, not of the
    wanted type. A mention_id that is repeated counts with its greatest span.
    """
    mentions = placed.groupBy(F.col("mention_id").alias("event_id")).agg(F.max(F.struct("doc_id", "g_start", "g_end", "mention_type")).alias("m"))
    j = events.select("event_id", "doc_id").join(mentions, "event_id", "left")
    problem = _problem(F.col("doc_id"), F.col("m.doc_id"), F.col("m.mention_type"), wanted)
    return j.select("event_id", "doc_id", "m.g_start", "m.g_end", problem.alias("problem"))
