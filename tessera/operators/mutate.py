"""Corrections of annotations, driven by small fix tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.corpus import chain_types, doc_categories
from tessera.schemas import DEFINITE, EVENT_MENTION, PERSON, ZERO, ZERO_SIGN


def entity_type(text: Column) -> Column:
    """The type of a mention of an entity chain by its text."""
    return F.when(text == ZERO_SIGN, ZERO).when(text == "其", PERSON).otherwise(DEFINITE)


def relabel_chains(mentions: DataFrame, chains: DataFrame) -> DataFrame:
    """Mentions of the listed chains (doc_id, chain_id) become ENTITY, with types by their text."""
    hit = mentions.join(chains.select("doc_id", "chain_id", F.lit(True).alias("_h")).distinct(), ["doc_id", "chain_id"], "left")
    return (
        hit.withColumn("mention_type", F.when(F.col("_h"), entity_type(F.col("text"))).otherwise(F.col("mention_type")))
        .withColumn("semantics", F.when(F.col("_h"), "ENTITY").otherwise(F.col("semantics")))
        .select(mentions.columns)
    )


def edit_mentions(mentions: DataFrame, fixes: DataFrame) -> DataFrame:
    """Set text and char_start, or delete. fixes: doc_id, chain_id, sentence_id, text (as it is), new_text, new_start, delete."""
    key = ["doc_id", "chain_id", "sentence_id", "text"]
    joined = mentions.join(fixes, key, "left").where("NOT coalesce(`delete`, false)")
    start = F.coalesce("new_start", "char_start")
    text = F.coalesce("new_text", "text")
    end = F.when(F.col("new_start").isNotNull() | F.col("new_text").isNotNull(), start + F.length(text) - 1).otherwise(F.col("char_end"))
    changed = {"text": text, "char_start": start, "char_end": end}
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in mentions.columns))


def fix_gate(mentions: DataFrame, fixes: DataFrame) -> DataFrame:
    """Fixes that don't hit exactly one mention: the key and n."""
    key = ["doc_id", "chain_id", "sentence_id", "text"]
    n = mentions.groupBy(*key).agg(F.count("*").alias("n"))
    return fixes.select(key).join(n, key, "left").select(*key, F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def remove_chars(sentences: DataFrame, mentions: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take one character out of sentences and its mention out of the chains; later offsets in the sentence fall by one.

    removals: doc_id, sentence_id, pos; one per sentence. Returns (sentences, mentions).
    """
    key = ["doc_id", "sentence_id"]
    s = sentences.join(removals, key, "left").withColumn(
        "sent", F.when(F.col("pos").isNotNull(), F.concat(F.expr("substring(sent, 1, pos)"), F.expr("substring(sent, pos + 2)"))).otherwise(F.col("sent"))
    )
    m = mentions.join(removals, key, "left").where("pos IS NULL OR NOT (char_start = pos AND char_end = pos)")
    moved = {
        "char_start": F.col("char_start") - F.when(F.col("char_start") > F.col("pos"), 1).otherwise(0),
        "char_end": F.col("char_end") - F.when(F.col("char_end") >= F.col("pos"), 1).otherwise(0),
    }
    return s.select(sentences.columns), m.select(*(moved[c].alias(c) if c in moved else F.col(c) for c in mentions.columns))


def remove_first(text: Column, sign: str = ZERO_SIGN) -> Column:
    """The text without the first occurrence of the sign."""
    at = F.instr(text, sign)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(sign), F.length(text)))).otherwise(text)


def as_event_mention(mentions: DataFrame, added: DataFrame) -> DataFrame:
    """Append overt event mentions in place of removed zeros."""
    return mentions.unionByName(added.withColumn("mention_type", F.lit(EVENT_MENTION)).withColumn("semantics", F.lit("EVENT")).select(mentions.columns))


def rederive(mentions: DataFrame, affected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chain types and ranges, categories) of the affected documents only."""
    part = mentions.join(affected.select("doc_id").distinct(), "doc_id", "left_semi")
    chains = chain_types(part)
    return chains, doc_categories(chains)
