"""Placing the mentions of generated documents at character offsets.

A mention stands at the first place in its sentence that no earlier mention of
that sentence uses; where its text isn't found, its head (without a deictic
prefix) is searched for. Only mentions of one sentence stand in each other's
way, so a sentence is placed at a time and no document is gathered in a task.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessera.functions.text import let, normalize_head, safe_int, strip
from tessera.schemas import EVENT_CHAIN
from tessera.scratch import ship

ship(__name__)

ROLES = ("antecedent", "anaphor")


def mention_shape(m: Column) -> Column:
    """(sentence_id, role, text) of a mention given as role and text, as antecedent, or as anaphor; null if it is none of these. m: struct with these fields, null where absent."""
    own = m["role"].isNotNull() & m["text"].isNotNull()
    role = F.when(own, strip(m["role"])).when(m["antecedent"].isNotNull(), ROLES[0]).when(m["anaphor"].isNotNull(), ROLES[1])
    text = strip(F.when(own, m["text"]).otherwise(F.coalesce(m["antecedent"], m["anaphor"])))
    sid = safe_int(m["sentence_id"])
    good = sid.isNotNull() & role.isin(*ROLES) & (text != "")
    return F.when(good, F.struct(sid.alias("sentence_id"), role.alias("role"), text.alias("text")))


def trigger_shape(t: Column) -> Column:
    """(sentence_id, text) of an event chain's trigger; null if it lacks either."""
    sid, text = safe_int(t["sentence_id"]), strip(t["text"])
    return F.when(sid.isNotNull() & (text != ""), F.struct(sid.alias("sentence_id"), text.alias("text")))


def find_span(sentence: Column, text: Column, used: Column) -> Column:
    """(s, e) of the first place of text, else of its head, that overlaps no used (s, e); e exclusive; null without one."""

    def first(needle: Column) -> Column:
        n = F.length(needle)
        look = lambda after: F.call_function("locate", needle, sentence, after + 1)
        # used spans are disjoint: in their order, a place that meets one moves on to the next behind its end
        place = F.aggregate(
            F.array_sort(used),
            F.when(n > 0, F.coalesce(look(F.lit(0)), F.lit(0))).otherwise(0),
            lambda at, u: F.when((at > 0) & (at - 1 < u["e"]) & (u["s"] < at - 1 + n), look(u["e"])).otherwise(at),
        )
        return let(place, lambda at: F.when(at > 0, F.struct((at - 1).alias("s"), (at - 1 + n).alias("e"))))

    head = normalize_head(text)
    return F.coalesce(first(text), F.when(head != text, first(head)))


@F.pandas_udf(ArrayType(StructType([StructField("s", IntegerType()), StructField("e", IntegerType())])))
def _places(sent: pd.Series, texts: pd.Series, heads: pd.Series) -> pd.Series:
    """find_span() of each text in turn, with the spans found before as used ones.

    Spans in use only grow, so the first free place of a text never moves back: each search goes on where the last one for
    the same text ended, and the work grows with the sentence and not with the square of its mentions.
    """

    def place(sentence: str, starts: list[int], ends: list[int], since: dict[str, int], text: str) -> dict[str, int] | None:
        at = sentence.find(text, since.get(text, 0)) if text else -1
        while at >= 0:
            k = bisect_right(ends, at)
            if k == len(starts) or starts[k] >= at + len(text):
                break
            at = sentence.find(text, ends[k])
        since[text] = at if at >= 0 else len(sentence) + 1
        if at < 0:
            return None
        k = bisect_right(starts, at)
        starts.insert(k, at)
        ends.insert(k, at + len(text))
        return {"s": at, "e": at + len(text)}

    def row(sentence: str | None, mine: list[str | None], other: list[str | None]) -> list[dict[str, int] | None]:
        state = sentence or "", [], [], {}
        out = []
        for text, head in zip(mine, other, strict=True):
            found = place(*state, text or "")
            out.append(found or (place(*state, head) if head and head != text else None))
        return out

    return pd.Series([row(*x) for x in zip(sent, texts, heads, strict=True)])


def place_spans(sentences: DataFrame, mentions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """mentions with char_start and char_end (exclusive; both null where there is no place). Placed in ``order`` within keys and sentence_id.

    sentences: keys, sentence_id, sent, each (keys, sentence_id) once, as a sentence that stands twice doubles its mentions; mentions: keys, sentence_id, text and order. Their other columns stay; a mention whose
    sentence doesn't exist has no place.
    """
    at = [*keys, "sentence_id"]
    rest = [c for c in mentions.columns if c not in [*at, *order]]
    row = F.struct(*order, *rest)
    lists = mentions.groupBy(*at).agg(F.array_sort(F.collect_list(row)).alias("ms")).join(sentences.select(*at, "sent"), at, "left")
    texts = F.transform("ms", lambda m: m["text"])
    heads = F.transform("ms", lambda m: normalize_head(m["text"]))
    zipped = lists.withColumn("spans", _places("sent", texts, heads)).select(*at, F.explode(F.arrays_zip("ms", "spans")).alias("x"))
    return zipped.select(*at, "x.ms.*", F.col("x.spans.s").alias("char_start"), F.col("x.spans.e").alias("char_end")).select(*mentions.columns, "char_start", "char_end")


def add_char_spans(docs: DataFrame, sentence_range: tuple[int, int] = (5, 7), least_chains: int = 3, inclusive: bool = False, triggers: bool = False) -> DataFrame:
    """Aligned documents: doc_id, sentences, chains (type, index, start_sentence, end_sentence, mentions with offsets, trigger).

    docs: doc_id (unique), sentences (texts), chains (type, index, start_sentence, end_sentence, mentions as in mention_shape,
    trigger). A document is left out if its sentences or chains are too few or too many, if a chain has under two mentions, or if
    any mention, or with ``triggers`` any event chain's trigger, is malformed or has no place. A chain's own numbers stay; those it
    lacks are computed. Triggers are placed after the mentions of their chain. With ``inclusive`` char_end is the last character.
    """
    shaped = docs.where(F.size("sentences").between(*sentence_range) & (F.size("chains") >= least_chains)).select(
        "doc_id",
        "sentences",
        F.transform(
            "chains",
            lambda c: F.struct(
                c["type"].alias("type"), c["index"].alias("index"), c["start_sentence"].alias("start_sentence"), c["end_sentence"].alias("end_sentence"),
                F.transform(c["mentions"], mention_shape).alias("mentions"),
                F.when(F.lit(triggers) & (c["type"] == EVENT_CHAIN), F.coalesce(trigger_shape(c["trigger"]), F.struct(F.lit(0).alias("sentence_id"), F.lit("").alias("text")))).alias("trigger"),
            ),
        ).alias("chains"),
    )
    n = F.size("sentences")
    outside = lambda x: x.isNull() | ~x["sentence_id"].between(1, n)
    bad = F.exists(
        "chains",
        lambda c: F.coalesce(F.size(c["mentions"]) < 2, F.lit(True)) | F.exists(c["mentions"], outside) | (c["trigger"].isNotNull() & outside(c["trigger"])),
    )
    good = shaped.where(~F.coalesce(bad, F.lit(True)))
    sents = good.select("doc_id", F.posexplode("sentences").alias("p", "sent")).select("doc_id", (F.col("p") + 1).alias("sentence_id"), "sent")
    each = F.transform(
        "chains",
        lambda c, i: F.concat(
            F.transform(c["mentions"], lambda m, k: F.struct(m["sentence_id"].alias("sentence_id"), i.alias("chain"), k.alias("k"), m["role"].alias("role"), m["text"].alias("text"))),
            F.when(c["trigger"].isNotNull(), F.array(F.struct(c["trigger"]["sentence_id"].alias("sentence_id"), i.alias("chain"), F.size(c["mentions"]).alias("k"), F.lit("trigger").alias("role"), c["trigger"]["text"].alias("text")))).otherwise(
                F.array().cast("array<struct<sentence_id:int,chain:int,k:int,role:string,text:string>>")
            ),
        ),
    )
    rows = good.select("doc_id", F.explode(F.flatten(each)).alias("m")).select("doc_id", "m.*")
    spans = place_spans(sents, rows, ["doc_id"], ["chain", "k"]).withColumn("char_end", F.col("char_end") - int(inclusive))
    place = F.struct("sentence_id", "role", "text", "char_start", "char_end")
    chain = spans.groupBy("doc_id", "chain").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") != "trigger", F.struct("k", place.alias("m"))))), lambda x: x["m"]).alias("mentions"),
        F.max(F.when(F.col("role") == "trigger", F.struct("sentence_id", "text", "char_start", "char_end"))).alias("trigger"),
        F.min(F.when(F.col("role") != "trigger", F.col("sentence_id"))).alias("s"), F.max(F.when(F.col("role") != "trigger", F.col("sentence_id"))).alias("e"),
        F.count_if(F.col("char_start").isNull()).alias("lost"),
    )
    told = good.select("doc_id", F.posexplode("chains").alias("chain", "c")).join(chain, ["doc_id", "chain"]).groupBy("doc_id").agg(
        F.sum("lost").alias("lost"),
        F.array_sort(
            F.collect_list(
                F.struct(
                    "chain",
                    F.struct(
                        F.col("c.type").alias("type"), F.coalesce(safe_int(F.col("c.index")), F.col("chain") + 1).alias("index"),
                        F.coalesce(safe_int(F.col("c.start_sentence")), F.col("s")).alias("start_sentence"), F.coalesce(safe_int(F.col("c.end_sentence")), F.col("e")).alias("end_sentence"),
                        "mentions", "trigger",
                    ).alias("c"),
                )
            )
        ).alias("x"),
    )
    aligned = told.where("lost = 0").select("doc_id", F.transform("x", lambda x: x["c"]).alias("chains"))
    return good.select("doc_id", "sentences").join(aligned, "doc_id")
