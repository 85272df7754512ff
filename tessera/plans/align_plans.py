"""Alignment of mentions to characters, over the derived corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import align as A
from tessera.plans import views as V


def mention_alignment(s, d):
    """Every second mention or so with a deictic prefix before it, as generated ones have, so that its head is searched for."""
    text = F.when(F.col("token_id") % 2 == 0, F.concat(F.lit("该"), "tok")).otherwise(F.col("tok"))
    m = V.mentions(s, d).select("doc_id", "chain_id", "sentence_id", "token_id", text.alias("text"))
    # a chain's mentions follow each other by sentence, so the token orders them within one
    return A.place_spans(V.sentences(s, d), m, ["doc_id"], ["chain_id", "token_id"]).drop("text")


def aligned_documents(s, d):
    """Documents all of whose chains find their places, with the number of their chains and the sum of their offsets."""
    m = V.mentions(s, d)
    none = F.lit(None).cast("string")
    one = F.struct(
        F.col("sentence_id").cast("string").alias("sentence_id"), none.alias("role"), none.alias("text"),
        F.when(F.col("first"), F.col("tok")).alias("antecedent"), F.when(~F.col("first"), F.col("tok")).alias("anaphor"),
    )
    head = F.min(F.struct("sentence_id", "token_id")).over(Window.partitionBy("doc_id", "chain_id")) == F.struct("sentence_id", "token_id")
    chains = m.withColumn("first", head).groupBy("doc_id", "chain_id").agg(F.array_sort(F.collect_list(F.struct("sentence_id", "token_id", one.alias("m")))).alias("ms"))
    whole = F.struct(
        F.lit("").alias("type"), none.alias("index"), none.alias("start_sentence"), none.alias("end_sentence"), F.transform("ms", lambda x: x["m"]).alias("mentions"),
        F.lit(None).cast("struct<sentence_id: string, text: string>").alias("trigger"),
    )
    docs = chains.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chain_id", whole.alias("c")))), lambda x: x["c"]).alias("chains"))
    sents = V.sentences(s, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sentence_id", "sent"))), lambda x: x["sent"]).alias("sentences"))
    most = 2147483647
    out = A.add_char_spans(sents.join(docs, "doc_id"), (1, most), 1)
    starts = F.flatten(F.transform("chains", lambda c: F.transform(c["mentions"], lambda x: x["char_start"])))
    total = F.aggregate(starts, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", F.size("chains").alias("n_chains"), F.size(starts).alias("n_mentions"), total.alias("sum_start"))


#: Placing is sequential; the tests hold both against a plain search.
PLANS = {"mention_alignment": (mention_alignment, None), "aligned_documents": (aligned_documents, None)}
