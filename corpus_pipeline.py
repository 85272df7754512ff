"""The corpus pipeline: quality classifier, near-duplicate join, substring dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Null texts count as empty and are rejected with the blank
ones by what the classifier learned of them; rows repeated with one doc_id count
as copies, of which one stays; an empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mil, mixing, spans
from tessera.llm.jaccard import jaccard_join
from tessera.llm.names import fresh
from tessera.scratch import materialize, scratch_path

CUTOFF = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier scores at CUTOFF or above. It learns from labelled rows of documents outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")
    )
    model = mil.fit(docs, labels.where(~mil.held_out(F.col("doc_id"))))
    # a name of its own: documents may have a column score
    into = fresh(docs, "score")
    return mil.score(docs, model, into).where(F.col(into) >= CUTOFF).drop(into)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates, the one with the least doc_id; texts without words stay."""
    groups = materialize(jaccard_join(docs, leaders=True).where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "tag", "leads"), "groups")
    doc, tag = fresh(docs, "doc"), fresh(docs, "tag")
    key = [F.col("doc_id").cast("long") == F.col(doc), F.xxhash64(F.col("text").cast("string")) == F.col(tag)]

    def rows(of: DataFrame) -> DataFrame:
        return of.select(F.col("doc_id").alias(doc), F.col("tag").alias(tag))

    gone = rows(groups.where("NOT leads").select("doc_id", "tag").distinct())
    repeated = rows(groups.where("leads").groupBy("doc_id", "tag").count().where("count > 1"))
    kept = docs.join(gone.unionByName(repeated), key, "left_anti")
    once = docs.join(repeated, key, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(once)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages; a document that had words and lost them all goes."""
    new = spans.substring_dedup(docs, carry=True).where("n_removed = 0 OR n_removed < n_sentences")
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text")}
    return new.select([own[f.name].cast(f.dataType).alias(f.name) if f.name in own else F.col("row")[f.name].alias(f.name) for f in docs.schema.fields])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source up to its target."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every whole text and decode its ids again."""
    return bpe.digest(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("mixing sources", mix),
    ("byte-level BPE", tokens),
]

#: No SQL expresses the classifier and the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
