"""Readers of corpus files: JSON arrays, delimited text, JSON lines, id lists, bytes and state tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera import schemas as S
from tessera.scratch import ship
from tessera.sources.splits import json_objects

ship(__name__)

ENCODINGS = ["utf-8-sig", "utf-8", "gb18030", "gbk"]


@F.pandas_udf(StringType())
def decode_any(content: pd.Series) -> pd.Series:
    """Bytes as text in the first encoding that fits; UTF-8 with replacement if none does."""

    def one(raw: bytes) -> str:
        for name in ENCODINGS:
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return raw.decode("utf-8", "replace")

    return content.map(one)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files in any of the encodings."""
    return spark.read.format("binaryFile").load(path).select("path", decode_any("content").alias("text"))


def _documents(parsed: DataFrame, schema: str) -> DataFrame:
    """Documents of row_index and raw, the JSON of each."""
    flat = F.from_json("raw", schema)
    items = F.from_json(F.get_json_object("raw", "$.sentences"), "array<string>")
    sentences = F.transform(items, lambda x: F.coalesce(F.get_json_object(x, "$.text"), x))
    return parsed.select("row_index", flat.alias("d"), sentences.alias("s")).select("row_index", "d.*", "s").withColumn("sentences", F.col("s")).drop("s")


def read_corpus(spark: SparkSession, path: str, schema: str = S.DOCUMENT) -> DataFrame:
    """Documents of JSON-array files with row_index, their place in the array. Sentences may be texts or objects with a text. A file is one row, 2 GB at most."""
    return _documents(text_files(spark, path).select(F.posexplode(F.from_json("text", "array<string>")).alias("row_index", "raw")), schema)


def read_large_corpus(spark: SparkSession, path: str, schema: str = S.DOCUMENT) -> DataFrame:
    """read_corpus() of UTF-8 files of any size, which are read by byte ranges; arrays hold objects only."""
    return _documents(json_objects(spark, path).select("row_index", "raw"), schema)


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited text with a header, all values text, a byte-order mark dropped, missing values empty."""
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns)).na.fill("")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_ids(spark: SparkSession, path: str, unique: bool = False) -> DataFrame:
    """doc_id of an id list: trimmed, blank lines left out. With unique an id that stands twice raises."""
    ids = spark.read.text(path).select(F.trim("value").alias("doc_id")).where("doc_id <> ''")
    if unique and (twice := ids.groupBy("doc_id").count().where("count > 1").limit(10).collect()):
        raise ValueError(f"ids that stand more than once: {sorted(r.doc_id for r in twice)}")
    return ids


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str = S.DOCUMENT) -> DataFrame:
    """One corpus file per split, with ids such as TRAIN_000001."""
    frames = [
        read_corpus(spark, p, schema).withColumn("split", F.lit(name)).withColumn("doc_id", F.format_string(f"{name.upper()}_%06d", F.col("row_index") + 1))
        for name, p in paths.items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def join_split_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents of a frozen corpus by position; row_index of the split rows counts before global_doc_index, and their metadata before the documents'."""
    at = F.coalesce(F.expr("try_cast(nullif(row_index, '') AS INT)"), F.expr("try_cast(nullif(global_doc_index, '') AS INT)"))
    meta = rows.select(at.alias("_at"), "doc_id", "split", *(F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in ("domain", "category_primary")))
    j = meta.join(docs, F.col("_at") == docs.row_index)
    return j.withColumn("domain", F.coalesce("_domain", "domain")).withColumn("category_primary", F.coalesce("_category_primary", "category_primary")).drop("_at", "_domain", "_category_primary")


def bad_split_rows(docs: DataFrame, rows: DataFrame, splits: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """Split rows whose index no document has, or whose split is unknown: doc_id, problem."""
    at = F.coalesce(F.expr("try_cast(nullif(row_index, '') AS INT)"), F.expr("try_cast(nullif(global_doc_index, '') AS INT)"))
    known = docs.select(F.col("row_index").alias("_at"))
    lost = rows.withColumn("_at", at).join(known, "_at", "left_anti").select("doc_id", F.lit("index_out_of_range").alias("problem"))
    return lost.unionByName(rows.where(~F.col("split").isin(*splits)).select("doc_id", F.lit("unknown_split").alias("problem")))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, sha256 of files, in byte order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def sensitive_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line of packaged text files where a path or key pattern stands."""
    from tessera.functions.text import SENSITIVE_KEY, SENSITIVE_PATH

    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return lines.where(F.col("line").rlike(SENSITIVE_PATH) | F.col("line").rlike(SENSITIVE_KEY))


def state_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table, or an empty one where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def scorer_output(text: Column) -> Column:
    """R, P and F1 (of the last such line) of a scorer's output, for Coreference or BLANC."""
    line = F.element_at(F.regexp_extract_all(text, F.lit(r"(?m)^((?:Coreference|BLANC):.*F1:.*)$"), F.lit(1)), -1)

    def number(name: str) -> Column:
        return F.regexp_extract(line, name + r".*?([0-9.]+)%", 1).try_cast("double")

    return F.struct(number("Recall:").alias("recall"), number("Precision:").alias("precision"), number("F1:").alias("f1"))
