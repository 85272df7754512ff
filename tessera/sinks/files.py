"""Writers: delimited text, JSON lines, CoNLL text, manifests, packages."""

from __future__ import annotations

import hashlib
import os
import zipfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StructType

from tessera.scratch import materialize


def flat(df: DataFrame) -> DataFrame:
    """All columns as text: nested ones as JSON, booleans as 0 and 1."""

    def one(f) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ArrayType, StructType, MapType)):
            return F.to_json(c).alias(f.name)
        return (c.cast("int") if isinstance(f.dataType, BooleanType) else c).cast("string").alias(f.name)

    return df.select(*(one(f) for f in df.schema.fields))


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, sep: str = ",", bom: bool = False) -> None:
    """Delimited text with a header; only the named columns, in their order. With bom the first header bears a byte-order mark, as some spreadsheets want."""
    out = flat(df.select(columns) if columns else df)
    if bom:
        out = out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0])
    out.write.option("header", True).option("sep", sep).option("escape", '"').option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines; with an order also idx 0.. over it. Rows are dealt to ranges of the order and numbered by the counts of the ranges before and inside their own."""
    if order:
        rows = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
        starts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
        # one row for each partition
        base = starts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
        inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
        df = rows.withColumn("idx", inside).join(F.broadcast(base), "_part").withColumn("idx", F.col("idx") + F.col("_base")).drop("_part", "_base").orderBy("idx")
    df.write.json(path)


def write_lines(lines: DataFrame, path: str, order: list[str], column: str = "line") -> None:
    """Text lines in a total order over the files."""
    lines.orderBy(*order).select(F.col(column).cast("string")).write.text(path)


def conll_document_lines(lines: DataFrame) -> DataFrame:
    """doc_id, sentence_id, token_id, line: token lines with begin and end lines and the blank ones. lines: doc_id, sentence_id, token_id, line."""
    d = lines.select("doc_id").distinct()
    first = d.select("doc_id", F.lit(0).alias("sentence_id"), F.lit(0).alias("token_id"), F.concat(F.lit("#begin document ("), F.col("doc_id").cast("string"), F.lit("); part 000")).alias("line"))
    gaps = lines.select("doc_id", "sentence_id").distinct().select("doc_id", "sentence_id", F.lit(2147483647).alias("token_id"), F.lit("").alias("line"))
    last = d.select("doc_id", F.lit(2147483647).alias("sentence_id"), F.lit(0).alias("token_id"), F.explode(F.array(F.lit("#end document"), F.lit(""))).alias("line")).withColumn("token_id", (F.col("line") == "").cast("int"))
    return first.unionByName(lines.select("doc_id", "sentence_id", "token_id", "line")).unionByName(gaps).unionByName(last)


def write_sidecar(row: DataFrame, path: str, **known: object) -> None:
    """A one-row table (a summary, metrics, a configuration) as one pretty JSON object beside a result, after the known values; characters stay as they are.

    Raises where the table hasn't exactly one row.
    """
    fixed = [F.lit(value).alias(name) for name, value in known.items()]
    text = F.to_json(F.struct(*fixed, *(F.col(f"`{c}`") for c in row.columns)), {"pretty": "true", "ignoreNullFields": "false"})
    one = F.when(F.count("*") == 1, F.first(text)).otherwise(F.raise_error(F.concat(F.lit("a sidecar has one row, not "), F.count("*").cast("string"))))
    row.agg(one.alias("value")).coalesce(1).write.text(path)


def run_manifest(accepted: DataFrame, outputs: dict[str, str], filters: dict[str, float]) -> DataFrame:
    """One row: number accepted, filters and outputs as JSON."""
    pairs = lambda d: F.to_json(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]))
    return accepted.agg(F.count("*").alias("n_accepted"), F.min("gen_id").alias("first_id"), F.max("gen_id").alias("last_id")).withColumn("filters", pairs(filters)).withColumn("outputs", pairs(outputs))


def package(folder: str, target: str) -> str:
    """Zip a small staged release folder of the driver: files sorted by path, fixed times, MANIFEST.tsv; returns the zip's SHA-256 and writes it beside. Links are refused."""
    files = sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if f != "MANIFEST.tsv")
    if any(os.path.islink(os.path.join(folder, f)) for f in files):
        raise ValueError("symbolic links in the package")
    rows = ["path\tsize_bytes\tsha256"]
    for f in files:
        with open(os.path.join(folder, f), "rb") as source:
            data = source.read()
        rows.append(f"{f}\t{len(data)}\t{hashlib.sha256(data).hexdigest()}")
    with open(os.path.join(folder, "MANIFEST.tsv"), "w", encoding="utf-8") as out:
        out.write("\n".join(rows) + "\n")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted([*files, "MANIFEST.tsv"]):
            with open(os.path.join(folder, f), "rb") as source:
                z.writestr(zipfile.ZipInfo(f, (1980, 1, 1, 0, 0, 0)), source.read(), zipfile.ZIP_DEFLATED)
    with open(target, "rb") as source:
        digest = hashlib.sha256(source.read()).hexdigest()
    with open(f"{target}.sha256", "w") as out:
        out.write(f"{digest}  {os.path.basename(target)}\n")
    with zipfile.ZipFile(target) as z:
        if z.testzip():
            raise ValueError("the package can't be read back")
    return digest
