"""Scores by slice: one pass over per-document metric parts for all groupings, in a fixed order, behind gates.

A grouping is a column of the documents' metadata and the labels that it may
have, in their order. Each grouping's slices cover all documents, so their totals
must equal the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import f1, macro_f1, ratio

#: Short names of the domains, and of the phenomena, in the order in which they are reported.
DOMAINS = ("PA", "BF", "TDG", "EDU", "SLSC")
PHENOMENA = ("Pronoun", "Demonstrative", "DefiniteNP", "Zero", "Event")
GROUPINGS = {"domain": DOMAINS, "phenomenon": PHENOMENA}
PARTS = {
    "muc": ("muc_rn", "muc_rd", "muc_pn", "muc_pd"),
    "b3": ("b3_rn", "b3_rd", "b3_pn", "b3_pd"),
    "ceafe": ("ceafe_n", "ceafe_rd", "ceafe_n", "ceafe_pd"),
}
BLANC = ("cg", "cp", "cb", "ng", "np", "nb")


def label_of(names: dict[str, str], label: Column) -> Column:
    """The short name of a label; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), label)


def slice_problems(docs: DataFrame, meta: DataFrame, groupings: dict[str, tuple[str, ...]] = GROUPINGS, split: str | None = None, expected: int | None = None) -> DataFrame:
    """doc_id, problem, value: what stands against slicing docs by meta (doc_id, the groupings' columns, and split if one is asked).

    no_metadata, repeated_metadata, other_split, unknown_<grouping>; and a row
    without doc_id where docs aren't as many as expected. Documents and metadata
    rows that no grouping asks for aren't looked at.
    """
    own = docs.select("doc_id").distinct()
    rows = meta.join(own, "doc_id", "left_semi")
    lost = own.join(meta.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("no_metadata").alias("problem"), F.lit(None).cast("string").alias("value"))
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit("repeated_metadata"), F.col("n").cast("string"))
    found = [lost, twice]
    if split is not None:
        found.append(rows.where(~F.col("split").eqNullSafe(F.lit(split))).select("doc_id", F.lit("other_split"), F.col("split").cast("string")))
    for name, labels in groupings.items():
        found.append(rows.where(~F.coalesce(F.col(name).isin(*labels), F.lit(False))).select("doc_id", F.lit(f"unknown_{name}"), F.col(name).cast("string")))
    if expected is not None:
        n = own.agg(F.count("*").alias("n")).where(F.col("n") != expected)
        found.append(n.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit("total"), F.col("n").cast("string")))
    return reduce(DataFrame.union, found)


def slice_sums(parts: DataFrame, meta: DataFrame, groupings: dict[str, tuple[str, ...]] = GROUPINGS) -> DataFrame:
    """grouping, slice, place, n_docs and the sums of the parts: all, then each grouping's labels in order, also those without documents.

    Raises where the slices of a grouping don't add up to all documents.
    """
    spark = parts.sparkSession
    names = list(groupings)
    numbers = [c for c in parts.columns if c != "doc_id"]
    joined = parts.join(meta.select("doc_id", *names), "doc_id", "left")
    sums = [F.count("*").alias("n_docs"), *(F.sum(c).alias(c) for c in numbers)]
    sets = [[], *([F.col(n)] for n in names)]
    grouped = joined.groupingSets(sets, *names).agg(F.grouping_id().alias("gid"), *sums)
    # the bit of a column is 1 where it is not grouped by; the first column has the highest
    every = (1 << len(names)) - 1
    kind = F.when(F.col("gid") == every, "all")
    label = F.lit("all")
    for k, name in enumerate(names):
        mine = F.col("gid") == every - (1 << (len(names) - 1 - k))
        kind, label = kind.when(mine, name), F.when(mine, F.col(name)).otherwise(label)
    named = grouped.select(kind.alias("grouping"), label.alias("slice"), "n_docs", *numbers)
    order = [("all", "all"), *((n, x) for n, labels in groupings.items() for x in labels)]
    wanted = spark.createDataFrame([(g, x, i) for i, (g, x) in enumerate(order)], "grouping string, slice string, place int")
    # as many rows as labels
    full = F.broadcast(wanted).join(named, ["grouping", "slice"], "left").na.fill(0, ["n_docs", *numbers])
    total = F.sum("n_docs").over(_window("grouping"))
    corpus = F.max(F.when(F.col("grouping") == "all", F.col("n_docs"))).over(_window())
    gate = F.when(total != corpus, F.raise_error(F.concat(F.lit("slices by "), "grouping", F.lit(" hold "), total, F.lit(" of "), corpus, F.lit(" documents"))))
    return full.withColumn("place", F.coalesce(gate.cast("int"), F.col("place")))


def _window(*by: str):
    from pyspark.sql import Window

    return Window.partitionBy(*by)


def slice_scores(parts: DataFrame, meta: DataFrame, groupings: dict[str, tuple[str, ...]] = GROUPINGS) -> DataFrame:
    """place, grouping, slice, n_docs, recall, precision and F1 of each metric that parts have, and their means where all are there."""
    sums = slice_sums(parts, meta, groupings)
    out, scores = [], []
    for name, (rn, rd, pn, pd) in PARTS.items():
        if rn in sums.columns:
            r, p = ratio(rn, rd), ratio(pn, pd)
            out += [r.alias(f"{name}_r"), p.alias(f"{name}_p"), f1(p, r).alias(f"{name}_f1")]
            scores.append(f1(p, r))
    if "cb" in sums.columns:
        c, n = ((ratio(f"{k}b", f"{k}p"), ratio(f"{k}b", f"{k}g")) for k in "cn")
        no_c, no_n = (F.col("cg") + F.col("cp")) == 0, (F.col("ng") + F.col("np")) == 0
        mean = lambda a, b: F.when(no_c, b).when(no_n, a).otherwise((a + b) / 2)
        blanc = mean(f1(*c), f1(*n))
        out += [mean(c[1], n[1]).alias("blanc_r"), mean(c[0], n[0]).alias("blanc_p"), blanc.alias("blanc_f1")]
        if len(scores) == len(PARTS):
            out += [macro_f1(*scores).alias("conll_f1"), macro_f1(*scores, blanc).alias("avg_f4")]
    return sums.select("place", "grouping", "slice", "n_docs", *out)
