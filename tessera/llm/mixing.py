"""Mixing sources to target weights in whole epochs and one partial one.

The mix is as large as ``share`` of all tokens. Sources get it by weight; no
target exceeds ``most`` times its source's size, and what that leaves over goes
to the others by weight until none is above. A source's documents get a
hash-random key; within each source they are range-partitioned by that key, the
ranges' token counts are summed and prefix sums taken over ranges and inside
each, so no task holds a source. Each document is taken once for every whole
epoch of its source, and in the last, partial epoch up to the exact budget: the
document at the cut gives its first tokens only.

The key hashes doc_id and text, so rows without doc_id, or of one, spread like the
others; only rows equal in both share a key. Ties go by doc_id and, where whole
rows are mixed, by the row's JSON, so reruns agree; rows equal in all columns are
interchangeable.

Defined results: null texts have size 0 and are never taken; a null source is a
source of its own and comes last; repeated rows count each; a null doc_id is
kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.names import quoted
from tessera.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Rows that a range of a source may hold on average, and the fewest ranges there are.
PER_RANGE, RANGES = 500_000, 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits of a hash of doc_id and the text."""
    parts = (F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{seed}|"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """From (source, size) per source: source, source_size, target. One row per source, so one task orders them."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    table = F.array(*map(F.lit, weights))
    ranked = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    )
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (
        # sources before this one are at their cap; the rest share what is left by weight
        ranked.withColumn(
            "level",
            (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / F.sum("weight").over(after),
        )
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    )
    return level.select(
        "source",
        "source_size",
        F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), F.col("cap").cast("double"))
        .otherwise(F.col("level") * F.col("weight"))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    seed: int = 0,
    ranges: int | None = None,
    carry: bool = False,
) -> DataFrame:
    """doc_id, source, size, source_size, target (of the source), taken (tokens of this document in the mix).

    ranges: of a source's keys; by default as many as the rows need. With carry, also the struct ``row`` of all columns of docs.
    """

    def keyed(*more: Column) -> DataFrame:
        text = F.col("text").cast("string")
        return docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            n_words(text).alias("size"),
            random_key(F.col("doc_id").cast("long"), text, seed).alias("key"),
            *more,
        )

    rows = materialize(keyed(), "sizes")
    width = (1 << 60) // (ranges or max(RANGES, rows.count() // PER_RANGE))

    def ranged(keyed_rows: DataFrame) -> DataFrame:
        return keyed_rows.withColumn("range", F.floor(F.col("key") / F.lit(width)).cast("int"))

    rows = ranged(rows)
    parts = rows.groupBy("source", "range").agg(F.sum("size").alias("size"))
    over = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    goals = (
        targets(parts, weights, share, most)
        .withColumn("budget", F.floor("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    starts = (
        parts.withColumn("before", F.coalesce(F.sum("size").over(over), F.lit(0)))
        .drop("size")
        .withColumnRenamed("source", "s")
        .join(goals, F.col("s").eqNullSafe(goals.source))
        .drop("s")
        .select(F.col("source").alias("s"), F.col("range").alias("r"), "before", "source_size", "target", "epochs", "rest")
    )
    ties = [F.to_json("row")] if carry else []
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged(keyed(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))) if carry else rows
    placed = whole.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(starts, placed.source.eqNullSafe(starts.s) & (placed.range == starts.r)).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (
            F.col("epochs") * F.col("size")
            + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("rest") - F.col("before") - F.col("inside")))
        ).alias("taken"),
        *(["row"] if carry else []),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, n.cast("int")), "")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, in the columns of docs: a document for each epoch that takes it, cut after its budget's last word in the partial one."""
    taken = mix(docs, carry=True, **how).where("taken > 0")
    each = taken.withColumn("epoch", F.explode(F.expr("sequence(0L, (taken - 1) div size)"))).withColumn(
        "n", F.least("size", F.col("taken") - F.col("epoch") * F.col("size"))
    )
    text = F.when(F.col("n") < F.col("size"), first_words(F.col("row.text"), F.col("n"))).otherwise(F.col("row.text"))
    columns = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        columns[docs.columns.index("n_chars")] = (
            F.when(F.col("n") < F.col("size"), F.length(text).cast(docs.schema["n_chars"].dataType))
            .otherwise(F.col("row.n_chars"))
            .alias("n_chars")
        )
    return each.select(columns)


SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|0|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight AS ratio FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM r),
m AS (SELECT (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1) AS level),
t AS (SELECT source, source_size, CASE WHEN m.level IS NULL OR ratio < m.level THEN cap::DOUBLE ELSE m.level * weight END AS target FROM r, m),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
p AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (
      PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT p.doc_id, p.source, p.size, g.source_size, g.target,
  (g.epochs * p.size + least(p.size, greatest(0, floor(g.target)::BIGINT - g.epochs * g.source_size - p.before)))::BIGINT AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""
