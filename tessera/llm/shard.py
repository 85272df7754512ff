"""Sharding by extendible hashing, with DataFrame functions only.

Every document has 60 bits of a hash of its key. A directory of hash prefixes
starts at the empty prefix; only buckets above the byte limit split on another
bit, until each shard fits. Bits are looked at ``STRIDE`` at a time: one pass
sums bytes per prefix and settles all buckets that fit within these bits, and
only documents of buckets that are still too large go on to the next bits. With
a key other than doc_id, the first half of the bits is the key's and the rest
doc_id's, so a key that holds a large share of the rows still splits. Documents
whose bits are all equal (repeated rows) are dealt to overflow pages.

Defined results: a null text has 0 bytes; a null doc_id or key hashes as empty
text; a document above the limit has a shard of its own (oversized); an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.names import fresh, quoted
from tessera.scratch import materialize

BITS, STRIDE = 60, 10
LIMIT = 16 << 20


def bits_of(value: Column, bits: int) -> Column:
    """The first bits (a multiple of 4) of md5 of the value's text."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, bits // 4), 16, 10).cast("long")


def _down(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", value, bits if isinstance(bits, Column) else F.lit(bits))


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", carry: bool = False) -> DataFrame:
    """doc_id, bytes, shard (b and the bits of its prefix, and a page after overflow), depth, shard_docs, shard_bytes, oversized.

    With carry, also the struct ``row`` of all columns of docs.
    """
    row = [F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")] if carry else []
    also = ["row"] if carry else []
    own = bits_of(F.col("doc_id"), BITS) if key == "doc_id" else (
        F.call_function("shiftleft", bits_of(F.col(key), 32), F.lit(BITS - 32)).bitwiseOR(bits_of(F.col("doc_id"), BITS - 32))
    )
    left = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes"),
            own.alias("hash"),
            F.pmod(F.monotonically_increasing_id(), F.lit(256)).cast("int").alias("salt"),
            *row,
        ),
        "sizes",
    )
    done = []
    for end in range(STRIDE, BITS + 1, STRIDE):
        prefix = _down(F.col("hash"), BITS - end)
        sums = left.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"))
        levels = sums.select(
            "prefix", "docs", "bytes", F.explode(F.array(*map(F.lit, range(end - STRIDE, end + 1)))).alias("depth")
        ).withColumn("node", _down(F.col("prefix"), F.lit(end) - F.col("depth")))
        nodes = levels.groupBy("depth", "node").agg(F.sum("docs").alias("shard_docs"), F.sum("bytes").alias("shard_bytes"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)
        homes = materialize(
            levels.drop("docs", "bytes")
            .join(nodes.where(fits), ["depth", "node"])
            .groupBy("prefix")
            .agg(F.min(F.struct("depth", "node", "shard_docs", "shard_bytes")).alias("home")),
            "homes",
        )
        joined = left.withColumn("prefix", prefix).join(F.broadcast(homes) if end == STRIDE else homes, "prefix", "left")
        if end < BITS:
            left_over = joined.where("home IS NULL").select("doc_id", "bytes", "hash", "salt", *also)
            more = not left.withColumn("prefix", prefix).join(homes, "prefix", "left_anti").isEmpty()
        done.append(
            joined.where("home IS NOT NULL").select(
                "doc_id",
                "bytes",
                F.concat(
                    F.lit("b"),
                    F.when(F.col("home.depth") == 0, "").otherwise(F.lpad(F.bin("home.node"), F.col("home.depth"), F.lit("0"))),
                ).alias("shard"),
                F.col("home.depth").alias("depth"),
                F.col("home.shard_docs").alias("shard_docs"),
                F.col("home.shard_bytes").alias("shard_bytes"),
                *also,
            )
        )
        if end < BITS:
            if not more:
                return _finish(done, limit)
            left = materialize(left_over, "sizes")
    full = joined.where("home IS NULL").select("doc_id", "bytes", "hash", "salt", *also)
    # all bits are equal: deal each salt's rows to pages that hold as many of the largest as fit
    room = full.groupBy("hash").agg(F.max("bytes").alias("top"))
    number = F.row_number().over(Window.partitionBy("hash", "salt").orderBy("doc_id", "bytes")) - 1
    pages = (
        full.join(room, "hash")
        .withColumn("page", F.floor(number / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("top", F.lit(1))))))
        .withColumn("shard", F.concat(F.lit("b"), F.lpad(F.bin("hash"), BITS, "0"), F.lit("#"), "salt", F.lit("."), "page"))
    )
    totals = pages.groupBy("shard").agg(F.count("*").alias("shard_docs"), F.sum("bytes").alias("shard_bytes"))
    done.append(
        pages.join(totals, "shard").select("doc_id", "bytes", "shard", F.lit(BITS).alias("depth"), "shard_docs", "shard_bytes", *also)
    )
    return _finish(done, limit)


def _finish(done: list[DataFrame], limit: int) -> DataFrame:
    return reduce(DataFrame.unionByName, done).withColumn("oversized", F.col("shard_bytes") > limit)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id") -> None:
    """Write every row of docs as Parquet, in the folder of its shard."""
    rows = assign(docs, limit, key, carry=True).select("row", "shard").repartition("shard")
    into = fresh(docs, "shard") if "shard" in docs.columns else "shard"
    rows.select(*(F.col("row")[c].alias(c) for c in docs.columns), F.col("shard").alias(into)).write.partitionBy(into).parquet(path)


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents),
l AS (SELECT *, unnest(range(0, 31)) AS depth FROM d),
n AS (SELECT depth, hash >> (60 - depth)::INT AS node, count(*) AS shard_docs, sum(bytes)::BIGINT AS shard_bytes
      FROM l GROUP BY 1, 2 HAVING sum(bytes) <= {LIMIT} OR count(*) = 1),
h AS (SELECT doc_id, bytes, l.hash, n.depth, node, shard_docs, shard_bytes,
             row_number() OVER (PARTITION BY doc_id, l.hash ORDER BY n.depth) AS k
      FROM l JOIN n ON n.depth = l.depth AND n.node = l.hash >> (60 - l.depth)::INT)
SELECT doc_id, bytes, 'b' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(node), depth::INT, '0') END AS shard,
       depth::INT AS depth, shard_docs, shard_bytes, shard_bytes > {LIMIT} AS oversized
FROM h WHERE k = 1
"""
