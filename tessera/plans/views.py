"""The pseudo-corpus that the plans run on, derived from the plain tables in Spark and in SQL alike.

Sentences and word tokens come from ``documents``; a mention is a word of six
letters or more whose lower-case form occurs at least twice in its document, and
these occurrences are its chain. Types, semantics, splits, scores and
predictions are drawn from MD5 of the keys, so both engines agree on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.schemas import DEFINITE, DEMONSTRATIVE, EVENT_MENTION, PERSON, ZERO

TYPES = [ZERO, PERSON, DEMONSTRATIVE, DEFINITE, EVENT_MENTION]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draw(*parts: Column | str) -> Column:
    """32 bits of MD5 of the parts joined by |."""
    key = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def split_of(doc_id: Column | str) -> Column:
    h = draw(doc_id) % 10
    return F.when(h < 7, "train").when(h == 7, "dev").otherwise("test")


def sentences(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """dealt: by document, texts as they are, so that no word is dealt later."""
    found = F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?\n]?"), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (docs.repartition("doc_id") if dealt else docs).select("doc_id", F.posexplode(found).alias("s", "sent")).select(
        "doc_id", (F.col("s") + 1).alias("sentence_id"), "sent"
    )


def tokens(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    found = F.regexp_extract_all("sent", F.lit(r"[A-Za-z\x{C0}-\x{24F}]+"), F.lit(0))
    return sentences(spark, sf_dir, dealt).select("doc_id", "sentence_id", F.posexplode(found).alias("token_id", "tok"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sentence_id, token_id, tok, chain_id, mention_type, semantics, is_zero, split."""
    word = Window.partitionBy("doc_id", "low")
    pos = F.struct("sentence_id", "token_id")
    h = draw("doc_id", "sentence_id", "token_id")
    found = (
        tokens(spark, sf_dir, dealt=True)
        .where(F.length("tok") >= 6)
        .withColumn("low", F.lower("tok"))
        .withColumn("n", F.count("*").over(word))
        .where("n >= 2")
        .withColumn("first", F.min(pos).over(word))
    )
    kind = F.array(*map(F.lit, TYPES))[(h % 5).cast("int")]
    return (
        found.withColumn("chain_id", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first")))
        .withColumn("mention_type", kind)
        .select(
            "doc_id",
            "sentence_id",
            "token_id",
            "tok",
            "chain_id",
            "mention_type",
            F.when((F.col("mention_type") == EVENT_MENTION) | (h % 7 == 0), "EVENT").otherwise("ENTITY").alias("semantics"),
            (F.col("mention_type") == ZERO).alias("is_zero"),
            split_of("doc_id").alias("split"),
        )
    )


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with pred_id: one in ten is missing, one in ten is in the next chain, the others as in gold."""
    h = draw(F.lit("p"), "doc_id", "sentence_id", "token_id") % 10
    top = F.max("chain_id").over(Window.partitionBy("doc_id"))
    return mentions(spark, sf_dir).withColumn("h", h).withColumn("top", top).where("h > 0").select(
        "doc_id",
        "sentence_id",
        "token_id",
        "is_zero",
        F.when(F.col("h") == 1, F.col("chain_id") % F.col("top") + 1).otherwise(F.col("chain_id")).alias("pred_id"),
    )


def digest(df: DataFrame, *columns: str) -> DataFrame:
    """Per doc_id: n rows and the sum of a hash of each, over these expressions. Whole results that have a row per pair are compared so."""
    key = F.concat_ws("|", *(F.coalesce(F.expr(c).cast("string"), F.lit("-")) for c in columns))
    hashed = F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(hashed).cast("string").alias("digest"))


def digest_sql(source: str, *columns: str) -> str:
    parts = ", ".join(f"coalesce(({c})::VARCHAR, '-')" for c in columns)
    return f"SELECT doc_id, count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', {parts})), 1, 15))::BIGINT)::VARCHAR AS digest FROM ({source}) GROUP BY doc_id"


#: A prime, and factors for hashes by arithmetic that stay below 2 to the 63rd.
PRIME, FACTOR, START = 2147483647, 48271, 69621


def numbers_digest(df: DataFrame, *columns: str) -> DataFrame:
    """digest() over whole numbers and truth values, by arithmetic: a row costs a few multiplications."""
    h = F.lit(START).cast("long")
    for c in columns:
        value = F.coalesce(F.expr(c).cast("long"), F.lit(-1))
        h = F.pmod(h * FACTOR + value, F.lit(PRIME))
        h = F.pmod(h * h + START, F.lit(PRIME))
    return df.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("digest"))


def numbers_digest_sql(source: str, *columns: str) -> str:
    steps, last = "", "s"
    for k, c in enumerate(columns):
        mixed = f"((h * {FACTOR} + coalesce(({c})::BIGINT, -1)) % {PRIME} + {PRIME}) % {PRIME}"
        steps += f", n{k} AS (SELECT * REPLACE ((({mixed}) * ({mixed}) + {START}) % {PRIME} AS h) FROM {last})"
        last = f"n{k}"
    return f"SELECT doc_id, count(*) AS n, sum(h)::VARCHAR AS digest FROM (WITH s AS (SELECT *, {START}::BIGINT AS h FROM ({source})){steps} SELECT * FROM {last}) GROUP BY doc_id"


#: Factors of the two mentions' draws for each kind of draw on a pair.
PAIR_DRAWS = {"score": (48271, 69621), "some": (39373, 16807), "swap": (40692, 40014)}


def pair_draw(kind: str) -> Column:
    """31 bits for a pair out of the draws of its mentions, h1 and h2."""
    a, b = PAIR_DRAWS[kind]
    return F.pmod(F.col("h1") * a + F.col("h2") * b, F.lit(PRIME))


def pair_draw_sql(kind: str) -> str:
    a, b = PAIR_DRAWS[kind]
    return f"((h1 * {a} + h2 * {b}) % {PRIME})"


SENT = r"""v_sent AS (
  SELECT doc_id, unnest(range(1, len(a) + 1))::INT AS sentence_id, unnest(a) AS sent
  FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?\n]?') AS a FROM documents))"""
TOK = SENT + r""",
v_tok AS (
  SELECT doc_id, sentence_id, unnest(range(0, len(a)))::INT AS token_id, unnest(a) AS tok
  FROM (SELECT doc_id, sentence_id, regexp_extract_all(sent, '[A-Za-z\x{C0}-\x{24F}]+') AS a FROM v_sent))"""


def draw_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def split_sql(doc_id: str = "doc_id") -> str:
    return f"CASE WHEN {draw_sql(doc_id)} % 10 < 7 THEN 'train' WHEN {draw_sql(doc_id)} % 10 = 7 THEN 'dev' ELSE 'test' END"


_KIND = "CASE h % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"
MENTION = TOK + f""",
v_mention AS (
  SELECT doc_id, sentence_id, token_id, tok, dense_rank() OVER (PARTITION BY doc_id ORDER BY f1, f2)::INT AS chain_id,
    {_KIND} AS mention_type, CASE WHEN h % 5 = 4 OR h % 7 = 0 THEN 'EVENT' ELSE 'ENTITY' END AS semantics, h % 5 = 0 AS is_zero, {split_sql()} AS split
  FROM (SELECT *, {draw_sql('doc_id', 'sentence_id', 'token_id')} AS h,
          first_value(sentence_id) OVER (PARTITION BY doc_id, lower(tok) ORDER BY sentence_id, token_id) AS f1,
          first_value(token_id) OVER (PARTITION BY doc_id, lower(tok) ORDER BY sentence_id, token_id) AS f2,
          count(*) OVER (PARTITION BY doc_id, lower(tok)) AS n
        FROM v_tok WHERE length(tok) >= 6) WHERE n >= 2)"""
PREDICTED = MENTION + f""",
v_pred AS (
  SELECT doc_id, sentence_id, token_id, is_zero, CASE WHEN h = 1 THEN chain_id % top + 1 ELSE chain_id END AS pred_id
  FROM (SELECT *, {draw_sql("'p'", 'doc_id', 'sentence_id', 'token_id')} % 10 AS h, max(chain_id) OVER (PARTITION BY doc_id) AS top FROM v_mention) WHERE h > 0)"""
