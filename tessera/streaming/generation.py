"""The append-only parts as streams: generation log, dedup against all accepted, carried state, document filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import hamming, simhash
from tessera.operators import dedup as D
from tessera.scratch import materialize
from tessera.streaming.state import Versions, carried

ACCEPTED = "doc_id long, text string"
REP = "rep struct<doc_id: long, tag: long>"
SETS = f"{REP}, grams array<long>"
PREFIX = f"{REP}, size int, gram long, i int"
BANDS = f"{REP}, sig long, key long"
#: A batch's side of the index joins is broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table until its input is used up."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_listed(stream: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of a stream whose doc_id is listed."""
    return stream.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def indexed(reps: DataFrame) -> dict[str, DataFrame]:
    """The index rows of representatives: whole gram sets, the grams of their prefixes, SimHash keys.

    Grams are ordered by their hash, an order that no later batch changes.
    """
    sets = D.gram_sets(reps).select("rep", F.array_sort("grams").alias("grams"))
    flat = sets.select("rep", F.size("grams").alias("size"), F.posexplode("grams").alias("i", "gram"))
    prefix = flat.select("rep", "size", "gram", (F.col("i") + 1).alias("i")).where(F.col("i") <= D.prefix_end(F.col("size"), D.SHARE))
    bands = reps.select("rep", simhash("text").alias("sig")).select("rep", "sig", F.explode(D.band_keys(F.col("sig"))).alias("key"))
    return {"sets": sets, "prefix": prefix, "bands": bands}


def known_similar(new: dict[str, DataFrame], old: dict[str, DataFrame]) -> DataFrame:
    """rep of the new representatives that resemble one of the index; old meets new, and never old."""

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    x, y = ([F.col(f"{s}{c}") for c in ("rep", "size", "i")] for s in "xy")
    a = new["prefix"].select("gram", *(F.col(c).alias(f"x{c}") for c in ("rep", "size", "i")))
    b = old["prefix"].select("gram", *(F.col(c).alias(f"y{c}") for c in ("rep", "size", "i")))
    # the smaller set's prefix may be shorter
    end = lambda s, o: s[2] <= F.when(s[1] <= o[1], D.prefix_end(s[1], 2 * D.SHARE / (1 + D.SHARE))).otherwise(s[1])
    fit = D.enough_left(x[1], x[2], y[1], y[2], D.SHARE) & end(x, y) & end(y, x)
    found = b.join(small(a), "gram").where(fit).select(F.col("xrep").alias("doc_a"), F.col("yrep").alias("doc_b")).distinct()
    alike = D.verified(found, new["sets"], old["sets"], D.SHARE).select(F.col("doc_a").alias("rep"))
    s = new["bands"].select("key", F.col("rep").alias("xrep"), F.col("sig").alias("xsig"))
    near = old["bands"].join(small(s), "key").where(hamming(F.col("sig"), F.col("xsig")) <= D.BITS).select(F.col("xrep").alias("rep"))
    return alike.unionByName(near).distinct()


def accept_batch(versions: Versions, batch: DataFrame, number: int, topics: DataFrame | None = None, blocked: DataFrame | None = None, generated: int = 0) -> bool:
    """Accept of a batch (doc_id, text) what resembles nothing accepted before, in order of doc_id, and commit it with its index and the carried state.

    False, and nothing is changed, if the batch was committed already. Rows
    without doc_id are left out.
    """
    if number in versions.committed():
        return False
    docs = batch.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members, reps = D.representatives(docs)
    rows = {name: materialize(df, name) for name, df in indexed(reps).items()}
    before = {name: versions.appended(name, schema, number) for name, schema in (("sets", SETS), ("prefix", PREFIX), ("bands", BANDS))}
    seen = materialize(known_similar(rows, before), "seen")
    fresh = reps.join(seen, "rep", "left_anti")
    rejected, _ = D.greedy_rejected(D.similar_pairs(fresh))
    gone = seen if rejected is None else seen.unionByName(rejected)
    kept = materialize(reps.join(gone, "rep", "left_anti"), "kept")
    own = {name: df.join(kept.select("rep"), "rep", "left_semi") for name, df in rows.items()}
    own["prefix"] = own["prefix"].repartitionByRange("gram").sortWithinPartitions("gram")
    own["bands"] = own["bands"].repartitionByRange("key").sortWithinPartitions("key")
    spark = versions.spark
    topics = spark.createDataFrame([], "topic string, signature string, place long") if topics is None else topics
    blocked = spark.createDataFrame([], "term string") if blocked is None else blocked
    tables, values = carried(versions, number, topics, blocked, generated)
    return versions.commit(number, {"accepted": kept.select("rep.doc_id", "text"), **own, **tables}, values)


def accepted_documents(versions: Versions) -> DataFrame:
    """doc_id, text of all that was accepted."""
    return versions.appended("accepted", ACCEPTED)


def dedup_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Accept (doc_id, text) that resemble nothing accepted before, in batches, and in order of doc_id within one; doc_ids are to grow over batches.

    Only a batch's own rows are indexed and compared: with one another, and with
    the index that earlier batches have committed below path.
    """

    def step(batch: DataFrame, number: int) -> None:
        accept_batch(Versions(batch.sparkSession, path), batch, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def generation_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take up a generation log (doc_id, text, topic, signature, blocked, status) in batches, with the generator's memory.

    Records of status ok are deduplicated; the topics of those and the blocked
    terms of all records are carried on, and the counter counts every record.
    """

    def step(batch: DataFrame, number: int) -> None:
        versions = Versions(batch.sparkSession, path)
        if number in versions.committed():
            return
        rows = materialize(batch, "log")
        ok = rows.where("status = 'ok'")
        topics = ok.where("topic IS NOT NULL").select("topic", "signature", F.col("doc_id").alias("place"))
        blocked = rows.select(F.explode("blocked").alias("term"))
        accept_batch(versions, ok, number, topics, blocked, rows.count())

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail_state(history: DataFrame, new: DataFrame, order: str, keep: int = 400) -> DataFrame:
    """The last ``keep`` rows of both by order: the memory of topics that is carried on."""
    return history.unionByName(new).orderBy(F.desc(order)).limit(keep)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per type and window, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
