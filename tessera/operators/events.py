"""Event mentions: sentence offsets, conflicts, clusters, pair statistics, packed predictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessera.scratch import materialize, ship

ship(__name__)


@F.pandas_udf(ArrayType(IntegerType()))
def _offsets(documents: pd.Series, sentences: pd.Series) -> pd.Series:
    def one(document: str | None, own: list | None) -> list[int] | None:
        if own is None:
            return None
        out, at = [], 0
        for s in own:
            found = document.find(s, at) if document is not None and s is not None and at >= 0 else -1
            at = found + len(s) if found >= 0 else -1
            out.append(found)
        return out

    return pd.Series([one(*x) for x in zip(documents, sentences, strict=True)])


def sentence_offsets(document: Column, sentences: Column) -> Column:
    """The start of each sentence, searched for after the one before; -1 from the first that isn't found (or is null). Time and space follow the document's length."""
    return _offsets(document, sentences)


def conflicts(events: DataFrame) -> DataFrame:
    """Neighbours in order of start that are the SAME (start and trigger equal) or OVERLAP: doc_id, event_id, next_id, kind."""
    w = Window.partitionBy("doc_id").orderBy("start", "event_id")
    nxt = F.lead(F.struct("event_id", "start", "trigger")).over(w)
    kind = F.when((F.col("start") == F.col("n.start")) & (F.col("trigger") == F.col("n.trigger")), "SAME").when(
        F.col("start") + F.length("trigger") > F.col("n.start"), "OVERLAP"
    )
    return events.withColumn("n", nxt).where("n IS NOT NULL").select("doc_id", "event_id", F.col("n.event_id").alias("next_id"), kind.alias("kind")).where("kind IS NOT NULL")


def _free(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that begin where the last kept one of their document has ended; they come in order."""
    now, end = None, -1
    for part in parts:
        keep = []
        for k, (doc, start, length) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "start", "length")), strict=True)):
            if doc != now:
                now, end = doc, -1
            if start is not None and start >= end:
                keep.append(k)
                end = start + length
        yield part.take(pa.array(keep, pa.int32())).select(["doc_id", "event_id"])


def drop_conflicts(events: DataFrame) -> DataFrame:
    """Events without SAME or OVERLAP: in order of (start, event_id) each is kept that begins where the last kept one has ended.

    One scan of each document in order, which holds its last end alone. Events
    without a start are dropped, a trigger that is null has no length.
    """
    doc = events.select("doc_id").schema.fields
    rows = events.select("doc_id", F.col("start").cast("long").alias("start"), F.col("event_id").cast("string").alias("event_id"), F.coalesce(F.length("trigger"), F.lit(0)).alias("length"))
    order = ["doc_id", "start", "event_id"]
    return rows.repartition("doc_id").sortWithinPartitions(*order).mapInArrow(_free, StructType([*doc, StructField("event_id", StringType())]))


def membership(events: DataFrame, members: DataFrame) -> DataFrame:
    """Per event its cluster; events in none become clusters of their own, named after them. status: ok, singleton or multiple. events, members: doc_id, event_id (, cluster)."""
    n = members.groupBy("doc_id", "event_id").agg(F.count("*").alias("n"), F.min("cluster").alias("cluster"))
    return events.join(n, ["doc_id", "event_id"], "left").select(
        "doc_id",
        "event_id",
        F.coalesce(F.col("cluster").cast("string"), F.concat(F.lit("singleton_"), F.col("event_id"))).alias("cluster"),
        F.when(F.col("n").isNull(), "singleton").when(F.col("n") > 1, "multiple").otherwise("ok").alias("status"),
    )


def pair_stats(events: DataFrame, by: list[str]) -> DataFrame:
    """Per split: docs, events, clusters, pairs, positive and negative pairs. events: doc_id, cluster and by."""
    choose = lambda n: n * (n - 1) / 2
    cluster = events.groupBy(*by, "doc_id", "cluster").agg(F.count("*").alias("c"))
    doc = cluster.groupBy(*by, "doc_id").agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(choose(F.col("c"))).alias("pos"))
    return doc.groupBy(*by).agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n_events"), F.sum("k").alias("n_clusters"), F.sum(choose(F.col("n"))).cast("long").alias("n_pairs"), F.sum("pos").cast("long").alias("n_positive")
    ).withColumn("n_negative", F.col("n_pairs") - F.col("n_positive"))


def prediction_offsets(counts: DataFrame, by: list[str], ranges: int = 256) -> DataFrame:
    """Where each document's n(n-1)/2 predictions begin in its group's flat vector, in doc_id order. counts: by, doc_id, n.

    doc_ids are dealt to ranges; a document's place is the sum of its group's
    earlier ranges and of the earlier documents in its own, so no task holds a group.
    """
    size = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    dealt = materialize(counts.withColumn("size", size).repartitionByRange(ranges, "doc_id").withColumn("_part", F.spark_partition_id()), "sizes")
    sums = dealt.groupBy(*by, "_part").agg(F.sum("size").alias("_size"))
    # a row for each group and range
    base = sums.select(*by, "_part", F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.sum("size").over(Window.partitionBy(*by, "_part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("offset", F.coalesce(inside, F.lit(0))).join(base, [*by, "_part"]).withColumn("offset", F.col("offset") + F.col("_base")).drop("_part", "_base")


def pack_predictions(scores: DataFrame) -> DataFrame:
    """doc_id, pred_label, pred_prob: upper triangles flattened in (i, j) order. scores: doc_id, i, j, p."""
    rows = F.array_sort(F.collect_list(F.struct("i", "j", "p")))
    return scores.groupBy("doc_id").agg(rows.alias("r")).select(
        "doc_id", F.transform("r", lambda x: (x["p"] >= 0.5).cast("int")).alias("pred_label"), F.transform("r", lambda x: x["p"]).alias("pred_prob")
    )


@F.pandas_udf(ArrayType(IntegerType()))
def event_clusters(n: pd.Series, labels: pd.Series) -> pd.Series:
    """Per document of n events the cluster of each, named by its first event: pairs labelled 1 are joined. labels: as pack_predictions() packs them.

    For documents whose packed triangle fits a row; greedy_clusters() takes a row
    per pair. Null labels count as none.
    """

    def one(size: int, packed: list[int] | None) -> list[int]:
        packed = np.asarray([] if packed is None else packed, dtype="int64")
        if len(packed) != size * (size - 1) // 2:
            raise ValueError(f"{len(packed)} labels for {size} events")
        hits = np.flatnonzero(packed == 1)
        # the row of the triangle that a place falls into
        begins = np.arange(size) * (2 * size - np.arange(size) - 1) // 2
        first = np.searchsorted(begins, hits, "right") - 1
        root = list(range(size))
        for a, b in zip(first.tolist(), (hits - begins[first] + first + 1).tolist(), strict=True):
            a, b = _root(root, a), _root(root, b)
            root[max(a, b)] = min(a, b)
        return [_root(root, x) for x in range(size)]

    return pd.Series([one(*x) for x in zip(n, labels, strict=True)])


def _root(of, x):
    while of[x] != x:
        of[x] = of[of[x]]
        x = of[x]
    return x


def _agglomerate(threshold: float, apart: float):
    """doc_id, event_id, cluster of the events that a link joins; pairs come document by document, those that stand apart first, then by falling p."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, root, against = None, {}, {}

        def told(doc) -> pa.RecordBatch:
            events = sorted(root)
            return pa.RecordBatch.from_arrays([pa.array([doc] * len(events), kind), pa.array(events, pa.string()), pa.array([_root(root, e) for e in events], pa.string())], names=["doc_id", "event_id", "cluster"])

        for part in parts:
            kind = part.column("doc_id").type
            out = []
            for doc, a, b, p in zip(*(part.column(c).to_pylist() for c in ("doc_id", "a", "b", "p")), strict=True):
                if doc != now:
                    if root:
                        out.append(told(now))
                    now, root, against = doc, {}, {}
                if p < apart:
                    against.setdefault(a, set()).add(b)
                    against.setdefault(b, set()).add(a)
                elif p >= threshold:
                    x, y = (_root(root, e) if e in root else root.setdefault(e, e) for e in (a, b))
                    if x != y and y not in against.get(x, ()):
                        x, y = min(x, y), max(x, y)
                        root[y] = x
                        # what stands against either cluster stands against both; names of clusters that were joined are replaced
                        for z in against.pop(y, ()):
                            against[z].discard(y)
                            against[z].add(x)
                            against.setdefault(x, set()).add(z)
            yield from out
        if root:
            yield told(now)

    return run


def greedy_clusters(pairs: DataFrame, threshold: float = 0.5, apart: float = 0.0) -> DataFrame:
    """doc_id, event_id, cluster (the least event_id) of events that stand in a pair at the threshold. pairs: doc_id, a, b, p.

    Pairs at the threshold or above are joined in order of falling p (equals by a,
    then b), unless a pair below ``apart`` stands between the two clusters. Where
    nothing stands apart these are the connected components. A document is one
    scan of its pairs in order; what it holds are its events and pairs apart.
    Pairs with a null are left out.
    """
    doc = pairs.select("doc_id").schema.fields
    used = pairs.select("doc_id", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("p").cast("double").alias("p")).where(
        (F.col("p") >= threshold) | (F.col("p") < apart)
    ).where("a IS NOT NULL AND b IS NOT NULL AND NOT isnan(p)")
    rank = F.when(F.col("p") < apart, 0).otherwise(1)
    dealt = used.repartition("doc_id").sortWithinPartitions("doc_id", rank, F.desc("p"), "a", "b")
    return dealt.mapInArrow(_agglomerate(threshold, apart), StructType([*doc, StructField("event_id", StringType()), StructField("cluster", StringType())]))


def filter_summary(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Per split: raw and filtered events, removed, conflicts left."""
    left = conflicts(after).groupBy("doc_id").agg(F.count("*").alias("c"))
    a = before.groupBy(*by).agg(F.count("*").alias("raw_events"))
    b = after.join(left, "doc_id", "left").groupBy(*by).agg(F.count("*").alias("filtered_events"))
    c = after.select("doc_id", *by).distinct().join(left, "doc_id").groupBy(*by).agg(F.sum("c").alias("remaining_conflicts"))
    zero = F.lit(0).cast("long")
    return a.join(b, by, "left").join(c, by, "left").select(
        *by, "raw_events", F.coalesce("filtered_events", zero).alias("filtered_events"),
        (F.col("raw_events") - F.coalesce("filtered_events", zero)).alias("removed"), F.coalesce("remaining_conflicts", zero).alias("remaining_conflicts"),
    )
