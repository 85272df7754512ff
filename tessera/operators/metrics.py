"""Metrics of pairs, zeros and clusters, as counts by key and arithmetic on them."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import distance_bucket
from tessera.operators.components import components
from tessera.scratch import materialize, ship

ship(__name__)

SPAN = ["doc_id", "sentence_id", "token_id"]


def ratio(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column | str, r: Column | str) -> Column:
    p, r = (F.col(x) if isinstance(x, str) else x for x in (p, r))
    return ratio(2 * p * r, p + r)


def confusion(df: DataFrame, gold: Column, pred: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """tp, fp, fn, tn, precision, recall, f1, accuracy; empty denominators give 0."""
    counts = df.groupBy(*by).agg(
        F.count_if(gold & pred).alias("tp"), F.count_if(~gold & pred).alias("fp"), F.count_if(gold & ~pred).alias("fn"), F.count_if(~gold & ~pred).alias("tn")
    )
    return with_prf(counts)


def with_prf(counts: DataFrame) -> DataFrame:
    return (
        counts.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio("tp", F.col("tp") + F.col("fn")))
        .withColumn("f1", f1("precision", "recall"))
        .withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
    )


def type_diagnostics(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per mention type: gold mentions, those seen in pairs, coverage, pairs, counts and P/R/F1. A pair counts once for each distinct type it involves."""
    types = ["mention_type1", "mention_type2"]
    cells = pairs.groupBy(*types, "label", "pred").agg(F.count("*").alias("n"))
    each = cells.withColumn("type", F.explode(F.array_distinct(F.array(*types))))
    of = lambda label, pred: F.coalesce(F.sum(F.when((F.col("label") == label) & (F.col("pred") == pred), F.col("n"))), F.lit(0))
    counts = each.groupBy("type").agg(F.sum("n").alias("pairs"), of(True, True).alias("tp"), of(False, True).alias("fp"), of(True, False).alias("fn"), of(False, False).alias("tn"))
    ends = [pairs.select("doc_id", F.col(f"s{i}").alias("s"), F.col(f"t{i}").alias("t"), F.col(f"mention_type{i}").alias("type")).distinct() for i in (1, 2)]
    seen = ends[0].unionByName(ends[1]).distinct().groupBy("type").agg(F.count("*").alias("seen"))
    gold = mentions.groupBy(F.col("mention_type").alias("type")).agg(F.count("*").alias("gold_mentions"))
    zero = F.lit(0).cast("long")
    joined = gold.join(seen, "type", "left").join(counts, "type", "left")
    filled = joined.select("type", "gold_mentions", *(F.coalesce(c, zero).alias(c) for c in ("seen", "pairs", "tp", "fp", "fn", "tn")))
    return with_prf(filled.withColumn("coverage", ratio("seen", "gold_mentions"))).drop("accuracy")


def _involved(targets: dict[str, str]) -> Column:
    """A struct (target, endpoint, partner_type) for each target type that a pair's mentions have: endpoint is both, span1 or span2."""
    rows = F.array(
        *(
            F.struct(
                F.lit(name).alias("target"),
                F.when((F.col("mention_type1") == t) & (F.col("mention_type2") == t), "both")
                .when(F.col("mention_type1") == t, "span1")
                .when(F.col("mention_type2") == t, "span2")
                .alias("endpoint"),
                F.when(F.col("mention_type1") == t, F.col("mention_type2")).otherwise(F.col("mention_type1")).alias("partner_type"),
            )
            for name, t in targets.items()
        )
    )
    return F.explode(F.filter(rows, lambda r: r["endpoint"].isNotNull()))


def error_rows(pairs: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Wrong pairs that involve a target type, a row per target: target, error (FP, FN), endpoint (both, span1, span2), partner_type, bucket, margin."""
    return (
        pairs.where(F.col("label") != F.col("pred"))
        .withColumn("x", _involved(targets))
        .select(
            "doc_id", "s1", "t1", "s2", "t2", "p",
            F.col("x.target").alias("target"),
            F.when(F.col("pred"), "FP").otherwise("FN").alias("error"),
            F.col("x.endpoint").alias("endpoint"),
            F.col("x.partner_type").alias("partner_type"),
            distance_bucket(F.abs(F.col("s2") - F.col("s1"))).alias("bucket"),
            F.abs(F.col("p") - 0.5).alias("margin"),
        )
    )


def error_counts(pairs: DataFrame, targets: dict[str, str], *by: str) -> DataFrame:
    """error_rows() counted: by, target, error, partner_type, bucket, n. Pairs are counted by their types and distance first, so no row is made of a pair."""
    types = ["mention_type1", "mention_type2"]
    wide = F.least(F.abs(F.col("s2") - F.col("s1")), F.lit(4)).alias("gap")
    cells = pairs.where(F.col("label") != F.col("pred")).groupBy(*by, *types, "pred", wide).agg(F.count("*").alias("n"))
    told = cells.withColumn("x", _involved(targets)).withColumn("bucket", distance_bucket(F.col("gap"))).withColumn("error", F.when(F.col("pred"), "FP").otherwise("FN"))
    return told.groupBy(*by, "x.target", "error", "x.partner_type", "bucket").agg(F.sum("n").alias("n"))


def top_errors(errors: DataFrame, error: str, n: int = 30) -> DataFrame:
    """False positives by falling, false negatives by rising score (8 decimals); ties in pair order."""
    p = F.round("p", 8)
    order = [p.desc() if error == "FP" else p.asc(), *(F.col(c) for c in ("doc_id", "s1", "t1", "s2", "t2", "target"))]
    return errors.where(F.col("error") == error).orderBy(*order).limit(n)


def error_summary(errors: DataFrame, dimensions: list[str], n: str | None = None) -> DataFrame:
    """Counts by each dimension on its own: target, error, dimension, value, n. Rows count once, or as often as their column n says.

    All dimensions are counted together first, so what is stacked are counts.
    """
    counts = errors.groupBy("target", "error", *dimensions).agg((F.sum(n) if n else F.count("*")).alias("n"))
    stacked = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions)))
    return counts.select("target", "error", "n", stacked.alias("x")).groupBy("target", "error", "x.dimension", "x.value").agg(F.sum("n").alias("n"))


def most_common(df: DataFrame, by: list[str], value: str, position: Column) -> DataFrame:
    """The most frequent value of each group; of equals the one seen first by position; NA for groups whose values are all null."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).isNull(), F.desc("n"), "first")))
    return best.where("k = 1").select(*by, F.coalesce(F.col(value), F.lit("NA")).alias("value"), "n")


# Zero pronouns --------------------------------------------------------------------------------------------------------


def _partners(zeros: DataFrame, others: DataFrame, by: list[str], name: str) -> DataFrame:
    """Per zero how many of the others share its clusters ``by``: counted by cluster, not paired."""
    sizes = others.groupBy("doc_id", *by).agg(F.count("*").alias("n"))
    return zeros.join(sizes, ["doc_id", *by]).groupBy(*SPAN).agg(F.sum("n").alias(name))


def zero_detail(gold: DataFrame, pred: DataFrame, zeros: DataFrame) -> DataFrame:
    """Per zero: covered, resolvable, pred_resolved, correct, gold_pairs, pred_pairs, correct_pairs.

    gold: SPAN, chain_id; pred: SPAN, pred_id; zeros: SPAN. Partners exclude every zero.
    """
    g, p = gold.select(*SPAN, F.col("chain_id").alias("g")), pred.select(*SPAN, F.col("pred_id").alias("p"))
    both = g.join(p, SPAN)
    counts = zeros.select(SPAN).distinct()
    for side, by, name in ((g, ["g"], "gold_pairs"), (p, ["p"], "pred_pairs"), (both, ["g", "p"], "correct_pairs")):
        counts = counts.join(_partners(side.join(zeros.select(SPAN), SPAN, "left_semi"), side.join(zeros, SPAN, "left_anti"), by, name), SPAN, "left")
    covered = zeros.join(pred.select(*SPAN, F.lit(True).alias("covered")).distinct(), SPAN, "left")
    zero = F.lit(0).cast("long")
    return covered.join(counts, SPAN, "left").select(
        *SPAN,
        F.coalesce("covered", F.lit(False)).alias("covered"),
        (F.coalesce("gold_pairs", zero) > 0).alias("resolvable"),
        (F.coalesce("pred_pairs", zero) > 0).alias("pred_resolved"),
        (F.coalesce("correct_pairs", zero) > 0).alias("correct"),
        *(F.coalesce(c, zero).alias(c) for c in ("gold_pairs", "pred_pairs", "correct_pairs")),
    )


def zero_resolution(detail: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    counts = detail.groupBy(*by).agg(
        F.count("*").alias("gold_zero"),
        F.count_if("resolvable").alias("resolvable"),
        F.count_if("covered").alias("covered"),
        F.count_if("pred_resolved").alias("pred_resolved"),
        F.count_if("correct").alias("correct_resolved"),
    )
    return (
        counts.withColumn("coverage", ratio("covered", "gold_zero"))
        .withColumn("precision", ratio("correct_resolved", "pred_resolved"))
        .withColumn("recall", ratio("correct_resolved", "resolvable"))
        .withColumn("f1", f1("precision", "recall"))
    )


def zero_pairs(detail: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    counts = detail.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("gold_pairs", "pred_pairs", "correct_pairs")))
    return (
        counts.withColumn("precision", ratio("correct_pairs", "pred_pairs"))
        .withColumn("recall", ratio("correct_pairs", "gold_pairs"))
        .withColumn("f1", f1("precision", "recall"))
    )


def normalize_zero_spans(pred: DataFrame, zero_tokens: DataFrame, anchors: DataFrame) -> DataFrame:
    """Predicted spans [t, t+1] become [t, t] where both tokens are the zero sign and t is a structural anchor.

    pred: doc_id, sentence_id, start, end, pred_id; zero_tokens and anchors: SPAN.
    """
    z = zero_tokens.select("doc_id", "sentence_id", F.col("token_id").alias("start")).distinct()
    second = z.withColumnRenamed("start", "end")
    a = anchors.select("doc_id", "sentence_id", F.col("token_id").alias("start")).distinct()
    wide = pred.where("end = start + 1").join(z, ["doc_id", "sentence_id", "start"], "left_semi").join(
        second, ["doc_id", "sentence_id", "end"], "left_semi"
    ).join(a, ["doc_id", "sentence_id", "start"], "left_semi")
    keys = ["doc_id", "sentence_id", "start", "end", "pred_id"]
    marked = pred.join(wide.select(*keys, F.lit(True).alias("_w")).distinct(), keys, "left")
    return marked.withColumn("end", F.when(F.col("_w"), F.col("start")).otherwise(F.col("end"))).drop("_w").select(pred.columns)


def span_collisions(pred: DataFrame) -> DataFrame:
    """Spans that stand in two clusters, as after a normalisation."""
    return pred.groupBy("doc_id", "sentence_id", "start", "end").agg(F.count_distinct("pred_id").alias("n")).where("n > 1")


def anchor_diagnostic(anchors: DataFrame, pred: DataFrame) -> DataFrame:
    """Per zero anchor the predicted mentions of its sentence that contain it: exact, starts, ends, contains, in_multi (a cluster of two or more), ambiguous."""
    size = pred.groupBy("doc_id", "pred_id").agg(F.count("*").alias("size"))
    inside = anchors.join(pred.join(size, ["doc_id", "pred_id"]), ["doc_id", "sentence_id"], "left").withColumn(
        "hit", (F.col("start") <= F.col("token_id")) & (F.col("end") >= F.col("token_id"))
    )
    hit = F.coalesce("hit", F.lit(False))
    return inside.groupBy(*SPAN).agg(
        F.coalesce(F.bool_or(hit & (F.col("start") == F.col("token_id")) & (F.col("end") == F.col("token_id"))), F.lit(False)).alias("exact"),
        F.coalesce(F.bool_or(hit & (F.col("start") == F.col("token_id"))), F.lit(False)).alias("starts"),
        F.coalesce(F.bool_or(hit & (F.col("end") == F.col("token_id"))), F.lit(False)).alias("ends"),
        F.bool_or(hit).alias("contained"),
        F.coalesce(F.bool_or(hit & (F.col("size") > 1)), F.lit(False)).alias("in_multi"),
        (F.count_distinct(F.when(hit, F.col("pred_id"))) > 1).alias("ambiguous"),
    )


def containing_lengths(anchors: DataFrame, pred: DataFrame) -> DataFrame:
    """How long the predicted mentions are that contain an anchor: length, n."""
    inside = anchors.join(pred, ["doc_id", "sentence_id"]).where("start <= token_id AND end >= token_id")
    return inside.groupBy((F.col("end") - F.col("start") + 1).alias("length")).agg(F.count("*").alias("n"))


def literal_audit(gold: DataFrame, pred: DataFrame, zeros: DataFrame) -> DataFrame:
    """Per zero: n_prior (earlier members of its gold chain), antecedent_hit, co_cluster_hit, pred_size, singleton, cross_chain.

    A zero that isn't predicted has pred_size 0.
    """
    z = zeros.join(gold.select(*SPAN, "chain_id"), SPAN).join(pred.select(*SPAN, "pred_id"), SPAN, "left")
    # counts over each chain in order, and over its members in one predicted cluster: members before, and all but the zero
    at = F.struct("sentence_id", "token_id")
    chain = Window.partitionBy("doc_id", "chain_id")
    both = Window.partitionBy("doc_id", "chain_id", "pred_id")
    before = lambda w: F.rank().over(w.orderBy(at)) - 1
    other = F.count("*").over(both) - F.count("*").over(Window.partitionBy("doc_id", "chain_id", "pred_id", "sentence_id", "token_id"))
    told = F.col("pred_id").isNotNull()
    members = gold.select(*SPAN, "chain_id").join(pred.select(*SPAN, "pred_id"), SPAN, "left")
    own = (
        members.withColumn("prior", before(chain))
        .withColumn("hit", told & (before(both) > 0))
        .withColumn("any", told & (other > 0))
        .groupBy(*SPAN)
        .agg(F.max("prior").alias("n_prior"), F.bool_or("hit").alias("antecedent_hit"), F.bool_or("any").alias("co_cluster_hit"))
    )
    label = pred.join(gold.select(*SPAN, "chain_id"), SPAN, "left").groupBy("doc_id", "pred_id").agg(
        F.count("*").alias("pred_size"), F.count_distinct("chain_id").alias("n_chains")
    )
    return z.join(own, SPAN, "left").join(label, ["doc_id", "pred_id"], "left").select(
        *SPAN,
        F.coalesce("n_prior", F.lit(0)).cast("long").alias("n_prior"),
        F.coalesce("antecedent_hit", F.lit(False)).alias("antecedent_hit"),
        F.coalesce("co_cluster_hit", F.lit(False)).alias("co_cluster_hit"),
        F.coalesce("pred_size", F.lit(0)).cast("long").alias("pred_size"),
        F.coalesce(F.col("pred_size") == 1, F.lit(False)).alias("singleton"),
        F.coalesce(F.col("n_chains") > 1, F.lit(False)).alias("cross_chain"),
    )


def literal_summary(audit: DataFrame) -> DataFrame:
    """Counts and rates; the antecedent rate is over zeros with an earlier member, the others over all."""
    return audit.agg(
        F.count("*").alias("zeros"),
        F.count_if(F.col("n_prior") > 0).alias("with_prior"),
        F.count_if("antecedent_hit").alias("antecedent_hits"),
        F.count_if("co_cluster_hit").alias("co_cluster_hits"),
        F.count_if("singleton").alias("singletons"),
        F.count_if("cross_chain").alias("cross_chain"),
        F.avg(F.col("pred_size").cast("double")).alias("mean_pred_size"),
    ).select("*", ratio("antecedent_hits", "with_prior").alias("antecedent_rate"), ratio("co_cluster_hits", "zeros").alias("co_cluster_rate"), ratio("singletons", "zeros").alias("singleton_rate"), ratio("cross_chain", "zeros").alias("cross_chain_rate"))


def wrong_cluster(gold: DataFrame, zeros: DataFrame) -> DataFrame:
    """Each zero moved to the other cluster of its document, with a member that's no zero, whose id comes first as text; without one it stays. Adds changed."""
    ids = gold.join(zeros, SPAN, "left_anti").select("doc_id", F.col("chain_id").alias("other")).distinct()
    # the two first ids are enough: the zero's own may be one of them
    two = ids.groupBy("doc_id").agg(F.min_by("other", F.col("other").cast("string")).alias("o1")).join(ids, "doc_id").groupBy("doc_id", "o1").agg(
        F.min_by("other", F.when(F.col("other") != F.col("o1"), F.col("other").cast("string"))).alias("o2x"),
        F.min(F.when(F.col("other") != F.col("o1"), F.col("other").cast("string"))).alias("has"),
    ).withColumn("o2", F.when(F.col("has").isNotNull(), F.col("o2x")))
    marked = gold.join(zeros.select(*SPAN, F.lit(True).alias("_z")).distinct(), SPAN, "left").join(two.select("doc_id", "o1", "o2"), "doc_id", "left")
    new = F.when(F.col("_z"), F.coalesce(F.when(F.col("o1") != F.col("chain_id"), F.col("o1")), F.col("o2"), F.col("chain_id"))).otherwise(F.col("chain_id"))
    return marked.withColumn("pred_id", new).withColumn("changed", F.col("pred_id") != F.col("chain_id")).select(*SPAN, "pred_id", "changed")


# Coreference metrics --------------------------------------------------------------------------------------------------


def overlaps(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id, g, p, n: shared mentions of gold cluster g and predicted cluster p."""
    return gold.select(*SPAN, F.col("chain_id").alias("g")).join(pred.select(*SPAN, F.col("pred_id").alias("p")), SPAN).groupBy("doc_id", "g", "p").agg(F.count("*").alias("n"))


def _sizes(df: DataFrame, cluster: str, name: str) -> DataFrame:
    return df.groupBy("doc_id", F.col(cluster).alias(name)).agg(F.count("*").alias("size"))


def muc_parts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per document: muc_rn, muc_rd, muc_pn, muc_pd (numerators and denominators of recall and precision)."""
    shared = overlaps(gold, pred)

    def side(df: DataFrame, cluster: str, name: str, tag: str) -> DataFrame:
        parts = shared.groupBy("doc_id", name).agg(F.count("*").alias("k"), F.sum("n").alias("m"))
        # mentions that the other side lacks are partitions of their own
        return _sizes(df, cluster, name).join(parts, ["doc_id", name], "left").groupBy("doc_id").agg(
            F.sum(F.col("size") - (F.coalesce("k", F.lit(0)) + F.col("size") - F.coalesce("m", F.lit(0)))).alias(f"muc_{tag}n"),
            F.sum(F.col("size") - 1).alias(f"muc_{tag}d"),
        )

    return side(gold, "chain_id", "g", "r").join(side(pred, "pred_id", "p", "p"), "doc_id", "full_outer").na.fill(0)


def b3_parts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per document: b3_rn, b3_rd, b3_pn, b3_pd."""
    shared = overlaps(gold, pred)

    def side(df: DataFrame, cluster: str, name: str, tag: str) -> DataFrame:
        sizes = _sizes(df, cluster, name)
        total = sizes.groupBy("doc_id").agg(F.sum("size").alias(f"b3_{tag}d"))
        part = shared.join(sizes, ["doc_id", name]).groupBy("doc_id").agg(F.sum(F.col("n").cast("double") * F.col("n") / F.col("size")).alias(f"b3_{tag}n"))
        return total.join(part, "doc_id", "left")

    return side(gold, "chain_id", "g", "r").join(side(pred, "pred_id", "p", "p"), "doc_id", "full_outer").na.fill(0)


def blanc_parts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per document: link counts of both kinds in gold (cg, ng), prediction (cp, np) and both (cb, nb)."""
    choose = lambda n: (n * (n - 1) / 2).cast("long")
    shared = overlaps(gold, pred)

    def side(df: DataFrame, cluster: str, name: str, tag: str) -> DataFrame:
        return _sizes(df, cluster, name).groupBy("doc_id").agg(F.sum(choose(F.col("size"))).alias(f"c{tag}"), F.sum("size").alias(f"m{tag}")).select(
            "doc_id", f"c{tag}", (choose(F.col(f"m{tag}")) - F.col(f"c{tag}")).alias(f"n{tag}")
        )

    # links among shared mentions: in both clusterings together, or apart in both
    g = shared.groupBy("doc_id", "g").agg(F.sum("n").alias("n")).groupBy("doc_id").agg(F.sum(choose(F.col("n"))).alias("sg"), F.sum("n").alias("m"))
    p = shared.groupBy("doc_id", "p").agg(F.sum("n").alias("n")).groupBy("doc_id").agg(F.sum(choose(F.col("n"))).alias("sp"))
    b = shared.groupBy("doc_id").agg(F.sum(choose(F.col("n"))).alias("cb"))
    both = g.join(p, "doc_id").join(b, "doc_id").select("doc_id", "cb", (choose(F.col("m")) - F.col("sg") - F.col("sp") + F.col("cb")).alias("nb"))
    return side(gold, "chain_id", "g", "g").join(side(pred, "pred_id", "p", "p"), "doc_id", "full_outer").join(both, "doc_id", "left").na.fill(0)


def assign(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> float:
    """The best total weight of a one-to-one assignment over these edges; nodes may stay alone.

    Shortest augmenting paths with potentials over the edges alone, so the work
    follows the edges that a path meets, not the product of the sides.
    """
    edges: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in zip(left.tolist(), right.tolist(), weight.tolist(), strict=True):
        edges.setdefault(a, []).append((b, -w))
    price: dict = {}  # of each right node, and of the place (None, a) that leaves a alone at no cost
    own, mate = {}, {}
    for start in edges:
        heap, came, dist, done = [], {}, {}, set()

        def reach(a: int, base: float, heap=heap, came=came, dist=dist, done=done) -> None:
            for b, cost in (*edges[a], ((None, a), 0.0)):
                if b not in done:
                    d = base + cost - price.get(b, 0.0)
                    if d < dist.get(b, math.inf):
                        dist[b], came[b] = d, a
                        heapq.heappush(heap, (d, isinstance(b, tuple), str(b), b))

        reach(start, 0.0)
        while True:
            d, _, _, b = heapq.heappop(heap)
            if b in done or d > dist[b]:
                continue
            done.add(b)
            if b not in mate:
                break
            a = mate[b]
            # the matched edge has reduced cost zero: its cost less the price is a's own value
            reach(a, d - (own[a][1] - price.get(b, 0.0)))
        end = dist[b]
        for x in done:
            price[x] = price.get(x, 0.0) + dist[x] - end
        while True:
            a = came[b]
            before = own.get(a)
            own[a] = (b, next((c for x, c in edges[a] if x == b), 0.0))
            mate[b] = a
            if a == start:
                break
            b = before[0]
    return float(-sum(c for _, c in own.values()))


def _best(group: pa.Table) -> pa.Table:
    total = assign(*(group.column(c).to_numpy() for c in ("g", "p", "phi")))
    return pa.table({"doc_id": group.column("doc_id").slice(0, 1), "n": pa.array([total])})


#: Documents with more overlapping cluster pairs than this are cut into components, which are spread over tasks.
EDGES = 20_000


def assignments(phi: DataFrame, most: int = EDGES) -> DataFrame:
    """doc_id, n: shares of the best assignment's total, to be summed. phi: doc_id, g, p, phi.

    Edges that stand alone need no search, nor do stars, of which the best edge
    counts. What is left of a document goes to one task, of a large document each
    component to one.
    """
    by_g, by_p = Window.partitionBy("doc_id", "g"), Window.partitionBy("doc_id", "p")
    degrees = phi.withColumn("dg", F.count("*").over(by_g)).withColumn("dp", F.count("*").over(by_p))
    # an edge is of a star if one of its ends is the middle of edges whose other ends have no other edge
    starred = degrees.withColumn("g_star", F.max("dp").over(by_g) == 1).withColumn("p_star", F.max("dg").over(by_p) == 1)
    kept = materialize(starred.withColumn("rest", F.count_if(~F.col("g_star") & ~F.col("p_star")).over(Window.partitionBy("doc_id"))), "phi")
    stars = kept.where("g_star").groupBy("doc_id", "g").agg(F.max("phi").alias("n")).select("doc_id", "n")
    stars = stars.unionByName(kept.where("p_star AND NOT g_star").groupBy("doc_id", "p").agg(F.max("phi").alias("n")).select("doc_id", "n"))
    rest = kept.where("NOT g_star AND NOT p_star").select("doc_id", F.col("g").cast("long").alias("g"), F.col("p").cast("long").alias("p"), "phi", "rest")
    kind = phi.schema["doc_id"].dataType.simpleString()
    small = rest.where(F.col("rest") <= most).groupBy("doc_id").applyInArrow(_best, f"doc_id {kind}, n double")
    large = rest.where(F.col("rest") > most)
    if large.isEmpty():
        return stars.unionByName(small)
    node = lambda side, c: F.struct("doc_id", F.lit(side).alias("side"), F.col(c).alias("id"))
    roots = components(large.select(node(0, "g").alias("a"), node(1, "p").alias("b"))).where("node.side = 0")
    parts = large.join(roots.select("node.doc_id", F.col("node.id").alias("g"), "root"), ["doc_id", "g"]).drop("rest")
    return stars.unionByName(small).unionByName(parts.groupBy("doc_id", "root").applyInArrow(_best, f"doc_id {kind}, n double"))


def ceafe_parts(gold: DataFrame, pred: DataFrame, most: int = EDGES) -> DataFrame:
    """Per document: ceafe_n (similarity of the best assignment), ceafe_rd, ceafe_pd. Cluster ids are whole numbers."""
    gs, ps = _sizes(gold, "chain_id", "g"), _sizes(pred, "pred_id", "p")
    phi = (
        overlaps(gold, pred)
        .join(gs.withColumnRenamed("size", "gs"), ["doc_id", "g"])
        .join(ps.withColumnRenamed("size", "ps"), ["doc_id", "p"])
        .select("doc_id", "g", "p", (2.0 * F.col("n") / (F.col("gs") + F.col("ps"))).alias("phi"))
    )
    best = assignments(phi, most).groupBy("doc_id").agg(F.sum("n").alias("ceafe_n"))
    return (
        gs.groupBy("doc_id").agg(F.count("*").alias("ceafe_rd"))
        .join(ps.groupBy("doc_id").agg(F.count("*").alias("ceafe_pd")), "doc_id", "full_outer")
        .join(best, "doc_id", "left")
        .na.fill(0)
    )


def document_parts(gold: DataFrame, pred: DataFrame, assigned: bool = True) -> DataFrame:
    """The parts of MUC, B3, BLANC and, if assigned, CEAFe of each document in one row."""
    kinds = [muc_parts, b3_parts, blanc_parts, *([ceafe_parts] if assigned else [])]
    return reduce(lambda a, b: a.join(b, "doc_id", "full_outer"), (kind(gold, pred) for kind in kinds)).na.fill(0)


def prf_of(parts: DataFrame, by: list[str], rn: str, rd: str, pn: str, pd_: str) -> DataFrame:
    """Sum parts by slice and divide: recall, precision, f1."""
    sums = parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in dict.fromkeys((rn, rd, pn, pd_))))
    return sums.select(*by, ratio(rn, rd).alias("recall"), ratio(pn, pd_).alias("precision")).withColumn("f1", f1("precision", "recall"))


def blanc(parts: DataFrame, by: list[str]) -> DataFrame:
    """BLANC: the mean over coreference and non-coreference links; where neither side has links of a kind the other kind counts alone."""
    sums = parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("cg", "cp", "cb", "ng", "np", "nb")))
    c = {"p": ratio("cb", "cp"), "r": ratio("cb", "cg")}
    n = {"p": ratio("nb", "np"), "r": ratio("nb", "ng")}
    no_c, no_n = (F.col("cg") + F.col("cp")) == 0, (F.col("ng") + F.col("np")) == 0

    def mean(a: Column, b: Column) -> Column:
        return F.when(no_c, b).when(no_n, a).otherwise((a + b) / 2)

    return sums.select(
        *by, mean(c["r"], n["r"]).alias("recall"), mean(c["p"], n["p"]).alias("precision"), mean(f1(c["p"], c["r"]), f1(n["p"], n["r"])).alias("f1")
    )


def macro_f1(*scores: Column) -> Column:
    """The mean of F1 values, as for CoNLL F1 (MUC, B3, CEAFe) or AVG-F4 (and BLANC)."""
    return sum(scores[1:], scores[0]) / len(scores)
