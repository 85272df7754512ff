"""Planning and judging of generated documents: quotas, topics, validation, candidates, logs' envelopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import YEAR_BEFORE_2025, YEAR_START, parse_object, safe_int, strip, topic_brief
from tessera.schemas import CATEGORY_PRIORITY, EVENT_CHAIN, ZERO, ZERO_SIGN
from tessera.scratch import materialize


def validation_reason(
    text: Column, sentences: Column, chains: Column, category: Column, least_chars: int = 110, sentence_range: tuple[int, int] = (5, 7), need_trigger: bool = False
) -> Column:
    """The first rule that a document breaks, or ok. chains: array of structs with type, mentions (sentence_id, text, role) and trigger."""

    def sid(m: Column) -> Column:
        return safe_int(m["sentence_id"])

    def anaphor(m: Column) -> Column:
        return F.coalesce(m["role"] == "anaphor", F.lit(False))

    def first_fault(c: Column) -> Column:
        """The first fault of a zero chain, in the order of its mentions."""
        faults = F.transform(
            c["mentions"],
            lambda m: F.when(m.isNull(), "zero_chain_bad_mention")
            .when(sid(m).isNull() | (sid(m) < 1) | (sid(m) > F.size(sentences)), "zero_chain_bad_sid")
            .when(anaphor(m) & (F.coalesce(strip(m["text"]), F.lit("")) != ZERO_SIGN), "zero_anaphor_not_O")
            .when(anaphor(m) & ~F.contains(F.get(sentences, sid(m) - 1), F.lit(ZERO_SIGN)), "zero_anaphor_not_in_sentence")
            .when(~F.coalesce(m["role"].isin("antecedent", "anaphor"), F.lit(False)), "zero_chain_bad_role"),
        )
        n = lambda role: F.size(F.filter(c["mentions"], lambda m: F.coalesce(m["role"] == role, F.lit(False))))
        return F.when(F.coalesce(F.size(c["mentions"]), F.lit(0)) < 2, "zero_chain_too_short").otherwise(
            F.coalesce(F.get(F.array_compact(faults), F.lit(0)), F.when((n("antecedent") != 1) | (n("anaphor") < 1), "zero_chain_bad_cardinality"))
        )

    zero_faults = F.array_compact(F.transform(F.filter(chains, lambda c: F.coalesce(c["type"] == ZERO, F.lit(False))), first_fault))
    bad_trigger = F.exists(chains, lambda c: (c["type"] == EVENT_CHAIN) & F.coalesce(F.length(strip(c["trigger"]["text"])) == 0, F.lit(True)))
    types = F.transform(chains, lambda c: c["type"])
    return F.coalesce(
        F.when(text.isNull() | (F.length(text) < least_chars), "text_too_short"),
        F.when(sentences.isNull() | ~F.size(sentences).between(*sentence_range), "bad_sentences_len"),
        F.when(chains.isNull() | (F.size(chains) < 3), "too_few_chains"),
        F.when(bad_trigger, "missing_or_bad_event_trigger") if need_trigger else F.lit(None),
        F.get(zero_faults, F.lit(0)),
        F.when(category.isin(*CATEGORY_PRIORITY) & ~F.coalesce(F.array_contains(types, category), F.lit(False)), F.concat(F.lit("primary_type_missing:"), category)),
        F.when(F.get(sentences, F.lit(0)).rlike(YEAR_START), "bad_time_anchor_year_start"),
        F.when(text.rlike(YEAR_BEFORE_2025), "contains_pre_2025_year"),
        F.lit("ok"),
    )


def candidate_score(chains: Column) -> Column:
    """Three for each distinct type and one for each chain that goes over sentences."""
    return 3 * F.size(F.array_distinct(F.transform(chains, lambda c: c["type"]))) + F.size(F.filter(chains, lambda c: c["end_sentence"] > c["start_sentence"]))


def best_candidates(candidates: DataFrame, enough: int = 12) -> DataFrame:
    """Per topic the best candidate of the first attempt with any: the highest score, of equals the first, looking no further than the first with ``enough``.

    candidates: topic, attempt, cand, score of candidates that passed.
    """
    attempt = Window.partitionBy("topic")
    order = Window.partitionBy("topic").orderBy("cand").rowsBetween(Window.unboundedPreceding, -1)
    first = candidates.withColumn("a0", F.min("attempt").over(attempt)).where("attempt = a0")
    seen = first.withColumn("stop", F.coalesce(F.max(F.col("score") >= enough).over(order), F.lit(False))).where("NOT stop")
    return seen.groupBy("topic").agg(F.max(F.struct("score", -F.col("cand"))).alias("b"), F.first("a0").alias("attempt")).select(
        "topic", "attempt", (-F.col("b.col2")).alias("cand"), F.col("b.score").alias("score")
    )


def quotas(have: DataFrame, domains: DataFrame, per_domain: int, limit: int) -> DataFrame:
    """domain, have, gap (missing of per_domain), target: one each in turn among domains with a gap left until the limit. domains: domain, place."""
    n = have.groupBy("domain").agg(F.count("*").alias("have"))
    gap = domains.join(n, "domain", "left").select("domain", "place", F.coalesce("have", F.lit(0)).alias("have")).withColumn(
        "gap", F.greatest(F.lit(0), F.lit(per_domain) - F.col("have")).cast("long")
    )
    # a unit for each missing document; turn k of every domain comes before turn k + 1 of any
    turns = gap.where("gap > 0").select("domain", "place", F.explode(F.sequence(F.lit(1).cast("long"), "gap")).alias("turn"))
    taken = turns.orderBy("turn", "place").limit(limit).groupBy("domain").agg(F.count("*").alias("target"))
    return gap.join(taken, "domain", "left").select("domain", "have", "gap", F.coalesce("target", F.lit(0)).alias("target"))


def weighted_choice(options: DataFrame, draw: Column, weight: str = "gap") -> DataFrame:
    """Per row of draws in [0, 1) the option that its cumulative weight reaches; without any weight all weigh the same. options: option, weight, place and draw id."""
    w = Window.partitionBy("draw_id").orderBy("place")
    every = Window.partitionBy("draw_id")
    even = options.withColumn("w", F.when(F.sum(weight).over(every) > 0, F.col(weight)).otherwise(F.lit(1)))
    cut = even.withColumn("upto", F.sum("w").over(w)).withColumn("total", F.sum("w").over(every))
    return cut.where(F.col("upto") > draw * F.col("total")).groupBy("draw_id").agg(F.min_by("option", "place").alias("option"))


def plan_topics(space: DataFrame, signature: Column, history: DataFrame, blocked: list[str], targets: DataFrame, order: Column) -> DataFrame:
    """Briefs up to each domain's target, in hash order, whose signature isn't in history and that hold no blocked term. space: domain, topic, action, conflict, evidence."""
    brief = topic_brief(*(F.col(c) for c in ("domain", "topic", "action", "conflict", "evidence")))
    fresh = space.withColumn("brief", brief)
    for term in blocked:
        fresh = fresh.where(~F.contains("brief", F.lit(term)))
    fresh = fresh.withColumn("signature", signature).join(history.select("signature").distinct(), "signature", "left_anti")
    once = fresh.groupBy("signature").agg(F.min_by(F.struct("domain", "brief"), order).alias("x"), F.min(order).alias("o")).select("x.*", "signature", "o")
    k = F.row_number().over(Window.partitionBy("domain").orderBy("o", "brief"))
    return once.withColumn("k", k).join(targets.select("domain", "target"), "domain").where("k <= target").select("domain", "k", "brief", "signature")


def batch_counts(accepted: DataFrame, order: list[str], by: str, size: int = 50) -> DataFrame:
    """batch, value, n: counts that start anew every ``size`` accepted. Rows are numbered by ranges of the order: a row per range is summed up, so nothing that is broadcast grows with the rows."""
    rows = materialize(accepted.select(*order, by).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "accepted")
    # one row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    k = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    numbered = rows.withColumn("_k", k).join(F.broadcast(base), "_part")
    return numbered.groupBy(F.floor((F.col("_k") + F.col("_before")) / size).alias("batch"), F.col(by).alias("value")).agg(F.count("*").alias("n"))


def recent(df: DataFrame, by: list[str], order: str, value: str, n: int) -> DataFrame:
    """The last n values before each row, oldest first."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-n, -1)
    return df.withColumn("recent", F.collect_list(value).over(w))


def repaired(obj: Column, envelope: bool = True) -> Column:
    """The document of a repair answer (canonical JSON): with an envelope the data of status ok or fixed, else the object itself."""
    if not envelope:
        return obj
    status = F.get_json_object(obj, "$.status")
    data = F.get_json_object(obj, "$.data")
    return F.when(status.isin("ok", "fixed") & data.startswith("{"), data)


def taken_repairs(answers: DataFrame, schema: str, check: Callable[[Column], Column], envelope: bool = True) -> DataFrame:
    """answers (answer: lenient JSON) with repaired, the document of a repair as this schema, and reason: no_document, or what check says of it (ok if nothing).

    A repaired document is judged anew by the rules that it broke: check gets the
    struct and gives the first broken rule or ok. Only rows of reason ok may be taken.
    """
    raw = repaired(parse_object("answer"), envelope)
    told = answers.withColumn("repaired", F.from_json(raw, schema))
    return told.withColumn("reason", F.when(F.col("repaired").isNull(), "no_document").otherwise(F.coalesce(check(F.col("repaired")), F.lit("ok"))))


def gen_id(prefix: Column, number: Column, suffix: Column) -> Column:
    return F.format_string("%s-%06d-%s", prefix, number, suffix)
