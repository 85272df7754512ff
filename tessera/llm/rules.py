"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Each rule rejects a document whose metric is above a cutoff. A level is one
cutoff of every rule, and the levels go from strict to lenient; what is controlled
is the union: the share of good documents that any rule of the level rejects.
Levels are certified per stratum (``lang``) on the labelled good documents that
pass the base: a level is certified if the exact binomial probability of at most
the observed number of false rejections, were the true rate ``risk``, is at most
``delta`` divided by the number of strata. They are tested from the most lenient
on, in an order fixed beforehand, and the first that fails ends the tests, so the
levels of a stratum need no further correction; the strictest certified one is
used. With probability 1 - delta the rules reject at most ``risk`` of the good
documents of each stratum. A stratum in which not even the most lenient level is
certified has no rules: that takes ln(delta / strata) / ln(1 - risk) labelled
good documents, 217 with four strata and the defaults, if none is rejected.

Defined results: null and empty texts have zero counts and fail the base; a null
stratum is a stratum of its own; strata without labels use no rules; labels of
unknown documents are ignored, and of contradicting labels for a doc_id the
greatest counts; repeated rows each keep their row; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.scratch import materialize

#: What counts as white space, and as a symbol.
WORD, BLANK, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", "#*$%&|<>"
WINDOW = 8
RISK, DELTA = 0.02, 0.05
#: The metric of each rule and its cutoff at each level, from strict to lenient.
RULES = {
    "symbols": ("n_symbols / word_chars", (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3)),
    "upper": ("n_upper / word_chars", (0.05, 0.08, 0.1, 0.12, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "dup_lines": ("n_dup_lines / n_lines", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7)),
    "repeats": ("n_repeat_words / n_words", (0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.29)),
    "word_length": ("word_chars / n_words", (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 14.0, 17.0, 20.0, 30.0)),
}

LEVELS = 10


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """How many of the words lie in k-word windows (k a power of two) that occur at least twice."""

    def doubled(step: int):
        return lambda h: F.zip_with(
            F.slice(h, 1, F.size(h) - step), F.slice(h, F.lit(step + 1), F.size(h) - step), lambda a, b: F.xxhash64(a, b)
        )

    def windows(hashes: Column) -> Column:
        out, step = hashes, 1
        while step < k:
            out = _let(out, doubled(step))
            step *= 2
        return out

    def covered(hashes: Column) -> Column:
        def count(ordered: Column) -> Column:
            # neighbours of equal hash are repeats; their positions, in order, cover k words each
            at = F.array_sort(
                F.filter(
                    F.transform(
                        ordered,
                        lambda x, i: F.when(
                            ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"])) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)),
                            x["at"],
                        ),
                    ),
                    lambda x: x.isNotNull(),
                )
            )
            return F.aggregate(
                at,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda a, p: F.struct((a["n"] + p + k - F.greatest(p, a["end"])).alias("n"), (p + k).alias("end")),
                lambda a: a["n"],
            )

        ordered = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(ordered, count))

    return (
        F.when(F.size(words) <= k, F.lit(0))
        .otherwise(_let(windows(F.transform(words, lambda w: F.xxhash64(w))), covered))
        .cast("long")
    )


def _deleted(text: Column, letters: str) -> Column:
    """How many of the letters the text holds."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def metrics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select(
        F.col("doc_id").cast("long"),
        F.col(stratum).cast("string").alias("stratum"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
    )
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    n = F.size("words").cast("long")
    return cut.select(
        "doc_id",
        "stratum",
        n.alias("n_words"),
        F.length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
        _deleted(F.col("text"), SYMBOLS).alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        _deleted(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
    ).select(
        "*", F.col("lines.dup").cast("long").alias("n_dup_lines"), F.col("lines.n").cast("long").alias("n_lines")
    ).drop("lines")


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float, terms: int = 4096) -> Column:
    """P(Bin(n, p) <= k), summed downwards from k; after ``terms`` terms a geometric bound of the rest is added, so it's never too small.

    Where k >= n p the value isn't needed exactly and is given as 1.
    """
    kd, nd = k.cast("double"), n.cast("double")
    top = F.exp(
        _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log(1 - p)
    )
    odds = (1 - p) / p
    total = F.aggregate(
        F.sequence(F.lit(0), F.least(k, F.lit(terms)).cast("int")),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, i: F.struct(
            (a["sum"] + a["term"]).alias("sum"), (a["term"] * ((kd - i) * odds / (nd - kd + i + 1))).alias("term")
        ),
        lambda a: a["sum"] + F.when(k > terms, a["term"] / (1 - (kd - terms) * odds / (nd - kd + terms + 1))).otherwise(0.0),
    )
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(top * total)


def _value(metric: str) -> Column:
    return F.coalesce(F.try_divide(*[F.expr(x).cast("double") for x in metric.split(" / ")]), F.lit(0.0))


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def levels(found: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, level): the strictest certified level (0 is the strictest there is) of the strata that have one."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality = 1")
    held = found.where(~_base_failed()).join(good.select("doc_id"), "doc_id", "left_semi")
    # how many levels reject the document: the most cutoffs that one of its metrics is above
    above = F.greatest(*(sum(((_value(metric) > c).cast("int") for c in grid), F.lit(0)) for metric, grid in RULES.values()))
    counts = held.groupBy("stratum", above.alias("above")).agg(F.count("*").alias("n"))
    whole = counts.groupBy("stratum").agg(F.sum("n").alias("n"), F.collect_list(F.struct("above", "n")).alias("hist"))
    n_strata = whole.agg(F.count("*").alias("strata"))
    tried = whole.select("stratum", "n", "hist", F.explode(F.array(*map(F.lit, range(LEVELS)))).alias("level")).withColumn(
        "k", F.aggregate("hist", F.lit(0).cast("long"), lambda a, h: a + F.when(h["above"] > F.col("level"), h["n"]).otherwise(0))
    )
    return (
        tried.crossJoin(F.broadcast(n_strata))  # one row
        .withColumn("fails", binomial_tail(F.col("k"), F.col("n"), risk) > delta / F.col("strata"))
        .groupBy("stratum")
        .agg((F.coalesce(F.max(F.when(F.col("fails"), F.col("level"))), F.lit(-1)) + 1).alias("level"))
        .where(F.col("level") < LEVELS)
    )


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, stratum: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and rejected_by (names of the rules)."""
    found = materialize(metrics(docs, stratum), "metrics")
    used = levels(found, labels, risk, delta).withColumnRenamed("stratum", "s")
    cutoff = lambda grid: F.get(F.array(*map(F.lit, grid)), F.col("level"))
    hit = F.array_compact(F.array(*(F.when(_value(metric) > cutoff(grid), F.lit(rule)) for rule, (metric, grid) in RULES.items())))
    return (
        found.join(used, found.stratum.eqNullSafe(used.s), "left")
        .withColumn("base_failed", _base_failed())
        .withColumn("hit", hit)
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            (~F.col("base_failed") & (F.size("hit") == 0)).alias("kept"),
            F.array_join("hit", ",").alias("rejected_by"),
        )
    )


def _sql() -> str:
    rules = ",\n".join(f"('{rule}', {i}, {c}::DOUBLE)" for rule, (_, grid) in RULES.items() for i, c in enumerate(grid))
    metric = ", ".join(f"struct_pack(rule := '{rule}', value := coalesce({a}::DOUBLE / nullif({b}, 0)::DOUBLE, 0))" for rule, (m, _) in RULES.items() for a, b in [m.split(" / ")])
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, lang, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
v AS (SELECT r, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM v) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + o)::BIGINT AS n FROM rep, (SELECT unnest(range(0, 8)) AS o) GROUP BY r),
ln AS (SELECT r, count(*)::BIGINT AS n, (count(*) - count(DISTINCT line))::BIGINT AS dup
       FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT w.r, doc_id, lang, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(ln.dup, 0) AS n_dup_lines, coalesce(ln.n, 0) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words,
        (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper
      FROM w LEFT JOIN ln ON ln.r = w.r LEFT JOIN cov ON cov.r = w.r),
x AS (SELECT r, doc_id, lang, unnest([{metric}]) AS x FROM m),
g AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
c(rule, level, cutoff) AS (VALUES {rules}),
y AS (SELECT x.r, x.lang, c.level, bool_or(x.x.value > cutoff) AS rejected FROM x JOIN m USING (r) JOIN c ON c.rule = x.x.rule
      WHERE x.doc_id IN (SELECT doc_id FROM g) AND NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) GROUP BY ALL),
t AS (SELECT lang, level, count(*) AS n, count(*) FILTER (WHERE rejected) AS k FROM y GROUP BY lang, level),
s AS (SELECT count(*) AS n FROM (SELECT DISTINCT lang FROM t)),
f AS (SELECT lang, level, k < n * {RISK} AND
        (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln(1 - {RISK})))
         FROM (SELECT unnest(range(0, k + 1)) AS j)) <= {DELTA} / (SELECT n FROM s) AS certified FROM t),
p AS (SELECT lang, coalesce(max(level) FILTER (WHERE NOT certified), -1) + 1 AS level FROM f GROUP BY lang),
h AS (SELECT x.r, string_agg(x.x.rule, ',' ORDER BY list_position({list(RULES)}, x.x.rule)) AS hit
      FROM x JOIN p ON p.lang IS NOT DISTINCT FROM x.lang JOIN c ON c.rule = x.x.rule AND c.level = p.level AND x.x.value > cutoff GROUP BY x.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND h.hit IS NULL AS kept, coalesce(h.hit, '') AS rejected_by
FROM m LEFT JOIN h ON h.r = m.r
"""


SQL = _sql()
