"""Corpus counts, audits, gates and zero-pronoun evaluation over the derived mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import corpus as O
from tessera.operators import metrics as M
from tessera.operators import slices as L
from tessera.operators import tokens as N
from tessera.plans import views as V
from tessera.schemas import CATEGORY_PRIORITY, CHAIN_PRIORITY, EVENT_CHAIN, EVENT_MENTION

SPAN = M.SPAN


def _case(column: str, order: list[str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(order)) + f" ELSE {len(order)} END"


CHAINS = V.MENTION + f""",
v_chain AS (
  SELECT doc_id, chain_id, CASE WHEN t = '{EVENT_MENTION}' THEN '{EVENT_CHAIN}' ELSE t END AS chain_type, start_sentence, end_sentence, n_mentions
  FROM (SELECT doc_id, chain_id, arg_min(mention_type, {_case('mention_type', CHAIN_PRIORITY)}) AS t, min(sentence_id) AS start_sentence, max(sentence_id) AS end_sentence, count(*) AS n_mentions
        FROM v_mention GROUP BY doc_id, chain_id))"""


def corpus_totals(s, d):
    return O.totals(V.sentences(s, d), V.mentions(s, d))


def corpus_counts_by_key(s, d):
    return O.counts_by_key(V.mentions(s, d), ["split", "mention_type", "semantics", "is_zero"])


def doc_counts(s, d):
    m = V.mentions(s, d).groupBy("doc_id").agg(F.count_distinct("chain_id").alias("n_chains"), F.count("*").alias("n_mentions"))
    n = V.sentences(s, d).groupBy("doc_id").agg(F.count("*").alias("n_sentences"))
    zero = F.lit(0).cast("long")
    return n.join(m, "doc_id", "left").select("doc_id", "n_sentences", F.coalesce("n_chains", zero).alias("n_chains"), F.coalesce("n_mentions", zero).alias("n_mentions"))


def chain_derived_type(s, d):
    return O.chain_types(V.mentions(s, d))


def doc_derived_category(s, d):
    return O.doc_categories(chain_derived_type(s, d))


def chain_mixed_semantics(s, d):
    return O.chain_semantics(V.mentions(s, d)).where("n_semantics > 1")


def test_view_audit(s, d):
    return O.test_view_audit(V.mentions(s, d).where("split = 'test'"))


def zero_count_reconcile(s, d):
    """Zeros by split counted from the mention rows and again from the chains' nested members."""
    m = V.mentions(s, d)
    flat = m.where("is_zero").groupBy("split").agg(F.count("*").alias("n")).select(F.lit("mention_map").alias("source"), F.col("split").alias("key"), "n")
    nested = m.groupBy("split", "doc_id", "chain_id").agg(F.collect_list("mention_type").alias("kinds")).groupBy("split").agg(
        F.sum(F.size(F.filter("kinds", lambda k: k == "零指代"))).alias("n")
    )
    return flat.unionByName(nested.where("n > 0").select(F.lit("corpus").alias("source"), F.col("split").alias("key"), "n"))


def gold_violations(s, d):
    """The derived mentions against their sentences, with offsets drawn so that some are wrong."""
    m = V.mentions(s, d).join(V.sentences(s, d), ["doc_id", "sentence_id"])
    at = F.expr("locate(tok, sent) - 1")
    h = V.draw(F.lit("v"), "doc_id", "sentence_id", "token_id") % 20
    shifted = m.withColumn("char_start", at + F.when(h == 0, 1).when(h == 1, 100000).otherwise(0)).withColumn("char_end", F.expr("char_start + length(tok) - 1"))
    c = chain_derived_type(s, d).withColumn("end_sentence", F.col("end_sentence") + F.when(V.draw(F.lit("c"), "doc_id", "chain_id") % 10 == 0, 1).otherwise(0))
    return O.gold_violations(shifted.withColumnRenamed("tok", "text").drop("sent"), V.sentences(s, d), c)


def event_zero_listing(s, d):
    return O.event_zero_listing(V.mentions(s, d), V.sentences(s, d))


def split_leakage(s, d):
    docs = V.table(s, d, "documents").select("doc_id", V.split_of("doc_id").alias("split"))
    copies = docs.where(V.draw(F.lit("l"), "doc_id") % 50 == 0).select("doc_id", F.lit("test").alias("split"))
    return O.overlaps_of_splits(docs.unionByName(copies), ["train", "dev", "test"])


def slice_semijoin_docs(s, d):
    return V.table(s, d, "documents").join(V.table(s, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.length("text").cast("long").alias("n_chars"))


def slice_missing_ids(s, d):
    wanted = V.table(s, d, "labels").select((F.col("doc_id") + 300).alias("doc_id"))
    return O.missing(wanted, V.table(s, d, "documents"), ["doc_id"])


def duplicate_doc_ids(s, d):
    return O.duplicates(V.table(s, d, "labels").select((F.col("doc_id") / 2).cast("long").alias("doc_id")), ["doc_id"])


def expectation_gate(s, d):
    t = corpus_totals(s, d)
    return O.expect(t, {"n_docs": 1000, "n_chains": 1, "n_mentions": 2})


def alignment_check(s, d):
    t = V.tokens(s, d)
    h = V.draw(F.lit("a"), "doc_id", "sentence_id", "token_id") % 100
    return O.alignment(t, t.where(h != 0).withColumn("tok", F.when(h == 1, F.upper("tok")).otherwise(F.col("tok"))))


def zero_key_symdiff(s, d):
    z = V.mentions(s, d).where("is_zero")
    p = V.predicted(s, d).where("is_zero")
    return O.symmetric_difference(z, p, SPAN, ("mention_map_only", "token_map_only"))


def _zeros(s, d):
    return V.mentions(s, d).where("is_zero").select(SPAN)


def zero_detail(s, d):
    return M.zero_detail(V.mentions(s, d), V.predicted(s, d), _zeros(s, d))


def zero_resolution(s, d):
    return M.zero_resolution(zero_detail(s, d).withColumn("split", V.split_of("doc_id")), ["split"])


def zero_pair_metrics(s, d):
    return M.zero_pairs(zero_detail(s, d).withColumn("split", V.split_of("doc_id")), ["split"])


def zero_coverage(s, d):
    return zero_detail(s, d).select(*SPAN, "covered")


def zero_wrong_cluster_sanity(s, d):
    """Gold against gold with every zero in a wrong cluster: coverage stays, resolution falls."""
    g = V.mentions(s, d)
    bad = M.wrong_cluster(g, _zeros(s, d))
    same = M.zero_resolution(M.zero_detail(g, g.select(*SPAN, F.col("chain_id").alias("pred_id")), _zeros(s, d))).withColumn("variant", F.lit("gold"))
    moved = M.zero_resolution(M.zero_detail(g, bad, _zeros(s, d))).withColumn("variant", F.lit("wrong_cluster"))
    return same.unionByName(moved).select("variant", "gold_zero", "covered", "resolvable", "correct_resolved", "coverage", "recall")


def zero_wrong_cluster(s, d):
    return M.wrong_cluster(V.mentions(s, d), _zeros(s, d))


def _spans(s, d):
    """Predictions as spans; every third zero is a token too wide."""
    wide = F.when(F.col("is_zero") & (V.draw(F.lit("w"), *SPAN) % 3 == 0), 1).otherwise(0)
    return V.predicted(s, d).select("doc_id", "sentence_id", F.col("token_id").alias("start"), (F.col("token_id") + wide).alias("end"), "pred_id")


def _zero_tokens(s, d):
    z = _zeros(s, d)
    return z.unionByName(z.withColumn("token_id", F.col("token_id") + 1))


def zero_normalized_eval(s, d):
    """Strict and normalised scores of predictions with widened zeros."""
    wide = _spans(s, d)
    fixed = M.normalize_zero_spans(wide, _zero_tokens(s, d), _zeros(s, d))
    out = []
    for name, p in (("strict", wide), ("normalized", fixed)):
        exact = p.where("start = end").select("doc_id", "sentence_id", F.col("start").alias("token_id"), "pred_id")
        out.append(M.zero_resolution(M.zero_detail(V.mentions(s, d), exact, _zeros(s, d))).withColumn("variant", F.lit(name)))
    return O.union_all(out)


def zero_pairized_sanity(s, d):
    """Gold with every zero a token too wide: nothing is covered before normalisation, all after."""
    m = V.mentions(s, d)
    wide = m.select("doc_id", "sentence_id", F.col("token_id").alias("start"), (F.col("token_id") + F.col("is_zero").cast("int")).alias("end"), F.col("chain_id").alias("pred_id"))
    fixed = M.normalize_zero_spans(wide, _zero_tokens(s, d), _zeros(s, d))
    out = []
    for name, p in (("strict", wide), ("normalized", fixed)):
        exact = p.where("start = end").select("doc_id", "sentence_id", F.col("start").alias("token_id"), "pred_id")
        out.append(M.zero_resolution(M.zero_detail(m, exact, _zeros(s, d))).select(F.lit(name).alias("variant"), "gold_zero", "covered", "correct_resolved"))
    return O.union_all(out)


def zero_anchor_diagnostic(s, d):
    return M.anchor_diagnostic(_zeros(s, d), _spans(s, d)).agg(
        F.count("*").alias("anchors"), *(F.count_if(c).alias(c) for c in ("exact", "starts", "ends", "contained", "in_multi", "ambiguous"))
    )


def zero_span_lengths(s, d):
    return M.containing_lengths(_zeros(s, d), _spans(s, d))


def literal_zero_audit(s, d):
    return M.literal_summary(M.literal_audit(V.mentions(s, d), V.predicted(s, d), _zeros(s, d)))


def _docs(s, d):
    return V.mentions(s, d), V.predicted(s, d)


def _sliced(parts: DataFrame) -> DataFrame:
    return parts.withColumn("slice", V.split_of("doc_id"))


def muc_by_slice(s, d):
    return M.prf_of(_sliced(M.muc_parts(*_docs(s, d))), ["slice"], "muc_rn", "muc_rd", "muc_pn", "muc_pd")


def b3_by_slice(s, d):
    return M.prf_of(_sliced(M.b3_parts(*_docs(s, d))), ["slice"], "b3_rn", "b3_rd", "b3_pn", "b3_pd")


def blanc_by_slice(s, d):
    return M.blanc(_sliced(M.blanc_parts(*_docs(s, d))), ["slice"])


def ceafe_by_slice(s, d):
    return M.prf_of(_sliced(M.ceafe_parts(*_docs(s, d))), ["slice"], "ceafe_n", "ceafe_rd", "ceafe_n", "ceafe_pd")


def conll_f1_by_slice(s, d):
    named = [x.select("slice", F.col("f1").alias(n)) for n, x in (("muc_f1", muc_by_slice(s, d)), ("b3_f1", b3_by_slice(s, d)), ("ceafe_f1", ceafe_by_slice(s, d)), ("blanc_f1", blanc_by_slice(s, d)))]
    joined = named[0].join(named[1], "slice").join(named[2], "slice").join(named[3], "slice")
    return joined.withColumn("conll_f1", M.macro_f1(F.col("muc_f1"), F.col("b3_f1"), F.col("ceafe_f1"))).withColumn(
        "avg_f4", M.macro_f1(F.col("muc_f1"), F.col("b3_f1"), F.col("ceafe_f1"), F.col("blanc_f1"))
    )


def _labels(name: str, labels: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, labels)), (V.draw(F.lit(name), "doc_id") % len(labels)).cast("int"))


def _meta(s, d) -> DataFrame:
    """A domain and a phenomenon of each document, as its metadata would have them."""
    return V.table(s, d, "documents").select("doc_id", *(_labels(name, labels).alias(name) for name, labels in L.GROUPINGS.items()))


def slice_scores(s, d):
    return L.slice_scores(M.document_parts(*_docs(s, d), assigned=False), _meta(s, d))


def slice_conll_scores(s, d):
    return L.slice_scores(M.document_parts(*_docs(s, d)), _meta(s, d))


def slice_problems(s, d):
    """Test documents against metadata with unknown domains, missing rows, repeated rows and rows of another split."""
    h = V.draw(F.lit("meta"), "doc_id")
    meta = _meta(s, d).withColumn("domain", F.when(h % 41 == 0, "XX").otherwise(F.col("domain"))).withColumn("split", F.when(h % 37 == 0, "dev").otherwise(V.split_of("doc_id")))
    rows = meta.where(h % 43 != 0).unionByName(meta.where(h % 47 == 0))
    docs = V.table(s, d, "documents").where(V.split_of("doc_id") == "test")
    return L.slice_problems(docs, rows, split="test", expected=448)


def global_token_index(s, d):
    return N.global_index(V.tokens(s, d))


def sentence_starts(s, d):
    return N.sentence_starts(V.tokens(s, d)).select("doc_id", "sentence_id", "start")


_J = "USING (doc_id, sentence_id, token_id)"
_SP = "doc_id, sentence_id, token_id"
ZERO_SQL = V.PREDICTED + f""",
v_zero AS (SELECT {_SP}, chain_id FROM v_mention WHERE is_zero)"""


def _detail(pred: str, name: str = "v_detail") -> str:
    return f""", {name}_g AS (SELECT z.{_SP.replace(', ', ', z.')}, m.sentence_id AS ps, m.token_id AS pt FROM v_zero z JOIN v_mention m ON m.doc_id = z.doc_id AND m.chain_id = z.chain_id AND NOT m.is_zero),
{name}_p AS (SELECT z.{_SP.replace(', ', ', z.')}, o.sentence_id AS ps, o.token_id AS pt FROM v_zero z JOIN {pred} q ON q.doc_id = z.doc_id AND q.sentence_id = z.sentence_id AND q.token_id = z.token_id
  JOIN {pred} o ON o.doc_id = q.doc_id AND o.pred_id = q.pred_id ANTI JOIN v_zero zz ON zz.doc_id = o.doc_id AND zz.sentence_id = o.sentence_id AND zz.token_id = o.token_id),
{name} AS (SELECT z.{_SP.replace(', ', ', z.')}, EXISTS (SELECT 1 FROM {pred} q WHERE q.doc_id = z.doc_id AND q.sentence_id = z.sentence_id AND q.token_id = z.token_id) AS covered,
  coalesce(g.n, 0) > 0 AS resolvable, coalesce(p.n, 0) > 0 AS pred_resolved, coalesce(c.n, 0) > 0 AS correct, coalesce(g.n, 0) AS gold_pairs, coalesce(p.n, 0) AS pred_pairs, coalesce(c.n, 0) AS correct_pairs
  FROM v_zero z LEFT JOIN (SELECT {_SP}, count(*) AS n FROM {name}_g GROUP BY ALL) g {_J} LEFT JOIN (SELECT {_SP}, count(*) AS n FROM {name}_p GROUP BY ALL) p {_J}
  LEFT JOIN (SELECT {_SP}, count(*) AS n FROM {name}_g JOIN {name}_p USING (doc_id, sentence_id, token_id, ps, pt) GROUP BY ALL) c {_J})"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / ({b})::DOUBLE ELSE 0 END"


RESOLUTION = f"""count(*) AS gold_zero, count(*) FILTER (WHERE resolvable) AS resolvable, count(*) FILTER (WHERE covered) AS covered,
 count(*) FILTER (WHERE pred_resolved) AS pred_resolved, count(*) FILTER (WHERE correct) AS correct_resolved"""
RATES = f"""{_div('covered', 'gold_zero')} AS coverage, {_div('correct_resolved', 'pred_resolved')} AS precision, {_div('correct_resolved', 'resolvable')} AS recall,
 {_div('2 * correct_resolved', 'pred_resolved + resolvable')} AS f1"""
WRONG = f""", v_cl AS (SELECT DISTINCT doc_id, chain_id AS other FROM v_mention WHERE NOT is_zero),
v_new AS (SELECT m.{_SP.replace(', ', ', m.')}, m.chain_id, m.is_zero, (SELECT arg_min(other, other::VARCHAR) FROM v_cl c WHERE c.doc_id = m.doc_id AND c.other <> m.chain_id) AS other FROM v_mention m),
v_wrong AS (SELECT {_SP}, CASE WHEN is_zero THEN coalesce(other, chain_id) ELSE chain_id END AS pred_id, is_zero AND other IS NOT NULL AS changed FROM v_new),
v_same AS (SELECT {_SP}, chain_id AS pred_id FROM v_mention)"""
SPANS = f""", v_span AS (SELECT doc_id, sentence_id, token_id AS start, token_id + CASE WHEN is_zero AND {V.draw_sql("'w'", 'doc_id', 'sentence_id', 'token_id')} % 3 = 0 THEN 1 ELSE 0 END AS stop, pred_id FROM v_pred),
v_strict AS (SELECT doc_id, sentence_id, start AS token_id, pred_id FROM v_span WHERE start = stop),
v_normal AS (SELECT doc_id, sentence_id, token_id, pred_id FROM v_pred)"""
OVER = V.PREDICTED + f""",
v_o AS (SELECT m.doc_id, m.chain_id AS g, p.pred_id AS p, count(*) AS n FROM v_mention m JOIN v_pred p USING (doc_id, sentence_id, token_id) GROUP BY ALL),
v_gs AS (SELECT doc_id, chain_id AS g, count(*) AS size FROM v_mention GROUP BY ALL), v_ps AS (SELECT doc_id, pred_id AS p, count(*) AS size FROM v_pred GROUP BY ALL)"""


def _muc(side: str, key: str) -> str:
    return f"""(SELECT {V.split_sql()} AS slice, sum(s.size - (coalesce(k, 0) + s.size - coalesce(m, 0))) AS num, sum(s.size - 1) AS den FROM {side} s
      LEFT JOIN (SELECT doc_id, {key}, count(*) AS k, sum(n) AS m FROM v_o GROUP BY ALL) USING (doc_id, {key}) GROUP BY slice)"""


def _b3(side: str, key: str) -> str:
    return f"""(SELECT slice, sum(num) AS num, sum(den) AS den FROM (SELECT {V.split_sql()} AS slice, size AS den,
      coalesce((SELECT sum(n * n / s.size::DOUBLE) FROM v_o WHERE v_o.doc_id = s.doc_id AND v_o.{key} = s.{key}), 0) AS num FROM {side} s) GROUP BY slice)"""


def _prf(part) -> str:
    return f"""WITH {OVER} SELECT slice, recall, precision, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END AS f1 FROM (
      SELECT slice, {_div('r.num', 'r.den')} AS recall, {_div('q.num', 'q.den')} AS precision FROM {part('v_gs', 'g')} r JOIN {part('v_ps', 'p')} q USING (slice))"""


_C = "({0} * ({0} - 1) // 2)"
BLANC_DOCS = f"""g AS (SELECT doc_id, sum({_C.format('size')}) AS cg, {_C.format('sum(size)')} - sum({_C.format('size')}) AS ng FROM v_gs GROUP BY doc_id),
q AS (SELECT doc_id, sum({_C.format('size')}) AS cp, {_C.format('sum(size)')} - sum({_C.format('size')}) AS np FROM v_ps GROUP BY doc_id),
sh AS (SELECT m.doc_id, m.chain_id AS g, p.pred_id AS p, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.sentence_id, m.token_id) AS i FROM v_mention m JOIN v_pred p USING (doc_id, sentence_id, token_id)),
b AS (SELECT x.doc_id, count(*) FILTER (WHERE x.g = y.g AND x.p = y.p) AS cb, count(*) FILTER (WHERE x.g <> y.g AND x.p <> y.p) AS nb FROM sh x JOIN sh y ON x.doc_id = y.doc_id AND x.i < y.i GROUP BY x.doc_id)"""
BLANC_SQL = f"""WITH {OVER}, {BLANC_DOCS},
t AS (SELECT {V.split_sql()} AS slice, sum(coalesce(cg, 0)) AS cg, sum(coalesce(ng, 0)) AS ng, sum(coalesce(cp, 0)) AS cp, sum(coalesce(np, 0)) AS np, sum(coalesce(cb, 0)) AS cb, sum(coalesce(nb, 0)) AS nb
      FROM g FULL JOIN q USING (doc_id) LEFT JOIN b USING (doc_id) GROUP BY slice)
SELECT slice, ({_div('cb', 'cg')} + {_div('nb', 'ng')}) / 2 AS recall, ({_div('cb', 'cp')} + {_div('nb', 'np')}) / 2 AS precision,
  ({_div('2 * cb', 'cg + cp')} + {_div('2 * nb', 'ng + np')}) / 2 AS f1 FROM t"""


def _label_sql(name: str) -> str:
    return f"{list(L.GROUPINGS[name])}[{V.draw_sql(chr(39) + name + chr(39), 'doc_id')} % {len(L.GROUPINGS[name])} + 1] AS {name}"


META = f"meta AS (SELECT doc_id, {', '.join(map(_label_sql, L.GROUPINGS))} FROM documents)"


def _slice_sql() -> str:
    def muc(side: str, key: str) -> str:
        return f"""SELECT doc_id, sum(s.size - (coalesce(k, 0) + s.size - coalesce(m, 0))) AS mn, sum(s.size - 1) AS md, sum(s.size) AS bd, coalesce(sum(b / s.size::DOUBLE), 0) AS bn FROM {side} s
      LEFT JOIN (SELECT doc_id, {key}, count(*) AS k, sum(n) AS m, sum(n * n) AS b FROM v_o GROUP BY ALL) USING (doc_id, {key}) GROUP BY doc_id"""

    wanted = ", ".join(f"('{g}', '{x}', {i})" for i, (g, x) in enumerate([("all", "all"), *((n, x) for n, labels in L.GROUPINGS.items() for x in labels)]))
    sums = "mnr mdr bnr bdr mnp mdp bnp bdp cg ng cp np cb nb".split()
    f1 = lambda p, r: f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"
    return f"""WITH {OVER}, {BLANC_DOCS}, {META},
rr AS ({muc('v_gs', 'g')}), pp AS ({muc('v_ps', 'p')}),
parts AS (SELECT doc_id, coalesce(rr.mn, 0) AS mnr, coalesce(rr.md, 0) AS mdr, coalesce(rr.bn, 0) AS bnr, coalesce(rr.bd, 0) AS bdr, coalesce(pp.mn, 0) AS mnp, coalesce(pp.md, 0) AS mdp, coalesce(pp.bn, 0) AS bnp, coalesce(pp.bd, 0) AS bdp,
  coalesce(cg, 0) AS cg, coalesce(ng, 0) AS ng, coalesce(cp, 0) AS cp, coalesce(np, 0) AS np, coalesce(cb, 0) AS cb, coalesce(nb, 0) AS nb
  FROM rr FULL JOIN pp USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN b USING (doc_id)),
gs AS (SELECT CASE grouping(domain, phenomenon) WHEN 3 THEN 'all' WHEN 1 THEN 'domain' ELSE 'phenomenon' END AS grouping, CASE grouping(domain, phenomenon) WHEN 3 THEN 'all' WHEN 1 THEN domain ELSE phenomenon END AS slice,
  count(*) AS n_docs, {', '.join(f'sum({c}) AS {c}' for c in sums)} FROM parts JOIN meta USING (doc_id) GROUP BY GROUPING SETS ((), (domain), (phenomenon))),
w(grouping, slice, place) AS (VALUES {wanted}),
t AS (SELECT w.place, w.grouping, w.slice, coalesce(n_docs, 0) AS n_docs, {', '.join(f'coalesce({c}, 0) AS {c}' for c in sums)} FROM w LEFT JOIN gs ON gs.grouping = w.grouping AND gs.slice = w.slice),
x AS (SELECT *, {_div('mnr', 'mdr')} AS muc_r, {_div('mnp', 'mdp')} AS muc_p, {_div('bnr', 'bdr')} AS b3_r, {_div('bnp', 'bdp')} AS b3_p FROM t)
SELECT place, grouping, slice, n_docs, muc_r, muc_p, {f1('muc_p', 'muc_r')} AS muc_f1, b3_r, b3_p, {f1('b3_p', 'b3_r')} AS b3_f1,
  ({_div('cb', 'cg')} + {_div('nb', 'ng')}) / 2 AS blanc_r, ({_div('cb', 'cp')} + {_div('nb', 'np')}) / 2 AS blanc_p, ({_div('2 * cb', 'cg + cp')} + {_div('2 * nb', 'ng + np')}) / 2 AS blanc_f1 FROM x"""


PROBLEMS = f"""WITH {META}, m AS (SELECT doc_id, CASE WHEN h % 41 = 0 THEN 'XX' ELSE domain END AS domain, phenomenon, CASE WHEN h % 37 = 0 THEN 'dev' ELSE {V.split_sql()} END AS split, h FROM (SELECT *, {V.draw_sql("'meta'", 'doc_id')} AS h FROM meta)),
o AS (SELECT doc_id FROM documents WHERE {V.split_sql()} = 'test'), r AS (SELECT * FROM (SELECT * FROM m WHERE h % 43 <> 0 UNION ALL SELECT * FROM m WHERE h % 47 = 0) SEMI JOIN o USING (doc_id))
SELECT doc_id, 'no_metadata' AS problem, NULL AS value FROM o ANTI JOIN r USING (doc_id) UNION ALL SELECT doc_id, 'repeated_metadata', count(*)::VARCHAR FROM r GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT doc_id, 'other_split', split FROM r WHERE split <> 'test' UNION ALL SELECT doc_id, 'unknown_domain', domain FROM r WHERE domain = 'XX' UNION ALL SELECT NULL, 'total', n::VARCHAR FROM (SELECT count(*) AS n FROM o) WHERE n <> 448"""
GLOB = f"v_idx AS (SELECT {_SP}, (row_number() OVER (PARTITION BY doc_id ORDER BY sentence_id, token_id) - 1)::INT AS idx FROM v_tok)"
AUDIT = ZERO_SQL + f""",
v_j AS (SELECT z.*, p.pred_id FROM v_zero z LEFT JOIN v_pred p {_J}),
v_own AS (SELECT j.{_SP.replace(', ', ', j.')}, count(*) FILTER (WHERE m.sentence_id < j.sentence_id OR (m.sentence_id = j.sentence_id AND m.token_id < j.token_id)) AS n_prior,
  coalesce(bool_or((m.sentence_id < j.sentence_id OR (m.sentence_id = j.sentence_id AND m.token_id < j.token_id)) AND coalesce(q.pred_id = j.pred_id, false)), false) AS ah, coalesce(bool_or(coalesce(q.pred_id = j.pred_id, false)), false) AS ch
  FROM v_j j JOIN v_mention m ON m.doc_id = j.doc_id AND m.chain_id = j.chain_id AND (m.sentence_id <> j.sentence_id OR m.token_id <> j.token_id)
  LEFT JOIN v_pred q ON q.doc_id = m.doc_id AND q.sentence_id = m.sentence_id AND q.token_id = m.token_id GROUP BY ALL),
v_cs AS (SELECT p.doc_id, p.pred_id, count(*) AS size, count(DISTINCT m.chain_id) AS nc FROM v_pred p LEFT JOIN v_mention m {_J} GROUP BY ALL)"""

PLANS = {
    "corpus_totals": (corpus_totals, f"WITH {V.MENTION} SELECT (SELECT count(DISTINCT doc_id) FROM v_sent) AS n_docs, (SELECT count(*) FROM v_sent) AS n_sentences, count(*) AS n_mentions, (SELECT count(*) FROM (SELECT DISTINCT doc_id, chain_id FROM v_mention)) AS n_chains FROM v_mention"),
    "corpus_counts_by_key": (corpus_counts_by_key, f"WITH {V.MENTION} SELECT 'split' AS dimension, split AS value, count(*) AS n FROM v_mention GROUP BY ALL UNION ALL SELECT 'mention_type', mention_type, count(*) FROM v_mention GROUP BY ALL UNION ALL SELECT 'semantics', semantics, count(*) FROM v_mention GROUP BY ALL UNION ALL SELECT 'is_zero', is_zero::VARCHAR, count(*) FROM v_mention GROUP BY ALL"),
    "doc_counts": (doc_counts, f"WITH {V.MENTION} SELECT doc_id, n_sentences, coalesce(n_chains, 0) AS n_chains, coalesce(n_mentions, 0) AS n_mentions FROM (SELECT doc_id, count(*) AS n_sentences FROM v_sent GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(DISTINCT chain_id) AS n_chains, count(*) AS n_mentions FROM v_mention GROUP BY doc_id) USING (doc_id)"),
    "chain_derived_type": (chain_derived_type, f"WITH {CHAINS} SELECT * FROM v_chain"),
    "doc_derived_category": (doc_derived_category, f"WITH {CHAINS} SELECT doc_id, arg_max(chain_type, n * 10 - {_case('chain_type', CATEGORY_PRIORITY)}) AS category FROM (SELECT doc_id, chain_type, count(*) AS n FROM v_chain GROUP BY ALL) GROUP BY doc_id"),
    "chain_mixed_semantics": (chain_mixed_semantics, f"WITH {V.MENTION} SELECT doc_id, chain_id, count(DISTINCT semantics) AS n_semantics FROM v_mention GROUP BY ALL HAVING count(DISTINCT semantics) > 1"),
    "test_view_audit": (
        test_view_audit,
        f"""WITH {V.MENTION}, c AS (SELECT doc_id, chain_id, count(*) AS f, count(DISTINCT semantics) AS k, count(*) FILTER (WHERE semantics = 'ENTITY') AS e, count(*) FILTER (WHERE semantics = 'EVENT') AS v,
        count(*) FILTER (WHERE semantics = 'ENTITY' AND NOT is_zero) AS o, count(*) FILTER (WHERE semantics = 'ENTITY' AND is_zero) AS z FROM v_mention WHERE split = 'test' GROUP BY ALL)
        SELECT count(DISTINCT doc_id) AS documents, sum(f)::BIGINT AS full_mentions, count(*) AS full_chains, count(*) FILTER (WHERE k > 1) AS mixed_chains,
        {', '.join(f"sum(CASE WHEN {c} >= {m} THEN {c} ELSE 0 END)::BIGINT AS {n}_mentions, count(*) FILTER (WHERE {c} >= {m}) AS {n}_chains" for c, m, n in (('e', 2, 'entity'), ('v', 2, 'event'), ('o', 2, 'overt_entity'), ('z', 1, 'zero_entity')))} FROM c""",
    ),
    "zero_count_reconcile": (zero_count_reconcile, f"WITH {V.MENTION}, z AS (SELECT split, count(*) AS n FROM v_mention WHERE is_zero GROUP BY split) SELECT 'mention_map' AS source, split AS key, n FROM z UNION ALL SELECT 'corpus', split, n FROM z"),
    "gold_violations": (
        gold_violations,
        f"""WITH {CHAINS}, x AS (SELECT m.*, sent, strpos(sent, tok) - 1 + CASE {V.draw_sql("'v'", 'm.doc_id', 'm.sentence_id', 'token_id')} % 20 WHEN 0 THEN 1 WHEN 1 THEN 100000 ELSE 0 END AS cs FROM v_mention m JOIN v_sent s USING (doc_id, sentence_id)),
        c AS (SELECT *, (SELECT count(DISTINCT semantics) FROM v_mention m WHERE m.doc_id = v_chain.doc_id AND m.chain_id = v_chain.chain_id) AS ns FROM v_chain)
        SELECT 'sentence_missing' AS rule, 0::BIGINT AS n_violations UNION ALL SELECT 'offset_out_of_bounds', count(*) FROM x WHERE cs + length(tok) - 1 >= length(sent)
        UNION ALL SELECT 'slice_differs', count(*) FROM x WHERE substring(sent, cs + 1, length(tok)) <> tok UNION ALL SELECT 'zero_not_one_char', 0
        UNION ALL SELECT 'zero_of_other_type', count(*) FROM x WHERE is_zero UNION ALL SELECT 'chain_too_small', count(*) FROM c WHERE n_mentions < 2 UNION ALL SELECT 'chain_mixed_semantics', count(*) FROM c WHERE ns > 1
        UNION ALL SELECT 'chain_type_differs', 0 UNION ALL SELECT 'chain_range_differs', count(*) FROM c WHERE {V.draw_sql("'c'", 'doc_id', 'chain_id')} % 10 = 0""",
    ),
    "event_zero_listing": (
        event_zero_listing,
        f"""WITH {V.MENTION}, c AS (SELECT doc_id, chain_id, string_agg(concat_ws('|', tok, mention_type, semantics, 's' || sentence_id), ' || ' ORDER BY sentence_id, token_id) AS chain_mentions FROM v_mention GROUP BY ALL)
        SELECT m.doc_id, m.chain_id, m.sentence_id, m.token_id, sent AS sentence, chain_mentions FROM v_mention m JOIN c USING (doc_id, chain_id) JOIN v_sent USING (doc_id, sentence_id) WHERE is_zero AND semantics = 'EVENT'""",
    ),
    "split_leakage": (
        split_leakage,
        f"""WITH a AS (SELECT doc_id, {V.split_sql()} AS split FROM documents UNION SELECT doc_id, 'test' FROM documents WHERE {V.draw_sql("'l'", 'doc_id')} % 50 = 0)
        SELECT p AS pair, (SELECT count(*) FROM (SELECT doc_id FROM a WHERE split = x) JOIN (SELECT doc_id FROM a WHERE split = y) USING (doc_id)) AS n_overlap
        FROM (VALUES ('train-dev', 'train', 'dev'), ('train-test', 'train', 'test'), ('dev-test', 'dev', 'test')) t(p, x, y)""",
    ),
    "slice_semijoin_docs": (slice_semijoin_docs, "SELECT doc_id, length(text) AS n_chars FROM documents SEMI JOIN labels USING (doc_id)"),
    "slice_missing_ids": (slice_missing_ids, "SELECT DISTINCT doc_id FROM (SELECT doc_id + 300 AS doc_id FROM labels) ANTI JOIN documents USING (doc_id)"),
    "duplicate_doc_ids": (duplicate_doc_ids, "SELECT doc_id // 2 AS doc_id, count(*) AS n FROM labels GROUP BY 1 HAVING count(*) > 1"),
    "expectation_gate": (
        expectation_gate,
        f"""WITH {V.MENTION}, a AS (SELECT 'n_docs' AS name, 1000::BIGINT AS expected, (SELECT count(DISTINCT doc_id) FROM v_sent) AS actual UNION ALL SELECT 'n_chains', 1, (SELECT count(*) FROM (SELECT DISTINCT doc_id, chain_id FROM v_mention))
        UNION ALL SELECT 'n_mentions', 2, (SELECT count(*) FROM v_mention)) SELECT *, expected = actual AS ok FROM a""",
    ),
    "alignment_check": (
        alignment_check,
        f"""WITH {V.TOK}, h AS (SELECT tok, {V.draw_sql("'a'", 'doc_id', 'sentence_id', 'token_id')} % 100 AS h FROM v_tok) SELECT 'missing_in_response' AS kind, count(*) FILTER (WHERE h = 0) AS n FROM h
        UNION ALL SELECT 'missing_in_gold', 0 UNION ALL SELECT 'text_differs', count(*) FILTER (WHERE h = 1 AND upper(tok) <> tok) FROM h""",
    ),
    "zero_key_symdiff": (zero_key_symdiff, f"WITH {ZERO_SQL} SELECT 'mention_map_only' AS kind, count(*) AS n FROM v_zero ANTI JOIN v_pred {_J} UNION ALL SELECT 'token_map_only', count(*) FROM (SELECT * FROM v_pred WHERE is_zero) ANTI JOIN v_zero {_J}"),
    "zero_detail": (zero_detail, f"WITH {ZERO_SQL} {_detail('v_pred')} SELECT * FROM v_detail"),
    "zero_coverage": (zero_coverage, f"WITH {ZERO_SQL} SELECT {_SP}, p.pred_id IS NOT NULL AS covered FROM v_zero LEFT JOIN v_pred p {_J}"),
    "zero_resolution": (zero_resolution, f"WITH {ZERO_SQL} {_detail('v_pred')} SELECT *, {RATES} FROM (SELECT {V.split_sql()} AS split, {RESOLUTION} FROM v_detail GROUP BY 1)"),
    "zero_pair_metrics": (
        zero_pair_metrics,
        f"""WITH {ZERO_SQL} {_detail('v_pred')} SELECT *, {_div('correct_pairs', 'pred_pairs')} AS precision, {_div('correct_pairs', 'gold_pairs')} AS recall, {_div('2 * correct_pairs', 'gold_pairs + pred_pairs')} AS f1
        FROM (SELECT {V.split_sql()} AS split, sum(gold_pairs)::BIGINT AS gold_pairs, sum(pred_pairs)::BIGINT AS pred_pairs, sum(correct_pairs)::BIGINT AS correct_pairs FROM v_detail GROUP BY 1)""",
    ),
    "zero_wrong_cluster": (zero_wrong_cluster, f"WITH {V.MENTION} {WRONG} SELECT * FROM v_wrong"),
    "zero_wrong_cluster_sanity": (
        zero_wrong_cluster_sanity,
        f"""WITH {ZERO_SQL} {WRONG} {_detail('v_same', 'v_a')} {_detail('v_wrong', 'v_b')}, t AS (SELECT 'gold' AS variant, {RESOLUTION} FROM v_a UNION ALL SELECT 'wrong_cluster', {RESOLUTION} FROM v_b)
        SELECT variant, gold_zero, covered, resolvable, correct_resolved, {_div('covered', 'gold_zero')} AS coverage, {_div('correct_resolved', 'resolvable')} AS recall FROM t""",
    ),
    "zero_normalized_eval": (
        zero_normalized_eval,
        f"WITH {ZERO_SQL} {SPANS} {_detail('v_strict', 'v_a')} {_detail('v_normal', 'v_b')}, t AS (SELECT 'strict' AS variant, {RESOLUTION} FROM v_a UNION ALL SELECT 'normalized', {RESOLUTION} FROM v_b) SELECT *, {RATES} FROM t",
    ),
    "zero_pairized_sanity": (
        zero_pairized_sanity,
        f"""WITH {ZERO_SQL} {_detail('v_same', 'v_b').replace(', v_b_g', f', v_same AS (SELECT {_SP}, chain_id AS pred_id FROM v_mention), v_b_g', 1)}
        SELECT 'strict' AS variant, (SELECT count(*) FROM v_zero) AS gold_zero, 0::BIGINT AS covered, 0::BIGINT AS correct_resolved UNION ALL SELECT 'normalized', count(*), count(*) FILTER (WHERE covered), count(*) FILTER (WHERE correct) FROM v_b""",
    ),
    "zero_anchor_diagnostic": (
        zero_anchor_diagnostic,
        f"""WITH {ZERO_SQL} {SPANS}, sz AS (SELECT doc_id, pred_id, count(*) AS size FROM v_span GROUP BY ALL), h AS (SELECT z.{_SP.replace(', ', ', z.')}, s.start, s.stop, s.pred_id, size FROM v_zero z
        JOIN v_span s ON s.doc_id = z.doc_id AND s.sentence_id = z.sentence_id AND s.start <= z.token_id AND s.stop >= z.token_id JOIN sz ON sz.doc_id = s.doc_id AND sz.pred_id = s.pred_id),
        a AS (SELECT {_SP}, bool_or(start = token_id AND stop = token_id) AS e, bool_or(start = token_id) AS s, bool_or(stop = token_id) AS t, bool_or(size > 1) AS m, count(DISTINCT pred_id) > 1 AS x FROM h GROUP BY ALL)
        SELECT (SELECT count(*) FROM v_zero) AS anchors, count(*) FILTER (WHERE e) AS exact, count(*) FILTER (WHERE s) AS starts, count(*) FILTER (WHERE t) AS ends, count(*) AS contained, count(*) FILTER (WHERE m) AS in_multi, count(*) FILTER (WHERE x) AS ambiguous FROM a""",
    ),
    "zero_span_lengths": (zero_span_lengths, f"WITH {ZERO_SQL} {SPANS} SELECT (stop - start + 1)::INT AS length, count(*) AS n FROM v_zero z JOIN v_span s ON s.doc_id = z.doc_id AND s.sentence_id = z.sentence_id AND start <= token_id AND stop >= token_id GROUP BY 1"),
    "literal_zero_audit": (
        literal_zero_audit,
        f"""WITH {AUDIT}, t AS (SELECT coalesce(n_prior, 0) AS n_prior, coalesce(ah, false) AS ah, coalesce(ch, false) AS ch, coalesce(size, 0) AS size, coalesce(nc, 0) AS nc FROM v_j LEFT JOIN v_own {_J} LEFT JOIN v_cs c ON c.doc_id = v_j.doc_id AND c.pred_id = v_j.pred_id),
        u AS (SELECT count(*) AS zeros, count(*) FILTER (WHERE n_prior > 0) AS with_prior, count(*) FILTER (WHERE ah) AS antecedent_hits, count(*) FILTER (WHERE ch) AS co_cluster_hits, count(*) FILTER (WHERE size = 1) AS singletons,
          count(*) FILTER (WHERE nc > 1) AS cross_chain, avg(size::DOUBLE) AS mean_pred_size FROM t)
        SELECT *, {_div('antecedent_hits', 'with_prior')} AS antecedent_rate, {_div('co_cluster_hits', 'zeros')} AS co_cluster_rate, {_div('singletons', 'zeros')} AS singleton_rate, {_div('cross_chain', 'zeros')} AS cross_chain_rate FROM u""",
    ),
    "muc_by_slice": (muc_by_slice, _prf(_muc)),
    "b3_by_slice": (b3_by_slice, _prf(_b3)),
    "blanc_by_slice": (blanc_by_slice, BLANC_SQL),
    "ceafe_by_slice": (ceafe_by_slice, None),
    "conll_f1_by_slice": (conll_f1_by_slice, None),
    "slice_scores": (slice_scores, _slice_sql()),
    "slice_conll_scores": (slice_conll_scores, None),
    "slice_problems": (slice_problems, PROBLEMS),
    "global_token_index": (global_token_index, f"WITH {V.TOK}, {GLOB} SELECT * FROM v_idx"),
    "sentence_starts": (sentence_starts, f"WITH {V.TOK}, {GLOB} SELECT doc_id, sentence_id, min(idx) AS start FROM v_idx GROUP BY ALL"),
}
