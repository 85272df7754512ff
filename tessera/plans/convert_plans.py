"""Conversion to token tables, corrections and events over the derived mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import clusters as C
from tessera.operators import convert as K
from tessera.operators import events as E
from tessera.operators import mutate as U
from tessera.operators import typemap as Y
from tessera.operators.pairs import meeting_in_cells
from tessera.plans import views as V
from tessera.plans.corpus_plans import CHAINS, GLOB, chain_derived_type, global_token_index, sentence_starts
from tessera.schemas import EVENT_MENTION
from tessera.scratch import materialize, shuffles_dropped


def raw_mentions(s, d, sents=None) -> DataFrame:
    """The derived mentions as annotations with character offsets, some of them wrong: sentence numbers of 0 and beyond the end, offsets that are off or missing."""
    h = V.draw(F.lit("r"), "doc_id", "sentence_id", "token_id") % 40
    m = V.mentions(s, d).join(V.sentences(s, d) if sents is None else sents, ["doc_id", "sentence_id"])
    at = F.expr("locate(tok, sent) - 1") + F.when(h == 1, 1).otherwise(0)
    text = F.when(F.col("is_zero"), "Ø").otherwise(F.col("tok"))
    return m.select(
        "doc_id", "split", F.col("chain_id").alias("chain_pos"), F.col("chain_id").alias("chain_index"), F.col("mention_type").alias("chain_type"),
        (F.row_number().over(Window.partitionBy("doc_id", "chain_id").orderBy("sentence_id", "token_id")) - 1).alias("mpos"),
        F.when(h == 2, 0).when(h == 3, 99999).otherwise(F.col("sentence_id")).cast("string").alias("sentence_id"),
        text.alias("text"), F.when(h == 4, F.lit(None)).otherwise(at).cast("string").alias("char_start"), (at + F.length("tok") - 1).cast("string").alias("char_end"),
        F.lit("anaphor").alias("role"), "mention_type", F.col("semantics").alias("referent_semantics"),
    ).withColumn("chain_type", F.first("chain_type").over(Window.partitionBy("doc_id", "chain_pos").orderBy("mpos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def _placed(s, d):
    return K.place_mentions(V.sentences(s, d), raw_mentions(s, d))


def token_insert(s, d):
    return K.token_map(V.sentences(s, d), _placed(s, d)).groupBy("mode", "doc_id", "sentence_id").agg(
        F.count("*").alias("n_tokens"), F.sum("is_zero_token").alias("n_zeros"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_id", "token_text"))), lambda x: x["token_text"]), " ").cast("binary")).alias("tokens_md5")
    )


def _mention_map(s, d):
    placed = materialize(_placed(s, d), "placed")
    return materialize(K.mention_map(placed), "mentions")


def span_to_token(s, d):
    return _mention_map(s, d).select("mode", "doc_id", "mention_id", "sentence_id", "token_start", "token_end", "is_exported", "drop_reason")


def singleton_drop(s, d):
    return K.chain_map(_mention_map(s, d)).select("mode", "doc_id", "conll_chain_id", "original_chain_index", "n_mentions_original", "n_mentions_exported", "dropped", "drop_reason")


def type_slice_map(s, d):
    m = _mention_map(s, d)
    docs = V.table(s, d, "documents").select("doc_id", F.col("lang").alias("domain"), F.col("source").alias("category_primary"))
    return K.type_slice_map(m, K.chain_map(m), docs).select("mode", "doc_id", "domain", "category_primary", "conll_chain_id", "chain_type", "mention_id", "sentence_id", "token_start", "token_end")


def conversion_issues(s, d):
    m = _mention_map(s, d)
    return K.issues(m, K.chain_map(m)).groupBy("severity", "mode", "error_type").agg(F.count("*").alias("n"))


def conversion_summary(s, d):
    m = _mention_map(s, d)
    return K.summary(m, K.chain_map(m))


def conll_lines(s, d):
    # texts are dealt by document once and their mentions meet them there
    with meeting_in_cells(s), shuffles_dropped(s):
        sents = V.sentences(s, d, dealt=True)
        placed = materialize(K.place_mentions(sents, raw_mentions(s, d, sents)), "placed")
        m = materialize(K.mention_map(placed.repartition("doc_id")), "mentions")
        ids = K.chain_map(m).select("mode", "doc_id", "chain_pos", "conll_chain_id")
        spans = m.where("is_exported").join(ids, ["mode", "doc_id", "chain_pos"]).select(
            F.struct("mode", "doc_id").alias("doc_id"), "sentence_id", F.col("token_start").alias("start"), F.col("token_end").alias("end"), F.col("conll_chain_id").alias("cid")
        )
        marks = C.coref_markers(spans).select(F.col("doc_id.mode").alias("mode"), F.col("doc_id.doc_id").alias("doc_id"), "sentence_id", "token_id", "coref")
        marks = materialize(marks, "marks")
    return K.conll_lines_of(V.sentences(s, d), placed, marks)


def zero_char_removal(s, d):
    """Take the first character of every mention of a drawn sentence's first zero out of it."""
    m = V.mentions(s, d).join(V.sentences(s, d), ["doc_id", "sentence_id"]).withColumn("char_start", F.expr("locate(tok, sent) - 1")).withColumn("char_end", F.expr("char_start + length(tok) - 1"))
    gone = m.where("is_zero").groupBy("doc_id", "sentence_id").agg(F.min("char_start").alias("pos"))
    sents, left = U.remove_chars(V.sentences(s, d), m.select("doc_id", "sentence_id", "token_id", "char_start", "char_end"), gone)
    return left.join(sents, ["doc_id", "sentence_id"]).select("doc_id", "sentence_id", "token_id", "char_start", "char_end", F.md5(F.col("sent").cast("binary")).alias("sentence_md5"))


def relabel_chain(s, d):
    m = V.mentions(s, d).withColumn("text", F.when(F.col("is_zero"), "Ø").otherwise(F.col("tok")))
    hit = m.where(V.draw(F.lit("x"), "doc_id", "chain_id") % 5 == 0).select("doc_id", "chain_id")
    return U.relabel_chains(m, hit).select("doc_id", "sentence_id", "token_id", "mention_type", "semantics")


def rederive_labels(s, d):
    m = V.mentions(s, d)
    return U.rederive(m, m.where(V.draw(F.lit("x"), "doc_id") % 5 == 0))[0]


def _events(s, d) -> DataFrame:
    """Events of one type as mentions in their user's document: start in seconds, trigger the type."""
    return V.table(s, d, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id"), (F.unix_timestamp("ts") % 3600).cast("int").alias("start"), F.col("event_type").alias("trigger"), (F.col("event_id") % 7).alias("cluster"), V.split_of("user_id").alias("split")
    )


def event_conflicts(s, d):
    return E.conflicts(_events(s, d))


def event_removed(s, d):
    e = _events(s, d).withColumn("event_id", F.col("event_id").cast("string"))
    return e.join(E.drop_conflicts(e), ["doc_id", "event_id"], "left_anti").select("doc_id", "event_id")


def event_cluster_membership(s, d):
    e = _events(s, d)
    return E.membership(e.select("doc_id", "event_id"), e.where("event_id % 11 <> 0").select("doc_id", "event_id", "cluster"))


def event_pair_stats(s, d):
    return E.pair_stats(_events(s, d), ["split"])


def event_pred_offsets(s, d):
    return E.prediction_offsets(_events(s, d).groupBy("split", "doc_id").agg(F.count("*").alias("n")), ["split"])


def event_filter_summary(s, d):
    e = _events(s, d).withColumn("event_id", F.col("event_id").cast("string"))
    return E.filter_summary(e, e.join(E.drop_conflicts(e), ["doc_id", "event_id"], "left_semi"), ["split"])


def _event_pairs(s, d) -> DataFrame:
    """Each event with the next three of its document, and a drawn probability."""
    w = Window.partitionBy("doc_id").orderBy("event_id")
    near = F.array(*(F.lead("event_id", k).over(w) for k in (1, 2, 3)))
    pairs = _events(s, d).select("doc_id", F.col("event_id").alias("a"), near.alias("near")).select("doc_id", "a", F.explode("near").alias("b")).where("b IS NOT NULL")
    return pairs.withColumn("p", V.draw("a", "b") % 1000 / F.lit(1000.0))


def event_components(s, d):
    return E.greedy_clusters(_event_pairs(s, d), 0.7)


def event_greedy_clusters(s, d):
    return E.greedy_clusters(_event_pairs(s, d), 0.5, 0.2)


def _type_map(s, d) -> DataFrame:
    """A type map of the mentions: some tokens don't exist, some spans have a second type, some rows stand twice."""
    m = V.mentions(s, d).select(
        "doc_id", "sentence_id", F.col("token_id").alias("token_start"), F.col("token_id").alias("token_end"), F.concat_ws(":", "doc_id", "sentence_id", "token_id").alias("mention_id"), "mention_type", "chain_id"
    ).withColumn("h", V.draw(F.lit("t"), "mention_id"))
    off = m.withColumn("token_end", F.when(F.col("h") % 97 == 0, F.col("token_end") + 10000).otherwise(F.col("token_end")))
    second = m.where("h % 53 = 0").withColumn("mention_id", F.concat("mention_id", F.lit("b"))).withColumn("mention_type", F.lit("other"))
    return off.unionByName(second).unionByName(off.where("h % 59 = 0")).drop("h")


def span_types(s, d):
    return Y.span_types(Y.with_global_spans(_type_map(s, d), global_token_index(s, d)), "chain_id")


def span_problems(s, d):
    return Y.span_problems(Y.with_global_spans(_type_map(s, d), global_token_index(s, d)))


def event_span_problems(s, d):
    """Event mentions and some others against the type map; some have an unknown id, some stand in another document."""
    m = V.mentions(s, d).withColumn("event_id", F.concat_ws(":", "doc_id", "sentence_id", "token_id")).withColumn("h", V.draw(F.lit("e"), "event_id"))
    events = m.where((F.col("mention_type") == EVENT_MENTION) | (F.col("h") % 29 == 0)).select(
        F.when(F.col("h") % 31 == 0, F.concat("event_id", F.lit("x"))).otherwise(F.col("event_id")).alias("event_id"), F.when(F.col("h") % 37 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("doc_id")
    )
    return Y.event_spans(events, Y.by_sentence_start(_type_map(s, d), sentence_starts(s, d)), EVENT_MENTION)


_EV = f"""ev AS (SELECT user_id AS doc_id, event_id, (floor(epoch(ts))::BIGINT % 3600)::INT AS start, event_type AS trigger, event_id % 7 AS cluster, {V.split_sql('user_id')} AS split FROM events)"""
#: Events in order, and the greedy choice of those that begin where the last kept one has ended.
_KEPT = f"""{_EV}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, event_id::VARCHAR) AS k FROM ev),
gr AS (SELECT doc_id, k, start + length(trigger) AS ends, event_id, true AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.k, CASE WHEN o.start >= gr.ends THEN o.start + length(o.trigger) ELSE gr.ends END, o.event_id, o.start >= gr.ends FROM gr JOIN o ON o.doc_id = gr.doc_id AND o.k = gr.k + 1),
af AS (SELECT ev.* FROM ev JOIN gr USING (doc_id, event_id) WHERE kept)"""
_PAIRS = f"""{_EV}, pr AS (SELECT doc_id, event_id AS a, unnest([lead(event_id, 1) OVER w, lead(event_id, 2) OVER w, lead(event_id, 3) OVER w]) AS b FROM ev WINDOW w AS (PARTITION BY doc_id ORDER BY event_id)),
ed AS MATERIALIZED (SELECT doc_id, a::VARCHAR AS a, b::VARCHAR AS b FROM pr WHERE b IS NOT NULL AND {V.draw_sql('a', 'b')} % 1000 / 1000.0::DOUBLE >= 0.7)"""
TYPES = V.MENTION + f""", {GLOB},
v_tm0 AS (SELECT doc_id, sentence_id, token_id AS token_start, token_id AS token_end, concat_ws(':', doc_id, sentence_id, token_id) AS mention_id, mention_type, chain_id FROM v_mention),
v_tm1 AS (SELECT *, {V.draw_sql("'t'", 'mention_id')} AS h FROM v_tm0),
v_tm AS (SELECT doc_id, sentence_id, token_start, CASE WHEN h % 97 = 0 THEN token_end + 10000 ELSE token_end END AS token_end, mention_id, mention_type, chain_id FROM v_tm1
  UNION ALL SELECT doc_id, sentence_id, token_start, token_end, mention_id || 'b', 'other', chain_id FROM v_tm1 WHERE h % 53 = 0
  UNION ALL SELECT doc_id, sentence_id, token_start, CASE WHEN h % 97 = 0 THEN token_end + 10000 ELSE token_end END, mention_id, mention_type, chain_id FROM v_tm1 WHERE h % 59 = 0),
v_gl AS (SELECT t.*, a.idx AS g_start, b.idx AS g_end FROM v_tm t LEFT JOIN v_idx a ON a.doc_id = t.doc_id AND a.sentence_id = t.sentence_id AND a.token_id = t.token_start
  LEFT JOIN v_idx b ON b.doc_id = t.doc_id AND b.sentence_id = t.sentence_id AND b.token_id = t.token_end),
v_sp AS (SELECT doc_id, g_start, g_end, count(DISTINCT mention_type) AS n, arg_max(mention_type, mention_id) AS mention_type, arg_max(chain_id, mention_id) AS chain_id FROM v_gl WHERE g_start IS NOT NULL AND g_end IS NOT NULL GROUP BY ALL)"""
WS = r"[\t-\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_N = "(SELECT doc_id, count(*) AS ns FROM v_sent GROUP BY doc_id)"
PLACED = V.MENTION + f""",
v_raw AS (SELECT m.*, {V.draw_sql("'r'", 'm.doc_id', 'm.sentence_id', 'm.token_id')} % 40 AS h, strpos(sent, tok) - 1 AS at0, row_number() OVER (PARTITION BY m.doc_id, chain_id ORDER BY m.sentence_id, m.token_id) AS mp,
  first_value(mention_type) OVER (PARTITION BY m.doc_id, chain_id ORDER BY m.sentence_id, m.token_id) AS chain_type FROM v_mention m JOIN v_sent s ON s.doc_id = m.doc_id AND s.sentence_id = m.sentence_id),
v_pl AS (SELECT doc_id, chain_id, chain_type, mp, tok, is_zero, split, h, 'x' AS x, doc_id || '_c' || chain_id || '_m' || mp AS mention_id,
  CASE WHEN h = 2 THEN 1 WHEN h = 3 THEN NULL ELSE sentence_id END AS sid, CASE WHEN h = 4 THEN NULL WHEN h = 1 THEN at0 + 1 ELSE at0 END AS cs, CASE WHEN h = 1 THEN at0 + 1 ELSE at0 END + length(tok) - 1 AS ce FROM v_raw),
v_char AS (SELECT doc_id, sentence_id, i - 1 AS pos, substring(sent, i, 1) AS c FROM (SELECT doc_id, sentence_id, sent, unnest(range(1, length(sent) + 1)) AS i FROM v_sent) WHERE NOT regexp_matches(substring(sent, i, 1), '{WS}')),
v_z AS (SELECT p.doc_id, p.sid AS sentence_id, greatest(0, least(coalesce(cs, 0), length(sent))) AS pos, chain_id, mp, mention_id FROM v_pl p JOIN v_sent s ON s.doc_id = p.doc_id AND s.sentence_id = p.sid WHERE is_zero),
v_both AS (SELECT 'with_zero' AS mode, doc_id, sentence_id, pos, 1 AS rank, 0 AS chain_id, 0 AS mp, c, '' AS mention_id FROM v_char UNION ALL SELECT 'surface_only', doc_id, sentence_id, pos, 1, 0, 0, c, '' FROM v_char
  UNION ALL SELECT 'with_zero', doc_id, sentence_id, pos, 0, chain_id, mp, 'Ø', mention_id FROM v_z),
v_t AS (SELECT *, row_number() OVER (PARTITION BY mode, doc_id, sentence_id ORDER BY pos, rank, chain_id, mp, mention_id) - 1 AS token_id FROM v_both),
v_mm AS (
  SELECT m.mode, p.*, CASE WHEN is_zero THEN (z.token_id) ELSE a.ts END AS ts, CASE WHEN is_zero THEN z.token_id ELSE a.te END AS te,
    CASE WHEN sid IS NULL THEN 'bad_sentence_id' WHEN is_zero AND m.mode = 'surface_only' THEN 'surface_only_drop_zero' WHEN is_zero AND z.token_id IS NULL THEN 'zero_token_not_found' WHEN is_zero THEN ''
      WHEN cs IS NULL THEN 'bad_char_offset' WHEN cs < 0 OR ce >= length(sent) OR substring(sent, cs + 1, length(tok)) <> tok THEN 'offset_text_mismatch' WHEN a.ts IS NULL THEN 'char_span_to_token_failed' ELSE '' END AS own
  FROM v_pl p CROSS JOIN (VALUES ('with_zero'), ('surface_only')) m(mode) LEFT JOIN v_sent s ON s.doc_id = p.doc_id AND s.sentence_id = p.sid
    LEFT JOIN v_t z ON z.mode = m.mode AND z.doc_id = p.doc_id AND z.mention_id = p.mention_id AND z.rank = 0
    LEFT JOIN (SELECT q.mention_id, q.doc_id, t.mode, min(t.token_id) AS ts, max(t.token_id) AS te FROM v_pl q JOIN v_t t ON t.doc_id = q.doc_id AND t.sentence_id = q.sid AND t.rank = 1 AND t.pos BETWEEN q.cs AND q.ce WHERE NOT q.is_zero GROUP BY ALL) a
      ON a.mode = m.mode AND a.doc_id = p.doc_id AND a.mention_id = p.mention_id),
v_map AS (SELECT *, CASE WHEN own = '' AND count(*) FILTER (WHERE own = '') OVER (PARTITION BY mode, doc_id, chain_id) < 2 THEN 'singleton_after_filter' ELSE own END AS drop_reason FROM v_mm),
v_cm0 AS (SELECT mode, doc_id, split, chain_id, chain_type, count(*) AS n0, count(*) FILTER (WHERE drop_reason = '') AS n1 FROM v_map GROUP BY ALL),
v_cm AS (SELECT *, n1 < 2 AS dropped, CASE WHEN n1 >= 2 THEN row_number() OVER (PARTITION BY mode, doc_id, n1 < 2 ORDER BY chain_id) END::INT AS cid FROM v_cm0)"""

PLANS = {
    "zero_token_insert": (token_insert, f"WITH {PLACED} SELECT mode, doc_id, sentence_id, count(*) AS n_tokens, sum(1 - rank)::BIGINT AS n_zeros, md5(string_agg(c, ' ' ORDER BY token_id)) AS tokens_md5 FROM v_t GROUP BY ALL"),
    "span_to_token": (span_to_token, f"WITH {PLACED} SELECT mode, doc_id, mention_id, CASE WHEN own = '' THEN sid END::INT AS sentence_id, CASE WHEN own = '' THEN ts END::INT AS token_start, CASE WHEN own = '' THEN te END::INT AS token_end, drop_reason = '' AS is_exported, drop_reason FROM v_map"),
    "singleton_drop": (singleton_drop, f"WITH {PLACED} SELECT mode, doc_id, cid AS conll_chain_id, chain_id AS original_chain_index, n0 AS n_mentions_original, n1 AS n_mentions_exported, dropped, CASE WHEN dropped THEN 'singleton_after_filter' ELSE '' END AS drop_reason FROM v_cm"),
    "type_slice_map": (
        type_slice_map,
        f"""WITH {PLACED} SELECT mode, doc_id, lang AS domain, source AS category_primary, cid AS conll_chain_id, v_map.chain_type, mention_id, sid::INT AS sentence_id, ts::INT AS token_start, te::INT AS token_end
        FROM v_map JOIN v_cm USING (mode, doc_id, chain_id) JOIN documents USING (doc_id) WHERE v_map.drop_reason = ''""",
    ),
    "conversion_issues": (
        conversion_issues,
        f"""WITH {PLACED} SELECT 'ERROR' AS severity, mode, drop_reason AS error_type, count(*) AS n FROM v_map WHERE drop_reason IN ('zero_token_not_found', 'bad_char_offset', 'offset_text_mismatch', 'char_span_to_token_failed') GROUP BY ALL
        UNION ALL SELECT 'WARN', mode, CASE h WHEN 2 THEN 'sentence_id_zero_based' ELSE 'sentence_id_out_of_range' END, count(*) FROM v_map WHERE h IN (2, 3) GROUP BY ALL UNION ALL SELECT 'WARN', mode, 'drop_singleton_chain', count(*) FROM v_cm WHERE dropped GROUP BY ALL""",
    ),
    "conversion_summary": (
        conversion_summary,
        f"""WITH {PLACED}, a AS (SELECT mode, split, count(*) AS chains, count(*) FILTER (WHERE NOT dropped) AS chains_exported FROM v_cm GROUP BY ALL),
        b AS (SELECT mode, split, count(*) AS mentions, count(*) FILTER (WHERE drop_reason = '') AS mentions_exported, count(*) FILTER (WHERE drop_reason = '' AND is_zero) AS zeros_exported FROM v_map GROUP BY ALL) SELECT * FROM a JOIN b USING (mode, split)""",
    ),
    "conll_lines": (
        lambda s, d: V.digest(conll_lines(s, d), "mode", "sentence_id", "token_id", "line"),
        f"WITH {PLACED}, v_x AS (SELECT mode, doc_id, sid AS sentence_id, ts, te, cid FROM v_map JOIN v_cm USING (mode, doc_id, chain_id) WHERE v_map.drop_reason = ''), "
        "v_at AS (SELECT mode, doc_id, sentence_id, ts AS token_id, 0 AS k, -te AS o, cid, '(' || cid AS atom FROM v_x WHERE ts < te UNION ALL SELECT mode, doc_id, sentence_id, ts, 1, 0, cid, '(' || cid || ')' FROM v_x WHERE ts >= te "
        "UNION ALL SELECT mode, doc_id, sentence_id, te, 2, -ts, cid, cid || ')' FROM v_x WHERE ts < te), "
        "v_mk AS (SELECT mode, doc_id, sentence_id, token_id, string_agg(atom, '|' ORDER BY k, o, cid, atom) AS coref FROM v_at GROUP BY ALL) "
        + V.digest_sql(
            "SELECT mode, doc_id, sentence_id, token_id, concat_ws(' ', doc_id::VARCHAR, '000', token_id::VARCHAR, c, '- * - - - - *', coalesce(coref, '-')) AS line FROM v_t LEFT JOIN v_mk USING (mode, doc_id, sentence_id, token_id)",
            "mode", "sentence_id", "token_id", "line",
        ),
    ),
    "zero_char_removal": (
        zero_char_removal,
        f"""WITH {V.MENTION}, m AS (SELECT m.*, sent, strpos(sent, tok) - 1 AS cs, strpos(sent, tok) + length(tok) - 2 AS ce FROM v_mention m JOIN v_sent USING (doc_id, sentence_id)),
        g AS (SELECT doc_id, sentence_id, min(cs) AS pos FROM m WHERE is_zero GROUP BY ALL)
        SELECT doc_id, sentence_id, token_id, (cs - CASE WHEN cs > pos THEN 1 ELSE 0 END)::INT AS char_start, (ce - CASE WHEN ce >= pos THEN 1 ELSE 0 END)::INT AS char_end,
          md5(CASE WHEN pos IS NULL THEN sent ELSE substring(sent, 1, pos) || substring(sent, pos + 2) END) AS sentence_md5 FROM m LEFT JOIN g USING (doc_id, sentence_id) WHERE pos IS NULL OR NOT (cs = pos AND ce = pos)""",
    ),
    "relabel_chain": (
        relabel_chain,
        f"""WITH {V.MENTION}, m AS (SELECT *, {V.draw_sql("'x'", 'doc_id', 'chain_id')} % 5 = 0 AS hit FROM v_mention)
        SELECT doc_id, sentence_id, token_id, CASE WHEN NOT hit THEN mention_type WHEN is_zero THEN '零指代' ELSE '有定描述' END AS mention_type, CASE WHEN hit THEN 'ENTITY' ELSE semantics END AS semantics FROM m""",
    ),
    "rederive_labels": (rederive_labels, f"WITH {CHAINS} SELECT * FROM v_chain WHERE {V.draw_sql(chr(39) + 'x' + chr(39), 'doc_id')} % 5 = 0"),
    "event_conflicts": (
        event_conflicts,
        f"""WITH {_EV}, n AS (SELECT *, lead(event_id) OVER w AS next_id, lead(start) OVER w AS ns, lead(trigger) OVER w AS nt FROM ev WINDOW w AS (PARTITION BY doc_id ORDER BY start, event_id))
        SELECT doc_id, event_id, next_id, CASE WHEN start = ns AND trigger = nt THEN 'SAME' ELSE 'OVERLAP' END AS kind FROM n WHERE next_id IS NOT NULL AND ((start = ns AND trigger = nt) OR start + length(trigger) > ns)""",
    ),
    "event_removed": (event_removed, f"WITH RECURSIVE {_KEPT} SELECT doc_id, event_id::VARCHAR AS event_id FROM gr WHERE NOT kept"),
    "event_components": (
        event_components,
        f"""WITH RECURSIVE {_PAIRS}, nb AS (SELECT doc_id, a, b FROM ed UNION SELECT doc_id, b, a FROM ed),
        rc AS (SELECT DISTINCT doc_id, a AS event_id, a AS c FROM nb UNION SELECT rc.doc_id, rc.event_id, nb.b FROM rc JOIN nb ON nb.doc_id = rc.doc_id AND nb.a = rc.c)
        SELECT doc_id, event_id, min(c) AS cluster FROM rc GROUP BY doc_id, event_id""",
    ),
    "event_greedy_clusters": (event_greedy_clusters, None),
    "span_types": (span_types, f"WITH {TYPES} SELECT doc_id, g_start, g_end, mention_type, chain_id FROM v_sp WHERE n = 1"),
    "span_problems": (
        span_problems,
        f"""WITH {TYPES} SELECT doc_id, mention_id, 'unaligned' AS problem FROM v_gl WHERE g_start IS NULL OR g_end IS NULL
        UNION ALL SELECT doc_id, mention_id, 'conflicting_type' FROM v_gl JOIN v_sp USING (doc_id, g_start, g_end) WHERE n > 1
        UNION ALL SELECT doc_id, mention_id, 'repeated_mention_id' FROM v_tm GROUP BY ALL HAVING count(*) > 1""",
    ),
    "event_span_problems": (
        event_span_problems,
        f"""WITH {TYPES}, e0 AS (SELECT *, concat_ws(':', doc_id, sentence_id, token_id) AS id FROM v_mention), e1 AS (SELECT *, {V.draw_sql("'e'", 'id')} AS h FROM e0),
        e AS (SELECT CASE WHEN h % 31 = 0 THEN id || 'x' ELSE id END AS event_id, CASE WHEN h % 37 = 0 THEN doc_id + 1 ELSE doc_id END AS doc_id FROM e1 WHERE mention_type = '{EVENT_MENTION}' OR h % 29 = 0),
        st AS (SELECT doc_id, sentence_id, min(idx) AS start FROM v_idx GROUP BY ALL),
        m AS (SELECT DISTINCT doc_id, mention_id, start + token_start AS g_start, start + token_end AS g_end, mention_type FROM v_tm JOIN st USING (doc_id, sentence_id))
        SELECT event_id, e.doc_id, g_start, g_end, CASE WHEN m.doc_id IS NULL THEN 'not_in_type_map' WHEN m.doc_id <> e.doc_id THEN 'doc_mismatch' WHEN mention_type <> '{EVENT_MENTION}' THEN 'not_an_event_mention' END AS problem
        FROM e LEFT JOIN m ON m.mention_id = e.event_id""",
    ),
    "event_cluster_membership": (event_cluster_membership, f"WITH {_EV} SELECT doc_id, event_id, CASE WHEN event_id % 11 = 0 THEN 'singleton_' || event_id ELSE cluster::VARCHAR END AS cluster, CASE WHEN event_id % 11 = 0 THEN 'singleton' ELSE 'ok' END AS status FROM ev"),
    "event_pair_stats": (
        event_pair_stats,
        f"""WITH {_EV}, c AS (SELECT split, doc_id, cluster, count(*) AS c FROM ev GROUP BY ALL), d AS (SELECT split, doc_id, sum(c)::BIGINT AS n, count(*) AS k, sum(c * (c - 1) // 2)::BIGINT AS p FROM c GROUP BY ALL)
        SELECT split, count(*) AS n_docs, sum(n)::BIGINT AS n_events, sum(k)::BIGINT AS n_clusters, sum(n * (n - 1) // 2)::BIGINT AS n_pairs, sum(p)::BIGINT AS n_positive, (sum(n * (n - 1) // 2) - sum(p))::BIGINT AS n_negative FROM d GROUP BY split""",
    ),
    "event_pred_offsets": (
        event_pred_offsets,
        f"""WITH {_EV}, d AS (SELECT split, doc_id, count(*) AS n FROM ev GROUP BY ALL) SELECT *, n * (n - 1) // 2 AS size,
        coalesce(sum(n * (n - 1) // 2) OVER (PARTITION BY split ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM d""",
    ),
    "event_filter_summary": (
        event_filter_summary,
        f"""WITH RECURSIVE {_KEPT}, n AS (SELECT *, lead(start) OVER w AS ns, lead(event_id) OVER w AS ni FROM af WINDOW w AS (PARTITION BY doc_id ORDER BY start, event_id::VARCHAR)),
        a AS (SELECT split, count(*) AS raw_events FROM ev GROUP BY split), b AS (SELECT split, count(*) AS f FROM af GROUP BY split), c AS (SELECT split, count(*) AS r FROM n WHERE ni IS NOT NULL AND start + length(trigger) > ns GROUP BY split)
        SELECT split, raw_events, coalesce(f, 0) AS filtered_events, raw_events - coalesce(f, 0) AS removed, coalesce(r, 0) AS remaining_conflicts FROM a LEFT JOIN b USING (split) LEFT JOIN c USING (split)""",
    ),
}
