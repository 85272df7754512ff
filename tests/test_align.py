"""Alignment by hand and against a plain search."""

from pyspark.sql import functions as F

import __spark_entry__
from tessera.operators import align as A
from tessera.plans import views as V

DOC = (
    "doc_id int, sentences array<string>, chains array<struct<type: string, index: string, start_sentence: string, end_sentence: string, "
    "mentions: array<struct<sentence_id: string, role: string, text: string, antecedent: string, anaphor: string>>, trigger: struct<sentence_id: string, text: string>>>"
)


def test_find_span_by_hand(spark):
    none, used = "array<struct<s:int,e:int>>", [(0, 3)]
    s = "该项目推进,项目验收"
    rows = [(s, "该项目", []), (s, "项目", used), (s, "这项目", used), (s, "项目", [(0, 3), (6, 8)]), ("", "x", []), (s, "", []), (None, "x", [])]
    got = spark.createDataFrame(rows, f"sent string, m string, used {none}").select(A.find_span(F.col("sent"), F.col("m"), F.col("used")).alias("x")).collect()
    assert [tuple(r.x) if r.x else None for r in got] == [(0, 3), (6, 8), (7, 8), None, None, None, None]


def chain(kind, mentions, trigger=None, index=None):
    return (kind, index, None, None, mentions, trigger)


def test_documents(spark):
    m = lambda sid, text=None, role=None, ante=None, ana=None: (str(sid), role, text, ante, ana)
    s = ["aa bb aa", "bb cc", "cc aa"]
    ok = [chain("x", [m(1, "aa ", "antecedent"), m(1, ana="aa")]), chain("事件指代", [m(1, ante="bb"), m(2, ana="bb")], ("2", "cc"), "7")]
    lost = [chain("x", [m(1, ante="aa"), m(1, ana="aa"), m(1, ana="aa")])]
    short, odd, far = [chain("x", [m(1, ante="aa")])], [chain("x", [m(1, ante="aa"), m(1, "aa", "other")])], [chain("x", [m(1, ante="aa"), m(4, ana="aa")])]
    no_trigger = [chain("事件指代", [m(1, ante="bb"), m(2, ana="bb")])]
    docs = spark.createDataFrame([(i, s, c) for i, c in enumerate([ok, lost, short, odd, far, no_trigger, None])], DOC)
    out = {r.doc_id: r.chains for r in A.add_char_spans(docs, (1, 5), 1, inclusive=True, triggers=True).collect()}
    assert set(out) == {0}
    first, second = out[0]
    assert [(x.sentence_id, x.role, x.text, x.char_start, x.char_end) for x in first.mentions] == [(1, "antecedent", "aa", 0, 1), (1, "anaphor", "aa", 6, 7)]
    assert (first["index"], first.start_sentence, first.end_sentence, first.trigger) == (1, 1, 1, None)
    assert (second["index"], second.end_sentence, tuple(second.trigger)) == (7, 2, (2, "cc", 3, 4))
    assert {r.doc_id for r in A.add_char_spans(docs, (1, 5), 1).collect()} == {0, 5}
    assert A.add_char_spans(docs, (5, 7), 3).count() == 0


def test_query_against_a_plain_search(spark):
    d = "/root/testdata/sf0.001"
    sents = {(r.doc_id, r.sentence_id): r.sent for r in V.sentences(spark, d).collect()}
    used, want = {}, {}
    for r in sorted(V.mentions(spark, d).collect(), key=lambda r: (r.doc_id, r.chain_id, r.sentence_id, r.token_id)):
        taken, sent, at = used.setdefault((r.doc_id, r.sentence_id), []), sents[r.doc_id, r.sentence_id], -1
        while (at := sent.find(r.tok, at + 1)) >= 0 and any(at < e and b < at + len(r.tok) for b, e in taken):
            pass
        taken.append((at, at + len(r.tok)))
        want[r.doc_id, r.sentence_id, r.token_id] = at if at >= 0 else None
    got = {(r.doc_id, r.sentence_id, r.token_id): r.char_start for r in __spark_entry__.queries()["mention_alignment"](spark, d).collect()}
    assert got == want and len(got) > 100
