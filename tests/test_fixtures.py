"""Hand-computed cases."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import clusters as C
from tessera.operators import convert as K
from tessera.operators import corpus as O
from tessera.operators import dedup as D
from tessera.operators import events as E
from tessera.operators import generate as G
from tessera.operators import metrics as M
from tessera.operators import pairs as P
from tessera.sinks import files as W
from tessera.sources import conll as L
from tessera.sources import corpus as R
from tessera.streaming import generation as ST


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def conversion(spark):
    docs = spark.createDataFrame(
        [("D1", "test", "王明提交报告。Ø随后离开。他很满意。", ["王明提交报告。", "Ø随后离开。", "他很满意。"], [("零指代", 1, [("1", "王明", "0", "1", "人称代词"), ("2", "Ø", "0", "0", "零指代"), ("3", "他", "0", "0", "人称代词")])])],
        "doc_id string, split string, text string, sentences array<string>, coreference_chains array<struct<type: string, index: int, mentions: array<struct<sentence_id: string, text: string, char_start: string, char_end: string, mention_type: string>>>>",
    )
    s, m = K.flatten_corpus(docs)
    placed = K.place_mentions(s, m.withColumn("referent_semantics", F.lit("ENTITY")))
    tokens = K.token_map(s, placed)
    return s, placed, tokens, K.mention_map(placed)


def test_fx1_conversion(spark):
    s, placed, tokens, mm = conversion(spark)
    second = tokens.where("mode = 'with_zero' AND sentence_id = 2").orderBy("token_id").collect()
    assert "".join(x.token_text for x in second) == "ØØ随后离开。" and [x.is_zero_token for x in second][:2] == [1, 0]
    spans = {x.text: (x.token_start, x.token_end) for x in mm.where("mode = 'with_zero'").collect()}
    assert spans == {"王明": (0, 1), "Ø": (0, 0), "他": (0, 0)}
    surface = mm.where("mode = 'surface_only'").collect()
    assert {x.text: x.drop_reason for x in surface} == {"王明": "", "Ø": "surface_only_drop_zero", "他": ""}
    alone = K.mention_map(placed.where("text <> '他'"))
    gone = K.chain_map(alone).where("mode = 'surface_only'").first()
    assert gone.dropped and gone.drop_reason == "singleton_after_filter" and gone.conll_chain_id is None


def test_fx1_file_round_trip(spark, tmp_path):
    s, placed, tokens, mm = conversion(spark)
    spans = mm.where("mode = 'with_zero' AND is_exported").select("doc_id", "sentence_id", F.col("token_start").alias("start"), F.col("token_end").alias("end"), F.lit(1).alias("cid"))
    marks = C.coref_markers(spans).withColumn("mode", F.lit("with_zero"))
    lines = W.conll_document_lines(K.conll_lines(tokens.where("mode = 'with_zero'"), marks))
    W.write_lines(lines.coalesce(1), f"{tmp_path}/c", ["doc_id", "sentence_id", "token_id"])
    read = spark.createDataFrame([(i, x.value) for i, x in enumerate(spark.read.text(f"{tmp_path}/c").collect())], "line_no int, line string").withColumn("path", F.lit("p"))
    assert {x.kind: x.n for x in L.block_gates(read).collect()} == {"nested": 0, "unclosed": 0, "outside": 0, "short_line": 0, "duplicate_document": 0}
    toks = L.tokens(L.blocks(read))
    assert toks.count() == 7 + 7 + 5 and {x.coref for x in toks.collect()} == {"-", "(1", "1)", "(1)"}
    assert sorted((x.start, x.end) for x in L.mentions(toks).collect()) == [(0, 1), (7, 7), (14, 14)]
    assert {x.n for x in L.mention_gates(L.mentions(toks)).collect()} == {0}
    zero = L.tokens(L.blocks(read), "token_zero")
    assert [x.sentence_id for x in zero.orderBy("idx").collect()] == [x.sentence_id for x in toks.orderBy("idx").collect()]
    assert L.slice_documents(read, spark.createDataFrame([("D1",)], "doc_id string")).count() == read.count() - 1
    assert L.slice_documents(read, spark.createDataFrame([("X",)], "doc_id string")).count() == 0
    assert {x.line.split()[-1] for x in L.rewrite_coref(L.blocks(read), spark.createDataFrame([], "path string, line_no int, coref string")).collect() if x.line.strip()} == {"-"}


def test_brackets_nest_and_break(spark):
    lines = ["#begin document (A); part 000", "A 000 0 a - (1|(2", "A 000 1 b - (1|1)", "A 000 2 c - 1)|2)", "A 000 3 d - 3)", "A 000 4 e - (4", "", "", "A 000 0 f - (5)", "#end document"]
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")
    toks = L.tokens(L.blocks(df))
    assert [x.sentence_id for x in toks.orderBy("idx").collect()] == [1, 1, 1, 1, 1, 2]
    found = sorted(((x.cid, x.start, x.end) for x in L.mentions(toks).collect()), key=str)
    assert found == sorted([("1", 0, 2), ("1", 1, 1), ("2", 0, 2), ("3", None, 3), ("4", 4, None), ("5", 5, 5)], key=str)
    gates = {x.kind: x.n for x in L.mention_gates(L.mentions(toks)).collect()}
    assert gates == {"unclosed": 1, "close_without_open": 1, "cross_sentence": 0, "in_two_clusters": 1}


def test_fx2_zero_evaluation(spark):
    gold = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 0, 1), (1, 3, 0, 1), (1, 3, 5, 2)], "doc_id int, sentence_id int, token_id int, chain_id int")
    zeros = spark.createDataFrame([(1, 2, 0)], "doc_id int, sentence_id int, token_id int")
    cases = {
        ((1, 0, 1), (2, 0, 1), (3, 0, 1)): (1, 1, 1, 2, 2, 2),
        (): (0, 0, 0, 2, 0, 0),
        ((2, 0, 1), (1, 0, 1), (3, 0, 2)): (1, 1, 1, 2, 1, 1),
        ((1, 0, 1), (3, 0, 1), (2, 0, 2), (3, 5, 2)): (1, 1, 0, 2, 1, 0),
        ((1, 0, 1), (3, 0, 1), (2, 0, 2)): (1, 0, 0, 2, 0, 0),
    }
    for spans, want in cases.items():
        pred = spark.createDataFrame([(1, *x) for x in spans], "doc_id int, sentence_id int, token_id int, pred_id int")
        x = M.zero_detail(gold, pred, zeros).first()
        assert (x.covered, x.pred_resolved, x.correct, x.gold_pairs, x.pred_pairs, x.correct_pairs) == want


def test_fx3_windows(spark):
    for (left, right), want in {((2), (5)): (1, 7), (8, 9): (4, 10), (0, 9): None}.items():
        w = one(spark, P.centered_window(F.lit(10), F.lit(left), F.lit(right), 6))
        assert (w and (w.start, w.stop)) == want


def test_fx4_best_antecedents(spark):
    m = spark.createDataFrame([(1, 0, 0), (1, 0, 2), (1, 0, 4)], "doc_id int, sentence_id int, token_id int")
    s = spark.createDataFrame([(1, 0, 0, 0, 2, 0.6), (1, 0, 0, 0, 4, 0.7), (1, 0, 2, 0, 4, 0.7)], "doc_id int, s1 int, t1 int, s2 int, t2 int, p double")
    for threshold, links, ids in ((0.5, {(2, 0), (4, 2)}, [1, 1, 1]), (0.65, {(4, 2)}, [1, 2, 2])):
        best = C.best_antecedents(s, threshold)
        assert {(x.t2, x.t1) for x in best.collect()} == links
        assert [x.cluster_id for x in C.forest_clusters(m, best).orderBy("token_id").collect()] == ids


def test_fx5_markers(spark):
    spans = spark.createDataFrame([(1, 1, 0, 3, 1), (1, 1, 0, 1, 2), (1, 1, 1, 1, 3), (1, 1, 1, 3, 4)], "doc_id int, sentence_id int, start int, end int, cid int")
    assert {x.token_id: x.coref for x in C.coref_markers(spans).collect()} == {0: "(1|(2", 1: "(4|(3)|2)", 3: "4)|1)"}


def test_fx6_jaccard_and_functions(spark):
    j = lambda a, b: one(spark, T.jaccard(T.ngrams(F.lit(a), 7), T.ngrams(F.lit(b), 7)))
    assert abs(j("abcdefgh", "abcdefgi") - 1 / 3) < 1e-9 and j("abc", "abcdefg") == 0 and j("a b c d e f g", "abcdefg") == 1
    assert one(spark, T.normalize_head(F.lit("这项目"))) == "目" and one(spark, T.normalize_head(F.lit("该项目"))) == "项目"
    assert one(spark, T.safe_int(F.lit("3.7"))) == 3 and one(spark, T.safe_int(F.lit("nan"))) is None and one(spark, T.safe_int(F.lit("-2.9"))) == -2
    assert one(spark, T.sanitize_doc_id(F.lit("  "))) == "UNKNOWN_DOC"


def test_fx17_lenient_json(spark):
    parse = lambda s: (lambda x: x and json.loads(x))(one(spark, T.parse_object(F.lit(s))))
    assert parse("```json\n{“a”: True,}\n```") == {"a": True}
    assert parse('前缀 {"a":{"b":1}} 后缀') == {"a": {"b": 1}}
    assert parse("[1,2]") is None and parse("") is None and parse("{") is None


def test_fx8_derived_labels(spark):
    m = spark.createDataFrame(
        [(1, 1, 1, "事件提及"), (1, 1, 2, "有定描述"), (1, 2, 1, "指示代词"), (1, 2, 2, "事件提及"), (1, 3, 1, "零指代"), (1, 3, 2, "人称代词")], "doc_id int, chain_id int, sentence_id int, mention_type string"
    )
    chains = O.chain_types(m)
    assert {x.chain_id: x.chain_type for x in chains.collect()} == {1: "事件指代", 2: "指示代词", 3: "零指代"}
    assert O.doc_categories(chains).first().category == "零指代"


def test_fx9_event_conflicts(spark):
    e = spark.createDataFrame([(1, "a", 0, "启动"), (1, "b", 1, "动作"), (2, "a", 5, "审计"), (2, "b", 5, "审计"), (3, "a", 0, "启动"), (3, "b", 2, "审计")], "doc_id int, event_id string, start int, trigger string")
    assert {x.doc_id: x.kind for x in E.conflicts(e).collect()} == {1: "OVERLAP", 2: "SAME"}
    kept = e.join(E.drop_conflicts(e), ["doc_id", "event_id"], "left_semi")
    assert E.conflicts(kept).count() == 0 and kept.count() == 4
    assert one(spark, E.sentence_offsets(F.lit("ab cd ab"), F.array(F.lit("ab"), F.lit("cd"), F.lit("ab")))) == [0, 3, 6]
    assert one(spark, E.sentence_offsets(F.lit("ab"), F.array(F.lit("x"), F.lit("ab")))) == [-1, -1]


def test_fx10_candidates(spark):
    c = spark.createDataFrame([(1, 0, i, v) for i, v in enumerate((9, 13, 15))], "topic int, attempt int, cand int, score int")
    assert [(x.cand, x.score) for x in G.best_candidates(c).collect()] == [(1, 13)]


def test_fx15_coreference_metrics(spark):
    ids = {c: i for i, c in enumerate("abcdefghi")}
    rows = lambda cl: [(1, 1, ids[m], k) for k, c in enumerate(cl, 1) for m in c]
    gold = spark.createDataFrame(rows(["abc", "defg"]), "doc_id int, sentence_id int, token_id int, chain_id int")
    pred = spark.createDataFrame(rows(["ab", "cd", "fghi"]), "doc_id int, sentence_id int, token_id int, pred_id int")
    by = ["doc_id"]
    got = {
        "muc": M.prf_of(M.muc_parts(gold, pred), by, "muc_rn", "muc_rd", "muc_pn", "muc_pd"),
        "b3": M.prf_of(M.b3_parts(gold, pred), by, "b3_rn", "b3_rd", "b3_pn", "b3_pd"),
        "ceafe": M.prf_of(M.ceafe_parts(gold, pred), by, "ceafe_n", "ceafe_rd", "ceafe_n", "ceafe_pd"),
        "blanc": M.blanc(M.blanc_parts(gold, pred), by),
    }
    want = {"muc": (0.4, 0.4, 0.4), "b3": (0.416667, 0.5, 0.454545), "ceafe": (0.65, 0.433333, 0.52), "blanc": (0.444444, 0.325, 0.367647)}
    for name, df in got.items():
        x = df.first()
        assert (x.recall, x.precision, x.f1) == pytest.approx(want[name], abs=1e-5), name


def test_fx16_greedy_dedup(spark):
    members = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 1)], "doc_id long, rep long")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "doc_a long, doc_b long")
    assert {x.doc_id for x in D.greedy_accept(members, pairs).where("accepted").collect()} == {1, 3}
    assert {x.doc_id for x in D.earlier_duplicate(members, pairs.selectExpr("doc_b AS rep")).where("is_dup").collect()} == {2, 3, 4}


def test_near_duplicates_match_brute_force(spark):
    import random

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    base = [" ".join(word() for _ in range(30)) for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(3):
            w = b.split()
            for _ in range(r.choice([0, 2, 9, 15])):
                w[r.randrange(30)] = word()
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members, reps = D.representatives(docs)
    texts = {x.rep: x.text.replace(" ", "") for x in reps.collect()}
    grams = {k: {t[i : i + 7] for i in range(len(t) - 6)} for k, t in texts.items()}
    want = {(a, b) for a in texts for b in texts if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.32}
    assert {(x.doc_a, x.doc_b) for x in D.jaccard_pairs(reps).collect()} == want and want
    sig = {x.rep: x.s & (2**64 - 1) for x in reps.select("rep", T.simhash("text").alias("s")).collect()}
    near = {(a, b) for a in sig for b in sig if a < b and bin(sig[a] ^ sig[b]).count("1") <= 8}
    assert {(x.doc_a, x.doc_b) for x in D.simhash_pairs(reps).collect()} == near


def test_corpus_files(spark, tmp_path):
    docs = [{"category_primary": "零指代", "text": "一", "sentences": ["一。", {"text": "二。"}], "coreference_chains": []}, {"text": "三", "sentences": []}]
    (tmp_path / "c.json").write_bytes(json.dumps(docs, ensure_ascii=False).encode("gb18030"))
    got = R.read_corpus(spark, f"{tmp_path}/c.json").orderBy("row_index").collect()
    assert [x.row_index for x in got] == [0, 1] and got[0].sentences == ["一。", "二。"] and got[0].category_primary == "零指代"
    table = spark.createDataFrame([(1, "a", [1, 2], True), (2, None, None, False)], "n int, s string, a array<int>, b boolean")
    W.write_table(table.coalesce(1), f"{tmp_path}/t", ["s", "a", "b", "n"], bom=True)
    assert sorted(map(tuple, R.read_table(spark, f"{tmp_path}/t").collect())) == [("", "", "0", "2"), ("a", "[1,2]", "1", "1")]
    assert R.read_table(spark, f"{tmp_path}/t").columns == ["s", "a", "b", "n"]
    (tmp_path / "ids").write_text(" a \n\nb\n")
    assert [x.doc_id for x in R.read_ids(spark, f"{tmp_path}/ids").collect()] == ["a", "b"]
    assert R.state_table(spark, f"{tmp_path}/none", "a int").collect() == []
    assert R.file_digests(spark, f"{tmp_path}/ids").first().size_bytes == 7
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.txt").write_text("api_key = 1\nfine\n")
    assert R.sensitive_lines(spark, f"{tmp_path}/p").count() == 1
    assert W.package(f"{tmp_path}/p", f"{tmp_path}/a.zip") == W.package(f"{tmp_path}/p", f"{tmp_path}/b.zip")


def test_stream_keeps_first_of_similar(spark, tmp_path):
    a = "the quick brown fox jumps over the lazy dog and runs away from it all day long"
    rows = [[(1, a), (2, a + " x")], [(3, a.replace("dog", "dig")), (4, "something else entirely, with other words in other places and no copy")]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = ST.log_stream(spark, f"{tmp_path}/in", "doc_id long, text string")
        ST.dedup_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(x.doc_id for x in ST.accepted_documents(ST.Versions(spark, f"{tmp_path}/out")).collect()) == [1, 4]


def test_gates(spark):
    with pytest.raises(ValueError):
        O.enforce(O.expect(spark.range(3).agg(F.count("*").alias("n")), {"n": 4}))
    O.enforce(O.expect(spark.range(3).agg(F.count("*").alias("n")), {"n": 3}))
