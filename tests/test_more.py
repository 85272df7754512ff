"""Functions and operators that no registered query shows."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import convert as K
from tessera.operators import events as E
from tessera.operators import generate as G
from tessera.operators import mutate as U
from tessera.operators import pairs as P
from tessera.sinks import files as W
from tessera.sources import corpus as R
from tessera.streaming import generation as ST


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, T.as_bool(F.lit(" Yes "))) is True and one(spark, T.yes(F.lit("no"))) is False
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, T.as_bool(F.lit("maybe")))
    assert one(spark, T.replace_terms(F.lit("ab c"), {"ab": "x", "x c": "y"})) == "y"
    assert one(spark, T.fill_prompt(F.lit("say {a} {b}"), {"a": F.lit("1"), "b": F.lit("2")})) == "say 1 2"
    assert one(spark, T.prompt_hash(F.lit("a"))).startswith("sha256:ca978112")
    assert one(spark, T.label_map(F.lit("k"), {"k": "v"})) == "v" and one(spark, T.label_map(F.lit("z"), {"k": "v"})) is None
    assert one(spark, T.first_sentence(F.lit("一。二。"))) == "一。" and one(spark, F.size(T.char_tokens(F.lit("a　b")))) == 2
    assert one(spark, T.topic_signature(F.lit("B：a、b"))) == "a|b"
    assert one(spark, T.topic_signature(F.lit("Bc：甲、乙"), T.TOPIC_MARKS_RANGE)) == "乙|甲"
    checks = {("王明来", "王明", 0, 1): "ok", ("王 明来", "王明", 0, 2): "space_only", ("王明来", "王", 1, 1): "mismatch", ("王明", "王", 0, 5): "bad_char_offset"}
    for (s, t, a, b), want in checks.items():
        assert one(spark, T.mention_text_check(F.lit(s), F.lit(t), F.lit(a), F.lit(b))) == want
    for value, want in {"1": (0, None), "0": (0, "sentence_id_zero_based"), "9": (None, "sentence_id_out_of_range"), "x": (None, "sentence_id_not_int")}.items():
        assert tuple(one(spark, T.sentence_index(F.lit(value), F.lit(3)))) == want
    assert tuple(one(spark, R.scorer_output(F.lit("x\nCoreference: Recall: (1 / 2) 50% Precision: (1 / 4) 25.5% F1: 33.33%\n")))) == (50.0, 25.5, 33.33)
    assert one(spark, G.repaired(F.lit('{"status":"fixed","data":{"a":1}}'))) == '{"a":1}' and one(spark, G.repaired(F.lit('{"status":"reject"}'))) is None
    assert one(spark, G.gen_id(F.lit("q"), F.lit(7), F.lit("c1"))) == "q-000007-c1"
    assert one(spark, U.remove_first(F.lit("aØbØ"))) == "abØ" and one(spark, U.remove_first(F.lit("ab"))) == "ab"


def test_validation_reasons(spark):
    mention = lambda s, t, r: (s, t, r)
    zero = ("零指代", [mention("1", "王", "antecedent"), mention("2", "Ø", "anaphor")], None)
    other = [("人称代词", [], None), ("有定描述", [], None)]
    base = {"text": "字" * 120, "sentences": ["王", "Ø来", "c", "d", "e"], "chains": [zero, *other], "category": "零指代"}
    bad = lambda m: [("零指代", m, None), *other]
    cases = [
        ({}, "ok"),
        ({"text": "短"}, "text_too_short"),
        ({"sentences": ["王"]}, "bad_sentences_len"),
        ({"chains": other}, "too_few_chains"),
        ({"chains": bad([mention("1", "王", "antecedent")])}, "zero_chain_too_short"),
        ({"chains": bad([mention("x", "王", "antecedent"), mention("2", "Ø", "anaphor")])}, "zero_chain_bad_sid"),
        ({"chains": bad([mention("1", "王", "antecedent"), mention("2", "他", "anaphor")])}, "zero_anaphor_not_O"),
        ({"chains": bad([mention("1", "王", "antecedent"), mention("3", "Ø", "anaphor")])}, "zero_anaphor_not_in_sentence"),
        ({"chains": bad([mention("1", "王", "other"), mention("2", "Ø", "anaphor")])}, "zero_chain_bad_role"),
        ({"chains": bad([mention("1", "王", "antecedent"), mention("1", "王", "antecedent")])}, "zero_chain_bad_cardinality"),
        ({"category": "事件指代"}, "primary_type_missing:事件指代"),
        ({"sentences": ["2025年王", "Ø来", "c", "d", "e"]}, "bad_time_anchor_year_start"),
        ({"text": "2019年" + "字" * 120}, "contains_pre_2025_year"),
    ]
    rows = [(i, *(base | change).values()) for i, (change, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, text string, sentences array<string>, chains array<struct<type: string, mentions: array<struct<sentence_id: string, text: string, role: string>>, trigger: struct<text: string>>>, category string")
    got = df.select("i", G.validation_reason(F.col("text"), F.col("sentences"), F.col("chains"), F.col("category")).alias("r")).collect()
    assert {x.i: x.r for x in got} == {i: want for i, (_, want) in enumerate(cases)}
    event = df.where("i = 0").withColumn("chains", F.transform("chains", lambda c: F.struct(F.lit("事件指代").alias("type"), c["mentions"].alias("mentions"), c["trigger"].alias("trigger"))))
    assert event.select(G.validation_reason(F.col("text"), F.col("sentences"), F.col("chains"), F.lit("x"), need_trigger=True).alias("r")).first().r == "missing_or_bad_event_trigger"


def test_fixes(spark):
    m = spark.createDataFrame([(1, 1, 1, "甲乙", 0, 1), (1, 1, 2, "丙", 3, 3)], "doc_id int, chain_id int, sentence_id int, text string, char_start int, char_end int")
    fixes = spark.createDataFrame([(1, 1, 1, "甲乙", "乙", 1, False), (1, 1, 2, "丙", None, None, True), (1, 1, 9, "无", None, None, True)], "doc_id int, chain_id int, sentence_id int, text string, new_text string, new_start int, delete boolean")
    assert [tuple(x) for x in U.edit_mentions(m, fixes).collect()] == [(1, 1, 1, "乙", 1, 1)]
    assert [(x.sentence_id, x.n) for x in U.fix_gate(m, fixes).collect()] == [(9, 0)]


def test_remap_and_predictions(spark):
    toks = spark.createDataFrame([(1, i, t) for i, t in enumerate(["[CLS]", "a", "[SEP]", "b"])], "doc_id int, idx int, tok string")
    kept = P.kept_token_index(toks, ["[CLS]", "[SEP]"])
    spans = spark.createDataFrame([(1, 1, 1), (1, 1, 3), (1, 0, 1)], "doc_id int, start int, end int")
    assert {(x.start, x.end): x.status for x in P.remap_spans(spans, kept).collect()} == {(1, 1): "ok", (1, 3): "not_contiguous", (0, 1): "touches_special"}
    packed = E.pack_predictions(spark.createDataFrame([(1, 1, 2, 0.2), (1, 0, 2, 0.5), (1, 0, 1, 0.9)], "doc_id int, i int, j int, p double")).first()
    assert packed.pred_label == [1, 1, 0] and packed.pred_prob == [0.9, 0.5, 0.2]


def test_splits_and_sampling(spark, tmp_path):
    for name in ("train", "dev"):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"text": name, "domain": "d"}, {"text": name}]))
    got = R.read_splits(spark, {n: f"{tmp_path}/{n}.json" for n in ("train", "dev")})
    assert sorted(x.doc_id for x in got.collect()) == ["DEV_000001", "DEV_000002", "TRAIN_000001", "TRAIN_000002"]
    docs = R.read_corpus(spark, f"{tmp_path}/train.json")
    rows = spark.createDataFrame([("1", "", "A", "test", "own", ""), ("", "0", "B", "train", "", ""), ("7", "", "C", "odd", "", "")], "row_index string, global_doc_index string, doc_id string, split string, domain string, category_primary string")
    assert {x.doc_id: x.domain for x in R.join_split_rows(docs, rows).collect()} == {"A": "own", "B": "d"}
    assert sorted(tuple(x) for x in R.bad_split_rows(docs, rows).collect()) == [("C", "index_out_of_range"), ("C", "unknown_split")]
    pairs = spark.range(110).select(F.col("id"), (F.col("id") < 10).alias("label"))
    order = F.xxhash64("id").bitwiseAND(F.lit(0xFFFFFFFF))
    for ratio, n in ((1.0, 10), (0.25, 2), (20.0, 100)):
        a = sorted(x.id for x in P.sample_negatives(pairs, order, ratio).collect())
        assert len(a) == 10 + n and a == sorted(x.id for x in P.sample_negatives(pairs.repartition(5), order, ratio).collect())


def test_policy_manifest_and_streams(spark, tmp_path):
    issues = spark.createDataFrame([("ERROR",)], "severity string")
    with pytest.raises(ValueError):
        K.apply_policy(issues, issues)
    assert K.apply_policy(issues, issues, "skip").count() == 1
    x = W.run_manifest(spark.createDataFrame([("a",), ("b",)], "gen_id string"), {"out": "p"}, {"j": 0.32}).first()
    assert (x.n_accepted, x.first_id, json.loads(x.filters)) == (2, "a", {"j": 0.32})
    W.write_jsonl(spark.range(3), f"{tmp_path}/j", ["id"])
    assert sorted(x.idx for x in R.read_jsonl(spark, f"{tmp_path}/j", "id long, idx long").collect()) == [0, 1, 2]
    stream = ST.log_stream(spark, f"{tmp_path}/j", "id long, idx long").withColumn("doc_id", F.col("id"))
    ST.append(ST.keep_listed(stream, spark.createDataFrame([(1,)], "doc_id long")), f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()
    assert [x.id for x in spark.read.parquet(f"{tmp_path}/o").collect()] == [1]
    assert [x.id for x in ST.tail_state(spark.range(5), spark.range(5, 8), "id", 2).orderBy("id").collect()] == [6, 7]
