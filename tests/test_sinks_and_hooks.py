"""The conversion's files, the score hook, event clusters, small functions."""

import csv
import glob
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions import text as T
from tessera.operators import corpus as O
from tessera.operators import events as E
from tessera.operators import generate as G
from tessera.operators import pairs as P
from tessera.sinks import files as W
from tessera.sinks.conversion import write_conversion
from tessera.sources import corpus


def docs(spark, end=1):
    m = lambda sid, text, a, b, kind="人称代词": {"sentence_id": sid, "text": text, "char_start": a, "char_end": b, "mention_type": kind, "referent_semantics": "ENTITY"}
    chain = {"index": 1, "type": "零指代", "mentions": [m(1, "小王", 0, end), m(2, "他", 0, 0), m(2, "Ø", 3, 3, S.ZERO)]}
    alone = {"index": 2, "type": "人称代词", "mentions": [m(2, "走", 1, 1)]}
    rows = [(f"d {i}", s, "体育", "小王来。他走了。", ["小王来。", "他走了。"], [chain, alone]) for i, s in enumerate(["train", "test"])]
    plain = "doc_id string, split string, domain string, text string, sentences array<string>, coreference_chains array<" + S.CHAIN + ">"
    return spark.createDataFrame(rows, plain).withColumn("category_primary", F.lit(S.ZERO))


def lines(folder):
    return [x for f in sorted(glob.glob(f"{folder}/part-*.txt")) for x in open(f, encoding="utf-8").read().split("\n")[:-1]]


def table(folder):
    return [r for f in sorted(glob.glob(f"{folder}/part-*.csv")) for r in csv.DictReader(open(f, encoding="utf-8"))]


def test_conversion_files(spark, tmp_path):
    out = str(tmp_path / "out")
    total = {(r["mode"], r["split"]): r for r in write_conversion(docs(spark), out).collect()}
    assert total["with_zero", "test"].mentions_exported == 3 and total["surface_only", "test"].mentions_exported == 2
    key, empty = lines(f"{out}/scorer/key"), lines(f"{out}/scorer/empty")
    assert key == lines(f"{out}/scorer/identity") == lines(f"{out}/conll/with_zero/test")
    assert key[0] == "#begin document (d_1); part 000" and [x.split()[-1] for x in key[1:5]] == ["(1", "1)", "-", "-"]
    assert [x.split()[3] for x in key[6:11]] == ["他", "走", "了", "Ø", "。"] and [x.split()[-1] for x in key[6:11]] == ["(1)", "-", "-", "(1)", "-"]
    assert len(empty) == len(key) and all(x.split()[-1] == "-" for x in empty if len(x.split()) > 5)
    assert [x for x in lines(f"{out}/conll/surface_only/all") if x.startswith("#begin")] == ["#begin document (d_0); part 000", "#begin document (d_1); part 000"]
    assert lines(f"{out}/conll/with_zero/dev") == [] and len(table(f"{out}/metadata/token_map")) == 2 * (9 + 8)
    assert [r["n_mentions"] for r in table(f"{out}/metadata/doc_map")] == ["4", "4"] and len(table(f"{out}/metadata/type_slice_map")) == 10
    assert table(f"{out}/validation/errors") == [] and {r["error_type"] for r in table(f"{out}/validation/warnings")} == {"drop_singleton_chain"}
    with pytest.raises(ValueError):
        write_conversion(docs(spark, 9), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_hook_clusters_and_functions(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 0.0), (2, 2.0)], "id int, x double")
    one = {r.id: (r.p, r.pred) for r in P.score_pairs(pairs, lambda b: b.x / 2).collect()}
    two = {r.id: (r.p, r.pred) for r in P.score_pairs(pairs, lambda b: np.stack([b.x * 0, b.x], 1)).collect()}
    assert one == {1: (0.0, False), 2: (1.0, True)} and two[1] == (0.5, True) and abs(two[2][0] - 1 / (1 + np.exp(-2))) < 1e-12
    packed = spark.createDataFrame([("a", 4, [0, 0, 1, 1, 0, 0]), ("b", 1, []), ("c", 0, [])], "doc_id string, n int, l array<int>")
    assert {r.doc_id: r.c for r in packed.select("doc_id", E.event_clusters("n", "l").alias("c")).collect()} == {"a": [0, 1, 1, 0], "b": [0], "c": []}
    numbers = [0.125, 2.675, -0.5, 1234567.891, 0.0, 1e-9]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select(*(T.fixed("x", k).alias(str(k)) for k in (2, 4, 6))).collect()
    assert [tuple(r) for r in got] == [(f"{x:.2f}", f"{x:.4f}", f"{x:.6f}") for x in numbers]
    row = spark.range(1).select(T.fixed(F.lit(float("nan")), 2), T.event_end(F.lit(3), F.lit("启动")), T.is_explicit_event(F.lit(S.EVENT_MENTION), F.lit("EVENT")), T.is_explicit_event(F.lit(None), F.lit("EVENT"))).first()
    assert tuple(row) == ("nan", 4, True, False)
    spans = spark.createDataFrame([(1, 2, 1, 2), (1, 2, 1, 3)], "s1 int, t1 int, s2 int, t2 int")
    assert P.self_pairs(spans).count() == 1
    (tmp_path / "ids").write_text(" a \n\nb\na\n")
    assert corpus.read_ids(spark, str(tmp_path / "ids")).count() == 3
    with pytest.raises(ValueError):
        corpus.read_ids(spark, str(tmp_path / "ids"), unique=True)


def test_configuration_manifest_and_commands(spark, tmp_path):
    (tmp_path / "in.json").write_text("[]")
    write_conversion(docs(spark), f"{tmp_path}/out", inputs={"corpus": f"{tmp_path}/in.json"})
    read = lambda name: json.loads("".join(open(f, encoding="utf-8").read() for f in glob.glob(f"{tmp_path}/out/{name}/part-*.txt")))
    assert read("conversion_config")["char_end_mode"] == "inclusive" and read("conversion_config")["drop_singleton_chains"] is True
    manifest = read("input_manifest")
    assert [(x["input"], x["size_bytes"]) for x in manifest["inputs"]] == [("corpus", 2)] and manifest["inputs"][0]["sha256"] == hashlib.sha256(b"[]").hexdigest()
    assert f"{tmp_path}/out/scorer/key" in manifest["outputs"] and all(glob.glob(f"{x}/part-*") for x in manifest["outputs"])
    commands = lines(f"{tmp_path}/out/scorer/command")
    assert len(commands) == 4 and commands[2].endswith(f'all "{tmp_path}/out/scorer/key" "{tmp_path}/out/scorer/empty" none')


def test_sidecars_are_one_object(spark, tmp_path):
    row = spark.createDataFrame([(3, 0.5, None, "é零")], "tp long, f1 double, x string, note string")
    W.write_sidecar(row, f"{tmp_path}/s", split="test", threshold=0.5)
    (file,) = glob.glob(f"{tmp_path}/s/part-*.txt")
    text = open(file, encoding="utf-8").read()
    assert json.loads(text) == {"split": "test", "threshold": 0.5, "tp": 3, "f1": 0.5, "x": None, "note": "é零"} and "é零" in text and text.count("\n") > 3
    with pytest.raises(Exception, match="one row"):
        W.write_sidecar(row.unionByName(row), f"{tmp_path}/t")


def test_gates_on_order_spans_and_tokens(spark):
    places = lambda *x: spark.createDataFrame(list(x), "doc_id string, place int")
    got = {tuple(r) for r in O.order_problems(places(("a", 1), ("b", 2), ("c", 3)), places(("a", 1), ("c", 2), ("b", 3), ("d", 4))).collect()}
    assert got == {("b", 2, 3), ("c", 3, 2), ("d", None, 4)}
    tokens = spark.createDataFrame([(1, 0, "a"), (1, 1, "b c"), (1, 2, ""), (1, 3, None), (1, 4, "d　")], "doc_id int, idx int, tok string")
    assert sorted(x.idx for x in P.bad_tokens(tokens).collect()) == [1, 2, 3, 4]
    keys = ["doc_id", "s1", "t1", "s2", "t2"]
    pairs = spark.createDataFrame([(1, 1, 0, 1, 1), (1, 1, 0, 2, 0)], "doc_id int, s1 int, t1 int, s2 int, t2 int")
    scores = spark.createDataFrame([(1, 1, 0, 1, 1), (1, 1, 0, 1, 0), (1, 1, 0, 9, 9), (1, 1, 0, 9, 9)], "doc_id int, s1 int, t1 int, s2 int, t2 int")
    mentions = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 2, 0)], "doc_id int, sentence_id int, token_id int")
    want = {"duplicate_pair": 0, "duplicate_score": 1, "missing_score": 1, "unknown_score": 3, "self_pair": 1, "unknown_span": 1}
    assert {r.kind: r.n for r in P.score_gates(pairs, scores, keys, mentions).collect()} == want


def test_zero_rows_of_both_maps(spark):
    mentions = spark.createDataFrame([("d", 1, 0, True, True, "EVENT", "with_zero"), ("d", 1, 3, True, True, "ENTITY", "with_zero"), ("d", 2, 0, False, True, "EVENT", "with_zero"), ("d", 1, 0, True, True, "EVENT", "surface_only")], "doc_id string, sentence_id int, token_start int, is_exported boolean, is_zero boolean, referent_semantics string, mode string")
    tokens = spark.createDataFrame([("d", 1, 0, 1, "with_zero"), ("d", 2, 0, 1, "with_zero"), ("d", 1, 1, 0, "with_zero")], "doc_id string, sentence_id int, token_id int, is_zero_token int, mode string")
    wanted, apart = O.zero_rows(mentions, tokens, "EVENT")
    assert [(r.sentence_id, r.token_id) for r in wanted.collect()] == [(1, 0)]
    assert {tuple(r) for r in apart.collect()} == {("d", 1, 3, "mention_only"), ("d", 2, 0, "token_only")}


def test_repairs_are_judged_again(spark):
    answers = [('```json\n{"status": "fixed", "data": {"text": "long enough"}}\n```',), ('{"status": "ok", "data": {"text": "no"}}',), ('{"status": "reject"}',), ("nothing",)]
    check = lambda d: F.when(F.length(d["text"]) < 5, "text_too_short")
    got = G.taken_repairs(spark.createDataFrame(answers, "answer string"), "text string", check).collect()
    assert [(r.repaired and r.repaired.text, r.reason) for r in got] == [("long enough", "ok"), ("no", "text_too_short"), (None, "no_document"), (None, "no_document")]
    bare = G.taken_repairs(spark.createDataFrame([('{"text": "long enough"}',)], "answer string"), "text string", check, envelope=False)
    assert bare.first().reason == "ok"
