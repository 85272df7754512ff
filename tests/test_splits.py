"""Readers by byte ranges against whole-file readers and plain parsers, at block sizes that cut everywhere."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.sources import conll as L
from tessera.sources import corpus as R
from tessera.sources import splits as B


@pytest.fixture
def small_blocks(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield use
    for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{key}")


def conll(end="\n", last="\n", head=""):
    r = random.Random(3)
    out = [head] if head else []
    for d in range(25):
        out.append(f"#begin document (d{d}); part {d % 3:03}")
        for _ in range(r.randrange(0, 4)):
            out += [f"d{d} 0 {k} wörd#begin document - * - - - - * -" for k in range(r.randrange(1, 5))] + [""] * r.randrange(0, 3)
        out.append("#end document")
    return end.join(out) + last


@pytest.mark.parametrize("size", [64, 300, 10**6])
def test_conll_lines_are_those_of_the_whole_file(spark, tmp_path, small_blocks, size):
    for name, text in {"a": conll(), "b": conll("\r\n", "\r\n"), "c": conll(last=""), "d": conll("\r\n", "\r", head="# a comment"), "e": "no document\nat all\n"}.items():
        (tmp_path / name).write_bytes(text.encode())
    want = sorted(map(tuple, L.read_lines(spark, f"{tmp_path}/*").collect()))
    small_blocks(size)
    assert sorted(map(tuple, B.conll_lines(spark, f"{tmp_path}/*").collect())) == want
    if size == 64:
        assert B.records(spark, f"{tmp_path}/a", "\n" + B.BEGIN_MARK).rdd.getNumPartitions() > 20


def documents():
    r = random.Random(4)
    odd = ['{', '}', '"', "\\", '\\"', "}{", "]", "ü", "\n", '{"a": "}"}', "\\\\", "["]
    text = lambda: "".join(r.choice(["word ", *odd]) for _ in range(r.randrange(0, 30)))
    mention = lambda: {"sentence_id": 1, "text": text(), "char_start": 0, "char_end": 1, "mention_type": "x"}
    return [{"category_primary": text(), "domain": "d", "text": text(), "sentences": [text(), {"text": text()}], "coreference_chains": [{"index": k, "type": text(), "mentions": [mention(), mention()]} for k in range(r.randrange(0, 3))]} for _ in range(40)]


@pytest.mark.parametrize("size", [50, 700, 10**6])
def test_json_objects_are_those_of_the_whole_file(spark, tmp_path, small_blocks, size):
    docs = documents()
    for name, text in {"flat": json.dumps(docs), "pretty": json.dumps(docs, indent=2, ensure_ascii=False), "bom": "﻿" + json.dumps(docs[:3], indent=1), "empty": "[]", "one": json.dumps(docs[:1])}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    want = {name: [tuple(x) for x in R.read_corpus(spark, f"{tmp_path}/{name}").orderBy("row_index").collect()] for name in ("flat", "pretty", "bom", "empty", "one")}
    assert len(want["flat"]) == 40
    small_blocks(size)
    for name, rows in want.items():
        assert [tuple(x) for x in R.read_large_corpus(spark, f"{tmp_path}/{name}").orderBy("row_index").collect()] == rows, name
    if size == 50:
        assert B.records(spark, f"{tmp_path}/flat", "}").rdd.getNumPartitions() > 50
    raw = [json.loads(x.raw) for x in B.json_objects(spark, f"{tmp_path}/flat").orderBy("row_index").collect()]
    assert raw == docs


def literal(lines):
    """What one reads from top to bottom, with a stack for each document and cluster; the last writer of a span wins."""
    spans, stacks, doc, sid, bad = {}, defaultdict(list), None, 0, []
    for line in lines:
        if line.startswith("#begin document"):
            doc, sid = line.split("(", 1)[1].split(")", 1)[0], 0
        elif line and not line.startswith("#"):
            parts = line.split()
            tid = int(parts[2])
            sid += tid == 0
            for mark in parts[-1].split("|") if parts[-1] != "-" else []:
                cid = mark.strip("()")
                if mark.startswith("("):
                    stacks[doc, cid].append((sid, tid))
                if mark.endswith(")"):
                    if not stacks[doc, cid]:
                        bad.append((doc, cid, "close_without_open"))
                        continue
                    s, t = stacks[doc, cid].pop()
                    if s != sid:
                        bad.append((doc, cid, "cross_sentence"))
                    else:
                        spans[doc, sid, t, tid] = cid
    bad += [(doc, cid, "unclosed") for (doc, cid), left in stacks.items() for _ in left]
    return spans, sorted(bad)


@pytest.mark.parametrize("seed", range(3))
def test_literal_mentions_match_a_plain_reader(spark, seed):
    r = random.Random(seed)
    lines = []
    for d in range(12):
        lines.append(f"#begin document (d{d % 9}); part {d:03}")
        for _ in range(r.randrange(1, 4)):
            for t in range(r.randrange(1, 6)):
                marks = [m for c in r.sample("1234", r.choice([0, 0, 1, 2, 3])) for m in [r.choice([f"({c}", f"{c})", f"({c})"])]]
                lines.append(f"d 0 {t} w - - - - - - - {'|'.join(marks) or '-'}")
            lines.append("")
        lines.append("#end document")
    table = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")
    got = L.literal_mentions(L.blocks(table)).collect()
    spans, bad = literal(lines)
    assert {(x.doc_id, x.sentence_id, x.start, x.end): x.cid for x in got if x.problem is None} == spans and len(spans) > 20
    assert sorted((x.doc_id, x.cid, x.problem) for x in got if x.problem) == bad and bad


def test_field_gate(spark):
    lines = ["#begin document (d); part 000", "d 0 0 w - * - - - - * -", "d 0 1 w -", "", "d 0 2 w - * - - - - * - x", "#end document"]
    table = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")
    assert [(x.line_no, x.n_fields) for x in L.field_gates(L.blocks(table)).orderBy("line_no").collect()] == [(2, 5), (4, 13)]
