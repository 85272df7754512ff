import hashlib
import random
import struct

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def want(rows):
    encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    out = []
    for d, t in rows:
        ids = encoder.encode_ordinary(t or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        out.append((d, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(7)
    alphabet = ["a", "b", " ", "  ", "\n", "\t ", "'s", "'", "1", "23", "é", "漢", "😀", "!", "?!", " ", " ", "<|endoftext|>", "ll"]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.choice([1, 5, 60, 400, 3000])))) for i in range(80)]
    return [*rows, (100, None), (101, ""), (102, "x" * 5000), (103, " " * 5000), (104, "!" * 700 + "a"), (105, "ab " * 4000), (105, "ab " * 4000), (None, "no id"), (106, "a" * 130 + " " + "1" * 1000)]


def test_equals_the_whole_text_encoding(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, ids int, row string")
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (64, 16), (33, 40)):
        got = bpe.digest(bpe.encode(docs, PATH, PATTERN, chunk, overlap)).collect()
        assert sorted((tuple(x) for x in got), key=str) == want(rows), (chunk, overlap)


def test_long_texts_are_cut_where_chunks_agree(spark):
    docs = spark.createDataFrame([(1, "r", "some words go on " * 40)], "doc_id long, row string, text string")
    pieces = bpe.pieces_of_long(docs, PATTERN, 64, 16).orderBy("piece_no").collect()
    assert len(pieces) > 8 and "".join(p.piece for p in pieces) == "some words go on " * 40


def test_empty_table_and_round_trip(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).collect() == []
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(corpus())], "doc_id long, text string")
    out = bpe.encode(docs, PATH, PATTERN, 50, 9).join(docs, "doc_id")
    again = bpe.decode(out.select("doc_id", "ids"), PATH, PATTERN).join(docs, "doc_id")
    for table in (out, again):
        assert table.where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0


def test_one_very_long_text(spark):
    rows = [(1, "Wörter und 12 more, " * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(x) for x in bpe.digest(bpe.encode(docs, PATH, PATTERN)).collect()] == want(rows)


def test_decode_keeps_columns_of_any_name(spark):
    out = bpe.decode(spark.createDataFrame([(bytearray(b"\x00\x00\x00\x00"), (1,))], "ids binary, `a b:c` struct<`d e`: int>"), PATH, PATTERN).first()
    assert out["a b:c"]["d e"] == 1 and len(out.decoded) == 1
