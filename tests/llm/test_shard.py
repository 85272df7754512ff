import hashlib
import random
from collections import defaultdict

from tessera.llm import shard


def brute(rows, limit):
    bits = lambda d: bin(int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16))[2:].zfill(60)
    docs = [(d, len((t or "").encode()), bits(d)) for d, t in rows]
    out = []

    def split(members, prefix):
        if not members:
            return
        if sum(b for _, b, _ in members) <= limit or len(members) == 1 or len(prefix) == 60:
            out.extend((d, b, "b" + prefix) for d, b, _ in members)
            return
        for bit in "01":
            split([m for m in members if m[2].startswith(prefix + bit)], prefix + bit)

    split(docs, "")
    return sorted(out, key=str)


def corpus():
    r = random.Random(2)
    rows = [(i, "é" * r.choice([0, 3, 40, 900])) for i in range(400)]
    return [*rows, (400, None), (None, "abc"), (401, "x" * 30000), (5, rows[5][1])]


def test_matches_splitting_by_hand(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, hash int")
    for limit in (1 << 30, 6000, 2500):
        got = shard.assign(docs, limit).collect()
        assert sorted(((x.doc_id, x.bytes, x.shard) for x in got), key=str) == brute(rows, limit)
        size = defaultdict(int)
        for x in got:
            size[x.shard] += x.bytes
        assert all(size[x.shard] == x.shard_bytes and x.oversized == (x.shard_bytes > limit) for x in got)
        assert all(not x.oversized or x.shard_docs == 1 for x in got)


def test_hot_key_and_repeated_rows_fit(spark):
    rows = [(i, "hot", "y" * 50) for i in range(600)] + [(i, f"k{i}", "y" * 50) for i in range(600, 900)] + [(7, "hot", "y" * 50)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = shard.assign(docs, 1000, key="source").collect()
    assert len(got) == len(rows) and max(x.shard_bytes for x in got) <= 1000


def test_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, "z" * 100) for i in range(50)], "doc_id long, text string")
    shard.write_shards(docs, f"{tmp_path}/out", 1000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 50 and back.select("shard").distinct().count() >= 5


def test_every_row_is_written(spark, tmp_path):
    rows = [(None, "a"), (1, "b"), (1, "c"), (1, "c"), (None, None), (2, "d" * 500)]
    docs = spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, shard string, `x.y` int")
    shard.write_shards(docs, f"{tmp_path}/out", 10)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(((x.doc_id, x.text) for x in back.collect()), key=str) == sorted(rows, key=str)


def test_empty_table(spark):
    assert shard.assign(spark.createDataFrame([], "doc_id long, text string")).collect() == []
