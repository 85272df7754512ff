"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

Texts with equal shingle sets form one class, so copies never multiply. Classes
that share a band of their signature become candidates; in each cell of
candidates the signatures are compared a step of hashes at a time and a pair is
dropped once the posterior probability (uniform prior) that its similarity
reaches the threshold is below the tolerance. The rest is verified exactly on
the shingle sets. Cells of large buckets are split into pairs of chunks, so a
bucket of any size is spread over tasks, and a cell emits one row for each class
with links, never its pairs.

Defined results: an empty or null text, and a null doc_id, links with nothing
(n_links 0; class_id is its own doc_id); rows of one doc_id each keep their row,
as copies where their shingle sets are equal and as different documents where
not; further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textnp
from tessera.llm.components import components
from tessera.scratch import materialize, ship, small_batches

ship(__name__)

U64 = np.uint64
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 32
CHUNK = 1024
BROADCAST_IDS = 500_000


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = textnp.mix(np.arange(1, 2 * HASHES + 1, dtype=U64) * textnp.BASE)
    return draw[:HASHES] | U64(1), draw[HASHES:]


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 32 bits."""
    a, b = _coefficients()
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=U64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048, None] * a + b).min(axis=0), out=least)
    return (least >> U64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; its low 5 bits are the band's number."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(U64)
    key = np.zeros(rows.shape[:2], dtype=U64)
    for r in range(ROWS):
        key = textnp.mix(key + U64(r + 1)) + rows[:, :, r]
    return ((textnp.mix(key) << U64(5)) | np.arange(BANDS, dtype=U64)).view(np.int64)


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For 0..HASHES compared values, the fewest matches at which P(similarity >= threshold | matches) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper
    tail at t is the binomial P(Bin(n + 1, t) <= m).
    """
    out = [0]
    for n in range(1, HASHES + 1):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def _set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell shingle sets apart."""
    return int(shingles.sum(dtype=U64).view(np.int64)), int(textnp.mix(shingles + U64(7)).sum(dtype=U64).view(np.int64))


def _digest(ngram: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, sizes, bands = [], [], []
            ids = [part.column("doc_id"), part.column("tag")]
            for _, _, raw, offsets in textnp.batches(part.column("text")):
                starts, ends, first = textnp.words(raw, offsets)
                for s in textnp.shingles(textnp.word_hashes(raw, starts, ends), first, ngram):
                    sizes.append(len(s))
                    keys.append(_set_keys(s))
                    bands.append(signature(s))
            table = band_keys(np.array(bands)) if bands else np.zeros((0, BANDS), np.int64)
            k = np.array(keys, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    *ids,
                    pa.array(k[:, 0]),
                    pa.array(k[:, 1]),
                    pa.array(np.array(sizes, dtype=np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, BANDS, dtype=np.int32)), pa.array(table.ravel())),
                ],
                names=["doc_id", "tag", "k1", "k2", "n_shingles", "bands"],
            )

    return run


def _payload(ngram: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("doc_id")
            for a, b, raw, offsets in textnp.batches(part.column("text"), 2 << 20):
                starts, ends, first = textnp.words(raw, offsets)
                sets, sigs, keys = [], [], []
                for s in textnp.shingles(textnp.word_hashes(raw, starts, ends), first, ngram):
                    keys.append(_set_keys(s)[0])
                    sets.append(s.tobytes())
                    sigs.append(signature(s).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(keys, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())],
                    names=["rep", "k1", "grams", "sig"],
                )

    return run


def _verified(pairs: np.ndarray, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the pairs (rows of two indices) have a Jaccard similarity of at least threshold; exact, in bounded memory."""
    keep = np.zeros(len(pairs), dtype=bool)
    for at in range(0, len(pairs), 1 << 15):
        part = pairs[at : at + (1 << 15)]
        if len(part) < 64:
            shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in part])
        else:
            used, local = np.unique(part, return_inverse=True)
            local = local.reshape(part.shape)
            flat = np.concatenate([sets[i] for i in used])
            values, number, count = np.unique(flat, return_inverse=True, return_counts=True)
            common = np.cumsum(count > 1) - 1
            owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
            mine = (count > 1)[number]
            owner, column = owner[mine], common[number[mine]]
            width = int((count > 1).sum())
            shared = np.zeros(len(part), dtype=np.int64)
            for lo in range(0, width, 1 << 14):
                hit = (column >= lo) & (column < lo + (1 << 14))
                size = min(1 << 14, width - lo)
                bits = np.zeros((len(used), -(-size // 64) * 64), dtype=bool)
                bits[owner[hit], column[hit] - lo] = True
                packed = np.packbits(bits, axis=1).view(U64)
                for x in range(0, len(part), 2048):
                    y = local[x : x + 2048]
                    shared[x : x + 2048] += np.bitwise_count(packed[y[:, 0]] & packed[y[:, 1]]).sum(axis=1, dtype=np.int64)
        sizes = np.array([[len(sets[i]), len(sets[j])] for i, j in part])
        keep[at : at + len(part)] = shared >= threshold * (sizes.sum(axis=1) - shared) - 1e-12
    return keep


def _candidates(left: np.ndarray, right: np.ndarray, same: bool, band: int, fewest: np.ndarray) -> np.ndarray:
    """Pairs (i, j) whose first common band is this one and that no step of the comparison drops."""
    out = []
    for at in range(0, len(left), 128):
        block = left[at : at + 128]
        i, j = np.nonzero((block[:, None, band * ROWS : (band + 1) * ROWS] == right[None, :, band * ROWS : (band + 1) * ROWS]).all(axis=2))
        if same:
            i, j = i[i + at < j], j[i + at < j]
        for lo in range(0, len(i), 1 << 15):
            p, q = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
            matches = np.zeros(len(p), dtype=np.int64)
            for n in range(0, HASHES, STEP):
                equal = block[p, n : n + STEP] == right[q, n : n + STEP]
                matches += equal.sum(axis=1)
                alive = matches >= fewest[n + STEP]
                if n < band * ROWS:  # a pair is handled where its first common band is
                    whole = equal.reshape(len(p), -1, ROWS).all(axis=2)
                    alive &= ~whole[:, : max(0, band - n // ROWS)].any(axis=1)
                p, q, matches = p[alive], q[alive], matches[alive]
                if not len(p):
                    break
            if len(p):
                out.append(np.stack([p + at, q], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 1], root[pairs[:, 0]])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _cells(threshold: float, tolerance: float):
    fewest = least_matches(threshold, tolerance)

    def one(cell: pd.DataFrame, out: list[pd.DataFrame]) -> None:
        cell = cell.sort_values(["rep", "k1"], kind="stable")
        ids, keys, weight, side = (cell[c].to_numpy() for c in ("rep", "k1", "copies", "side"))
        sets = [np.frombuffer(x, dtype=U64) for x in cell["grams"]]
        sigs = np.stack([np.frombuffer(x, dtype=np.uint32) for x in cell["sig"]])
        band = int(cell["key"].iat[0] & (BANDS - 1))
        if (side == 2).all():
            pairs = _candidates(sigs, sigs, True, band, fewest)
        else:
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            pairs = _candidates(sigs[x], sigs[y], False, band, fewest)
            pairs = np.stack([x[pairs[:, 0]], y[pairs[:, 1]]], axis=1)
        pairs = pairs[_verified(pairs, sets, threshold)]
        if not len(pairs):
            return
        links = np.bincount(pairs[:, 0], weight[pairs[:, 1]], len(ids)) + np.bincount(pairs[:, 1], weight[pairs[:, 0]], len(ids))
        partners = np.bincount(pairs.ravel(), minlength=len(ids))
        hit = np.flatnonzero(partners)
        root = _roots(len(ids), pairs)[hit]  # (rep, k1) ascend with the index
        out.append(pd.DataFrame({"rep": ids[hit], "k1": keys[hit], "root": ids[root], "root_k1": keys[root], "linked": links[hit].astype(np.int64), "partners": partners[hit]}))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        names = ["key", "ci", "cj"]
        for part in parts:
            if not len(part):
                continue
            rest.append(part)
            last = tuple(part[names].iloc[-1])
            if tuple(rest[0][names].iloc[0]) == last:
                continue
            whole = pd.concat(rest)
            code = whole[names].to_numpy()
            cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1).tolist()]
            out: list[pd.DataFrame] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                one(whole.iloc[a:b], out)
            rest = [whole.iloc[cuts[-1] :]]
            if out:
                yield pd.concat(out)
        if rest:
            out = []
            one(pd.concat(rest), out)
            yield from out

    return run


def jaccard_join(
    docs: DataFrame, threshold: float = 0.8, ngram: int = 5, tolerance: float = 1e-7, chunk: int = CHUNK, leaders: bool = False
) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id reachable by links), copy_id (least doc_id with an equal shingle set),
    n_links (other documents at the threshold or above, copies included), n_partners (different texts among them), n_shingles.

    With leaders also tag (xxhash64 of the text) and leads: whether the row is the first of its class by (doc_id, set, tag); what links with nothing leads.
    A class in this code is told by its least doc_id and k1, as a doc_id may come with several texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    digest = materialize(
        texts.mapInArrow(_digest(ngram), "doc_id long, tag long, k1 long, k2 long, n_shingles long, bands array<long>"), "digest"
    )
    able = digest.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(
        able.groupBy("k1", "k2")
        .agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.count("*").alias("copies"))
        .select("k1", "k2", F.col("first.doc_id").alias("rep"), F.col("first.tag").alias("tag"), "copies"),
        "classes",
    )
    reps = able.withColumnRenamed("doc_id", "rep").join(classes, ["k1", "k2", "rep", "tag"]).dropDuplicates(["rep", "k1", "k2"])
    banded = reps.select("rep", "k1", "copies", F.explode("bands").alias("key"))
    buckets = (
        banded.groupBy("key")
        .agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("rep", "k1")).alias("f1"),
            F.bit_xor(F.xxhash64("rep", "k1", F.lit(1))).alias("f2"),
        )
        .where("n > 1")
        .groupBy("n", "f1", "f2")  # bands with the same members: the first will do
        .agg(F.min(F.struct(F.expr(f"key & {BANDS - 1}"), "key")).alias("x"))
        .select(F.col("x.key").alias("key"), F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    )
    members = materialize(
        banded.join(buckets, "key").withColumn("own", F.expr("cast(pmod(xxhash64(rep, k1, key), chunks) as int)")), "members"
    )
    wanted = members.select("rep").distinct()
    few = members.agg(F.approx_count_distinct("rep").alias("n")).first().n <= BROADCAST_IDS
    payload = (
        texts.join(F.broadcast(wanted) if few else wanted, texts.doc_id == wanted.rep, "left_semi")
        .mapInArrow(_payload(ngram), "rep long, k1 long, grams binary, sig binary")
        .dropDuplicates(["rep", "k1"])
    )
    cells = members.select(
        "key", "rep", "k1", "copies", "own", F.explode(F.expr("sequence(0, chunks - 1)")).alias("other")
    ).select(
        "key",
        F.least("own", "other").alias("ci"),
        F.greatest("own", "other").alias("cj"),
        "rep",
        "k1",
        "copies",
        F.expr("cast(CASE WHEN own = other THEN 2 WHEN own < other THEN 0 ELSE 1 END AS int)").alias("side"),
    )
    linked = materialize(
        cells.join(payload, ["rep", "k1"])
        .repartition("key", "ci", "cj")
        .sortWithinPartitions("key", "ci", "cj")
        .mapInPandas(_cells(threshold, tolerance), "rep long, k1 long, root long, root_k1 long, linked long, partners long"),
        "linked",
    )
    sums = linked.groupBy("rep", "k1").agg(F.sum("linked").alias("linked"), F.sum("partners").alias("n_partners"))
    node = [F.struct(F.col(a).alias("rep"), F.col(b).alias("k1")) for a, b in (("rep", "k1"), ("root", "root_k1"))]
    roots = components(linked.select(node[0].alias("a"), node[1].alias("b"))).select("node.rep", "node.k1", "root")
    known = (
        classes.join(sums, ["rep", "k1"], "left")
        .join(roots, ["rep", "k1"], "left")
        .select(
            "k1",
            "k2",
            F.col("rep").alias("copy_id"),
            F.coalesce("root.rep", "rep").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("n_partners", F.lit(0)).cast("long").alias("n_partners"),
            F.when(F.col("root").isNull() | (F.col("root") == F.struct("rep", "k1")), F.col("tag")).alias("lead"),
        )
    )
    columns = ["doc_id", "class_id", "copy_id", "n_links", "n_partners", "n_shingles", *(["tag", "leads"] if leaders else [])]
    alone = digest.where("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id",
        F.col("doc_id").alias("class_id"),
        F.col("doc_id").alias("copy_id"),
        F.lit(0).cast("long").alias("n_links"),
        F.lit(0).cast("long").alias("n_partners"),
        "n_shingles",
        "tag",
        F.lit(True).alias("leads"),
    )
    leads = F.coalesce((F.col("doc_id") == F.col("copy_id")) & (F.col("tag") == F.col("lead")), F.lit(False))
    every = able.drop("bands").join(known, ["k1", "k2"]).withColumn("leads", leads)
    return every.select(columns).unionByName(alone.select(columns))


#: The exact join by shared shingles.
SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
s AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b, x.size + y.size - shared = shared AS same FROM s JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE shared >= 0.8 * (x.size + y.size - shared)),
copy AS (SELECT n.doc_id, least(n.doc_id, coalesce(min(e.b), n.doc_id)) AS copy_id FROM n LEFT JOIN e ON e.a = n.doc_id AND e.same GROUP BY n.doc_id),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT e.a, count(*) AS n_links, count(DISTINCT y.copy_id) FILTER (WHERE y.copy_id <> x.copy_id) AS n_partners
      FROM e JOIN copy x ON x.doc_id = e.a JOIN copy y ON y.doc_id = e.b GROUP BY e.a)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, coalesce(copy_id, w.doc_id) AS copy_id,
       coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_partners, 0)::BIGINT AS n_partners, coalesce(size, 0)::BIGINT AS n_shingles
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN copy ON copy.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id LEFT JOIN l ON l.a = w.doc_id
"""
