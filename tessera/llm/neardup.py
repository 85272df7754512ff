"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative per group.

Centroids are fitted on at most ``sample`` vectors (the least hashes of vec_id)
and SAMPLE_BYTES. Every vector has one home cell, its nearest centroid's, and
visits each further cell that can hold a vector linked with it, by two bounds:
beyond the bisector of two centroids the best cosine is sqrt(1 - s^2), s being
the vector's distance from it; and no vector of a cell is further from its
centroid than the cell's radius, so the vector may be at most that and the
threshold's angle away. Two cells meet in the vectors that each may send to the
other, and every pair is compared once. No link is lost, whatever the centroids.
Cells are dealt to groups of ``block`` vectors and compared group by group: in
single precision with a margin for its rounding, then the pairs found in double.
What two cells have in common (or a cell with itself) and would take more than
``SPLIT`` groups is clustered again, by centroids of its own and the same bounds,
level after level, so that what a vector is compared with follows the cells near
it and not the number of vectors; only what no centroids can part is dealt to
blocks at any size.
Equal vectors are collapsed before, and a block gives one row for each vector
with links, never its pairs.

Vectors are compared only where labels are equal (as text) and not null, and
lengths are equal. Defined results: vectors that are null, empty, zero or hold
null or non-finite components, and rows without vec_id, link with nothing
(n_links 0, component_id their own vec_id, kept true); repeated rows, also of one
vec_id with different vectors or labels, count as other vectors; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera.llm.components import components
from tessera.llm.jaccard import _roots
from tessera.scratch import materialize, ship, small_batches

ship(__name__)

SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
BLOCK = 4_096
CELL = 4_096
MOST_CELLS = 1_024
#: What takes more groups than this is clustered again, on about so many vectors of it.
SPLIT, FIT = 16, 8_192


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """k unit centroids of unit vectors; empty cells are given the vectors that fit worst."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = np.flatnonzero(np.linalg.norm(total, axis=1) < 1e-9)
        if len(empty):
            total[empty] = x[np.argsort((x * c[near]).sum(axis=1))[: len(empty)]]
        c = total / np.linalg.norm(total, axis=1, keepdims=True)
    return c


def _vectors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components' bytes of each vector that can be compared, else null."""
    for part in parts:
        column = part.column("embedding")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        values = column.values.to_numpy(zero_copy_only=False)  # null components are NaN
        at = column.offsets.to_numpy()
        bad, some = (np.concatenate(([0], np.cumsum(x))) for x in (~np.isfinite(values), values != 0))
        able = column.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
        out = [values[x:y].tobytes() if ok else None for x, y, ok in zip(at[:-1], at[1:], able, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "vector"])


def units(vectors: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors of one length, in double precision; scaled first, so that no square over- or underflows."""
    x = np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _place(centroids: np.ndarray, threshold: float, kind: str):
    reach = np.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9
    gap = np.sqrt(np.maximum(2 - 2 * (centroids @ centroids.T), 0)) if len(centroids) else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            home, own = np.zeros(len(part), dtype=np.int32), np.ones(len(part))
            visits: list[list[dict]] = [[{"cell": 0, "dot": 1.0}]] * len(part)
            known = np.flatnonzero((part["dim"] == (centroids.shape[1] if len(centroids) else -1)).to_numpy())
            if len(known):
                dots = units([part["vector"].iat[i] for i in known], kind) @ centroids.T
                best = dots.argmax(axis=1)
                home[known], own[known] = best, dots[np.arange(len(known)), best]
                seen = own[known][:, None] - dots <= reach * gap[best] + 1e-12
                for i, row, dot in zip(known, seen, dots, strict=True):
                    visits[i] = [{"cell": int(c), "dot": float(dot[c])} for c in np.flatnonzero(row)]
            yield part.assign(home=home, own=own, visits=visits)

    return run


def linked_pairs(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i of x, j of y) with a cosine of at least threshold, in slices; with same, x is y and i < j."""
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    least = np.float32(threshold - 1e-6 - 2e-7 * x.shape[1])  # a margin for single precision
    for a in range(0, len(x), 512):
        i, j = np.nonzero(x32[a : a + 512] @ y32.T >= least)
        i += a
        if same:
            i, j = i[i < j], j[i < j]
        for b in range(0, len(i), 1 << 16):
            p, q = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
            sure = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
            if sure.any():
                yield p[sure], q[sure]


def _compare(threshold: float, kind: str):
    def one(block: pd.DataFrame, out: list[pd.DataFrame]) -> None:
        block = block.sort_values(["rep", "tag"], kind="stable")
        ids, tags, weight, role = (block[c].to_numpy() for c in ("rep", "tag", "copies", "role"))
        left, right = (np.arange(len(ids)),) * 2 if (role == 2).all() else (np.flatnonzero(role == 0), np.flatnonzero(role == 1))
        if not len(left) or not len(right):
            return
        all_units = units(block["vector"].tolist(), kind)
        linked, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for i, j in linked_pairs(all_units[left], all_units[right], left is right, threshold):
            i, j = left[i], right[j]
            np.add.at(linked, i, weight[j])
            np.add.at(linked, j, weight[i])
            # so far's groups and the new pairs; indices ascend with (rep, tag)
            root = _roots(len(ids), np.concatenate([np.stack([np.arange(len(ids)), root], axis=1), np.stack([i, j], axis=1)]))
        hit = np.flatnonzero(linked)
        if len(hit):
            out.append(pd.DataFrame({"rep": ids[hit], "tag": tags[hit], "root": ids[root[hit]], "root_tag": tags[root[hit]], "linked": linked[hit]}))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["block"]
        rest: list[pd.DataFrame] = []
        for part in parts:
            if not len(part):
                continue
            rest.append(part)
            if tuple(rest[0][names].iloc[0]) == tuple(part[names].iloc[-1]):
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


def fit_centroids(reps: DataFrame, n: int, n_labels: int, dim: int, kind: str, sample: int = SAMPLE) -> np.ndarray:
    """Centroids for the most frequent vector length; the number of cells follows the number of vectors per label. dim: the greatest length."""
    most = max(1, min(sample, SAMPLE_BYTES // (8 * max(1, dim))))
    drawn = [bytes(r.vector) for r in reps.orderBy(F.xxhash64("rep"), "rep", "tag").select("vector").limit(most).collect()]
    if not drawn:
        return np.zeros((0, 0))
    lengths, counts = np.unique([len(v) for v in drawn], return_counts=True)
    x = units([v for v in drawn if len(v) == lengths[counts.argmax()]], kind)
    k = min(MOST_CELLS, max(2, -(-n // (max(1, n_labels) * CELL))), max(1, len(x) // 8))
    return spherical_kmeans(x, k)


def _fit_set(kind: str):
    def run(group: pa.Table) -> pa.Table:
        x = units(group.column("vector").to_pylist(), kind)
        k = min(MOST_CELLS, max(2, -(-group.column("n")[0].as_py() // CELL)), max(1, len(x) // 8))
        return pa.table({"set": group.column("set").slice(0, 1), "centroids": pa.array([spherical_kmeans(x, k).tobytes()], pa.binary())})

    return run


def _place_sets(threshold: float, kind: str):
    """home, own and visits of the rows of each set, whose centroids come before them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, centroids, place = None, b"", None
        for part in parts:
            out = []
            for name, rows in part.groupby("set", sort=False):
                if name != now:
                    now, centroids, place = name, b"", None
                heads = rows["centroids"].notna()
                if heads.any():
                    centroids = rows.loc[heads, "centroids"].iat[0]
                rows = rows[~heads]
                if len(rows):
                    dim = len(rows["vector"].iat[0]) // np.dtype(kind).itemsize
                    place = place or _place(np.frombuffer(centroids, dtype=np.float64).reshape(-1, dim), threshold, kind)
                    out += list(place(iter([rows.assign(dim=dim)])))
            if out:
                yield pd.concat(out)[["set", "rep", "tag", "copies", "vector", "role", "home", "own", "visits"]]

    return run


def _set_blocks(rows: DataFrame, block: int) -> DataFrame:
    """block, rep, tag, copies, vector, role of sets (with n, their size) that are compared block by block: among themselves (role 2), or role 0 with role 1."""
    both, mine, other = F.col("role") == 2, F.col("mine"), F.col("other")
    dealt = (
        rows.withColumn("groups", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("mine", F.expr("cast(pmod(xxhash64(rep, tag), groups) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, groups - 1)")))
    )
    ahead = F.when(both, mine <= other).otherwise(F.col("role") == 0)
    name = F.when(ahead, F.concat_ws(".", mine, other)).otherwise(F.concat_ws(".", other, mine))
    return dealt.select(
        F.concat_ws("|", F.lit("set"), "set", name).alias("block"), "rep", "tag", "copies", "vector",
        F.when(both, F.when(mine == other, 2).when(mine < other, 0).otherwise(1)).otherwise(F.col("role")).alias("role"),
    )


def split_sets(sets: DataFrame, threshold: float, kind: str, block: int = BLOCK) -> DataFrame:
    """_set_blocks() of sets (set, rep, tag, copies, vector, role) of any size, after clustering those that are too large level by level.

    A linked pair meets in the set of its two cells, as each of its vectors visits
    the other one's. A set from which no level takes a tenth of its vectors is
    dealt to blocks as it is.
    """
    theta = float(np.arccos(min(1.0, max(-1.0, threshold))))
    angle = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c))))
    left, out = sets.withColumn("parent", F.lit(None).cast("long")), []
    while True:
        left = materialize(left, "sets")
        sides = [F.count_if(F.col("role") != r).alias(f"side{r}") for r in (1, 0)]
        sizes = left.groupBy("set").agg(F.count("*").alias("n"), F.max("parent").alias("whole"), *sides).where("side0 > 0 AND side1 > 0")
        sizes = materialize(sizes.select("set", "n", (F.coalesce(F.col("n") > 0.9 * F.col("whole"), F.lit(False)) | (F.col("n") <= SPLIT * block)).alias("last")), "set-sizes")
        sized = left.drop("parent").join(sizes, "set")
        out.append(_set_blocks(sized.where("last").drop("last"), block))
        if sizes.where("NOT last").isEmpty():
            return reduce(DataFrame.unionByName, out)
        rest = sized.where("NOT last").drop("last")
        drawn = F.expr(f"pmod(xxhash64(rep, tag, 7), greatest(1, cast(ceil(n / {FIT}) as int))) = 0")
        fitted = materialize(rest.where(drawn).select("set", "n", "vector").groupBy("set").applyInArrow(_fit_set(kind), "set string, centroids binary"), "set-centroids")
        # the rows of a set go to several tasks, each of which gets its centroids first
        share = F.ceil(F.col("n") / (SPLIT * block)).cast("int")
        own = rest.withColumn("part", F.expr(f"cast(pmod(xxhash64(rep, tag, 3), ceil(n / {SPLIT * block})) as int)")).withColumn("centroids", F.lit(None).cast("binary"))
        heads = fitted.join(sizes, "set").withColumn("part", F.explode(F.sequence(F.lit(0), share - 1)))
        # no nulls, which would turn whole numbers into floating ones
        heads = heads.select("set", "part", "centroids", *(F.lit(0).cast(f.dataType).alias(f.name) for f in own.schema.fields if f.name in ("rep", "tag", "copies", "role")), F.lit(b"").alias("vector"))
        stream = own.select(heads.columns).unionByName(heads).repartition("set", "part").sortWithinPartitions("set", "part", F.col("centroids").isNull())
        schema = "set string, rep long, tag long, copies long, vector binary, role int, home int, own double, visits array<struct<cell: int, dot: double>>"
        placed = materialize(stream.mapInPandas(_place_sets(threshold, kind), schema), "set-places")
        edges = placed.groupBy("set", F.col("home").alias("cell")).agg(F.min("own").alias("edge"))
        same, both = F.col("home") == F.col("cell"), F.col("role") == 2
        visits = placed.select("*", F.explode("visits").alias("v")).select("set", "rep", "tag", "copies", "vector", "role", "home", F.col("v.cell").alias("cell"), F.col("v.dot").alias("dot"))
        kept = visits.join(edges, ["set", "cell"]).where(same | (angle("dot") <= angle("edge") + theta + 1e-6)).join(sizes.select("set", F.col("n").alias("parent")), "set")
        ahead = F.when(both, F.col("home") <= F.col("cell")).otherwise(F.col("role") == 0)
        left = kept.select(
            F.concat_ws("/", "set", F.when(ahead, F.concat_ws(".", "home", "cell")).otherwise(F.concat_ws(".", "cell", "home"))).alias("set"), "rep", "tag", "copies", "vector",
            F.when(both, F.when(same, 2).when(F.col("home") < F.col("cell"), 0).otherwise(1)).otherwise(F.col("role")).alias("role"), "parent",
        )


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per vector."""
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    single = vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull)
    kind = "<f4" if single else "<f8"
    found = materialize(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("label").cast("string").alias("label"),
            F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"),
        )
        .mapInArrow(_vectors, "vec_id long, label string, vector binary")
        .select("*", F.xxhash64("vector").alias("k1"), F.xxhash64("vector", F.lit(1)).alias("k2")),
        "vectors",
    )
    usable = F.col("vector").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    able = found.where(usable)
    # equal vectors of a label are one class, told by its least vec_id and tag, as a vec_id may come with several vectors
    classes = ["label", "k1", "k2"]
    reps = materialize(
        able.groupBy(classes)
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
        .withColumn("tag", F.xxhash64(*classes))
        .withColumn("dim", (F.octet_length("vector") / np.dtype(kind).itemsize).cast("int")),
        "reps",
    )
    n, n_labels, dim = reps.agg(F.count("*"), F.count_distinct("label"), F.coalesce(F.max("dim"), F.lit(0))).first()
    centroids = fit_centroids(reps, n, n_labels, dim, kind, sample)
    placed = materialize(
        reps.select("rep", "tag", "copies", "label", "dim", "vector").mapInPandas(
            _place(centroids, threshold, kind),
            "rep long, tag long, copies long, label string, dim int, vector binary, home int, own double, visits array<struct<cell: int, dot: double>>",
        ),
        "placed",
    )
    key = ["label", "dim"]
    cells = materialize(
        placed.groupBy(*key, "home").agg(F.ceil(F.count("*") / block).cast("int").alias("groups"), F.min("own").alias("edge")), "cells"
    )
    theta = float(np.arccos(min(1.0, max(-1.0, threshold))))
    angle = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c))))
    same = F.col("cell") == F.col("home")
    mine, theirs = F.col("mine"), F.col("theirs")
    met = (
        placed.join(cells.select(*key, "home", "groups"), [*key, "home"])
        .withColumn("mine", F.expr("cast(pmod(xxhash64(rep, tag), groups) as int)"))
        .select("*", F.explode("visits").alias("visit"))
        .select(*key, "rep", "tag", "copies", "vector", "home", "mine", "groups", F.col("visit.cell").alias("cell"), F.col("visit.dot").alias("dot"))
        .join(cells.select(*key, F.col("home").alias("cell"), F.col("groups").alias("others"), "edge"), [*key, "cell"])
        .where(same | (angle("dot") <= angle("edge") + theta + 1e-6))
    )
    large = F.greatest("groups", "others") > SPLIT
    dealt = (
        met.where(~large)
        .withColumn("theirs", F.explode(F.expr("sequence(0, others - 1)")))
        .withColumn("first", F.when(same, mine <= theirs).otherwise(F.col("home") < F.col("cell")))
        .select(
            # what the two groups have in common: a hash would do for dealing but not for telling blocks apart
            F.concat_ws(
                "|", F.when(F.col("first"), F.concat_ws(".", "home", mine, "cell", theirs)).otherwise(F.concat_ws(".", "cell", theirs, "home", mine)), "dim", "label"
            ).alias("block"),
            "rep",
            "tag",
            "copies",
            "vector",
            F.when(same & (mine == theirs), 2).when(F.col("first"), 0).otherwise(1).alias("role"),
        )
    )
    if not cells.where(F.col("groups") > SPLIT).isEmpty():
        pair = F.concat_ws(".", F.least("home", "cell"), F.greatest("home", "cell"), "dim", "label")
        role = F.when(same, 2).when(F.col("home") < F.col("cell"), 0).otherwise(1)
        sets = met.where(large).select(pair.alias("set"), "rep", "tag", "copies", "vector", role.alias("role"))
        dealt = dealt.unionByName(split_sets(sets, threshold, kind, block))
    linked = materialize(
        dealt.repartition("block").sortWithinPartitions("block").mapInPandas(_compare(threshold, kind), "rep long, tag long, root long, root_tag long, linked long"),
        "links",
    )
    sums = linked.groupBy("rep", "tag").agg(F.sum("linked").alias("linked"))
    node = [F.struct(F.col(a).alias("rep"), F.col(b).alias("tag")) for a, b in (("rep", "tag"), ("root", "root_tag"))]
    roots = components(linked.select(node[0].alias("a"), node[1].alias("b"))).select("node.rep", "node.tag", "root")
    known = (
        reps.select(*classes, "rep", "tag", "copies")
        .join(sums, ["rep", "tag"], "left")
        .join(roots, ["rep", "tag"], "left")
        .select(*classes, (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root.rep", "rep").alias("component_id"))
    )
    alone = found.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        able.join(known, classes)
        .select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS norm FROM v
      WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      AND a.norm > 0 AND b.norm > 0 AND list_inner_product(a.x, b.x) >= 0.93 * a.norm * b.norm),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(l.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN l ON l.a = vec_id
"""
