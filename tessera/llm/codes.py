"""Vector code compression: product codes by k-means over columnar NumPy part blocks.

Components become integers floor(``SCALE`` * x), and vectors are cut into
``PARTS`` equal consecutive parts. Executors turn Arrow batches into part blocks
of at most ``BLOCK`` vectors, one array per dimension, which are written once.
In each round the codebooks (at most 256 entries a part, whatever the input) are
broadcast; a task adds up squared distances dimension by dimension, takes the
nearest entry (ties: the lower index) and adds the block to int64 sum and count
tensors with np.add.at. RDD.treeAggregate merges the tensors, with a depth that
leaves the driver ``FAN_IN`` of them whatever the number of partitions. All
arithmetic is exact: 32-bit integers where the largest component proves that no
distance overflows, else 64-bit, else Python's integers.

Defined results: vectors that are null or hold null or non-finite components are
dropped; the codebooks start from the rows with the least (vec_id, vector), so
repeated rows count repeatedly and a null vec_id starts none; the dimension is
the most frequent length that PARTS divides (ties: the greater one), and vectors
of another length (or with no vec_id in the table to start a codebook) get a null
code and error; an error beyond a long is null; rows of a null label
are summed together; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.scratch import materialize, release, ship, small_batches

ship(__name__)

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK = 1024
FAN_IN = 16
#: Label sums are broadcast up to so many labels, and joined by a shuffle beyond.
BROADCAST_LABELS = 50_000


def integers(x: np.ndarray, kind: str) -> np.ndarray:
    """floor(SCALE * x), exactly."""
    if kind == "object":
        ratios = [v.as_integer_ratio() for v in x.ravel().tolist()]
        out = np.empty(len(ratios), dtype=object)
        out[:] = [n * SCALE // d for n, d in ratios]
        return out.reshape(x.shape)
    return np.floor(x * SCALE).astype(kind)


def kind_for(largest: float, width: int) -> str:
    """The narrowest integer type that holds any squared distance of a part of width components."""
    if not math.isfinite(largest * SCALE):
        return "object"
    most = width * (2 * (math.floor(largest * SCALE) + 1)) ** 2
    return "int32" if most < 2**31 else "int64" if most < 2**62 else "object"


def nearest(columns: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to each vector's nearest entry; columns is (width, vectors), entries (entries, width)."""
    far = np.zeros((columns.shape[1], len(entries)), dtype=columns.dtype)
    for column, values in zip(columns, entries.T, strict=True):
        gap = column[:, None] - values[None, :]
        gap *= gap
        far += gap
    at = far.argmin(axis=1)
    return at, far[np.arange(len(at)), at]


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _blocks(dim: int, kind: str):
    """part, n, data: blocks of each part, dimension after dimension (Python's integers as decimal text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a in range(0, batch.num_rows, BLOCK):
                x = integers(_dense(batch.column("x").slice(a, BLOCK), dim), kind).T.reshape(PARTS, dim // PARTS, -1)
                data = [" ".join(map(str, p.ravel().tolist())).encode() if kind == "object" else p.tobytes() for p in x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(PARTS), pa.int32()), pa.array([x.shape[2]] * PARTS, pa.int32()), pa.array(data, pa.binary())], names=["part", "n", "data"]
                )

    return run


def _columns(data: bytes, n: int, kind: str) -> np.ndarray:
    flat = np.array([int(v) for v in bytes(data).split()], dtype=object) if kind == "object" else np.frombuffer(data, dtype=kind)
    return flat.reshape(-1, n)


def _tensors(books, kind: str):
    """What treeAggregate folds a block into, and how it merges two tensors; None stands for zeros."""
    wide = object if kind == "object" else np.int64

    def fold(acc, row):
        entries = books.value
        if acc is None:
            acc = np.zeros(entries.shape, dtype=wide), np.zeros(entries.shape[:2], dtype=np.int64)
        columns = _columns(row["data"], row["n"], kind)
        at, _ = nearest(columns, entries[row["part"]])
        np.add.at(acc[0][row["part"]], at, columns.T.astype(wide))
        np.add.at(acc[1][row["part"]], at, 1)
        return acc

    def merge(a, b):
        return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

    return fold, merge


def train(vectors: DataFrame, starts: np.ndarray, kind: str, rounds: int = ROUNDS) -> np.ndarray:
    """(PARTS, entries, width) codebooks after the rounds; starts holds the first ones, vectors has x of one length."""
    spark = vectors.sparkSession
    width = starts.shape[2]
    stored = materialize(vectors.select("x").mapInArrow(_blocks(width * PARTS, kind), "part int, n int, data binary"), "blocks")
    rows = stored.rdd
    # as deep as it takes to send the driver FAN_IN tensors
    depth = max(2, math.ceil(math.log(max(2, rows.getNumPartitions()), FAN_IN)))
    books = starts
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        fold, merge = _tensors(sent, kind)
        sums, counts = rows.treeAggregate(None, fold, merge, depth)
        used = counts > 0
        books = books.copy()
        books[used] = (sums[used] // counts[used][:, None]).astype(books.dtype)
        sent.destroy()
    release(stored)
    return books


def _encode(books: np.ndarray, kind: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = books.shape[0] * books.shape[2]
        for batch in parts:
            for a in range(0, batch.num_rows, BLOCK):
                own = batch.slice(a, BLOCK)
                x = integers(_dense(own.column("x"), dim), kind).T.reshape(PARTS, books.shape[2], -1)
                found = [nearest(columns, entries) for columns, entries in zip(x, books, strict=True)]
                codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
                errors = [e if (e := sum(map(int, far))) < 2**63 else None for far in zip(*(far for _, far in found), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [own.column("vec_id"), own.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors, pa.int64())],
                    names=["vec_id", "label", "code", "error"],
                )

    return run


def kept(table: DataFrame) -> DataFrame:
    """vec_id, label and x (array<double>) of the vectors with finite components."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x"))


def compress(table: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of each kept vector; the codebooks). At most 256 entries, so that an index takes a byte."""
    small_batches(table.sparkSession, 8 * BLOCK)
    rows = kept(table)
    size = F.size("x")
    most = (
        rows.where((size > 0) & (size % PARTS == 0)).groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest"))
        .orderBy(F.desc("n"), F.desc("size")).first()
    )
    uncoded = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    dim = most["size"] if most else 0
    fits = rows.where(size == dim)
    first = [r["x"] for r in fits.where("vec_id IS NOT NULL").orderBy("vec_id", "x").limit(entries).collect()] if dim else []
    if not first:
        return uncoded, np.zeros((PARTS, 0, dim // PARTS), dtype=np.int64)
    width = dim // PARTS
    kind = kind_for(most["largest"], width)
    starts = np.ascontiguousarray(integers(np.array(first), kind).reshape(-1, PARTS, width).transpose(1, 0, 2))
    books = train(fits, starts, kind, rounds)
    schema = StructType([*rows.drop("x").schema.fields, *uncoded.select("code", "error").schema.fields])
    return fits.mapInArrow(_encode(books, kind), schema).unionByName(uncoded.where(size != dim)), books


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([entries[i] for entries, i in zip(books, bytes.fromhex(code), strict=True)]).astype(np.float64) / SCALE


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept vector."""
    found, books = compress(table)
    coded = materialize(found, "codes")
    sums = materialize(
        coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")), "label-errors"
    )
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    part = "x[part * len(x) // 4 + 1:(part + 1) * len(x) // 4]"
    distance = "(list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v))::BIGINT"
    rounds = "".join(
        f"""a{t} AS MATERIALIZED (SELECT p.r, p.part, min(struct_pack(far := {distance}, entry := c.entry)) AS m FROM p JOIN c{t} c ON c.part = p.part GROUP BY p.r, p.part),
"""
        + (
            f"""s{t} AS (SELECT part, entry, i, floor(sum(y) / count(*)) AS y FROM (
  SELECT p.part, a.m.entry AS entry, unnest(p.v) AS y, unnest(range(len(p.v))) AS i FROM p JOIN a{t} a ON a.r = p.r AND a.part = p.part) GROUP BY ALL),
n{t} AS (SELECT part, entry, list(y ORDER BY i) AS v FROM s{t} GROUP BY part, entry),
c{t + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.v, c.v) AS v FROM c{t} c LEFT JOIN n{t} n ON n.part = c.part AND n.entry = c.entry),
"""
            if t < ROUNDS
            else ""
        )
        for t in range(ROUNDS + 1)
    )
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, part, {part} AS v FROM k, (SELECT unnest(range(4)) AS part)),
c0 AS MATERIALIZED (SELECT part, entry, v FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p) WHERE entry < 256),
{rounds}e AS (SELECT r, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.far)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
b AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(v) AS y, unnest(range(len(v))) AS i FROM c{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN e ON e.r = k.r, b
"""


SQL = _sql()
