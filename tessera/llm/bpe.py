"""Byte-level BPE over overlapping chunks.

Texts over ``chunk`` characters are cut into chunks that overlap their next one.
Each chunk is pre-tokenised on its own, in parallel; a pre-token boundary that a
chunk and its predecessor both have inside their overlap is where the two agree
from then on (a match depends only on what follows its start), and the text is
cut there. From the first overlap without a shared boundary on, the rest of the
text stays one piece, so the result is exact for any text. Then the pieces are
encoded in parallel, and their ids and decoded bytes concatenated in order in one
pass. Shorter texts are one piece.

Defined results: a null text counts as empty and gives no ids; repeated rows
each keep their row; a null doc_id is kept; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.scratch import materialize, ship, small_batches

ship(__name__)

CHUNK, OVERLAP = 32_768, 1_024
_loaded: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks file: a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _loaded:
        import tiktoken

        _loaded[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _loaded[path, pattern]


def boundaries(text: str, pattern: str, whole: bool) -> list[int]:
    """Ends of the settled pre-tokens that don't end in white space, as places to cut.

    Of a text that goes on (whole False) a match at its very end may change and
    doesn't count. After white space a cut would hide what a look-ahead sees.
    """
    import regex

    n = len(text)
    return [e for m in regex.finditer(pattern, text) if ((e := m.end()) < n or whole) and not text[e - 1].isspace()]


def _edges(pattern: str, chunk: int, overlap: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            heads, tails = [], []
            for k, more, text in zip(
                part.column("k").to_pylist(), part.column("more").to_pylist(), part.column("chunk").to_pylist(), strict=True
            ):
                ends = boundaries(text, pattern, not more)
                heads.append([k * chunk + e for e in [0, *ends] if e < overlap])
                tails.append([k * chunk + e for e in ends if e >= chunk])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("k"), pa.array(heads, kind), pa.array(tails, kind)], names=["row", "k", "head", "tail"]
            )

    return run


def _chunks(chunk: int, overlap: int):
    """row, k, more, chunk: the chunks of each text, cut in one pass over it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True):
                n = -(-len(text) // chunk)
                for at in range(0, n, 64):
                    ks = range(at, min(n, at + 64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(ks)),
                            pa.array(ks, pa.int32()),
                            pa.array([(k + 1) * chunk + overlap < len(text) for k in ks]),
                            pa.array([text[k * chunk : (k + 1) * chunk + overlap] for k in ks]),
                        ],
                        names=["row", "k", "more", "chunk"],
                    )

    return run


def _pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row, piece_no, piece: the stretches of each text, cut in one pass over it."""
    for part in parts:
        for doc, row, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row", "text", "spans")), strict=True):
            for at in range(0, len(spans), 64):
                own = spans[at : at + 64]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc] * len(own), pa.int64()),
                        pa.array([row] * len(own)),
                        pa.array(range(at, at + len(own)), pa.int32()),
                        pa.array([text[s["begin"] : s["until"]] for s in own], pa.string()),
                    ],
                    names=["doc_id", "row", "piece_no", "piece"],
                )


def _encode(path: str, pattern: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for part in parts:
            ids, decoded = [], []
            for text in part.column("piece").to_pylist():
                own = encoder.encode_ordinary(text or "")
                ids.append(np.array(own, dtype="<u4").tobytes())
                decoded.append(encoder.decode_bytes(own))
            names = [n for n in part.schema.names if n != "piece"]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in names), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                names=[*names, "ids", "decoded"],
            )

    return run


def _decode(path: str, pattern: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for part in parts:
            raw = [None if x is None else encoder.decode_bytes(np.frombuffer(x, dtype="<u4").tolist()) for x in part.column("ids").to_pylist()]
            names = part.schema.names
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds decoded, the raw bytes of the column ids (little-endian unsigned 32-bit)."""
    return encoded.mapInArrow(_decode(path, pattern), StructType(list(encoded.schema.fields)).add("decoded", "binary"))


def pieces_of_long(docs: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, row, piece_no, piece) of a table (doc_id, row, text) of long texts; row is unique."""
    chunks = docs.select("row", "text").mapInArrow(_chunks(chunk, overlap), "row string, k int, more boolean, chunk string")
    # dealt anew, so that the chunks of one text are cut in parallel
    edges = chunks.repartition("row", "k").mapInArrow(_edges(pattern, chunk, overlap), "row string, k int, head array<long>, tail array<long>")
    w = Window.partitionBy("row").orderBy("k")
    cuts = (
        edges.withColumn("cut", F.expr("array_min(array_intersect(head, lag(tail) OVER (PARTITION BY row ORDER BY k)))"))
        .withColumn("cut", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.col("cut")))
        # a chunk that never met its predecessor can't vouch for the next one
        .withColumn("met", F.expr("bool_and(cut IS NOT NULL) OVER (PARTITION BY row ORDER BY k)"))
        .where("met")
        .withColumn("until", F.lead("cut").over(w))
        .select("row", F.col("cut").alias("begin"), "until")
    )
    # a cut comes once: where an overlap spans several chunks, two chunks may name the same boundary
    cuts = cuts.where("until IS NULL OR until > begin")
    spans = cuts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "until"))).alias("spans"))
    return docs.join(spans, "row").select("doc_id", "row", "text", "spans").mapInArrow(_pieces, "doc_id long, row string, piece_no int, piece string")


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded (raw bytes) of each whole text."""
    spark = docs.sparkSession
    small_batches(spark, 512)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = texts.where(F.length("text") <= chunk).select("doc_id", F.col("text").alias("piece")).mapInArrow(
        _encode(path, pattern), "doc_id long, ids binary, decoded binary"
    )
    long = materialize(texts.where(F.length("text") > chunk).withColumn("row", F.expr("uuid()")), "long-texts")
    pieces = pieces_of_long(long, pattern, chunk, overlap).repartition("row", "piece_no")
    parts = pieces.mapInArrow(
        _encode(path, pattern), "doc_id long, row string, piece_no int, ids binary, decoded binary"
    )
    whole = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *(F.expr(f"listagg({c}) WITHIN GROUP (ORDER BY piece_no)").alias(c) for c in ("ids", "decoded")),
    )
    whole = whole.select("doc_id", *(F.coalesce(c, F.lit(b"")).alias(c) for c in ("ids", "decoded")))
    return short.unionByName(whole)


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
