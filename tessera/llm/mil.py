"""Quality classifier: gated-attention multiple-instance learning over passages.

A text is a bag of passages of ``PASSAGE`` words (the last one may be shorter).
Each passage gives a feature vector of byte statistics; a learned tanh layer
encodes it, a learned gate (tanh times sigmoid) weighs it by a softmax over the
bag, and the weighted sum of the encodings is scored by a logistic unit. Only
document labels are needed. Training runs on the driver over at most ``sample``
labelled documents, the ones with the least hash of doc_id among those offered,
and of these over as many, in that order, as hold ``most_passages`` passages
together (a document that doesn't fit is passed over, so the driver's memory is
bounded; both bounds are the same at every size). Scoring runs over every passage
of every text on the executors. Nothing but the text enters a score.

Defined results: empty, blank and null texts are a bag of one passage without
words and get that bag's score; repeated rows each keep their row, and of a
doc_id with several texts the one with the least hash is trained on; of
contradicting labels for a doc_id the least counts; a null doc_id is scored and
never trained on (held_out null); without labels of both classes every score is
the share of label 1 (0.5 without any labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm import textnp
from tessera.llm.names import quoted
from tessera.scratch import materialize, ship, small_batches

ship(__name__)

PASSAGE = 64
PAIR_BUCKETS = 96
SAMPLE, MOST_PASSAGES = 5000, 100_000
HIDDEN, GATE = 24, 12
#: The fixed byte classes: every printable ASCII character that isn't a letter or digit has one of its own.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    for c in range(256):
        if c in MARKS:
            table[c] = 6 + MARKS.index(c)
        elif chr(c).isascii() and chr(c).isupper():
            table[c] = 1
        elif chr(c).isascii() and chr(c).islower():
            table[c] = 2
        elif chr(c).isascii() and chr(c).isdigit():
            table[c] = 3
        elif c >= 0x80:
            table[c] = 4
        elif c == 0x0A:
            table[c] = 5
    return table


CLASSES = 6 + len(MARKS)
FEATURES = CLASSES + PAIR_BUCKETS + 7


def _pair_buckets() -> np.ndarray:
    """A bucket for each pair of bytes, upper case folded to lower case."""
    fold = np.arange(256)
    fold[65:91] += 32
    pair = fold[:, None] * 256 + fold[None, :]
    return (textnp.mix(pair.astype(np.uint64).ravel() * textnp.BASE) % np.uint64(PAIR_BUCKETS)).astype(np.int64)


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, first passage of each text and the total)."""
    starts, ends, first = textnp.words(raw, offsets)
    per_text = np.maximum(1, -(-(first[1:] - first[:-1]) // PASSAGE))
    bag = np.concatenate(([0], np.cumsum(per_text)))
    n = int(bag[-1])
    x = np.zeros((n, FEATURES))
    if not len(starts):
        return x, bag
    text = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    of_word = bag[text] + (np.arange(len(starts)) - first[text]) // PASSAGE
    head = np.flatnonzero(np.concatenate(([True], of_word[1:] != of_word[:-1])))
    full, begin = of_word[head], starts[head]
    m = len(full)
    # a passage reaches from its first word to the next passage's or the end of its text; other bytes are no one's
    sizes = np.minimum(np.append(begin[1:], len(raw)), offsets[text[head] + 1]) - begin
    stretches = np.stack([sizes, np.append(begin[1:], len(raw)) - begin - sizes], axis=1).ravel()
    owners = np.stack([np.arange(m), np.full(m, -1)], axis=1).ravel()
    of_byte = np.concatenate((np.full(begin[0], -1), np.repeat(owners, stretches)))
    mine = of_byte >= 0
    counts = np.bincount(of_byte[mine] * CLASSES + _byte_classes()[raw[mine]], minlength=m * CLASSES).reshape(m, CLASSES)
    both = mine[:-1] & (of_byte[:-1] == of_byte[1:])
    pairs = _pair_buckets()[raw[:-1][both].astype(np.int64) * 256 + raw[1:][both]]
    grams = np.bincount(of_byte[:-1][both] * PAIR_BUCKETS + pairs, minlength=m * PAIR_BUCKETS).reshape(m, PAIR_BUCKETS)
    words = np.diff(np.append(head, len(starts)))
    hashes = textnp.word_hashes(raw, starts, ends)
    order = np.lexsort((hashes, of_word))
    same = (of_word[order][1:] == of_word[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    repeats = np.bincount(np.searchsorted(full, of_word[order][1:][same]), minlength=m)
    lengths = (ends - starts).astype(np.float64)
    letters = np.add.reduceat(lengths, head)
    spread = np.sqrt(np.maximum(np.add.reduceat(lengths**2, head) / words - (letters / words) ** 2, 0))
    top = np.maximum.reduceat(lengths, head)
    # the share of words in capitals: two ASCII capitals or more, no small letter
    capitals = np.add.reduceat(((raw >= 0x41) & (raw <= 0x5A)).astype(np.int64), starts)
    small = np.add.reduceat(((raw >= 0x61) & (raw <= 0x7A)).astype(np.int64), starts)
    upper = np.add.reduceat(((capitals >= 2) & (small == 0)).astype(np.float64), head)
    x[full] = np.concatenate(
        [
            np.sqrt(counts / np.maximum(sizes, 1)[:, None]),
            np.sqrt(grams / np.maximum(sizes, 1)[:, None]),
            np.stack([letters / words / 10, spread / 10, np.log1p(top) / 5, np.log1p(words) / 5, repeats / words, upper / words, np.log1p(sizes) / 8], axis=1),
        ],
        axis=1,
    )
    return x, bag


class Model:
    """Encoder (w, b), gate (v, u, a), logistic output (c, d) over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        sizes = np.diff(bag)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bag[:-1]), sizes))
        alpha = e / np.repeat(np.add.reduceat(e, bag[:-1]), sizes)
        z = np.add.reduceat(alpha[:, None] * h, bag[:-1], axis=0)
        return {"h": h, "t": t, "g": g, "alpha": alpha, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))}

    def score(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(bag) - 1, float(self.mean[0]))
        out = np.empty(len(bag) - 1)
        a = 0
        while a < len(bag) - 1:  # bounded slices of whole bags
            b = max(a + 1, int(np.searchsorted(bag, bag[a] + 20_000, "right")) - 1)
            out[a:b] = self.forward((x[bag[a] : bag[b]] - self.mean) * self.scale, bag[a : b + 1] - bag[a])["y"]
            a = b
        return out

    def gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p, f, sizes = self.weights, self.forward(x, bag), np.diff(bag)
        dy = (f["y"] - y) / len(y)
        dz = np.repeat(dy[:, None] * p["c"], sizes, axis=0)
        dalpha = (dz * f["h"]).sum(axis=1)
        inner = np.repeat(np.add.reduceat(dalpha * f["alpha"], bag[:-1]), sizes)
        de = f["alpha"] * (dalpha - inner)
        dtg = de[:, None] * p["a"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = dz * f["alpha"][:, None] + dt @ p["v"].T + dg @ p["u"].T
        dpre = dh * (1 - f["h"] ** 2)
        out = {
            "w": x.T @ dpre, "b": dpre.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg,
            "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(),
        }
        return {k: g + decay * p[k] * (k in "wc") for k, g in out.items()}


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 24, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, seed: int = 11) -> Model:
    """Adam over mini-batches of bags; the same input gives the same model."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.array([labels.mean() if len(labels) else 0.5]), np.ones(1), {})
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), 1 / np.maximum(every.std(axis=0), 1e-3)
    bags = [(b - mean) * scale for b in bags]
    r = np.random.default_rng(seed)
    shape = {"w": (FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": ()}
    model = Model(mean, scale, {k: r.normal(0, 1 / np.sqrt(s[0]) if len(s) else 0.0, s) * (k != "b") for k, s in shape.items()})
    m = {k: np.zeros(s) for k, s in shape.items()}
    v = {k: np.zeros(s) for k, s in shape.items()}
    step = 0
    steps = epochs * -(-len(bags) // batch)
    for _ in range(epochs):
        order = r.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            bag = np.concatenate(([0], np.cumsum([len(bags[i]) for i in pick])))
            g = model.gradient(np.concatenate([bags[i] for i in pick]), bag, labels[pick], decay)
            step += 1
            now = rate * (1 - step / (steps + 1))
            for k in g:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                model.weights[k] = model.weights[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _sizes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        out = np.zeros(part.num_rows, dtype=np.int64)
        for a, b, raw, offsets in textnp.batches(part.column("text")):
            _, _, first = textnp.words(raw, offsets)
            out[a:b] = np.maximum(1, -(-(first[1:] - first[:-1]) // PASSAGE))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), pa.array(out)], names=["doc_id", "tag", "n"])


def _features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        out = []
        for _, _, raw, offsets in textnp.batches(part.column("text")):
            x, bag = passages(raw, offsets)
            out += [x[a:b].astype(np.float32).tobytes() for a, b in zip(bag[:-1], bag[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bag"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_passages: int = MOST_PASSAGES) -> Model:
    """Train on docs (doc_id, text) and labels (doc_id, label 0 or 1), within the bounds on documents and on passages."""
    small_batches(docs.sparkSession)
    clean = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    # at most ``sample`` rows: the order is by hash, so the choice doesn't depend on partitions
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.col("text").cast("string")
    # the rows of these documents only
    rows = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))
        .join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"),
        "labelled",
    )
    least = (
        rows.mapInArrow(_sizes, "doc_id long, tag long, n long")
        .groupBy("doc_id")
        .agg(F.min(F.struct("tag", "n")).alias("x"))
        .join(F.broadcast(chosen), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .select("doc_id", "x.tag", "x.n", "label")
        .collect()
    )
    taken, room = [], most_passages
    for x in least:
        if x.n <= room:
            taken.append((x.doc_id, x.tag, x.label))
            room -= x.n
    # at most ``sample`` rows again
    few = docs.sparkSession.createDataFrame(taken, "doc_id long, tag long, label int")
    found = (
        rows.join(F.broadcast(few), ["doc_id", "tag"], "left_semi")
        .dropDuplicates(["doc_id"])
        .mapInArrow(_features, "doc_id long, bag binary")
        .collect()
    )
    bags = {x.doc_id: np.frombuffer(x.bag, dtype=np.float32).reshape(-1, FEATURES).astype(np.float64) for x in found}
    return train([bags[d] for d, _, _ in sorted(taken)], np.array([float(y) for _, _, y in sorted(taken)]))


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """All columns of docs and the column ``into`` with the score; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name.lower() != into.lower()]
    flat = (model.mean, model.scale, model.weights)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*flat)
        for part in parts:
            out = np.zeros(part.num_rows)
            for a, b, raw, offsets in textnp.batches(part.column("text").cast(pa.string())):
                out[a:b] = own.score(*passages(raw, offsets))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], names=[*part.schema.names, into])

    names = [F.col(quoted(f.name)) for f in fields]
    return docs.select(names).mapInArrow(run, StructType(fields).add(into, "double"))


def held_out(doc_id):
    """The fold that labels are never learned from: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cutoff: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    offered = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    model = fit(docs, offered, sample)
    return score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted")
    )
