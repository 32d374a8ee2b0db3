"""Quality classifier: random-indexing word vectors and a two-layer network.

Every word and symbol run falls into one of ``SLOTS`` hashed slots, and each slot
has a sparse random index vector.  A slot's word vector is the sum of the index
vectors around all its occurrences in all documents; tasks add up their own
matrices, and these are summed block by block in a tree, so that what a task reads
and what is broadcast has a fixed size.  A document's features are the mean of its word vectors, the
mean's length and the logarithm of its number of words.  A numpy network with one
hidden layer is fitted on at most ``MAX_ROWS`` labelled rows (smallest hashes of the
ids); a temperature, fitted on a part it has not seen, calibrates its probabilities.

Only the text is an input of a score.  Ids with crc32(id as text) mod 5 = 0 are held
out.  Null and empty texts have zero features and get the network's score for them.
Rows with a null label are not learned from; with no labelled row, or one class
only, the score is the smoothed share of label 1.  A row in, a row out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm import common as C
from langmix.llm.decontaminate import pack, unpack
from langmix.llm.text import MULT, PUNCT, SPACE, buffers, mix, tokens

SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
DIM = 32
NONZERO = 2
REACH = 2
BLOCKS = 16
MAX_ROWS = 20_000
HIDDEN = 32
EPOCHS = 40
PREDICT = 0.3
SYMBOLS = bytes(b for b in PUNCT if b > 0x20 and b != 0x7F)
_STEP = 1 << 18


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def slots_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slot of every word and symbol run, first of each text)."""
    _, _, h, first = tokens(*buffers(col), SPACE, symbols=SYMBOLS)
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), first


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(dimension, sign) of each slot's nonzero entries."""
    r = mix(np.arange(1, SLOTS * NONZERO + 1, dtype=np.uint64) * MULT).reshape(NONZERO, SLOTS)
    return (r % np.uint64(DIM)).astype(np.int64), np.where(r >> np.uint64(63), 1.0, -1.0)


def add_contexts(total: np.ndarray, slot: np.ndarray, first: np.ndarray) -> None:
    """Add the index vectors of each word's neighbours to its slot's row."""
    dims, signs = index_vectors()
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for at in range(0, len(slot), _STEP):
        a, t = slot[at:at + _STEP + REACH], text[at:at + _STEP + REACH]
        for o in range(1, REACH + 1):
            n = min(_STEP, len(a) - o)
            if n <= 0:
                continue
            ok = t[:n] == t[o:n + o]
            x, y = a[:n][ok], a[o:n + o][ok]
            for k in range(NONZERO):
                total += np.bincount(x * DIM + dims[k, y], signs[k, y], SLOTS * DIM)
                total += np.bincount(y * DIM + dims[k, x], signs[k, x], SLOTS * DIM)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(SLOTS x DIM) unit vectors learned from all documents; slots without any
    neighbour stay zero."""
    C.prepare(docs.sparkSession)

    def run(batches):
        total = np.zeros(SLOTS * DIM)
        for batch in batches:
            for b in C.pieces(batch, "text"):
                add_contexts(total, *slots_of(b.column(0)))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"key": pa.array(range(BLOCKS), pa.int32()), "part": pa.array([part] * BLOCKS, pa.int32()),
                                          "m": pa.array([pack(x) for x in total.astype(np.int64).reshape(BLOCKS, -1)], pa.binary())})

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key int, part int, m binary")
    out = np.zeros((BLOCKS, SLOTS * DIM // BLOCKS))
    for k, x in C.add_up(parts, BLOCKS, lambda m: unpack(m, np.int64), pack).items():
        out[k] = x
    out = out.reshape(SLOTS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(vectors: np.ndarray, col: pa.Array) -> np.ndarray:
    """(texts x DIM + 2) features."""
    slot, first = slots_of(col)
    n = np.diff(first)
    total = np.zeros((len(n), DIM))
    for at in range(0, len(slot), _STEP):
        to = min(len(slot), at + _STEP)
        own = np.arange(np.searchsorted(first, at, "right") - 1, np.searchsorted(first, to))
        own = own[n[own] > 0]
        total[own] += np.add.reduceat(vectors[slot[at:to]], np.maximum(first[own] - at, 0), axis=0)
    mean = total / np.maximum(n, 1)[:, None]
    return np.column_stack([mean, np.linalg.norm(mean, axis=1), np.log1p(n)])


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam on the logistic loss; every sixth row is left for the temperature."""
    width = DIM + 2
    if len(np.unique(y)) < 2:
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    keep = np.arange(len(y)) % 6 == 5
    if len(np.unique(y[keep])) < 2:
        keep[:] = False
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, t = ((x - shift) / scale)[~keep], y[~keep]
    p = [rng.standard_normal((width, hidden)) / np.sqrt(width), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for rows in np.array_split(order, max(1, len(t) // 128)):
            a = np.tanh(z[rows] @ p[0] + p[1])
            r = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - t[rows]) / len(rows)
            back = np.outer(r, p[2]) * (1 - a * a)
            grad = [z[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), a.T @ r + 1e-4 * p[2], np.array([r.sum()])]
            step += 1
            for k, g in enumerate(grad):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    net = Network(shift, scale, *p[:3], float(p[3][0]))
    if keep.any():
        logit, t = net.logit(x[keep]), y[keep]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.mean(np.logaddexp(0, np.where(t > 0, -logit, logit) / k)) for k in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def learn(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label_col: str = "quality", max_rows: int = MAX_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> Network:
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = (labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"))
              .where("_id is not null and _y is not null").where(~held_out("_id"))
              .orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id", "_y").limit(max_rows))

    def run(batches):
        for batch in batches:
            for b in C.pieces(batch, "text"):
                x = pooled(sent.value, b.column(2))
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([r.tobytes() for r in x], pa.binary())], ["_id", "_y", "x"])

    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    found = text.join(F.broadcast(sample), "_id").select("_id", "_y", "text").mapInArrow(run, "_id long, _y int, x binary")
    # an id may stand at several texts: the bound holds for what is learned from
    got = found.orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id", F.xxhash64("x")).limit(max_rows).toArrow().to_pydict()
    order = sorted(range(len(got["_id"])), key=lambda k: (got["_id"][k] * 2654435761 % (1 << 32), got["_id"][k], got["x"][k]))
    x = np.frombuffer(b"".join(got["x"][k] for k in order)).reshape(-1, DIM + 2)
    return fit_network(x, np.array([got["_y"][k] for k in order], float))


def with_score(docs: DataFrame, vectors: np.ndarray, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches):
        for batch in batches:
            for b in C.pieces(batch, "text"):
                v, n = sent.value
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(n.score(pooled(v, b.column(2))))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= PREDICT).cast("int")))


def op8_quality(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    vectors = word_vectors(docs)
    return with_score(docs, vectors, learn(docs, C.table(spark, sf_dir, "labels"), vectors))
