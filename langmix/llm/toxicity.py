"""Toxicity by a classifier chain.

The categories are 0/1 label columns in a given order.  Each has a linear
(logistic) model over how often words, beginnings of words (for inflected and
compound forms) and symbol runs occur in a text; the models of later categories
also get the earlier categories' probabilities.  In training these are out-of-fold
predictions, so a later model never sees an earlier one's answer for a row that
it was fitted on.

Training uses at most ``MAX_ROWS`` labelled rows (the smallest hashes of the ids,
so the same rows each time); of these, ids with crc32(id as text) mod 5 = 0 are
held out for measuring.  Only hashed counts of the sample reach the driver, a part
after the other; they lie in a scratch file there and each step of the fit reads them
a block at a time, so the driver's memory does not grow with how long the texts are.
All documents are scored where they are read, without a shuffle.

Null and empty texts have no features and get the models' base rate.  Rows with a
null label, or without a document, are not learned from; without any labelled row
nothing is rejected.  A row in, a row out, repeated rows included.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langmix.llm import common as C
from langmix.llm.text import PUNCT, buffers, byte_codes, mix, powers, tokens

MAX_ROWS = 8000
MIN_DOCS = 4
FOLDS = 3
L2 = 0.05
STEPS = 150
#: a document is rejected from this probability on
REJECT = 0.3
#: slots of the hashed feature space, and the bytes of a word's beginning
SLOTS = 1 << 20
BEGINNINGS = (4, 6)
#: a feature's value is its share of the text's words in this unit; a text of
#: fewer words than SHORT counts as one of SHORT, lest one word decide
UNIT = 0.01
SHORT = 60
#: entries of the sample that the driver holds at once (those of one row at least)
BLOCK = 1 << 17
#: parts in which the sample comes to the driver
PARTS = 32
#: a feature (its slot, or its number among the known ones) and its value in a row
ENTRY = np.dtype([("at", np.int32), ("value", np.float32)])
#: the labels table's categories, in the order of the chain
CATEGORIES = ("low_quality", "toxic")
#: everything but ASCII punctuation parts symbol runs
NOT_SYMBOL = bytes(b for b in range(256) if b >= 128 or b < 0x21 or b == 0x7F or chr(b).isalnum())


def features(buf: np.ndarray, off: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(slots, begin of each text's)] for each kind of feature, words of each text).
    A word that is repeated on the spot counts once."""
    s, e, h, first = tokens(buf, off, PUNCT, fold_case=True)
    kinds = [(h, first)]
    codes, p = byte_codes(True), powers(max(BEGINNINGS) + 1)[0]
    acc, size = np.zeros(len(s), np.uint64), e - s
    for j in range(max(BEGINNINGS)):
        if j in BEGINNINGS:
            kinds.append(_beginning(acc, size > j, first, j))
        x = codes[buf[np.minimum(s + j, len(buf) - 1)]] if len(s) else acc
        acc = acc + x * p[j]
    kinds.append(_beginning(acc, size > max(BEGINNINGS), first, max(BEGINNINGS)))
    _, _, g, begin = tokens(buf, off, NOT_SYMBOL)
    kinds = [_once(_slot(k), f) for k, f in kinds]
    return [*kinds, (_slot(mix(g)), begin)], np.diff(kinds[0][1])


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _once(slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.ones(len(slots), bool)
    keep[1:] = slots[1:] != slots[:-1]
    keep[first[:-1][np.diff(first) > 0]] = True
    return slots[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def _beginning(acc: np.ndarray, longer: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    before = np.concatenate([[0], np.cumsum(longer)])
    return mix(acc[longer] + np.uint64(n)), before[first]


#: (first row, end, row of each entry counted from the first, feature, value)
Block = tuple[int, int, np.ndarray, np.ndarray, np.ndarray]


class Rows:
    """Sparse rows in a scratch file of this process, read as blocks any number of times."""

    def __init__(self) -> None:
        self.file, self.sizes = tempfile.TemporaryFile(), []

    def extend(self, at: np.ndarray, value: np.ndarray, sizes: Iterable[int]) -> None:
        """Rows that have ``sizes`` of the entries each."""
        x = np.empty(len(at), ENTRY)
        x["at"], x["value"] = at, value
        self.file.write(x.tobytes())
        self.sizes.extend(sizes)

    def __iter__(self) -> Iterator[Block]:
        ends = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        self.file.seek(0)
        first = 0
        while first < len(self.sizes):
            end = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK, "right")) - 1)
            x = np.frombuffer(self.file.read(int(ends[end] - ends[first]) * ENTRY.itemsize), ENTRY)
            yield (first, end, np.repeat(np.arange(end - first), np.diff(ends[first:end + 1])),
                   x["at"].astype(np.intp), x["value"].astype(float))
            first = end


def logit_fit(blocks: Iterable[Block], dense: np.ndarray, y: np.ndarray, size: int, use: np.ndarray | None = None,
              l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on sparse rows and dense columns (the last one constant):
    (weights, dense weights), by accelerated gradient descent.  With ``use`` only
    these rows count.  Sums run through the blocks in the order of the entries, so
    they do not depend on how the rows are cut."""
    use = np.ones(len(y), bool) if use is None else use
    dense, target, y = dense[use], y, y[use]
    prior = (y.sum() + 1e-3) / (len(y) + 1.0)
    w, v = np.zeros(size), np.zeros(dense.shape[1])
    v[-1] = np.log(prior / (1 - prior))
    if len(np.unique(y)) < 2:
        return w, v
    n = len(y)
    # each feature's own curvature bounds its step
    hw = np.zeros(size)
    for first, end, owner, idx, val in blocks:
        np.add.at(hw, idx, val * val * use[first:end][owner])
    hw = hw / (4 * n) * 8 + l2 / n * 8 + 1e-9
    hv = (dense * dense).mean(axis=0) * 2 + 1e-9
    pw, pv = w.copy(), v.copy()
    base, r = np.zeros(len(use)), np.zeros(len(use))
    for k in range(steps):
        m = k / (k + 3)
        aw, av = w + m * (w - pw), v + m * (v - pv)
        base[use] = dense @ av
        slope = np.zeros(size)
        for first, end, owner, idx, val in blocks:
            z = np.bincount(owner, aw[idx] * val, end - first) + base[first:end]
            r[first:end] = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[first:end]) / n * use[first:end]
            np.add.at(slope, idx, r[first:end][owner] * val)
        pw, pv = w, v
        w = aw - (slope + l2 / n * aw) / hw
        v = av - (dense.T @ r[use]) / hv
    return w, v


@dataclass
class Chain:
    names: tuple[str, ...]
    weights: list[np.ndarray]
    dense: list[np.ndarray]

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts x categories) probabilities, one category after the other."""
        kinds, words = features(buf, off)
        n = len(off) - 1
        odds = np.zeros((n, len(self.names)))
        unit = np.maximum(words, SHORT) * UNIT
        for k, (w, v) in enumerate(zip(self.weights, self.dense)):
            z = np.zeros(n)
            for slots, begin in kinds:
                z += np.diff(np.concatenate([[0.0], np.cumsum(w[slots], dtype=np.float64)])[begin])
            odds[:, k] = np.clip(z / unit + np.column_stack([sigmoid(odds[:, :k]), np.ones(n)]) @ v, -30, 30)
        return sigmoid(odds)


def sigmoid(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


def fit_chain(idx: np.ndarray, val: np.ndarray, owner: np.ndarray, y: np.ndarray, names: tuple[str, ...],
              size: int, folds: int = FOLDS) -> tuple[list, list]:
    """``fit_blocks`` on rows in memory: features, their values and rows."""
    return fit_blocks([(0, len(y), owner, idx, val)], y, names, size, folds)


def fit_blocks(blocks: Iterable[Block], y: np.ndarray, names: tuple[str, ...], size: int, folds: int = FOLDS) -> tuple[list, list]:
    """y: (texts x categories).  Each category's out-of-fold probabilities become a
    feature of the later categories' models.  (weights, dense weights) by category."""
    n = len(y)
    fold = np.arange(n) % folds
    seen = np.zeros((n, 0))
    weights, dense = [], []
    for k in range(len(names)):
        x = np.column_stack([seen, np.ones(n)])
        w, v = logit_fit(blocks, x, y[:, k], size)
        weights.append(w)
        dense.append(v)
        out = np.zeros(n)
        for f in range(folds if k + 1 < len(names) else 0):
            w, v = logit_fit(blocks, x, y[:, k], size, fold != f)
            z = x @ v
            for first, end, owner, idx, val in blocks:
                z[first:end] += np.bincount(owner, w[idx] * val, end - first)
            out[fold == f] = z[fold == f]
        seen = np.column_stack([seen, sigmoid(np.clip(out, -30, 30))])
    return weights, dense


def learn(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] = CATEGORIES, max_rows: int = MAX_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit the chain on a bounded sample; ``labels`` has the id and a 0/1 column per category."""
    C.prepare(docs.sparkSession)
    held = F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(5)) == 0
    full = F.lit(True)
    for c in names:
        full = full & F.col(f"y_{c}").isNotNull()
    sample = (labels.select(F.col(id_col).cast("long").alias("_id"), *[F.col(c).cast("int").alias(f"y_{c}") for c in names])
              .where(full & F.col("_id").isNotNull() & ~held)
              .orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id", *[f"y_{c}" for c in names]).limit(max_rows))
    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    rows = text.join(F.broadcast(sample), "_id").select("_id", *[f"y_{c}" for c in names], "text")

    def run(batches):
        for batch in batches:
            for b in C.pieces(batch, "text"):
                kinds, words = features(*buffers(b.column(b.num_columns - 1)))
                slots, values = [], []
                for k in range(b.num_rows):
                    u, c = np.unique(np.concatenate([x[f[k]:f[k + 1]] for x, f in kinds]), return_counts=True)
                    slots.append(u.astype(np.int32).tobytes())
                    values.append((c / (max(words[k], SHORT) * UNIT)).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    b.columns[:-1] + [pa.array(slots, pa.binary()), pa.array(values, pa.binary())],
                    [*b.schema.names[:-1], "slots", "values"])

    found = rows.mapInArrow(run, "_id long, " + ", ".join(f"y_{c} int" for c in names) + ", slots binary, values binary")
    # an id may stand at several texts: the bound holds for what is learned from
    order = F.xxhash64("slots", "values")
    got = C.ckpt(found.orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id", order).limit(max_rows))
    raw, y, texts = Rows(), [], np.zeros(SLOTS, np.int32)
    for r in got.repartitionByRange(PARTS, "_id").sortWithinPartitions("_id", "slots", order).toLocalIterator():
        slots = np.frombuffer(r["slots"], np.int32)
        raw.extend(slots, np.frombuffer(r["values"], np.float32), [len(slots)])
        y.append([r[f"y_{c}"] for c in names])
        texts[slots] += 1  # each once in a row
    keep = texts >= MIN_DOCS
    number = np.cumsum(keep, dtype=np.int32) - 1
    known = Rows()
    for first, end, owner, slots, values in raw:
        some = keep[slots]
        known.extend(number[slots[some]], values[some], np.bincount(owner[some], minlength=end - first))
    weights, dense = fit_blocks(known, np.array(y, float).reshape(len(y), len(names)), names, int(keep.sum()))
    spread = [np.zeros(SLOTS, np.float32) for _ in names]
    for w, small in zip(spread, weights):
        w[keep] = small
    return Chain(tuple(names), spread, dense)


def with_scores(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` and a probability column (prefix + category) for each category, in
    place of any column of that name."""
    C.prepare(docs.sparkSession)
    docs = docs.drop(*[prefix + c for c in chain.names])
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [prefix + c for c in chain.names]

    def run(batches):
        for batch in batches:
            for b in C.pieces(batch, text_col):
                p = sent.value.score(*buffers(b.column(b.schema.get_field_index(text_col))))
                yield pa.RecordBatch.from_arrays(b.columns + [pa.array(p[:, k]) for k in range(len(names))], b.schema.names + names)

    kinds = [*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]]
    return docs.mapInArrow(run, T.StructType(kinds))


def categories(labels: DataFrame) -> DataFrame:
    """The labels table as the chain's categories."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))


def op5_toxicity(spark, sf_dir):
    """doc_id, a probability for each category, toxic (the last one's is REJECT or more)."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = learn(docs, categories(C.table(spark, sf_dir, "labels")))
    scored = with_scores(docs, chain)
    return scored.select("doc_id", *[F.col(f"p_{c}") for c in CATEGORIES], (F.col("p_toxic") >= REJECT).alias("toxic"))
