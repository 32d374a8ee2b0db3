"""Brown class-based n-gram scoring.

1. Documents become blocks of hashed tokens (one pass over the text, written once).
2. Word counts over all training documents: every block sends its distinct words and
   counts to the words' partitions, whose totals come back to the block.  A word that
   is everywhere costs one entry per block.
3. Exchange clustering: the ``OWN`` most frequent words are units of their own, all
   others are tied by their endings at first.  One pass counts unit bigrams (a matrix
   of fixed size, summed block by block); units are then moved, one after the other,
   to the class that most increases the mutual information of adjacent classes, until
   no unit moves or after ``SWEEPS``.  Then every other training word meets in its
   partition with the classes before and after all its occurrences and moves to the
   class that gains most by the same criterion.  Endings decide for unseen words alone:
   the class where most training words of the ending are.
4. The score of a text is the sum of log10 P(class | class before) P(word | class).
   Emissions use absolute discounting, and what it frees goes to the class's unknown
   words; transitions are smoothed with the classes' shares.  The end token also
   precedes the first word.

Tokens: words (maximal runs outside space and \\t\\n\\v\\f\\r, A-Z lower-cased), then one
end.  Training documents are those whose crc32(id as text) mod 7 is not 2; a null id
counts as training.  Null texts are empty (one end token).  Repeated rows count as
often as they occur.  Without any training token all scores are 0.  Words are told
apart by 64-bit hashes.  Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm import common as C
from langmix.llm.text import SPACE, buffers, byte_codes, mix, tokens

HELD = 2
FOLD = 7
OWN = 512
ENDINGS = 1024
ENDING_BYTES = 3
UNITS = OWN + ENDINGS
CLASSES = 64
SWEEPS = 12
PRIOR = 5.0
BLOCK_BYTES = 4 << 20
ROW_BLOCKS = 16
END = np.uint64(0x1D)

BLOCK = "block long, ids array<bigint>, held binary, sizes binary, local binary, words binary, endings binary"


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed (small numbers take little room)."""
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _unpack(b: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(b[8:], n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).reshape(-1)


def token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written once: a row for each few megabytes of documents."""
    C.prepare(docs.sparkSession)

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        codes = byte_codes(True)
        for batch in batches:
            for b in C.pieces(batch, "text", BLOCK_BYTES):
                buf, off = buffers(b.column(2))
                s, e, h, first = tokens(buf, off, SPACE, fold_case=True)
                size = np.diff(first) + 1
                stop = np.cumsum(size) - 1
                is_end = np.zeros(int(size.sum()), bool)
                is_end[stop] = True
                seq = np.full(len(is_end), END, np.uint64)
                seq[~is_end] = h
                words, at, local = np.unique(seq, return_index=True, return_inverse=True)
                # endings of the distinct words, from one place where each occurs
                place = np.zeros(len(seq), np.int64)
                place[~is_end] = np.arange(len(h))
                s1, e1 = (s[place[at]], e[place[at]]) if len(s) else (np.zeros(len(at), np.int64),) * 2
                tail = np.zeros(len(words), np.uint64)
                for j in range(1, ENDING_BYTES + 1):
                    x = codes[buf[np.maximum(e1 - j, 0)]] if len(buf) else tail
                    tail = np.where(e1 - s1 >= j, mix(tail + x), tail)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([part << 32 | k]), "ids": pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())),
                    "held": [np.array(b.column(1).to_pylist(), bool).tobytes()], "sizes": [_pack(size.astype(np.int64))],
                    "local": [_pack(local.astype(np.uint32))], "words": [words.tobytes()],
                    "endings": [_pack((tail % np.uint64(ENDINGS)).astype(np.uint16))]})
                k += 1

    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLD)) == HELD, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    return C.ckpt(rows.mapInArrow(run, BLOCK))


#: what learning reads of a block
COLS = ["block", "held", "sizes", "local", "words", "endings"]


class Block:
    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.held = np.frombuffer(row["held"], bool)
        self.sizes = _unpack(row["sizes"], np.int64)
        self.local = _unpack(row["local"], np.uint32)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.endings = _unpack(row["endings"], np.uint16)

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)

    def times(self) -> np.ndarray:
        """How often each distinct word occurs in the block's training documents."""
        return np.bincount(self.local[self.training()], minlength=len(self.words)).astype(np.uint32)

    def units(self, own: np.ndarray) -> np.ndarray:
        """The unit of each distinct word; ``own``: sorted hashes of the words
        that are units of their own (number 0 is the end token)."""
        at = np.minimum(np.searchsorted(own, self.words), len(own) - 1) if len(own) else np.zeros(len(self.words), np.int64)
        mine = own[at] == self.words if len(own) else np.zeros(len(self.words), bool)
        unit = np.where(mine, at + 1, OWN + self.endings.astype(np.int64))
        unit[self.words == END] = 0
        return unit


def _deal(words: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words by partition: (their order, where each partition's begin)."""
    p = (words >> np.uint64(24)) % np.uint64(groups)
    order = np.argsort(p, kind="stable")
    return order, np.searchsorted(p[order], np.arange(groups + 1, dtype=np.uint64))


def word_totals(blocks: DataFrame) -> DataFrame:
    """Written once: what each partition of the words found (its most frequent words,
    [tokens, types, types seen once, twice]) in training documents."""
    groups = C.parts(blocks.sparkSession)

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block({**row, "ids": None})
                n = b.times()
                order, cut = _deal(b.words, groups)
                rows = [(k, order[a:z]) for k, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
                yield pa.RecordBatch.from_pydict({
                    "p": pa.array([k for k, _ in rows], pa.int32()),
                    "words": pa.array([b.words[o].tobytes() for _, o in rows], pa.binary()),
                    "counts": pa.array([_pack(n[o]) for _, o in rows], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        words, at = np.unique(np.frombuffer(b"".join(t.column("words").to_pylist()), np.uint64), return_inverse=True)
        n = np.bincount(at, np.concatenate([_unpack(x, np.uint32) for x in t.column("counts").to_pylist()]), len(words)).astype(np.int64)
        top = np.lexsort((words, -n))[:OWN + 1]
        top = top[(n[top] > 0) & (words[top] != END)]
        return pa.table({"words": [words[top].tobytes()], "counts": [n[top].tobytes()],
                         "sums": pa.array([[int(n.sum()), int((n > 0).sum()), int((n == 1).sum()), int((n == 2).sum())]], pa.list_(pa.int64()))})

    sent = blocks.select(*COLS).mapInArrow(send, "p int, words binary, counts binary")
    return C.ckpt(sent.groupBy("p").applyInArrow(add, "words binary, counts binary, sums array<bigint>"))


def frequent(totals: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of the OWN - 1 most frequent words, their counts)."""
    def flat(batches):
        best = np.zeros((2, 0), np.int64)  # of all partitions that this task reads
        for b in batches:
            rows = np.stack([np.frombuffer(b"".join(c.to_pylist()), np.int64) for c in b.columns])
            best = np.concatenate([best, rows], axis=1)
            best = best[:, np.lexsort((best[0], -best[1]))[:OWN - 1]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["word", "n"])

    top = (totals.select("words", "counts").mapInArrow(flat, "word long, n long")
           .orderBy(F.desc("n"), "word").limit(OWN - 1).collect())
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([r["n"] for r in top], np.int64)[order]


def corpus_sums(totals: DataFrame) -> tuple[int, int, int, int]:
    """(tokens, types, types seen once, types seen twice) of the training documents."""
    r = totals.agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(4)]).first()
    return tuple(map(int, r))


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of packed rows (m) of ``size`` counts.  Every task sums what it reads, before
    and after a shuffle; at most ROW_BLOCKS rows of a fixed size reach the driver."""
    def add(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for m in b.column(0).to_pylist():
                total += _unpack(m, np.int64)
        yield pa.RecordBatch.from_pydict({"m": [_pack(total)]})

    got = rows.select("m").mapInArrow(add, "m binary").repartition(ROW_BLOCKS).mapInArrow(add, "m binary").collect()
    return sum((_unpack(r["m"], np.int64) for r in got), np.zeros(size, np.int64))


def bigrams(blocks: DataFrame, own: np.ndarray) -> np.ndarray:
    """(UNITS x UNITS) counts of adjacent units in training documents; the end
    unit stands before the first word."""
    size = UNITS * UNITS

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                b = Block({**row, "ids": None})
                seq = b.units(own)[b.local]
                before = np.concatenate([[0], seq[:-1]])  # after an end comes a text's first word
                ok = b.training()
                total += np.bincount(before[ok] * UNITS + seq[ok], minlength=size)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"key": pa.array(range(ROW_BLOCKS), pa.int32()), "part": pa.array([part] * ROW_BLOCKS, pa.int32()),
                                          "m": pa.array([_pack(x) for x in total.reshape(ROW_BLOCKS, -1)], pa.binary())})

    # a matrix of fixed size: ROW_BLOCKS rows
    out = np.zeros((ROW_BLOCKS, size // ROW_BLOCKS))
    for k, x in C.add_up(blocks.select(*COLS).mapInArrow(run, "key int, part int, m binary"), ROW_BLOCKS,
                         lambda m: _unpack(m, np.int64), _pack).items():
        out[k] = x
    return out.reshape(UNITS, UNITS)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(b: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit.  Every unit, the most frequent first, moves to the class
    with the largest sum of N log N over class bigrams less that over the classes."""
    units = len(b)
    often = b.sum(axis=1) + b.sum(axis=0)
    order = np.argsort(-often, kind="stable")
    cls = np.empty(units, np.int64)
    cls[order] = np.arange(units) % classes
    one = np.eye(classes)[cls]
    right, left = b @ one, b.T @ one  # unit before class, unit after class
    n = one.T @ right
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not often[u]:
                continue
            a, own = cls[u], b[u, u]
            r, l = right[u].copy(), left[u].copy()
            r[a] -= own
            l[a] -= own
            n[a] -= r
            n[:, a] -= l
            n[a, a] -= own
            rows, cols, f = n.sum(axis=1) + l, n.sum(axis=0) + r, xlogx(n)
            gain = (xlogx(n + r[None, :]) - f).sum(axis=1) + (xlogx(n + l[:, None]) - f).sum(axis=0)
            d = np.diag(n)
            gain += xlogx(d + r + l + own) - xlogx(d + r) - xlogx(d + l) + xlogx(d)
            gain -= xlogx(rows + r.sum() + own) - xlogx(rows) + xlogx(cols + l.sum() + own) - xlogx(cols)
            k = int(np.argmax(gain))
            if gain[k] <= gain[a] + 1e-9:
                k = a
            n[k] += r
            n[:, k] += l
            n[k, k] += own
            if k != a:
                moved += 1
                cls[u] = k
                right[:, a] -= b[:, u]
                right[:, k] += b[:, u]
                left[:, a] -= b[u]
                left[:, k] += b[u]
        if not moved:
            break
    return cls


def best_classes(n: np.ndarray, r: np.ndarray, l: np.ndarray, own: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Where ``exchange`` would move each word on its own, all others left in place.
    ``n``: class bigrams; for each word the counts of the classes after (r) and before
    it (l) without itself, how often it follows itself (own), and its class now (a)."""
    w, classes = r.shape
    each = np.arange(w)
    gain = np.zeros((w, classes))
    for j in range(classes):
        for mine, other, cells in ((r, l, n[:, j]), (l, r, n[j])):
            at = np.flatnonzero(mine[:, j])
            c, k = mine[at, j], a[at]
            # the word's occurrences leave its class first
            x = cells[None, :] - np.where((k == j)[:, None], other[at], 0.0)
            x[np.arange(len(at)), k] = cells[k] - c - np.where(k == j, other[at, j] + own[at], 0.0)
            gain[at] += xlogx(x + c[:, None]) - xlogx(x)
    d = np.repeat(np.diag(n)[None, :], w, axis=0)
    d[each, a] -= r[each, a] + l[each, a] + own
    # sums of rows and columns, which hold the word on the other side of its bigrams anyway
    after, before = r.sum(axis=1) + own, l.sum(axis=1) + own
    rows, cols = np.repeat(n.sum(axis=1)[None, :], w, axis=0), np.repeat(n.sum(axis=0)[None, :], w, axis=0)
    rows[each, a] -= after
    cols[each, a] -= before
    gain += xlogx(d + r + l + own[:, None]) - xlogx(d + r) - xlogx(d + l) + xlogx(d)
    gain -= xlogx(rows + after[:, None]) - xlogx(rows) + xlogx(cols + before[:, None]) - xlogx(cols)
    k = gain.argmax(axis=1)
    return np.where(gain[each, k] <= gain[each, a] + 1e-9, a, k)


SLOTS = 2 * CLASSES + 1
UNSEEN = 255
WORDS = 1 << 13


def contexts(b: Block, own: np.ndarray, cls: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts): for each tied word of the block, at its ``rank``, the classes
    after it, before it, and itself after itself, in training documents."""
    units = b.units(own)
    tied = (units >= OWN)[b.local]
    c = cls[units][b.local]
    first = np.zeros(len(c), bool)
    first[np.concatenate([[0], np.cumsum(b.sizes)[:-1]])] = True
    ok = b.training()
    at = rank[b.local].astype(np.int64) * SLOTS
    before = np.where(first, cls[0], np.concatenate([cls[:1], c[:-1]]))
    follows = ok[1:] & ~first[1:] & tied[:-1]
    same = follows & (b.local[1:] == b.local[:-1])
    cells = np.concatenate([(at[:-1] + c[1:])[follows], (at + CLASSES + before)[ok & tied], (at[:-1] + 2 * CLASSES)[same]])
    return np.unique(cells, return_counts=True)


def word_classes(blocks: DataFrame, own: np.ndarray, cls: np.ndarray, n: np.ndarray) -> DataFrame:
    """Written once.  Rows with a block: the training counts and the classes of its
    words of partition p, in order (UNSEEN: of none yet).  Rows without: the types of
    partition p by ending and class, words that are units of their own apart."""
    groups = C.parts(blocks.sparkSession)
    sent = blocks.sparkSession.sparkContext.broadcast((own, cls, n))
    sent_schema = pa.schema([("p", pa.int32()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("words", "times", "endings", "steps", "counts")]])

    def send(batches):
        own, cls, _ = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                b = Block({**row, "ids": None})
                times = b.times()
                order, cut = _deal(b.words, groups)
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                cells, count = contexts(b, own, cls, rank)
                edge = np.searchsorted(cells, cut * SLOTS)
                rows = []
                for k in np.flatnonzero(np.diff(cut)):
                    o, some = order[cut[k]:cut[k + 1]], slice(edge[k], edge[k + 1])
                    step = np.diff(cells[some], prepend=cut[k] * SLOTS)
                    rows.append((k, row["block"], b.words[o].tobytes(), _pack(times[o]), _pack(b.endings[o]),
                                 _pack(step.astype(np.uint32)), _pack(count[some].astype(np.uint32))))
                # a batch for each block: to make one takes longer than to pack a row of it
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), sent_schema.types)], schema=sent_schema)

    def choose(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        own, cls, n = sent.value
        rows = t.num_rows
        part = [np.frombuffer(x, np.uint64) for x in t.column("words").to_pylist()]
        words, at = np.unique(np.concatenate(part), return_inverse=True)
        at = np.split(at.astype(np.int32), np.cumsum([len(x) for x in part])[:-1])
        times, ending = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for x, w, e in zip(at, t.column("times").to_pylist(), t.column("endings").to_pylist()):
            times[x] += _unpack(w, np.uint32)
            ending[x] = _unpack(e, np.uint16)
        # cells of all blocks, word by word
        cells = [_spread(x, _unpack(s, np.uint32)) for x, s in zip(at, t.column("steps").to_pylist())]
        count = [_unpack(c, np.uint32) for c in t.column("counts").to_pylist()]
        cells, count = np.concatenate(cells), np.concatenate(count)
        order = np.argsort(cells, kind="stable")
        cells, count = cells[order], count[order]
        out = np.full(len(words), UNSEEN, np.uint8)
        for lo in range(0, len(words), WORDS):
            hi = min(lo + WORDS, len(words))
            a, z = np.searchsorted(cells, [lo * SLOTS, hi * SLOTS])
            m = np.bincount(cells[a:z] - lo * SLOTS, count[a:z], (hi - lo) * SLOTS).reshape(hi - lo, SLOTS)
            now = cls[OWN + ending[lo:hi]]
            r, l, self = m[:, :CLASSES], m[:, CLASSES:2 * CLASSES], m[:, 2 * CLASSES]
            has = np.flatnonzero(r.sum(axis=1))
            r, l, self, now = r[has], l[has], self[has], now[has]
            r[np.arange(len(has)), now] -= self
            l[np.arange(len(has)), now] -= self
            out[lo + has] = best_classes(n, r, l, self, now)
        tied = out != UNSEEN
        kinds = np.bincount(ending[tied] * CLASSES + out[tied], minlength=ENDINGS * CLASSES).astype(np.int64)
        at_own = np.minimum(np.searchsorted(own, words), max(len(own) - 1, 0))
        mine = own[at_own] == words if len(own) else np.zeros(len(words), bool)
        out[mine] = cls[at_own[mine] + 1]
        out[words == END] = cls[0]
        return pa.table({"block": pa.array([*t.column("block").to_pylist(), None], pa.int64()),
                         "p": pa.array([key[0].as_py()] * (rows + 1), pa.int32()),
                         "times": pa.array([*[_pack(times[x]) for x in at], None], pa.binary()),
                         "classes": pa.array([*[_pack(out[x]) for x in at], None], pa.binary()),
                         "m": pa.array([None] * rows + [_pack(kinds)], pa.binary())})

    rows = blocks.select(*COLS).mapInArrow(send, "p int, block long, words binary, times binary, endings binary, steps binary, counts binary")
    return C.ckpt(rows.groupBy("p").applyInArrow(choose, "block long, p int, times binary, classes binary, m binary"))


def _spread(at: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Cells of a block's words as cells of the partition's (``at``: their places)."""
    cell = np.cumsum(steps.astype(np.int64))
    return at[cell // SLOTS].astype(np.int64) * SLOTS + cell % SLOTS


STATES = "ids array<bigint>, held binary, sizes binary, classes binary, known binary, base binary, emits binary, m binary"


def block_states(b: Block, times: np.ndarray, cls: np.ndarray, sums: tuple[int, int], discount: float) -> dict:
    """Of a block: the class of every token (64 more: unknown word), per document the
    known words, base score and the emissions' part that is the word's own, and the
    bigrams of classes in training documents.  ``cls[0]`` is the end's class."""
    docs = len(b.sizes)
    owner = np.repeat(np.arange(docs), b.sizes)
    seen = times > 0
    base = np.bincount(owner, np.log10(times + 1.0)[b.local], docs) - b.sizes * np.log10(sum(sums) + 1.0)
    emits = np.bincount(owner, np.where(seen, np.log10(np.maximum(times, 1) - discount), 0.0)[b.local], docs)
    c = cls[b.local]
    before = _before(c, b.sizes, int(cls[b.words == END][0]))
    ok = b.training()
    n = np.bincount(before[ok] * CLASSES + c[ok], minlength=CLASSES * CLASSES)
    return {"ids": b.ids, "held": b.held.tobytes(), "sizes": _pack(b.sizes), "classes": _pack((c + CLASSES * ~seen[b.local]).astype(np.uint8)),
            "known": _pack(np.bincount(owner, seen[b.local], docs).astype(np.int64)), "base": _pack(base), "emits": _pack(emits),
            "m": _pack(n.astype(np.int64))}


def _before(c: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    out = np.concatenate([[end], c[:-1]])
    out[np.cumsum(sizes)[:-1]] = end
    return out


@dataclass
class Model:
    end: int  # class of the end token
    step: np.ndarray  # log10 P(class | class before)
    inside: np.ndarray  # log10 of 1 / tokens of a class
    unknown: np.ndarray  # log10 P(an unknown word | class)
    discount: float
    tokens: int
    types: int


def class_model(n: np.ndarray, kinds: np.ndarray, end: int, sums: tuple[int, int], discount: float) -> Model:
    """``n``: class bigrams, ``kinds``: training types of each class."""
    size = n.sum(axis=0)
    share = size / max(1, sums[0])
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.log10((n + PRIOR * share[None, :]) / (n.sum(axis=1, keepdims=True) + PRIOR))
        inside = -np.log10(size)
        unknown = np.log10(discount * kinds / size)
    return Model(end, step, inside, unknown, discount, *sums)


@dataclass
class Fitted:
    states: DataFrame
    words: DataFrame
    model: Model
    own: np.ndarray
    units: np.ndarray  # class of each unit
    endings: np.ndarray  # class of an unseen word of each ending


def fit(blocks: DataFrame) -> Fitted:
    totals = word_totals(blocks)
    own, _ = frequent(totals)
    tokens, types, once, twice = corpus_sums(totals)
    discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
    b = bigrams(blocks, own)
    cls = exchange(b)
    one = np.eye(CLASSES)[cls]
    words = word_classes(blocks, own, cls, one.T @ b @ one)
    by_ending = summed(words.where("block is null"), ENDINGS * CLASSES).reshape(ENDINGS, CLASSES)
    kinds = by_ending.sum(axis=0) + np.bincount(cls[:len(own) + 1], minlength=CLASSES)
    endings = np.where(by_ending.any(axis=1), by_ending.argmax(axis=1), kinds.argmax())
    states = token_states(blocks, words, endings, (tokens, types), discount)
    n = summed(states, CLASSES * CLASSES).reshape(CLASSES, CLASSES).astype(float)
    return Fitted(states, words, class_model(n, kinds, int(cls[0]), (tokens, types), discount), own, cls, endings)


def token_states(blocks: DataFrame, words: DataFrame, endings: np.ndarray, sums: tuple[int, int], discount: float) -> DataFrame:
    """Written once: the ``block_states`` of every block."""
    groups = C.parts(blocks.sparkSession)
    schema = pa.schema([("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("held", "sizes", "classes", "known", "base", "emits", "m")]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts, out = {r["p"]: r for r in right.to_pylist()}, []
        for row in left.to_pylist():
            b = Block(row)
            order, _ = _deal(b.words, groups)
            times, cls = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            times[order] = np.concatenate([_unpack(parts[k]["times"], np.int64) for k in sorted(parts)])
            cls[order] = np.concatenate([_unpack(parts[k]["classes"], np.uint8) for k in sorted(parts)])
            out.append(block_states(b, times, np.where(cls == UNSEEN, endings[b.endings], cls), sums, discount))
        return pa.Table.from_pylist(out, schema)

    back = words.where("block is not null").select("block", "p", "times", "classes")
    return C.ckpt(blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, STATES))


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10);
    a text's perplexity is 10 ** (-score / n_tokens)."""
    fitted = fit(token_blocks(docs, id_col, text_col))
    m = fitted.model

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = _unpack(row["sizes"], np.int64)
                state = _unpack(row["classes"], np.uint8).astype(np.int64)
                c, seen = state % CLASSES, state < CLASSES
                score = np.zeros(len(sizes))
                if m.tokens:
                    each = m.step[_before(c, sizes, m.end), c] + np.where(seen, m.inside[c], m.unknown[c])
                    score = np.bincount(np.repeat(np.arange(len(sizes)), sizes), each, len(sizes)) + _unpack(row["emits"], float)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(np.frombuffer(row["held"], bool)), "n_tokens": pa.array(sizes),
                    "n_known": pa.array(_unpack(row["known"], np.int64)), "train_tokens": pa.array(np.full(len(sizes), m.tokens, np.int64)),
                    "base_score": pa.array(_unpack(row["base"], float)), "score": pa.array(score)})

    return fitted.states.drop("m").mapInArrow(run, SCORES)


def op6_class_lm(spark, sf_dir):
    return scores(C.table(spark, sf_dir, "documents"))
