"""Finding repeated windows of ``length`` units (bytes or words) across all texts.

Every window is represented by the smallest hash among its ``gram``-unit grams, so
equal windows have equal representatives wherever they stand.  Consecutive windows
with the same representative form a run.  The work then has three steps:

1. ``recurring``: representatives are shuffled (one entry per Arrow batch and value,
   so a passage that a third of all documents share sends one entry per batch);
   runs whose representative occurs more than once are candidates.
2. ``candidate_pieces``: the text of candidate runs is shuffled by representative.
   Identical pieces of one Arrow batch are settled on the spot, only the earliest
   travels.
3. An exact method (``decide``) compares the pieces that meet in a task and returns
   the window starts to remove.  Runs cover each window once, so nothing is missed
   and nothing is judged twice.
4. Pieces stream by in the order of their representatives, and a task holds those of some
   representatives, ``kind.hot`` units at most.  A representative with more of them (a
   line that many documents share between other neighbours) is dealt out again: its
   windows are keyed by a 128-bit digest of the whole window, and the earliest of each
   digest is found by an aggregate.

Documents that equal an earlier one are settled before by a 128-bit hash of the whole
text: all their windows are repeats, and what repeats them repeats the earlier one.

The texts themselves are shuffled once, by a hash of id and text, so that rows without
an id spread like others; all steps read that shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm import common as C
from langmix.llm.text import SPACE, buffers, byte_codes, grams, tokens

#: the id of rows without one: after all others
LAST = (1 << 63) - 1
#: what keyed() returns; all steps read the same columns, so that they share one shuffle
COLUMNS = ("doc_id", "key", "u", "text")
KEY, U, TEXT, TOLD = 1, 2, 3, 4
SLICE_UNITS = 1 << 20
SLICE_BYTES = 4 << 20

RANGES = "u long, key long, ranges binary"
#: the range of a document that equals an earlier one: all its windows
ALL = (0, -1)


@dataclass(frozen=True)
class Kind:
    """What a window is made of."""

    length: int
    gram: int
    of_words: bool
    #: a window that repeats within one document counts as a repeat
    within: bool
    #: units of pieces of one representative that one task compares
    hot: int

    @property
    def span(self) -> int:
        return self.length - self.gram + 1

    def units(self, col: pa.Array):
        """(unit hashes, first unit of each text, function (text, from, to) -> bytes)."""
        buf, off = buffers(col)
        if not self.of_words:
            return byte_codes()[buf], off, lambda t, a, z: buf[off[t] + a:off[t] + z].tobytes()
        s, e, h, first = tokens(buf, off, SPACE)

        def words(t: int, a: int, z: int) -> bytes:
            a, z = first[t] + a, first[t] + z
            return b" ".join(buf[x:y].tobytes() for x, y in zip(s[a:z], e[a:z]))

        return h, first, words


def slide_min(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries."""
    span = 1
    while span * 2 <= width:
        g = np.minimum(g[:-span], g[span:])
        span *= 2
    rest = width - span
    return np.minimum(g[:len(g) - rest], g[rest:]) if rest else g


def runs(h: np.ndarray, first: np.ndarray, kind: Kind):
    """Runs of windows with one representative: (text, from, to inclusive, hash,
    alone); window starts are counted from the text's first unit.  alone: the run
    holds its representative once, so no two of its windows can be equal (only
    worked out for kinds that ask for it)."""
    none = np.zeros(0, np.int64)
    out = []
    texts, at = len(first) - 1, 0
    while at < texts:
        to = max(at + 1, int(np.searchsorted(first, first[at] + SLICE_UNITS, "right")) - 1)
        x = h[first[at]:first[to]]
        begin = first[at:to + 1] - first[at]
        at, base = to, at
        if len(x) < kind.length:
            continue
        g = grams(x, kind.gram)
        m = slide_min(g, kind.span)  # one for each window start
        count = np.maximum(np.diff(begin) - kind.length + 1, 0)  # windows of each text
        starts = np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())
        if not len(starts):
            continue
        v, text = m[starts], np.repeat(np.arange(len(count)), count)
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (text[1:] != text[:-1])
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(v)) - 1
        t = text[lo]
        alone = np.ones(len(lo), bool)
        if kind.within:
            grams_of = hi - lo + kind.span
            upto = np.cumsum(grams_of)
            place = np.repeat(starts[lo] - upto + grams_of, grams_of) + np.arange(upto[-1])
            alone = np.add.reduceat(g[place] == np.repeat(v[lo], grams_of), upto - grams_of, dtype=np.int64) == 1
        out.append((t + base, starts[lo] - begin[t], starts[hi] - begin[t], v[lo], alone))
    if not out:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    return tuple(np.concatenate(c) for c in zip(*out))


def by_key(keys: np.ndarray, *cols: np.ndarray):
    """(key, slices of the columns) for every distinct key."""
    order = np.argsort(keys, kind="stable")
    keys, cols = keys[order], [c[order] for c in cols]
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    for a, z in zip(cut, np.append(cut[1:], len(keys))):
        yield keys[a], [c[a:z] for c in cols]


ENTRY = "p int, u long, ids binary, hashes binary, starts binary, known binary"
FOUND = "u long, starts binary"


def recurring(docs: DataFrame, kind: Kind, groups: int) -> DataFrame:
    """(u, starts): starts of the runs of a document whose representative
    occurs more than once anywhere (or, ``within``, in the run itself)."""
    def spread(batches):
        for batch in batches:
            for b in C.pieces(batch, "text", SLICE_BYTES):
                ids = b.column(U).to_numpy()
                h, first, _ = kind.units(b.column(TEXT))
                t, lo, hi, v, alone = runs(h, first, kind)
                _, at, count = np.unique(v, return_inverse=True, return_counts=True)
                known = (count[at] > 1) | ~alone  # met twice here already
                rows = [(int(key) % groups, int(key), None, None, s.astype(np.int32).tobytes(), None)
                        for key, (s,) in by_key(ids[t[known]], lo[known])]
                once = np.zeros(len(v), bool)
                once[np.unique(v, return_index=True)[1]] = True  # one entry for each value
                p = (v[once] >> np.uint64(20)) % np.uint64(groups)
                for k, (i, s, x, f) in by_key(p, ids[t[once]], lo[once], v[once], known[once]):
                    rows.append((int(k), None, i.tobytes(), x.tobytes(), s.astype(np.int32).tobytes(), f.tobytes()))
                yield batch_of(rows, ENTRY)

    def meet(table: pa.Table) -> pa.Table:
        t = table.to_pydict()
        rows = [(k, s) for k, s in zip(t["u"], t["starts"]) if k is not None]
        mine = [i for i, k in enumerate(t["u"]) if k is None]
        if mine:
            ids = np.concatenate([np.frombuffer(t["ids"][i], np.int64) for i in mine])
            v = np.concatenate([np.frombuffer(t["hashes"][i], np.uint64) for i in mine])
            lo = np.concatenate([np.frombuffer(t["starts"][i], np.int32) for i in mine])
            known = np.concatenate([np.frombuffer(t["known"][i], bool) for i in mine])
            _, at, count = np.unique(v, return_inverse=True, return_counts=True)
            use = (count[at] > 1) & ~known  # the known ones have been told already
            rows += [(int(key), s.tobytes()) for key, (s,) in by_key(ids[use], lo[use])]
        return pa.Table.from_batches([batch_of(rows, FOUND)])

    return docs.mapInArrow(spread, ENTRY).groupBy("p").applyInArrow(meet, FOUND)


PIECE = "a long, key long, u long, lo int, hi int, piece binary, alone boolean, ranges binary"


def candidate_pieces(docs: DataFrame, found: DataFrame, kind: Kind) -> DataFrame:
    """Text of the candidate runs, and ranges that are settled already."""
    starts = found.groupBy("u").agg(F.collect_list("starts").alias("starts"))

    def cut(batches):
        for batch in batches:
            for b in C.pieces(batch, "text", SLICE_BYTES):
                key, u = b.column(KEY).to_numpy(), b.column(U).to_numpy()
                told = [np.concatenate([np.frombuffer(x, np.int32) for x in s]) if s else np.zeros(0, np.int32)
                        for s in b.column(TOLD).to_pylist()]
                h, first, content = kind.units(b.column(TEXT))
                t, lo, hi, v, alone = runs(h, first, kind)
                same: dict[bytes, list] = {}
                begin = np.searchsorted(t, np.arange(b.num_rows + 1))
                for d in range(b.num_rows):
                    x = slice(begin[d], begin[d + 1])
                    for j in np.flatnonzero(np.isin(lo[x], told[d])) + begin[d]:
                        same.setdefault(content(d, lo[j], hi[j] + kind.length), []).append(
                            (int(key[d]), int(u[d]), int(lo[j]), int(hi[j]), int(v[j]), bool(alone[j])))
                rows, settled = [], {}
                for piece, at in same.items():
                    at = sorted(set(at))
                    for n, (k, r, a, z, value, solo) in enumerate(at):
                        if n == 0 or (not kind.within and k == at[0][0]):
                            rows.append((value - (1 << 64) if value >> 63 else value, k, r, a, z, piece, solo, None))
                        else:
                            settled.setdefault((k, r), []).append((a, z))
                rows += [(r, k, r, 0, 0, None, None, np.array(x, np.int32).tobytes()) for (k, r), x in settled.items()]
                yield batch_of(rows, PIECE)

    return docs.join(starts, "u").select(*COLUMNS, "starts").mapInArrow(cut, PIECE)


Decide = Callable[[list[list[tuple]], Kind], list[tuple[int, int, int, int]]]


SPREAD = "w binary, u long, key long, start int"


def removed(docs: Keyed, kind: Kind, decide: Decide) -> DataFrame:
    """(u, key, ranges): for each document, packed (first, last) window starts to remove."""
    # the copies are the side that is hashed, so that texts are not sorted for this; an
    # anti join would be moved before the shuffle of the texts, which all steps share
    copies = docs.copies.select("u", F.lit(True).alias("copy")).hint("shuffle_hash")
    fresh = docs.rows.join(copies, "u", "left").where("copy is null").select(*COLUMNS)
    pieces = candidate_pieces(docs.rows, recurring(fresh, kind, C.parts(fresh.sparkSession)), kind)
    lined = pieces.repartition("a").sortWithinPartitions("a")

    def meet(batches):
        many, total, rows = [], 0, []

        def decided() -> list[tuple]:
            out: dict = {}
            for k, r, a, z in decide(many, kind):
                out.setdefault((r, k), []).append((a, z))
            return [(*who, np.array(x, np.int32).tobytes()) for who, x in out.items()]

        for hot, t in portions(batches, kind):
            cols = [t[c].to_pylist() for c in ("a", "key", "u", "lo", "hi", "piece", "alone", "ranges")]
            rows += [(u, key, r) for key, u, r in zip(cols[1], cols[2], cols[7]) if r is not None]
            if not hot:
                for _, each in groupby(zip(*cols[:7]), itemgetter(0)):
                    held = [x[1:] for x in each if x[5] is not None]
                    if held:
                        many.append(held)
                        total += sum(x[3] - x[2] for x in held) + len(held) * kind.length
                        if total >= kind.hot:
                            rows += decided()
                            many, total = [], 0
            if len(rows) > 2000:
                yield batch_of(rows, RANGES)
                rows = []
        yield batch_of(rows + (decided() if many else []), RANGES)

    def spread(batches):
        for hot, t in portions(batches, kind):
            for at in range(0, t.num_rows if hot else 0, 200):
                part = zip(*(t[c].slice(at, 200).to_pylist() for c in ("key", "u", "lo", "hi", "piece")))
                yield batch_of([w for x in part if x[4] is not None for w in windows(x, kind)], SPREAD)

    everywhere = F.lit(np.array(ALL, np.int32).tobytes()).alias("ranges")
    return (lined.mapInArrow(meet, RANGES).unionByName(repeated_windows(lined.mapInArrow(spread, SPREAD), kind))
            .unionByName(docs.copies.select("u", "key", everywhere)))


def portions(batches, kind: Kind):
    """(hot, rows) of pieces that come sorted by representative: whole representatives,
    several at a time, or, where one holds more than ``kind.hot`` units, parts of it."""
    group, held, size, hot = None, [], 0, False  # the last representative so far
    for batch in batches:
        if not batch.num_rows:
            continue
        a, lo, hi = (batch[c].to_numpy() for c in ("a", "lo", "hi"))
        cut = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a))
        units = np.add.reduceat(hi.astype(np.int64) - lo + kind.length, cut[:-1])
        at, last = 0, len(units) - 1
        if group is not None and a[0] == group:
            held.append(batch.slice(0, cut[1]))
            size += int(units[0])
            hot |= size > kind.hot
            at = 1
            if last == 0 and not hot:
                continue
        if held:
            yield hot, pa.Table.from_batches(held)
            held = []
        if at > last:
            continue
        size, hot = 0, False
        for k in [*(np.flatnonzero(units[at:last] > kind.hot) + at).tolist(), last]:
            if k > at:
                yield False, batch.slice(cut[at], cut[k] - cut[at])
            if k < last:
                yield True, batch.slice(cut[k], cut[k + 1] - cut[k])
            at = k + 1
        group, held, size = a[-1], [batch.slice(cut[last])], int(units[last])
        hot = size > kind.hot
    if held:
        yield hot, pa.Table.from_batches(held)


def windows(piece: tuple, kind: Kind) -> list[tuple]:
    """A row for each window of a piece, under a digest of the whole window."""
    key, u, lo, hi, text = piece
    if kind.of_words:
        words = text.split(b" ")
        each = (b" ".join(words[k:k + kind.length]) for k in range(hi - lo + 1))
    else:
        each = (text[k:k + kind.length] for k in range(hi - lo + 1))
    return [(hashlib.blake2b(w, digest_size=16).digest(), u, key, lo + k) for k, w in enumerate(each)]


def repeated_windows(spread: DataFrame, kind: Kind) -> DataFrame:
    """Ranges of the windows (w, u, key, start) that occur earlier: under a smaller key, or
    ``within``, at an earlier place of all."""
    place = F.struct("key", "u", "start")
    first = spread.groupBy("w").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(
        "first < last" if kind.within else "first.key < last.key")
    # under a name of its own both sides are shuffled for the join, which Spark splits where a window is hot
    first = first.select(F.concat("w", F.lit(b"")).alias("w"), "first")
    late = place > F.col("first") if kind.within else F.col("key") > F.col("first.key")
    return spread.join(first, "w").where(late).select("u", "key", "start").mapInArrow(_packed, RANGES)


def _packed(batches):
    for b in batches:
        starts = b.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.array((s, s), np.int32).tobytes() for s in starts], pa.binary())],
                                         ["u", "key", "ranges"])


def equal_documents(docs: DataFrame) -> DataFrame:
    """(u, key) of the documents whose whole text another one with a smaller key has."""
    text = F.col("text")
    hashes = docs.select("u", "key", F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).where(F.length(text) > 0)
    least = hashes.groupBy("a", "b").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").drop("most")
    return hashes.join(least, ["a", "b"]).where("key > least").select("u", "key").distinct()


@dataclass(frozen=True)
class Keyed:
    rows: DataFrame    #: COLUMNS, dealt out by u
    copies: DataFrame  #: (u, key) of documents that equal an earlier one


def keyed(docs: DataFrame, id_col: str, text_col: str) -> Keyed:
    """doc_id, key (null ids last), u (of key and text) and text, dealt out by u."""
    spark = docs.sparkSession
    C.prepare(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.xxhash64(key, text).alias("u"), text.alias("text"))
    return Keyed(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "u"), C.ckpt(equal_documents(rows)))


def digest(docs: Keyed, ranges: DataFrame, one: Callable[[bytes, list[tuple[int, int]]], tuple], ddl: str) -> DataFrame:
    """A row for every document: ``one`` gets its text and the sorted ranges of
    removed window starts."""
    told = ranges.groupBy("u").agg(F.collect_list(F.struct("key", "ranges")).alias("told"))

    def run(batches):
        for b in batches:
            rows = []
            buf, off = buffers(b.column(TEXT))
            keys = b.column(KEY).to_pylist()
            for k, (doc, found) in enumerate(zip(b.column(0).to_pylist(), b.column(TOLD).to_pylist())):
                own = b"".join(f["ranges"] for f in found or [] if f["key"] == keys[k])
                pairs = np.frombuffer(own, np.int32).reshape(-1, 2)
                rows.append((doc, *one(buf[off[k]:off[k + 1]].tobytes(), sorted(set(map(tuple, pairs.tolist()))))))
            yield batch_of(rows, ddl)

    return docs.rows.join(told, "u", "left").select(*COLUMNS, "told").mapInArrow(run, ddl)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names = [c.split() for c in ddl.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, names)], [n for n, _ in names])


def merged(pairs: list[tuple[int, int]], extra: int, units: int) -> list[tuple[int, int]]:
    """Union of [a, z + extra) as sorted disjoint half-open ranges of a text of so many
    units; ``ALL`` stands for all of its windows."""
    if ALL in pairs:
        return [(0, units)] if units >= extra else []
    out: list[list[int]] = []
    for a, z in pairs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z + extra)
        else:
            out.append([a, z + extra])
    return [tuple(x) for x in out]


def chunks(groups: list[list[tuple]], size: Callable[[list[tuple]], int], most: int):
    """Groups (never split) in lists of about ``most`` in total size."""
    out, n = [], 0
    for g in groups:
        out.append(g)
        n += size(g)
        if n >= most:
            yield out
            out, n = [], 0
    if out:
        yield out


def starts_to_ranges(flags: np.ndarray, base: int):
    """(first, last) of every run of set flags, counted from ``base``."""
    padded = np.zeros(len(flags) + 2, bool)
    padded[1:-1] = flags
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    return [(int(a) + base, int(z) - 1 + base) for a, z in zip(edge[::2], edge[1::2])]
