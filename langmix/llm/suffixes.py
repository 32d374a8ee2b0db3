"""Suffix-array dedup of repeated byte strings by two-stage sorting.

``repeats`` brings together the passages whose 100-byte strings may recur.  In each
task they are concatenated, with a mark after each, and their suffixes sorted in
two stages: only suffixes smaller than their successors are sorted directly (on
their first ``length`` symbols, which is all that matters here); every other suffix
is induced by scanning the buckets of first symbols in ascending order, where its
place follows from the place of its successor.  Common prefixes of neighbours in
suffix order then give the groups of equal strings, and all but the earliest start
of each group are removed.

Texts are UTF-8 bytes; matches never cross documents; null texts are empty.  The
earliest start is the smallest by (id, text hash, position); rows without an id come
last.  Rows that repeat both id and text are one document and get the same result.
Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from langmix.llm import common as C
from langmix.llm import repeats as R

LENGTH = 100
GRAM = 24
#: symbols (a byte + 1, or the mark 0) packed in a sort key
PACK, BITS = 7, 9
#: bytes sorted together: few enough for a core's cache
SORT_BYTES = 1 << 16
#: bytes of the pieces of one representative that one task sorts; more are dealt out by window
HOT = 4 << 20


def packed(t: np.ndarray) -> np.ndarray:
    """PACK symbols from every position, as one number; marks follow the end."""
    x = np.concatenate([t, np.zeros(PACK, t.dtype)]).astype(np.uint64)
    out = np.zeros(len(t), np.uint64)
    for j in range(PACK):
        out = (out << np.uint64(BITS)) | x[j:j + len(t)]
    return out


def key_at(keys: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return np.where(pos < len(keys), keys[np.minimum(pos, len(keys) - 1)], 0)


def direct_sort(keys: np.ndarray, pos: np.ndarray, length: int) -> np.ndarray:
    """``pos`` in the order of the suffixes' first ``length`` symbols (ties by position)."""
    order, tied = pos[np.argsort(keys[pos], kind="stable")], None
    same = keys[order][1:] == keys[order][:-1]
    for at in range(PACK, length, PACK):
        # only places whose suffix still equals a neighbour are sorted further
        edge = np.concatenate([[False], same, [False]])
        tied = np.flatnonzero(edge[1:] | edge[:-1])
        if not len(tied):
            break
        group = np.cumsum(~edge[:-1])[tied]
        part = order[tied]
        k = key_at(keys, part + at)
        o = np.lexsort((k, group))
        order[tied] = part[o]
        k, group = k[o], group[o]
        still = (k[1:] == k[:-1]) & (group[1:] == group[:-1])
        same = np.zeros(len(order) - 1, bool)
        follows = tied[1:] == tied[:-1] + 1
        same[tied[1:][follows & still] - 1] = True
    return order


def suffix_order(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions by their suffixes' first ``length`` symbols, packed keys).
    ``t`` holds symbols, 0 the mark; it ends in a mark."""
    n = len(t)
    keys = packed(t)
    # the next position with another symbol, and the run of equal ones up to it
    change = np.flatnonzero(t[1:] != t[:-1]) + 1
    ends = np.append(change, n)
    stop = ends[np.searchsorted(ends, np.arange(n), "right")]
    after = np.where(stop < n, t[np.minimum(stop, n - 1)], 0)
    mark = t == 0
    small = (t < after) & ~mark  # smaller than its successor
    rank = np.empty(n, np.int64)
    count = np.bincount(t, minlength=257)
    first = np.concatenate([[0], np.cumsum(count)])
    rank[mark] = np.arange(count[0])
    # stage one: the smaller ones, directly
    a = direct_sort(keys, np.flatnonzero(small), length)
    sym = t[a]  # ascending, so each bucket's share is one slice
    begin = np.searchsorted(sym, np.arange(258))
    # stage two: bucket scans; in a bucket the induced suffixes come first
    large = np.flatnonzero(~small & ~mark)
    large = large[np.argsort(t[large], kind="stable")]
    cut = np.searchsorted(t[large], np.arange(258))
    for c in np.flatnonzero(count[1:]) + 1:
        own = large[cut[c]:cut[c + 1]]
        if len(own):
            last = stop[own] - 1  # the run's last symbol: its successor is in a lower bucket
            base = rank[np.minimum(last + 1, n - 1)]
            own = own[np.lexsort((base, stop[own] - own))]
            rank[own] = first[c] + np.arange(len(own))
        direct = a[begin[c]:begin[c + 1]]
        rank[direct] = first[c] + len(own) + np.arange(len(direct))
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, keys


def common_prefixes(order: np.ndarray, keys: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to ``most`` symbols."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, most, PACK):
        x = key_at(keys, order[live] + at) ^ key_at(keys, order[live - 1] + at)
        out[live] += PACK
        differ = x != 0
        if differ.any():
            # symbols above the highest differing bit agree
            high = np.floor(np.log2(x[differ].astype(np.float64))).astype(np.int64)
            exact = (x[differ] >> np.minimum(high, 63).astype(np.uint64)) == 0  # rounding up
            high -= exact
            out[live[differ]] -= high // BITS + 1
        live = live[~differ]
        if not len(live):
            break
    return np.minimum(out, most)


def repeated(anchors: list[list[tuple]], kind: R.Kind) -> list[tuple[int, int, int, int]]:
    """(key, u, first, last) window starts whose string starts earlier as well.
    anchors: for each representative its pieces (key, u, lo, hi, bytes, alone)."""
    out, several = [], []
    for rows in anchors:
        rows = sorted(set(rows))
        seen: dict[bytes, tuple] = {}
        for r in rows:  # the same piece again: all of it is a repeat
            if r[4] in seen:
                out.append(r[:4])
            else:
                seen[r[4]] = r
        rows = list(seen.values())
        if len(rows) > 1 or not rows[0][5]:
            several.append(rows)
    for shard in R.chunks(several, lambda g: sum(len(r[4]) for r in g), SORT_BYTES):
        rows = sorted(r for g in shard for r in g)  # so an earlier position starts earlier
        size = np.array([len(r[4]) + 1 for r in rows])
        at = np.concatenate([[0], np.cumsum(size)])
        t = np.zeros(at[-1], np.int64)
        body = np.ones(at[-1], bool)
        body[at[1:] - 1] = False
        t[body] = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).astype(np.int64) + 1
        order, keys = suffix_order(t, kind.length)
        valid = np.zeros(len(t), bool)
        for a, r in zip(at, rows):
            valid[a:a + r[3] - r[2] + 1] = True
        order = order[valid[order]]
        group = np.cumsum(common_prefixes(order, keys, kind.length) < kind.length)
        least = np.minimum.reduceat(order, np.flatnonzero(np.append(True, group[1:] != group[:-1])))
        flags = np.zeros(len(t), bool)
        flags[order] = order > least[group - group[0]]
        for a, r in zip(at, rows):
            out += [(r[0], r[1], x, z) for x, z in R.starts_to_ranges(flags[a:a + r[3] - r[2] + 1], r[2])]
    return out


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, z in spans:
        kept.append(text[at:a])
        at = z
    return b"".join(kept) + text[at:]


def removed_ranges(rows: R.Keyed, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    return R.removed(rows, R.Kind(length, gram, of_words=False, within=True, hot=hot), repeated)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, the bytes that are left, and the removed spans as (start, end) pairs."""
    rows = R.keyed(docs, id_col, text_col)

    def one(text: bytes, pairs: list[tuple[int, int]]) -> tuple:
        spans = R.merged(pairs, length, len(text))
        return kept_bytes(text, spans), np.array(spans, np.int32).tobytes()

    return R.digest(rows, removed_ranges(rows, length), one, "doc_id long, kept binary, spans binary")


def op2_suffix_dedup(spark, sf_dir):
    rows = R.keyed(C.table(spark, sf_dir, "documents"), "doc_id", "text")

    def one(text: bytes, pairs: list[tuple[int, int]]) -> tuple:
        spans = R.merged(pairs, LENGTH, len(text))
        return (len(text), sum(z - a for a, z in spans), len(spans),
                hashlib.sha256(kept_bytes(text, spans)).hexdigest())

    return R.digest(rows, removed_ranges(rows), one, DIGEST)
