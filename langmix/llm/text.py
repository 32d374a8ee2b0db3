"""Vectorised word and byte hashing over Arrow string columns.

Everything works on the raw UTF-8 buffer of an Arrow column, a slice of about
``CHUNK`` bytes at a time, so memory does not depend on how long one text is
beyond the text itself.  A null text counts as an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: ASCII bytes that are neither digits nor letters: they part the words of WORD text
PUNCT = bytes(b for b in range(128) if not (chr(b).isalnum()))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply) on a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(fold_case: bool = False) -> np.ndarray:
    """A pseudo-random 64-bit code for each byte; A-Z share a-z's if fold_case."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * MULT)
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


_POW = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of MULT and of its inverse modulo 2^64 (cached per process)."""
    if len(_POW["p"]) < n:
        size = 1 << int(n - 1).bit_length()
        inv = np.uint64(pow(int(MULT), -1, 1 << 64))
        for key, base in (("p", MULT), ("q", inv)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POW[key] = np.cumprod(steps, dtype=np.uint64)
    return _POW["p"], _POW["q"]


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not (wide or pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col, wide = col.cast(pa.string()), False
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32, len(col) + 1 + col.offset)[col.offset:].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0]:o[-1]], o - o[0]


def tokens(buf: np.ndarray, offsets: np.ndarray, seps: bytes = SPACE, fold_case: bool = False,
           symbols: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs of bytes outside ``seps``) of every text; runs of
    ``symbols`` are words of their own.

    Returns (starts, ends, hashes, first): byte ranges in ``buf``, a 64-bit hash
    of each word's bytes, and the index of each text's first word (one more
    entry than texts)."""
    sep = np.zeros(256, bool)
    sep[list(seps)] = True
    kinds = np.where(sep, 0, 1).astype(np.uint8)
    kinds[list(symbols)] = 2
    codes = byte_codes(fold_case)
    codes[sep] = 0
    n = len(buf)
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[offsets] = True
    all_s, all_e, all_h = [], [], []
    at = 0
    while at < n:
        to = min(n, at + CHUNK)
        while to < n and not (sep[buf[to]] or cut[to]):  # never inside a word
            stop = min(n, to + 4096)
            free = sep[buf[to:stop]] | cut[to:stop]
            to = to + int(free.argmax()) if free.any() else stop
        x = buf[at:to]
        kind = kinds[x]
        turn = (kind[1:] != kind[:-1]) | cut[at + 1:to]
        begins = kind > 0
        finishes = begins.copy()
        begins[1:] &= turn
        finishes[:-1] &= turn
        s, e = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        if len(s):
            p, q = powers(len(x) + 1)
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(codes[x] * p[:len(x)], out=total[1:])
            h = (total[e] - total[s]) * q[s]
            all_h.append(mix(h + (e - s).astype(np.uint64)))
            all_s.append(s + at)
            all_e.append(e + at)
        at = to
    if not all_s:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    s, e, h = np.concatenate(all_s), np.concatenate(all_e), np.concatenate(all_h)
    return s, e, h, np.searchsorted(s, offsets)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries of ``h`` (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = []
    for at in range(0, len(h) - n + 1, CHUNK):
        x = h[at:at + CHUNK + n - 1]
        p, q = powers(len(x) + 1)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * p[:len(x)], out=total[1:])
        out.append(mix((total[n:] - total[:-n]) * q[:len(x) - n + 1]))
    return np.concatenate(out)


def owners(first: np.ndarray) -> np.ndarray:
    """The text index of each word, from ``tokens()``' first."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
