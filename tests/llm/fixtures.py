"""Small inputs with the awkward cases, and plain brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

LAST = 1 << 63

#: columns whose names clash with those that the operators use inside
CLASH = ("size", "shard", "slot", "key", "node", "copies", "h", "p", "rk", "at", "held", "score", "block", "_id", "g")
DDL = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def sentence(rng: random.Random, n: int, words=None) -> str:
    words = words or [f"{a}{b}" for a in "the ran sto mil bek".split() for b in "ing er on ly a".split()]
    return " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    """(doc_id, text, lang, source): nulls in every column, empty and very long
    texts, ties, repeated rows, near copies and shared passages."""
    rng = random.Random(seed)
    passage = sentence(rng, 70)
    base = sentence(rng, 300)
    near = base.split()
    near[120] = "changed"
    rows: list[list] = []
    for k in range(30):
        body = sentence(rng, rng.randrange(8, 160))
        if k % 5 == 0:
            body = body + "\n" + passage + "\t" + sentence(rng, 20)
        rows.append([k, body, "en", f"s{k % 3}"])
    rows += [[100, base, "en", "s0"], [101, " ".join(near), "en", "s0"], [102, base, "en", None], [103, base, None, "s1"],
             [104, "", "en", "s1"], [105, None, "en", "s2"], [106, "", "en", "s1"], [107, "one", "en", "s2"],
             [108, "One two,three", "de", "s2"], [109, "été Été à la plage   　 x", "fr", "s1"],
             [110, "same " * 700, "en", "s0"], [111, "ab" * 400, "en", "s0"], [112, sentence(rng, 30_000), "en", "s0"],
             [None, sentence(rng, 40) + " " + passage, "en", "s0"], [3, rows[3][1], "en", "s0"], [3, rows[3][1], "en", "s0"],
             [113, "idiot " + sentence(rng, 30), "en", "s1"], [114, "\x00\x01 nul \x7f", "en", "s1"]]
    return [tuple(r) for r in rows]


def frame(spark, rows: list[tuple]):
    full = [(d, t, lang, src, len(t) if t is not None else None, *["x"] * len(CLASH)) for d, t, lang, src in rows]
    return spark.createDataFrame(full, DDL).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DDL)


def space_words(text) -> list[bytes]:
    return (text or "").encode().split()


def fold(text) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_words(text) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def crc(doc_id) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


def decontaminated(docs, items, width=10) -> Counter:
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = plain_words(text)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(item) if item is not None else "")
    out = Counter()
    for d, text, *_ in docs:
        w, found = plain_words(text), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    found |= windows[tuple(w[k:k + n])]
                    hit[k:k + n] = [True] * n
        out[(d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit))] += 1
    return out


def phrase_dedup(docs, window=50) -> Counter:
    """(doc_id, words, removed, sha256 of the kept words)."""
    first: dict[tuple, int] = {}
    words = [(LAST if d is None else d, d, space_words(t)) for d, t, *_ in docs]
    for key, _, w in words:
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            first[x] = min(first.get(x, LAST + 1), key)
    out = Counter()
    for key, d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < key:
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[(d, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def byte_dedup(docs, length=100) -> Counter:
    """(doc_id, bytes, removed, spans, sha256 of the rest); repeated rows are one document."""
    seen, out = set(), Counter()
    count = Counter((d, t) for d, t, *_ in docs)
    for d, t in sorted(count, key=lambda x: (LAST if x[0] is None else x[0], x[1] or "")):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            x = raw[k:k + length]
            if x in seen:
                gone[k:k + length] = b"\1" * length
            seen.add(x)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[(d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += count[(d, t)]
    return out


def jaccard_classes(docs, n=5, threshold=0.8) -> Counter:
    """(doc_id, class_id, links, kept)."""
    sets = []
    for d, t, *_ in docs:
        w = space_words(t)
        sets.append({tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    near = [[j for j in range(len(docs)) if j != i and sets[i] and sets[j]
             and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12] for i in range(len(docs))]
    return _classes([d for d, *_ in docs], near)


def _classes(ids, near) -> Counter:
    label = list(range(len(ids)))
    moved = True
    while moved:
        moved = False
        for i, js in enumerate(near):
            for j in js:
                low = min(label[i], label[j])
                moved |= label[i] != low or label[j] != low
                label[i] = label[j] = low
    least: dict[int, int | None] = {}
    for i, d in zip(label, ids):
        if d is not None:
            least[i] = min(least.get(i, LAST), d)
    return Counter((d, least.get(label[i]), len(near[i]), d == least.get(label[i])) for i, d in enumerate(ids))


def rows_of(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())
