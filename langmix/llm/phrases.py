"""Substring dedup with repeated-phrase automata.

``repeats`` brings the passages with a recurring representative together; here they
are confirmed word by word.  Passages that occur in one form only need no further
look.  The others' windows are compiled into Aho-Corasick automata (pyahocorasick),
one for each shard of about ``SHARD_WINDOWS`` windows, with the smallest document id
that holds the window; a passage is a string of one code point per distinct word
of the shard, so matches begin and end on words.  All passages of all documents
are streamed through their shard's automaton, which reports every occurrence.

A word is removed if a window over it also starts in a document with a smaller id.
Words are maximal runs outside space and \\t\\n\\v\\f\\r, unchanged.  Null and empty
texts have no words.  Rows without an id come after all others and do not remove
one another's words; nor do rows that repeat an id.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from langmix.llm import common as C
from langmix.llm import repeats as R

WINDOW = 50
GRAM = 8
SHARD_WINDOWS = 20_000
#: words of the pieces of one representative that one task compiles; more are dealt out by window
HOT = 200_000


def confirm(anchors: list[list[tuple]], kind: R.Kind) -> list[tuple[int, int, int, int]]:
    """(key, u, first, last) window starts that also occur under a smaller key.
    anchors: for each representative its pieces (key, u, lo, hi, words, alone)."""
    out, several = [], []
    for rows in anchors:
        least = min(r[0] for r in rows)
        if all(r[0] == least for r in rows):
            continue
        if len({r[4] for r in rows}) == 1:
            out += [(k, rk, lo, hi) for k, rk, lo, hi, *_ in rows if k > least]
        else:
            several.append(rows)
    for shard in R.chunks(several, lambda g: sum(r[3] - r[2] + 1 for r in g), SHARD_WINDOWS):
        rows = [r for g in shard for r in g]
        code: dict[bytes, str] = {}
        texts = []
        for *_, piece, _ in rows:
            texts.append("".join([code.setdefault(w, chr(len(code) + 1 + (0x800 if len(code) >= 0xD7FF else 0))) for w in piece.split(b" ")]))
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        windows: dict[str, int] = {}
        for (key, *_), s in zip(rows, texts):
            for i in range(len(s) - kind.length + 1):
                w = s[i:i + kind.length]
                if windows.get(w, R.LAST + 1) > key:
                    windows[w] = key
        lowest = sorted(set(windows.values()))
        number = {k: i for i, k in enumerate(lowest)}
        for w, key in windows.items():
            machine.add_word(w, number[key])
        machine.make_automaton()
        streamed: dict[str, list[tuple[int, int]]] = {}
        for (key, rk, lo, hi, *_), s in zip(rows, texts):
            if s not in streamed:
                streamed[s] = [(end - kind.length + 1, lowest[n]) for end, n in machine.iter(s)]
            flags = np.zeros(hi - lo + 1, bool)
            for start, least in streamed[s]:
                flags[start] = least < key
            out += [(key, rk, a, z) for a, z in R.starts_to_ranges(flags, lo)]
    return out


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def kept_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], list[bytes]]:
    """(all words, kept words) of a text."""
    words = text.split()
    kept, at = [], 0
    for a, z in spans:
        kept += words[at:a]
        at = z
    return words, kept + words[at:]


def removed_ranges(rows: R.Keyed, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    return R.removed(rows, R.Kind(window, gram, of_words=True, within=False, hot=hot), confirm)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id and the text without the repeated words (the others joined by one space)."""
    rows = R.keyed(docs, id_col, text_col)

    def one(text: bytes, pairs: list[tuple[int, int]]) -> tuple:
        return (b" ".join(kept_words(text, R.merged(pairs, window, len(text.split())))[1]).decode(),)

    return R.digest(rows, removed_ranges(rows, window), one, "doc_id long, text string")


def op7_phrase_dedup(spark, sf_dir):
    rows = R.keyed(C.table(spark, sf_dir, "documents"), "doc_id", "text")

    def one(text: bytes, pairs: list[tuple[int, int]]) -> tuple:
        words, kept = kept_words(text, R.merged(pairs, WINDOW, len(text.split())))
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return R.digest(rows, removed_ranges(rows), one, DIGEST)
