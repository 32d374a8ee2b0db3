"""Benchmark decontamination with a positional inverted index.

``build_index`` cuts the documents into segments of some megabytes and stores,
for each, the sorted term dictionary and every term's list of word positions.
The index is written once (checkpoint) and searched as often as wanted.  A phrase
is found by taking the list of its rarest term in the segment and intersecting it
with the other terms' lists, each shifted by the term's place in the phrase;
proximity matches follow the lists with a bounded number of foreign words.

Segments are independent, so no list of a common word is ever shuffled or
gathered; the query set is sent to all segments in blocks of about ``BLOCK_WORDS``
words, one after the other.  A block holds each word once, windows are cut from it
in the task; long items are cut into pieces that overlap by a window less a word.
What a block finds is written before the next one is sent.

Words are ``[0-9a-z]`` and non-ASCII runs after lower-casing A-Z.  Null texts have
no words; empty tables, repeated rows and null ids are kept as they come (a row
in, a row out).  Items with a null id count and are listed as the empty string;
items without words are ignored.  Other columns of the inputs are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langmix.llm import common as C
from langmix.llm.text import PUNCT, buffers, tokens

SEGMENT_BYTES = 4 << 20
BLOCK_WORDS = 1 << 18
WINDOW = 10

INDEX = "seg long, ids array<bigint>, first binary, terms binary, ends binary, postings binary"


def pack(a: np.ndarray) -> bytes:
    raw = a.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(b: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], n, "zstd", asbytes=True), dtype) if n else np.zeros(0, dtype)


def index_segment(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text, sorted terms, end of each term's list, positions)."""
    _, _, h, first = tokens(buf, off, PUNCT, fold_case=True)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begins = np.flatnonzero(new)
    return first, ranked[begins], np.append(begins[1:], len(h)), order.astype(np.uint32)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored index: a row per segment of whole documents."""
    C.prepare(docs.sparkSession)

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in C.pieces(batch, "text", segment_bytes):
                first, terms, ends, posts = index_segment(*buffers(b.column(1)))
                # positions within a list ascend: differences pack well
                gaps = np.diff(posts.astype(np.int64), prepend=0).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "seg": pa.array([part << 32 | k]), "ids": pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())),
                    "first": [pack(first)], "terms": [pack(terms)], "ends": [pack(ends)], "postings": [pack(gaps)]})
                k += 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return C.ckpt(rows.mapInArrow(run, INDEX))


class Segment:
    """One opened index row."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.first = unpack(row["first"], np.int64)
        self.terms = unpack(row["terms"], np.uint64)
        self.ends = unpack(row["ends"], np.int64)
        self.posts = np.cumsum(unpack(row["postings"], np.int32), dtype=np.int64)

    def owner(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, pos, "right") - 1

    def listing(self, t: int) -> np.ndarray:
        return self.posts[self.ends[t - 1] if t else 0:self.ends[t]]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The term numbers of word hashes, -1 for words that do not occur."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def phrase(self, t: np.ndarray) -> np.ndarray:
        """Starts of the exact phrase of term numbers ``t``."""
        size = self.ends[t] - np.where(t > 0, self.ends[t - 1], 0)
        order = np.argsort(size, kind="stable")
        starts = self.listing(t[order[0]]) - order[0]
        for o in order[1:]:
            if not len(starts):
                return starts
            other = self.listing(t[o])
            at = np.minimum(np.searchsorted(other, starts + o), len(other) - 1)
            starts = starts[other[at] == starts + o]
        starts = starts[starts >= 0]
        return starts[self.owner(starts) == self.owner(starts + len(t) - 1)] if len(starts) else starts

    def near(self, t: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of in-order matches with at most ``slop`` foreign words
        in between, each start with its shortest end."""
        starts = ends = self.listing(t[0])
        for k in t[1:]:
            other = self.listing(k)
            at = np.searchsorted(other, ends, "right")
            ok = at < len(other)
            starts, ends = starts[ok], other[at[ok]]
        ok = (ends - starts + 1 <= len(t) + slop) & (self.owner(starts) == self.owner(ends))
        return starts[ok], ends[ok] + 1


def item_pieces(items: DataFrame, width: int, id_col: str, text_col: str, most_words: int) -> DataFrame:
    """(item, terms): an item's words as packed hashes, cut so that every window lies
    in one piece of at most ``most_words`` windows."""
    def run(batches):
        for batch in batches:
            for b in C.pieces(batch, "text"):
                _, _, h, first = tokens(*buffers(b.column(1)), PUNCT, fold_case=True)
                ids = b.column(0).to_pylist()
                rows = [(i, h[s:min(s + most_words + width - 1, z)].tobytes()) for i, a, z in zip(ids, first[:-1], first[1:])
                        for s in range(a, max(z - width + 1, min(a + 1, z)), most_words)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())],
                                                 ["item", "terms"])

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, terms binary").distinct()


def query_blocks(items: DataFrame, width: int, id_col: str, text_col: str, block_words: int = BLOCK_WORDS):
    """The query set as lists of rows (item, terms), each of about ``block_words`` words."""
    spark = items.sparkSession
    pieces = C.ckpt(item_pieces(items, width, id_col, text_col, max(1, block_words // 8)))
    total = pieces.agg(F.sum(F.octet_length("terms"))).first()[0] or 0
    blocks = max(1, -(-total // (8 * block_words)))
    if blocks == 1:
        yield pieces.collect()
        return
    folder = f"{spark.sparkContext.getCheckpointDir()}/items-{uuid.uuid4()}"  # a block is read without the others
    (pieces.withColumn("block", F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)))
     .repartition("block").write.partitionBy("block").parquet(folder))
    for b in range(blocks):
        yield spark.read.parquet(folder).where(F.col("block") == b).select("item", "terms").collect()


@dataclass
class Query:
    """A block of the query set: the words of its pieces, one after the other, and for
    each window length where windows begin and whose they are."""
    words: np.ndarray
    windows: list[tuple[int, np.ndarray, np.ndarray]]
    names: list[str]

    @staticmethod
    def of(block, width: int) -> Query:
        names = sorted({r["item"] for r in block})
        number = {n: k for k, n in enumerate(names)}
        by, at = {}, 0
        for r in block:
            n = len(r["terms"]) // 8
            w = min(width, n)
            by.setdefault(w, []).append((at + np.arange(n - w + 1), np.full(n - w + 1, number[r["item"]])))
            at += n
        return Query(np.frombuffer(b"".join(r["terms"] for r in block), np.uint64),
                     [(w, *(np.concatenate(x) for x in zip(*v))) for w, v in sorted(by.items())], names)

    def possible(self, seg: Segment):
        """(term numbers, item's number) of windows all of whose words occur in the segment."""
        t = seg.numbers(self.words)
        known = np.append(0, np.cumsum(t >= 0))
        for w, start, item in self.windows:
            for k in np.flatnonzero(known[start + w] - known[start] == w):
                yield t[start[k]:start[k] + w], item[k]


OUT = ("seg long, row int, doc_id long, n_words long, hits binary, items array<string>")


def search(index: DataFrame, query: Broadcast, all_rows: bool = True) -> DataFrame:
    """For every document (or those with a hit): its words, the covered ones (packed
    start/end pairs) and the items found, for one block of the query set."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seg, names = Segment(row), query.value.names
                n, found = len(seg.ids), []
                cover = np.zeros(int(seg.first[-1]) + 1, np.int32)
                for t, item in query.value.possible(seg):
                    at = seg.phrase(t)
                    if len(at):
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + len(t), -1)
                        found.append(np.unique(np.stack([seg.owner(at), np.full(len(at), item)]), axis=1))
                hit = np.cumsum(cover[:-1]) > 0
                items: list[list] = [[] for _ in range(n)]
                if found:
                    for d, i in np.unique(np.concatenate(found, axis=1), axis=1).T:
                        items[d].append(names[i])
                out = [d for d in range(n) if all_rows or items[d]]
                hits = [np.flatnonzero(np.diff(hit[seg.first[d]:seg.first[d + 1]].view(np.int8), prepend=0, append=0))
                        .astype(np.int32).tobytes() for d in out]
                yield pa.RecordBatch.from_pydict({
                    "seg": pa.array([row["seg"]] * len(out), pa.int64()), "row": pa.array(out, pa.int32()),
                    "doc_id": pa.array([seg.ids[d] for d in out], pa.int64()), "n_words": pa.array(np.diff(seg.first)[out], pa.int64()),
                    "hits": pa.array(hits, pa.binary()), "items": pa.array([items[d] for d in out], pa.list_(pa.string()))})

    return index.mapInArrow(run, OUT)


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def digest_batch(b: pa.RecordBatch) -> pa.RecordBatch:
    """One row per document; several rows of a document (query blocks) are merged."""
    merged: dict[tuple, list] = {}
    for r in b.to_pylist():
        merged.setdefault((r["seg"], r["row"]), []).append(r)
    rows = []
    for same in merged.values():
        n = same[0]["n_words"]
        cover = np.zeros(n + 1, np.int32) if any(r["hits"] for r in same) else None
        for r in same:
            edge = np.frombuffer(r["hits"], np.int32)
            if len(edge):
                cover[edge[0::2]] += 1
                cover[edge[1::2]] -= 1
        items = sorted({i for r in same for i in r["items"]})
        hit = 0 if cover is None else int((np.cumsum(cover[:-1]) > 0).sum())
        rows.append((same[0]["doc_id"], n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0))
    cols = list(zip(*rows)) if rows else [[]] * 6
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [c.split()[0] for c in DIGEST.split(", ")])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: n_words, n_hit (words inside any occurrence of a window of
    ``width`` item words), n_items, items_sha256 and contaminated (n_hit > 0)."""
    index = build_index(docs, id_col, text_col)
    context, both, waiting = docs.sparkSession.sparkContext, None, None
    for block in query_blocks(benchmark, width, item_col, item_text, block_words):
        if waiting:
            part = C.ckpt(search(index, waiting, all_rows=both is None))
            waiting.destroy()
            both = part if both is None else both.unionByName(part)
        waiting = context.broadcast(Query.of(block, width))
    last = search(index, waiting, all_rows=both is None)
    if both is None:
        return last.mapInArrow(lambda it: (digest_batch(b) for b in it), DIGEST)
    both = both.unionByName(last)

    def whole(t: pa.Table) -> pa.Table:
        b = t.combine_chunks().to_batches()
        return pa.Table.from_batches([digest_batch(b[0])])

    return both.groupBy("seg").applyInArrow(whole, DIGEST)


def phrase_matches(index: DataFrame, phrases: list[tuple[str, str]], slop: int = 0) -> DataFrame:
    """(doc_id, phrase, start, end) in words: every exact occurrence of the given
    (name, text) phrases, or with ``slop`` foreign words in between at most."""
    queries = []
    for name, text in phrases:
        raw = text.encode()
        h = tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), PUNCT, fold_case=True)[2]
        if len(h):
            queries.append((name, h))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seg, out = Segment(row), []
                for name, h in queries:
                    t = seg.numbers(h)
                    if (t >= 0).all():
                        if slop:
                            s, e = seg.near(t, slop)
                        else:
                            s = seg.phrase(t)
                            e = s + len(h)
                        d = seg.owner(s)
                        out += [(seg.ids[k], name, int(a - seg.first[k]), int(z - seg.first[k])) for k, a, z in zip(d, s, e)]
                cols = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    ["doc_id", "phrase", "start", "end"])

    return index.mapInArrow(run, "doc_id long, phrase string, start long, end long")


def op4_decontaminate(spark, sf_dir):
    return decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
