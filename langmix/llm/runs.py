"""Periodic runs of words by seed and extend along diagonals.

A run of period q and length >= max(LEAST, TIMES * q) matches itself q words later over
max(LEAST - q, (TIMES - 1) * q) words at least, so some k-gram of that guaranteed overlap
occurs twice, q apart.  k-grams are indexed at k = 16 (the least overlap of all periods)
for lags up to 16 and then at 32, 64, ... for the lags in (k/2, k], whose overlap is k at
least.  As such a gram holds a whole period, its next occurrence in the document lies
exactly one smallest period on: successive occurrences are all pairs that are needed,
and multiples of a period never come up.  Grams are named exactly, by pairs of names of
half their length, and only those that recur in their document reach the next level.
Each pair is a seed on the diagonal of its lag and is extended word by word both ways;
a table of the furthest covered position of each lag suppresses all later seeds of the
same run, so work is n log n also where one word fills the text.

Documents are worked off where they are read, some megabytes at a time; nothing is
shuffled.  Words are maximal runs outside space and \\t\\n\\v\\f\\r, compared whole.  Null
and empty texts have no words and no runs; repeated rows and ids give a row each; other
columns are not read.  Empty in, empty out.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.llm import common as C

LEAST = 24
TIMES = 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def gram_size(least: int, times: int) -> int:
    """The largest power of two within the least overlap that any period guarantees."""
    overlap = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    return 1 << (overlap.bit_length() - 1)


def seeds(names: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, lags) of successive occurrences of a gram, band by band of lags."""
    first, k = gram_size(least, times), 1
    alive = names
    while True:
        if k == 1:
            idx, key = np.arange(len(names)), names
        else:
            half = k // 2
            idx = np.flatnonzero((alive[:-half] >= 0) & (alive[half:] >= 0)) if len(alive) > half else np.zeros(0, np.int64)
            key = alive[idx] * (int(alive.max(initial=0)) + 1) + alive[idx + half]
        if not len(idx):
            return
        order = np.argsort(key, kind="stable")
        at, key = idx[order], key[order]
        same = key[1:] == key[:-1]
        if k >= first:
            lag = (at[1:] - at[:-1])[same]
            fits = (lag <= k) & (lag > (k // 2 if k > first else 0))
            yield at[:-1][same][fits], lag[fits]
        again = np.zeros(len(at), bool)
        again[1:] = same
        again[:-1] |= same
        alive = np.full(len(names), -1, np.int64)
        alive[at[again]] = np.concatenate([[0], np.cumsum(~same)])[again]
        k *= 2


def _matching(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries of a and b agree; looks ahead in growing steps."""
    at, step = 0, 64
    n = min(len(a), len(b))
    while at < n:
        differs = a[at:min(n, at + step)] != b[at:min(n, at + step)]
        if differs.any():
            return at + int(differs.argmax())
        at, step = at + step, step * 2
    return n


def find_runs(names: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run among word names.  Several documents may
    lie one after the other if they share no name."""
    found = []
    for at, lag in seeds(names, least, times):
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        fresh = np.ones(len(at), bool)  # the word before is no seed of this lag
        fresh[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        covered: dict[int, int] = {}
        for i, q in zip(at[fresh].tolist(), lag[fresh].tolist()):
            if i < covered.get(q, 0):
                continue
            end = i + _matching(names[i:], names[i + q:])
            start = i - _matching(names[:i][::-1], names[:i + q][::-1])
            covered[q] = end
            if end + q - start >= max(least, times * q):
                found.append((start, end + q - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES,
                  change: Callable | None = None) -> DataFrame:
    """One row per document: id, n_words, runs (start, length, period; by start, then
    period) and collapsed: the text's words without those that a run holds after its
    first period, joined by one space.  ``change(id, words)`` may alter a document's
    words before."""
    out = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])

    def work(batches):
        for batch in batches:
            for piece in C.pieces(batch, text_col, 4 << 20):
                ids = piece.column(piece.schema.get_field_index(id_col)).to_pylist()
                words: list[bytes] = []
                starts, names = [0], []
                fresh = count()
                for key, text in zip(ids, piece.column(piece.schema.get_field_index(text_col)).to_pylist()):
                    own = text.encode("utf-8").split() if text else []
                    if change is not None:
                        own = change(key, own)
                    name = defaultdict(fresh.__next__)  # names are of this document alone
                    names.append(np.fromiter(map(name.__getitem__, own), np.int64, len(own)))
                    words += own
                    starts.append(len(words))
                runs = find_runs(np.concatenate(names) if names else np.zeros(0, np.int64), least, times)
                turn = np.zeros(len(words) + 1, np.int64)
                per: list[list[dict]] = [[] for _ in ids]
                owner = np.searchsorted(starts, [r[0] for r in runs], "right") - 1
                for (start, length, period), d in zip(runs, owner.tolist()):
                    turn[start + period] += 1
                    turn[start + length] -= 1
                    per[d].append({"start": start - starts[d], "length": length, "period": period})
                kept = np.cumsum(turn)[:-1] == 0
                texts = []
                for d, (a, b) in enumerate(zip(starts, starts[1:])):
                    left = [words[i] for i in (np.flatnonzero(kept[a:b]) + a).tolist()] if per[d] else words[a:b]
                    texts.append(b" ".join(left).decode("utf-8"))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(starts)), pa.array(per, out.field("runs").type),
                                                  pa.array(texts, pa.string())], schema=out)

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(
        work, f"{id_col} long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's periodic tail: from word a on, a tenth of the documents repeat
    their next p words.  A document without id stays as it is."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _greatest(runs: Column) -> Column:
    """The run with the greatest exact exponent, then the smallest start and period."""
    def order(x, y):
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return (F.when(left > right, -1).when(left < right, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
                .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))
    return F.get(F.array_sort(runs, order), 0)


def digests(runs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``periodic_runs``."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("best")
    return (runs.withColumn("best", _greatest(F.col("runs")))
            .select(id_col, F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
                    best["period"].alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole document, a tenth of which gets a periodic tail first."""
    C.prepare(spark)
    return digests(periodic_runs(C.table(spark, sf_dir, "documents"), change=planted))


ORACLE = r"""
with recursive""" + C.CRC_SQL + r""",
given as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, """ + C.crc32_sql("doc_id::varchar") + r""" as h
  from documents, poly),
cut as (
  select *, len(w) as n, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from given),
tail as (
  select doc_id, n, case when a is null then w else list_concat(w[1:a], list_transform(range(n - a),
    lambda i: w[a + 1 + i % (1 + (n - a) // (3 + (h // 10) % 8))])) end as w
  from cut),
words as (select doc_id, unnest(range(n)) as i, unnest(w) as word from tail),
same as (
  select x.doc_id, x.i, y.i - x.i as q
  from words x join words y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i join tail t on t.doc_id = x.doc_id and 3 * (y.i - x.i) <= t.n),
islands as (select *, i - row_number() over (partition by doc_id, q order by i) as island from same),
long as (
  select doc_id, min(i) as s, count(*) + q as l, q from islands group by doc_id, q, island having count(*) + q >= greatest(24, 3 * q)),
runs as (select doc_id, s, l, min(q) as q from long group by doc_id, s, l),
listed as (
  select doc_id, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as line from runs group by doc_id),
ranked as (
  select *, row_number() over (partition by doc_id order by l::decimal(38, 20) / q desc, s, q) as k from runs),
gone as (select distinct doc_id, unnest(range(s + q, s + l)) as i from runs),
kept as (
  select doc_id, string_agg(word, ' ' order by i) as line from words anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, r.s as start, r.l as length, r.q as period, 1000 * r.l // r.q as exponent_milli,
       sha256(coalesce(listed.line, '')) as runs_sha256, sha256(coalesce(kept.line, '')) as collapsed_sha256
from documents d left join listed using (doc_id) left join kept using (doc_id) left join ranked r on r.doc_id = d.doc_id and r.k = 1
"""
