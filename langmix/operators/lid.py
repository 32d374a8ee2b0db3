"""Language identification as a Spark job.

The reference calls per-row native detectors.  Here detection is model inference
in one narrow step: the model is a pair of tables that grow with the training data,
learned by one aggregation over labelled rows, and a vectorised Arrow function scores
each text where it is read.  Nothing is shuffled to label a line or a token.

* **primary detector** - character trigrams, each under its own key (its three code
  points).  A trigram's weight for a language is ``ln(1 + SCALE * count / total)``, the
  log-likelihood ratio of its relative frequency against a uniform floor of ``1/SCALE``.
  A unit's score is the sum of its trigrams' weights; the confidence is the softmax over
  all languages.  The table has a row per real trigram.
* **secondary detector** - word votes.  A training word votes for the language in which
  it is relatively most frequent; confidence is the winner's share of the votes.  Words
  are known by 64-bit hashes; a task looks them up in a fingerprint table
  (:class:`WordVotes`, 48 bits and a vote each, about six bytes a word), so a word that
  was never seen stays unknown (but for one in 2^48 / words).  Beyond ``MAX_WORDS`` words
  the table is not broadcast: the units that trigrams leave open meet it by a shuffle.

Scores are rounded to 6 decimals before ranking so the result does not depend on
summation order; ties go to the smaller language code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langmix.functions import text as tx
from langmix.session import arrow_batches, cut_lineage

# --- fixed values -----------------------------------------------------------
STOPWORDS_TOP_K = 30         # length of the stop-word report
WEIGHT_SCALE = 1_000_000.0   # uniform floor 1e-6 for unseen trigrams
UNKNOWN = "unknown"
OTHERS = "others"
# ---------------------------------------------------------------------------
_CHARS = 1 << 18  # bytes of text that a task works on at a time, whatever an Arrow batch holds
_ENTRIES = 1 << 19  # distinct trigrams and words that a training task counts before it hands them on
_CELLS = 1 << 24  # largest cube of an alphabet that is addressed directly
_BATCH = 2 << 20  # bytes of an Arrow batch in training, whose rows are whole texts
MAX_WORDS = 1 << 24  # words whose votes are broadcast (about 100 MB in each Python worker)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class WordVotes:
    """A static map from 64-bit word keys to language numbers: keys go to buckets by
    their first 16 bits, where the next 32 lie sorted beside the vote."""

    def __init__(self, keys: np.ndarray, votes: np.ndarray):
        keys = keys.astype(np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        self.begin = np.searchsorted(keys >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64)).astype(np.int64)
        self.prints = (keys >> np.uint64(16)).astype(np.uint32)
        self.votes = votes[order].astype(np.int16)

    def __len__(self) -> int:
        return len(self.prints)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The vote of each key, -1 if there is none: a binary search in all buckets at once."""
        if not len(self):
            return np.full(len(keys), -1, np.int64)
        bucket, want = (keys >> np.uint64(48)).astype(np.int64), (keys >> np.uint64(16)).astype(np.uint32)
        low, high = self.begin[bucket], self.begin[bucket + 1]
        end = high.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            less = (low < high) & (self.prints[np.minimum(middle, len(self) - 1)] < want)
            low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(high, middle))
        at = np.minimum(low, len(self) - 1)
        return np.where((low < end) & (self.prints[at] == want), self.votes[at], -1).astype(np.int64)


@dataclass
class LidModel:
    profile: DataFrame      # lang, gram, cnt, weight
    langs: list[str]        # languages of the profile, sorted
    grams: np.ndarray       # sorted trigram keys
    weights: np.ndarray     # (trigrams + 1) x languages; the last row, of zeros, is for unknown ones
    words: DataFrame        # key, lang: the votes
    votes: WordVotes | None # the same as a table, up to MAX_WORDS of them
    _sent: dict = field(default_factory=dict)

    @property
    def n_langs(self) -> int:
        return len(self.langs)

    def broadcast(self, with_votes: bool):
        """(trigram table, votes) as one broadcast for all that label with this model: a
        Python worker that goes from lines to tokens holds them once."""
        if with_votes not in self._sent:
            context = self.profile.sparkSession.sparkContext
            self._sent[with_votes] = context.broadcast((Grams(self.grams, self.weights), self.votes if with_votes else None))
        return self._sent[with_votes]


# ---- keys of trigrams and words of normalised text ---------------------------

def code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, begin of each text's); nulls are empty."""
    col = col.fill_null("") if col.null_count else col
    if not len(col):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    wide = pa.types.is_large_string(col.type)
    o = np.frombuffer(off, np.int64 if wide else np.int32, len(col) + 1 + col.offset)[col.offset:].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, np.uint8)
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    return points, first[o - o[0]]


def trigram_keys(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, begin of each text's): the three code points of 21 bits."""
    n = np.maximum(np.diff(first) - 2, 0)
    begin = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    return (points[at] << 42) | (points[at + 1] << 21) | points[at + 2], begin


def word_keys(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit keys, begin of each text's) of the words between single spaces."""
    cut = np.zeros(len(points) + 1, bool)
    cut[first] = True
    letter = points != 32
    starts = np.flatnonzero(letter & (np.concatenate([[True], ~letter[:-1]]) | cut[:-1]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    size = np.diff(np.append(starts, len(points)))
    place = np.arange(starts[0], len(points)) - np.repeat(starts, size)
    power = np.cumprod(np.full(int(size.max()), _BASE, np.uint64), dtype=np.uint64)
    part = np.where(letter, points, 0)[starts[0]:].astype(np.uint64) * power[place]
    x = np.add.reduceat(part, starts - starts[0])
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32)), np.searchsorted(starts, first)


def pieces(col: pa.Array, most: int | None = None):
    """Slices (begin, end) of consecutive texts of at most ``most`` bytes together, or of
    one text: what is held for a piece does not grow with the batch."""
    most = most or _CHARS
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield at, to
        at = to


# ---- training ----------------------------------------------------------------

def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, their counts) of several such pairs."""
    if len(parts) == 1:
        return parts[0]
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(counts[order], begin) if len(begin) else counts


def _count_batches(kind: str, lang: str, keys: np.ndarray, counts: np.ndarray, rows: int = 10_000):
    for at in range(0, len(keys), rows):
        own, n = keys[at:at + rows].view(np.int64), counts[at:at + rows]
        text = ["".join(map(chr, (x >> 42, x >> 21 & 0x1FFFFF, x & 0x1FFFFF))) for x in own.tolist()] if kind == "gram" else [None] * len(own)
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array([kind] * len(own), pa.string()), "lang": pa.array([lang] * len(own), pa.string()),
            "key": pa.array(own, pa.int64()), "gram": pa.array(text, pa.string()), "cnt": pa.array(n, pa.int64())})


def key_counts(labelled: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(kind, lang, key, gram, cnt): trigram and word counts, pre-aggregated in each task
    over pieces of text, at most ``_ENTRIES`` of them (and a piece's) at a time."""
    def run(batches):
        held: dict[tuple[str, str], list] = {}

        def flush():
            for (kind, lang), parts in held.items():
                yield from _count_batches(kind, lang, *_merged(parts))
            held.clear()

        entries = 0
        for b in batches:
            names, at = np.unique(np.array(b.column(0).to_pylist(), dtype=str), return_inverse=True)
            for k, name in enumerate(names):
                texts = b.column(1).take(pa.array(np.flatnonzero(at == k)))
                for begin, end in pieces(texts):
                    points, first = code_points(texts.slice(begin, end - begin))
                    for kind, f in (("gram", trigram_keys), ("word", word_keys)):
                        part = np.unique(f(points, first)[0], return_counts=True)
                        held.setdefault((kind, str(name)), []).append(part)
                        entries += len(part[0])
                    if entries >= _ENTRIES:
                        held = {key: [_merged(parts)] for key, parts in held.items()}
                        entries = sum(len(parts[0][0]) for parts in held.values())
                        if 2 * entries >= _ENTRIES:
                            yield from flush()
                            entries = 0
        yield from flush()

    rows = labelled.select(F.col(label_col).cast("string").alias("lang"), tx.char_trigram_text(text_col).alias("t")).where("lang is not null")
    return (rows.mapInArrow(run, "kind string, lang string, key long, gram string, cnt long")
            .groupBy("kind", "lang", "key", "gram").agg(F.sum("cnt").alias("cnt")))


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> LidModel:
    """Fit both detectors.  The counts are checkpointed, so later queries do not
    depend on the training lineage."""
    with arrow_batches(labelled.sparkSession, _BATCH):
        counts = cut_lineage(key_counts(labelled, text_col, label_col))
    totals = F.broadcast(cut_lineage(counts.groupBy("kind", "lang").agg(F.sum("cnt").alias("total"))))  # two rows a language
    counted = counts.join(totals, ["kind", "lang"])
    profile = cut_lineage(counted.where("kind = 'gram'").select(
        "lang", "gram", "key", "cnt", F.round(F.ln(F.lit(1.0) + F.lit(WEIGHT_SCALE) * F.col("cnt") / F.col("total")), 6).alias("weight")))
    best = F.min(F.struct((-(F.col("cnt") / F.col("total"))).alias("share"), "lang"))
    words = cut_lineage(counted.where("kind = 'word'").groupBy("key").agg(best.alias("x")).select("key", "x.lang"))
    langs = sorted(r.lang for r in totals.select("lang").distinct().collect())
    number = {x: i for i, x in enumerate(langs)}
    held = profile.select("key", "lang", "weight").toArrow().to_pydict()  # real trigrams: a bounded alphabet
    grams, at = np.unique(np.array(held["key"], np.int64), return_inverse=True)
    weights = np.zeros((len(grams) + 1, max(1, len(langs))))
    weights[at, [number[x] for x in held["lang"]]] = held["weight"]
    return LidModel(profile.drop("key"), langs, grams, weights, words, _table(words, number))


def _table(words: DataFrame, number: dict[str, int]) -> WordVotes | None:
    if words.count() > MAX_WORDS:
        return None
    t = words.toArrow()
    lang = t.column("lang").combine_chunks().dictionary_encode()
    votes = np.array([number[x] for x in lang.dictionary.to_pylist()], np.int64)[lang.indices.to_numpy()]
    return WordVotes(t.column("key").to_numpy().astype(np.int64).view(np.uint64), votes)


def stopword_lists(labelled: DataFrame, text_col: str = "text", label_col: str = "lang",
                   top_k: int = STOPWORDS_TOP_K) -> DataFrame:
    """(lang, word): the top-k lower-cased words of each language, a report."""
    words = labelled.select(F.col(label_col).alias("lang"),
                            F.explode(tx.word_punct_tokens(F.lower(F.col(text_col)))).alias("word"))
    words = words.filter(F.col("lang").isNotNull() & F.col("word").rlike(r"^\p{L}+$"))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy("lang").orderBy(F.desc("cnt"), F.asc("word"))
    return (counts.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= top_k)
            .select("lang", "word"))


# ---- detection ---------------------------------------------------------------

class Grams:
    """Rows of a weight table by trigram.  The letters of the known trigrams are
    numbered, and a small enough cube of them is addressed directly; trigrams of a
    larger alphabet are searched for."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        self.keys, self.columns = keys, np.ascontiguousarray(weights.T)  # a column a language; the last row is of unknown trigrams
        parts = [keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF]
        letters = np.unique(np.concatenate(parts)) if len(keys) else np.zeros(0, np.int64)
        self.width = len(letters) + 1  # 0: a letter of no trigram
        self.cells = None
        if self.width**3 <= _CELLS:
            self.number = np.zeros(int(letters[-1]) + 2 if len(letters) else 1, np.int32)
            self.number[letters] = np.arange(1, self.width)
            self.cells = np.full(self.width**3, len(keys), np.int32)
            x, y, z = (self.number[p].astype(np.int64) for p in parts)
            self.cells[(x * self.width + y) * self.width + z] = np.arange(len(keys))

    @property
    def n_langs(self) -> int:
        return len(self.columns)

    def rows(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The row of the trigram that begins at each point; where none does, that of unknown ones."""
        at = np.full(len(points), len(self.keys), np.int32)
        if len(points) > 2:
            if self.cells is not None:
                letter = self.number[np.minimum(points, len(self.number) - 1)]
                at[:-2] = self.cells[(letter[:-2] * self.width + letter[1:-1]) * self.width + letter[2:]]
            else:
                keys = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
                found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                at[:-2] = np.where(self.keys[found] == keys, found, len(self.keys))
        full = np.diff(first) > 0
        for back in (1, 2):  # no trigram begins at the last two points of a text
            at[np.maximum(first[1:] - back, first[:-1])[full]] = len(self.keys)
        return at


def primary(points: np.ndarray, first: np.ndarray, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """(language number, confidence) of each text; confidence -1 without any known trigram."""
    at, full = grams.rows(points, first), np.flatnonzero(np.diff(first))
    s = np.zeros((len(first) - 1, grams.n_langs))
    if len(full):
        for k, weights in enumerate(grams.columns):
            s[full, k] = np.round(np.add.reduceat(weights[at], first[full]), 6)
    top = s.max(axis=1, initial=0)
    conf = 1.0 / np.exp(s - top[:, None]).sum(axis=1)
    return s.argmax(axis=1), np.where(top > 0, conf, -1.0)


def secondary(points: np.ndarray, first: np.ndarray, votes: WordVotes, langs: int) -> tuple[np.ndarray, np.ndarray]:
    keys, begin = word_keys(points, first)
    v = votes.find(keys)
    hit = v >= 0
    owner = np.repeat(np.arange(len(first) - 1), np.diff(begin))[hit]
    n = np.bincount(owner * langs + v[hit], minlength=(len(first) - 1) * langs).reshape(-1, langs)
    total = n.sum(axis=1)
    return n.argmax(axis=1), np.where(total > 0, n.max(axis=1, initial=0) / np.maximum(total, 1), -1.0)


OPEN = -2  # the trigrams leave it open and the votes are not at hand


def detect(col: pa.Array, grams: Grams, votes: WordVotes | None, mode: str, threshold: float, second: np.ndarray) -> np.ndarray:
    """Label number of each normalised text: a language, -1 unknown, or what
    ``second`` makes of the secondary detector's language; ``OPEN`` without votes.

    mode ``single`` (L3): primary label if confidence > threshold.
    mode ``cascade`` (L1/L2): primary label if confidence >= threshold; else the
    secondary label if its confidence >= threshold; else unknown.  Works on pieces of
    the column, and asks the secondary detector only about what the primary leaves open."""
    out = np.full(len(col), -1, np.int64)
    for begin, end in pieces(col):
        piece = col.slice(begin, end - begin)
        label, conf = primary(*code_points(piece), grams)
        if mode == "single":
            out[begin:end] = np.where(conf > threshold, label, -1)
            continue
        out[begin:end] = np.where(conf >= threshold, label, OPEN)
        left = np.flatnonzero(conf < threshold)
        if votes is not None and len(left):
            other, share = secondary(*code_points(piece.take(pa.array(left))), votes, grams.n_langs)
            out[begin + left] = np.where(share >= threshold, second[other], -1)
    return out


def _labeller(model: LidModel, mode: str, code_map: dict[str, str] | None = None, unmapped: str | None = None):
    """(broadcast tables, label names, label number of each secondary language)."""
    names = [*model.langs]
    if code_map is not None:  # mapped codes, and 'others' for the rest
        second = []
        for x in model.langs:
            y = code_map.get(x, unmapped or x)
            if y not in names:
                names.append(y)
            second.append(names.index(y))
    else:
        second = range(len(model.langs))
    second = np.array([*second] or [-1])
    names.append(UNKNOWN)
    return model.broadcast(mode != "single"), names, second


def _name(number: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), F.when(number < 0, F.lit(-1)).otherwise(number + 1))


def label_column(facts: DataFrame, text_col: str, model: LidModel, out_col: str = "pred_lang", mode: str = "cascade",
                 threshold: float = 0.3, code_map: dict[str, str] | None = None, unmapped: str | None = None) -> DataFrame:
    """Label every row's ``text_col``, without a shuffle (but for open units of a
    model whose votes are too many to broadcast)."""
    sent, names, second = _labeller(model, mode, code_map, unmapped)

    @F.arrow_udf("int")
    def label(t: pa.Array) -> pa.Array:
        return pa.array(detect(t, *sent.value, mode, threshold, second), pa.int32())

    if model.votes is not None or mode == "single":
        return facts.withColumn(out_col, _name(label(tx.char_trigram_text(text_col)), names))
    rows = facts.withColumn("_unit", tx.char_trigram_text(text_col))
    rows = rows.withColumn("_number", label("_unit"))
    voted = _voted(rows.where(F.col("_number") == OPEN).select("_unit").distinct(), model, threshold, second)
    number = F.when(F.col("_number") == OPEN, F.coalesce("_second", F.lit(-1))).otherwise(F.col("_number"))
    met = rows.join(voted, (rows["_unit"] == voted["_voted"]) & (rows["_number"] == OPEN), "left")
    return met.withColumn(out_col, _name(number, names)).select(*facts.drop(out_col).columns, out_col)


def _voted(units: DataFrame, model: LidModel, threshold: float, second: np.ndarray) -> DataFrame:
    """(_voted, _second): the secondary label number of distinct normalised texts, by a
    join of their words with the votes."""
    @F.arrow_udf("array<long>")
    def keys(t: pa.Array) -> pa.Array:
        k, begin = word_keys(*code_points(t))
        return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(k.view(np.int64), pa.int64()))

    words = units.select("_unit", F.explode(keys("_unit")).alias("key")).groupBy("_unit", "key").agg(F.count("*").alias("n"))
    per = words.join(model.words, "key").groupBy("_unit", "lang").agg(F.sum("n").alias("n"))
    best = per.groupBy("_unit").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("n"), "lang")).alias("x"))
    number = F.element_at(F.create_map(*[F.lit(v) for x, y in zip(model.langs, second.tolist()) for v in (x, y)]), F.col("x.lang"))
    return best.select(F.col("_unit").alias("_voted"), F.when(-F.col("x.n") / F.col("total") >= threshold, number).otherwise(-1).alias("_second"))


def _joined(array_col: str) -> Column:
    """All elements of an array in one text, lower case and letters only, each ended by
    a line feed: one expression a row instead of one an element."""
    rows = F.array_join(F.transform(array_col, lambda x: F.replace(x, F.lit("\n"), F.lit(" "))), "\n", "")
    return F.when(F.size(array_col) > 0, F.concat(F.regexp_replace(F.lower(rows), r"[^\p{L}\n]+", " "), F.lit("\n")))


def split_units(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the elements that :func:`_joined` put together, each trimmed and padded as
    :func:`tx.char_trigram_text` does; how many each row has)."""
    col = col.fill_null("").cast(pa.string())
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int32, len(col) + 1 + col.offset)[col.offset:].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, np.uint8)
    end = raw == 10
    count = np.diff(np.concatenate([[0], np.cumsum(end)])[o - o[0]])
    at_edge = np.concatenate([end[1:], [True]])[:len(raw)] | np.concatenate([[True], end[:-1]])[:len(raw)]
    raw = raw[(raw != 32) | ~at_edge]
    end = raw == 10  # becomes the blank after a unit and the one before the next
    wide = np.repeat(np.where(end, np.uint8(32), raw), 1 + end.astype(np.int8))
    cut = np.flatnonzero(end) + 2 + np.arange(count.sum())
    text = np.concatenate([np.full(1, 32, np.uint8), wide])[:cut[-1] if len(cut) else 0]
    begin = np.concatenate([[0], cut]).astype(np.int32)
    return pa.StringArray.from_buffers(len(cut), pa.py_buffer(begin.tobytes()), pa.py_buffer(text.tobytes())), count


def _array_labels(col: pa.Array, *how) -> tuple[np.ndarray, np.ndarray]:
    """(label number of every element, elements of every row) of joined arrays."""
    labels, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin, end in pieces(col):
        units, count = split_units(col.slice(begin, end - begin))
        labels.append(detect(units, *how))
        counts.append(count)
    return np.concatenate(labels), np.concatenate(counts)


def _known_votes(model: LidModel) -> None:
    if model.votes is None:
        raise ValueError("too many votes to broadcast: explode the array and use label_column")


def label_array(facts: DataFrame, array_col: str, model: LidModel, out_col: str = "langs", mode: str = "cascade",
                threshold: float = 0.3) -> DataFrame:
    """Label every element of an array of texts, without a shuffle; for models
    whose votes are broadcast."""
    _known_votes(model)
    sent, names, second = _labeller(model, mode)

    @F.arrow_udf("array<int>")
    def label(t: pa.Array) -> pa.Array:
        n, size = _array_labels(t, *sent.value, mode, threshold, second)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(n, pa.int32()))

    return facts.withColumn(out_col, F.transform(label(_joined(array_col)), lambda n: _name(n, names)))


def count_array(facts: DataFrame, array_col: str, model: LidModel, out_col: str = "counts", mode: str = "cascade",
                threshold: float = 0.3) -> DataFrame:
    """L6 + L7: label every element of an array of texts as :func:`label_array` does and
    count them in the row: array of (lang, n), an entry per language that occurs."""
    _known_votes(model)
    sent, names, second = _labeller(model, mode)
    width = len(names)

    @F.arrow_udf("array<struct<label:int,n:long>>")
    def count(t: pa.Array) -> pa.Array:
        label, size = _array_labels(t, *sent.value, mode, threshold, second)
        owner = np.repeat(np.arange(len(size)), size)
        cell, n = np.unique(owner * width + label + 1, return_counts=True)
        entries = pa.StructArray.from_arrays([pa.array(cell % width - 1, pa.int32()), pa.array(n, pa.int64())], names=["label", "n"])
        begin = np.searchsorted(cell // width, np.arange(len(size) + 1))
        return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), entries)

    return facts.withColumn(out_col, F.transform(count(_joined(array_col)), lambda x: F.struct(_name(x["label"], names).alias("lang"), x["n"].alias("n"))))
