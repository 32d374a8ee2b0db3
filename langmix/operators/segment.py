"""Tokens of text written without spaces (T7): the cheapest split into known words.

A unigram model is counted in Spark: a word costs ``ln(total / count)``, a character
that no word covers ``ln(total) + 3``.  The model keeps the ``VOCABULARY`` most frequent
words (a bound of the model, ties by word).  Splitting is a dynamic program over the
characters of one text, in an Arrow function where the text is read; among splits of
equal cost the last word is the longest.  Null texts give null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langmix.functions import text as tx

VOCABULARY = 200_000
LONGEST = 24  # characters of a word


@dataclass
class Unigrams:
    costs: dict[str, float]
    unknown: float
    longest: int

    @cached_property
    def endings(self) -> dict[str, float]:
        """The cost of every word and of every ending of one, which is infinite unless
        it is a word itself: a search back from a character stops where no word goes on."""
        out = {w[k:]: math.inf for w in self.costs for k in range(len(w))}
        out.update(self.costs)
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "endings"}  # each process makes its own

    def split(self, text: str) -> list[str]:
        best, back, endings, longest = [0.0], [0], self.endings, self.longest
        for end in range(1, len(text) + 1):
            low, at = best[end - 1] + self.costs.get(text[end - 1], self.unknown), end - 1
            for begin in range(end - 2, max(-1, end - longest - 1), -1):
                cost = endings.get(text[begin:end])
                if cost is None:
                    break
                if best[begin] + cost <= low:
                    low, at = best[begin] + cost, begin
            best.append(low)
            back.append(at)
        words, end = [], len(text)
        while end:
            words.append(text[back[end]:end])
            end = back[end]
        return words[::-1]


def learn(words: DataFrame, col: str, vocabulary: int = VOCABULARY) -> Unigrams:
    """Unigram costs from a column of words."""
    counts = words.where(F.length(col).between(1, LONGEST)).groupBy(F.col(col).alias("w")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    top = counts.orderBy(F.desc("n"), "w").limit(vocabulary).collect()
    return Unigrams({r.w: math.log(total / r.n) for r in top}, math.log(total) + 3, max((len(r.w) for r in top), default=1))


def tokens_by_language(df: DataFrame, text_col: str, lang_col: str, model: Unigrams, no_space_langs: Sequence[str], out: str = "tokens") -> DataFrame:
    """Words by the model where the language is written without spaces, else runs
    of word characters or punctuation."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        m = held.value
        return pa.array([None if t is None else [w for part in t.split() for w in m.split(part)] for t in texts.to_pylist()], pa.list_(pa.string()))

    spaceless = F.coalesce(F.col(lang_col).isin(*no_space_langs), F.lit(False))
    # only the texts that need it reach the function
    own = split(F.when(spaceless, F.col(text_col)))
    general: Column = tx.word_punct_tokens(text_col)
    return df.withColumn(out, F.when(spaceless, own).otherwise(general))
