"""Text preparation as native Column expressions.

Everything here compiles to JVM expressions (regex, translate, higher-order
functions), so it stays inside Catalyst/Tungsten; no Python worker is used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) -------------------
# ASCII punctuation deleted by completion normalisation (Python's string.punctuation).
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Cut point of a completion: text after the first "\nQ:" is a new prompt.
COMPLETION_CUT = "\nQ:"
# Em dash becomes a space; Arabic comma is deleted.
EM_DASH = "—"
ARABIC_COMMA = "،"
# White space of Python's str.strip() and str.split().
STRIP_CHARS = ("\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
               "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# The same as a regular expression.
STRIP_RE = r"[\t-\r\x1c- \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# Minimum characters of a kept line (distributions) and minimum tokens (pass rates).
MIN_LINE_CHARS = 5
MIN_LINE_TOKENS = 5
# Word/punctuation tokeniser: runs of word characters or runs of other non-space characters.
WORD_PUNCT_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_completion(col) -> Column:
    """Keep text before the first "\\nQ:", strip, delete ASCII punctuation,
    em dash -> space, delete the Arabic comma."""
    t = F.substring_index(_c(col), COMPLETION_CUT, 1)
    t = F.trim(t, F.lit(STRIP_CHARS))
    t = F.translate(t, ASCII_PUNCTUATION, "")
    t = F.replace(t, F.lit(EM_DASH), F.lit(" "))
    return F.replace(t, F.lit(ARABIC_COMMA), F.lit(""))


def split_lines(col) -> Column:
    return F.split(_c(col), "\n")


def kept_lines(col, min_chars: int = MIN_LINE_CHARS) -> Column:
    """Lines with more than ``min_chars`` characters (code points), in order."""
    return F.filter(split_lines(col), lambda x: F.length(x) > min_chars)


def whitespace_tokens(col) -> Column:
    """T5: ``str.split()`` - split on whitespace runs, drop empty strings."""
    return F.array_remove(F.split(_c(col), STRIP_RE), "")


def word_punct_tokens(col) -> Column:
    """Runs of word characters or runs of punctuation (Unicode aware)."""
    return F.regexp_extract_all(_c(col), F.lit(WORD_PUNCT_RE), 0)


def tokenize(col) -> Column:
    """T7 without a language: the general word/punct tokeniser, which is what the
    reference's dispatch effectively does; by language see
    :mod:`langmix.operators.segment`."""
    return word_punct_tokens(col)


def strip_prefix(col, prefix: str = "query: ") -> Column:
    """T8."""
    return F.replace(_c(col), F.lit(prefix), F.lit(""))


def lang_part(col) -> Column:
    """``deu_Latn`` -> ``deu``."""
    return F.split_part(_c(col), F.lit("_"), F.lit(1))


def script_part(col) -> Column:
    """``deu_Latn`` -> ``Latn``."""
    return F.split_part(_c(col), F.lit("_"), F.lit(2))


def ngrams(arr_col, n: int) -> Column:
    """Contiguous n-grams of a token array, each joined with a space;
    empty when the array is shorter than n."""
    a = _c(arr_col)
    return F.when(F.size(a) >= n,
                  F.transform(F.sequence(F.lit(1), F.size(a) - n + 1),
                              lambda i: F.array_join(F.slice(a, i, n), " "))
                  ).otherwise(F.array().cast("array<string>"))


def is_dictionary_word(col) -> Column:
    """Lower-case alphabetic words longer than three characters."""
    c = _c(col)
    return (c == F.lower(c)) & c.rlike("^[a-z]+$") & (F.length(c) > 3)


def char_trigram_text(col) -> Column:
    """Letters-only, lower-cased, space padded text used for trigram profiles."""
    t = F.regexp_replace(F.lower(_c(col)), r"[^\p{L}]+", " ")
    return F.concat(F.lit(" "), F.trim(t), F.lit(" "))
