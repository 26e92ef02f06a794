"""Text normalisation and tokenisation as JVM-side column expressions.

Tokens are maximal runs of Unicode letters and digits after lower-casing
and folding Latin diacritics (``é`` -> ``e``), matching the default
full-text tokenizer of the reference's search index.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}]+"


@functools.lru_cache(maxsize=1)
def diacritic_fold_table() -> tuple[str, str]:
    """(from_chars, to_chars) for ``translate``: Latin letters with marks -> base letter.

    Built by rule from Unicode decompositions over Latin-1 Supplement,
    Latin Extended-A/B and Latin Extended Additional: a character whose canonical decomposition is an
    ASCII letter followed only by combining marks maps to that letter.
    """
    src, dst = [], []
    for cp in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        ch = chr(cp)
        d = unicodedata.normalize("NFD", ch)
        if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(
                unicodedata.combining(c) for c in d[1:]):
            src.append(ch)
            dst.append(d[0])
    return "".join(src), "".join(dst)


@functools.lru_cache(maxsize=1)
def combining_marks() -> str:
    """All marks (category M) of the basic plane."""
    return "".join(c for c in map(chr, range(0x300, 0xFFFF)) if unicodedata.category(c).startswith("M"))


def normalize(text: Column) -> Column:
    """lower-case, drop combining marks (a decomposed accent splits no word), then fold Latin diacritics."""
    a, b = diacritic_fold_table()
    # characters that have no counterpart are dropped: one pass folds and strips
    low = F.lower(text)
    # a text of ASCII only (as many bytes as characters) has nothing to fold
    return F.when(F.octet_length(text) == F.char_length(text), low).otherwise(F.translate(low, a + combining_marks(), b))


def tokens(text: Column) -> Column:
    """array<string> of normalised tokens (empty array for NULL text)."""
    return F.coalesce(F.regexp_extract_all(normalize(text), F.lit(TOKEN_PATTERN), 0),
                      F.array().cast("array<string>"))


def raw_tokens(text: Column) -> Column:
    """Tokens with original case and accents (same boundaries as ``tokens``)."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"), 0), F.array().cast("array<string>"))


def py_tokens(text: str) -> list[str]:
    """Python twin of ``tokens`` for tokenising a (small) query string on the driver."""
    import regex

    a, b = diacritic_fold_table()
    t = regex.sub(r"\p{M}+", "", (text or "").lower()).translate(str.maketrans(a, b))
    return regex.findall(TOKEN_PATTERN, t)
