"""Splitting of a text into byte-level BPE pieces, as the vocabulary's pattern does."""

from __future__ import annotations

import re

import regex
from public_tokenizers import PATTERN

_UNICODE = regex.compile(PATTERN)


def _spelt_out(last: int) -> re.Pattern:
    """The pattern with its classes spelt out up to a code point, which the standard library matches faster."""
    own = {kind: "".join(re.escape(chr(c)) for c in range(last + 1) if regex.match(kind, chr(c))) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    out = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(own.values())}]")
    for kind, chars in own.items():
        out = out.replace(kind, f"[{chars}]")
    return re.compile(out.replace(r"\S", f"[^{own[r'\s']}]"))


_ASCII, _LATIN = _spelt_out(127), _spelt_out(255)


def split(text: str) -> list[str]:
    """The pattern's matches; together they are the whole text."""
    if text.isascii():
        return _ASCII.findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _UNICODE.findall(text)
    return _LATIN.findall(text)
