"""Tokens: longest runs of characters other than space, tab, line feed and carriage return."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = "[^ \\t\\n\\r]+"
_TOKEN = re.compile("[^ \t\n\r]+")


def token_count(text: Column | str) -> Column:
    """Number of tokens as INT; null text has none. Stays in the JVM, one pass over the text."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERN)), F.lit(0))


def tokens(text: Column | str) -> Column:
    """The tokens as an array; null for null."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def first_tokens(text: str | Column, count: str | Column, limit: int) -> Column:
    """The text, or its first ``limit`` tokens joined by spaces where it has more."""
    text = F.col(text) if isinstance(text, str) else text
    count = F.col(count) if isinstance(count, str) else count
    return F.when(count > limit, F.array_join(F.slice(tokens(text), 1, limit), " ")).otherwise(F.coalesce(text, F.lit("")))


def token_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every token, on a worker."""
    return [m.span() for m in _TOKEN.finditer(text)]


class Tokenizer(Protocol):
    """What can stand in for the default token: a callable pair that gives a text back from its tokens."""

    def encode(self, text: str) -> list: ...

    def decode(self, tokens: list) -> str: ...


class Lossless:
    """The default: tokens with the white space that follows them, so that decoding gives the text back."""

    _PART = re.compile("[ \t\n\r]*[^ \t\n\r]+[ \t\n\r]*$|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+$")

    def encode(self, text: str) -> list[str]:
        return self._PART.findall(text)

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens)


class FromFile:
    """A public tokenizer from its vocabulary file (JSON); the file is loaded once a worker."""

    def __init__(self, path: str):
        self.path = path

    @lru_cache(maxsize=4)  # noqa: B019
    def _loaded(self):
        from tokenizers import Tokenizer as Loaded

        return Loaded.from_file(self.path)

    def encode(self, text: str) -> list[int]:
        return self._loaded().encode(text, add_special_tokens=False).ids

    def decode(self, tokens: list[int]) -> str:
        return self._loaded().decode(tokens, skip_special_tokens=False)

    def __getstate__(self):
        return {"path": self.path}


def count_with(tokenizer: Tokenizer, text: Column | str) -> Column:
    """Number of tokens by a tokenizer; null text has none."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(tokenizer.encode(t)) if t is not None else 0)

    return count(F.col(text) if isinstance(text, str) else text)


def first_with(tokenizer: Tokenizer, text: Column | str, limit: int) -> Column:
    """The first ``limit`` tokens by a tokenizer, decoded; null for null."""

    @F.pandas_udf("string")
    def first(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else tokenizer.decode(tokenizer.encode(t)[:limit]))

    return first(F.col(text) if isinstance(text, str) else text)
