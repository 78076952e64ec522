"""Cleaning and filtering of records.

Null texts are dropped by the length filter; equal texts are settled by the order key; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

from . import dedup

# Suffixes of files that count as source code.
CODE_SUFFIXES = (".py", ".c", ".h", ".cpp", ".hpp", ".cc", ".js", ".jsx", ".ts", ".tsx", ".rs", ".pwn", ".inc", ".md", ".toml", ".yaml", ".yml", ".json")


@dataclass(frozen=True)
class CleaningConfig:
    """What `clean_records` does, with the usual defaults."""

    min_chars: int = 16
    max_chars: int | None = None
    normalize_unicode: bool = True
    collapse_whitespace: bool = False
    deduplicate: bool = True
    near_deduplicate: bool = False
    lang_filter: str | None = None


def is_code(path: Column) -> Column:
    """Whether a path has the suffix of source code."""
    return T.path_suffix(path).isin(*CODE_SUFFIXES)


def looks_binary(content: Column) -> Column:
    """Whether the first 4096 bytes hold a NUL."""
    return F.hex(F.substring(content, 1, 4096)).rlike("^(..)*00")


def length_filter(df: DataFrame, min_chars: int = 16, text_col: str = "text") -> DataFrame:
    """Rows of at least `min_chars` characters, the closing line end included."""
    return df.where(F.length(text_col) >= min_chars)


def language_filter(df: DataFrame, lang: str, text_col: str = "text") -> DataFrame:
    return df.where(T.language_label(F.col(text_col)) == lang)


def clean_records(df: DataFrame, config: CleaningConfig = CleaningConfig(), text_col: str = "text", order: str = "ord") -> DataFrame:
    """Clean, filter by length, truncate, filter by language, drop exact and then near repeats; the first by `order` wins."""
    out = df.withColumn(text_col, T.clean_text(F.col(text_col), config.normalize_unicode, config.collapse_whitespace))
    out = length_filter(out, config.min_chars, text_col)
    if config.max_chars:
        out = out.withColumn(text_col, T.truncate(F.col(text_col), config.max_chars))
    if config.lang_filter:
        out = language_filter(out, config.lang_filter, text_col)
    if config.deduplicate:
        out = dedup.exact_dedup(out, text_col, order)
    if config.near_deduplicate:
        out = dedup.near_dedup(out, text_col, order)
    return out
