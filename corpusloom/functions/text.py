"""Text functions as column expressions; all but `nfkc` stay in the JVM.

Null text gives null everywhere. White space is what Python's `str.isspace` accepts.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space of Unicode and the four information separators, in Java and RE2 syntax.
SPACE_CLASS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STRIP = rf"\A[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z"
RSTRIP = rf"[{SPACE_CLASS}]+\z"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, RSTRIP, "")


def unix_lines(c: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def normalize_text(c: Column) -> Column:
    """Unix line ends, outer white space stripped, one line end appended."""
    return F.concat(strip(unix_lines(c)), F.lit("\n"))


def drop_nul(c: Column) -> Column:
    return F.regexp_replace(c, r"\x00", "")


@F.arrow_udf(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    ascii_ = pc.string_is_ascii(values)
    if pc.all(ascii_, skip_nulls=True).as_py() in (True, None):
        return values
    return pa.array([v if v is None or v.isascii() else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def nfkc(c: Column) -> Column:
    """Compatibility composition; batches of ASCII text pass unchanged."""
    return _nfkc(c)


def sanitize_text(c: Column) -> Column:
    """Without NULs, in compatibility composition, normalised line ends."""
    return normalize_text(nfkc(drop_nul(c)))


def clean_text(c: Column, normalize_unicode: bool = True, collapse_whitespace: bool = False) -> Column:
    """Without NULs, optionally in compatibility composition and with runs of blanks and of empty lines shortened."""
    c = drop_nul(c)
    if normalize_unicode:
        c = nfkc(c)
    c = unix_lines(c)
    if collapse_whitespace:
        c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{4,}", "\n\n\n")
    return F.concat(strip(c), F.lit("\n"))


def truncate(c: Column, max_chars: int) -> Column:
    """Texts over `max_chars` characters cut there, stripped on the right and ended by a line end."""
    return F.when(F.length(c) > max_chars, F.concat(rstrip(F.substring(c, 1, max_chars)), F.lit("\n"))).otherwise(c)


def language_label(c: Column) -> Column:
    """`en` where more than 85 percent of the characters are ASCII, else `unknown`."""
    ascii_ = F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    return F.when(ascii_ / F.greatest(F.length(c), F.lit(1)) > 0.85, "en").otherwise("unknown")


def path_suffix(c: Column) -> Column:
    """The lower-cased last suffix of a path, empty without one."""
    name = F.regexp_extract(c, r"([^/]*)\z", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)\z", 1))
