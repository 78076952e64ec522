"""Formats by path."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import path_suffix

from . import storage

# Formats by suffix.
SUFFIX_FORMATS = {
    ".zip": "archive", ".tar": "archive", ".tgz": "archive", ".gz": "archive", ".jsonl": "jsonl", ".json": "json", ".csv": "csv", ".tsv": "csv", ".yaml": "yaml", ".yml": "yaml",
    ".xml": "xml", ".sqlite": "sqlite", ".db": "sqlite", ".parquet": "parquet", ".arrow": "arrow", ".bin": "pretokenized", ".npy": "pretokenized", ".npz": "pretokenized",
}


def detect_format(path: str) -> str:
    """The format of one path; paths without a known suffix are directories where they exist as such, else text."""
    low = path.lower()
    if path.startswith(("hf://", "hf:")):
        return "huggingface"
    if path.startswith(("http://", "https://")):
        return "http-jsonl" if low.split("?", 1)[0].endswith(".jsonl") else "http-text"
    found = SUFFIX_FORMATS.get(os.path.splitext(low)[1])
    return found or ("directory" if storage.is_dir(path) else "text")


def format_of(path: Column) -> Column:
    """As `detect_format` over a column; there are no directories in it."""
    suffix = path_suffix(path)
    out = F.when(path.rlike("^hf:"), "huggingface").when(path.rlike(r"^https?://") & F.lower(F.split_part(path, F.lit("?"), F.lit(1))).endswith(".jsonl"), "http-jsonl").when(path.rlike(r"^https?://"), "http-text")
    for s, name in SUFFIX_FORMATS.items():
        out = out.when(suffix == s, name)
    return out.otherwise("text")


def sql_format(path: str) -> str:
    """The same rule in SQL."""
    suffix = f"lower(regexp_extract(regexp_extract({path}, '([^/]*)$', 1), '[^.](\\.[^.]+)$', 1))"
    cases = " ".join(f"when {suffix} = '{s}' then '{name}'" for s, name in SUFFIX_FORMATS.items())
    return f"case when {path} like 'hf:%' then 'huggingface' when {path} like 'http%' and lower(split_part({path}, '?', 1)) like '%.jsonl' then 'http-jsonl' when {path} like 'http%' then 'http-text' {cases} else 'text' end"
