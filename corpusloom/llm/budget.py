"""Token totals per source, language and domain (problem 4).

Method: whole documents are hashed and deduplicated, each distinct text is tokenized once, the exact
count is joined back by hash, and totals are taken with the multiplicities of each hash within
source, language and domain.

Defined cases: null and empty texts count as documents of no tokens; null source, language and domain
are groups of their own (null); spellings of one language (`en-US`, `EN`, `eng`) are one language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encode import TOKENIZER_DIR, count_tokens

# Three-letter and mistaken codes of languages that have a two-letter code.
LANGUAGE_CODES = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "rus": "ru", "jpn": "ja", "jp": "ja",
    "ita": "it", "nld": "nl", "dut": "nl", "zho": "zh", "chi": "zh", "kor": "ko", "ara": "ar", "pol": "pl", "ukr": "uk", "ua": "uk",
}


def language_code(lang: Column) -> Column:
    """The plain code of a language in any of its spellings; blank is null."""
    base = F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]+)", 1)
    out = base
    for long, short in LANGUAGE_CODES.items():
        out = F.when(base == long, short).otherwise(out)
    return F.when(F.length(base) > 0, out)


def document_tokens(df: DataFrame, text_col: str = "text", tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """`(hash, tokens)`: each distinct text once, tokenized once; `tokenizer` may also be `byte` (one token a UTF-8 byte)."""
    hashed = df.select(F.unhex(F.md5(text_col)).alias("hash"), F.col(text_col).alias("text")).where("text is not null")
    if tokenizer == "byte":
        return hashed.select("hash", F.octet_length("text").cast("long").alias("tokens")).distinct()
    return count_tokens(hashed.groupBy("hash").agg(F.first("text").alias("text")), "text", tokenizer, directory)


def token_totals(df: DataFrame, text_col: str = "text", by: tuple[str, ...] = ("source", "lang", "domain"), tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """`by`, documents, characters, tokens: totals over all documents, copies included. `lang` is brought to plain codes."""
    keys = [language_code(F.col(c)).alias(c) if c == "lang" else F.col(c) for c in by]
    many = (
        df.select(*keys, F.unhex(F.md5(text_col)).alias("hash"), F.length(text_col).cast("long").alias("chars"))
        .groupBy(*by, "hash")
        .agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    )
    counted = many.join(document_tokens(df, text_col, tokenizer, directory), "hash", "left")
    return counted.groupBy(*by).agg(
        F.sum("n").alias("documents"),
        F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("characters"),
        F.coalesce(F.sum(F.col("tokens") * F.col("n")), F.lit(0)).cast("long").alias("tokens"),
    )
