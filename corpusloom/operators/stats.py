"""Inspection, validation and tokenizer reports of record tables.

Records have the columns of `corpusloom.records`; null texts count as records without characters.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import BYTE_OFFSET, UNK, byte_count


def first(df: DataFrame, limit: int | None, order: str = "ord") -> DataFrame:
    """The first `limit` rows in order; all without a limit."""
    return df if limit is None else df.orderBy(order).limit(limit)


def last(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """The last `limit` rows in order, in order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(limit).orderBy(*order)


def dataset_summary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: records, filled records, characters, UTF-8 bytes."""
    return df.agg(
        F.count("*").alias("records"),
        F.count(F.when(F.length(text_col) > 0, 1)).alias("filled"),
        F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("long").alias("characters"),
        F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).cast("long").alias("bytes_utf8"),
    )


def field_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """`(field, n)`: in how many rows each field is present; one pass over the columns, no row is repeated."""
    counts = df.agg(*[F.count(F.col(f"`{f}`")).alias(f"c{i}") for i, f in enumerate(fields)])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"c{i}").alias("n")) for i, f in enumerate(fields)])
    return counts.select(F.inline(pairs)).where("n > 0")


def map_key_counts(df: DataFrame, map_col: str) -> DataFrame:
    """`(field, n)` over the keys of a map column."""
    return df.select(F.explode(F.map_keys(map_col)).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def group_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def validate(records: DataFrame, issues: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """One row: records, errors, and whether there are records and no errors."""
    errors = issues.where("kind = 'error'").agg(F.count("*").alias("errors")) if issues is not None else records.limit(0).agg(F.count("*").alias("errors"))
    return records.agg(F.count(text_col).alias("records")).crossJoin(errors).withColumn("valid", (F.col("records") > 0) & (F.col("errors") == 0))  # one row each


def training_scan(df: DataFrame, min_chars: int = 1, text_col: str = "text") -> DataFrame:
    """One row: records and characters a tokenizer would be trained on, skipped rows, and rows with replacement characters."""
    used = F.length(F.col(text_col)) >= min_chars
    return df.agg(
        F.count(F.when(used, 1)).alias("records"),
        F.coalesce(F.sum(F.when(used, F.length(text_col))), F.lit(0)).cast("long").alias("characters"),
        F.count(F.when(~F.coalesce(used, F.lit(False)), 1)).alias("skipped"),
        F.count(F.when(F.col(text_col).contains("�"), 1)).alias("invalid"),
    )


def token_counts(df: DataFrame, ids: Column) -> DataFrame:
    """`(token, n)` over all ids."""
    return df.select(F.explode(ids).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def byte_histogram(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`(token, n)` of the byte tokenizer: each task counts its bytes in an array of 256, so only these counts are shuffled."""
    import numpy as np
    import pyarrow as pa

    def run(it):
        n = np.zeros(256, np.int64)
        for batch in it:
            for chunk in batch.column(0).cast(pa.large_string()).drop_null().cast(pa.large_binary()).to_pylist():
                n += np.bincount(np.frombuffer(chunk, np.uint8), minlength=256)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array((at + BYTE_OFFSET).astype(np.int32)), pa.array(n[at])], ["token", "n"])

    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def tokenizer_report(df: DataFrame, text_col: str = "text", encode=None) -> DataFrame:
    """One row: documents, characters, bytes, tokens, characters and bytes a token, different tokens, share of unknown ones."""
    rows = df.where(F.col(text_col).isNotNull())
    size = byte_count(F.col(text_col)) if encode is None else F.size(encode(F.col(text_col)))
    sums = rows.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("long").alias("characters"),
        F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).cast("long").alias("bytes_utf8"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("tokens"),
    )
    counts = byte_histogram(rows, text_col) if encode is None else token_counts(rows, encode(F.col(text_col)))
    kinds = counts.agg(F.count("*").alias("unique_tokens"), F.coalesce(F.sum(F.when(F.col("token") == UNK, F.col("n"))), F.lit(0)).alias("unk"))
    per = lambda c: c / F.greatest(F.col("tokens"), F.lit(1))
    return sums.crossJoin(kinds).select(  # one row each
        "documents", "characters", "bytes_utf8", "tokens", per(F.col("characters")).alias("chars_per_token"), per(F.col("bytes_utf8")).alias("bytes_per_token"), "unique_tokens", per(F.col("unk")).alias("unk_rate")
    )


def top_tokens(counts: DataFrame, k: int = 50) -> DataFrame:
    """The `k` most frequent tokens, the lower id first on ties."""
    return counts.orderBy(F.desc("n"), "token").limit(k)


def repetition_score(ids: Column, n: int = 3) -> Column:
    """One minus the share of different n-grams; 0 for fewer than n ids."""
    count = F.size(ids) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(ids, i, n), " "))
    return F.when(count < 1, 0.0).otherwise(1.0 - F.size(F.array_distinct(grams)) / F.greatest(count, F.lit(1)))


def distinct_ratio(ids: Column) -> Column:
    return F.when(F.size(ids) > 0, F.size(F.array_distinct(ids)) / F.size(ids)).otherwise(0.0)


def repetitive_tail(ids: Column, window: int = 64, threshold: float = 0.85) -> Column:
    """Whether the end of an id sequence only repeats itself: few different ids, one of 2 to 4 ids four times, or little new in a full window."""
    n = F.size(ids)
    tail = F.when(n > window, F.slice(ids, -window, window)).otherwise(ids)
    t, kinds = F.size(tail), F.size(F.array_distinct(tail))
    cycles = F.lit(False)
    for k in (2, 3, 4):
        end = F.slice(tail, -4 * k, 4 * k)
        cycles = cycles | ((t >= 4 * k) & (F.slice(end, 1, 3 * k) == F.slice(end, k + 1, 3 * k)))
    low = (1.0 - kinds / F.greatest(t, F.lit(1)) >= threshold) & (t >= window)
    return (n >= max(16, window // 2)) & (((kinds <= 2) & (t >= 16)) | F.coalesce(cycles, F.lit(False)) | low)


def stop_match(ids: Column, stop: list[int]) -> Column:
    """Whether a sequence ends with `stop`."""
    k = len(stop)
    return (F.size(ids) >= k) & (F.slice(ids, -k, k) == F.array(*[F.lit(x) for x in stop]))


def banned_next(ids: Column, n: int) -> Column:
    """The ids that would complete an n-gram the sequence already holds."""
    m = F.size(ids)
    tail = F.slice(ids, -(n - 1), n - 1)
    starts = F.sequence(F.lit(1), F.greatest(m - n + 1, F.lit(1)))
    hit = F.filter(starts, lambda i: F.slice(ids, i, n - 1) == tail)
    return F.when(m >= n, F.array_sort(F.array_distinct(F.transform(hit, lambda i: F.element_at(ids, i + (n - 1)))))).otherwise(F.array().cast("array<int>"))


def tokenizer_benchmark(df: DataFrame, encode, text_col: str = "text") -> dict:
    """Characters and tokens a second of a tokenizer over all texts; counted on the executors, timed on the driver."""
    began = time.perf_counter()
    row = df.where(F.col(text_col).isNotNull()).agg(F.count("*").alias("records"), F.sum(F.length(text_col)).alias("chars"), F.sum(F.size(encode(F.col(text_col)))).alias("tokens")).first()
    seconds = max(time.perf_counter() - began, 1e-9)
    chars, tokens = row.chars or 0, row.tokens or 0
    return {"records": row.records, "characters": chars, "tokens": tokens, "seconds": seconds, "chars_per_s": chars / seconds, "tokens_per_s": tokens / seconds}


def longest_prefix(queries: DataFrame, prefixes: DataFrame, key: str = "key", ids_col: str = "ids") -> DataFrame:
    """`(key, length)`: of each id sequence, the longest of `prefixes(ids)` that it begins with; 0 where none.

    Sequences are cut at the lengths that prefixes have (few, as cached prefixes are) and joined by hash, not compared in pairs.
    """
    sizes = F.broadcast(prefixes.select(F.size(ids_col).alias("length")).distinct().agg(F.collect_set("length").alias("lengths")))  # one row
    cuts = queries.select(key, ids_col).crossJoin(sizes).select(key, ids_col, F.explode_outer(F.filter("lengths", lambda n: n <= F.size(ids_col))).alias("length"))
    hashed = cuts.select(key, "length", F.xxhash64(F.slice(ids_col, F.lit(1), F.coalesce("length", F.lit(0)))).alias("h"))
    known = prefixes.select(F.size(ids_col).alias("length"), F.xxhash64(ids_col).alias("h")).distinct().withColumn("hit", F.lit(True))
    found = hashed.join(known, ["length", "h"], "left")
    return found.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("hit"), F.col("length"))), F.lit(0)).alias("length"))
