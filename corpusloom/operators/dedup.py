"""Exact and fingerprint-based near deduplication; the first row in the order of a key survives.

Null texts form one group of repeats. Order keys must be unique; ties between equal keys are not settled.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

_WORD = regex.compile(r"[\p{L}\p{N}_]+")


def text_key(c: Column) -> Column:
    """128 bits that stand for a text; null has a key of its own."""
    return F.coalesce(F.unhex(F.md5(c)), F.lit(b""))


def _repeated(df: DataFrame, text_col: str, order: str) -> DataFrame:
    """`(_key, _first)` of the texts that occur more than once: counted on keys and hashes, with partial sums in each task."""
    keys = df.select(F.col(order).alias("_o"), text_key(F.col(text_col)).alias("_key"))
    return keys.groupBy("_key").agg(F.min("_o").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_key", "_first")


def repeats(df: DataFrame, text_col: str = "text", order: str = "ord") -> DataFrame:
    """The order keys of all rows whose text an earlier row has. Only keys and hashes are shuffled, never texts."""
    keys = df.select(F.col(order), text_key(F.col(text_col)).alias("_key"))
    return keys.join(_repeated(df, text_col, order), "_key").where(F.col(order) != F.col("_first")).select(order)


def exact_dedup(df: DataFrame, text_col: str = "text", order: str = "ord") -> DataFrame:
    """Rows whose text occurs first in `order`.

    One pass counts hashes, a second keeps the first of each repeated one. The repeated hashes are few as a rule, so AQE
    broadcasts them and no text is shuffled; where they are many, the join is shuffled, and hot hashes are split.
    """
    marked = df.withColumn("_key", text_key(F.col(text_col))).join(_repeated(df, text_col, order), "_key", "left")
    return marked.where(F.col("_first").isNull() | (F.col(order) == F.col("_first"))).select(*df.columns)


def without_seen(df: DataFrame, corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text an existing corpus lacks (texts are compared by hash)."""
    seen = corpus.select(text_key(F.col(text_col)).alias("_key")).distinct()
    return df.withColumn("_key", text_key(F.col(text_col))).join(seen, "_key", "left_anti").drop("_key")


@lru_cache(maxsize=1 << 18)
def _token_bits(token: str, algorithm: str) -> int:
    raw = token.encode("utf-8", "ignore")
    digest = hashlib.md5(raw).digest() if algorithm == "md5" else hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(digest[8:], "big")


#: Words of a batch whose bits are added up at once; bounds memory only.
WORDS_AT_ONCE = 1 << 18


def simhashes(texts: list[str], algorithm: str = "blake2b") -> np.ndarray:
    """64-bit similarity hashes of texts by their words with multiplicity; 0 for a text without words.

    The words of all texts are numbered once; their signed bits are gathered in one matrix and added up text by text.
    """
    found = [_WORD.findall(t.lower()) for t in texts]
    number, words = pd.factorize(np.array([w for ws in found for w in ws], object))
    bits = np.array([_token_bits(w, algorithm) for w in words], ">u8").view(np.uint8).reshape(-1, 8)
    signs = (2 * np.unpackbits(bits, axis=1).astype(np.int8) - 1).reshape(-1, 64)
    doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in found])
    total = np.zeros((len(texts), 64), np.int64)
    for at in range(0, len(doc), WORDS_AT_ONCE):
        d, k = doc[at : at + WORDS_AT_ONCE], number[at : at + WORDS_AT_ONCE]
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        total[d[first]] += np.add.reduceat(signs[k], first, axis=0, dtype=np.int64)
    return np.packbits(total > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def simhash64(text: str, algorithm: str = "blake2b") -> int:
    """`simhashes` of one text."""
    return int(simhashes([text], algorithm)[0])


def simhash(c: Column, algorithm: str = "blake2b") -> Column:
    """`simhashes` as a signed long column."""

    @F.arrow_udf("long")
    def run(values: pa.Array) -> pa.Array:
        got = simhashes(values.drop_null().to_pylist(), algorithm).view(np.int64)
        out, there = np.zeros(len(values), np.int64), np.asarray(values.is_valid())
        out[there] = got
        return pa.array(out, mask=~there)

    return run(c)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint_pairs(prints: DataFrame, distance: int = 3, crowd: int = 16) -> DataFrame:
    """`(a, b)`, a < b: different fingerprints of `prints(fp)` at most `distance` bits apart.

    Cut into `distance` + n blocks, such a pair agrees in n blocks; it is found by an equi-join on each choice of n.
    n grows with the number of fingerprints, so that about `crowd` of them share a key at most. Equal fingerprints
    are one row, so empty texts are no hot key.
    """
    one = materialize(prints.select("fp").distinct(), "prints")
    total, n = one.count(), 1
    while n < 5 and total / 2 ** (64 * n // (distance + n)) > crowd:
        n += 1
    m = distance + n
    edges = [64 * k // m for k in range(m + 1)]
    keys = []
    for pick in combinations(range(m), n):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in pick)
        keys.append(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    rows = one.select("fp", F.posexplode(F.array(*keys)).alias("k", "v"))
    a, b = rows.select("k", "v", F.col("fp").alias("a")), rows.select("k", "v", F.col("fp").alias("b"))
    near = a.join(b, ["k", "v"]).where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= distance))
    return near.select("a", "b").distinct()


def near_pairs(df: DataFrame, id_col: str, text_col: str = "text", distance: int = 3, algorithm: str = "blake2b") -> DataFrame:
    """`(id_a, id_b)` with id_a < id_b: rows whose similarity hashes differ in at most `distance` bits."""
    rows = df.select(F.col(id_col).alias("id"), simhash(F.col(text_col), algorithm).alias("fp")).where("fp is not null")
    rows = materialize(rows, "simhash")
    fps = fingerprint_pairs(rows, distance)
    both = fps.unionByName(fps.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(rows.select(F.col("fp").alias("a"), F.col("fp").alias("b")).distinct())
    x, y = rows.select(F.col("fp").alias("a"), F.col("id").alias("id_a")), rows.select(F.col("fp").alias("b"), F.col("id").alias("id_b"))
    return both.join(x, "a").join(y, "b").where("id_a < id_b").select("id_a", "id_b")


def near_dedup(df: DataFrame, text_col: str = "text", order: str = "ord", distance: int = 3, algorithm: str = "blake2b") -> DataFrame:
    """Rows that a greedy pass in `order` keeps: those at no kept earlier row's distance.

    That is the lexicographically first maximal independent set of the pairs of fingerprints, found in rounds: a
    fingerprint whose earlier neighbours are all dropped is kept, its later neighbours are dropped. Every round settles the first of
    those left at least, so there are at most as many rounds as the longest chain of neighbours in order is long; each works on what is left only.
    """
    rows = materialize(df.select(F.col(order).alias("o"), simhash(F.col(text_col), algorithm).alias("fp")), "simhash")
    first = rows.where("fp is not null").groupBy("fp").agg(F.min("o").alias("o"))
    pairs = fingerprint_pairs(rows.where("fp is not null"), distance)
    at = first.select("fp", "o")
    edges = (
        pairs.join(at.select(F.col("fp").alias("a"), F.col("o").alias("oa")), "a")
        .join(at.select(F.col("fp").alias("b"), F.col("o").alias("ob")), "b")
        .select(F.least("oa", "ob").alias("early"), F.greatest("oa", "ob").alias("late"))
    )
    edges = materialize(edges, "edges")
    dropped = None
    left = edges
    while not left.isEmpty():
        waiting = left.select("late").distinct()
        kept = left.select("early").distinct().join(waiting.withColumnRenamed("late", "early"), "early", "left_anti")
        gone = materialize(left.join(kept, "early", "left_semi").select(F.col("late").alias("o")).distinct(), "dropped")
        dropped = gone if dropped is None else dropped.union(gone)
        settled = gone.withColumnRenamed("o", "early")
        left = left.join(settled, "early", "left_anti").join(gone.withColumnRenamed("o", "late"), "late", "left_anti")
        left = materialize(left.join(kept, "early", "left_anti"), "edges")
    later = rows.join(first.withColumnRenamed("o", "first"), "fp").where(F.col("o") != F.col("first")).select("o")
    out = df.join(later.withColumnRenamed("o", order), order, "left_anti")
    return out if dropped is None else out.join(dropped.withColumnRenamed("o", order), order, "left_anti")
