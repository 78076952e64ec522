"""Texts that look the same but are stored as different characters (problem 5).

Method: compatibility normalisation in composed form, full case folding, mapped blanks, removal of
default-ignorable characters (see `forms`), computed per distinct value of a batch. The folded form
is the blocking key; an exact check on the visual form follows, because letter case and raised
digits are differences to a reader.

Defined cases: null text has null forms and no pairs; texts under `least_chars` characters have no
pairs; rows repeated under one id count once, rows without an id not at all; texts equal but for outer blanks and CRLF are stored
alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

from . import forms

FORM_TYPES = "id long, key long, look long, look2 long, stored long, length int, side byte"


def normalized(text: Column, fold: bool = False) -> Column:
    """The one consistent form of a text column; with `fold`, the case-folded key form."""

    @F.pandas_udf("string")
    def run(values):
        distinct = {v: forms.visual_form(v) for v in values.dropna().unique()}
        if fold:
            distinct = {k: forms.fold_key(v) for k, v in distinct.items()}
        return values.map(distinct)

    return run(text)


def look_hashes(df: DataFrame) -> DataFrame:
    """Hashes of the folded form, the visual form and the stored text (outer blanks and CRLF settled) of `df(id, text, side)`."""

    def h(data: bytes) -> bytes:
        return hashlib.blake2b(data, digest_size=16).digest()

    def run(it):
        for batch in it:
            texts = batch.column("text").to_pylist()
            n = len(texts)
            out = np.zeros((n, 4), np.int64)
            length = np.zeros(n, np.int32)
            seen: dict[str, int] = {}
            for ix in forms.batches(texts):
                own = [i for i in ix if seen.setdefault(texts[i], i) == i]
                codes, starts = forms.form_codes([texts[i] for i in own])
                ascii_ = codes.dtype == np.uint8
                for k, i in enumerate(own):
                    look = codes[starts[k] : starts[k + 1] - 1]
                    length[i] = len(look)
                    raw = texts[i].strip().replace("\r\n", "\n")
                    form = look.tobytes().decode("latin-1") if ascii_ else look.tobytes().decode("utf-32-le")
                    visual = h(form.encode())
                    key = forms.fold_key(form) if not form.isascii() else form.lower()
                    stored = visual if form == raw else h(raw.encode())
                    out[i] = *np.frombuffer(h(key.encode()), np.int64)[:1], *np.frombuffer(visual, np.int64), *np.frombuffer(stored, np.int64)[:1]
            keep = [i for i, x in enumerate(texts) if x is not None]
            first = np.array([seen[texts[i]] for i in keep], np.int64)
            if not keep:
                continue
            v, ids = out[first], batch.column("id").take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), *(pa.array(v[:, c]) for c in range(4)), pa.array(length[first]), batch.column("side").take(pa.array(keep))],
                ["id", "key", "look", "look2", "stored", "length", "side"],
            )

    return df.select("id", "text", "side").mapInArrow(run, FORM_TYPES)


def same_look_pairs(df: DataFrame, id_col: str = "record_id", text_col: str = "text", least_chars: int = 16) -> DataFrame:
    """`(id_a, id_b)` with id_a < id_b: texts of at least `least_chars` characters that look the same but are stored differently.

    Only pairs of different stored variants of one look are joined, so many equal copies cost no pairs.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("byte").alias("side")).where("id is not null")
    have = look_hashes(rows).where(F.col("length") >= least_chars)
    by = ["key", "look", "look2"]
    have = materialize(have.select(*by, "stored", "id").distinct(), "looks")  # five numbers a record, so that texts are read once
    variants = have.select(*by, "stored").distinct()
    several = variants.groupBy(*by).agg(F.collect_set("stored").alias("all")).where(F.size("all") > 1)
    pair = several.select(*by, F.explode("all").alias("stored"), "all").select(*by, F.col("stored").alias("s1"), F.explode("all").alias("s2")).where("s1 < s2")
    a = have.select(*by, F.col("stored").alias("s1"), F.col("id").alias("x"))
    b = have.select(*by, F.col("stored").alias("s2"), F.col("id").alias("y"))
    return (
        pair.join(a, [*by, "s1"])
        .join(b, [*by, "s2"])
        .where("x <> y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .distinct()
    )
