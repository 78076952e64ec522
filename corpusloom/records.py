"""The record table: text, where it came from, and typed metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of every source's records. `ord` is a total order: source path, then line, row or entry.
SCHEMA = "ord string, text string, source string, format string, suffix string, line bigint, index bigint, table string, tag string, mode string"
FIELDS = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]
ISSUES = "source string, message string, kind string"


def as_records(df: DataFrame, **given) -> DataFrame:
    """`df` with the columns of a record: present ones, `given` ones, the rest null."""
    kinds = dict(f.strip().split(" ") for f in SCHEMA.split(","))
    cols = []
    for name in FIELDS:
        value = given.get(name, F.col(name) if name in df.columns else None)
        value = F.lit(value) if value is None or isinstance(value, (str, int)) else value
        cols.append(value.cast(kinds[name]).alias(name))
    return df.select(*cols)


def order_key(source, number):
    """A key that sorts by source, then by number; 19 digits hold every long that isn't negative."""
    return F.concat(source, F.lit("\x01"), F.lpad(F.coalesce(number, F.lit(0)).cast("string"), 19, "0"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of several record tables."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
