"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: White space as a class of RE2, as `corpusloom.functions.text` has it.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_rstrip(x: str) -> str:
    return f"regexp_replace({x}, '[{SPACE}]+$', '')"


def sql_lines(x: str) -> str:
    return f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"


def sql_normalize(x: str) -> str:
    return f"({sql_strip(sql_lines(x))} || chr(10))"


def sql_no_nul(x: str) -> str:
    return f"regexp_replace({x}, '\\x00', '', 'g')"


def sql_clean(x: str) -> str:
    return sql_normalize(sql_no_nul(x))
