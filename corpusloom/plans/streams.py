"""Streaming queries, run over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import streaming as S
from corpusloom.session import shared_dir

from .common import read, sql_clean


def _drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows of a finished stream, written to the shared folder batch by batch; a replayed batch replaces its rows."""
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    S.run_available(stream, sink, f"{base}/checkpoint", mode)
    out = spark.read.parquet(f"{base}/out")
    return out.drop("batch")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return S.stream_parquet(spark, f"{d}/records.parque[t]", read(spark, d, "records").schema)


def stream_clean_dedup(spark, d):
    out = _drain(spark, S.clean_stream(_records(spark, d).select("text", "source")))
    return out.select(F.md5("text").alias("digest"))


def stream_daily_counts(spark, d):
    rows = _records(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp"))
    out = _drain(spark, S.windowed_counts(rows, "created_at", "fmt", "1 day"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "fmt", "n")


def stream_sliding_counts(spark, d):
    rows = _records(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp"))
    out = _drain(spark, S.windowed_counts(rows, "created_at", "split_name", "2 days", "1 day"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "split_name", "n")


def stream_sessions(spark, d):
    """Sessions of `events` a user: runs of rows less than ten hours apart; a closing row beyond the watermark is not needed in complete form."""
    e = read(spark, d, "events")
    stream = S.stream_parquet(spark, f"{d}/events.parque[t]", e.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drain(spark, S.session_counts(stream, "ts", "user_id", "10 hours"), "complete")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


def stream_distinct_records(spark, d):
    rows = _records(spark, d).select("record_id", "source").dropDuplicates(["record_id"])
    return _drain(spark, rows).groupBy("source").agg(F.count("*").alias("n"))


QUERIES = {
    "stream_clean_dedup": stream_clean_dedup, "stream_daily_counts": stream_daily_counts, "stream_sliding_counts": stream_sliding_counts, "stream_distinct_records": stream_distinct_records, "stream_sessions": stream_sessions,
}

SQL = {
    "stream_clean_dedup": f"select distinct md5(t) as digest from (select {sql_clean('text')} as t from records) where length(t) >= 16",
    "stream_daily_counts": "select strftime(created_at, '%Y-%m-%d') as day, fmt, count(*) as n from records group by 1, 2",
    "stream_sliding_counts": "select strftime(t, '%Y-%m-%d') as day, split_name, count(*) as n from (select date_trunc('day', created_at) - to_days(k::int) as t, split_name from records, (select unnest([0, 1]) as k)) group by 1, 2",
    "stream_sessions": """select user_id, count(*) as sessions, cast(sum(n) as bigint) as events, max(n) as longest from (select user_id, s, count(*) as n from (select user_id, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from
        (select user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 36000000000 then 0 else 1 end as fresh from events)) group by 1, 2) group by 1""",
    "stream_distinct_records": "select source, count(distinct record_id) as n from records group by 1",
}
