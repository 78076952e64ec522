"""Structured Streaming forms of ingestion, deduplication and metric analytics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dedup


def stream_parquet(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files under a path (or glob) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New text files, line by line."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def clean_stream(stream: DataFrame, event_time: str | None = None, lateness: str = "30 days", min_chars: int = 16, text_col: str = "text") -> DataFrame:
    """Cleaned records without repeats: state is one hash a text; with an event time, it is given up after `lateness`."""
    out = stream.withColumn(text_col, T.clean_text(F.col(text_col), normalize_unicode=False)).where(F.length(text_col) >= min_chars)
    out = out.withColumn("text_key", dedup.text_key(F.col(text_col)))
    if event_time:
        return out.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["text_key"])
    return out.dropDuplicates(["text_key"])


def windowed_counts(stream: DataFrame, event_time: str, by: str, width: str = "1 day", slide: str | None = None, lateness: str = "30 days") -> DataFrame:
    """Rows by tumbling or sliding window of event time and key; later rows than `lateness` are dropped."""
    w = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return stream.withWatermark(event_time, lateness).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def session_counts(stream: DataFrame, event_time: str, by: str, gap: str = "30 minutes", lateness: str = "30 days") -> DataFrame:
    """Rows by session of a key: runs of rows with less than `gap` between them."""
    w = F.session_window(event_time, gap)
    return stream.withWatermark(event_time, lateness).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; `sink` gets each batch. A restart with the same checkpoint goes on from there."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def append_unseen(corpus: str, text_col: str = "text") -> Callable[[DataFrame, int], None]:
    """A sink that appends rows whose text the Parquet corpus lacks. Replaying a batch adds nothing."""

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["text_key"]) if "text_key" in batch.columns else batch
        try:
            rows = dedup.without_seen(rows, spark.read.parquet(corpus), text_col)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        rows.write.mode("append").parquet(corpus)

    return sink
