"""Readers and writers: tables are written in each format and read back; SQL on the table says what has to come out.

Formats that Spark splits hold the `part` table; those that are parsed as a whole hold `nation`, a table of fixed size.
"""

from __future__ import annotations

import gzip
import io
import json
import sqlite3
import tarfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import metrics_log, stats
from corpusloom.session import shared_dir
from corpusloom.sources import readers, sinks, storage

from .common import read


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _parts(spark, d) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_name").alias("text"), F.col("p_partkey").cast("string").alias("key"))


def _texts(spark: SparkSession, path: str, **options) -> DataFrame:
    records, _ = readers.read_records(spark, [path], **options)
    return records.groupBy("format", F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.countDistinct("ord").alias("places"))


def source_jsonl(spark, d):
    at = _place(spark)
    _parts(spark, d).select(F.to_json(F.struct("text", "key")).alias("value")).write.option("compression", "none").text(at)
    return _texts(spark, _renamed(at, ".jsonl"))


def source_csv(spark, d):
    at = _place(spark)
    _parts(spark, d).write.option("header", "true").csv(at)
    return _texts(spark, _renamed(at, ".csv"))


def source_parquet(spark, d):
    at = _place(spark) + ".parquet"
    _parts(spark, d).write.parquet(at)
    return _texts(spark, at)


def _renamed(folder: str, suffix: str) -> str:
    """A copy of the folder's data files under names with `suffix`, as the reader goes by names."""
    for k, f in enumerate(f for f in storage.files_under(folder) if "/part-" in f and not f.endswith(".crc")):
        storage.make_dir(folder + "-named")
        storage.write_bytes(f"{folder}-named/{k:05d}{suffix}", storage.read_bytes(f))
    return folder + "-named"


def _nations(spark, d) -> list[dict]:
    return [{"text": r[1], "key": str(r[0])} for r in read(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]  # 25 rows at every size


def _written(spark: SparkSession, name: str, data: bytes) -> str:
    folder = _place(spark)
    storage.make_dir(folder)
    storage.write_bytes(f"{folder}/{name}", data)
    return f"{folder}/{name}"


def source_json(spark, d):
    return _texts(spark, _written(spark, "a.json", json.dumps({"data": _nations(spark, d)}).encode()))


def source_xml(spark, d):
    body = "".join(f"<row>{r['text']}</row>" for r in _nations(spark, d))
    records, _ = readers.read_records(spark, [_written(spark, "a.xml", f"<all>{body}</all>".encode())])
    return records.where("tag = 'row'").groupBy("format", F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.countDistinct("ord").alias("places"))


def source_sqlite(spark, d):
    db = sqlite3.connect(":memory:")
    db.execute("create table t (text varchar, key varchar)")
    db.executemany("insert into t values (:text, :key)", _nations(spark, d))
    db.commit()
    return _texts(spark, _written(spark, "a.sqlite", db.serialize()))


def source_arrow(spark, d):
    sink, table = io.BytesIO(), pa.Table.from_pylist(_nations(spark, d))
    with pa.ipc.new_file(sink, table.schema) as w:
        w.write_table(table)
    return _texts(spark, _written(spark, "a.arrow", sink.getvalue()), text_columns=("text",))


def source_text_folder(spark, d):
    folder = _place(spark)
    for r in _nations(spark, d):
        storage.make_dir(f"{folder}/{r['key']}")
        storage.write_bytes(f"{folder}/{r['key']}/a.txt", r["text"].encode())
    return _texts(spark, folder)


def source_zip(spark, d):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for r in _nations(spark, d):
            z.writestr(f"{r['key']}.txt", r["text"])
    return _texts(spark, _written(spark, "a.zip", raw.getvalue()))


def source_tar(spark, d):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for r in _nations(spark, d):
            data = r["text"].encode()
            m = tarfile.TarInfo(f"{r['key']}.txt")
            m.size = len(data)
            t.addfile(m, io.BytesIO(data))
    return _texts(spark, _written(spark, "a.tar.gz", gzip.compress(raw.getvalue())))


def sink_jsonl(spark, d):
    at = _place(spark)
    sinks.write_jsonl(_parts(spark, d).withColumn("source", F.lit("part")), at)
    rows = spark.read.schema("text string, source string, metadata struct<key: string>").json(at)
    return rows.select("source", F.md5("text").alias("digest"), F.col("metadata.key").alias("key"))


def sink_txt(spark, d):
    at = _place(spark)
    sinks.write_txt(_parts(spark, d), at)
    return spark.read.text(at).groupBy(F.md5("value").alias("digest")).agg(F.count("*").alias("n"))


def sink_first_column(spark, d):
    at = _place(spark)
    sinks.write_first_column(read(spark, d, "part").select("p_partkey", "p_name"), at)
    return spark.read.text(at).select(F.col("value").cast("long").alias("key"))


def parse_log(spark, d):
    """The metric log as JSON lines with blank and broken lines between them, parsed again."""
    rows = read(spark, d, "metric_log").select("run_id", "step", "event", "loss", "grad_norm")
    line = F.to_json(F.struct(*rows.columns))
    lines = rows.select(F.explode(F.array(line, F.lit(""), F.concat(F.lit("{"), line))).alias("value"))
    got = metrics_log.parse_log(lines, "run_id long, step long, event string, loss double, grad_norm double")
    return got.groupBy("run_id", "event").agg(F.count("*").alias("n"), F.round(F.sum("loss"), 5).alias("loss"), F.max("step").alias("last"))


def map_key_counts(spark, d):
    rows = read(spark, d, "records").select(F.map_filter(F.create_map(F.lit("fmt"), F.col("fmt"), F.lit("lang"), F.col("lang"), F.lit("rec_mode"), F.col("rec_mode")), lambda k, v: v.isNotNull()).alias("m"))
    return stats.map_key_counts(rows, "m")


QUERIES = {
    "source_jsonl": source_jsonl, "source_csv": source_csv, "source_parquet": source_parquet, "source_json": source_json, "source_xml": source_xml, "source_sqlite": source_sqlite, "source_arrow": source_arrow,
    "source_text_folder": source_text_folder, "source_zip": source_zip, "source_tar": source_tar, "sink_jsonl": sink_jsonl, "sink_txt": sink_txt, "sink_first_column": sink_first_column,
    "parse_log": parse_log, "map_key_counts": map_key_counts,
}


def _sql(format_: str, table: str, text: str) -> str:
    return f"select '{format_}' as format, md5(trim({text}) || chr(10)) as digest, count(*) as n, count(*) as places from {table} group by 2"


SQL = {
    **{f"source_{f}": _sql(f, "part", "p_name") for f in ("jsonl", "csv", "parquet")},
    **{f"source_{f}": _sql(name, "nation", "n_name") for f, name in (("json", "json"), ("xml", "xml"), ("sqlite", "sqlite"), ("arrow", "arrow"), ("text_folder", "text"), ("zip", "archive-text"), ("tar", "archive-text"))},
    "sink_jsonl": "select 'part' as source, md5(p_name) as digest, cast(p_partkey as varchar) as key from part",
    "sink_txt": "select md5(p_name) as digest, count(*) as n from part group by 1",
    "sink_first_column": "select cast(p_partkey as bigint) as key from part",
    "parse_log": "select run_id, event, count(*) as n, round(sum(case when isfinite(loss) then loss end), 5) as loss, max(step) as last from metric_log group by 1, 2",
    "map_key_counts": "select * from (select 'fmt' as field, count(fmt) as n from records union all select 'lang', count(lang) from records union all select 'rec_mode', count(rec_mode) from records) where n > 0",
}
