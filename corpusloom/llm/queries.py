"""The queries of this subpackage's operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import spread

from . import binpack, budget, encode, looks, mixing, mojibake, near_dup, overlap, pairs


def _read(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table, over all cores where its files are few."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df.select(*columns)) if columns else df


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = near_dup.near_duplicate_pairs(_read(spark, d, "records", "record_id", "text"), "record_id", "text", threshold=0.6, shingle=3, least_words=30)
    return found.select(F.col("id_a").alias("record_id_a"), F.col("id_b").alias("record_id_b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = looks.same_look_pairs(_read(spark, d, "records", "record_id", "text"), "record_id", "text", least_chars=16)
    return found.select(F.col("id_a").alias("record_id_a"), F.col("id_b").alias("record_id_b"))


def _p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.split_overlaps(_read(spark, d, "records", "record_id", "text", "split_name"), threshold=0.6, shingle=3, least_words=30, least_chars=16)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = _p6_pairs(spark, d)
    return found.select(F.least("train_id", "eval_id").alias("record_id_a"), F.greatest("train_id", "eval_id").alias("record_id_b")).distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "records", "record_id", "text", "split_name")
    found = overlap.overlap_classes(rows, threshold=0.6, shingle=3, least_words=30, least_chars=16)
    return overlap.class_report(*found, _read(spark, d, "records", "record_id", "split_name", "source"))


def p2_draws(spark: SparkSession, d: str) -> DataFrame:
    drawn, _ = mixing.draw(_read(spark, d, "records"), _read(spark, d, "mix_weights"))
    return drawn.select("mix_id", "source", "record_id", "repeats", "tokens")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*mixing.draw(_read(spark, d, "records"), _read(spark, d, "mix_weights")))


def p2_shards(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shard_plan(mixing.slots(_read(spark, d, "records"), _read(spark, d, "mix_weights"))[0])


def p2_slots(spark: SparkSession, d: str) -> DataFrame:
    return mixing.slots(_read(spark, d, "records"), _read(spark, d, "mix_weights"))[0]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_defects(_read(spark, d, "instruct_pairs"))


def p4_token_totals(spark: SparkSession, d: str) -> DataFrame:
    return budget.token_totals(_read(spark, d, "documents"))


def p4_byte_totals(spark: SparkSession, d: str) -> DataFrame:
    return budget.token_totals(_read(spark, d, "documents"), tokenizer="byte")


def p4_document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return encode.count_tokens(_read(spark, d, "documents", "doc_id", "text"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_table(_read(spark, d, "documents", "doc_id", "text"))


def p8_sequences(spark: SparkSession, d: str) -> DataFrame:
    return binpack.pack_texts(_read(spark, d, "documents", "doc_id", "text"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: sequences, tokens in them, and the share of their room that is filled."""
    one = p8_sequences(spark, d).where("sequence is not null").groupBy("sequence").agg(F.max("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    sums = one.groupBy("capacity").agg(F.count("*").alias("sequences"), F.sum("tokens").alias("tokens"))
    return sums.withColumn("filled", F.col("tokens") / (F.col("sequences") * F.col("capacity")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(_read(spark, d, "documents", "doc_id", "text", "lang")).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(_read(spark, d, "documents", "doc_id", "text", "lang"))


QUERIES = {
    "p1_found": p1_found,
    "p2_draws": p2_draws,
    "p2_shares": p2_shares,
    "p2_shards": p2_shards,
    "p2_slots": p2_slots,
    "p3_found": p3_found,
    "p4_token_totals": p4_token_totals,
    "p4_byte_totals": p4_byte_totals,
    "p4_document_tokens": p4_document_tokens,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_ids": p7_ids,
    "p8_sequences": p8_sequences,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

_LANG = """case regexp_extract(lower(trim(lang)), '^([a-z]+)', 1)
    when '' then null """ + " ".join(f"when '{a}' then '{b}'" for a, b in budget.LANGUAGE_CODES.items()) + """
    else regexp_extract(lower(trim(lang)), '^([a-z]+)', 1) end"""

SQL: dict[str, str] = {
    "p4_byte_totals": f"""
        select source, {_LANG} as lang, domain, count(*) as documents, cast(coalesce(sum(length(text)), 0) as bigint) as characters,
               cast(coalesce(sum(strlen(text)), 0) as bigint) as tokens
        from documents group by 1, 2, 3""",
}
