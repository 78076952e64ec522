"""Cleaning, filtering and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import clean, dedup
from corpusloom.session import spread

from .common import read, sql_clean, sql_lines, sql_no_nul, sql_normalize, sql_rstrip, sql_strip

PLAIN = clean.CleaningConfig(normalize_unicode=False)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def _spread(spark: SparkSession, d: str) -> DataFrame:
    return spread(_docs(spark, d))


def _digest(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select("doc_id", F.length(text).alias("chars"), F.md5(text).alias("digest"))


def normalize_text(spark, d):
    return _digest(_docs(spark, d).withColumn("text", T.normalize_text(F.col("text"))))


def clean_text(spark, d):
    return _digest(_docs(spark, d).withColumn("text", T.clean_text(F.col("text"), normalize_unicode=False)))


def collapse_whitespace(spark, d):
    return _digest(_spread(spark, d).withColumn("text", T.clean_text(F.col("text"), normalize_unicode=False, collapse_whitespace=True)))


def sanitize_text(spark, d):
    return _digest(_docs(spark, d).withColumn("text", T.sanitize_text(F.col("text"))))


def length_filter(spark, d):
    return clean.length_filter(_docs(spark, d).withColumn("text", T.clean_text(F.col("text"), False)), 16).select("doc_id", F.length("text").alias("chars"))


def truncate_text(spark, d):
    return _digest(_docs(spark, d).withColumn("text", T.truncate(T.clean_text(F.col("text"), False), 200)))


def language_label(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.language_label(F.col("text")).alias("label"))


def language_filter(spark, d):
    return clean.language_filter(_docs(spark, d).where("text is not null"), "en").groupBy("source").agg(F.count("*").alias("docs"))


def exact_dedup(spark, d):
    return dedup.exact_dedup(_docs(spark, d), order="doc_id").select("doc_id", "lang", "source")


def exact_repeats(spark, d):
    return dedup.repeats(_docs(spark, d), order="doc_id")


def anti_dedup_vs_corpus(spark, d):
    return dedup.without_seen(_docs(spark, d).where("text is not null"), read(spark, d, "records")).select("doc_id", "source")


def clean_pipeline(spark, d):
    out = clean.clean_records(_spread(spark, d), PLAIN, order="doc_id")
    return out.select("doc_id", "source", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def clean_pipeline_full(spark, d):
    config = clean.CleaningConfig(max_chars=4000, collapse_whitespace=True, lang_filter="en", normalize_unicode=False)
    return _digest(clean.clean_records(_spread(spark, d), config, order="doc_id"))


def clean_report(spark, d):
    out = clean.clean_records(_spread(spark, d), PLAIN, order="doc_id").withColumn("label", T.language_label(F.col("text")))
    return out.groupBy("label").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


def simhash_md5(spark, d):
    return _spread(spark, d).where("text is not null").select("doc_id", dedup.simhash(F.col("text"), "md5").alias("simhash"))


def near_dup_pairs(spark, d):
    return dedup.near_pairs(_spread(spark, d), "doc_id", algorithm="md5")


def near_dup_filter(spark, d):
    docs = clean.clean_records(_spread(spark, d), PLAIN, order="doc_id")
    return dedup.near_dedup(docs, order="doc_id").select("doc_id")


def code_only(spark, d):
    return read(spark, d, "records").where(clean.is_code(F.col("source"))).groupBy("source").agg(F.count("*").alias("n"))


QUERIES = {
    "normalize_text": normalize_text, "clean_text": clean_text, "collapse_whitespace": collapse_whitespace, "sanitize_text": sanitize_text, "length_filter": length_filter,
    "truncate_text": truncate_text, "language_label": language_label, "language_filter": language_filter, "exact_dedup": exact_dedup, "exact_repeats": exact_repeats,
    "anti_dedup_vs_corpus": anti_dedup_vs_corpus, "clean_pipeline": clean_pipeline, "clean_pipeline_full": clean_pipeline_full, "clean_report": clean_report,
    "simhash_md5": simhash_md5, "near_dup_pairs": near_dup_pairs, "near_dup_filter": near_dup_filter, "code_only": code_only,
}

_LABEL = "case when length(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g')) / greatest(length({x}), 1) > 0.85 then 'en' else 'unknown' end"
_COLLAPSED = f"({sql_strip('''regexp_replace(regexp_replace(''' + sql_lines(sql_no_nul('text')) + ''', '[ \\t]+', ' ', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g')''')} || chr(10))"


def _short(n: int) -> str:
    return f"case when length(t) > {n} then {sql_rstrip(f'substring(t, 1, {n})')} || chr(10) else t end"


_CLEAN = f"select *, {sql_clean('text')} as t from documents"
_PIPELINE = f"""with c as (select * from ({_CLEAN}) where length(t) >= 16),
    kept as (select * from (select *, row_number() over (partition by md5(t) order by doc_id) as rn from c) where rn = 1)"""
_CODE = ", ".join(f"'{s}'" for s in clean.CODE_SUFFIXES)
_SIMHASH = """with words as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as w from documents where text is not null),
    counts as (select doc_id, w, count(*) as n from words group by 1, 2),
    hashes as (select distinct w, ('0x' || substr(md5(w), 17, 16))::ubigint as h from counts),
    bits as (select doc_id, b, sum(case when (h >> b) & 1 = 1 then n else -n end) as weight from counts join hashes using (w), (select unnest(range(64))::ubigint as b) group by 1, 2),
    fp as (select doc_id, sum(case when weight > 0 then (1::hugeint << b::int) else 0 end)::hugeint as h from bits group by 1),
    prints as (select d.doc_id, case when coalesce(h, 0) >= 9223372036854775808 then (h - 18446744073709551616)::bigint else coalesce(h, 0)::bigint end as simhash
        from documents d left join fp using (doc_id) where d.text is not null)"""

SQL = {
    "normalize_text": f"select doc_id, length(t) as chars, md5(t) as digest from (select doc_id, {sql_normalize('text')} as t from documents)",
    "clean_text": f"select doc_id, length(t) as chars, md5(t) as digest from ({_CLEAN})",
    "collapse_whitespace": f"select doc_id, length(t) as chars, md5(t) as digest from (select doc_id, {_COLLAPSED} as t from documents)",
    "length_filter": f"select doc_id, length(t) as chars from ({_CLEAN}) where length(t) >= 16",
    "truncate_text": f"select doc_id, length(s) as chars, md5(s) as digest from (select doc_id, {_short(200)} as s from ({_CLEAN}))",
    "language_label": f"select doc_id, {_LABEL.format(x='text')} as label from documents where text is not null",
    "language_filter": f"select source, count(*) as docs from documents where text is not null and {_LABEL.format(x='text')} = 'en' group by 1",
    "exact_dedup": "select doc_id, lang, source from (select *, row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1",
    "exact_repeats": "select doc_id from (select *, row_number() over (partition by text order by doc_id) as rn from documents) where rn > 1",
    "anti_dedup_vs_corpus": "select doc_id, source from documents where text is not null and text not in (select text from records where text is not null)",
    "clean_pipeline": f"{_PIPELINE} select doc_id, source, length(t) as chars, md5(t) as digest from kept",
    "clean_pipeline_full": f"""with c as (select doc_id, {_COLLAPSED} as t from documents), s as (select doc_id, {_short(4000)} as t from c where length(t) >= 16),
        l as (select * from s where {_LABEL.format(x='t')} = 'en')
        select doc_id, length(t) as chars, md5(t) as digest from (select *, row_number() over (partition by md5(t) order by doc_id) as rn from l) where rn = 1""",
    "clean_report": f"{_PIPELINE} select {_LABEL.format(x='t')} as label, count(*) as docs, cast(sum(length(t)) as bigint) as chars, cast(sum(strlen(t)) as bigint) as bytes from kept group by 1",
    "simhash_md5": f"{_SIMHASH} select doc_id, simhash from prints",
    "near_dup_pairs": f"{_SIMHASH} select a.doc_id as id_a, b.doc_id as id_b from prints a join prints b on a.doc_id < b.doc_id and bit_count(xor(a.simhash, b.simhash)) <= 3",
    "code_only": f"select source, count(*) as n from records where lower(regexp_extract(regexp_extract(source, '([^/]*)$', 1), '[^.](\\.[^.]+)$', 1)) in ({_CODE}) group by 1",
}
