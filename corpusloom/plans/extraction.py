"""Text extraction, modes, formats and inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import extract, stats
from corpusloom.sources import detect

from .common import read


def _pairs(spark, d):
    return read(spark, d, "instruct_pairs").dropDuplicates(["pair_id"])


def detect_format(spark, d):
    return read(spark, d, "records").select("source", detect.format_of(F.col("source")).alias("format")).groupBy("source", "format").agg(F.count("*").alias("n"))


def parquet_text_scan(spark, d):
    docs = read(spark, d, "documents")
    chosen = extract.select_text_columns(docs.columns)
    return docs.select(*chosen).agg(F.count("*").alias("records"), F.sum(F.length(chosen[0])).alias("characters"))


def select_columns_prune(spark, d):
    pairs = read(spark, d, "instruct_pairs")
    chosen = extract.select_text_columns(pairs.columns)
    return pairs.select(*chosen).agg(*[F.count(c).alias(c) for c in chosen])


def extract_best_key(spark, d):
    part = read(spark, d, "part")
    return part.select("p_partkey", extract.best_text_key(part).alias("best"), F.md5(extract.extract_text(part)).alias("digest"))


def extract_text(spark, d):
    pairs = _pairs(spark, d).select("pair_id", "instruction", "input", "output", "response")
    return pairs.select("pair_id", F.md5(extract.extract_text(pairs)).alias("digest"))


def instruct_template(spark, d):
    pairs = _pairs(spark, d)
    text = extract.instruct_text(F.coalesce("instruction", F.lit("")), F.coalesce("input", F.lit("")), F.coalesce("output", F.lit("")))
    return pairs.where("prompt is null").select("pair_id", F.length(text).alias("chars"), F.md5(text).alias("digest"))


def prompt_completion_join(spark, d):
    pairs = _pairs(spark, d).where("prompt is not null").select("pair_id", "prompt", "response")
    return pairs.select("pair_id", F.md5(extract.extract_text(pairs)).alias("digest"))


def row_mode(spark, d):
    names = ["documents", "records", "instruct_pairs", "conversations", "part", "customer"]
    return spark.createDataFrame([(n, extract.row_mode(read(spark, d, n).columns)) for n in names], "name string, mode string")


def chat_render(spark, d):
    out = extract.render_turns(read(spark, d, "conversations"))
    return out.select("conv_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def chat_export_endoftext(spark, d):
    out = extract.chat_export(read(spark, d, "conversations"))
    return out.select("conv_id", F.md5("text").alias("digest"))


def infer_mode(spark, d):
    mode = extract.record_mode(F.lit("auto"), F.col("rec_mode"), F.col("text"), F.col("suffix"))
    return read(spark, d, "records").dropDuplicates(["record_id"]).select(F.coalesce(mode, F.lit("generative")).alias("mode")).groupBy("mode").agg(F.count("*").alias("n"))


def mask_policy(spark, d):
    mode = extract.record_mode(F.lit("auto"), F.col("rec_mode"), F.col("text"), F.col("suffix"))
    return read(spark, d, "records").select(extract.loss_masking(F.lit("auto"), mode).alias("policy")).groupBy("policy").agg(F.count("*").alias("n"))


def dataset_inspect(spark, d):
    return stats.dataset_summary(read(spark, d, "records"))


def field_counts(spark, d):
    records = read(spark, d, "records")
    return stats.field_counts(records, records.columns)


def format_counts(spark, d):
    return stats.group_counts(read(spark, d, "records"), "fmt")


def validate(spark, d):
    return stats.validate(read(spark, d, "records"))


def training_scan(spark, d):
    return stats.training_scan(read(spark, d, "documents"), 16)


def multi_source_union(spark, d):
    a = read(spark, d, "documents").select("text", "source")
    b = read(spark, d, "records").select("text", "source")
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


QUERIES = {
    "detect_format": detect_format, "parquet_text_scan": parquet_text_scan, "select_columns_prune": select_columns_prune, "extract_best_key": extract_best_key, "extract_text": extract_text,
    "instruct_template": instruct_template, "prompt_completion_join": prompt_completion_join, "row_mode": row_mode, "chat_render": chat_render, "chat_export_endoftext": chat_export_endoftext,
    "infer_mode": infer_mode, "mask_policy": mask_policy, "dataset_inspect": dataset_inspect, "field_counts": field_counts, "format_counts": format_counts, "validate": validate,
    "training_scan": training_scan, "multi_source_union": multi_source_union,
}

_ONE_PAIR = "(select pair_id, any_value(prompt) as prompt, any_value(response) as response, any_value(instruction) as instruction, any_value(input) as input, any_value(output) as output from instruct_pairs group by 1)"
_INSTRUCT = """case when length(coalesce({answer}, '')) > 0 then '<|user|>' || chr(10) || p || chr(10) || '<|assistant|>' || chr(10) || {answer} else p end"""
_PROMPT = "concat_ws(chr(10), case when length(instruction) > 0 then instruction end, case when length(input) > 0 then input end)"
_ROLE = """case when lower(trim(role)) = 'human' then 'user' when lower(trim(role)) in ('gpt', 'bot') then 'assistant' when role is null or trim(role) = '' then 'user' else lower(trim(role)) end"""
_TURNS = f"(select conv_id, turn, min({{'r': {_ROLE}, 't': coalesce(text, '')}}) as m from conversations group by 1, 2)"
_MODE = """case when rec_mode is not null and replace(lower(trim(rec_mode)), '-', '_') not in ('', 'auto') then replace(lower(trim(rec_mode)), '-', '_')
    when contains(text, '<|user|>') and contains(text, '<|assistant|>') then 'chat'
    when lower(suffix) in (""" + ", ".join(f"'{s}'" for s in extract.MODE_CODE_SUFFIXES) + """) then 'code' else 'generative' end"""

SQL = {
    "detect_format": f"select source, {detect.sql_format('source')} as format, count(*) as n from records group by 1, 2",
    "parquet_text_scan": "select count(*) as records, cast(sum(length(text)) as bigint) as characters from documents",
    "select_columns_prune": "select count(prompt) as prompt, count(response) as response, count(instruction) as instruction, count(input) as input from instruct_pairs",
    "extract_best_key": """select p_partkey, case when t >= n and t >= b then 'p_type' when n >= b then 'p_name' else 'p_brand' end as best,
            md5(case when t >= n and t >= b then p_type when n >= b then p_name else p_brand end) as digest
        from (select *, least(length(p_name), 4096) as n, least(length(p_brand), 4096) as b, least(length(p_type), 4096) as t from part)""",
    "extract_text": f"select pair_id, md5({_INSTRUCT.format(answer='output')}) as digest from (select *, {_PROMPT} as p from {_ONE_PAIR})",
    "instruct_template": f"select pair_id, length(s) as chars, md5(s) as digest from (select pair_id, {_INSTRUCT.format(answer='output')} as s from (select *, {_PROMPT} as p from {_ONE_PAIR}) where prompt is null)",
    "prompt_completion_join": f"select pair_id, md5(concat_ws(chr(10), case when length(prompt) > 0 then prompt end, case when length(response) > 0 then response end)) as digest from {_ONE_PAIR} where prompt is not null",
    "row_mode": """select name, case when list_has_any(c, ['messages', 'conversations']) then 'chat' when list_contains(c, 'instruction') and list_has_any(c, ['output', 'response', 'answer']) then 'instruct'
            when list_contains(c, 'prompt') and list_has_any(c, ['completion', 'response', 'answer']) then 'completion' when list_contains(c, 'code') then 'code' else 'generative' end as mode
        from (select table_name as name, list(lower(column_name)) as c from information_schema.columns group by 1) where name in ('documents', 'records', 'instruct_pairs', 'conversations', 'part', 'customer')""",
    "chat_render": f"select conv_id, length(s) as chars, md5(s) as digest from (select conv_id, string_agg('<|' || m.r || '|>' || chr(10) || m.t, chr(10) order by turn) as s from {_TURNS} group by 1)",
    "chat_export_endoftext": f"""select conv_id, md5(string_agg('<|' || m.r || '|>' || chr(10) || m.t, chr(10) order by turn) || chr(10) || '<|endoftext|>' || chr(10) || chr(10)) as digest
        from (select conv_id, turn, min({{'r': case when {_ROLE} in ('system', 'user', 'assistant', 'tool') then {_ROLE} else 'user' end, 't': trim(text)}}) as m
            from conversations where length(trim(coalesce(text, ''))) > 0 group by 1, 2) group by 1""",
    "infer_mode": f"select {_MODE} as mode, count(*) as n from (select record_id, any_value(rec_mode) as rec_mode, any_value(text) as text, any_value(suffix) as suffix from records group by 1) group by 1",
    "mask_policy": f"select case when m in ('chat', 'instruct', 'reasoning', 'roleplay') then 'assistant_only' when m = 'completion' then 'completion_only' else 'none' end as policy, count(*) as n from (select {_MODE} as m from records) group by 1",
    "dataset_inspect": "select count(*) as records, count(case when length(text) > 0 then 1 end) as filled, cast(sum(length(text)) as bigint) as characters, cast(sum(strlen(text)) as bigint) as bytes_utf8 from records",
    "field_counts": " union all ".join(f"select '{c}' as field, count({c}) as n from records" for c in ("record_id", "text", "source", "fmt", "suffix", "line_no", "rec_mode", "split_name", "lang", "tokens", "created_at", "ingested_at")),
    "format_counts": "select fmt, count(*) as n from records group by 1",
    "validate": "select count(text) as records, cast(0 as bigint) as errors, count(text) > 0 as valid from records",
    "training_scan": """select count(case when length(text) >= 16 then 1 end) as records, cast(coalesce(sum(case when length(text) >= 16 then length(text) end), 0) as bigint) as characters,
        count(case when text is null or length(text) < 16 then 1 end) as skipped, count(case when contains(text, chr(65533)) then 1 end) as invalid from documents""",
    "multi_source_union": "select source, count(*) as n, count(distinct text) as texts from (select text, source from documents union all select text, source from records) group by 1",
}
