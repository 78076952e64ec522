"""Tokens, reports, word and pair statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import bpe, stats, tokens

from .common import read


def _docs(spark, d):
    return read(spark, d, "documents")


def _digest(ids):
    return F.md5(F.array_join(ids, ","))


def byte_tokenize(spark, d):
    ids = tokens.byte_encode(F.col("text"), bos=True, eos=True)
    return _docs(spark, d).where("text is not null").select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").alias("n"), _digest(F.col("ids")).alias("digest"))


def byte_round_trip(spark, d):
    back = tokens.byte_decode(tokens.byte_encode(F.col("text"), bos=True, eos=True))
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(back).alias("digest"), F.length(back).alias("chars"))


def tokenizer_report(spark, d):
    out = stats.tokenizer_report(_docs(spark, d))
    return out.select("documents", "characters", "bytes_utf8", "tokens", F.round("chars_per_token", 6).alias("chars_per_token"), F.round("bytes_per_token", 6).alias("bytes_per_token"), "unique_tokens", F.round("unk_rate", 6).alias("unk_rate"))


def tokenizer_report_by_source(spark, d):
    rows = _docs(spark, d).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.length("text")).cast("long").alias("characters"), F.sum(tokens.byte_count(F.col("text"))).cast("long").alias("tokens"))
    return rows.withColumn("chars_per_token", F.round(F.col("characters") / F.greatest("tokens", F.lit(1)), 6))


def top_tokens(spark, d):
    return stats.top_tokens(stats.byte_histogram(_docs(spark, d)))


def report_against_runs(spark, d):
    reports, runs = read(spark, d, "tokenizer_reports"), read(spark, d, "prep_runs")
    both = reports.join(runs.select("run_id", F.col("tokenizer_type").alias("run_type"), "train_tokens"), "run_id", "left")
    return both.groupBy("tokenizer_type").agg(F.count("*").alias("reports"), F.sum("tokens").cast("long").alias("tokens"), F.sum(F.col("run_type").eqNullSafe(F.col("tokenizer_type")).cast("long")).alias("same_type"))


def word_freq(spark, d):
    return bpe.word_frequencies(_docs(spark, d))


def line_freq(spark, d):
    return bpe.word_frequencies(_docs(spark, d), split=False).select(F.md5("word").alias("digest"), "n")


def _words(spark, d):
    words = bpe.word_frequencies(_docs(spark, d))
    return words.select(tokens.byte_encode(F.col("word")).alias("ids"), "n")


def pair_counts(spark, d):
    return bpe.pair_counts(_words(spark, d))


def best_pair(spark, d):
    return bpe.best_pair(bpe.pair_counts(_words(spark, d)))


def bpe_merges(spark, d):
    model = bpe.train_bpe(_docs(spark, d), vocab_size=tokens.BPE_OFFSET + 256 + 200)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(model.merges)], "rank int, l int, r int")


def bpe_encode_stats(spark, d):
    model = bpe.train_bpe(_docs(spark, d), vocab_size=tokens.BPE_OFFSET + 256 + 200)
    docs = _docs(spark, d).where("text is not null")
    ids = tokens.bpe_encode(F.col("text"), model)
    rows = docs.select("doc_id", "text", ids.alias("ids"))
    return rows.agg(F.count("*").alias("docs"), F.sum(F.size("ids")).alias("tokens"), F.sum((tokens.bpe_decode(F.col("ids"), model) == F.col("text")).cast("long")).alias("equal"))


def ngram_ban(spark, d):
    rows = _docs(spark, d).where("text is not null").select("doc_id", tokens.byte_encode(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.array_join(stats.banned_next(F.col("ids"), 3), ",").alias("banned"))


def repetition_score(spark, d):
    rows = _docs(spark, d).where("text is not null").select("doc_id", tokens.byte_encode(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.round(stats.repetition_score(F.col("ids")), 9).alias("score"))


def distinct_ratio(spark, d):
    rows = _docs(spark, d).where("text is not null").select("doc_id", tokens.byte_encode(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.round(stats.distinct_ratio(F.col("ids")), 9).alias("ratio"))


TAILS = {"one": "a" * 20, "two": "ab" * 4, "three": "abc" * 4, "four": "abcd" * 4, "few": "abcdefghi" * 8, "once": "abcd" * 3}


def repetitive_tail(spark, d):
    """Every text as it is and with three tails that repeat themselves, long and short ones, so that each rule fires and fails."""
    tails = F.array(F.struct(F.lit("none").alias("tail"), F.col("text").alias("t")), *[F.struct(F.lit(name).alias("tail"), F.concat("text", F.lit(tail)).alias("t")) for name, tail in TAILS.items()])
    rows = _docs(spark, d).where("text is not null").select("doc_id", F.inline(tails)).select("doc_id", "tail", tokens.byte_encode(F.col("t")).alias("ids"))
    return rows.where(stats.repetitive_tail(F.col("ids"))).select("doc_id", "tail")


QUERIES = {
    "byte_tokenize": byte_tokenize, "byte_round_trip": byte_round_trip, "tokenizer_report": tokenizer_report, "tokenizer_report_by_source": tokenizer_report_by_source, "top_tokens": top_tokens,
    "report_against_runs": report_against_runs, "word_freq": word_freq, "line_freq": line_freq, "pair_counts": pair_counts, "best_pair": best_pair, "bpe_merges": bpe_merges, "bpe_encode_stats": bpe_encode_stats,
    "ngram_ban": ngram_ban, "repetition_score": repetition_score, "distinct_ratio": distinct_ratio, "repetitive_tail": repetitive_tail,
}

#: Byte ids of a text in SQL: the bytes in hexadecimal, cut in pairs.
SQL_IDS = "list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: ('0x' || h)::int + 4)"
_IDS = f"select doc_id, {SQL_IDS.format(x='text')} as ids from documents where text is not null"
_WORDS = "select w as word, count(*) as n from (select unnest(regexp_split_to_array(text, '[\\t\\n\\f\\r ]+')) as w from documents) where w <> '' group by 1"
_PAIRS = f"""select ids[i] as l, ids[i + 1] as r, cast(sum(n) as bigint) as n from (select ids, n, unnest(range(1, len(ids))) as i from (select {SQL_IDS.format(x='word')} as ids, n from ({_WORDS}))) group by 1, 2"""

SQL = {
    "byte_tokenize": f"select doc_id, len(ids) as n, md5(array_to_string(ids, ',')) as digest from (select doc_id, list_concat(list_concat([1], ids), [2]) as ids from ({_IDS}))",
    "byte_round_trip": "select doc_id, md5(text) as digest, length(text) as chars from documents where text is not null",
    "tokenizer_report": f"""with t as (select unnest(ids) as token from ({_IDS})) select count(*) as documents, cast(sum(length(text)) as bigint) as characters, cast(sum(strlen(text)) as bigint) as bytes_utf8,
        (select count(*) from t) as tokens, round(sum(length(text)) / (select count(*) from t), 6) as chars_per_token, round(sum(strlen(text)) / (select count(*) from t), 6) as bytes_per_token,
        (select count(distinct token) from t) as unique_tokens, cast(0 as double) as unk_rate from documents where text is not null""",
    "tokenizer_report_by_source": """select source, count(*) as documents, cast(sum(length(text)) as bigint) as characters, cast(sum(strlen(text)) as bigint) as tokens,
        round(sum(length(text)) / greatest(sum(strlen(text)), 1), 6) as chars_per_token from documents group by 1""",
    "top_tokens": f"select token, count(*) as n from (select unnest(ids) as token from ({_IDS})) group by 1 order by n desc, token limit 50",
    "report_against_runs": """select r.tokenizer_type, count(*) as reports, cast(sum(r.tokens) as bigint) as tokens, cast(sum(case when p.tokenizer_type is not distinct from r.tokenizer_type then 1 else 0 end) as bigint) as same_type
        from tokenizer_reports r left join prep_runs p using (run_id) group by 1""",
    "word_freq": _WORDS,
    "line_freq": "select md5(text) as digest, count(*) as n from documents where text <> '' group by text",
    "pair_counts": _PAIRS,
    "best_pair": f"select * from ({_PAIRS}) order by n desc, l, r limit 1",
    "ngram_ban": f"""with s as ({_IDS}), h as (select doc_id, ids, len(ids) as m, unnest(range(1, len(ids) - 1)) as i from s),
        b as (select doc_id, list_sort(list_distinct(list(ids[i + 2]))) as banned from h where ids[i] = ids[m - 1] and ids[i + 1] = ids[m] group by 1)
        select doc_id, coalesce(array_to_string(banned, ','), '') as banned from s left join b using (doc_id)""",
    "repetition_score": f"""with g as (select doc_id, ids, unnest(range(1, len(ids) - 1)) as i from ({_IDS})), n as (select doc_id, 1.0::double - count(distinct (ids[i], ids[i + 1], ids[i + 2])) / count(*)::double as score from g group by 1)
        select doc_id, round(coalesce(score, 0.0), 9) as score from ({_IDS}) left join n using (doc_id)""",
    "distinct_ratio": f"select doc_id, case when len(ids) > 0 then round(len(list_distinct(ids)) / len(ids), 9) else 0.0 end as ratio from ({_IDS})",
    "repetitive_tail": f"""with e as (select doc_id, k as kind, {SQL_IDS.format(x="text || v")} as ids from documents, (values ('none', ''), {", ".join(f"('{k}', '{v}')" for k, v in TAILS.items())}) x(k, v) where text is not null),
        t as (select doc_id, kind, len(ids) as n, ids[-64:] as tail from e), k as (select *, len(tail) as t, len(list_distinct(tail)) as kinds from t)
        select doc_id, kind as tail from k where n >= 32 and ((kinds <= 2 and t >= 16) or (t >= 8 and tail[-8:-3] = tail[-6:]) or (t >= 12 and tail[-12:-4] = tail[-9:]) or (t >= 16 and tail[-16:-5] = tail[-12:]) or (1.0 - kinds / t >= 0.85 and t >= 64))""",
}
