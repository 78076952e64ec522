"""Loss masks, training sequences, splits and packing statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import extract, masking, packing
from corpusloom.operators.tokens import byte_encode

from .common import read
from .tokenization import SQL_IDS

SEQ_LEN = 256


def _chats(spark, d):
    return extract.render_turns(read(spark, d, "conversations"))


def _texts(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", "text")


def _show(df, key):
    join = lambda c: F.md5(F.array_join(c, ","))
    return df.select(key, F.size("e.ids").alias("n"), join("e.ids").alias("ids"), join("e.labels").alias("labels"))


LEADS = {
    "response": "ask\n### Response:\n", "completion": "ask\nCompletion:\n", "answer": "ask\nAnswer:\n", "both": "a\nAnswer:\nb\n### Response:\nc", "chat": "<|user|>\nask\n<|assistant|>\n",
}


def role_blocks(spark, d):
    spans = F.regexp_extract_all(F.col("text"), F.lit(r"(?s)<\|(system|user|assistant|tool)\|>\s*((?:(?!<\|(?:system|user|assistant|tool)\|>).)*)"), F.lit(1))
    bodies = F.regexp_extract_all(F.col("text"), F.lit(r"(?s)<\|(system|user|assistant|tool)\|>\s*((?:(?!<\|(?:system|user|assistant|tool)\|>).)*)"), F.lit(2))
    rows = _chats(spark, d).select("conv_id", F.posexplode(F.arrays_zip(spans.alias("role"), bodies.alias("body"))).alias("k", "b"))
    return rows.where(F.length("b.body") > 0).groupBy("conv_id", F.col("b.role").alias("role")).agg(F.count("*").alias("blocks"), F.sum(F.octet_length("b.body")).cast("long").alias("bytes"))


def assistant_mask(spark, d):
    return _show(_chats(spark, d).select("conv_id", masking.encoded(F.col("text"), F.lit("assistant_only")).alias("e")), "conv_id")


def completion_mask(spark, d):
    """Every text as it is and behind each marker of a completion and of an answer."""
    leads = F.array(F.struct(F.lit("none").alias("lead"), F.col("text").alias("t")), *[F.struct(F.lit(k).alias("lead"), F.concat(F.lit(v), "text").alias("t")) for k, v in LEADS.items()])
    texts = _texts(spark, d).select("doc_id", F.inline(leads)).select(F.concat_ws(":", "lead", "doc_id").alias("doc_id"), F.col("t").alias("text"))
    return _show(texts.select("doc_id", masking.encoded(F.col("text"), F.lit("completion_only")).alias("e")), "doc_id")


def partial_mask(spark, d):
    return _show(_texts(spark, d).select("doc_id", masking.encoded(F.col("text"), F.lit("partial")).alias("e")), "doc_id")


def plain_labels(spark, d):
    return _show(_texts(spark, d).select("doc_id", masking.encoded(F.col("text"), F.lit("none")).alias("e")), "doc_id")


def _plain_sequences(spark, d):
    rows = _texts(spark, d).withColumn("mode", F.lit("generative")).withColumn("policy", F.lit("none"))
    return masking.sequences(rows, SEQ_LEN)


def fixed_sequences(spark, d):
    join = lambda c: F.md5(F.array_join(c, ","))
    return _plain_sequences(spark, d).select("doc_id", "seq_no", join("input_ids").alias("input_ids"), join("labels").alias("labels"))


def _chat_sequences(spark, d):
    rows = _chats(spark, d).withColumn("mode", F.lit("chat")).withColumn("policy", F.lit("assistant_only"))
    return masking.sequences(rows, SEQ_LEN)


def role_boundary_sequences(spark, d):
    join = lambda c: F.md5(F.array_join(c, ","))
    return _chat_sequences(spark, d).select("conv_id", "seq_no", join("input_ids").alias("input_ids"), join("labels").alias("labels"))


def packing_stats(spark, d):
    return packing.packing_stats(packing.split(_plain_sequences(spark, d), ["doc_id", "seq_no"], 0.1))


def mask_health(spark, d):
    return packing.mask_health(_plain_sequences(spark, d)).withColumn("unmasked_percent", F.round("unmasked_percent", 6))


def chat_packing_stats(spark, d):
    return packing.packing_stats(packing.split(_chat_sequences(spark, d), ["conv_id", "seq_no"], 0.1))


def hash_split(spark, d):
    return packing.split(read(spark, d, "documents").select("doc_id"), ["doc_id"], 0.1)


def split_guarantee(spark, d):
    rows = packing.split(read(spark, d, "documents").select("doc_id"), ["doc_id"], 0.0)
    return packing.guarantee_splits(rows, ["doc_id"]).groupBy("split").agg(F.count("*").alias("n"))


def split_by_source(spark, d):
    return packing.split(read(spark, d, "records").select("record_id", "source").distinct(), ["record_id"], 0.1).groupBy("source", "split").agg(F.count("*").alias("n"))


def zipped_labels(spark, d):
    rows = _texts(spark, d).select("doc_id", byte_encode(F.col("text")).alias("ids")).where(F.size("ids") > 1)
    pairs = F.arrays_zip(F.slice("ids", F.lit(1), F.size("ids") - 1).alias("x"), F.slice("ids", F.lit(2), F.size("ids") - 1).alias("y"))
    return rows.select("doc_id", F.aggregate(pairs, F.lit(0).cast("long"), lambda a, p: a + p["x"] * p["y"]).alias("product"))


QUERIES = {
    "role_blocks": role_blocks, "assistant_mask": assistant_mask, "completion_mask": completion_mask, "partial_mask": partial_mask, "plain_labels": plain_labels, "fixed_sequences": fixed_sequences,
    "role_boundary_sequences": role_boundary_sequences, "packing_stats": packing_stats, "mask_health": mask_health, "chat_packing_stats": chat_packing_stats, "hash_split": hash_split,
    "split_guarantee": split_guarantee, "split_by_source": split_by_source, "zipped_labels": zipped_labels,
}

_ROLE = """case when lower(trim(role)) = 'human' then 'user' when lower(trim(role)) in ('gpt', 'bot') then 'assistant' when role is null or trim(role) = '' then 'user' else lower(trim(role)) end"""
_CHATS = f"""(select conv_id, string_agg('<|' || m.r || '|>' || chr(10) || m.t, chr(10) order by turn) as text from
    (select conv_id, turn, min({{'r': {_ROLE}, 't': coalesce(text, '')}}) as m from conversations group by 1, 2) group by 1)"""
_MARK = r"<\|(system|user|assistant|tool)\|>[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
# the marker is replaced by two characters that no text holds, the first of them naming the role
_TAGGED = f"regexp_replace(text, '{_MARK}', chr(57344) || '\\0' || chr(57345), 'g')"
_SPANS = f"""select conv_id, k, case when contains(p, chr(57345)) then split_part(p, chr(57345), 1) else '' end as marker, case when contains(p, chr(57345)) then substring(p, strpos(p, chr(57345)) + 1) else p end as body
    from (select conv_id, unnest(parts) as p, generate_subscripts(parts, 1) as k from (select conv_id, string_split({_TAGGED}, chr(57344)) as parts from {_CHATS}))"""
_PARTS = f"select conv_id, k, marker, body, regexp_extract(marker, '[a-z]+') as role from ({_SPANS}) where marker <> '' or body <> ''"
_IDS = SQL_IDS.format(x="text")
_BOUND = f"select doc_id, list_concat(list_concat([1], {_IDS}), [2]) as ids from documents where text is not null"
_WINDOWS = f"""select doc_id, k as seq_no, list_concat(w, list_transform(range({SEQ_LEN + 1} - len(w)), lambda x: 0)) as i, list_concat(y, list_transform(range({SEQ_LEN + 1} - len(y)), lambda x: -100)) as y from
    (select doc_id, k, ids[k * {SEQ_LEN + 1} + 1 : (k + 1) * {SEQ_LEN + 1}] as w, labels[k * {SEQ_LEN + 1} + 1 : (k + 1) * {SEQ_LEN + 1}] as y from
        (select doc_id, ids, list_concat([-100], ids[2:]) as labels, unnest(range(0, (len(ids) + {SEQ_LEN}) // {SEQ_LEN + 1}))::int as k from ({_BOUND}))) where len(w) > 1"""
_SEQS = f"select doc_id, seq_no, i[:{SEQ_LEN}] as input_ids, y[2:] as labels from ({_WINDOWS})"
_SHARE = "((('0x' || substr(md5('1337:' || {k}), 1, 8))::bigint % 10000) / 10000.0)"
_SPLIT = "case when " + _SHARE + " < {f} then 'val' else 'train' end"
_COUNTED = "select *, len(list_filter(labels, lambda x: x = -100)) as masked from ({s})"
_STATS = """select count(*) as sequences, cast(coalesce(sum(case when split = 'train' then {n} end), 0) as bigint) as train_tokens, cast(coalesce(sum(case when split = 'val' then {n} end), 0) as bigint) as val_tokens,
    cast(sum(masked) as bigint) as masked_labels, cast(sum({n} - masked) as bigint) as unmasked_labels, cast(sum(case when masked = {n} then 1 else 0 end) as bigint) as all_masked,
    cast(sum(case when masked = 0 then 1 else 0 end) as bigint) as all_unmasked, cast(sum(case when masked > 0 and masked < {n} then 1 else 0 end) as bigint) as mixed from ({s})"""
_TARGET = SEQ_LEN // 2
_ROOM = SEQ_LEN + 1 - _TARGET - 2
_BLOCKS = f"""select *, last_value(case when role = 'user' then body end ignore nulls) over (partition by conv_id order by k rows between unbounded preceding and 1 preceding) as user_text,
        last_value(case when role = 'system' then body end ignore nulls) over (partition by conv_id order by k rows between unbounded preceding and unbounded following) as system_text
    from ({_PARTS}) where role <> '' and body <> ''"""


def _stripped(x: str) -> str:
    from .common import sql_strip

    return sql_strip(x)


def _said(role: str, x: str) -> str:
    return f"case when coalesce({_stripped(x)}, '') <> '' then '<|{role}|>' || chr(10) || {_stripped(x)} || chr(10) else '' end"


_PREFIX = f"({_said('system', 'system_text')} || {_said('user', 'user_text')} || '<|assistant|>' || chr(10))"
_ANSWERS = f"""select conv_id, k, {SQL_IDS.format(x='body')} as b, {SQL_IDS.format(x=_PREFIX)} as prefix
    from ({_BLOCKS}) where role = 'assistant' and {_stripped('body')} <> ''"""
_W = SEQ_LEN + 1
_CUTS = f"select *, prefix[greatest(len(prefix) - {_ROOM}, 0) + 1:] as p from ({_ANSWERS})"
_PIECES = f"""select conv_id, k, j, p, b[j * step + 1:(j + 1) * step] as piece, (j + 1) * step >= len(b) as closes from
    (select *, unnest(range(0, (len(b) + step - 1) // step)) as j from (select *, greatest(1, least({_TARGET}, {_W} - len(p) - 2)) as step from ({_CUTS})))"""
_ALONG = f"""select conv_id, k, j, list_concat(list_concat([1], p), list_concat(piece, e)) as ids, list_concat(list_transform(range(len(p) + 1), lambda x: -100), list_concat(piece, e)) as labels
    from (select *, case when closes and 1 + len(p) + len(piece) < {_W} then [2] else [] end as e from ({_PIECES}))"""


def _parts(key: str, source: str) -> str:
    """Marker, role and body of each stretch of the texts of `source`, in order `k`."""
    spans = f"""select {key}, k, case when contains(p, chr(57345)) then split_part(p, chr(57345), 1) else '' end as marker, case when contains(p, chr(57345)) then substring(p, strpos(p, chr(57345)) + 1) else p end as body
        from (select {key}, unnest(parts) as p, generate_subscripts(parts, 1) as k from (select {key}, string_split({_TAGGED}, chr(57344)) as parts from {source}))"""
    return f"select {key}, k, marker, body, regexp_extract(marker, '[a-z]+') as role from ({spans}) where marker <> '' or body <> ''"


def _masked(key: str, source: str) -> str:
    """Ids and labels of the texts of `source` with only what the assistant says labelled."""
    return f"""select {key}, list_concat(list_concat([1], ids), [2]) as ids, list_concat(list_concat([-100], labels), [case when final = 'assistant' then 2 else -100 end]) as labels from
        (select {key}, flatten(list(list_concat(m, b) order by k)) as ids, flatten(list(list_concat(list_transform(m, lambda x: -100), case when role = 'assistant' then b else list_transform(b, lambda x: -100) end) order by k)) as labels,
            arg_max(role, k) as final from (select {key}, k, role, {SQL_IDS.format(x='marker')} as m, {SQL_IDS.format(x='body')} as b from ({_parts(key, source)})) group by 1)"""


_BEHIND = f"""select conv_id, 1 as k, w as j, ids[w * {_W} + 1:(w + 1) * {_W}] as ids, labels[w * {_W} + 1:(w + 1) * {_W}] as labels from
    (select *, unnest(range(0, (len(ids) + {SEQ_LEN}) // {_W})) as w from ({_masked('conv_id', _CHATS)}) where conv_id not in (select conv_id from ({_ANSWERS})))"""
_ALL = f"""select conv_id, row_number() over (partition by conv_id order by k, j) - 1 as seq_no, list_concat(ids, list_transform(range({_W} - len(ids)), lambda x: 0))[:{SEQ_LEN}] as input_ids,
    list_concat(labels, list_transform(range({_W} - len(labels)), lambda x: -100))[2:] as labels from ({_ALONG} union all {_BEHIND}) where len(ids) > 1"""
_LEAD_TEXTS = "(select k || ':' || doc_id as doc_id, v || text as text from documents, (values ('none', ''), " + ", ".join("('" + k + "', '" + v.replace(chr(10), "' || chr(10) || '") + "')" for k, v in LEADS.items()) + ") x(k, v) where text is not null)"
_COMPLETION = f"""with t as {_LEAD_TEXTS}, c as (select *, case when contains(text, chr(10) || '### Response:' || chr(10)) then chr(10) || '### Response:' || chr(10) when contains(text, chr(10) || 'Completion:' || chr(10)) then chr(10) || 'Completion:' || chr(10)
            when contains(text, chr(10) || 'Answer:' || chr(10)) then chr(10) || 'Answer:' || chr(10) end as mark from t where not contains(text, '<|assistant|>')),
    e as (select doc_id, list_concat(list_concat([1], {SQL_IDS.format(x='text')}), [2]) as ids, case when mark is null then 1 else 1 + strlen(split_part(text, mark, 1)) + strlen(mark) end as lead from c),
    a as (select * from t where contains(text, '<|assistant|>'))
    select doc_id, ids, list_concat(list_transform(range(lead), lambda x: -100), ids[lead + 1:]) as labels from e union all {_masked('doc_id', 'a')}"""

SQL = {
    "role_blocks": f"select conv_id, role, count(*) as blocks, cast(sum(strlen(body)) as bigint) as bytes from ({_PARTS}) where role <> '' and body <> '' group by 1, 2",
    "assistant_mask": f"""with p as (select conv_id, k, role, {SQL_IDS.format(x='marker')} as m, {SQL_IDS.format(x='body')} as b from ({_PARTS})),
        s as (select conv_id, flatten(list(list_concat(m, b) order by k)) as ids, flatten(list(list_concat(list_transform(m, lambda x: -100), case when role = 'assistant' then b else list_transform(b, lambda x: -100) end) order by k)) as labels,
            arg_max(role, k) as final from p group by 1)
        select conv_id, len(ids) + 2 as n, md5(array_to_string(list_concat(list_concat([1], ids), [2]), ',')) as ids,
            md5(array_to_string(list_concat(list_concat([-100], labels), [case when final = 'assistant' then 2 else -100 end]), ',')) as labels from s""",
    "completion_mask": f"select doc_id, len(ids) as n, md5(array_to_string(ids, ',')) as ids, md5(array_to_string(labels, ',')) as labels from ({_COMPLETION})",
    "partial_mask": f"""select doc_id, len(ids) as n, md5(array_to_string(ids, ',')) as ids,
        md5(array_to_string(list_concat(list_transform(range(len(ids) // 2), lambda x: -100), ids[len(ids) // 2 + 1:]), ',')) as labels from ({_BOUND})""",
    "plain_labels": f"select doc_id, len(ids) as n, md5(array_to_string(ids, ',')) as ids, md5(array_to_string(list_concat([-100], ids[2:]), ',')) as labels from ({_BOUND})",
    "fixed_sequences": f"select doc_id, seq_no, md5(array_to_string(input_ids, ',')) as input_ids, md5(array_to_string(labels, ',')) as labels from ({_SEQS})",
    "role_boundary_sequences": f"select conv_id, cast(seq_no as int) as seq_no, md5(array_to_string(input_ids, ',')) as input_ids, md5(array_to_string(labels, ',')) as labels from ({_ALL})",
    "chat_packing_stats": _STATS.format(n=SEQ_LEN, s="select *, " + _SPLIT.format(k="conv_id || ':' || seq_no", f=0.1) + f" as split from ({_COUNTED.format(s=_ALL)})"),
    "packing_stats": _STATS.format(n=SEQ_LEN, s="select *, " + _SPLIT.format(k="doc_id || ':' || seq_no", f=0.1) + f" as split from ({_COUNTED.format(s=_SEQS)})"),
    "mask_health": f"""select round(sum({SEQ_LEN} - masked) * 100.0 / sum({SEQ_LEN}), 6) as unmasked_percent, cast(sum(case when masked = {SEQ_LEN} then 1 else 0 end) as bigint) as all_masked,
        case when sum({SEQ_LEN} - masked) = 0 then 'fail' when sum({SEQ_LEN} - masked) * 100.0 / sum({SEQ_LEN}) < 5 then 'warn' else 'ok' end as verdict from ({_COUNTED.format(s=_SEQS)})""",
    "hash_split": f"select doc_id, {_SPLIT.format(k='doc_id', f=0.1)} as split from documents",
    "split_guarantee": "select 'train' as split, count(*) as n from documents union all select 'val', cast(1 as bigint)",
    "split_by_source": f"select source, {_SPLIT.format(k='record_id', f=0.1)} as split, count(*) as n from (select distinct record_id, source from records) group by 1, 2",
    "zipped_labels": f"select doc_id, cast(list_sum(list_transform(range(1, len(ids)), lambda j: ids[j] * ids[j + 1])) as bigint) as product from (select doc_id, {_IDS} as ids from documents where text is not null) where len(ids) > 1",
}
