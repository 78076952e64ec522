"""Filters over logits; the embeddings serve as vectors of logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import sampling as S

from .common import read


def _logits(spark, d):
    return S.explode_logits(read(spark, d, "embeddings"), "vec_id", "embedding")


def _history(spark, d):
    """Tokens seen in each group: a fixed pattern of five, one of them twice."""
    rows = read(spark, d, "embeddings").select("vec_id", F.explode(F.array(*[F.lit(k) for k in (0, 1, 2, 3, 3)])).alias("k"))
    return rows.select("vec_id", F.pmod(F.col("vec_id") * 7 + F.col("k") * 13, F.lit(64)).cast("int").alias("token"))


def _repeating(spark, d):
    """A history in which an n-gram comes again: seven tokens, twice."""
    rows = read(spark, d, "embeddings").select("vec_id", F.posexplode(F.array(*[F.lit(k) for k in (0, 1, 2, 3, 4, 5, 6, 0, 1, 2)])).alias("pos", "k"))
    return rows.select("vec_id", "pos", F.pmod(F.col("vec_id") * 7 + F.col("k") * 13, F.lit(64)).cast("int").alias("token"))


def distillation_loss(spark, d):
    """Each vector as the student of the next one; the label is a token fixed by the id."""
    vectors = read(spark, d, "embeddings").select("vec_id", "embedding")
    student, teacher = S.explode_logits(vectors, "vec_id", "embedding"), S.explode_logits(vectors.withColumn("embedding", F.reverse("embedding")), "vec_id", "embedding")
    labels = vectors.select("vec_id", F.pmod("vec_id", F.lit(64)).cast("int").alias("token"))
    return S.distillation_loss(student, teacher, "vec_id", labels).select("vec_id", F.round("loss", 6).alias("loss"))


def _kept(df):
    return df.where("logit is not null").groupBy("vec_id").agg(F.count("*").alias("kept"), F.sum(F.col("token").cast("long")).alias("tokens"))


def softmax_entropy(spark, d):
    return S.entropy(_logits(spark, d), "vec_id").select("vec_id", F.round("entropy", 6).alias("entropy"))


def top_k(spark, d):
    return _kept(S.top_k(_logits(spark, d), "vec_id", 5))


def top_p(spark, d):
    return _kept(S.top_p(_logits(spark, d), "vec_id", 0.8))


def min_p(spark, d):
    return _kept(S.min_p(_logits(spark, d), "vec_id", 0.8))


def argmax(spark, d):
    return S.argmax(_logits(spark, d), "vec_id")


def _digest(df):
    return df.groupBy("vec_id").agg(F.round(F.sum(F.col("logit") * (F.col("token") + 1)), 5).alias("checksum"))


def repetition_penalty(spark, d):
    return _digest(S.repetition_penalty(_logits(spark, d), _history(spark, d), "vec_id", 1.3))


def freq_presence_penalty(spark, d):
    return _digest(S.frequency_presence(_logits(spark, d), _history(spark, d), "vec_id", 0.2, 0.1))


def chat_preset(spark, d):
    config = S.preset(S.SamplingConfig(mode="chat", top_k=20, frequency_penalty=0.2, presence_penalty=0.1))
    return _kept(S.apply_config(_logits(spark, d), "vec_id", config, _repeating(spark, d)))


def gumbel_draw(spark, d):
    return S.draw(_logits(spark, d), "vec_id", seed=3)


def mirostat(spark, d):
    rows = _logits(spark, d).withColumn("gen", F.col("vec_id") % 10).withColumnRenamed("vec_id", "step")
    return S.mirostat(rows, "gen", "step")


def masked_cross_entropy(spark, d):
    p = S.softmax(_logits(spark, d), "vec_id").withColumn("label", F.pmod(F.col("vec_id"), F.lit(64)))
    chosen = p.where("token = label").select(F.col("vec_id"), F.ln("prob").alias("log_prob"), F.when(F.col("vec_id") % 5 == 0, -100).otherwise(F.col("label")).alias("label"), (F.col("vec_id") % 7).alias("part"))
    return S.masked_cross_entropy(chosen, "part").select("part", F.round("loss", 6).alias("loss"))


def preference_loss(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(4)])
    return rows.select("vec_id", F.round(S.preference_loss(*[F.col(f"e{k}") for k in range(4)]), 6).alias("loss"))


def token_accuracy(spark, d):
    best = S.argmax(_logits(spark, d), "vec_id")
    rows = read(spark, d, "embeddings").select("vec_id", "label").join(best, "vec_id")
    return rows.agg(F.count("*").alias("n"), F.sum((F.col("token") % 10 == F.col("label") % 10).cast("long")).alias("hits"))


QUERIES = {
    "softmax_entropy": softmax_entropy, "top_k": top_k, "top_p": top_p, "min_p": min_p, "argmax": argmax, "repetition_penalty": repetition_penalty, "freq_presence_penalty": freq_presence_penalty,
    "chat_preset": chat_preset, "gumbel_draw": gumbel_draw, "mirostat": mirostat, "masked_cross_entropy": masked_cross_entropy, "preference_loss": preference_loss, "distillation_loss": distillation_loss, "token_accuracy": token_accuracy,
}

_L = "(select vec_id, unnest(embedding)::double as logit, unnest(range(len(embedding)))::int as token from embeddings)"
_P = f"(select *, exp(logit - m) / sum(exp(logit - m)) over (partition by vec_id) as prob from (select *, max(logit) over (partition by vec_id) as m from {_L}))"
_H = "(select vec_id, ((vec_id * 7 + k * 13) % 64)::int as token from embeddings, (select unnest([0, 1, 2, 3, 3]) as k))"
_R = "(select vec_id, ((vec_id * 7 + k * 13) % 64)::int as token from embeddings, (select unnest([0, 1, 2, 3, 4, 5, 6, 0, 1, 2]) as k))"
_KEPT = "select vec_id, count(*) as kept, cast(sum(token) as bigint) as tokens from ({s}) group by 1"
_SUM = "select vec_id, round(sum(logit * (token + 1)), 5) as checksum from ({s}) group by 1"

SQL = {
    "softmax_entropy": f"select vec_id, round(-sum(prob * ln(greatest(prob, 1e-12))), 6) as entropy from {_P} group by 1",
    "top_k": _KEPT.format(s=f"select * from (select *, rank() over (partition by vec_id order by logit desc) as r from {_L}) where r <= 5"),
    "top_p": _KEPT.format(s=f"select * from (select *, coalesce(sum(prob) over (partition by vec_id order by prob desc, token rows between unbounded preceding and 1 preceding), 0) as before from {_P}) where before <= 0.8"),
    "min_p": _KEPT.format(s=f"select * from (select *, max(prob) over (partition by vec_id) as top from {_P}) where prob >= top * 0.8"),
    "argmax": f"select vec_id, arg_max(token, (logit, -token)) as token from {_L} group by 1",
    "repetition_penalty": _SUM.format(s=f"select l.vec_id, l.token, case when h.token is null then logit when logit < 0 then logit * 1.3 else logit / 1.3 end as logit from {_L} l left join (select distinct * from {_H}) h using (vec_id, token)"),
    "freq_presence_penalty": _SUM.format(s=f"select l.vec_id, l.token, logit - coalesce(n * 0.2 + 0.1, 0) as logit from {_L} l left join (select vec_id, token, count(*) as n from {_H} group by 1, 2) h using (vec_id, token)"),
    "chat_preset": _KEPT.format(s=f"""select * from (select *, coalesce(sum(prob) over (partition by vec_id order by prob desc, token rows between unbounded preceding and 1 preceding), 0) as before from
        (select *, exp(logit - m) / sum(exp(logit - m)) over (partition by vec_id) as prob from (select *, max(logit) over (partition by vec_id) as m from
        (select * from (select *, rank() over (partition by vec_id order by logit desc) as r from (select l.vec_id, l.token, (case when n is null then logit when logit < 0 then logit * 1.08 else logit / 1.08 end - coalesce(n * 0.2 + 0.1, 0)) / 0.7 as logit
        from {_L} l left join (select vec_id, token, count(*) as n from {_R} group by 1, 2) h using (vec_id, token) where l.token <> (l.vec_id * 7 + 3 * 13) % 64)) where r <= 20)))) where before <= 0.9"""),
    "distillation_loss": f"""with s as (select vec_id, unnest(embedding)::double as x, unnest(list_reverse(embedding))::double as y, unnest(range(len(embedding)))::int as token from embeddings),
        z as (select vec_id, token, x, exp(x / 2) / sum(exp(x / 2)) over w as ps, exp(y / 2) / sum(exp(y / 2)) over w as pt, exp(x) / sum(exp(x)) over w as p from s window w as (partition by vec_id))
        select vec_id, round(0.5 * 4 * sum(pt * (ln(pt) - ln(ps))) + 0.5 * max(case when token = vec_id % 64 then -ln(p) end), 6) as loss from z group by 1""",
    "masked_cross_entropy": f"""select part, round(coalesce(-sum(case when label <> -100 then lp end) / nullif(count(case when label <> -100 then 1 end), 0), 0), 6) as loss
        from (select vec_id % 7 as part, ln(prob) as lp, case when vec_id % 5 = 0 then -100 else vec_id % 64 end as label from {_P} where token = vec_id % 64) group by 1""",
    "preference_loss": "select vec_id, round(ln(1 + exp(-0.1 * ((e[1]::double - e[2]::double) - (e[3]::double - e[4]::double)))), 6) as loss from (select vec_id, embedding as e from embeddings)",
    "token_accuracy": f"select count(*) as n, cast(sum(case when token % 10 = label % 10 then 1 else 0 end) as bigint) as hits from embeddings join (select vec_id, arg_max(token, (logit, -token)) as token from {_L} group by 1) using (vec_id)",
}
