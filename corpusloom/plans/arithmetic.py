"""Closed-form arithmetic over ranges and over run configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import schedules as A

from .common import read

SCHEDULE = A.Schedule(learning_rate=3e-4, min_learning_rate=3e-5, warmup_steps=50, max_steps=1000)


def _rate(kind):
    def query(spark, d):
        return spark.range(1200).select(F.col("id").alias("step"), F.round(A.learning_rate(F.col("id"), SCHEDULE, kind), 12).alias("lr"))

    return query


def model_profile(spark, d):
    rows = read(spark, d, "prep_runs").select("run_id", F.coalesce("seq_len", F.lit(512)).alias("s"))
    shape = A.model_profile(F.lit(32000), F.lit(512), F.lit(8), F.lit(8), F.lit(4), F.lit(2.5), F.col("s"))
    return rows.select("run_id", *[(F.round(c, 6) if k.endswith("_mb") else c).alias(k) for k, c in shape.items()])


def rope_positions(spark, d):
    p = lambda kind: F.round(A.scaled_position(F.col("id"), 2048, kind, 4.0, 512), 9)
    return spark.range(2048).select(F.col("id").alias("pos"), p("linear").alias("linear"), p("dynamic").alias("dynamic"), p("yarn").alias("yarn"))


def alibi_slopes(spark, d):
    return spark.range(12).select(F.col("id").alias("head"), F.round(A.alibi_slope(F.col("id"), 12), 9).alias("slope"))


def yarn_theta(spark, d):
    return spark.createDataFrame([(h, round(A.yarn_theta(10000.0, 4.0, h), 6)) for h in (16, 32, 64, 128)], "head_dim int, theta double")


def kv_int8(spark, d):
    q, scale = A.quantize_int8(F.col("embedding"))
    return read(spark, d, "embeddings").select("vec_id", F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.round(scale, 9).alias("scale"))


QUERIES = {
    "lr_cosine": _rate("cosine"), "lr_linear": _rate("linear"), "lr_constant": _rate("constant"), "model_profile": model_profile, "rope_positions": rope_positions,
    "alibi_slopes": alibi_slopes, "yarn_theta": yarn_theta, "kv_int8": kv_int8,
}

_STEPS = "(select unnest(range(1200)) as step)"


def _sql_rate(main: str) -> str:
    return f"select step, round(case when step < 50 then 3e-4 * (step + 1) / 50 else {main} end, 12) as lr from {_STEPS}"


_PARAMS = "(32000 * 512 + 8 * (2 * 512 * 8 * 64 + 2 * 512 * 4 * 64) + 8 * 3 * 512 * 1280 + 8 * 2 * 512 + 512)"
_FLOPS = "(8 * (4 * 512 * 512 + 2 * s * 512 + 6 * 512 * 1280))"

SQL = {
    "lr_cosine": _sql_rate("3e-5 + 0.5 * (1 + cos(pi() * least(1.0, (step - 50) / 950.0))) * 2.7e-4"),
    "lr_linear": _sql_rate("3e-5 + greatest(0.0, 1 - (step - 50) / 950.0) * 2.7e-4"),
    "lr_constant": _sql_rate("3e-4"),
    "model_profile": f"""select run_id, {_PARAMS}::bigint as parameters, ({_PARAMS} - 32000 * 512)::bigint as non_embedding_parameters, {_FLOPS}::bigint as forward_flops_per_token, ({_FLOPS} * 3)::bigint as train_flops_per_token,
        round(s * 8 * 512 * 2 / 1048576.0, 6) as activation_memory_mb, round(s * 8 * 2 * 4 * 64 * 2 / 1048576.0, 6) as kv_cache_memory_mb, round({_PARAMS} * 4 / 1048576.0, 6) as optimizer_state_memory_mb
        from (select run_id, coalesce(seq_len, 512)::bigint as s from prep_runs)""",
    "rope_positions": "select pos, round(pos / 4.0::double, 9) as linear, round(pos * 511.0::double / 2047, 9) as dynamic, round(pos / (1.0::double + least(1.0, greatest(0.0, (pos - 512.0::double) / 1536)) * 3), 9) as yarn from (select unnest(range(2048)) as pos)",
    "alibi_slopes": "select head, round(case when head < 8 then pow(0.5, head + 1) else pow(pow(2.0, -0.5), 2 * (head - 8) + 1) end, 9) as slope from (select unnest(range(12)) as head)",
    "yarn_theta": "select h::int as head_dim, round(10000.0::double * pow(4.0::double, h / (h - 2)::double), 6) as theta from (select unnest([16, 32, 64, 128]) as h)",
    "kv_int8": """select vec_id, cast(list_sum(list_transform(e, lambda x: greatest(-128, least(127, round_even(x / scale, 0)::int)))) as bigint) as total, round(scale, 9) as scale
        from (select vec_id, e, greatest(list_max(list_transform(e, lambda x: abs(x))), 1e-8) / 127.0::double as scale from (select vec_id, embedding::double[] as e from embeddings))""",
}
