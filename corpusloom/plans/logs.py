"""Analytics of metric logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import metrics_log as M
from corpusloom.operators import stats

from .common import read


def _log(spark, d):
    return M.once(read(spark, d, "metric_log"), ["run_id", "step", "event"])


def _train(spark, d, metric):
    return M.series(_log(spark, d).where("event = 'train'"), metric)


def _evals(spark, d):
    return M.series(_log(spark, d).where("val_loss is not null"), "val_loss").groupBy("run_id", "step").agg(F.min("value").alias("value"))


def metric_series(spark, d):
    return _log(spark, d).select("run_id", "event", M.finite("loss").alias("value")).where("value is not null").groupBy("run_id", "event").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def rolling_loss_mean(spark, d):
    return M.rolling_mean(_train(spark, d, "loss")).select("run_id", "step", F.round("recent_mean", 3).alias("recent_mean"))


def rolling_median(spark, d):
    return M.rolling_median(_train(spark, d, "grad_norm")).select("run_id", "step", F.round("recent_median", 6).alias("recent_median"))


def grad_explosions(spark, d):
    return M.explosions(_train(spark, d, "grad_norm"), factor=5.0).select("run_id", "step", F.round("baseline", 6).alias("baseline"))


def last_nonnull(spark, d):
    cols = ["loss", "val_loss", "grad_norm", "lr"]
    return M.last_values(_log(spark, d).where("event = 'train'"), cols)


def best_so_far(spark, d):
    return M.best_so_far(_evals(spark, d), patience=3).select("run_id", "step", F.round("best_before", 9).alias("best_before"), "improved", "stale")


def early_stop(spark, d):
    return M.best_so_far(_evals(spark, d), patience=2).where("stops").select("run_id", "step")


def tail_n(spark, d):
    return stats.last(_log(spark, d).select("run_id", "step", "event"), 50, "run_id", "step", "event")


def head_n(spark, d):
    return stats.first(read(spark, d, "documents"), 100, "doc_id").select("doc_id", "source")


def alerts(spark, d):
    cols = ["loss", "val_loss", "grad_norm"]
    return M.alerts(M.last_values(_log(spark, d), cols))


def evaluation(spark, d):
    out = M.evaluation(_log(spark, d))
    return out.select("run_id", F.round("mean_loss", 6).alias("mean_loss"), F.round("perplexity", 4).alias("perplexity"))


def cumulative_tokens(spark, d):
    return M.cumulative(_train(spark, d, "loss"), 4096).groupBy("run_id").agg(F.max("tokens_seen").alias("tokens_seen"))


def throughput(spark, d):
    rows = read(spark, d, "metric_log").groupBy("run_id", "step").agg(F.min("logged_at").alias("logged_at"))
    return M.throughput(rows, 4096).where("tokens_per_s is not null").groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.avg("tokens_per_s"), 3).alias("mean"))


def log_with_runs(spark, d):
    last = M.last_values(_log(spark, d), ["loss"])
    return read(spark, d, "prep_runs").select("run_id", "seq_len", "tokenizer_type").join(last, "run_id", "left")


def late_rows(spark, d):
    rows = read(spark, d, "metric_log")
    return rows.where(F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("logged_at").cast("timestamp")) > 86_400_000_000).groupBy("run_id").agg(F.count("*").alias("late"))


QUERIES = {
    "metric_series": metric_series, "rolling_loss_mean": rolling_loss_mean, "rolling_median": rolling_median, "grad_explosions": grad_explosions, "last_nonnull": last_nonnull, "best_so_far": best_so_far,
    "early_stop": early_stop, "tail_n": tail_n, "head_n": head_n, "alerts": alerts, "evaluation": evaluation, "cumulative_tokens": cumulative_tokens, "throughput": throughput, "log_with_runs": log_with_runs, "late_rows": late_rows,
}

_TRAIN = "event = 'train'"
_VALUES = ("loss", "val_loss", "grad_norm", "lr")
_ONCE = """(select * from (select *, row_number() over (partition by run_id, step, event order by ingested_at, loss nulls first, val_loss nulls first, grad_norm nulls first, lr nulls first, logged_at) as rn from metric_log) where rn = 1)"""


def _fin(c: str) -> str:
    return f"case when isfinite({c}) then {c} end"


def _points(metric: str, where: str = "event = 'train'") -> str:
    return f"(select run_id, step, {metric} as value from {_ONCE} where {where} and isfinite({metric}))"


def _last(metrics: tuple[str, ...], where: str = "true") -> str:
    return f"(select run_id, {', '.join(f'arg_max({_fin(m)}, step) filter (where isfinite({m})) as {m}' for m in metrics)} from {_ONCE} where {where} group by 1)"


_EVALS = f"(select run_id, step, min(value) as value from {_points('val_loss', 'val_loss is not null')} group by 1, 2)"
_BEST = f"""(select *, best_before is null or value < best_before as improved from (select *, min(value) over (partition by run_id order by step rows between unbounded preceding and 1 preceding) as best_before from {_EVALS}))"""
_STALE = f"""(select *, row_number() over (partition by run_id, island order by step) - 1 as stale from (select *, sum(improved::int) over (partition by run_id order by step rows unbounded preceding) as island from {_BEST}))"""

SQL = {
    "metric_series": f"select run_id, event, count(*) as n, round(sum(loss), 6) as total from {_ONCE} where isfinite(loss) group by 1, 2",
    "rolling_loss_mean": f"select run_id, step, round(avg(value) over (partition by run_id order by step rows between 31 preceding and current row), 3) as recent_mean from {_points('loss')}",
    "rolling_median": f"select run_id, step, round(median(value) over (partition by run_id order by step rows between 31 preceding and current row), 6) as recent_median from {_points('grad_norm')}",
    "grad_explosions": f"""select run_id, step, round(baseline, 6) as baseline from (select *, median(value) over (partition by run_id order by step rows between 32 preceding and 1 preceding) as baseline from {_points('grad_norm')})
        where baseline > 0 and value > baseline * 5""",
    "last_nonnull": f"select * from {_last(_VALUES, _TRAIN)}",
    "best_so_far": f"select run_id, step, round(best_before, 9) as best_before, improved, stale::int as stale from {_STALE}",
    "early_stop": f"select run_id, min(step) as step from {_STALE} where stale >= 2 group by 1",
    "tail_n": f"select run_id, step, event from {_ONCE} order by run_id desc, step desc, event desc limit 50",
    "head_n": "select doc_id, source from documents order by doc_id limit 100",
    "alerts": f"""with l as (select * from {_last(('loss', 'val_loss', 'grad_norm'))}) select run_id, case when grad_norm > 10 then 'danger' else 'warning' end as level, 'gradient' as kind from l where grad_norm > 5
        union all select run_id, 'warning', 'gap' from l where val_loss - loss > 0.5""",
    "evaluation": f"select run_id, round(m, 6) as mean_loss, round(exp(least(20.0, m)), 4) as perplexity from (select run_id, avg({_fin('val_loss')}) as m from {_ONCE} group by 1)",
    "cumulative_tokens": f"select run_id, max((step + 1) * 4096) as tokens_seen from {_points('loss')} group by 1",
    "throughput": """with r as (select run_id, step, min(logged_at) as t from metric_log group by 1, 2), l as (select *, lag(t) over w as t0, lag(step) over w as s0 from r window w as (partition by run_id order by step))
        select run_id, count(*) as n, round(avg((step - s0) * 4096 / ((epoch_us(t) - epoch_us(t0)) / 1e6)), 3) as mean from l where epoch_us(t) > epoch_us(t0) group by 1""",
    "log_with_runs": f"select p.run_id, p.seq_len, p.tokenizer_type, l.loss from prep_runs p left join {_last(('loss',))} l using (run_id)",
    "late_rows": "select run_id, count(*) as late from metric_log where epoch_us(ingested_at) - epoch_us(logged_at) > 86400000000 group by 1",
}
