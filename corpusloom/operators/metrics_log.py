"""Analytics of training metric logs.

Rows are ordered by `order` within `by` (a run). Values that are null, NaN or infinite are skipped, as if the row lacked
the metric. Windows are over a run's rows: runs are the unit of parallelism, and only the few columns of a metric are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    """The value where it is a finite number, else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def once(df: DataFrame, keys: list[str], arrival: str = "ingested_at") -> DataFrame:
    """Rows written twice count once: the first to arrive of each key."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(arrival, *[c for c in rest if c != arrival])).alias("_r"))
    return one.select(*keys, "_r.*")


def series(df: DataFrame, metric: str, by: str = "run_id", order: str = "step") -> DataFrame:
    """`(by, order, value)` of the finite values of a metric."""
    return df.select(by, order, finite(metric).alias("value")).where("value is not null")


def rolling_mean(points: DataFrame, width: int = 32, by: str = "run_id", order: str = "step") -> DataFrame:
    """Each point with the mean of it and the `width` - 1 before it."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(width - 1), 0)
    return points.withColumn("recent_mean", F.avg("value").over(w))


def rolling_median(points: DataFrame, width: int = 32, by: str = "run_id", order: str = "step") -> DataFrame:
    """Each point with the median of it and the `width` - 1 before it."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(width - 1), 0)
    return points.withColumn("recent_median", F.expr("percentile(value, 0.5)").over(w))


def explosions(points: DataFrame, factor: float = 10.0, width: int = 32, by: str = "run_id", order: str = "step") -> DataFrame:
    """Points more than `factor` times the median of the `width` before them, where that is positive."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-width, -1)
    base = points.withColumn("baseline", F.expr("percentile(value, 0.5)").over(w))
    return base.where((F.col("baseline") > 0) & (F.col("value") > F.col("baseline") * factor))


def entropy_collapse(points: DataFrame, least: float = 0.25) -> DataFrame:
    return points.where(F.col("value") < least)


def last_values(df: DataFrame, metrics: list[str], by: str = "run_id", order: str = "step") -> DataFrame:
    """The last finite value of each metric of each run."""
    return df.groupBy(by).agg(*[F.max_by(finite(m), F.when(finite(m).isNotNull(), F.col(order))).alias(m) for m in metrics])


def best_so_far(points: DataFrame, patience: int = 5, by: str = "run_id", order: str = "step") -> DataFrame:
    """Each evaluation with the best value before it, whether it improves on that, the evaluations since the last
    improvement, and whether training stops there: at the first that reaches `patience`."""
    run = Window.partitionBy(by).orderBy(order)
    before = F.min("value").over(run.rowsBetween(Window.unboundedPreceding, -1))
    rows = points.withColumn("best_before", before).withColumn("improved", F.col("best_before").isNull() | (F.col("value") < F.col("best_before")))
    rows = rows.withColumn("_island", F.sum(F.col("improved").cast("int")).over(run))
    rows = rows.withColumn("stale", (F.row_number().over(Window.partitionBy(by, "_island").orderBy(order)) - 1).cast("int"))
    reached = F.sum((F.col("stale") >= patience).cast("int")).over(run)
    return rows.withColumn("stops", (F.col("stale") >= patience) & (reached == 1)).drop("_island")


def cumulative(points: DataFrame, tokens_per_step: int, by: str = "run_id", order: str = "step") -> DataFrame:
    """Points with the tokens trained on up to their step."""
    return points.withColumn("tokens_seen", (F.col(order) + 1) * tokens_per_step)


def throughput(df: DataFrame, tokens_per_step: int, by: str = "run_id", order: str = "step", at: str = "logged_at") -> DataFrame:
    """Tokens a second between neighbouring rows of a run."""
    run = Window.partitionBy(by).orderBy(order)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    seconds = (micros - F.lag(micros).over(run)) / 1e6
    steps = F.col(order) - F.lag(order).over(run)
    return df.select(by, order, F.when(seconds > 0, steps * tokens_per_step / seconds).alias("tokens_per_s"))


def alerts(last: DataFrame, by: str = "run_id", loss: str = "loss", val_loss: str = "val_loss", grad: str = "grad_norm") -> DataFrame:
    """`(by, level, kind)`: gradients over 10 (danger) or 5 (warning), validation loss more than 0.5 above training loss."""
    found = F.array(
        F.when(F.col(grad) > 10, F.struct(F.lit("danger").alias("level"), F.lit("gradient").alias("kind"))).when(F.col(grad) > 5, F.struct(F.lit("warning").alias("level"), F.lit("gradient").alias("kind"))),
        F.when(F.col(val_loss) - F.col(loss) > 0.5, F.struct(F.lit("warning").alias("level"), F.lit("gap").alias("kind"))),
    )
    return last.select(by, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a")).select(by, "a.level", "a.kind")


def evaluation(df: DataFrame, by: str = "run_id", loss: str = "val_loss") -> DataFrame:
    """Mean loss of each run and its perplexity, the loss capped at 20."""
    return df.groupBy(by).agg(F.avg(finite(loss)).alias("mean_loss")).withColumn("perplexity", F.exp(F.least(F.lit(20.0), F.col("mean_loss"))))


def parse_log(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Rows of a JSON-lines log: blank and broken lines are skipped, values that are not finite become null, fields may be missing."""
    with_ = lines.withColumn("_line", F.monotonically_increasing_id()) if "_line" not in lines.columns else lines
    parsed = with_.where(F.trim(value) != "").withColumn("_p", F.from_json(value, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowNonNumericNumbers": "true"}))
    rows = parsed.where("_p is not null and _p._corrupt is null").select("_line", "_p.*").drop("_corrupt")
    return rows.select(*[finite(f.name).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in rows.schema])
