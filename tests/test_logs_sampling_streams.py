import math
import statistics

import pytest
from pyspark.sql import functions as F

from corpusloom import streaming as S
from corpusloom.functions import schedules as A
from corpusloom.operators import metrics_log as M
from corpusloom.operators import sampling as G
from corpusloom.operators import stats


def points(spark, values, run=1):
    return spark.createDataFrame([(run, i, v) for i, v in enumerate(values)], "run_id int, step int, value double")


def test_rolling_and_explosions(spark):
    values = [1.0, 2.0, 3.0, 1.5, 2.5] * 8 + [50.0, 2.0]
    rows = points(spark, values)
    mean = [r.recent_mean for r in M.rolling_mean(rows, 4).orderBy("step").collect()]
    assert mean == pytest.approx([statistics.fmean(values[max(0, i - 3) : i + 1]) for i in range(len(values))])
    med = [r.recent_median for r in M.rolling_median(rows, 32).orderBy("step").collect()]
    assert med == pytest.approx([statistics.median(values[max(0, i - 31) : i + 1]) for i in range(len(values))])
    assert [r.step for r in M.explosions(rows).collect()] == [40]
    assert M.explosions(points(spark, [0.0, 5.0])).count() == 0


def test_values_that_are_not_finite_are_absent(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, float("nan")), (1, 3, None), (1, 4, float("inf"))], "run_id int, step int, loss double")
    assert [r.value for r in M.series(df, "loss").collect()] == [0.5]
    assert M.last_values(df, ["loss"]).first().loss == 0.5


def test_early_stop(spark):
    rows = {r.step: r for r in M.best_so_far(points(spark, [3.0, 2.0, 2.0, 2.5, 1.0, 1.5, 1.5]), patience=2).collect()}
    assert [rows[i].improved for i in range(7)] == [True, True, False, False, True, False, False]
    assert [rows[i].stale for i in range(7)] == [0, 0, 1, 2, 0, 1, 2]
    assert [i for i in range(7) if rows[i].stops] == [3]


def test_alerts_and_perplexity(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 11.0), (2, 1.0, 1.2, 6.0), (3, 1.0, None, None)], "run_id int, loss double, val_loss double, grad_norm double")
    assert sorted(tuple(r) for r in M.alerts(df).collect()) == [(1, "danger", "gradient"), (1, "warning", "gap"), (2, "warning", "gradient")]
    assert M.evaluation(points(spark, [30.0]).withColumnRenamed("value", "val_loss")).first().perplexity == pytest.approx(math.exp(20))


def logits(spark, values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, token int, logit double")


def kept(df):
    return [r.token for r in df.where("logit is not null").orderBy("token").collect()]


def test_filters_keep_ties_and_the_crossing_token(spark):
    assert kept(G.top_k(logits(spark, [3.0, 2.0, 2.0, 1.0]), "g", 2)) == [0, 1, 2]
    even = logits(spark, [math.log(x) for x in (0.4, 0.3, 0.2, 0.1)])
    assert kept(G.top_p(even, "g", 0.5)) == [0, 1]
    assert kept(G.top_p(even, "g", 0.05)) == [0]
    assert kept(G.min_p(even, "g", 0.5)) == [0, 1, 2]
    history = spark.createDataFrame([(1, 0), (1, 0), (1, 3)], "g int, token int")
    got = {r.token: r.logit for r in G.repetition_penalty(logits(spark, [2.0, 1.0, 0.0, -2.0]), history, "g", 2.0).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 0.0, 3: -4.0}
    got = {r.token: r.logit for r in G.frequency_presence(logits(spark, [2.0, 1.0, 0.0, -2.0]), history, "g", 0.5, 0.25).collect()}
    assert got == {0: 0.75, 1: 1.0, 2: 0.0, 3: -2.75}
    assert G.argmax(logits(spark, [1.0, 2.0, 2.0]), "g").first().token == 1


def test_presets():
    c = G.preset(G.SamplingConfig(mode="chat"))
    assert (c.temperature, c.top_p, c.repetition_penalty, c.no_repeat_ngram_size) == (0.7, 0.9, 1.08, 4)
    assert G.preset(G.SamplingConfig(mode="deterministic")).top_k == 1 and G.preset(G.SamplingConfig(mode="low_memory", top_k=80)).top_k == 40


def test_losses(spark):
    df = spark.createDataFrame([(-0.5, 1), (-1.5, 2), (-9.0, -100)], "log_prob double, label int")
    assert G.masked_cross_entropy(df).first().loss == pytest.approx(1.0)
    assert G.masked_cross_entropy(df.where("label = -100")).first().loss == 0.0
    same, labels = logits(spark, [1.0, 0.0]), spark.createDataFrame([(1, 0)], "g int, token int")
    ce = math.log(1 + math.exp(-1))
    assert G.distillation_loss(same, same, "g", labels).first().loss == pytest.approx(0.5 * ce)
    one = spark.range(1).select(G.preference_loss(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)]).alias("l")).first().l
    assert one == pytest.approx(math.log(1 + math.exp(-0.1)))


def test_mirostat_is_the_same_every_time(spark):
    df = spark.range(6).crossJoin(spark.range(8).withColumnRenamed("id", "t")).select(F.lit(1).alias("g"), F.col("id").alias("step"), F.col("t").cast("int").alias("token"), (F.col("t") % 3).cast("double").alias("logit"))
    a, b = (G.mirostat(df, "g", "step", seed=4).orderBy("step").collect() for _ in range(2))
    assert a == b and len(a) == 6


def test_schedules(spark):
    s = A.Schedule(1.0, 0.1, 10, 110)
    df = spark.createDataFrame([(0,), (9,), (10,), (60,), (110,), (500,)], "s int")
    got = {k: [r.v for r in df.select(A.learning_rate(F.col("s"), s, k).alias("v")).collect()] for k in ("cosine", "linear", "constant")}
    assert got["cosine"] == pytest.approx([0.1, 1.0, 1.0, 0.55, 0.1, 0.1])
    assert got["linear"] == pytest.approx([0.1, 1.0, 1.0, 0.55, 0.1, 0.1])
    assert got["constant"] == pytest.approx([0.1, 1.0, 1.0, 1.0, 1.0, 1.0])
    slopes = [r.v for r in spark.range(8).select(A.alibi_slope(F.col("id"), 8).alias("v")).collect()]
    assert slopes == pytest.approx([2.0 ** -(i + 1) for i in range(8)])
    q, scale = A.quantize_int8(F.array(F.lit(1.0), F.lit(-2.0), F.lit(0.5)))
    r = spark.range(1).select(q.alias("q"), scale.alias("s")).first()
    assert r.q == [64, -127, 32] and r.s == pytest.approx(2 / 127)


def test_scores(spark):
    df = spark.createDataFrame([([1, 2, 3, 1, 2, 3],), ([1],), ([],)], "ids array<int>")
    assert [r.s for r in df.select(stats.repetition_score(F.col("ids")).alias("s")).collect()] == pytest.approx([0.25, 0.0, 0.0])
    assert [r.s for r in df.select(stats.distinct_ratio(F.col("ids")).alias("s")).collect()] == pytest.approx([0.5, 1.0, 0.0])


def test_reports_of_empty_tables(spark):
    empty = spark.createDataFrame([], "text string, ord int")
    assert stats.tokenizer_report(empty).first().tokens == 0
    assert stats.training_scan(empty).first().records == 0
    assert stats.validate(empty).first().valid is False
    assert stats.dataset_summary(empty).first().bytes_utf8 == 0


def test_stream_dedup_appends_once(spark, tmp_path):
    from corpusloom.operators import dedup

    source, corpus = tmp_path / "in", tmp_path / "corpus"
    rows = [("a text that is long enough",), ("a text that is long enough ",), ("another text, also long",), (None,), ("short",)]
    spark.createDataFrame(rows, "text string").coalesce(1).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema

    def run():
        stream = S.clean_stream(S.stream_parquet(spark, str(source), schema))
        S.run_available(stream, S.append_unseen(str(corpus)), str(tmp_path / "checkpoint"))

    run()
    assert spark.read.parquet(str(corpus)).count() == 2
    spark.createDataFrame([("another text, also long",), ("a third text of some length",)], "text string").write.mode("append").parquet(str(source))
    run()
    assert spark.read.parquet(str(corpus)).count() == 3
    assert dedup.repeats(spark.read.parquet(str(corpus)).withColumn("ord", F.monotonically_increasing_id())).count() == 0


def test_entry_is_consistent():
    import __spark_entry__ as E

    queries, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
