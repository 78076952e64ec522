"""What the physical plans must look like, and how operators behave on skewed and clashing input."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bpe, dedup, extract, stats


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "documents.parquet")
    rows = [(i, f"text {i % 40}", "en", "a/b.txt", "x" * 50) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, unused string").write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(table):
    chosen = extract.select_text_columns(table.columns)
    assert "ReadSchema: struct<text:string>" in plan(table.select(*chosen).agg(F.sum(F.length("text"))))
    assert "unused" not in plan(dedup.repeats(table, order="doc_id"))
    assert "unused" not in plan(bpe.word_frequencies(table))


def test_filters_reach_the_scan(table):
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan(table.where("lang = 'en'").select("text"))


def test_no_texts_are_shuffled_to_find_repeats(table):
    exchanges = [line for line in plan(dedup.repeats(table, order="doc_id")).splitlines() if "Exchange" in line]
    assert exchanges and all("text" not in line for line in exchanges)


def test_top_k_is_not_a_full_sort(table):
    assert "TakeOrderedAndProject" in plan(stats.first(table, 5, "doc_id"))


def test_no_cartesian_products(spark, table):
    for df in (dedup.exact_dedup(table, order="doc_id"), dedup.near_pairs(table, "doc_id"), bpe.pair_counts(table.select(F.array(F.lit(1), F.lit(2)).alias("ids"), F.lit(1).alias("n")))):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_hot_text(spark, table):
    hot = table.withColumn("text", F.when(F.col("doc_id") % 3 == 0, "the same").otherwise(F.col("text")))
    kept = dedup.exact_dedup(hot, order="doc_id")
    assert kept.count() == hot.select("text").distinct().count()
    assert kept.where("text = 'the same'").first().doc_id == 0


def test_turns_out_of_order_and_twice(spark):
    rows = [(1, 2, "ASSISTANT ", "a", 9), (1, 1, "Human", "q", 9), (1, 1, "Human", "q", 8), (1, 3, None, None, 7), (2, 1, "gpt", "", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, r int")
    got = {r.conv_id: r.text for r in extract.render_turns(df).collect()}
    assert got == {1: "<|user|>\nq\n<|assistant|>\na\n<|user|>\n", 2: "<|assistant|>\n"}
    script = {r.conv_id: r.text for r in extract.chat_export(df).collect()}
    assert script == {1: "<|user|>\nq\n<|assistant|>\na\n<|endoftext|>\n\n"}


def test_longest_prefix(spark):
    q = spark.createDataFrame([("a", [1, 2, 3, 4]), ("b", [1, 2]), ("c", [9]), ("d", [])], "key string, ids array<int>")
    p = spark.createDataFrame([([1],), ([1, 2, 3],), ([1, 3],), ([1, 2, 3, 4, 5],)], "ids array<int>")
    assert {r.key: r.length for r in stats.longest_prefix(q, p).collect()} == {"a": 3, "b": 1, "c": 0, "d": 0}
    assert {r.length for r in stats.longest_prefix(q, p.limit(0)).collect()} == {0}


def test_tokenizer_benchmark_and_checkpoints(table, tmp_path):
    from corpusloom.operators.tokens import byte_encode
    from corpusloom.sources.sinks import newest_checkpoints

    said = stats.tokenizer_benchmark(table, byte_encode)
    assert said["records"] == 400 and said["tokens"] == said["characters"] > 0 and said["tokens_per_s"] > 0
    for n in ("step_1.pt", "step_2.pt", "x.json"):
        (tmp_path / n).write_text("")
    assert [p.rsplit("/", 1)[1] for p in newest_checkpoints(str(tmp_path))] == ["step_2.pt", "step_1.pt"]
    assert newest_checkpoints(str(tmp_path / "none")) == []
