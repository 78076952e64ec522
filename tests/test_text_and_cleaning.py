import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import clean, dedup


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize("raw", ["", " a ", "a\r\nb\rc", " x ", "\x1cx\x1f", "\tq\n\n", "a\x00b", "　全　"])
def test_normalize_is_what_python_strips(spark, raw):
    assert one(spark, raw, T.normalize_text) == raw.replace("\r\n", "\n").replace("\r", "\n").strip() + "\n"


def test_clean_text(spark):
    assert one(spark, "ａﬁ①\x00  b\t c\n\n\n\n\n\nd ", lambda c: T.clean_text(c, collapse_whitespace=True)) == "afi1 b c\n\n\nd\n"
    assert one(spark, "ａ  b", lambda c: T.clean_text(c, normalize_unicode=False)) == "ａ  b\n"
    assert one(spark, None, T.clean_text) is None


def test_length_and_truncation(spark):
    df = spark.createDataFrame([("x" * n + "\n",) for n in (14, 15, 16)] + [(None,)], "text string")
    assert clean.length_filter(df, 16).count() == 2
    assert one(spark, "ab cd ef", lambda c: T.truncate(c, 3)) == "ab\n"
    assert one(spark, "ab", lambda c: T.truncate(c, 3)) == "ab"


def test_language_is_en_only_above_the_share(spark):
    assert one(spark, "a" * 17 + "é" * 3, T.language_label) == "unknown"
    assert one(spark, "a" * 18 + "é" * 2, T.language_label) == "en"
    assert one(spark, "", T.language_label) == "unknown"


def test_suffixes(spark):
    paths = ["a/b.PY", "x.tar.gz", ".bashrc", "none", "d.ir/file", "q.jsonl"]
    assert [one(spark, p, T.path_suffix) for p in paths] == [".py", ".gz", "", "", "", ".jsonl"]


def test_first_repeat_survives_with_its_columns(spark):
    df = spark.createDataFrame([(3, "a", "z"), (1, "a", "x"), (2, "b", "y"), (4, None, "n"), (5, None, "m")], "ord int, text string, source string")
    assert sorted((r.ord, r.source) for r in dedup.exact_dedup(df).collect()) == [(1, "x"), (2, "y"), (4, "n")]
    assert dedup.exact_dedup(df.limit(0)).count() == 0
    corpus = spark.createDataFrame([("b",)], "text string")
    assert {r.ord for r in dedup.without_seen(df.where("text is not null"), corpus).collect()} == {1, 3}


def test_fingerprint_pairs_are_all_pairs(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(2)} | set(base) | {0}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    for crowd in (1000, 0):  # blocks of 16 bits, and the finest blocks
        got = dedup.fingerprint_pairs(spark.createDataFrame([(s,) for s in signed], "fp long"), 3, crowd)
        assert {(r.a, r.b) for r in got.collect()} == want


def test_near_dedup_is_the_greedy_pass(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words)]
    for k in range(1, 12):
        changed = list(words)
        changed[: 3 * k] = [f"x{k}_{i}" for i in range(3 * k)]
        texts.append(" ".join(changed))
    texts += ["", "", "something else entirely", texts[0]]
    kept, prints = [], []
    for i, t in enumerate(texts):
        f = dedup.simhash64(t)
        if all(bin(f ^ p).count("1") > 3 for p in prints):
            kept.append(i)
            prints.append(f)
    df = spark.createDataFrame(list(enumerate(texts)), "ord int, text string")
    assert sorted(r.ord for r in dedup.near_dedup(df).collect()) == kept
    assert len(kept) < len(texts) - 2


def test_pipeline_with_other_columns(spark):
    rows = [(1, "same text, long enough", 7), (2, "same text, long enough  ", 8), (3, "short", 9), (4, None, 1)]
    out = clean.clean_records(spark.createDataFrame(rows, "ord int, text string, key int"))
    assert [(r.ord, r.key) for r in out.collect()] == [(1, 7)]
