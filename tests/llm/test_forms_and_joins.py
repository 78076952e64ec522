import random
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import forms, looks, near_dup, overlap, setjoin

VOCABULARY = [f"w{i}" for i in range(400)] + ["the", "a", "of"] * 30


def text(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, s, k):
    words = s.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


def collection(seed=5, n=60):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(n):
        base = text(rng, rng.randrange(5, 80))
        for k in range(rng.choice((1, 1, 2, 4))):
            rows.append((i, edited(rng, base, k * 2) if k else base))
            i += 1
    rows += [(i, rows[0][1]), (i + 1, rows[0][1].upper()), (i + 2, None), (i + 3, ""), (i + 4, "tiny"), (i + 5, "a a a a a a a a"), (i + 6, "a a a a a a"), (0, rows[0][1])]
    return rows


def shingles(s, k):
    w = re.findall(r"\w+", forms.visual_form(s).lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)


def brute(rows, t, k, least):
    sets = {i: x for i, s in rows if s for x, n in [shingles(s, k)] if n >= least and x}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


@pytest.mark.parametrize("t,k,least", [(0.6, 3, 6), (0.8, 5, 1), (0.9, 1, 1)])
def test_near_duplicates_are_all_pairs(spark, t, k, least):
    rows = collection()
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "doc_id long, text string, side string").repartition(3)
    got = {(r.id_a, r.id_b) for r in near_dup.near_duplicate_pairs(df, threshold=t, shingle=k, least_words=least).collect()}
    want = brute(rows, Fraction(str(t)), k, least)
    assert got == want and len(want) >= 5


def test_hot_sequences_are_split_without_loss(spark):
    rows = collection(6)
    df = spark.createDataFrame(rows, "id long, text string").withColumn("side", F.lit(0).cast("byte"))
    want = None
    for hot in (10**6, 3):
        members, pairs = setjoin.similar_classes(df, Fraction(3, 5), 2, 3, bits=10, hot=hot)  # a crowded sketch
        got = {(r.a, r.b, r.overlap) for r in pairs.collect()}
        want = want or got
        assert got == want and got


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, record_id long, split_name string")
    assert near_dup.near_duplicate_pairs(df).count() == 0
    assert looks.same_look_pairs(df).count() == 0
    assert overlap.split_overlaps(df).count() == 0


def test_overlaps_of_splits(spark):
    rng = random.Random(2)
    rows = [(i, s, rng.choice(("train", "train", "val", "test", None))) for i, s in collection(7) if i]
    df = spark.createDataFrame(rows, "record_id long, text string, split_name string")
    got = {(r.train_id, r.eval_id) for r in overlap.split_overlaps(df, threshold=0.6, shingle=3, least_words=6).collect()}
    split = {i: s for i, _, s in rows}
    pairs = brute([(i, s) for i, s, _ in rows], Fraction(3, 5), 3, 6)
    look = {}
    for i, s, _ in rows:
        if s and len(forms.visual_form(s)) >= 16:
            look.setdefault(forms.visual_form(s), []).append(i)
    pairs |= {(min(a, b), max(a, b)) for g in look.values() for a in g for b in g if a != b}
    side = lambda i: {"train": 1, "val": 2, "test": 2}.get(split[i])
    want = {(a, b) if side(a) == 1 else (b, a) for a, b in pairs if {side(a), side(b)} == {1, 2}}
    assert got == want and want
    report = overlap.overlap_report(overlap.split_overlaps(df.withColumn("source", F.lit("s")), threshold=0.6, shingle=3, least_words=6), df.withColumn("source", F.lit("s")))
    assert sum(r.pairs for r in report.collect()) == len(want)
    sourced = df.withColumn("source", F.concat(F.lit("s"), F.col("record_id") % 3))
    whole = overlap.overlap_report(overlap.split_overlaps(sourced, threshold=0.6, shingle=3, least_words=6), sourced)
    by_class = overlap.class_report(*overlap.overlap_classes(sourced, threshold=0.6, shingle=3, least_words=6), sourced)
    assert sorted(map(tuple, by_class.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_the_join_is_the_same_in_many_buckets_and_without_filters(spark):
    rows = [(i, s) for i, s in collection(11) if i]
    df = spark.createDataFrame(rows, "id long, text string")
    split = df.withColumn("side", F.when(F.col("id") % 3 == 0, 2).otherwise(1).cast("byte"))
    for frame in (df.withColumn("side", F.lit(0).cast("byte")), split):
        want = None
        for given in ({}, {"bucket_entries": 50}, {"filter_most": 10}, {"bits": 8, "filter_most": 10, "bucket_entries": 200}):
            _, pairs = setjoin.similar_classes(frame, Fraction(3, 5), 3, 6, **given)
            got = {(r.a, r.b, r.overlap) for r in pairs.collect()}
            want = want or got
            assert got == want and got


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=12), st.sampled_from([Fraction(3, 5), Fraction(4, 5), Fraction(1, 2)]))
def test_block_skipping_and_derived_overlaps_lose_nothing(sets, t):
    token, fp, size, pos = [], [], [], []
    for i, s in enumerate(sets):
        n = int(setjoin.prefix_length(np.array(len(s)), t))
        for p, x in enumerate(sorted(s)[:n]):
            token.append(x), fp.append(i), size.append(len(s)), pos.append(p)
    token, fp, size, pos = (np.array(x) for x in (token, fp, size, pos))
    o = np.lexsort((pos, size, token))
    token, fp, size, pos = token[o], fp[o], size[o], pos[o]
    seen = {}
    for a, b in setjoin.block_pairs(token, fp, size, pos, np.zeros(len(fp), np.uint8), t):
        for x, y in zip(fp[a].tolist(), fp[b].tolist()):
            k = (min(x, y), max(x, y))
            seen[k] = seen.get(k, 0) + 1
    enough = [k for k, n in seen.items() if n >= min(setjoin.MATCHES, setjoin.needed(len(sets[k[0]]) + len(sets[k[1]]), t))]
    want = {(i, j): len(sets[i] & sets[j]) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])}
    assert set(want) <= set(enough)
    arrays = {i: np.array(sorted(s), np.uint64) for i, s in enumerate(sets)}
    every = [(i, j) for j in range(len(sets)) for i in range(j)]
    assert {(a, b): n for a, b, n in setjoin.verify_group(every, arrays, t)} == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAéßеоΣσﬁｘ ​\xa0\r\n\t²½‐é́ё́", max_size=12), min_size=1, max_size=5))
def test_table_path_equals_string_path(texts):
    for lower in (False, True):
        for ix in forms.batches(texts):
            codes, starts = forms.form_codes([texts[i] for i in ix], lower)
            for k, i in enumerate(ix):
                want = forms.visual_form(texts[i])
                assert "".join(map(chr, codes[starts[k] : starts[k + 1] - 1])) == (want.lower() if lower else want)


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("ｆｕｌｌ　ｗｉｄｔｈ", "full width", True), ("café", "café", True), ("ﬁne", "fine", True), ("a\xa0b", "a b", True), ("a​b\xad", "ab", True), ("раypal", "paypal", True), ("a‐b", "a-b", True),
        ("K", "K", True), ("ё", "ë", True), ("A", "a", False), ("cafe", "café", False), ("x²", "x2", False), ("a.", "a!", False), ("½", "1/2", False), ("a  b", "a b", False), ("ß", "ss", False), (" x\r\ny ", "x\ny", True),
    ],
)
def test_what_a_reader_sees(a, b, same):
    assert (forms.visual_form(a) == forms.visual_form(b)) is same
    if same:
        assert forms.fold_key(forms.visual_form(a)) == forms.fold_key(forms.visual_form(b))


def test_same_look_pairs(spark):
    long = "the quick brown fox jumps"
    rows = [(1, long), (2, long.replace(" ", "\xa0")), (3, long), (4, long.replace("o", "о")), (5, long.upper()), (6, "short"), (7, "sh​ort"), (8, None), (1, long), (9, f"  {long}\r\n")]
    df = spark.createDataFrame(rows, "record_id long, text string")
    got = {(r.id_a, r.id_b) for r in looks.same_look_pairs(df).collect()}
    assert got == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4), (2, 9), (4, 9)}
    shown = [r.t for r in df.select(looks.normalized(F.col("text")).alias("t")).collect()]
    assert shown == [forms.visual_form(t) for _, t in rows]


def test_rows_without_an_id_take_no_part(spark):
    text = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, text, "train"), (2, text.replace(" ", "\xa0"), "val"), (None, text, "train"), (None, text, "val")], "record_id long, text string, split_name string")
    pair = [(1, 2)]
    assert [tuple(r)[:2] for r in near_dup.near_duplicate_pairs(df, "record_id", "text", 0.6, 3, 3).collect()] == pair
    assert [tuple(r) for r in looks.same_look_pairs(df).collect()] == pair
    assert [tuple(r) for r in overlap.split_overlaps(df, threshold=0.6, shingle=3, least_words=3).collect()] == pair
