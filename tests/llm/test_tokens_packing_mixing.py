import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import binpack, budget, encode, mixing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return encode.load_vocabulary()


def encoded(vocabulary, texts):
    enc = encode.Encoder(vocabulary)
    parts = list(enc.split(texts))
    enc.learn()
    out = {}
    for ix, number, counts in parts:
        flat = enc.flat(number).tolist()
        ends = np.cumsum(np.concatenate([[0], enc.lengths(number)]))[np.cumsum(counts)].tolist()
        for i, a, b in zip(ix, [0, *ends], ends):
            out[i] = flat[a:b]
    return [out.get(i, []) for i in range(len(texts))]


def test_known_texts(library, vocabulary):
    texts = ["", "it's we'll 's 'S 've", "   ", "a  b\n\n c\t\td ", "<|endoftext|>", "aaaaaaaaaaaaaaa", "½²①x　y z", "日本語 🙂🇳🇿 Привет", "x" * 3000, "\r\n\r\n", "a\x1cb\x00c", "''s", "don't'll"]
    assert encoded(vocabulary, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="ab '\n\té1.llsred中ж\xa0", max_size=40)), min_size=1, max_size=4))
def test_any_text(library, vocabulary, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encoded(vocabulary, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_tables(spark, library, monkeypatch):
    texts = ["one two", None, "", "naïve café", "one two", "z" * 100] * 3
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(2)
    got = {r.doc_id: r.ids for r in encode.encode_table(df).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    counts = {r.doc_id: r.tokens for r in encode.count_tokens(df.select("doc_id", "text")).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encode.encode_table(df.limit(0)).count() == 0
    clash = df.select(df.doc_id.alias("tokens"), df.text.alias("body"), df.ids.alias("text"))
    assert sorted(r.tokens for r in encode.count_tokens(clash, "body").collect()) == sorted(counts.values())


def test_totals(spark):
    rows = [("s", "en-US", "d", "one two"), ("s", "EN", "d", "one two"), ("s", "eng", "d", None), ("s", None, None, ""), ("t", "jp", None, "one two"), ("t", " ", None, "é")]
    df = spark.createDataFrame(rows, "source string, lang string, domain string, text string")
    got = {(r.source, r.lang, r.domain): (r.documents, r.characters, r.tokens) for r in budget.token_totals(df).collect()}
    assert got == {("s", "en", "d"): (3, 14, 4), ("s", None, None): (1, 0, 0), ("t", "ja", None): (1, 7, 2), ("t", None, None): (1, 1, 1)}
    assert {r.tokens for r in budget.token_totals(df, tokenizer="byte").collect()} == {14, 0, 7, 2}
    assert budget.token_totals(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=20))
def test_plan_places_every_item_once_within_capacity(lengths):
    steps, runs = binpack.plan_bins(lengths, (16, 32, 64), 1.0)
    load = {}
    for length in lengths:
        own = sorted(s for s in steps.tolist() if s[0] == length)
        assert [s[1] for s in own] == [0, *[s[2] for s in own[:-1]]] and own[-1][2] == lengths[length]
        for _, a, b, first, per in own:
            for i in range(a, b):
                k = first + (i - a) // per
                load[k] = load.get(k, 0) + length
    for first, many, capacity, used in runs.tolist():
        assert all(load[k] == used <= capacity for k in range(first, first + many))
        assert used > max([0, *[c for c in (16, 32, 64) if c < capacity]])  # downsized
    assert sorted(load) == list(range(sum(r[1] for r in runs.tolist())))


def test_sequences(spark):
    rng = random.Random(4)
    sizes = [rng.choice((0, 3, 10, 100, 200, 255, 256, 257, 1000, 2049, 5000)) for _ in range(400)] + [17] * 500
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(10_000, None)], "doc_id long, n long")
    rows = binpack.pack_items(df, "doc_id", "n", (256, 512, 1024)).collect()
    total, pieces, fill = {}, {}, {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + 1
        assert (r.sequence is None) == (r.tokens == 0)
        if r.sequence is not None:
            fill.setdefault(r.sequence, [r.capacity, r.used, 0])[2] += r.tokens
    assert total == {i: n for i, n in enumerate(sizes)} | {10_000: 0}
    assert all(pieces[i] == max(1, -(-n // 1024)) for i, n in enumerate(sizes))
    assert all(used == held <= cap for cap, used, held in fill.values())
    assert sum(sizes) / sum(c for c, _, _ in fill.values()) > 0.97
    assert binpack.pack_items(df.limit(0), "doc_id", "n").count() == 0


def test_permutations_are_permutations():
    for n in (1, 2, 7, 64, 1000):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(got.tolist()) == list(range(n))
    assert mixing.permute(np.arange(50), np.full(50, 50), np.full(50, 1)).tolist() != mixing.permute(np.arange(50), np.full(50, 50), np.full(50, 2)).tolist()


def test_mix_meets_weights_and_caps(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("aab"), rng.choice([None, 50, 60, 80]), "x" * 70, "train") for i in range(600)] + [(1000 + i, "c", 40, "y", "train") for i in range(5)]
    rows += rows[:20] + [(2000, "a", 10_000, "z", "val"), (2001, "b", 0, "", "train")]
    records = spark.createDataFrame(rows, "record_id long, source string, tokens long, text string, split_name string")
    mix = [("m", "a", 3.0, 1, 20_000), ("m", "b", 1.0, None, 20_000), ("m", "b", 1.0, None, 20_000), ("m", "c", 1.0, 2, 20_000), ("m", "none", 1.0, 4, 20_000), ("m", "b0", 0.0, 1, 20_000), ("n", "b", 1.0, None, 40_000)]
    weights = spark.createDataFrame(mix, "mix_id string, source string, weight double, max_repeats int, target_tokens long")
    drawn, q = mixing.draw(records, weights, block=500)
    got = drawn.collect()
    assert len({(r.mix_id, r.record_id) for r in got}) == len(got)
    assert all(r.record_id < 2000 for r in got)
    share = {(r.mix_id, r.source): r for r in mixing.shares(drawn, q).collect()}
    want = {("m", "a"): 10_000, ("m", "b"): 20_000 / 6, ("n", "b"): 40_000}
    for k, n in want.items():
        assert abs(share[k].actual_tokens - n) <= 60
    assert share["m", "c"].actual_tokens == 400 and share["m", "c"].most_repeats == 2
    assert share["m", "none"].actual_tokens == 0 and share["m", "b0"].actual_tokens == 0
    assert share["m", "a"].most_repeats == 1
    reps = [r.repeats for r in got if r.mix_id == "n"]
    assert max(reps) - min(reps) <= 1
    again = {(r.mix_id, r.record_id, r.repeats) for r in mixing.draw(records.repartition(7), weights, block=500)[0].collect()}
    assert again == {(r.mix_id, r.record_id, r.repeats) for r in got}
    laid, placed, _ = mixing.slots(records, weights, block=500, shards=4)
    laid = laid.persist()
    assert laid.where("record_id is null").groupBy("mix_id", "slot", "source").count().where("count > 1").isEmpty()
    places = laid.select("mix_id", "source", "slot", "place", "shard").distinct().orderBy("mix_id", "place").collect()
    for m in {r.mix_id for r in places}:
        own = [r for r in places if r.mix_id == m]
        assert [r.place for r in own] == list(range(len(own))) and [r.shard for r in own] == [4 * k // len(own) for k in range(len(own))]
    assert {tuple(r) for r in mixing.drawn_records(laid, placed).collect()} == {(r.mix_id, r.source, r.record_id, r.block, r.repeats, r.tokens) for r in drawn.collect()}
    plan = mixing.shard_plan(laid).groupBy("mix_id", "shard").sum("slots").collect()
    for m in "mn":
        n = [r["sum(slots)"] for r in plan if r.mix_id == m]
        assert max(n) - min(n) <= 1
    none, q = mixing.draw(records.limit(0), weights)
    assert none.count() == 0 and mixing.shares(none, q).count() == 6
