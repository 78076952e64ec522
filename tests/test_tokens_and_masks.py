import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import bpe, extract, masking, packing, stats, tokens

CHAT = "<|system|>\nSpeak plainly.\n<|user|>\nWhich tree is tallest?\n<|assistant|>\nThe redwood.\n"


def test_byte_encoding_matches_python(spark):
    texts = ["", "a", "héllo � 世界 🙂", None, "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for bos, eos in ((False, False), (True, True), (False, True)):
        got = [r.i for r in df.select(tokens.byte_encode(F.col("t"), bos, eos).alias("i")).collect()]
        assert got == [None if t is None else tokens.byte_ids(t, bos, eos) for t in texts]
    back = df.select(tokens.byte_decode(tokens.byte_encode(F.col("t"), True, True)).alias("t")).collect()
    assert [r.t for r in back] == texts


def slow_bpe(words, merges, least):
    words = [(list(i), n) for i, n in words]
    out = []
    for _ in range(merges):
        count = {}
        for ids, n in words:
            for p in zip(ids, ids[1:]):
                count[p] = count.get(p, 0) + n
        if not count:
            break
        best = min(count, key=lambda p: (-count[p], p))
        if count[best] < least:
            break
        out.append(best)
        words = [(bpe.merge(i, *best, tokens.BPE_OFFSET + 255 + len(out)), n) for i, n in words]
    return out


def test_incremental_training_equals_recounting(spark):
    rng = random.Random(3)
    words = [([rng.randrange(14, 20) for _ in range(rng.randrange(1, 9))], rng.randrange(1, 9)) for _ in range(200)]
    want = slow_bpe(words, 60, 2)
    assert bpe.learn([(list(i), n) for i, n in words], 60, 2) == want
    df = spark.createDataFrame(words, "ids array<int>, n long")
    assert bpe.learn_distributed(df, 8, 2, cut_every=3) == want[:8]


def test_training_on_pieces_equals_recounting(spark):
    rng = random.Random(4)
    skewed = [(["aabb"[rng.randrange(4)] + "c" * rng.randrange(3) for _ in range(rng.randrange(1, 6))], rng.choice((1, 2, 900))) for _ in range(60)]
    fading = [(["ab"] * 6, 1000), (["abc"], 40), (["cd"], 9), (["de"], 9), (["ef"] * 3, 8), (["aaa", "aa"], 300), (["a"], 70), (["fg", "gh"], 3)]  # the later merges are far rarer than the pairs of bytes at first
    for words, merges, ids in ((skewed, 12, 0), (skewed, 25, 60), (fading, 4, 0), (fading, 14, 12), (fading, 40, 60)):
        rows = [([b + tokens.BPE_OFFSET for b in "".join(w).encode()], n) for w, n in words]
        df = spark.createDataFrame(rows, "ids array<int>, n long").repartition(3)
        assert bpe.learn_distributed(df, merges, 2, cut_every=2, driver_ids=ids) == slow_bpe(rows, merges, 2)


def test_a_merge_of_an_id_with_itself_ends_a_round():
    assert bpe.next_merges([(1, 1, 50), (2, 3, 20), (4, 5, 9)], 9) == [(1, 1)]  # the new id's own pair may have 24


def test_the_driver_never_holds_more_than_a_million_ids(spark, monkeypatch):
    rng = random.Random(5)
    letters = "etaoinshrdlu"
    words = ["".join(rng.choices(letters, [0.6**k for k in range(12)], k=30)) for _ in range(36_000)]
    seen, learn = [], bpe.learn
    monkeypatch.setattr(bpe, "learn", lambda words, *a: seen.append(sum(len(i) for i, _ in words)) or learn(words, *a))
    model = bpe.train_bpe(spark.createDataFrame([(w,) for w in words], "text string"), tokens.BPE_OFFSET + 256 + 8)
    assert len(model.merges) == 8 and max(seen, default=0) <= 1_000_000
    assert list(model.merges) == slow_bpe([([b + tokens.BPE_OFFSET for b in w.encode()], 1) for w in words], 8, 2)


def test_bpe_round_trip_and_ties(spark):
    df = spark.createDataFrame([("alpha alpha beta <|assistant|>",), (None,), ("",)], "text string")
    model = bpe.train_bpe(df, vocab_size=290)
    again = tokens.BpeModel.from_json(model.to_json())
    assert again == model and model.merges
    text = "alpha aaa beta\n<|assistant|> é"
    ids = model.encoder()(text)
    assert model.decode(ids) == text and len(ids) < len(text.encode())
    assert bpe.merge([1, 1, 1], 1, 1, 9) == [9, 1]


def test_columns_of_ids_equal_single_texts(spark, monkeypatch):
    texts = ["ab  cab é\nabab ", None, "", " ", "zz ab\x00", "é" * 50, *(f"abcab {k} cab" for k in range(40))]
    learnt = [([b + tokens.BPE_OFFSET for b in w], n) for w, n in ((b"abcab", 5), (b"cab a", 3), (b"aaab", 2), ("é".encode(), 2))]
    for merges in (2, 12):  # without a blank in the merges, and with one
        model = tokens.BpeModel(tuple(bpe.learn([(list(i), n) for i, n in learnt], merges, 2)))
        assert any(tokens.BPE_OFFSET + 32 in m for m in model.merges) == (merges == 12)
        df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", tokens.bpe_encode(F.col("t"), model).alias("ids"))
        rows = df.select("t", "ids", tokens.bpe_decode(F.col("ids"), model).alias("back")).collect()
        assert [r.ids for r in rows] == [None if t is None else model.encoder()(t) for t in texts]
        assert [r.back for r in rows] == texts
        odd = [[], None, [-1, 3, 14 + 97, 9999, 14 + 0xE9], [14 + 98]]
        got = spark.createDataFrame([(i,) for i in odd], "ids array<int>").coalesce(1).select(tokens.bpe_decode(F.col("ids"), model).alias("t")).collect()
        assert [r.t for r in got] == ["", None, "a\ufffd", "b"]
    made, init = [], tokens.BpeEncoder.__init__
    monkeypatch.setattr(tokens.BpeEncoder, "__init__", lambda self, m: made.append(m) or init(self, m))
    run = tokens._encoder
    run.cache_clear()
    assert run(model) is run(tokens.BpeModel.from_json(model.to_json())) and len(made) == 1  # texts of later batches find what was learnt


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc <|>\né", max_size=40))
def test_merging_in_order_equals_lowest_rank_first(text):
    model = tokens.BpeModel(tuple(bpe.learn([([b + 14 for b in w], n) for w, n in ((b"abcab", 5), (b"cab<|", 3), (b"aaab", 2))], 12, 2)))
    ids = [b + 14 for b in text.encode()]
    for k, (a, b) in enumerate(model.merges):
        ids = bpe.merge(ids, a, b, tokens.BPE_OFFSET + 256 + k)
    assert model.encoder()(text) == ids


def test_assistant_mask_keeps_only_the_answer():
    ids, labels = masking.assistant_mask(CHAT, tokens.byte_ids)
    said = tokens.byte_text([y for y in labels if y != masking.IGNORE])
    assert said == "The redwood.\n" and len(ids) == len(labels) and labels[-1] == tokens.EOS
    assert all(y in (masking.IGNORE, i) for i, y in zip(ids, labels))


def test_body_that_begins_like_a_marker_stays_a_body():
    blocks = masking.role_blocks("<|user|>\n<|x|> hi\n<|assistant|>\nyes")
    assert blocks == [("user", "<|x|> hi\n"), ("assistant", "yes")]
    assert masking.role_blocks("lead <|user|>a<|robot|>b") == [("user", "a<|robot|>b")]


@pytest.mark.parametrize("marker", masking.COMPLETION_MARKERS)
def test_completion_markers(marker):
    _, labels = masking.completion_mask(f"ask{marker}done", tokens.byte_ids)
    assert tokens.byte_text([y for y in labels if y != masking.IGNORE]) == "done"


def test_first_marker_of_the_list_wins():
    text = "q\nAnswer:\nx\n### Response:\ny"
    _, labels = masking.completion_mask(text, tokens.byte_ids)
    assert tokens.byte_text([y for y in labels if y != masking.IGNORE]) == "y"


@pytest.mark.parametrize("n", [1, 2, 8, 9, 10, 11, 18, 19])
def test_windows(n):
    ids = list(range(10, 10 + n))
    out = masking.shifted(ids, list(ids), 8)
    assert all(len(i) == len(y) == 8 for i, y in out)
    assert len(out) == n // 9 + (n % 9 > 1)
    if n == 9:
        assert out[0] == (ids[:-1], ids[1:])


def test_role_boundary_sequences():
    long = "<|user|>\n" + "q" * 300 + "\n<|assistant|>\n" + "a" * 100 + "\n<|user|>\nmore\n<|assistant|>\n   \n"
    out = masking.role_boundary(long, 64)
    kept = [tokens.byte_text([y for y in labels if y > 3]) for _, labels in out]
    assert "".join(kept) == "a" * 100 + "\n"
    assert sum(y == tokens.EOS for _, labels in out for y in labels) == 1
    assert all(0 < sum(y != -100 for y in labels) < 64 for _, labels in out)
    assert masking.training_sequences("no roles here", "chat", "assistant_only", 8)


def test_sequences_stats_and_splits(spark):
    df = spark.createDataFrame([(1, CHAT, "chat", "assistant_only"), (2, "plain text of some length", "generative", "none"), (3, None, "chat", "none"), (4, "", "generative", "none")], "ord int, text string, mode string, policy string")
    seqs = masking.sequences(df, 64)
    assert {r.ord for r in seqs.collect()} == {1, 2, 4}
    split = packing.split(seqs, ["ord", "seq_no"], 0.0)
    s = packing.packing_stats(split).first()
    assert s.sequences == 3 and s.mixed >= 2 and s.val_tokens == 0
    both = packing.guarantee_splits(split, ["ord", "seq_no"])
    assert {r.split for r in both.collect()} == {"train", "val"}
    assert packing.guarantee_splits(packing.split(seqs, ["ord"], 1.0), ["ord", "seq_no"]).where("split = 'train'").count() == 1
    h = packing.mask_health(split).first()
    assert 0 < h.unmasked_percent < 100 and h.verdict == "ok"
    assert packing.packing_stats(split.limit(0)).first().sequences == 0


@pytest.mark.parametrize("per", [50, 64, 10_000])
def test_shards_round_trip(spark, tmp_path, per):
    rows = [(i, [i * 10 + k for k in range(16)], [-100] * 8 + [i] * 8, "val" if i % 4 == 0 else "train") for i in range(21)]
    seqs = spark.createDataFrame(rows, "ord int, input_ids array<int>, labels array<int>, split string").repartition(5)
    packing.write_shards(seqs, str(tmp_path), packing.ShardLayout(300, per), ["ord"], 16)
    for name, want in (("train", [r for r in rows if r[3] == "train"]), ("val", [r for r in rows if r[3] == "val"])):
        got = packing.read_shards(spark, str(tmp_path), name).orderBy("seq_no").collect()
        assert [(r.input_ids, r.labels) for r in got] == [(r[1], r[2]) for r in want]
    with pytest.raises(ValueError):
        packing.read_shards(spark, str(tmp_path), "train", seq_len=32)
    assert packing.sample_batch(packing.read_shards(spark, str(tmp_path)), 40, seed=1).count() == 40


def test_decisions():
    assert packing.boundary_packing("auto", "none") and packing.boundary_packing("generative", "assistant-only") and not packing.boundary_packing("code", "auto")
    assert packing.writes_labels("generative", "auto") and not packing.writes_labels("code", "none")
    assert packing.ShardLayout(65535).dtype == "uint16" and packing.ShardLayout(65536).dtype == "uint32"


def test_modes(spark):
    rows = [("auto", None, CHAT, ".txt"), ("auto", "In-struct", "x", ".py"), (None, None, "x", ".PY"), ("Role-Play", "code", "x", ""), ("auto", "auto", "x", None)]
    df = spark.createDataFrame(rows, "m string, h string, t string, s string")
    mode = extract.record_mode(F.col("m"), F.col("h"), F.col("t"), F.col("s"))
    assert [r.m for r in df.select(mode.alias("m")).collect()] == ["chat", "in_struct", "code", "role_play", "generative"]
    assert extract.row_mode(["prompt", "answer"]) == "completion" and extract.corpus_mode({"prompt", "answer"}) == "generative"


def test_detectors(spark):
    cases = {"cycle": [1, 2, 3] * 10, "flat": [7] * 40, "short": [7] * 20, "fresh": list(range(64)), "long": (list(range(9)) * 8)[:64]}
    df = spark.createDataFrame(list(cases.items()), "k string, ids array<int>")
    hit = {r.k for r in df.where(stats.repetitive_tail(F.col("ids"))).collect()}
    assert hit == {"flat", "long"}
    assert df.where(stats.stop_match(F.col("ids"), [2, 3])).collect()[0].k == "cycle"
    ban = spark.createDataFrame([([1, 2, 3, 1, 2, 4, 1, 2],), ([1],), ([],)], "ids array<int>")
    assert [r.b for r in ban.select(stats.banned_next(F.col("ids"), 3).alias("b")).collect()] == [[3, 4], [], []]


def test_many_small_shards_and_large_reads_agree(spark, tmp_path):
    rows = [(f"d{i:03d}", [(i * 7 + k) % 250 for k in range(16)], [k if k % 3 else -100 for k in range(16)], "train") for i in range(300)]
    seqs = spark.createDataFrame(rows, "ord string, input_ids array<int>, labels array<int>, split string").repartition(5)
    packing.write_shards(seqs, "file://" + str(tmp_path), packing.ShardLayout(300, 1000), ["ord"], 16)
    for chunk in (1, 7, 1000):
        got = packing.read_shards(spark, str(tmp_path), chunk=chunk).orderBy("seq_no").collect()
        assert [(r.input_ids, r.labels) for r in got] == [(r[1], r[2]) for r in rows]
    assert packing.read_shards(spark, str(tmp_path), "val").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abcde", min_size=1, max_size=8), st.integers(1, 5)), min_size=1, max_size=12))
def test_rounds_of_sure_merges_equal_single_merges(words):
    rows = [([ord(c) for c in w], n) for w, n in words]
    want = slow_bpe(rows, 6, 2)
    got, left = [], [list(i) for i, _ in rows]
    while len(got) < 6:
        count = {}
        for ids, (_, n) in zip(left, rows):
            for p in zip(ids, ids[1:]):
                count[p] = count.get(p, 0) + n
        now = bpe.next_merges(sorted(((a, b, n) for (a, b), n in count.items()), key=lambda x: (-x[2], x[0], x[1])), 6 - len(got), 2)
        if not now:
            break
        for k, (a, b) in enumerate(now):
            left = [bpe.merge(ids, a, b, tokens.BPE_OFFSET + 256 + len(got) + k) for ids in left]
        got += now
    assert got == want


def test_wrapped_tokenizers(spark, tmp_path):
    tk = pytest.importorskip("tokenizers")
    vocabulary = {"[UNK]": 0, "red": 1, "##wood": 2, "tree": 3}
    t = tk.Tokenizer(tk.models.WordPiece(vocabulary, unk_token="[UNK]"))
    t.pre_tokenizer = tk.pre_tokenizers.Whitespace()
    path = str(tmp_path / "wp.json")
    t.save(path)
    encode, _ = tokens.load_tokenizer("WordPiece", path)
    df = spark.createDataFrame([("redwood tree",), (None,), ("",), ("??",)], "t string").coalesce(1)
    assert [r.i for r in df.select(encode(F.col("t")).alias("i")).collect()] == [[1, 2, 3], None, [], [0]]
    with pytest.raises(ValueError):
        tokens.tokenizer_type("no-such-type")
