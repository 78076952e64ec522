"""Encoding of a whole corpus with a public byte-level BPE tokenizer (problem 7).

Method: pair occurrence index. A task splits its texts into pieces by the tokenizer's pattern, finds
the different pieces, and lays their bytes side by side. Every adjacent pair of symbols that has a
rank is entered in an index from rank to all its positions in the partition. The active ranks are
applied in ascending order, each to all its positions at once; only the lists of the pairs next to
a merge are updated. A merge creates a symbol whose own merges come later, so one ascending pass
is the whole encoding.

Splitting is done over the code points of a batch at once, by character class; pieces are told
apart by a 64-bit hash and encoded once per task. No text is cut.

Defined cases: null and empty texts have an empty list; marker strings are plain text; ids are the
vocabulary's, special tokens are never produced; other columns are ignored; very long texts are
encoded whole.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forms

#: Where the vocabulary files are, on the driver; a parameter of every operator.
TOKENIZER_DIR = "/opt/tokenizers"
#: Pieces a task keeps between flushes, and different pieces a worker remembers; both bound memory only.
HELD_PIECES = 3_000_000
REMEMBERED = 1_500_000

NONE = np.int32(2**31 - 1)
# Unicode white space.
SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE, LETTER, DIGIT, OTHER, EDGE = range(5)


class Vocabulary:
    """Arrays of a byte-level BPE vocabulary: symbol of each byte, sorted pairs, their ranks and results."""

    def __init__(self, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray):
        self.byte_ids = byte_ids.astype(np.int32)
        key = left.astype(np.int64) << 20 | right.astype(np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.result = key[order], rank[order].astype(np.int32), result.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it never merges."""
        k = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.rank[at], NONE)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable Latin-1 ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> Vocabulary:
    """Read a vocabulary on the driver, from its merge list (.json) or its ranks (.tiktoken)."""
    path = os.path.join(directory, f"{name}.json")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, letters = model["vocab"], byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        byte_ids = np.zeros(256, np.int32)
        for c, b in letters.items():
            byte_ids[b] = ids[c]
        left, right = (np.array([ids[m[k]] for m in merges]) for k in (0, 1))
        return Vocabulary(byte_ids, left, right, np.arange(len(merges)), np.array([ids[a + b] for a, b in merges]))
    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
    found = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    left, right, rank = (np.array(x) for x in zip(*found))
    return Vocabulary(byte_ids, left, right, rank, np.arange(max(ranks.values()) + 1))


@functools.cache
def char_classes() -> np.ndarray:
    """Class of each code point in the splitting pattern: space, letter, digit or other."""
    out = np.full(forms.LIMIT, OTHER, np.uint8)
    for cp in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0x20000), *range(0x2A6D0, 0x33500)):
        k = unicodedata.category(chr(cp))[0]
        if k in "LN":
            out[cp] = LETTER if k == "L" else DIGIT
    for lo, hi in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2A6D0)):
        for cp in range(lo, hi):
            if unicodedata.category(chr(cp)) == "Lo" or 0x4E00 <= cp < 0xA000 and unicodedata.category(chr(cp))[0] == "L":
                out[cp] = LETTER
    out[list(SPACES)] = SPACE
    return out


def pieces(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each piece of texts laid side by side; `ends` are the places of the separators between them.

    Runs of letters, of digits and of other signs are pieces, with one blank before them if there is one; a run of
    white space before something else leaves its last character to it (a blank) or apart (any other); an apostrophe
    right before s, t, m, d, re, ve or ll is a piece with them.
    """
    cls = char_classes()[codes]
    cls[ends] = EDGE
    n = len(cls)
    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = cls[1:] != cls[:-1]
    cut[ends] = True
    cut[ends + 1] = True
    # the last character of white space that something follows
    last = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE) & (cls[1:] != EDGE))
    cut[last] = True
    cut[last[codes[last] == 0x20] + 1] = False
    # apostrophes that begin a piece and stand before a letter
    q = np.flatnonzero(codes[:-1] == 0x27)
    q = q[cut[q] & (cls[q + 1] == LETTER)]
    if len(q):
        padded = np.concatenate([codes[: n], np.zeros(3, codes.dtype)])
        a, b = padded[q + 1], padded[q + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        width = np.where(one, 1, np.where(two, 2, 0))
        q, width = q[width > 0], width[width > 0]
        cut[q + 1] = False
        cut[q + 1 + width] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    real = cls[start] != EDGE
    return start[real], end[real]


def merge_all(symbols: np.ndarray, word_ends: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Apply the merges to words laid side by side (`word_ends`: last position of each).

    Returns the final symbol of each position and which positions still start a symbol.
    """
    n = len(symbols)
    sym = symbols.astype(np.int32)
    nxt = np.arange(1, n + 1, dtype=np.int32)
    nxt[word_ends] = -1
    prv = np.arange(-1, n - 1, dtype=np.int32)
    prv[0] = -1
    prv[word_ends[:-1] + 1] = -1
    at = np.full(n, NONE, np.int32)  # rank of the pair that starts here
    inner = np.flatnonzero(nxt >= 0)
    at[inner] = vocab.ranks(sym[inner], sym[inner + 1])
    alive = np.ones(n, bool)
    have = np.flatnonzero(at != NONE)
    have = have[np.argsort(at[have], kind="stable")]
    ranks, first = np.unique(at[have], return_index=True)
    index: dict[int, list[np.ndarray]] = {r: [p] for r, p in zip(ranks.tolist(), np.split(have, first[1:]))}
    heap = ranks.tolist()
    result, by_rank = vocab.result, at
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        p = p[by_rank[p] == r]
        if not len(p):
            continue
        right = nxt[p]
        if len(p) > 1 and (right[:-1] == p[1:]).any():  # a run of one symbol: every other pair, from the left
            joined = np.concatenate([[False], right[:-1] == p[1:]])
            head = np.maximum.accumulate(np.where(joined, 0, np.arange(len(p))))
            keep = (np.arange(len(p)) - head) % 2 == 0
            p, right = p[keep], right[keep]
        after = nxt[right]
        sym[p] = result[r]
        nxt[p] = after
        prv[after[after >= 0]] = p[after >= 0]
        alive[right] = False
        by_rank[right] = NONE
        before = prv[p]
        near = np.concatenate([before[before >= 0], p])
        if len(near) > 2:
            near = np.unique(near)
        follow = nxt[near]
        new = np.where(follow >= 0, vocab.ranks(sym[near], sym[follow]), NONE)
        by_rank[near] = new
        m = new != NONE
        near, new = near[m], new[m]
        if not len(near):
            continue
        if len(near) > 1:
            o = np.argsort(new, kind="stable")
            near, new = near[o], new[o]
            cuts = np.flatnonzero(new[1:] != new[:-1]) + 1
            parts = zip([int(new[0]), *new[cuts].tolist()], np.split(near, cuts))
        else:
            parts = ((int(new[0]), near),)
        for k, x in parts:
            if k in index:
                index[k].append(x)
            else:
                index[k] = [x]
                heapq.heappush(heap, k)
    return sym, alive


class Encoder:
    """Encodes batches of texts in one task, remembering the pieces it has met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)
        self.new_bytes: list[bytes] = []
        self.new_lengths: list[np.ndarray] = []

    def split(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Of each batch of texts: their numbers, the piece number of each piece, and how many pieces each text has."""
        for ix in forms.batches(texts):
            own = [texts[i] for i in ix]
            codes = forms._codes(own)
            ends = np.cumsum(np.fromiter((len(t) + 1 for t in own), np.int64, len(own))) - 1
            a, b = pieces(codes, ends)
            counts = np.bincount(np.searchsorted(ends, a), minlength=len(own))
            h, first, inv = np.unique(forms.span_hashes(codes, a, b), return_index=True, return_inverse=True)
            number = np.fromiter((self.known.get(x, -1) for x in h.tolist()), np.int64, len(h))
            fresh = np.flatnonzero(number < 0)
            if len(fresh):
                number[fresh] = len(self.known) + np.arange(len(fresh))
                self.known.update(zip(h[fresh].tolist(), number[fresh].tolist()))
                self._add(codes, a[first[fresh]], b[first[fresh]])
            yield ix, number[inv].astype(np.int32), counts

    def _add(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        n = b - a
        chars = codes[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
        if chars.dtype == np.uint8:
            self.new_bytes.append(chars.tobytes())
            self.new_lengths.append(n)
        else:
            self.new_bytes.append(chars.tobytes().decode("utf-32-le").encode())
            width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
            self.new_lengths.append(np.add.reduceat(width, np.concatenate([[0], np.cumsum(n)[:-1]])))

    def learn(self) -> None:
        """Encode the pieces met since the last call."""
        if not self.new_bytes:
            return
        raw = np.frombuffer(b"".join(self.new_bytes), np.uint8)
        lengths = np.concatenate(self.new_lengths)
        self.new_bytes, self.new_lengths = [], []
        ends = np.cumsum(lengths)
        sym, alive = merge_all(self.vocab.byte_ids[raw], ends - 1, self.vocab)
        kept = np.concatenate([[0], np.cumsum(alive)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + kept[ends]])
        self.ids = np.concatenate([self.ids, sym[alive]])

    def lengths(self, number: np.ndarray) -> np.ndarray:
        return self.offsets[number + 1] - self.offsets[number]

    def flat(self, number: np.ndarray) -> np.ndarray:
        """The ids of the pieces, one after the other."""
        n = self.lengths(number)
        total = np.cumsum(n)
        if not len(n):
            return np.zeros(0, np.int32)
        return self.ids[np.repeat(self.offsets[number] - (total - n), n) + np.arange(total[-1])]


_encoders: dict[int, Encoder] = {}


def task_encoder(shared) -> Encoder:
    """This worker's encoder for a broadcast vocabulary; it is kept between tasks and emptied when it grows large."""
    got = _encoders.get(shared.value_id)
    if got is None:
        _encoders.clear()
        got = _encoders[shared.value_id] = Encoder(shared.get())
    if len(got.known) > REMEMBERED:
        got.reset()
    return got


class SharedVocabulary:
    """A vocabulary sent to the workers once; its size is the vocabulary's (about 1 MB), not the data's."""

    def __init__(self, spark, name: str, directory: str):
        self.value_id = f"{directory}/{name}"
        self.sent = spark.sparkContext.broadcast(load_vocabulary(name, directory))

    def get(self) -> Vocabulary:
        return self.sent.value


def encode_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """`(id_col, ids)`: the token ids of each row's text, an empty list for null and empty texts."""
    shared = SharedVocabulary(df.sparkSession, tokenizer, directory)

    def run(it):
        enc = task_encoder(shared)
        held: list[tuple] = []
        count = 0
        for batch in it:
            texts = batch.column(1).to_pylist()
            parts = list(enc.split(texts))
            held.append((batch.column(0), len(texts), parts))
            count += sum(len(p[1]) for p in parts)
            if count > HELD_PIECES:
                yield from flush(enc, held)
                held, count = [], 0
                if len(enc.known) > REMEMBERED:
                    enc.reset()
        yield from flush(enc, held)

    def flush(enc, held):
        enc.learn()
        for ids, n, parts in held:
            done = np.zeros(n, bool)
            for ix, number, counts in parts:
                flat = enc.flat(number)
                ends = np.cumsum(np.concatenate([[0], enc.lengths(number)]))[np.cumsum(counts)]
                yield _lists(ids.take(pa.array(ix, pa.int64())), flat, np.concatenate([[0], ends]))
                done[ix] = True
            rest = np.flatnonzero(~done)
            if len(rest):
                yield _lists(ids.take(pa.array(rest)), np.zeros(0, np.int32), np.zeros(len(rest) + 1, np.int64))

    def _lists(ids, flat, offsets):
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([ids, lists], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text_col: str = "text", tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """The columns of `df` but the text, with `tokens`: the number of ids of each row's text (0 for null and empty).

    A column `tokens` of `df` is replaced.
    """
    shared = SharedVocabulary(df.sparkSession, tokenizer, directory)
    keep = [c for c in df.columns if c not in (text_col, "tokens")]

    def run(it):
        enc = task_encoder(shared)
        held: list[tuple] = []
        count = 0
        for batch in it:
            parts = list(enc.split(batch.column(batch.num_columns - 1).to_pylist()))
            held.append((batch, parts))
            count += sum(len(p[1]) for p in parts)
            if count > HELD_PIECES:
                yield from flush(enc, held)
                held, count = [], 0
                if len(enc.known) > REMEMBERED:
                    enc.reset()
        yield from flush(enc, held)

    def flush(enc, held):
        enc.learn()
        for batch, parts in held:
            tokens = np.zeros(batch.num_rows, np.int64)
            for ix, number, counts in parts:
                total = np.cumsum(np.concatenate([[0], enc.lengths(number)]))[np.cumsum(counts)]
                tokens[ix] = np.diff(np.concatenate([[0], total]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(tokens)], [*keep, "tokens"])

    types = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, f"{types}tokens long")
