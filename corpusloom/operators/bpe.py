"""Word and pair statistics, and training of byte-level BPE vocabularies.

Counting the corpus is a Spark aggregation; the merge loop runs on the distinct words with an index from pairs to words, so a
round touches only words that hold the merged pair. Where the distinct words are more than `driver_words`, or their ids more than `driver_ids`, which bounds the driver's memory,
Spark jobs first cut them where no merge can come, until what is left is small enough; the merges are the same. Ties go to the lowest pair. Null and empty texts count nothing.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

from .tokens import BPE_OFFSET, BpeModel, byte_encode

#: Distinct words up to which the merge loop runs on the driver.
DRIVER_WORDS = 2_000_000
#: Ids of distinct words, or of pieces of them, up to which it does; each takes some hundred bytes there.
DRIVER_IDS = 1_000_000
#: Pairs whose counts the driver holds at once.
DRIVER_PAIRS = 100_000


def word_frequencies(df: DataFrame, text_col: str = "text", split: bool = True) -> DataFrame:
    """`(word, n)`: words between ASCII white space, or whole filled texts."""
    word = F.explode(F.split(text_col, r"[\t\n\f\r ]+")) if split else F.col(text_col)
    return df.select(word.alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def adjacent_pairs(ids: Column) -> Column:
    """The overlapping neighbouring pairs of an array of ids."""
    n = F.size(ids)
    left, right = F.slice(ids, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ids, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.when(n > 1, F.zip_with(left, right, lambda a, b: F.struct(a.alias("l"), b.alias("r"))))


def pair_counts(words: DataFrame, ids_col: str = "ids", n_col: str = "n") -> DataFrame:
    """`(l, r, n)`: neighbouring pairs weighted by the words' frequencies."""
    rows = words.select(F.explode(adjacent_pairs(F.col(ids_col))).alias("p"), F.col(n_col).alias("w"))
    return rows.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("w").alias("n"))


def best_pair(counts: DataFrame) -> DataFrame:
    """The most frequent pair, the lowest on ties."""
    return counts.orderBy(F.desc("n"), "l", "r").limit(1)


def merge(ids: list[int], left: int, right: int, new: int) -> list[int]:
    """`ids` with each (left, right) from the left replaced by `new`."""
    out, i = [], 0
    while i < len(ids):
        hit = ids[i] == left and i + 1 < len(ids) and ids[i + 1] == right
        out.append(new if hit else ids[i])
        i += 1 + hit
    return out


def learn(words: list[tuple[list[int], int]], merges: int, min_frequency: int = 2, before: int = 0) -> list[tuple[int, int]]:
    """The merges of weighted words, each round the most frequent pair; stops below `min_frequency`. `before` merges are done already."""
    count: dict[tuple[int, int], int] = defaultdict(int)
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for k, (ids, n) in enumerate(words):
        for p in zip(ids, ids[1:]):
            count[p] += n
            where[p].add(k)
    heap = [(-n, p) for p, n in count.items()]
    heapq.heapify(heap)
    out: list[tuple[int, int]] = []
    while heap and len(out) < merges:
        n, best = heapq.heappop(heap)
        if count.get(best, 0) != -n:  # an outdated entry; the current one is in the heap as well
            continue
        if -n < min_frequency or n == 0:
            break
        new = BPE_OFFSET + 256 + before + len(out)
        out.append(best)
        changed = set()
        for k in where.pop(best):
            ids, w = words[k]
            for p in zip(ids, ids[1:]):
                count[p] -= w
                changed.add(p)
                if p != best:
                    where[p].discard(k)
            ids = merge(ids, *best, new)
            words[k] = (ids, w)
            for p in zip(ids, ids[1:]):
                count[p] += w
                where[p].add(k)
                changed.add(p)
        for p in changed:
            if count[p] > 0:
                heapq.heappush(heap, (-count[p], p))
            else:
                del count[p]
    return out


def train_bpe(df: DataFrame, vocab_size: int = 32_000, min_frequency: int = 2, text_col: str = "text", split: bool = True, driver_words: int = DRIVER_WORDS, driver_ids: int = DRIVER_IDS) -> BpeModel:
    """A vocabulary of at most `vocab_size` ids learnt from all texts of `df`."""
    merges = vocab_size - BPE_OFFSET - 256
    words = word_frequencies(df, text_col, split)
    words = words.select((F.transform(byte_encode(F.col("word")), lambda x: x + (BPE_OFFSET - 4))).alias("ids"), "n")
    words = materialize(words, "words")
    count, ids = _size(words)
    if count <= driver_words and ids <= driver_ids:
        return BpeModel(tuple(learn(_collected(words), merges, min_frequency)))
    return BpeModel(tuple(learn_distributed(words, merges, min_frequency, driver_ids=driver_ids)))


def _size(words: DataFrame) -> tuple[int, int]:
    """The number of words and of their ids."""
    row = words.agg(F.count("*"), F.sum(F.size("ids"))).first()
    return row[0], row[1] or 0


def _collected(words: DataFrame) -> list[tuple[list[int], int]]:
    table = words.select("ids", "n").toArrow()
    return list(zip(table.column("ids").to_pylist(), table.column("n").to_pylist()))


def next_merges(top: list[tuple[int, int, int]], most: int, min_frequency: int = 2) -> list[tuple[int, int]]:
    """The merges that surely come next, of pairs `(l, r, n)` in order (frequent first, then lowest).

    A merge changes only counts of pairs that hold one of its two ids, and a pair with the new id is no more frequent than one of these. So the pairs
    in order are merged one by one until one holds an id of an earlier merge of the round. A merge of an id with itself ends the round, as there the only bound on the new pairs is the merged pair.
    """
    out: list[tuple[int, int]] = []
    touched: set[int] = set()
    for left, right, n in top:
        if len(out) == most or n < min_frequency or touched & {left, right}:
            break
        out.append((left, right))
        touched |= {left, right}
        if left == right:
            break
    return out


def learn_distributed(words: DataFrame, merges: int, min_frequency: int = 2, cut_every: int = 10, ahead: int = 256, driver_ids: int = 0) -> list[tuple[int, int]]:
    """As `learn`, with the words distributed: a round counts pairs, takes all merges that surely come next (`next_merges` of the
    first `ahead` pairs) and applies them in one pass.

    Counts of pairs only fall, and a pair with a new id is no more frequent than the pair of old ids at the same place. So down to merges of a count `floor`,
    words can be cut between the ids of a pair below it. The first floor is a guess from the counts; where the merges reach it, all words are taken up again with the merges so far, and a
    lower one. Every `cut_every` rounds, first of all in the first, equal pieces are counted together and stored; rounds in between are applied to them in one task each, as a chain of Python stages would take a worker for each. Once the pieces have at most `driver_ids` ids, the driver goes on with them.
    """
    out: list[tuple[int, int]] = []
    whole, done, floor, rounds = words, 0, 0, 0
    open_: list[Round] = []
    while len(out) < merges:
        top = [tuple(r) for r in _counted(words, open_).where(F.col("n") >= max(floor, min_frequency)).orderBy(F.desc("n"), "l", "r").limit(DRIVER_PAIRS).collect()]
        if not floor:
            left = merges - len(out)
            floor = max(min_frequency, top[left][2] // 2 if len(top) > left else 0)
        now = next_merges(top[:ahead], merges - len(out), max(floor, min_frequency))
        if now:
            steps = _steps(now, len(out))
            out += now
            known = len(top) < DRIVER_PAIRS or top[-1][2] < floor
            open_.append((steps, np.array(sorted(left << 32 | right for left, right, n in top if n >= floor), np.int64) if known else None))
            rounds += 1
            if rounds % cut_every != 1 % cut_every:
                continue
            words, open_ = materialize(_rewritten(words, open_).groupBy("ids").agg(F.sum("n").alias("n")), "words"), []
            if _size(words)[1] > driver_ids:
                continue
            out += learn(_collected(words), merges - len(out), floor, len(out))
        if floor <= min_frequency:
            break
        if len(out) < merges:
            floor = max(min_frequency, floor // 4)
            whole = words = materialize(_rewritten(whole, [(_steps(out[done:], done), None)]), "words")
            done, rounds, open_ = len(out), 0, []
    return out


def _steps(merges: list[tuple[int, int]], before: int) -> list[tuple[int, int, int]]:
    return [(*pair, BPE_OFFSET + 256 + before + k) for k, pair in enumerate(merges)]


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all words of a batch, whether the next id is of the same word, and the word's frequency at each id."""
    words = batch.column("ids")
    n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ids = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(n)[n > 0] - 1] = False
    return ids, inner, np.repeat(batch.column("n").to_numpy(zero_copy_only=False), n)


def _pair_codes(ids: np.ndarray) -> np.ndarray:
    """A number for each id and the next one."""
    return ids[:-1] << 32 | ids[1:]


#: The merges `(left, right, new)` of a round, and the codes of the pairs of ids that aren't cut apart before them; None: no cuts.
Round = tuple[list[tuple[int, int, int]], np.ndarray | None]


def _applied(batch: pa.RecordBatch, rounds: list[Round]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `_flat`, after the rounds."""
    ids, inner, n = _flat(batch)
    for steps, kept in rounds:
        if kept is not None and len(ids):
            inner[:-1] &= np.isin(_pair_codes(ids), kept)
        for left, right, new in steps:
            at = np.flatnonzero((ids[:-1] == left) & (ids[1:] == right) & inner[:-1])
            if left == right and len(at):  # of a run of hits every other one, from the left
                first = np.concatenate([[True], np.diff(at) > 1])
                at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
            if len(at):
                ids[at], inner[at] = new, inner[at + 1]
                stays = np.ones(len(ids), bool)
                stays[at + 1] = False
                ids, inner, n = ids[stays], inner[stays], n[stays]
        stays = inner.copy()
        stays[1:] |= inner[:-1]
        ids, inner, n = ids[stays], inner[stays], n[stays]
    return ids, inner, n


def _counted(words: DataFrame, rounds: list[Round]) -> DataFrame:
    """As `pair_counts`, of the words after the rounds, summed within each task first."""

    def run(it):
        counts: dict[int, int] = defaultdict(int)

        def rows():
            codes, n = np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["l", "r", "n"])

        for batch in it:
            ids, inner, n = _applied(batch, rounds)
            inner, n = inner[:-1], n[:-1]
            codes, at = np.unique(_pair_codes(ids)[inner], return_inverse=True)
            sums = np.zeros(len(codes), np.int64)
            np.add.at(sums, at, n[inner])
            for c, k in zip(codes.tolist(), sums.tolist()):
                counts[c] += k
            if len(counts) > 500_000:
                yield rows()
        yield rows()

    return words.select("ids", "n").mapInArrow(run, "l int, r int, n long").groupBy("l", "r").agg(F.sum("n").alias("n"))


def _rewritten(words: DataFrame, rounds: list[Round]) -> DataFrame:
    """`(ids, n)` of the words or their pieces after the rounds. Those of a single id have no pairs and are left out."""

    def run(it):
        for batch in it:
            ids, inner, n = _applied(batch, rounds)
            ends = np.flatnonzero(~inner) + 1
            starts = np.concatenate([[0], ends])[: len(ends)].astype(np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, pa.array(n[starts])], ["ids", "n"])

    return words.select("ids", "n").mapInArrow(run, "ids array<int>, n long")
