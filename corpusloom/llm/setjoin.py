"""Exact similarity joins of texts by their sets of word sequences (problems 1 and 6).

A text's set holds the hashes (52 bits) of its different runs of `shingle` words. Texts with equal
sets form one class, named by a 64-bit fingerprint, so copies cost one entry however many they are.

1. `sketch`: how often each sequence occurs, over all texts, in one array of fixed size (counts of
   hash buckets, never too low). It only orders the sequences, rare ones first; any order that all
   tasks share gives exact results, so bucket collisions cost time, not pairs. A bucket counted once
   proves that its sequence joins nothing.
2. `postings`: the prefix of each set in that order (of two sides, first those of the index, then the entries of the other that meet it). Two sets of similarity >= t share `MATCHES`
   sequences of their prefixes (all they need to share, if that is fewer). Entries travel packed by hash bucket. A sequence that very many texts hold in
   their prefix is split into pairs of blocks, each pair its own entry list.
3. `candidates`: within a bucket, lists are split by size and ordered by position. For a list and a
   size, the bound on the overlap says up to which position entries can still qualify; whole blocks
   beyond it are skipped without touching their entries.
4. `verify`: candidate pairs are gathered around a common neighbour. Where a set's overlaps are
   known, those of a highly similar set follow from the few elements by which the two differ:
   bounds first, then only those elements are looked up.

Everything is keyed by fingerprints; the caller joins records back.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize, partitions

from . import forms

#: log2 of the sketch's buckets, least and most; the broadcast array has that many bytes. In between, a bucket for every eight bytes of input.
SKETCH_BITS, SKETCH_MOST = 24, 27
SLICE_BITS = 16
#: Bits of a filter for each value in it, and log2 of the bits that a filter has at most (128 MB); beyond these the texts to verify are found by a join.
FILTER_LOAD, FILTER_MOST = 16, 30
#: Prefix entries that a task of the candidate search holds, about; the number of tasks follows from the counted entries.
BUCKET_ENTRIES = 2_000_000
#: Entries of one sequence above which its list is split into pairs of blocks.
HOT = 20_000
#: Sequences of their prefixes that two sets must share; each more lengthens the prefix by one and saves false candidates.
MATCHES = 4
#: Pairs that are expanded at once within a task.
CHUNK = 1 << 21
#: Pairs of a verification group above which it is split.
GROUP = 20_000


def needed(total: np.ndarray | int, t: Fraction) -> np.ndarray | int:
    """The least overlap of two sets with `total` elements together whose Jaccard similarity is >= t."""
    p, q = t.numerator, t.numerator + t.denominator
    return -((-p * total) // q)


def prefix_length(n: np.ndarray, t: Fraction) -> np.ndarray:
    """Entries of a set of `n` elements that are indexed: any partner shares at least `MATCHES` of them, or all it shares."""
    return np.minimum(n, n - -(-t.numerator * n // t.denominator) + MATCHES)


def text_sets(texts: list[str | None], shingle: int, least_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (text numbers, set elements, offsets): the sorted set of each text with at least `least_words` words."""
    for ix in forms.batches(texts):
        codes, starts = forms.form_codes([texts[i] for i in ix], lower=True)
        a, b, doc = forms.word_spans(codes, starts)
        words = np.bincount(doc, minlength=len(ix))
        if shingle > 1:
            h = forms.span_hashes(codes, a, b)
            n = len(h) - shingle + 1
            if n <= 0:
                continue
            mixed = np.zeros(n, np.uint64)
            for k in range(shingle):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
            same = doc[:n] == doc[shingle - 1 :]
            h, doc = forms.mix(mixed)[same], doc[:n][same]
        else:
            h = forms.span_hashes(codes, a, b)
        keep = words[doc] >= least_words
        h, doc = h[keep] >> np.uint64(12), doc[keep]
        for lo in range(0, len(ix), 4096):  # 12 bits for the text, 52 for the element: one sort does both
            m = (doc >= lo) & (doc < lo + 4096)
            both = np.unique((doc[m] - lo).astype(np.uint64) << np.uint64(52) | h[m])
            d = (both >> np.uint64(52)).astype(np.int64)
            own, at = np.unique(d, return_index=True)
            if len(own):
                yield np.asarray(ix, np.int64)[own + lo], both & np.uint64((1 << 52) - 1), np.append(at, len(both))


def fingerprints(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set (signed, as Spark's long)."""
    n = np.diff(offsets).astype(np.uint64)
    total = np.add.reduceat(forms.mix(sets + np.uint64(0x5851F42D4C957F2D)), offsets[:-1])
    return forms.mix(total ^ forms.mix(n)).view(np.int64)


def _bucket(sets: np.ndarray, bits: int) -> np.ndarray:
    return (forms.mix(sets) >> np.uint64(64 - bits)).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("text").to_pylist()


SKETCH_SCHEMA = "slice int, counts binary, fp long, id long, side byte, elements long, entries long"


def sketch_bits(df: DataFrame) -> int:
    """log2 of the sketch's buckets by the size that Spark estimates for the input, which runs nothing; the least where it has no estimate."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return SKETCH_BITS if size >= 1 << 60 else min(SKETCH_MOST, max(SKETCH_BITS, (size // 8).bit_length()))


def scan_sets(df: DataFrame, t: Fraction, shingle: int, least_words: int, bits: int = SKETCH_BITS) -> DataFrame:
    """One pass over `df(id, text, side)`: rows of members (fp, id, side), this task's counts by slice, and a row of its elements and prefix entries."""

    def run(it):
        counts = np.zeros(1 << bits, np.uint16)
        z = zstandard.ZstdCompressor(level=1)
        elements = entries = 0
        for batch in it:
            texts = _texts(batch)
            ids, sides = batch.column("id").to_numpy(zero_copy_only=False), batch.column("side").to_numpy(zero_copy_only=False)
            fps, who = [], []
            for ix, sets, off in text_sets(texts, shingle, least_words):
                b, n = np.unique(_bucket(sets, bits), return_counts=True)
                counts[b] = np.minimum(counts[b].astype(np.int64) + n, 65535)
                fps.append(fingerprints(sets, off))
                who.append(ix)
                elements += len(sets)
                entries += int(prefix_length(np.diff(off), t).sum())
            if fps:
                fp, ix = np.concatenate(fps), np.concatenate(who)
                yield _batch(len(fp), fp=fp, id=ids[ix], side=sides[ix])
        step = 1 << min(SLICE_BITS, bits)
        blobs = [(k, counts[k * step : (k + 1) * step]) for k in range(len(counts) // step)]
        blobs = [(k, z.compress(c.tobytes())) for k, c in blobs if c.any()]
        for at in range(0, len(blobs), 64):
            part = blobs[at : at + 64]
            yield _batch(len(part), slice=[k for k, _ in part], counts=[c for _, c in part])
        yield _batch(1, elements=[elements], entries=[entries])

    types = {"slice": pa.int32(), "counts": pa.binary(), "fp": pa.int64(), "id": pa.int64(), "side": pa.int8(), "elements": pa.int64(), "entries": pa.int64()}

    def _batch(n: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in types.items()], list(types))

    return df.select("id", "text", "side").mapInArrow(run, SKETCH_SCHEMA)


def sum_sketch(scanned: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """The counts of all tasks, summed by slice in parallel and coded in one byte a bucket (1 is exactly one;
    more is coded in steps of a quarter of a power of two)."""
    spark = scanned.sparkSession
    step = 1 << min(SLICE_BITS, bits)

    def run(it):
        sums: dict[int, np.ndarray] = {}
        d = zstandard.ZstdDecompressor()
        for batch in it:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                c = np.frombuffer(d.decompress(blob), np.uint16)
                if k in sums:
                    sums[k] += c
                else:
                    sums[k] = c.astype(np.uint64)
        for k, c in sums.items():
            code = np.where(c > 1, np.minimum(255, 2 + np.rint(4 * np.log2(np.maximum(c, 1))) - 4 + 1), c).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([code.tobytes()], pa.binary())], ["slice", "codes"])

    slices = scanned.where("slice is not null").select("slice", "counts").repartition(partitions(spark), "slice")
    out = np.zeros(1 << bits, np.uint8)
    for row in slices.mapInArrow(run, "slice int, codes binary").collect():  # 2^bits bytes in all
        out[row[0] * step : (row[0] + 1) * step] = np.frombuffer(row[1], np.uint8)
    return out


def count_of(code: np.ndarray) -> np.ndarray:
    """About the count that a sketch code stands for."""
    return np.where(code < 2, code, np.exp2((code.astype(float) + 1) / 4))


#: Bits of a token's hash that travel with an entry; its bucket stands for others.
TOKEN = np.uint64((1 << 48) - 1)


def _pack(tokens, fps, sizes, poss, sides, z) -> bytes:
    wide = bool(len(sizes)) and int(sizes.max()) > 65535
    kind = np.uint32 if wide else np.uint16
    parts = [np.array([len(tokens), wide], np.uint32), tokens.astype(np.uint32), (tokens >> np.uint64(32)).astype(np.uint16), fps, sizes.astype(kind), poss.astype(kind), sides.astype(np.uint8)]
    return z.compress(b"".join(np.ascontiguousarray(p).tobytes() for p in parts))


def _unpack(blob: bytes, d) -> tuple[np.ndarray, ...]:
    raw = d.decompress(blob)
    n, wide = np.frombuffer(raw, np.uint32, 2).tolist()
    kind, w = (np.uint32, 4) if wide else (np.uint16, 2)
    at = 8
    out = []
    for dt, width in ((np.uint32, 4), (np.uint16, 2), (np.int64, 8), (kind, w), (kind, w), (np.uint8, 1)):
        out.append(np.frombuffer(raw, dt, n, at))
        at += n * width
    return out[0] | out[1].astype(np.uint64) << np.uint64(32), out[2], out[3].astype(np.uint32), out[4].astype(np.uint32), out[5]


def postings(df: DataFrame, codes, t: Fraction, shingle: int, least_words: int, buckets: int, bits: int = SKETCH_BITS, hot: int = HOT, load: float = 0.0, index=None) -> DataFrame:
    """Packed prefix entries `(bucket, entries)` of `df(text, side)`; side 0 joins with itself, 1 only with 2.

    `load` is how much of a bucket's count is due to other sequences on average. With `index`, a broadcast filter of the other side's tokens, entries that
    it lacks are left out at once, as they meet nothing.
    """

    def run(it):
        z = zstandard.ZstdCompressor(level=1)
        code = codes.value
        seen: set[tuple[int, int]] = set()
        got, held = defaultdict(list), 0

        def flush():
            rows = [(b, _pack(*(np.concatenate(x) for x in zip(*v)), z)) for b, v in got.items()]
            got.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "entries"])

        for batch in it:
            texts = _texts(batch)
            sides = batch.column("side").to_numpy(zero_copy_only=False)
            for ix, sets, off in text_sets(texts, shingle, least_words):
                fps, n = fingerprints(sets, off), np.diff(off)
                side = sides[ix]
                doc = np.repeat(np.arange(len(n)), n)
                c = code[_bucket(sets, bits)]
                order = np.argsort((doc.astype(np.uint64) << np.uint64(50)) | (c.astype(np.uint64) << np.uint64(42)) | (sets >> np.uint64(10)), kind="stable")
                pos = np.arange(len(sets)) - np.repeat(off[:-1], n)
                new = np.fromiter(((k := (f, s)) not in seen and (seen.add(k) or True) for f, s in zip(fps.tolist(), side.tolist())), bool, len(fps))
                lengths = prefix_length(n, t)
                c, tok = c[order], sets[order]
                m = (pos < lengths[doc]) & (c > 1) & new[doc]
                tok, d, p, c = tok[m], doc[m], pos[m], c[m]
                if not len(tok):
                    continue
                h, s = forms.mix(tok * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), side[d]
                blocks = np.ceil((count_of(c) - load) / hot).astype(np.int64)
                if index is not None:
                    m = (blocks > 1) | index.value.has(h & TOKEN)
                    h, d, p, s, blocks = h[m], d[m], p[m], s[m], blocks[m]
                    if not len(h):
                        continue
                if (blocks > 1).any():
                    h, d, p, s = _split(h, d, p, s, blocks, fps)
                b = (h >> np.uint64(40)).astype(np.int64) % buckets
                o = np.argsort(b, kind="stable")
                h, d, p, s, b = h[o], d[o], p[o], s[o], b[o]
                cut = np.flatnonzero(np.diff(b)) + 1
                for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(b)]):
                    x = slice(lo, hi)
                    got[int(b[lo])].append((h[x] & TOKEN, fps[d[x]], n[d[x]], p[x], s[x]))
                held += len(b)
                if held > CHUNK // 2:
                    yield flush()
                    held = 0
        if got:
            yield flush()

    return df.select("text", "side").mapInArrow(run, "bucket int, entries binary")


def _split(h, d, p, s, blocks, fps):
    """Entries of hot sequences, once for each pair of blocks that their text's block takes part in.

    A pair (i, j) of blocks is a list of its own, whose entries are of side 1 (block i) or 2 (block j); i = j stays
    side 0. Where the sides are given already, side 1's blocks are paired with side 2's.
    """
    parts = [[h[blocks <= 1]], [d[blocks <= 1]], [p[blocks <= 1]], [s[blocks <= 1]]]
    for nb in np.unique(blocks[blocks > 1]).tolist():
        m = blocks == nb
        hh, dd, pp, ss = h[m], d[m], p[m], s[m]
        own = (forms.mix(fps[dd].view(np.uint64)) % np.uint64(nb)).astype(np.int64)
        for other in range(nb):
            given = ss > 0
            first = np.where(given & (ss == 2), other, np.where(given, own, np.minimum(own, other)))
            second = np.where(given & (ss == 2), own, np.where(given, other, np.maximum(own, other)))
            parts[0].append(forms.mix(hh + (first * nb + second + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            parts[1].append(dd)
            parts[2].append(pp)
            parts[3].append(np.where(given, ss, np.where(first == second, 0, np.where(own == first, 1, 2))).astype(ss.dtype))
    return [np.concatenate(x) for x in parts]


def block_pairs(token, fp, size, pos, side, t: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entry numbers that share a list and may reach `t` by size and position, skipping whole blocks.

    Input must be ordered by (token, size, pos). A block is the run of one token and size. For blocks of sizes
    s <= s2 the first `MATCHES` common entries have s - p - 1 + MATCHES >= needed(s + s2), likewise for s2: in either
    block these are the entries before one position, found by a binary search; none: the block is skipped.
    """
    if len(token) < 2:
        return
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (size[1:] != size[:-1])])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(token))
    bt, bs = token[start], size[start].astype(np.int64)
    key = (np.cumsum(new) - 1).astype(np.int64) << 32 | pos.astype(np.int64)
    # blocks of the same token from the own size up to size / t
    run = np.concatenate([[True], bt[1:] != bt[:-1]])
    rid = (np.cumsum(run) - 1).astype(np.int64) << 32
    last = np.searchsorted(rid | bs, rid | np.minimum(bs * t.denominator // t.numerator, (1 << 32) - 1), side="right")
    many = last - np.arange(len(bs))
    for lo, hi in _chunks(many, CHUNK):
        x = np.repeat(np.arange(lo, hi), many[lo:hi])
        y = x + np.arange(len(x)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
        need = needed(bs[x] + bs[y], t)
        nx = np.searchsorted(key, x << 32 | np.maximum(bs[x] - need + MATCHES, 0)) - start[x]
        ny = np.searchsorted(key, y << 32 | np.maximum(bs[y] - need + MATCHES, 0)) - start[y]
        ok = (nx > 0) & (ny > 0) & ((x != y) | (nx > 1))
        x, y, nx, ny = x[ok], y[ok], nx[ok], ny[ok]
        # rows: one for each entry of x's part; then its partners in y's part
        for lo2, hi2 in _chunks(nx * ny, CHUNK):
            bx, by, cx, cy = x[lo2:hi2], y[lo2:hi2], nx[lo2:hi2], ny[lo2:hi2]
            own = np.repeat(np.arange(len(bx)), cx)
            i = start[bx][own] + np.arange(len(own)) - np.repeat(np.cumsum(cx) - cx, cx)
            first = np.where(bx[own] == by[own], i + 1, start[by][own])
            n = np.maximum(start[by][own] + cy[own] - first, 0)
            for lo3, hi3 in _chunks(n, CHUNK):
                k = n[lo3:hi3]
                a = np.repeat(i[lo3:hi3], k)
                b = np.repeat(first[lo3:hi3], k) + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
                ok = (fp[a] != fp[b]) & (((side[a] == 0) & (side[b] == 0)) | (side[a] + side[b] == 3))
                if ok.any():
                    yield a[ok], b[ok]


def _chunks(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges whose `n` add up to about `most`; at least one item each."""
    total = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def candidates(posted: DataFrame, t: Fraction, buckets: int) -> DataFrame:
    """Pairs `(a, b)`, a < b, of fingerprints that share enough prefix entries within the size and position bounds, each once."""

    def run(it):
        d = zstandard.ZstdDecompressor()
        parts = [_unpack(blob, d) for batch in it for blob in batch.column("entries").to_pylist()]
        if not parts:
            return
        token, fp, size, pos, side = (np.concatenate(x) for x in zip(*parts))
        del parts
        o = np.argsort(token, kind="stable")
        s = token[o]
        alone = np.concatenate([[True], s[1:] != s[:-1]]) & np.concatenate([s[1:] != s[:-1], [True]])
        o = o[~alone]
        token, fp, size, pos, side = token[o], fp[o], size[o], pos[o], side[o]
        o = np.lexsort((side, fp, pos, size, token))
        token, fp, size, pos, side = token[o], fp[o], size[o], pos[o], side[o]
        if len(o):  # copies from other tasks
            keep = np.concatenate([[True], (token[1:] != token[:-1]) | (fp[1:] != fp[:-1]) | (side[1:] != side[:-1])])
            token, fp, size, pos, side = token[keep], fp[keep], size[keep], pos[keep], side[keep]
        held = None
        for a, b in block_pairs(token, fp, size, pos, side, t):
            x, y = fp[a], fp[b]
            must = np.minimum(needed(size[a].astype(np.int64) + size[b], t), MATCHES)
            pair = np.stack([np.minimum(x, y), np.maximum(x, y), must, np.ones(len(x), np.int64)], axis=1)
            held = _summed(pair if held is None else np.concatenate([held, pair]))
            if len(held) > CHUNK:
                yield _pairs(held)
                held = None
        if held is not None and len(held):
            yield _pairs(held)

    packed = posted.repartitionById(buckets, F.col("bucket"))
    counted = packed.select("entries").mapInArrow(run, "a long, b long, must long, n long")
    return counted.groupBy("a", "b").agg(F.max("must").alias("must"), F.sum("n").alias("n")).where("n >= must").select("a", "b")


def _summed(pairs: np.ndarray) -> np.ndarray:
    """Each pair once, its matches added up."""
    o = np.lexsort((pairs[:, 1], pairs[:, 0]))
    p = pairs[o]
    first = np.flatnonzero(np.concatenate([[True], (p[1:, :2] != p[:-1, :2]).any(axis=1)]))
    out = p[first]
    out[:, 3] = np.add.reduceat(p[:, 3], first)
    return out


def _pairs(p: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p[:, k]) for k in range(4)], ["a", "b", "must", "n"])


class BitFilter:
    """A filter that has every value put into it, and some others."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def has(self, values: np.ndarray) -> np.ndarray:
        k = filter_bit(values, self.bits)
        return ((self.data[k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1).astype(bool)


def filter_bit(values: np.ndarray, bits: int) -> np.ndarray:
    return (forms.mix(values.view(np.uint64) + np.uint64(7)) >> np.uint64(64 - bits)).astype(np.int64)


def bit_filter(df: DataFrame, values, count: int, most: int | None = None) -> BitFilter | None:
    """A filter of the numbers that `values(batch)` gives for the batches of `df`, built in parallel with `FILTER_LOAD` bits for each of
    `count` values; None where these would be more than 2^`most` bits in all."""
    bits = max(16, (FILTER_LOAD * max(count, 1) - 1).bit_length())
    if bits > (FILTER_MOST if most is None else most):
        return None
    spark = df.sparkSession
    step = (1 << bits) // 64

    def run(it):
        have = np.zeros(1 << bits, bool)
        for batch in it:
            have[filter_bit(values(batch), bits)] = True
        z = zstandard.ZstdCompressor(level=1)
        rows = [(k, z.compress(np.packbits(have[k * step : (k + 1) * step]).tobytes())) for k in range(64) if have[k * step : (k + 1) * step].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["k", "bits"])

    def join(it):
        d, sums = zstandard.ZstdDecompressor(), {}
        for batch in it:
            for k, blob in zip(batch.column("k").to_pylist(), batch.column("bits").to_pylist()):
                x = np.frombuffer(d.decompress(blob), np.uint8)
                sums[k] = sums[k] | x if k in sums else x
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["k", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    parts = df.mapInArrow(run, "k int, bits binary").repartition(min(64, partitions(spark)), "k").mapInArrow(join, "k int, bits binary")
    for k, blob in parts.collect():  # 2^bits bits in all
        out[k * step // 8 : (k + 1) * step // 8] = np.frombuffer(blob, np.uint8)
    return BitFilter(bits, out)


def only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `df(id, text, side)` whose id `ids(id)` has, and perhaps some others: by a broadcast filter, or by a join where that would be too large."""
    wanted = bit_filter(ids, lambda batch: batch.column(0).to_numpy(zero_copy_only=False), ids.count())
    if wanted is None:
        return df.join(ids.distinct(), "id", "left_semi")
    sent = df.sparkSession.sparkContext.broadcast(wanted)

    def run(it):
        for batch in it:
            yield batch.filter(pa.array(sent.value.has(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))

    return df.select("id", "text", "side").mapInArrow(run, "id long, text string, side byte")


def sets_of(df: DataFrame, shingle: int, least_words: int, wanted=None) -> DataFrame:
    """`(fp, elements)` of the texts of `df(id, text)`, with `wanted` of those whose id the broadcast filter has; once per task and fp."""

    def run(it):
        seen: set[int] = set()
        for batch in it:
            if wanted is not None:
                batch = batch.filter(pa.array(wanted.value.has(batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64))))
            rows = []
            for _, sets, off in text_sets(_texts(batch), shingle, least_words):
                for i, f in enumerate(fingerprints(sets, off).tolist()):
                    if f not in seen:
                        seen.add(f)
                        rows.append((f, sets[off[i] : off[i + 1]].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["fp", "elements"])

    return df.select("id", "text").mapInArrow(run, "fp long, elements binary")


def verify_group(pairs: list[tuple[int, int]], sets: dict[int, np.ndarray], t: Fraction) -> list[tuple[int, int, int]]:
    """The pairs whose sets reach `t`, with their overlap; overlaps are derived from those of a similar set where known."""
    lookup = functools.cache(lambda f: frozenset(sets[f].tolist()))
    partners = defaultdict(set)
    for a, b in pairs:
        partners[a].add(b)
        partners[b].add(a)
    base: dict[int, int] = {}
    known: dict[tuple[int, int], int] = {}
    out = []
    key = lambda x, y: (x, y) if x < y else (y, x)
    done: set[tuple[int, int]] = set()
    for lead in sorted(partners, key=lambda f: (-len(partners[f]), f)):
        own = lookup(lead)
        for other in sorted(partners[lead]):
            k = key(lead, other)
            if k in done:
                continue
            done.add(k)
            need = needed(len(own) + len(sets[other]), t)
            b, flip = base.get(lead), False
            if b is None or key(b, other) not in known:
                b, flip = base.get(other), True
            x, y = (other, lead) if flip else (lead, other)
            if b is not None and b != y and key(b, y) in known:
                # x is highly similar to b, and b's overlap with y is known: x = b - gone + come
                gone, come, was = len(lookup(b)) - known[key(b, x)], len(lookup(x)) - known[key(b, x)], known[key(b, y)]
                if was + come < need:
                    continue
                if come + gone < min(len(lookup(x)), len(lookup(y))):
                    theirs = lookup(y)
                    got = was - len((lookup(b) - lookup(x)) & theirs) + len((lookup(x) - lookup(b)) & theirs)
                else:
                    got = len(lookup(x) & lookup(y))
            else:
                got = len(own & lookup(other))
            known[k] = got
            if got >= need:
                out.append((*k, got))
                base.setdefault(other, lead)  # highly similar: lead's overlaps serve it
    return out


def verify(cand: DataFrame, sets: DataFrame, t: Fraction, group: int = GROUP) -> DataFrame:
    """`(a, b, overlap, size_a, size_b)` of the candidate pairs that reach `t`.

    Each text goes to the group of its least neighbour, so similar texts meet and their sets travel once; a group
    of more pairs than `group` is split by blocks of its texts.
    """
    spark = cand.sparkSession
    both = cand.select(F.col("a").alias("x"), F.col("b").alias("y")).union(cand.select("b", "a"))
    lead = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("lead"))
    homed = cand.join(lead, cand.a == lead.x).select("a", "b", F.col("lead").alias("home"))
    load = homed.groupBy("home").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.sqrt(F.col("n") / group)).cast("int")
    homed = homed.join(load, "home").select(
        "a", "b", "home", F.when(F.col("n") > group, F.pmod(F.xxhash64("a"), blocks) * 100_000 + F.pmod(F.xxhash64("b"), blocks)).otherwise(0).alias("block")
    )
    homed = materialize(homed, "homed")
    asked = homed.select("home", "block", F.col("a").alias("fp")).union(homed.select("home", "block", "b")).distinct()
    one = sets.groupBy("fp").agg(F.first("elements").alias("elements"))
    rows = asked.join(one, "fp").select("home", "block", "fp", F.lit(None).cast("long").alias("other"), "elements")
    rows = rows.unionByName(homed.select("home", "block", F.col("a").alias("fp"), F.col("b").alias("other"), F.lit(None).cast("binary").alias("elements")))
    rows = rows.repartition(partitions(spark), "home", "block").sortWithinPartitions("home", "block")

    def run(it):
        now, pairs, sets = None, [], {}
        found: list[tuple] = []

        def close():
            for a, b, got in verify_group(pairs, sets, t):
                found.append((a, b, got, len(sets[a]), len(sets[b])))

        def batch():
            cols = list(zip(*found)) or [[]] * 5
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "overlap", "size_a", "size_b"])

        for rb in it:
            for h, k, f, o, e in zip(*(rb.column(c).to_pylist() for c in ("home", "block", "fp", "other", "elements"))):
                if (h, k) != now:
                    close()
                    now, pairs, sets = (h, k), [], {}
                if e is None:
                    pairs.append((f, o))
                else:
                    sets[f] = np.frombuffer(e, np.uint64)
            if len(found) > 10_000:
                yield batch()
        close()
        yield batch()

    return rows.mapInArrow(run, "a long, b long, overlap long, size_a long, size_b long")


def _tokens(batch: pa.RecordBatch) -> np.ndarray:
    d = zstandard.ZstdDecompressor()
    parts = [_unpack(blob, d)[0] for blob in batch.column("entries").to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def similar_classes(df: DataFrame, t: Fraction, shingle: int, least_words: int, bits: int | None = None, hot: int = HOT, bucket_entries: int = BUCKET_ENTRIES, filter_most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The join over `df(id, text, side)`: members `(fp, id, side)` and the similar class pairs `(a, b, overlap, size_a, size_b)`.

    With sides 1 and 2, pairs are between them, unordered: the prefixes of side 2 are the index, and side 1 probes it, so that of its entries only those travel whose
    token the index has. Members of one class have equal sets. The number of buckets follows from the counted entries, so a task's memory does not grow with the input.
    """
    spark = df.sparkSession
    bits = sketch_bits(df) if bits is None else bits
    scanned = materialize(scan_sets(df, t, shingle, least_words, bits), "scan")
    codes = spark.sparkContext.broadcast(sum_sketch(scanned, bits))
    sums = scanned.where("entries is not null").agg(F.sum("elements").alias("elements"), F.sum("entries").alias("entries")).first()
    elements, entries = sums.elements or 0, sums.entries or 0
    buckets = max(partitions(spark), -(-entries // bucket_entries))
    members = scanned.where("fp is not null").select("fp", "id", "side").distinct()
    load = elements / (1 << bits)

    def post(part: DataFrame, index=None) -> DataFrame:
        return postings(part, codes, t, shingle, least_words, buckets, bits, hot, load, index)

    sides = dict(scanned.where("fp is not null").groupBy("side").agg(F.count("*")).collect())  # three rows at most
    if 2 not in sides:
        posted = post(df)
    elif 0 in sides:
        raise ValueError("rows of side 0 can't be joined together with sides 1 and 2")
    else:
        asked = materialize(post(df.where("side = 2")), "index")
        index = bit_filter(asked.select("entries"), _tokens, 2 * entries * sides[2] // sum(sides.values()), filter_most)
        posted = asked.union(post(df.where("side = 1"), None if index is None else spark.sparkContext.broadcast(index)))
    cand = materialize(candidates(posted, t, buckets), "candidates")
    named = cand.select(F.col("a").alias("fp")).union(cand.select("b")).distinct()
    ids = materialize(members.join(named, "fp", "left_semi").select("id"), "wanted")
    wanted = bit_filter(ids, lambda batch: batch.column(0).to_numpy(zero_copy_only=False), ids.count(), filter_most)
    texts = df if wanted is not None else df.join(ids.distinct(), "id", "left_semi")
    pairs = verify(cand, sets_of(texts, shingle, least_words, None if wanted is None else spark.sparkContext.broadcast(wanted)), t)
    return members, pairs
