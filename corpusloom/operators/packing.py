"""Splitting and packing of training sequences, their statistics, and packed shards on disk."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize
from corpusloom.sources import storage

from .masking import CHAT_MODES, IGNORE

SHARD_TOKENS = 50_000_000


def boundary_packing(mode: str, masking: str) -> bool:
    """Whether sequences are packed along role boundaries."""
    mode, masking = (x.strip().lower().replace("-", "_") for x in (mode, masking))
    return mode == "auto" or mode in CHAT_MODES or masking in ("assistant_only", "completion_only")


def writes_labels(mode: str, masking: str) -> bool:
    """Whether a label file goes with the shards."""
    return masking != "none" or mode not in ("generative", "code", "creative")


def split_share(*keys: Column | str, seed: int = 1337) -> Column:
    """A number in [0, 1) fixed by the keys and the seed, whatever the partitioning."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    text = F.concat_ws(":", F.lit(str(seed)), *parts)
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(10_000)) / 10_000


def split(df: DataFrame, keys: list[str], val_fraction: float = 0.01, seed: int = 1337) -> DataFrame:
    """`df` with `split`: val where the row's share is under `val_fraction`. Give a document's key alone to keep it in one split."""
    return df.withColumn("split", F.when(split_share(*keys, seed=seed) < val_fraction, "val").otherwise("train"))


def guarantee_splits(df: DataFrame, order: list[str]) -> DataFrame:
    """Where a split is empty, the first row by `order` is put into it as well."""
    have = {r[0] for r in df.select("split").distinct().collect()}  # at most two values
    if not have or len(have) == 2:
        return df
    missing = ({"train", "val"} - have).pop()
    return df.unionByName(df.orderBy(*order).limit(1).withColumn("split", F.lit(missing)))


def label_counts(seqs: DataFrame) -> DataFrame:
    """`seqs` with the numbers of labelled and of ignored positions of each sequence."""
    masked = F.size(F.filter("labels", lambda x: x == IGNORE))
    return seqs.withColumn("masked", masked).withColumn("unmasked", F.size("labels") - masked)


def packing_stats(seqs: DataFrame) -> DataFrame:
    """One row: sequences, tokens by split, label totals, and sequences without, with only, and with some ignored labels."""
    c = label_counts(seqs)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    tokens = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.size("input_ids"))), F.lit(0)).cast("long")
    return c.agg(
        F.count("*").alias("sequences"),
        tokens("train").alias("train_tokens"),
        tokens("val").alias("val_tokens"),
        F.coalesce(F.sum("masked"), F.lit(0)).cast("long").alias("masked_labels"),
        F.coalesce(F.sum("unmasked"), F.lit(0)).cast("long").alias("unmasked_labels"),
        n(F.col("unmasked") == 0).alias("all_masked"),
        n(F.col("masked") == 0).alias("all_unmasked"),
        n((F.col("masked") > 0) & (F.col("unmasked") > 0)).alias("mixed"),
    )


def mask_health(seqs: DataFrame) -> DataFrame:
    """One row: share of labelled positions in percent, sequences without any, and a verdict (fail at none, warn under 5)."""
    c = label_counts(seqs)
    rate = F.sum("unmasked") * 100.0 / F.greatest(F.sum(F.col("masked") + F.col("unmasked")), F.lit(1))
    rows = c.agg(F.coalesce(rate, F.lit(0.0)).alias("unmasked_percent"), F.coalesce(F.sum((F.col("unmasked") == 0).cast("long")), F.lit(0)).alias("all_masked"))
    return rows.withColumn("verdict", F.when(F.col("unmasked_percent") == 0, "fail").when(F.col("unmasked_percent") < 5, "warn").otherwise("ok"))


@dataclass(frozen=True)
class ShardLayout:
    """Element types and names of packed shards."""

    vocab_size: int
    shard_tokens: int = SHARD_TOKENS

    @property
    def dtype(self) -> str:
        return "uint16" if self.vocab_size <= 65535 else "uint32"

    @staticmethod
    def name(prefix: str, number: int) -> str:
        return f"{prefix}.bin" if number == 0 else f"{prefix}.{number:05d}.bin"


def write_shards(seqs: DataFrame, out: str, layout: ShardLayout, order: list[str], seq_len: int, labels: bool = True, fixed: bool = True, stats: dict | None = None) -> dict:
    """Write the sequences of each split, in `order`, as flat binary shards with manifests, and return the summary.

    Rows are ranged by `order` into as many partitions as there are shards to fill; each task streams its own files, of `shard_tokens` tokens at most, to `out`, which
    may be on any storage. The files of a split, one after the other as the manifest names them, hold its tokens in order. A repeated task writes the same
    files again; manifests come last.
    """
    storage.make_dir(out)
    per = layout.shard_tokens
    summary: dict = {"dtype": layout.dtype, "seq_len": seq_len, "splits": {}}
    for name in ("train", "val"):
        part = seqs.where(F.col("split") == name).select(*order, "input_ids", *(["labels"] if labels else []))
        tokens = part.agg(F.coalesce(F.sum(F.size("input_ids")), F.lit(0))).first()[0]
        laid = part.repartitionByRange(max(1, -(-tokens // per)), *order).sortWithinPartitions(*order)
        laid = materialize(laid.withColumn("_part", F.spark_partition_id()), "shards")
        sizes = dict(laid.groupBy("_part").agg(F.sum(F.size("input_ids"))).collect())  # one row a shard or so
        first, numbers, counts = {}, 0, []
        for p in sorted(sizes):
            first[p] = numbers
            counts += [min(per, sizes[p] - at) for at in range(0, max(sizes[p], 1), per)]
            numbers = len(counts)
        kinds = [("", "input_ids", layout.dtype)] + ([(".labels", "labels", "int32")] if labels else [])
        if not counts:
            counts = [0]
            for suffix, _, _ in kinds:
                storage.write_bytes(storage.join(out, layout.name(name + suffix, 0)), b"")

        def write(it, name=name, first=first, kinds=kinds):
            files, at, part = {}, 0, None

            def close():
                for f in files.values():
                    f.close()
                files.clear()

            for batch in it:
                for p, rows in _runs(batch):
                    if p != part:
                        close()
                        part, at = p, 0
                    columns = {column: rows.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind) for _, column, kind in kinds}
                    total, done = len(columns["input_ids"]), 0
                    while done < total:
                        k, inner = divmod(at, per)
                        if inner == 0:
                            close()
                            files.update({s: storage.writer(storage.join(out, layout.name(name + s, first[part] + k))) for s, _, _ in kinds})
                        n = min(total - done, per - inner)
                        for s, column, _ in kinds:
                            files[s].write(columns[column][done : done + n].tobytes())
                        done += n
                        at += n
            close()
            yield from ()

        # the rows of a part lie in one file of the table; a task gets whole parts in order
        laid.repartitionByRange(max(1, len(first)), "_part").sortWithinPartitions("_part", *order).mapInArrow(write, "done int").collect()
        for suffix, _, kind in kinds:
            files = [layout.name(name + suffix, k) for k in range(len(counts))]
            meta = {"dtype": kind, "tokens": sum(counts), "files": files, "file_tokens": counts, "fixed_sequences": fixed, "sequence_length": seq_len if fixed else 0, "labels_are_shifted": fixed}
            _dump(storage.join(out, f"{name}{suffix}.manifest.json"), meta)
            _dump(storage.join(out, f"{name}{suffix}.meta"), {"dtype": kind, "tokens": sum(counts)})
        summary["splits"][name] = {"tokens": sum(counts)}
    _dump(storage.join(out, "packing.manifest.json"), summary | {"stats": stats or {}})
    return summary


def _runs(batch: pa.RecordBatch):
    """The stretches of a batch with one number in `_part`."""
    parts = batch.column("_part").to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield int(parts[lo]), pa.Table.from_batches([batch.slice(lo, hi - lo)])


def _dump(path: str, data: dict) -> None:
    storage.write_bytes(path, json.dumps(data, indent=2, sort_keys=True).encode())


def read_shards(spark: SparkSession, out: str, prefix: str = "train", seq_len: int | None = None, chunk: int = 1024) -> DataFrame:
    """`(seq_no, input_ids, labels)` of packed shards; sequences are read in parallel, `chunk` of them by one read of each file.

    A stored sequence length that differs from `seq_len` is an error; a rest shorter than a sequence is left out; labels
    are null where there are none or their number differs.
    """
    meta = _load(storage.join(out, f"{prefix}.manifest.json")) or _load(storage.join(out, f"{prefix}.meta")) or {"dtype": "uint16"}
    files = meta.get("files") or [f"{prefix}.bin"]
    stored = meta.get("sequence_length") or 0
    if stored and seq_len and stored != seq_len:
        raise ValueError(f"shards hold sequences of {stored} tokens, not {seq_len}")
    n = stored or seq_len or 512
    kind = np.dtype(meta["dtype"])
    ends = np.cumsum([storage.info(storage.join(out, f)).size // kind.itemsize for f in files])
    total = int(ends[-1]) // n
    side = _load(storage.join(out, f"{prefix}.labels.manifest.json"))
    paired = bool(side) and side["tokens"] == int(ends[-1])

    def span(names: list[str], dtype: np.dtype, lo: int, hi: int) -> np.ndarray:
        parts = []
        while lo < hi:
            k = int(np.searchsorted(ends, lo, side="right"))
            start, stop = int(ends[k - 1]) if k else 0, min(hi, int(ends[k]))
            parts.append(np.frombuffer(storage.read_bytes(storage.join(out, names[k]), (lo - start) * dtype.itemsize, (stop - lo) * dtype.itemsize), dtype))
            lo = stop
        return np.concatenate(parts).astype(np.int32)

    def run(it):
        for batch in it:
            for c in batch.column(0).to_pylist():
                lo, hi = c * chunk, min(total, (c + 1) * chunk)
                offsets = pa.array(np.arange(0, (hi - lo) * n + 1, n, dtype=np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(span(files, kind, lo * n, hi * n)))
                labels = pa.ListArray.from_arrays(offsets, pa.array(span(side["files"], np.dtype("int32"), lo * n, hi * n))) if paired else pa.nulls(hi - lo, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), ids, labels], ["seq_no", "input_ids", "labels"])

    return spark.range(-(-total // chunk)).mapInArrow(run, "seq_no long, input_ids array<int>, labels array<int>")


def _load(path: str) -> dict | None:
    return json.loads(storage.read_bytes(path)) if storage.exists(path) else None


def sample_batch(seqs: DataFrame, size: int, seed: int = 0, order: str = "seq_no") -> DataFrame:
    """`size` sequences drawn with replacement: draw numbers are hashed to places, places are joined to sequences.

    Places are numbered in two levels, within ranges of `order` and over the ranges' counts; the counts of ranges are summed in ranges again, so no task sees all of them.
    """
    n = seqs.count()
    draws = seqs.sparkSession.range(size).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))).alias("_place"))
    rough = seqs.withColumn("_b", F.floor(F.col(order) / 4096)).withColumn("_a", F.floor(F.col("_b") / 4096))
    counts = rough.groupBy("_a", "_b").agg(F.count("*").alias("_n"))
    high = counts.groupBy("_a").agg(F.sum("_n").alias("_m")).withColumn("_one", F.lit(1))
    over = Window.partitionBy("_one").orderBy("_a")  # a row for every 16 million sequences
    high = high.select("_a", (F.sum("_m").over(over) - F.col("_m")).alias("_base"))
    before = counts.select("_a", "_b", (F.sum("_n").over(Window.partitionBy("_a").orderBy("_b")) - F.col("_n")).alias("_start"))
    placed = rough.withColumn("_i", F.row_number().over(Window.partitionBy("_a", "_b").orderBy(order)) - 1).join(before, ["_a", "_b"]).join(high, "_a")
    placed = placed.withColumn("_place", F.col("_i") + F.col("_start") + F.col("_base"))
    return draws.join(placed, "_place").drop("_a", "_b", "_i", "_start", "_base", "_place")
