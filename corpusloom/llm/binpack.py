"""Filling fixed-capacity sequences with texts of varying length (problem 8).

Method: variable-capacity best-fit. Only lengths matter for the plan, so it is made from the
histogram of lengths, whose size is the largest permitted capacity and not the number of texts:
lengths in descending order go into the open bins that they fill best; where none fits, bins of the
permitted capacity of least cost per token are opened (judged by what the lengths still to come can
fill); finally each bin is given the least permitted capacity that holds its contents. Whole runs of
equal lengths and of equal bins are handled as one step.

Texts find their places in parallel: items are numbered within their length by two-level counting,
and a step of the plan maps a range of numbers to a range of bins.

Defined cases: texts of no tokens (null, empty) keep their row, without a sequence; a text longer than
the largest capacity is cut into full pieces and a rest, nothing else is cut; ties and repeated
texts are ordered by id; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize, partitions

from .encode import TOKENIZER_DIR, count_tokens

CAPACITIES = (256, 512, 1024, 2048)


def plan_bins(lengths: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit of a histogram `{length: items}`, no length above the largest capacity.

    A bin costs its capacity plus `overhead` tokens. Returns steps `(length, first item, end item, first bin, items a
    bin)` and runs of bins `(first bin, bins, capacity, used)`.
    """
    caps = sorted(capacities)
    left = defaultdict(int, {k: int(n) for k, n in lengths.items() if n > 0})
    order = sorted(left, reverse=True)
    open_: dict[int, list[tuple[int, int, int]]] = {}  # space left -> runs of bins (first bin, bins, capacity)
    spaces: list[int] = []  # sorted keys of open_
    steps, bins = [], 0

    def push(space: int, run: tuple[int, int, int]) -> None:
        if space not in open_:
            open_[space] = []
            bisect.insort(spaces, space)
        open_[space].append(run)

    def expected_use(space: int, below: int) -> int:
        """Tokens that the greedy filling of one bin's space takes from the lengths still to come."""
        used, most = 0, below
        for _ in range(8):
            i = bisect.bisect_right(ascending, min(space - used, most)) - 1
            if i < 0:
                break
            k = ascending[i]
            used += k * min(left[k], (space - used) // k)
            most = k - 1
        return used

    ascending = sorted(order)
    for length in order:
        n, item = left[length], 0
        while item < n:
            i = bisect.bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                first, many, cap = open_[space].pop()
                if not open_[space]:
                    del open_[space]
                    spaces.pop(i)
            else:
                space, first, many = 0, bins, 0
                best = None
                for cap in (c for c in caps if c >= length):
                    used = length + expected_use(cap - length, length)
                    cost = (cap + overhead) / used
                    if best is None or cost <= best[0]:
                        best = (cost, cap)
                space = cap = best[1]
                many = -(-(n - item) // (cap // length))
                bins += many
            per = space // length
            full, rest = divmod(n - item, per)
            take = min(many, full)
            if take:
                steps.append((length, item, item + take * per, first, per))
                item += take * per
                push(space - per * length, (first, take, cap))
            if take < many and item < n and rest and item + rest == n:
                steps.append((length, item, n, first + take, rest))
                item = n
                push(space - rest * length, (first + take, 1, cap))
                take += 1
            if take < many:
                push(space, (first + take, many - take, cap))
        left[length] = 0
    runs = []
    for space, held in open_.items():
        for first, many, cap in held:
            used = cap - space
            runs.append((first, many, next(c for c in caps if c >= used), used))
    runs.sort()
    return np.array(steps, np.int64).reshape(-1, 5), np.array(runs, np.int64).reshape(-1, 4)


def pack_items(items: DataFrame, id_col: str, tokens_col: str, capacities: tuple[int, ...] = CAPACITIES, overhead: float = 8.0) -> DataFrame:
    """`(id_col, piece, tokens, sequence, capacity, used)` of `items(id_col, tokens_col)`; ids should be unique."""
    spark = items.sparkSession
    most, buckets = max(capacities), partitions(spark) * 4
    kind = items.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.col(tokens_col), F.lit(0)).cast("long")
    whole = (size / most).cast("long")
    cut = items.select(F.col(id_col), size.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(whole - (size % most == 0).cast("long"), F.lit(0)))).alias("piece"))
    rows = cut.select(
        id_col, F.col("piece").cast("int").alias("piece"), F.least(F.col("n") - F.col("piece") * most, F.lit(most)).cast("int").alias("tokens"), F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int").alias("bucket")
    )
    rows = materialize(rows, "items")
    counts = rows.where("tokens > 0").groupBy("tokens", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("tokens", "bucket", (F.sum("n").over(Window.partitionBy("tokens").orderBy("bucket")) - F.col("n")).alias("offset"))
    histogram = {r[0]: r[1] for r in counts.groupBy("tokens").agg(F.sum("n")).collect()}  # at most `most` rows
    steps, runs = plan_bins(histogram, capacities, overhead)
    steps = steps[np.argsort(steps[:, 0] << 40 | steps[:, 1])]
    sent = spark.sparkContext.broadcast((steps, runs))  # a few steps for each length, at most `most` lengths
    own = Window.partitionBy("tokens", "bucket").orderBy(id_col, "piece")
    placed = (
        rows.where("tokens > 0")
        .withColumn("place", F.row_number().over(own) - 1)
        .join(before, ["tokens", "bucket"])
        .select(id_col, "piece", "tokens", (F.col("place") + F.col("offset")).cast("long").alias("item"))
    )

    def run(it):
        steps, runs = sent.value
        key = steps[:, 0] << 40 | steps[:, 1]
        for batch in it:
            tokens = batch.column("tokens").to_numpy(zero_copy_only=False).astype(np.int64)
            item = batch.column("item").to_numpy(zero_copy_only=False)
            s = steps[np.searchsorted(key, tokens << 40 | item, side="right") - 1]
            bin_ = s[:, 3] + (item - s[:, 1]) // s[:, 4]
            r = runs[np.searchsorted(runs[:, 0], bin_, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column("piece"), batch.column("tokens"), pa.array(bin_), pa.array(r[:, 2].astype(np.int32)), pa.array(r[:, 3].astype(np.int32))],
                [id_col, "piece", "tokens", "sequence", "capacity", "used"],
            )

    done = placed.mapInArrow(run, f"`{id_col}` {kind}, piece int, tokens int, sequence long, capacity int, used int")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("sequence", "long"), ("capacity", "int"), ("used", "int"))]
    return done.union(rows.where("tokens = 0").select(id_col, "piece", "tokens", *none))


def pack_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR
) -> DataFrame:
    """Sequences of the texts of `df`, measured in tokens of a public tokenizer."""
    return pack_items(count_tokens(df.select(id_col, text_col), text_col, tokenizer, directory), id_col, "tokens", capacities)
