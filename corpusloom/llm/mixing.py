"""Mixing sources to target weights (problem 2).

Method: each source's records, in a pseudorandom order, are packed into blocks of a fixed number of
tokens (a record belongs to the block in which it starts). A source's quota of tokens is its weight
of the mix's target, at most `max_repeats` times what it has. The slots of a source run through
its blocks once an epoch, each epoch in the order of its own pseudorandom permutation of the block
indices; slots and blocks meet by index. The last epoch ends in the middle of a block; a last slot is filled
with the records of the next blocks that meet the quota best. All slots of a mix are put into the places of the output by one more pseudorandom
permutation, and shards are stretches of places of equal length: so the counts of the sources in a shard are multinomial given the totals (shares hold
exactly over all shards and vary at random within each), at any size and without a draw on the driver.

Defined cases: a repeated row of the weights counts once; weights need not sum to 1; a null cap is no
cap; a zero or null weight and sources without records get a wanted share and no records; null
tokens are counted from the text; records of no tokens are never drawn; records delivered again
count once; where supply times cap is short, the report shows the shortfall and nothing is repeated
beyond the cap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

BLOCK = 2048
#: Blocks after the one in which a quota ends, of which records may fill it up.
NEAR = 8
SHARDS = 16
SEED = 1337
#: Stretches of a source's pseudorandom order whose totals are taken apart, so no task sorts a source.
STRETCHES = 1 << 16
#: Slots that one row is unfolded to at once.
UNFOLD = 1 << 12
#: Rows up to which a table made from the mix weights is broadcast; larger ones are joined as Spark sees fit.
CONFIGURED = 100_000


def configured(df: DataFrame) -> DataFrame:
    """A table made from the mix weights, broadcast where its counted rows are few."""
    return F.broadcast(df) if df.limit(CONFIGURED + 1).count() <= CONFIGURED else df


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..size-1 at `index`: a Feistel network over the next even power of two, walked until in range."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    x, out = index.astype(np.uint64), np.full(len(index), -1, np.int64)
    todo = np.arange(len(index))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> b, x & m
        for r in range(4):
            f = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        x = left << b | right
        ok = x < size[todo].astype(np.uint64)
        out[todo[ok]] = x[ok].astype(np.int64)
        todo, x = todo[~ok], x[~ok]
    return out


def permuted(index: Column, size: Column, key: Column) -> Column:
    """`permute` over columns."""

    @F.pandas_udf("long")
    def run(i, n, k):
        return pd.Series(permute(i.to_numpy(), n.to_numpy(), k.to_numpy()))

    return run(index, size, key)


def running_total(df: DataFrame, keys: list[str], rough: str, order: list[str], value: str, name: str) -> DataFrame:
    """`name`: the sum of `value` over earlier rows of the same `keys`, by `rough` and then `order`.

    Taken within (keys, rough) and over the totals of these, so no task sorts a whole group.
    """
    totals = df.groupBy(*keys, rough).agg(F.sum(value).alias("_total"))
    w = Window.partitionBy(*keys).orderBy(rough)
    start = totals.select(*keys, rough, (F.sum("_total").over(w) - F.col("_total")).alias("_start"))
    own = Window.partitionBy(*keys, rough).orderBy(*order)
    return df.withColumn("_own", F.sum(value).over(own) - F.col(value)).join(start, [*keys, rough]).withColumn(name, F.col("_own") + F.col("_start")).drop("_own", "_start")


def supply(records: DataFrame, split: str | None = "train") -> DataFrame:
    """`(source, record_id, tokens)` of the records that may be drawn, each once."""
    rows = records.where(F.col("split_name") == split) if split else records
    tokens = F.coalesce(F.col("tokens"), F.octet_length("text").cast("long"))
    return rows.select("source", "record_id", tokens.cast("long").alias("tokens")).where("tokens > 0").groupBy("record_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))


def quotas(weights: DataFrame, have: DataFrame) -> DataFrame:
    """Per mix and source: wanted tokens, tokens in store, tokens to draw, whole epochs, and the rest."""
    one = weights.groupBy("mix_id", "source").agg(
        F.max(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max("max_repeats").cast("long").alias("max_repeats"), F.max("target_tokens").alias("target_tokens")
    )
    total = F.sum("weight").over(Window.partitionBy("mix_id"))
    share = F.when(total > 0, F.col("weight") / total).otherwise(0.0)
    stock = have.groupBy("source").agg(F.sum("tokens").alias("stock"), F.count("*").alias("records"))
    q = one.withColumn("wanted_share", share).join(stock, "source", "left").fillna({"stock": 0, "records": 0})
    q = q.withColumn("wanted_tokens", F.round(F.col("wanted_share") * F.col("target_tokens")).cast("long"))
    limit = F.when(F.col("max_repeats").isNull(), F.col("wanted_tokens")).otherwise(F.col("max_repeats") * F.col("stock"))
    q = q.withColumn("quota", F.when(F.col("stock") > 0, F.least("wanted_tokens", limit)).otherwise(0).cast("long"))
    q = q.withColumn("epochs", F.when(F.col("stock") > 0, F.floor(F.col("quota") / F.col("stock"))).otherwise(0).cast("long"))
    return q.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("stock"))


def placed_blocks(records: DataFrame, weights: DataFrame, block: int, seed: int, split: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records `(source, record_id, tokens, block)`, numbered blocks `(source, block, block_tokens, at)`, and the quotas with each source's number of blocks."""
    have = materialize(supply(records, split).join(configured(weights.select("source").distinct()), "source"), "supply")
    rough = F.pmod(F.xxhash64("record_id", F.lit(seed)), F.lit(STRETCHES))
    ordered = running_total(
        have.withColumn("rough", rough).withColumn("fine", F.xxhash64("record_id", F.lit(seed + 1))), ["source"], "rough", ["fine", "record_id"], "tokens", "before"
    )
    placed = materialize(ordered.select("source", "record_id", "tokens", F.floor(F.col("before") / block).cast("long").alias("block")), "placed")
    blocks = placed.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    # a block is named by its place among the source's blocks, as a long record leaves numbers unused
    numbered = running_total(blocks.withColumn("one", F.lit(1)).withColumn("rough", F.floor(F.col("block") / 1024)), ["source"], "rough", ["block"], "one", "at")
    numbered = materialize(numbered.select("source", "block", "block_tokens", "at"), "blocks")
    size = numbered.groupBy("source").agg(F.count("*").alias("blocks"))
    q = quotas(weights, have).join(size, "source", "left").fillna({"blocks": 0})
    return placed, numbered, materialize(q, "quotas")


def unfold(rows: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row `n` times, numbered from 0 in `name`; unfolded in two steps, so no row becomes a long array."""
    last = F.floor((n - 1) / UNFOLD)
    part = rows.where(n > 0).withColumn("_n", n).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    own = F.sequence(F.col("_part") * UNFOLD, F.least((F.col("_part") + 1) * UNFOLD, F.col("_n")) - 1)
    return part.withColumn(name, F.explode(own)).drop("_n", "_part")


def slots(records: DataFrame, weights: DataFrame, block: int = BLOCK, seed: int = SEED, split: str | None = "train", shards: int = SHARDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(mix_id, source, slot, block, record_id, shard, place)` of the slots, the placed records, and the quotas.

    A slot takes a whole block (`record_id` null), but for a source's last, which takes single records of one or several blocks.
    """
    placed, numbered, q = placed_blocks(records, weights, block, seed, split)
    want = configured(q.where("quota > 0").select("mix_id", "source", "epochs", "rest", "blocks"))
    key = F.xxhash64("mix_id", "source", "epoch", F.lit(seed))
    # the last epoch: which of its slots are whole, by the running total in the order of the slots
    last = unfold(want.where("rest > 0"), F.col("blocks"), "turn").withColumn("epoch", F.col("epochs"))
    last = last.withColumn("at", permuted(F.col("turn"), F.col("blocks"), key)).join(numbered, ["source", "at"])
    last = running_total(last.withColumn("rough", F.floor(F.col("turn") / 1024)), ["mix_id", "source"], "rough", ["turn"], "block_tokens", "drawn")
    last = materialize(last.select("mix_id", "source", "epochs", "blocks", "turn", "block", "block_tokens", (F.col("rest") - F.col("drawn")).alias("open")), "last")
    is_whole = F.col("open") >= F.col("block_tokens")
    whole = last.where(is_whole).select("mix_id", "source", (F.col("epochs") * F.col("blocks") + F.col("turn")).alias("slot"), "block")
    cut = last.where(~is_whole & (F.col("open") > -NEAR * block))  # the block in which the quota ends, and the next few
    fitted = (
        placed.join(cut.select("mix_id", "source", "block", "open"), ["source", "block"])
        .select("mix_id", "source", "record_id", "tokens", "block", "open")
        .groupBy("mix_id", "source")
        .applyInPandas(_fit, "mix_id string, source string, record_id long, block long")
    )
    ends = last.groupBy("mix_id", "source").agg(F.coalesce(F.max(F.when(is_whole, F.col("turn") + 1)), F.lit(0)).alias("turns"))
    filling = fitted.join(configured(want.join(ends, ["mix_id", "source"]).select("mix_id", "source", (F.col("epochs") * F.col("blocks") + F.col("turns")).alias("slot"))), ["mix_id", "source"])
    # whole epochs
    turns = unfold(want, F.col("epochs") * F.col("blocks"), "slot").withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")))
    turns = turns.withColumn("at", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), key))
    full = turns.join(numbered.select("source", "at", "block"), ["source", "at"]).select("mix_id", "source", "slot", "block")
    none = F.lit(None).cast("long").alias("record_id")
    every = full.union(whole).select("mix_id", "source", "slot", "block", none).unionByName(filling.select("mix_id", "source", "slot", "block", "record_id"))
    every = materialize(every, "slots")
    # places: the slots of a mix, source by source, through one permutation
    count = every.groupBy("mix_id", "source").agg((F.max("slot") + 1).alias("own"))
    w = Window.partitionBy("mix_id")
    offsets = count.select("mix_id", "source", (F.sum("own").over(w.orderBy("source")) - F.col("own")).alias("offset"), F.sum("own").over(w).alias("all"))  # a row for each row of the weights
    laid = every.join(configured(offsets), ["mix_id", "source"])
    laid = laid.withColumn("place", permuted(F.col("offset") + F.col("slot"), F.col("all"), F.xxhash64("mix_id", F.lit(seed + 2))))
    shard = F.expr(f"(place * {int(shards)}) div all").cast("int")
    return laid.select("mix_id", "source", "slot", "block", "record_id", shard.alias("shard"), "place"), placed, q


def draw(records: DataFrame, weights: DataFrame, block: int = BLOCK, seed: int = SEED, split: str | None = "train") -> tuple[DataFrame, DataFrame]:
    """`(mix_id, source, record_id, block, repeats, tokens)` of the drawn records, and the quotas; the slots of `slots` joined to the records of their blocks."""
    laid, placed, q = slots(records, weights, block, seed, split)
    return drawn_records(laid, placed), q


def drawn_records(laid: DataFrame, placed: DataFrame) -> DataFrame:
    """How often each record is drawn by the slots."""
    whole = laid.where("record_id is null").groupBy("mix_id", "source", "block").agg(F.count("*").alias("n"))
    by_block = placed.join(whole, ["source", "block"]).select("mix_id", "source", "record_id", "block", "tokens", "n")
    single = laid.where("record_id is not null").select("mix_id", "source", "record_id").join(placed, ["source", "record_id"]).select("mix_id", "source", "record_id", "block", "tokens", F.lit(1).cast("long").alias("n"))
    return by_block.unionByName(single).groupBy("mix_id", "source", "record_id").agg(F.max("block").alias("block"), F.sum("n").alias("repeats"), F.max("tokens").alias("tokens"))


def _fit(block: pd.DataFrame) -> pd.DataFrame:
    """Of the block in which a quota ends and the next few, records that fill what is open: large ones first, then the one that misses least."""
    room, taken, rest = int(block["open"].max()), [], []
    for r in block.sort_values(["tokens", "record_id"], ascending=[False, True]).itertuples():
        if r.tokens <= room:
            taken.append(r.record_id)
            room -= r.tokens
        else:
            rest.append((r.tokens, r.record_id))
    if rest and min(rest)[0] - room < room:
        taken.append(min(rest)[1])
    return block[block["record_id"].isin(taken)][["mix_id", "source", "record_id", "block"]]


def shares(drawn: DataFrame, q: DataFrame) -> DataFrame:
    """Wanted and actual share and tokens of each mix and source."""
    got = drawn.groupBy("mix_id", "source").agg(
        F.sum(F.col("repeats") * F.col("tokens")).alias("actual_tokens"), F.count("*").alias("drawn_records"), F.max("repeats").alias("most_repeats")
    )
    out = q.select("mix_id", "source", "wanted_share", "wanted_tokens", "max_repeats", "stock").join(got, ["mix_id", "source"], "left")
    out = out.fillna({"actual_tokens": 0, "drawn_records": 0, "most_repeats": 0})
    total = F.sum("actual_tokens").over(Window.partitionBy("mix_id"))
    return out.withColumn("actual_share", F.when(total > 0, F.col("actual_tokens") / total).otherwise(0.0))


def shard_plan(laid: DataFrame) -> DataFrame:
    """`(mix_id, shard, source, slots)`: how many slots of each source each output shard takes."""
    return laid.groupBy("mix_id", "shard", "source").agg(F.countDistinct("slot").alias("slots"))
