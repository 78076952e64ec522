"""Closed-form arithmetic of training runs as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schedule:
    """A learning-rate schedule."""

    learning_rate: float = 3e-4
    min_learning_rate: float = 3e-5
    warmup_steps: int = 100
    max_steps: int = 1000


def learning_rate(step: Column, s: Schedule = Schedule(), kind: str = "cosine") -> Column:
    """The rate at a step: a linear warm-up, then a cosine or linear descent to the minimum, or constant."""
    progress = (step - s.warmup_steps) / max(1, s.max_steps - s.warmup_steps)
    span = s.learning_rate - s.min_learning_rate
    if kind == "cosine":
        main = s.min_learning_rate + 0.5 * (1.0 + F.cos(math.pi * F.least(F.lit(1.0), progress))) * span
    elif kind == "linear":
        main = s.min_learning_rate + F.greatest(F.lit(0.0), 1.0 - progress) * span
    elif kind == "constant":
        main = F.lit(s.learning_rate)
    else:
        raise ValueError(f"unknown schedule {kind!r}")
    return F.when(step < s.warmup_steps, s.learning_rate * (step + 1) / s.warmup_steps).otherwise(main) if s.warmup_steps > 0 else main


def model_profile(vocab: Column, width: Column, layers: Column, heads: Column, kv_heads: Column, ffn_mult: Column, seq_len: Column, batch: int = 1, tied: bool = True, width_bytes: int = 2, optimizer: float = 2.0) -> dict[str, Column]:
    """Parameters, operations a token and memory of a decoder, from its shape."""
    head = F.floor(width / heads)
    hidden = F.floor(width * ffn_mult)
    embed = vocab * width
    attention = layers * (2 * width * heads * head + 2 * width * kv_heads * head)
    params = embed + attention + layers * 3 * width * hidden + layers * 2 * width + width + (F.lit(0) if tied else embed)
    flops = layers * (4 * width * width + 2 * seq_len * width + 6 * width * hidden)
    mb = 1024.0 * 1024.0
    return {
        "parameters": params.cast("long"),
        "non_embedding_parameters": (params - embed).cast("long"),
        "forward_flops_per_token": flops.cast("long"),
        "train_flops_per_token": (flops * 3).cast("long"),
        "activation_memory_mb": batch * seq_len * layers * width * width_bytes / mb,
        "kv_cache_memory_mb": batch * seq_len * layers * 2 * kv_heads * head * width_bytes / mb,
        "optimizer_state_memory_mb": params * width_bytes * optimizer / mb,
    }


def scaled_position(pos: Column, seq_len: int, kind: str | None = None, factor: float = 1.0, original: int | None = None) -> Column:
    """Rotary positions under linear, dynamic or ramped scaling."""
    p = pos.cast("double")
    first = float(original if original is not None else seq_len)
    if not kind or factor <= 1.0:
        return p
    if kind == "linear":
        return p / factor
    if kind == "dynamic":
        return p if seq_len <= first else p * (first - 1) / max(seq_len - 1, 1)
    if kind == "yarn":
        ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (p - first) / max(first * (factor - 1.0), 1.0)))
        return p / (1.0 + ramp * (factor - 1.0))
    raise ValueError(f"unknown scaling {kind!r}")


def yarn_theta(base: float, factor: float, head_dim: int) -> float:
    return base * factor ** (head_dim / max(head_dim - 2, 1))


def alibi_slope(head: Column, heads: int) -> Column:
    """The slope of a head (from 0): a geometric series, filled up from the series of twice the length for other head counts."""
    whole = 2 ** math.floor(math.log2(heads))
    base = 2.0 ** -(2.0 ** -(math.log2(whole) - 3))
    more = 2.0 ** -(2.0 ** -(math.log2(2 * whole) - 3))
    return F.when(head < whole, F.pow(F.lit(base), head + 1)).otherwise(F.pow(F.lit(more), 2 * (head - whole) + 1))


def quantize_int8(values: Column) -> tuple[Column, Column]:
    """A vector as whole numbers from -128 to 127 and the scale that restores it; halves are rounded to even."""
    scale = F.greatest(F.array_max(F.transform(values, lambda x: F.abs(x.cast("double")))), F.lit(1e-8)) / 127.0
    return F.transform(values, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.rint(x.cast("double") / scale).cast("int")))), scale
