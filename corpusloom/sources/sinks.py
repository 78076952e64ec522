"""Writers of record tables, reports and metric logs."""

from __future__ import annotations

import json
import math
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.tokens import BpeModel

from . import storage


def write_jsonl(df: DataFrame, out: str) -> None:
    """Records as lines of `{text, source, metadata}`; null metadata are left out. One file a task."""
    meta = [c for c in df.columns if c not in ("text", "source", "ord")]
    df.select(F.to_json(F.struct("text", "source", F.struct(*meta).alias("metadata"))).alias("value")).write.mode("overwrite").text(out)


def write_txt(df: DataFrame, out: str, text_col: str = "text") -> None:
    """Texts, each ended by one line end."""
    df.select(F.regexp_replace(text_col, r"\n+\z", "").alias("value")).write.mode("overwrite").text(out)


def first_column_text(df: DataFrame) -> DataFrame:
    """The first column as lines of text."""
    return df.select(F.coalesce(F.col(f"`{df.columns[0]}`").cast("string"), F.lit("")).alias("value"))


def write_first_column(df: DataFrame, out: str) -> None:
    """The first column of a table as lines of text, one file a task."""
    first_column_text(df).write.mode("overwrite").text(out)


def write_bpe(model: BpeModel, path: str) -> None:
    storage.write_bytes(path, model.to_json().encode())


def write_report(df: DataFrame, path: str) -> dict:
    """A one-row report as a JSON file on the driver."""
    row = df.first().asDict(recursive=True)
    storage.write_bytes(path, json.dumps(row, indent=2, ensure_ascii=False).encode())
    return row


def finite(value):
    """NaN and infinities become null, at any depth."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): finite(v) for k, v in value.items()}
    return [finite(v) for v in value] if isinstance(value, (list, tuple)) else value


class MetricLog:
    """An append-only JSON-lines log of metrics on a local disk; a reset keeps the old log beside it."""

    def __init__(self, path: str, reset: bool = False):
        self.path = path
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        if reset and os.path.exists(path) and os.path.getsize(path):
            os.replace(path, f"{path}.{time.time_ns()}.bak")

    def append(self, step: int, event: str = "train", **metrics) -> None:
        row = finite({"time": time.time(), "event": event, "step": step, **metrics})
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")

    def tail(self, limit: int = 1000) -> list[dict]:
        """The last `limit` readable rows."""
        rows = []
        with open(self.path, encoding="utf-8", errors="replace") as f:
            for line in f:
                try:
                    rows.append(finite(json.loads(line)))
                except ValueError:
                    continue
        return rows[-limit:]


def newest_checkpoints(folder: str, suffix: str = ".pt") -> list[str]:
    """Checkpoint files of a folder, the last name first."""
    names = os.listdir(folder) if os.path.isdir(folder) else []
    return [os.path.join(folder, n) for n in sorted(names, reverse=True) if n.endswith(suffix)]
