"""Text out of rows of any shape.

Key names are case-sensitive; null cells give empty text; numeric cells are never chosen by score. Rules
are compiled once from the schema into one expression, so only the needed columns are read.
"""

from __future__ import annotations

import ast
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of columns that usually hold text.
TEXT_HINTS = ("text", "content", "body", "prompt", "completion", "response", "answer", "instruction", "input", "output", "code", "story", "messages", "conversations")
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)
# Suffixes that make a record's mode `code`.
MODE_CODE_SUFFIXES = (".py", ".js", ".ts", ".tsx", ".jsx", ".rs", ".c", ".cpp", ".h", ".hpp", ".go", ".java")
ROLES = ("system", "user", "assistant", "tool")


def _plain(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    return json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, (dict, list)) else str(value)


def coerce(df: DataFrame, name: str) -> Column:
    """A cell as text: null is empty, nested values are JSON with blanks after separators, the rest as Python prints it."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        out = c
    elif isinstance(kind, T.BooleanType):
        out = F.when(c, "True").otherwise("False")
        out = F.when(c.isNotNull(), out)
    elif isinstance(kind, T.BinaryType):
        out = F.make_valid_utf8(c.cast("string"))
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        out = _json_cell(F.to_json(c))
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


@F.arrow_udf(T.StringType())
def _json_cell(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else json.dumps(json.loads(v), ensure_ascii=False) for v in values.to_pylist()], pa.string())


def _messages(value: object) -> list | None:
    if isinstance(value, str):
        for parse in (json.loads, ast.literal_eval):
            try:
                value = parse(value)
                break
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue
        else:
            return None
    if isinstance(value, dict):
        value = value.get("messages") or value.get("conversations") or [value]
    return value if isinstance(value, list) else None


def render_messages(value: object) -> str:
    """A conversation as `<|role|>` lines and contents; strings may hold JSON or a Python literal, else they are kept as they are."""
    found = _messages(value)
    if found is None:
        return _plain(value)
    lines = []
    for m in found:
        if isinstance(m, dict):
            role = str(m.get("role") or m.get("from") or "user")
            role = {"human": "user", "gpt": "assistant"}.get(role, role)
            content = m["content"] if m.get("content") is not None else m.get("value")
            lines.append(f"<|{role}|>\n{_plain(content)}")
    return "\n".join(lines)


@F.arrow_udf(T.StringType())
def _render(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else render_messages(v) for v in values.to_pylist()], pa.string())


def chat_text(df: DataFrame, name: str) -> Column:
    """A column of messages rendered as chat text: strings by parsing, arrays of structs by array functions."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)):
        return _render(c if isinstance(kind, T.StringType) else F.to_json(c))
    have = kind.elementType.names

    def line(m: Column) -> Column:
        role = F.coalesce(*[F.when(m[k] != "", m[k]) for k in ("role", "from") if k in have], F.lit("user"))
        role = F.when(role == "human", "user").when(role == "gpt", "assistant").otherwise(role)
        content = F.coalesce(*[m[k].cast("string") for k in ("content", "value") if k in have], F.lit(""))
        return F.concat(F.lit("<|"), role, F.lit("|>\n"), content)

    return F.array_join(F.transform(F.filter(c, lambda m: m.isNotNull()), line), "\n")


def render_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`(conv, text)`: conversations kept as one row a turn, rendered in the order of turns. Turns sent twice count once."""
    name = F.lower(F.trim(F.coalesce(F.col(role), F.lit("user"))))
    name = F.when(name == "human", "user").when(name.isin("gpt", "bot"), "assistant").when(name == "", "user").otherwise(name)
    one = df.groupBy(conv, turn).agg(F.min(F.struct(name.alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"))).alias("m"))
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("n"), F.col("m.r").alias("r"), F.col("m.t").alias("t"))))
    line = lambda x: F.concat(F.lit("<|"), x["r"], F.lit("|>\n"), x["t"])
    return one.groupBy(conv).agg(turns.alias("turns")).select(conv, F.array_join(F.transform("turns", line), "\n").alias("text"))


def instruct_text(instruction: Column, input_: Column | None, answer: Column) -> Column:
    """The two-role template: filled instruction and input, then the answer if there is one."""
    filled = lambda c: F.when(F.length(c) > 0, c)
    prompt = F.concat_ws("\n", filled(instruction), *([filled(input_)] if input_ is not None else []))
    return F.when(F.length(answer) > 0, F.concat(F.lit("<|user|>\n"), prompt, F.lit("\n<|assistant|>\n"), answer)).otherwise(prompt)


def best_text_key(df: DataFrame, text_key: str = "text") -> Column:
    """Name of the column that most looks like text: length up to 4096 plus bonuses for exact and hinted names; the larger name on ties."""
    scored = []
    for f in df.schema:
        if isinstance(f.dataType, NUMERIC):
            continue
        value = coerce(df, f.name)
        low = f.name.lower()
        bonus = (100_000 if low == text_key.lower() else 0) + (50_000 if low in TEXT_HINTS else 0) + (10_000 if any(h in low for h in TEXT_HINTS) else 0)
        filled = F.col(f"`{f.name}`").isNotNull() & (F.length(F.trim(value)) > 0)
        scored.append(F.when(filled, F.struct((F.least(F.length(value), F.lit(4096)) + bonus).alias("score"), F.lit(f.name).alias("key"))))
    if not scored:
        return F.lit(None).cast("string")
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["key"]


def select_text_columns(names: list[str], text_key: str = "text", configured: tuple[str, ...] = ()) -> list[str]:
    """Columns to read: configured ones, else the key, else up to four hinted names, else up to four that contain a hint."""
    own = [c for c in configured if c in names]
    if own or text_key in names:
        return own or [text_key]
    exact = [c for c in names if c.lower() in TEXT_HINTS][:4]
    return exact or [c for c in names if any(h in c.lower() for h in TEXT_HINTS)][:4]


def extract_text(df: DataFrame, text_key: str = "text", text_columns: tuple[str, ...] = ()) -> Column:
    """The text of a row by the first rule that applies: configured columns, the key, messages, instruction, prompt, best column."""
    names = df.columns
    chats = ("messages", "conversations")
    cell = lambda c: chat_text(df, c) if c in chats else coerce(df, c)
    rules: list[tuple[Column, Column]] = []
    own = [c for c in text_columns if c in names]
    if own:
        parts = [F.when(F.length(F.trim(cell(c))) > 0, cell(c)) for c in own]
        any_ = F.coalesce(*parts).isNotNull()
        rules.append((any_, F.concat_ws("\n", *parts)))
    if text_key in names:
        rules.append((F.lit(True), F.coalesce(cell(text_key), F.lit(""))))
    for c in chats:
        if c in names:
            rules.append((F.col(c).isNotNull(), cell(c)))
    if "instruction" in names and {"input", "output", "response"} & {*names}:
        answer = coerce(df, "output") if "output" in names else coerce(df, "response") if "response" in names else F.lit("")
        rules.append((F.lit(True), instruct_text(coerce(df, "instruction"), coerce(df, "input") if "input" in names else None, answer)))
    if "prompt" in names and {"completion", "response"} & {*names}:
        second = "completion" if "completion" in names else "response"
        filled = [F.when(F.length(coerce(df, c)) > 0, coerce(df, c)) for c in ("prompt", second)]
        rules.append((F.lit(True), F.concat_ws("\n", *filled)))
    if not rules:
        best = best_text_key(df, text_key)
        pick = None
        for c in names:
            pick = F.when(best == c, coerce(df, c)) if pick is None else pick.when(best == c, coerce(df, c))
        return F.coalesce(pick, F.lit("")) if pick is not None else F.lit("")
    out = F.when(*rules[0])
    for when, then in rules[1:]:
        out = out.when(when, then)
    return F.coalesce(out, F.lit(""))


def row_mode(names: list[str]) -> str:
    """The mode of a row by its keys."""
    have = {n.lower() for n in names}
    if have & {"messages", "conversations"}:
        return "chat"
    if "instruction" in have and have & {"output", "response", "answer"}:
        return "instruct"
    if "prompt" in have and have & {"completion", "response", "answer"}:
        return "completion"
    return "code" if "code" in have else "generative"


def corpus_mode(fields: set[str]) -> str:
    """The mode of a corpus by the field names met in it; it knows no completion."""
    have = {n.lower() for n in fields}
    if have & {"messages", "conversations"}:
        return "chat"
    if "instruction" in have and have & {"output", "response", "answer"}:
        return "instruct"
    return "code" if "code" in have else "generative"


def record_mode(mode: Column, hint: Column, text: Column, suffix: Column) -> Column:
    """Explicit mode, else the record's hint, else chat by its markers, code by its suffix, else generative."""
    norm = lambda c: F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))
    return (
        F.when(mode.isNotNull() & ~norm(mode).isin("", "auto"), norm(mode))
        .when(hint.isNotNull() & ~norm(hint).isin("", "auto"), norm(hint))
        .when(text.contains("<|user|>") & text.contains("<|assistant|>"), "chat")
        .when(F.lower(suffix).isin(*MODE_CODE_SUFFIXES), "code")
        .otherwise("generative")
    )


def loss_masking(policy: Column, mode: Column) -> Column:
    """Explicit policy, else the one of the mode."""
    norm = F.replace(F.lower(F.trim(policy)), F.lit("-"), F.lit("_"))
    return (
        F.when(policy.isNotNull() & ~norm.isin("", "auto"), norm)
        .when(mode.isin("chat", "instruct", "reasoning", "roleplay"), "assistant_only")
        .when(mode == "completion", "completion_only")
        .otherwise("none")
    )


def chat_export(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`(conv, text)`: conversations as training script: known roles, others as user, empty contents left out, an end mark after each."""
    kept = turns.where(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0)
    known = F.lower(F.trim(F.col(role)))
    known = F.when(known == "human", "user").when(known.isin("gpt", "bot"), "assistant").otherwise(known)
    named = kept.withColumn(role, F.when(known.isin(*ROLES), known).otherwise("user")).withColumn(text, F.trim(text))
    out = render_turns(named, conv, turn, role, text)
    return out.select(conv, F.concat("text", F.lit("\n<|endoftext|>\n\n")).alias("text"))


def text_of_row(row: object, text_key: str = "text", text_columns: tuple[str, ...] = ()) -> str | None:
    """As `extract_text`, for one row of a source whose rows have no common schema. None where no rule applies."""
    if isinstance(row, str):
        return row
    if not isinstance(row, dict):
        return _plain(row)
    cell = lambda k: render_messages(row[k]) if k in ("messages", "conversations") else _plain(row[k])
    own = [c for c in text_columns if row.get(c) is not None]
    if parts := [t for t in map(cell, own) if t.strip()]:
        return "\n".join(parts)
    if text_key in row:
        return cell(text_key) if row[text_key] is not None else ""
    for name in ("messages", "conversations"):
        if name in row:
            return cell(name)
    if "instruction" in row and row.keys() & {"input", "output", "response"}:
        prompt = "\n".join(_plain(row[k]) for k in ("instruction", "input") if row.get(k))
        answer = _plain(row["output"] if "output" in row else row.get("response"))
        return f"<|user|>\n{prompt}\n<|assistant|>\n{answer}" if answer else prompt
    if "prompt" in row and row.keys() & {"completion", "response"}:
        return "\n".join(_plain(v) for v in (row["prompt"], row.get("completion", row.get("response"))) if v)
    scored = []
    for key, value in row.items():
        if value is None or isinstance(value, (bool, int, float)):
            continue
        text, low = _plain(value), key.lower()
        if text.strip():
            bonus = 100_000 * (low == text_key.lower()) + 50_000 * (low in TEXT_HINTS) + 10_000 * any(h in low for h in TEXT_HINTS)
            scored.append((min(len(text), 4096) + bonus, key))
    return _plain(row[max(scored)[1]]) if scored else None
