"""Command line: `python -m corpusloom.cli COMMAND ...`.

Inputs are named without an option or with `--input`; options of several spellings mean the same.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import functions as F

from corpusloom import prepare as P
from corpusloom.functions import schedules
from corpusloom.operators import bpe, clean, extract, metrics_log, stats, tokens
from corpusloom.session import build_session, release
from corpusloom.sources import readers, sinks, storage

#: Options by command: (spellings, settings of argparse).
READING = [
    (("inputs",), {"nargs": "*", "default": []}), (("--input",), {"nargs": "+", "action": "extend", "default": [], "dest": "more"}), (("--text-key", "--jsonl-text-key"), {"default": "text"}),
    (("--text-columns",), {"nargs": "*", "action": "extend", "default": []}), (("--text-column",), {"action": "append", "dest": "text_columns"}), (("--code-only",), {"action": "store_true"}),
    (("--max-records",), {"type": int}), (("--no-progress", "--jsonl"), {"action": "store_true", "help": "accepted, without effect"}),
    (("--tokenizer-batch-size", "--batch-size"), {"type": int, "help": "accepted, without effect: Arrow batches are the session's"}),
]
CLEANING = [
    (("--min-chars",), {"type": int, "default": clean.CleaningConfig().min_chars}), (("--max-chars",), {"type": int}), (("--no-normalize-unicode",), {"action": "store_true"}),
    (("--collapse-whitespace",), {"action": "store_true"}), (("--no-deduplicate",), {"action": "store_true"}), (("--near-deduplicate",), {"action": "store_true"}), (("--lang-filter", "--language"), {"dest": "lang_filter"}),
]
OUT = [(("--out",), {"required": True})]
LIMIT = [(("--limit", "--inspect-limit"), {"type": int, "default": 1000})]
TOKENIZER = [(("--tokenizer", "--tokenizer-path"), {"dest": "tokenizer"}), (("--tokenizer-type",), {})]
TRAINING = [(("--vocab-size",), {"type": int, "default": 32_000}), (("--min-frequency",), {"type": int, "default": 2}), (("--type",), {"choices": ("bpe", "native-bpe", "python-bpe"), "default": "bpe"}), (("--dry-run",), {"action": "store_true"})]
PACKING = [
    (("--seq-len",), {"type": int, "default": 512}), (("--val-fraction",), {"type": float, "default": 0.01}), (("--seed",), {"type": int, "default": 1337}), (("--mode",), {"default": "auto"}), (("--loss-masking",), {"default": "auto"}),
]
SHAPE = [((f"--{k}",), {"type": float, "default": v}) for k, v in (("vocab-size", 32000), ("width", 512), ("layers", 8), ("heads", 8), ("kv-heads", 4), ("ffn-mult", 2.5), ("seq-len", 512))]
COMMANDS = {
    "clean-dataset": ("clean records", READING + OUT + CLEANING),
    "deduplicate-dataset": ("clean records and drop repeats", READING + OUT + CLEANING),
    "convert-dataset": ("records as text or JSON lines", READING + OUT + [(("--to", "--format"), {"dest": "to", "choices": ("txt", "jsonl"), "default": "jsonl"})]),
    "inspect-dataset": ("counts, fields and issues", READING + LIMIT),
    "validate-dataset": ("whether there are records and no errors", READING + LIMIT),
    "tokenizer-report": ("what a tokenizer makes of the records", READING + LIMIT + TOKENIZER + [(("--out",), {})]),
    "benchmark-tokenizer": ("how fast a tokenizer is", READING + LIMIT + TOKENIZER + [(("--add-bos",), {"action": "store_true"}), (("--add-eos",), {"action": "store_true"})]),
    "tokenizer-status": ("tokenizer types, and the packages that some need", []),
    "train-tokenizer": ("learn a byte-level BPE vocabulary", READING + OUT + TRAINING),
    "prepare": ("packed training shards", READING + OUT + CLEANING + TOKENIZER + PACKING),
    "auto-train": ("vocabulary, shards and a configuration; no training", READING + CLEANING + LIMIT + TRAINING + TOKENIZER + PACKING + [(("--name",), {"required": True}), (("--packed-dir",), {}), (("--config-out",), {}), (("--no-train",), {"action": "store_true"})]),
    "evaluate": ("mean loss and perplexity of the runs of a JSON-lines metric log", [(("inputs",), {"nargs": "+"})]),
    "profile-config": ("parameters, operations and memory of a decoder", SHAPE),
    "params": ("parameters of a decoder", SHAPE),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    top.add_argument("--master")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (help_, options) in COMMANDS.items():
        p = sub.add_parser(name, help=help_)
        for spellings, settings in options:
            p.add_argument(*spellings, **settings)
    return top


def cleaning_config(a: argparse.Namespace) -> clean.CleaningConfig:
    return clean.CleaningConfig(a.min_chars, a.max_chars, not a.no_normalize_unicode, a.collapse_whitespace, not a.no_deduplicate, a.near_deduplicate, a.lang_filter)


def _show(data) -> None:
    print(json.dumps(data, indent=2, ensure_ascii=False, default=str))


def _encode(a: argparse.Namespace):
    """The encoding of a command's tokenizer; none for the byte tokenizer."""
    return tokens.load_tokenizer(a.tokenizer_type or "bpe", a.tokenizer)[0] if a.tokenizer else None


def _records(spark, a: argparse.Namespace, options: dict, limit: int | None = None):
    records, _ = readers.read_records(spark, a.inputs, **options)
    return stats.first(records, a.max_records if limit is None else limit)


def status() -> dict:
    """Tokenizer types by name, and whether the packages that they need are there."""
    from importlib.util import find_spec

    return {"types": sorted(tokens.TOKENIZER_ALIASES), "packages": {p: find_spec(p) is not None for p in ("tokenizers", "sentencepiece")}}


def train_tokenizer(spark, a: argparse.Namespace, options: dict, out: str) -> dict:
    records = _records(spark, a, options)
    seen = stats.training_scan(records).first().asDict() | {"dry_run": a.dry_run}
    if not a.dry_run:
        sinks.write_bpe(bpe.train_bpe(records, a.vocab_size, a.min_frequency), out)
    return seen


def auto_train(spark, a: argparse.Namespace, options: dict) -> dict:
    """Inspect, learn a vocabulary unless one is given, pack, and write the configuration that a training would take."""
    found = readers.inspect(spark, a.inputs, a.limit, **options)
    if not found["records"]:
        raise ValueError("no records to train on")
    out = a.packed_dir or storage.join("data", a.name)
    vocabulary = a.tokenizer or storage.join(out, "tokenizer.json")
    storage.make_dir(out)
    if not a.tokenizer:
        train_tokenizer(spark, a, options, vocabulary)
    mode = extract.corpus_mode(set(found["fields"])) if a.mode == "auto" else a.mode
    packed = P.prepare(spark, a.inputs, out, a.seq_len, a.tokenizer_type or "bpe", vocabulary, cleaning_config(a), a.val_fraction, a.seed, mode, a.loss_masking, **options)
    config = {"name": a.name, "data": {"train_path": storage.join(out, "train.bin"), "val_path": storage.join(out, "val.bin"), "seq_len": a.seq_len, "mode": mode}, "tokenizer": {"path": vocabulary, "type": a.tokenizer_type or "bpe"}, "packed": packed}
    storage.write_bytes(a.config_out or storage.join(out, "config.json"), json.dumps(config, indent=2).encode())
    return config


def evaluate(spark, paths: list[str]) -> list[dict]:
    lines = spark.read.text([storage.uri(p) for p in paths])
    rows = metrics_log.parse_log(lines, "run_id long, step long, event string, loss double, val_loss double")
    return [r.asDict() for r in metrics_log.evaluation(rows).orderBy("run_id").collect()]  # a row a run


def profile(spark, a: argparse.Namespace) -> dict:
    given = [F.lit(getattr(a, k) if k == "ffn_mult" else int(getattr(a, k))) for k in ("vocab_size", "width", "layers", "heads", "kv_heads", "ffn_mult", "seq_len")]
    return spark.range(1).select(*[c.alias(k) for k, c in schedules.model_profile(*given).items()]).first().asDict()


def run(spark, a: argparse.Namespace) -> int:
    if a.command == "tokenizer-status":
        _show(status())
        return 0
    if a.command in ("profile-config", "params"):
        found = profile(spark, a)
        _show(found if a.command == "profile-config" else {"parameters": found["parameters"]})
        return 0
    if a.command == "evaluate":
        _show(evaluate(spark, a.inputs))
        return 0
    a.inputs = [*a.inputs, *a.more]
    if not a.inputs:
        raise SystemExit("no inputs are given")
    options = {"text_key": a.text_key, "text_columns": tuple(a.text_columns or ()), "code_only": a.code_only}
    if a.command in ("inspect-dataset", "validate-dataset"):
        found = readers.inspect(spark, a.inputs, a.limit, **options)
        if a.command == "validate-dataset":
            found["valid"] = found["records"] > 0 and not any(i["kind"] == "error" for i in found["issues"])
        _show(found)
        return 0 if found.get("valid", True) else 1
    if a.command == "prepare":
        _show(P.prepare(spark, a.inputs, a.out, a.seq_len, a.tokenizer_type or "byte", a.tokenizer, cleaning_config(a), a.val_fraction, a.seed, a.mode, a.loss_masking, **options))
    elif a.command == "auto-train":
        _show(auto_train(spark, a, options))
    elif a.command == "convert-dataset":
        (sinks.write_txt if a.to == "txt" else sinks.write_jsonl)(_records(spark, a, options), a.out)
    elif a.command == "tokenizer-report":
        report = stats.tokenizer_report(_records(spark, a, options, a.limit), encode=_encode(a))
        _show(sinks.write_report(report, a.out) if a.out else report.first().asDict())
    elif a.command == "benchmark-tokenizer":
        encode = _encode(a) or (lambda c: tokens.byte_encode(c, a.add_bos, a.add_eos))
        _show(stats.tokenizer_benchmark(_records(spark, a, options, a.limit), encode))
    elif a.command == "train-tokenizer":
        _show(train_tokenizer(spark, a, options, a.out))
    else:
        config = cleaning_config(a)
        if a.command == "deduplicate-dataset":
            config = replace(config, deduplicate=True)
        sinks.write_jsonl(clean.clean_records(_records(spark, a, options), config), a.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session(master=a.master)
    try:
        return run(spark, a)
    finally:
        release(spark)


if __name__ == "__main__":
    sys.exit(main())
