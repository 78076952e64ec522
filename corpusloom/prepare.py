"""From files to packed training shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import clean, extract, masking, packing, tokens
from corpusloom.session import materialize
from corpusloom.sources import readers


def training_table(records: DataFrame, seq_len: int = 512, mode: str = "auto", loss_masking: str = "auto", val_fraction: float = 0.01, seed: int = 1337, encode=None, by_document: bool = False) -> DataFrame:
    """Training sequences of records with their split. By default sequences are split one by one; `by_document` keeps a
    document in one split, so that no text of it is trained on and evaluated."""
    resolved = extract.record_mode(F.lit(mode), F.col("mode"), F.col("text"), F.col("suffix"))
    rows = records.select("ord", "text", resolved.alias("mode")).withColumn("policy", extract.loss_masking(F.lit(loss_masking), F.col("mode")))
    if not packing.boundary_packing(mode, loss_masking):
        rows = rows.withColumn("mode", F.lit(mode))
    seqs = masking.sequences(rows, seq_len, encode=encode)
    return packing.split(seqs, ["ord"] if by_document else ["ord", "seq_no"], val_fraction, seed)


def prepare(
    spark: SparkSession,
    paths: list[str],
    out: str,
    seq_len: int = 512,
    tokenizer_type: str = "byte",
    tokenizer_path: str | None = None,
    config: clean.CleaningConfig = clean.CleaningConfig(),
    val_fraction: float = 0.01,
    seed: int = 1337,
    mode: str = "auto",
    loss_masking: str = "auto",
    shard_tokens: int = packing.SHARD_TOKENS,
    **options,
) -> dict:
    """Read, clean, tokenize, mask, cut, split and pack; returns the packing statistics."""
    records, issues = readers.read_records(spark, paths, **options)
    kept = clean.clean_records(materialize(records, "records"), config)
    encode, vocab = None, tokens.BYTE_VOCABULARY
    if tokens.tokenizer_type(tokenizer_type) != "byte" and tokenizer_path:
        model = tokens.load_model(tokenizer_type, tokenizer_path)
        encode, vocab = model.encoder(), model.vocab_size
    seqs = materialize(training_table(kept, seq_len, mode, loss_masking, val_fraction, seed, encode), "sequences")
    seqs = packing.guarantee_splits(seqs, ["ord", "seq_no"])
    stats = packing.packing_stats(seqs).first().asDict() | {"issues": issues.count()}
    layout = packing.ShardLayout(vocab, shard_tokens)
    packing.write_shards(seqs, out, layout, ["ord", "seq_no"], seq_len, labels=packing.writes_labels(mode, loss_masking), stats=stats)
    return stats
