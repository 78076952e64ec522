"""Records that occur in both the training and an evaluation split (problem 6).

Method: exact prefix-filter bipartite join on rare word sequences: the prefixes of evaluation texts
are indexed, training texts probe them with theirs under size and position bounds, and overlaps are
verified (`setjoin`, sides 1 and 2). Texts of equal look (`looks`) are added by an equality join of their forms.
The report counts from classes of equal texts, so that no pair is made for it.

Defined cases: null, empty and short texts have no pairs of the first kind; texts under 16 characters
none of the second; rows of a null or other split or without an id take no part; repeated rows count once.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

from . import looks, setjoin


def split_overlaps(
    df: DataFrame,
    id_col: str = "record_id",
    text_col: str = "text",
    split_col: str = "split_name",
    train: tuple[str, ...] = ("train",),
    evaluation: tuple[str, ...] = ("val", "test"),
    threshold: float = 0.8,
    shingle: int = 5,
    least_words: int = 1,
    least_chars: int = 16,
) -> DataFrame:
    """`(train_id, eval_id)`: every training and evaluation record that look the same or reach the similarity."""
    t, e, links = overlap_classes(df, id_col, text_col, split_col, train, evaluation, threshold, shingle, least_words, least_chars)
    across = links.join(t.select(F.col("class").alias("train_class"), F.col("id").alias("train_id")), "train_class").join(
        e.select(F.col("class").alias("eval_class"), F.col("id").alias("eval_id")), "eval_class"
    )
    return across.select("train_id", "eval_id").where("train_id <> eval_id").distinct()


def overlap_classes(
    df: DataFrame,
    id_col: str = "record_id",
    text_col: str = "text",
    split_col: str = "split_name",
    train: tuple[str, ...] = ("train",),
    evaluation: tuple[str, ...] = ("val", "test"),
    threshold: float = 0.8,
    shingle: int = 5,
    least_words: int = 1,
    least_chars: int = 16,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members `(class, id)` of the training and of the evaluation side, and the links `(train_class, eval_class)` of classes that overlap.

    A class is a set of word sequences for texts of enough words, else a look: texts that look the same have the same words, so no pair is lost or found twice.
    """
    side = F.when(F.col(split_col).isin(*train), 1).when(F.col(split_col).isin(*evaluation), 2).cast("byte")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), side.alias("side")).where("side is not null and id is not null")
    members, pairs = setjoin.similar_classes(rows, Fraction(str(threshold)), shingle, least_words)
    named = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    sets = materialize(members.select(named("fp").alias("class"), "id", "side"), "members")
    look = F.concat_ws(":", F.lit("l"), "key", "look", "look2")
    absent = materialize(rows.select("id", "side").join(sets, ["id", "side"], "left_anti").select("id").distinct(), "absent")
    few = setjoin.only(rows, absent)
    short = looks.look_hashes(few).where(F.col("length") >= least_chars).select(look.alias("class"), "id", "side").distinct().join(sets, ["id", "side"], "left_anti")
    every = materialize(sets.unionByName(short), "classes")
    t, e = every.where("side = 1").select("class", "id"), every.where("side = 2").select("class", "id")
    similar = pairs.select(named("a").alias("x"), named("b").alias("y"))
    both = similar.union(similar.select("y", "x"))
    have = lambda m, c: m.select(F.col("class").alias(c)).distinct()
    links = both.toDF("train_class", "eval_class").join(have(t, "train_class"), "train_class", "left_semi").join(have(e, "eval_class"), "eval_class", "left_semi")
    equal = have(t, "train_class").join(have(e, "eval_class"), F.col("train_class") == F.col("eval_class"))
    return t, e, links.union(equal).distinct()


def class_report(t: DataFrame, e: DataFrame, links: DataFrame, df: DataFrame, id_col: str = "record_id", split_col: str = "split_name", source_col: str = "source") -> DataFrame:
    """Per evaluation split and source: records that overlap with training, training records that they overlap with, and pairs; of `overlap_classes`.

    Counted by class: the members of a class are counted once, and the counts of linked classes are multiplied.
    """
    linked = materialize(links, "links")
    names = df.groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.col(split_col).alias("split_name"), F.col(source_col).alias("source"))).alias("r")).select("id", "r.*")
    many = e.join(names, "id").groupBy("class", "split_name", "source").agg(F.count("*").alias("n")).withColumnRenamed("class", "eval_class")
    size = t.groupBy(F.col("class").alias("train_class")).agg(F.count("*").alias("m"))
    weighed = linked.join(size, "train_class")
    cell = many.join(weighed.groupBy("eval_class").agg(F.sum("m").alias("m")), "eval_class")
    counts = cell.groupBy("split_name", "source").agg(F.sum("n").alias("eval_records"), F.sum(F.col("n") * F.col("m")).alias("pairs"))
    met = many.select("eval_class", "split_name", "source").join(weighed, "eval_class").groupBy("split_name", "source", "train_class").agg(F.max("m").alias("m"))
    trained = met.groupBy(F.col("split_name").alias("s"), F.col("source").alias("f")).agg(F.sum("m").alias("train_records"))
    out = counts.join(trained, counts.split_name.eqNullSafe(trained.s) & counts.source.eqNullSafe(trained.f))
    return out.select("split_name", "source", "eval_records", "train_records", "pairs")


def overlap_report(pairs: DataFrame, df: DataFrame, id_col: str = "record_id", split_col: str = "split_name", source_col: str = "source") -> DataFrame:
    """Per evaluation split and source: records that overlap with training, and pairs."""
    names = df.select(F.col(id_col).alias("eval_id"), F.col(split_col).alias("split_name"), F.col(source_col).alias("source")).dropDuplicates(["eval_id"])
    return (
        pairs.join(names, "eval_id")
        .groupBy("split_name", "source")
        .agg(F.countDistinct("eval_id").alias("eval_records"), F.countDistinct("train_id").alias("train_records"), F.count("*").alias("pairs"))
    )
