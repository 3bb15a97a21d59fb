"""Corpus pipeline: documents with a language, one of each group of near copies, none that gives the benchmark away, mixed and sharded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of documents; a document that the mix takes twice then stands there twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partsloom.llm import decontaminate, language_id, mixing, sharding, similar
from partsloom.llm.common import col, kept, table, with_columns

#: A text is of no language if its 3-grams are less known, or its best language leads by less, than such a part of what all but a share LOW of the labelled texts reach.
LOW, HELD, LEAD = 0.05, 0.35, 0.25
#: Columns that stages look at.
COLUMNS = ("doc_id", "text", "source")
#: Near copies: Jaccard similarity of five-word shingles.
SHINGLE, SIMILARITY = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language is recognised. Learns from the labelled rows of all documents outside the held-out fold, and what is too little on all of them."""
    train = table(spark, sf_dir, "documents").where(~language_id.held_out(F.col("doc_id")))
    model = language_id.train(train, "doc_id", "text", "lang")
    if not model.langs:  # nothing to learn from: nothing to reject on
        return docs
    held, lead = language_id.low(train.where("lang is not null"), "text", model, LOW)
    own, back = aside(docs)
    least = (HELD * held, LEAD * lead)
    found = language_id.predict(own, "text", model, proof=True, least=least)
    return back(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("held") >= least[0]) & (F.col("lead") >= least[1])))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the smallest id. Rows of one id and text are one document; rows of
    one id and other texts are told apart by their texts. Without any id in a component, the row of the smallest text hash stays."""
    label = kept(similar.near_copies(docs, shingle=SHINGLE, least=SIMILARITY), "near-copies")
    first = label.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x"))
    key = lambda i, k: [F.coalesce(i, F.lit(0)).alias("_pl_id"), i.isNull().alias("_pl_none"), k.alias("_pl_key")]
    first = kept(first.select(*key(F.col("x.doc_id"), F.col("x.key"))), "near-copies-first")
    keyed = docs.select(*map(col, docs.columns), *key(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    by = ["_pl_id", "_pl_none", "_pl_key"]
    return keyed.join(first, by, "left_semi").dropDuplicates(by).select(*map(col, docs.columns))  # one shuffle for both


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that gives a benchmark item away; rows are known by id and text."""
    keyed = with_columns(docs, {"_pl_key": F.xxhash64("doc_id", "text")})
    hit = kept(decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="_pl_key"), "leaks")
    return keyed.join(hit.select(F.col("doc_id").alias("_pl_key")).distinct(), "_pl_key", "left_anti").select(*map(col, docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Sizes and hashes go through the mix; texts meet the numbers of copies once, by the number of their row, the same way at any size."""
    own, back = aside(docs)
    own = own.select("*", mixing.word_count(F.col("text")).alias("_pl_size"), F.xxhash64("doc_id", "text").alias("_pl_hashed"), F.monotonically_increasing_id().alias("_pl_at"))
    own = kept(own, "mix-sized")
    counts = mixing.mix(own.select("_pl_at", "source", "_pl_size", "_pl_hashed"), F.col("_pl_size"), order=F.col("_pl_hashed"))
    counts = kept(counts.where("copies > 0").select("_pl_at", "copies"), "mix-copies")
    return back(own.join(counts.hint("merge"), "_pl_at").withColumn("_pl_nth", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns and the slot and shard that each document's id names; copies stay together. Columns slot and shard of the input, if any, make room for them."""
    return sharding.assign_shards(docs, ["doc_id"], [f"shard-{i}" for i in range(sharding.SHARDS)])


def aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but those of documents under other names, so that none clashes with an operator's own; and what gives the columns back as they were."""
    name = {c: c if c in COLUMNS else f"_pl_c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[col(c).alias(n) for c, n in name.items()]), lambda df: df.select(*[col(n).alias(c) for c, n in name.items()])


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminate", clean_of_benchmark), ("mix", mixed), ("shard", sharded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Kernels, fingerprints and Newton's method are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
