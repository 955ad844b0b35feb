"""The corpus pipeline: five stages, each on all that its predecessor kept. Every stage's result is written as Parquet and read again.

All stages but the last return the columns of ``documents``; the last adds ``copy_no`` and ``mix_key``. Columns that an input has besides
these five are dropped. A document without an id is examined under a key of its own (:func:`litprops.llm.store.named`) and keeps its null id if
it stays. Documents of one id are decided together: if one of them is rejected, all go. Null texts and sources are treated as each
operator's module says; empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litprops.llm import decontaminate, langid, line_dedup, mixing, ngram_join
from litprops.llm.store import Scratch, named, only_ids, unnamed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if no language is at least this likely, or if it has no letter.
MIN_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known with enough certainty."""
    docs = named(docs)
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model)
    bad = found.filter((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < MIN_LANGUAGE_SCORE)).select("doc_id")
    bad = Scratch(spark, "language-id").put(bad.distinct(), "rejected")
    return unnamed(only_ids(docs.select(*COLUMNS), bad, "doc_id", "left_anti"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that repeat an earlier one; a document that had lines and has none left goes."""
    scratch, docs = Scratch(spark, "line-dedup-stage"), named(docs)
    gone = line_dedup.repeated_lines(docs, scratch)
    docs, ids = docs.select(*COLUMNS), gone.select("doc_id")
    same = only_ids(docs, ids, "doc_id", "left_anti")
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i.cast("int")))
    cut = only_ids(docs, ids, "doc_id").join(gone.withColumnRenamed("lines", "gone"), "doc_id").withColumn("left", left)
    cut = cut.filter(F.exists("left", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).withColumn("text", F.array_join("left", "\n"))
    return unnamed(same.unionByName(cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    docs = named(docs)
    groups = ngram_join.near_duplicates(docs, keyed=True)
    return unnamed(only_ids(docs.select(*COLUMNS), groups.filter("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    docs = named(docs)
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unnamed(only_ids(docs.select(*COLUMNS), found.select("doc_id").distinct(), "doc_id", "left_anti"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and shuffle documents so that sources have their target weights."""
    return unnamed(mixing.mix(named(docs.select(*COLUMNS))))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mix_sources),
]

#: The language stage is learned, which SQL cannot say; the tests hold the whole pipeline against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
