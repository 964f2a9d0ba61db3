"""The training-corpus pipeline: each stage applies one corpus operator to all that the stage before kept.

Quality classifier, exact dedup, near duplicates by n-gram Jaccard join (five
words, similarity 0.8), benchmark decontamination, mixing to target weights.
All but the last return the columns of ``documents``; the last adds the number
of each copy that the mix takes. ``ORACLE_SQL`` is None: training, prefix joins
and random rounding aren't SQL; ``tests/llm`` holds the stages against brute
force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duewatch.llm import quality
from duewatch.llm.decontaminate import decontaminate
from duewatch.llm.exact_dedup import exact_dedup
from duewatch.llm.jaccard_join import jaccard_classes
from duewatch.llm.mixing import mix_sources
from duewatch.llm.shared import cut, keep_without, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return quality.quality_filter(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id."""
    classes = jaccard_classes(docs, words=5, percent=80)
    gone = cut(classes.where("component_id != doc_id").select("doc_id").distinct(), "near-copies")
    return keep_without(docs, gone, "doc_id")


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken, with its number in ``mix_copy``."""
    name = "mix_copy"
    while name in docs.columns:
        name += "_"
    taken = mix_sources(docs).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
                                                         F.col("copies").alias("__copies"))
    # The same kind of join at every size: both sides are dealt by the document.
    joined = docs.join(taken.hint("merge"), docs["doc_id"].eqNullSafe(taken["__id"]) & docs["source"].eqNullSafe(taken["__source"]))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), taken["__copies"])).alias(name))


STAGES = [("quality classifier", good_quality), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies),
          ("benchmark decontamination", no_benchmark), ("mixing to target weights", mixed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
