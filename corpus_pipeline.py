"""A corpus pipeline of five of the operators: classify, deduplicate, pack.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept; run()
writes each result to the shared folder and reads it again before the next stage, and then
deletes what the stage before it had staged.

In every stage null text counts as empty, extra columns are handed through whatever their
names, and an empty table gives an empty one.  The classifier judges each row by its text;
rows that share a doc_id stay or go together in the stages after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, near_dedup, packing, quality_classifier, substring_dedup
from plumbline.llm.common import keep_rows, mark, release, staged, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; a tie at 0.5 stays, and so do
    all where there are no labels of both kinds and as many good ones as bad ones at least."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.filtered(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the largest doc_id; rows without one only where no
    copy has one."""
    return keep_rows(docs, exact_dedup.exact_dedup(docs).where("kept").select("doc_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the smallest doc_id.  Texts
    without words are linked with nothing and stay."""
    return keep_rows(docs, near_dedup.near_components(docs).where("kept").select("doc_id"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of repeated runs; n_chars follows the text (zero for
    null text, which becomes empty).  No document goes, even if nothing of it is left."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = substring_dedup.substring_dedup(docs, carry=others, closing=True)
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    made |= {c: F.col(f"carry_{k}") for k, c in enumerate(others)}
    return cut.select(*(made[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each with its place in a sequence of 1024 tokens; an empty
    text is a piece of the end id alone."""
    return packing.pack(docs)


STAGES = [("quality classifier", classify), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies), ("substring dedup", drop_repeats), ("best-fit packing", pack)]

#: A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            until = mark()
            docs = staged(docs, f"stage-{k}")
            release(spark, since, until)
    return docs
