"""Corpus pipeline over ``documents``: quality rules, toxicity, n-gram Jaccard join, packing.

Each stage works on all rows that its predecessor kept. All but the last return the columns of ``documents``.

Edge cases, for every stage: null text counts as empty (the quality rules reject it); null and repeated doc_ids are rows of
their own until the near-duplicate stage, which keeps one row of each component; an empty table gives no rows; further
columns are carried by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import jaccard, packing, quality, toxicity
from veilspark.llm.common import ship, staged, table


#: Near duplicates share at least this part of their 5-word windows; op10's contract has values of its own.
NEAR_GRAM, NEAR_PERCENT = 5, 80
#: Rows of 24 bytes that a join may broadcast: 24 MB; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy 2 keeps, whole. Native, one pass, no shuffle; nothing is stored but the result.

    Null text has no words and goes; repeated rows are judged alike.
    """
    own = [c for c in docs.columns if c != "doc_id"]
    carried = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("own_columns"))
    kept = quality.apply_policy(quality.judged(carried, ("own_columns",))).filter("kept")
    return kept.select(*[F.col("doc_id") if c == "doc_id" else F.col("own_columns").getField(c).alias(c) for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. Trained on the labelled ones among its input."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each component: the smallest doc_id (null first), then the smallest hash of the text.

    Rows are named by (doc_id, two hashes of the text), as doc_id may be null or repeated; of rows that are equal in
    these one stays, whichever. Texts without words are components of their own, so all their rows stay.
    Texts move only where the rows to drop are too many to broadcast, and for repeated rows of which one stays.
    """
    ship(spark)
    text = F.col("text").cast("string")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit("second"), text).alias("g"))
    found = staged(jaccard.labelled_rows(whole, NEAR_GRAM, NEAR_PERCENT, ("h", "g")).filter("label is not null").select("doc_id", "h", "g", "label"), "pipeline-labels")
    # minima before the shuffle, so that a large component costs each task one row; a struct with a null id comes first
    first = found.groupBy("label").agg(F.min(F.struct("doc_id", "h", "g")).alias("f")).select("label", "f.*")
    counted = found.groupBy("doc_id", "h", "g").agg(F.count("*").alias("k"), F.first("label").alias("label"))
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["h"] == y["h"]) & (x["g"] == y["g"])
    stays = first.select(F.col("label").alias("l"), F.col("doc_id").alias("d"), F.col("h").alias("p"), F.col("g").alias("q"))
    marked = counted.join(stays, F.col("label") == F.col("l"))
    chosen = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("p")) & (F.col("g") == F.col("q"))
    marked = staged(marked.select("doc_id", "h", "g", "k", chosen.alias("stays")).filter("not stays or k > 1"), "pipeline-marked")
    drop, repeated = marked.filter("not stays").select("doc_id", "h", "g"), marked.filter("stays").select("doc_id", "h", "g")
    held = F.broadcast if marked.count() <= BROADCAST_ROWS else lambda d: d
    left = whole.join(held(drop), same(whole, drop), "left_anti")
    once = left.join(held(repeated), same(left, repeated), "left_anti").select("row")
    more = left.join(held(repeated), same(left, repeated), "left_semi").dropDuplicates(["doc_id", "h", "g"]).select("row")
    return once.union(more).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_stage), ("toxicity", toxicity_stage), ("ngram_jaccard", near_duplicate_stage), ("packing", packing_stage)]
#: SQL has no string-kernel machine; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
