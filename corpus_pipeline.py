"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and reread as the next one's docs. All stages but the last return the
columns of ``documents``. A decision on a doc_id (a null one too) holds for all
rows that carry it; of rows that repeat a kept id, near-dedup keeps one.

All stages take whole texts of any length, and give no rows for an empty table.
Further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import decontaminate, near_dup, packing, quality, toxicity
from tracefold.llm.common import materialise, read_table
from tracefold.session import ship


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the ids in ``dropped`` (doc_id). The ids are written first: their true size decides the join."""
    gone, _ = materialise(dropped.select(F.col("doc_id").alias("dropped_doc_id")).distinct(), "dropped")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["dropped_doc_id"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules. Null, empty and short texts fail; a document at the threshold stays."""
    return _without(docs, quality.score_quality(docs, read_table(spark, sf_dir, "labels")).where("not kept"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the cut. Null and empty texts have the score of a text without matches."""
    ship(spark)
    return _without(docs, toxicity.score_toxicity(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels"))).where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one of the smallest id. Null and blank texts are in no group; of rows that repeat an id any one stays."""
    ship(spark)
    found = near_dup.near_duplicates(docs)
    kept = _without(docs, found.where("not kept"))
    # of rows that repeat a kept id, one stays; there are none in a sound table
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again_doc_id"))
    again, _ = materialise(again, "again")
    if again.isEmpty():
        return kept
    once = kept.join(again, kept["doc_id"] == again["again_doc_id"], "left_anti")
    return once.unionByName(kept.join(again, kept["doc_id"] == again["again_doc_id"], "left_semi").dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; a similarity at the threshold is a find. Null and blank texts stay."""
    ship(spark)
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places; null and empty texts are the end token alone, repeated rows are packed each."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Learned models and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
