"""The corpus pipeline: toxicity filter, line dedup, SimHash near-dedup, mixing to target weights, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet below the shared
folder and reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestra.llm import toxicity
from contestra.llm.common import read_table, staged, word_count
from contestra.llm.line_dedup import drop_repeated_lines
from contestra.llm.mixing import mix_sources
from contestra.llm.near_copies import near_copies, small
from contestra.llm.packing import packed_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on labelled ones, doesn't reject. Rejected: score of 0.3 or more."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat, within two edits, one seen before; what is left empty goes."""
    return drop_repeated_lines(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word shingles, similarity 0.8 or more): smallest doc_id, nulls last, then
    smallest digest of the row. Rows of different groups stay, whatever their doc_ids."""
    rows, groups = near_copies(docs.select(*COLUMNS))
    least = groups.groupBy("__root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("least"))
    kept = least.select(F.col("least.__row").alias("__row")).join(groups.groupBy("__row").agg(F.count("*").alias("__n")), "__row")
    kept = small(staged(kept, "kept"))
    rows = rows.join(kept, "__row")
    if kept.where("__n > 1").isEmpty():
        return rows.select(*COLUMNS)
    # Rows of one digest are equal in every column, so it doesn't matter which of them stays.
    return rows.where("__n = 1").unionByName(rows.where("__n > 1").dropDuplicates(["__row"])).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to weights 1, 2, 3 by source takes them; those it takes 0 times go."""
    out = mix_sources(docs.select(*COLUMNS), F.array("source"), word_count(F.col("text")), [1, 2, 3])
    return out.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, repeats included, in sequences of at most 2048 tokens."""
    return packed_documents(docs.select("doc_id", "text"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("simhash near-dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
