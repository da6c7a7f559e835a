"""A training-data pipeline over `documents`: toxicity, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on everything that the one before it kept, and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.io import stored, table
from metrolith.llm import mixing, packing, simhash, substring, toxicity
from metrolith.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 stay."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the row with the smallest doc_id stays (null is the largest), of those the first by a hash of its text.

    Groups are those of shingles of five words and a similarity of 0.8 or more, by wide fingerprints. Rows that share an
    id, or have none, stay for each group that they lead.
    """
    first = simhash.similar_groups(docs, 0.8, k=5).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    leaders = first.select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_leader"))
    keyed = docs.withColumn("_key", simhash.text_key("text"))
    kept = keyed.join(leaders, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_leader")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_key"]).drop("_key")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows of 50 that an earlier document holds go; a document of which nothing is left goes too."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    left = substring.dedup_substrings(docs, 50, 10, carry=tuple(others))
    left = left.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    made = {"text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}
    return left.select(*[made.get(c, F.col(f"`{c}`")) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of training; a copy that the mix cuts has its words alone."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences; a document that the mix repeats has its pieces again."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier, fingerprints and token ids can't be had in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from documents; what stands between two stages is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
