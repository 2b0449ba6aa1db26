"""From raw documents to shards: each stage works on what the one before it kept.

All stages take documents with null ids, texts, languages and sources, empty and very long texts, repeated rows, further
columns of any name, and empty tables (these give an empty result). What each does with them is said below.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.llm import decontaminate, languages, mixing, neardups, sharding
from priceloom.llm.shared import settle, table

#: Language ID and mixing draw on statistics of their whole input, so no stage's rows can be told by one SQL query.
ORACLE_SQL = None

#: Languages that may stay (None: all that the labelled documents teach), and the least score of the one predicted.
WANTED, LEAST_SCORE = None, 0.0


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in no wanted language: those of which the model knows next to nothing, those with a lower score or
    another language, and those whose text is null or has no letter. The rows that stay are as they were.

    Without a labelled document nothing can be known, and nothing stays.
    """
    model = languages.learn(docs.filter(languages.learnt(docs["doc_id"])).select("text", "lang"))
    found = languages.identify(docs, model).filter((F.col("lang_pred") != languages.UNKNOWN) & (F.col("known") >= languages.LEAST_KNOWN) & (F.col("score") >= LEAST_SCORE))
    return (found if WANTED is None else found.filter(F.col("lang_pred").isin(*WANTED))).select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that with the smallest doc_id, nulls last, one of repeated rows.
    Documents without a word link with nothing and stay."""
    return neardups.drop_near_duplicates(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark window occurs; those without a word stay, and an empty benchmark drops none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources meet their target weights; a null source is one of its own, a null
    text has no words. Equal documents are told apart by nothing and share what they get."""
    return mixing.mix(docs)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each document, its depth and its bytes (columns of these names go); repeats beyond the limit get pages."""
    return sharding.shard_rows(docs)


STAGES = [
    ("language_id", in_known_language),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmarks),
    ("mixing", mixed),
    ("sharding", in_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
