"""A training corpus from ``documents``: toxic documents go, one document of each near-duplicate group stays, repeated
passages are cut, sources are mixed to their targets, and what is left is packed into sequences.

Each stage takes all that the stage before kept, as written. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlode.llm import jaccard, mixing, packing, substring, toxicity
from utterlode.llm.folds import held_out
from utterlode.llm.queries import tokenizer_path
from utterlode.plans.durable import saved

#: Columns of the table of ids that stay, which no table of documents has.
ID, ROWS = "_staying_id", "_staying_rows"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models score below one half; they learn as in the query of that operator."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = toxicity.train(docs, labels.where(~held_out("doc_id")))
    return toxicity.score(docs, scorer, keep=tuple(docs.columns)).where("score < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links of similarity 0.8 join.

    Of rows with one id, those with different texts all stay, and one of each text; rows without an id stay.
    """
    groups = jaccard.jaccard_components(docs)
    stay = saved(groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias(ID)).agg(F.count("*").alias(ROWS)), "stay")
    one = docs.join(stay.where(f"{ROWS} = 1").hint("shuffle_hash"), F.col("doc_id") == F.col(ID), "left_semi")
    several = docs.join(stay.where(f"{ROWS} > 1").hint("shuffle_hash"), F.col("doc_id") == F.col(ID), "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(several).unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that runs of 13 words repeat from a document with a smaller id."""
    cut = substring.dedup_substrings(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each copy lies."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("repeated passages", cut_repeats), ("mixing", mix), ("packing", pack)]

#: Learnt scores and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
