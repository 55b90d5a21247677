"""Which rows a learner may see, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5
#: A label may hold most rows, so it is sampled in so many parts.
PARTS = 64


def held_out(id_col: str) -> Column:
    """True for ids whose crc32, as text, is divisible by ``FOLDS``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample_ids(labelled: DataFrame, label: str, each: int, most: int, size: str | None = None, most_size: int = 0) -> DataFrame:
    """About ``each`` ids of every label, and ``most`` in all, those with the smallest hash: ``id`` and ``label``.

    A label's rows fall into ``PARTS`` parts by hash, and each part gives its share, so no task ranks all rows of a label.
    With ``size``, a part gives ids in that order only as long as their sizes add up to its share of ``most_size``.
    """
    by_hash = Window.partitionBy("label", "part").orderBy(F.xxhash64("id"), F.col("id"))
    rows = labelled.select("id", F.col(label).alias("label"), *([F.col(size).alias("size")] if size else [])).withColumn("part", F.pmod(F.hash("id"), F.lit(PARTS)))
    picked = rows.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= -(-each // PARTS))
    if size:
        picked = picked.withColumn("upto", F.sum("size").over(by_hash)).where(F.col("upto") <= most_size // PARTS)
    return picked.orderBy("rank", F.xxhash64("id"), "label").limit(most).select("id", "label")
