"""Clusters to ranked candidates, and the usage profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as x
from ..functions import text as t
from ..plans.numbering import numbered


def candidates(phrases: DataFrame, clusters: DataFrame, min_count: int = 3, min_projects: int = 3) -> DataFrame:
    """Ranked candidates of ``phrases`` under ``clusters`` (``ord, leader``)."""
    members = phrases.join(clusters, "ord").withColumn("pattern", t.clip(t.shown(F.col("text")), x.VARIANT_CHARS))
    rolled = members.groupBy("leader").agg(
        F.sum("count").alias("count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("project_keys")))).alias("project_keys"),
        F.min("first_timestamp").alias("first"), F.max("last_timestamp").alias("last"),
    ).where(F.col("count") >= min_count)
    patterns = members.groupBy("leader", "pattern").agg(F.sum("count").alias("n"), F.min("ord").alias("at"))
    variants = patterns.groupBy("leader").agg(F.count("*").alias("variant_count"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "at", F.col("pattern").alias("text"), F.col("n").alias("count")))).alias("all"))
    first = F.transform(F.slice("all", 1, x.VARIANTS_SHOWN), lambda v: F.struct(v["text"].alias("text"), v["count"].alias("count")))
    leaders = phrases.select(F.col("ord").alias("leader"), F.col("phrase_id").alias("candidate_id"), "text", "norm_key", "is_correction").where(~t.is_bare_path(F.col("text")))
    rows = rolled.join(leaders, "leader").join(variants.select("leader", "variant_count", first.alias("variants")), "leader")
    rows = rows.withColumns({"project_count": F.size("project_keys").cast("long"), "day_span": t.day_span(F.col("first"), F.col("last")).cast("long"), "kind": t.classify_kind(F.col("text"), F.col("norm_key"), F.col("is_correction"))})
    long_lived = (F.col("day_span") >= x.LONG_LIVED_DAYS) & (F.col("count") >= x.LONG_LIVED_FACTOR * min_count)
    rows = rows.withColumn("confidence", F.when((F.col("project_count") >= min_projects) | long_lived, "strong").otherwise("medium"))
    rows = rows.withColumns({"suggested_dest": t.destination(F.col("kind"), F.col("confidence")), "section": t.review_section(F.col("kind"), F.col("confidence")), "label": t.display_label(F.col("text"), F.col("kind"))})
    place = F.array_position(F.array(*map(F.lit, x.SECTIONS)), F.col("section"))
    order = [place, F.desc("confidence"), F.desc("count"), F.desc("project_count"), F.asc("candidate_id")]
    return numbered(rows, order, "number", start=1).select("number", "candidate_id", "label", "count", "project_count", "day_span", "kind", "suggested_dest", "confidence", "variant_count", "variants", "project_keys", "section")


def correction_share(phrases: DataFrame) -> DataFrame:
    """One row: utterances after merging, and those in phrases that are constraints."""
    kind = t.classify_kind(F.col("text"), F.col("norm_key"), F.col("is_correction"))
    return phrases.agg(F.sum("count").alias("total"), F.coalesce(F.sum(F.when(kind == "constraint", F.col("count"))), F.lit(0)).alias("corrections"))


def project_distribution(utterances: DataFrame) -> DataFrame:
    """Utterances of the busiest projects, with the folder of their earliest (A9); ties by first appearance."""
    rows = utterances.groupBy("project_key").agg(F.count("*").alias("n"), F.min_by("cwd", "seq").alias("cwd"), F.min("seq").alias("first"))
    return rows.orderBy(F.desc("n"), "first").limit(x.PROJECTS_SHOWN).select("project_key", t.display_cwd(F.col("cwd")).alias("cwd"), "n")


def section_top(ranked: DataFrame, k: int = x.ITEMS_SHOWN) -> DataFrame:
    """The first ``k`` candidates of each section."""
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("number"))).where(F.col("place") <= k)
