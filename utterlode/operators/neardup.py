"""Exact and near-duplicate wording: fork copies, set-similarity join, phrases."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as x
from ..functions import text as t
from ..plans.durable import saved
from ..plans.numbering import numbered
from .components import connected_components

#: Keys that a set gets at most for a range of sizes, where it has a choice of more than one bigram.
KEYS = 24


def drop_forks(rows: DataFrame) -> DataFrame:
    """The first row of each timestamp and normalized key."""
    first = F.row_number().over(Window.partitionBy("timestamp", "norm_key").orderBy("seq"))
    return rows.withColumn("_first", first).where("_first = 1").drop("_first")


def _meetings(sizes: list[int], threshold: float) -> list[tuple[int, int, int, list[int]]]:
    """``n, least, most, places``: where sets of ``n`` bigrams, rare-first, meet others whose smaller set has ``least`` to ``most``.

    Sets of m and n bigrams that are similar share at least ``need(m, n)``. So they share ``k`` of the first
    ``n - need + k`` of either, and every choice of ``k`` places there is a key. A range of sizes has one ``k``, the largest
    for which a set gets no more than ``KEYS`` keys from it, or 1.
    """
    need = lambda m, n: max(1, math.ceil(threshold / (1 + threshold) * (m + n) - 1e-9))
    rows, least, top = [], 1, max(sizes, default=0)
    while least <= top:
        most = least + max(0, math.floor(least * (1 - threshold) / 3) - 1)
        spare = {n: n - need(max(least, math.ceil(threshold * n - 1e-9)), n) for n in range(least, math.floor(most / threshold + 1e-9) + 1)}
        k = max((k for k in range(1, need(least, least) + 1) if math.comb(max(spare.values()) + k, k) <= KEYS), default=1)
        rows += [(n, least, most, list(places)) for n in sorted(set(sizes) & set(spare)) for places in combinations(range(min(n, spare[n] + k)), k)]
        least = most + 1
    return rows


def jaccard_pairs(keys: DataFrame, threshold: float = x.FUZZY_JACCARD) -> DataFrame:
    """``a, b, similarity`` of all pairs of ``ord, key`` whose character bigrams are at least ``threshold`` alike.

    Exact: two similar keys share several of their rarest bigrams, and meet by each such choice (``_meetings``). Texts that
    have the same few rare bigrams are few where those that have one of them are a share of all. A key's bigrams, as
    numbers, travel with it, so a pair is decided where it meets, and only by the first choice that it shares. Choices are
    told apart by 64 bits; one that is taken for another costs a comparison, not a result.
    """
    spark = keys.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    code = lambda c: F.ascii(c) * 2097152 + F.ascii(F.substring(c, 2, 1))  # both code points; 2^21 is beyond any
    tokens = keys.select("ord", F.explode(t.bigrams(F.col("key"))).alias("gram")).select("ord", code(F.col("gram").cast("string")).cast("long").alias("gram"))
    tokens = saved(tokens, "bigrams")
    rarity = tokens.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = tokens.join(rarity, "gram").groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda r: r["gram"]).alias("grams"))
    marks = F.aggregate("grams", F.lit(0).cast("long"), lambda m, g: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(g), F.lit(64)).cast("int"))))
    sets = saved(ranked.withColumns({"n": F.size("grams"), "marks": marks}), "sets")
    plan = _meetings([r["n"] for r in sets.select("n").distinct().collect()], threshold)
    plan = spark.createDataFrame(plan, "n int, least int, most int, places array<int>")
    choice = F.xxhash64("least", F.transform("places", lambda i: F.get("grams", i)))
    own = ("ord", "n", "marks", "grams")
    keyed = sets.repartition(width, "ord").join(F.broadcast(plan), "n").select(choice.alias("choice"), "least", "most", F.size("places").alias("k"), *own)
    # a given number of tasks: pairs are many where bytes are few, and by bytes all would fall to one task
    left = keyed.select("choice", "least", "most", "k", *[F.col(c).alias(f"{c}_a") for c in own]).repartition(width, "choice")
    right = keyed.select("choice", *[F.col(c).alias(f"{c}_b") for c in own]).repartition(width, "choice")
    need = f"ceil({threshold / (1 + threshold)!r}D * (n_a + n_b) - 1e-9D)"
    # of the grams that only one side has, each changes one mark at most
    met = left.join(right, "choice").where(F.expr(f"ord_a < ord_b and least(n_a, n_b) between least and most and least(n_a, n_b) >= {threshold}D * greatest(n_a, n_b) - 1e-9D and bit_count(marks_a ^ marks_b) <= n_a + n_b - 2 * {need}"))
    common = F.array_intersect("grams_a", "grams_b")
    shared = met.where(F.size(common) >= F.expr(need)).withColumn("common", common).where(F.col("choice") == F.xxhash64("least", F.slice("common", F.lit(1), F.col("k"))))
    similarity = F.size("common") / (F.col("n_a") + F.col("n_b") - F.size("common"))
    return shared.select(F.col("ord_a").alias("a"), F.col("ord_b").alias("b"), similarity.alias("similarity")).where(F.col("similarity") >= F.lit(threshold))


def key_groups(rows: DataFrame, threshold: float = x.FUZZY_JACCARD) -> DataFrame:
    """``match_key, key_ord, component``: keys by first appearance; near-equal ones share a component."""
    keys = saved(rows.where("norm_key <> ''").groupBy("match_key").agg(F.min("seq").alias("key_ord")), "keys")
    near = jaccard_pairs(keys.where(F.length("match_key").between(*x.FUZZY_CHARS)).select(F.col("key_ord").alias("ord"), F.col("match_key").alias("key")), threshold)
    components = connected_components(near, "a", "b")
    return keys.join(components, F.col("key_ord") == F.col("node"), "left").select("match_key", "key_ord", F.coalesce("component", "key_ord").alias("component"))


def phrases(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per component: its most frequent wording (the earliest on a tie) and the rollup of its utterances (A4)."""
    placed = rows.where("norm_key <> ''").join(groups, "match_key").withColumn("_at", F.struct("timestamp", "key_ord", "seq"))
    wordings = placed.groupBy("component", "text").agg(F.count("*").alias("n"), F.min("_at").alias("at"))
    chosen = wordings.groupBy("component").agg(F.min_by("text", F.struct((-F.col("n")).alias("less"), "at")).alias("text"))
    rolled = placed.groupBy("component").agg(
        F.count("*").alias("count"), F.array_sort(F.collect_set("project_key")).alias("project_keys"),
        F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
    )
    named = rolled.join(chosen, "component").withColumn("norm_key", t.normalize_key("text"))
    return numbered(named, [F.desc("count"), F.asc("norm_key"), F.asc("component")], "ord").select(
        t.digest(F.col("norm_key"), 12).alias("phrase_id"), "text", "norm_key", "count", "project_keys", "first_timestamp", "last_timestamp",
        t.is_correction_key(F.col("norm_key")).alias("is_correction"), "ord", "component",
    )


def members(rows: DataFrame, groups: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrase_id, timestamp, key_ord, seq, utterance_id``: the utterances of each phrase, a row each, so that a phrase that
    was said in a third of all utterances is no cell. Sorted by the three in the middle they stand as they were said."""
    placed = rows.where("norm_key <> ''").join(groups, "match_key")
    return placed.join(phrases.select("component", "phrase_id"), "component").select("phrase_id", "timestamp", "key_ord", "seq", "utterance_id")


def keyed(utterances: DataFrame) -> DataFrame:
    """Utterances with ``norm_key`` (which may be there already) and ``match_key``, computed once."""
    rows = utterances if "norm_key" in utterances.columns else utterances.withColumn("norm_key", t.normalize_key("text"))
    return saved(rows.withColumn("match_key", t.match_key(F.col("norm_key"))), "keyed")
