"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import discard, saved
from .spread import hot_keys, spread_join

#: Up to so many links any task may hold them all; beyond, nodes and labels that hold many rows are spread.
FEW = 200_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for every node that an edge names; the component is its smallest node.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so a path of length
    d needs about log d rounds. Labels are written to the shared folder each round, which cuts the lineage. A node that
    many links name, and a label that many nodes bear, meet their rows by broadcast. Only counts reach the driver. Null
    ends and loops are ignored.
    """
    spark = edges.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    clean = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    links = saved(clean.union(clean.select("b", "a")).distinct(), "links")
    total = links.count()
    labels = saved(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    hubs = saved(hot_keys(links.groupBy("b").agg(F.count("*").alias("size")), "size", total, width).select("b"), "hubs") if total > FEW else None

    def heard_by(labels: DataFrame) -> DataFrame:
        named = labels.withColumnRenamed("node", "b")
        if hubs is None:
            return links.join(named, "b")
        hot = F.broadcast(named.join(F.broadcast(hubs), "b"))
        return links.join(hot, "b").unionByName(links.join(F.broadcast(hubs), "b", "left_anti").join(named, "b"))

    while True:
        heard = heard_by(labels).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        spread = saved(labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("now")), "spread")
        roots = spread.select(F.col("node").alias("root"), F.col("now").alias("beyond"))
        if hubs is None:
            followed = spread.join(roots, F.col("now") == F.col("root"), "left")
        else:
            borne = spread.groupBy("now").agg(F.count("*").alias("size"))
            borne = saved(borne.join(roots, F.col("now") == F.col("root"), "left").select("now", "size", "beyond"), "borne")
            followed = spread_join(spread, borne, "now", "size", total, width)
        after = saved(followed.select("node", "was", F.least("now", F.coalesce("beyond", "now")).alias("component")), "labels")
        changed = after.where("component <> was").limit(1).count()
        discard(spread)
        discard(labels)
        if hubs is not None:
            discard(borne)
        labels = after.select("node", "component")
        labels._utterlode_path = after._utterlode_path
        if not changed:
            discard(links)
            if hubs is not None:
                discard(hubs)
            return labels
