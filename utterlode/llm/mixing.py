"""Mixing sources to target weights by systematic sampling. DataFrame operations only.

Every document of a source expects ``target / source size`` copies. Documents stand in a fixed order, their expected
copies are prefix-summed within the source, one offset drawn from the seed and the source's name is added, and a
document is emitted once for each integer that its stretch of the sum crosses. So copies differ from the expectation by
less than one, and since the order runs by size, the words taken come out close to the target.

A source may hold a third of all rows, so its prefix sum is not one window: documents fall into cells of (source, size
class, class of the id's hash), the cells' counts are prefix-summed (at most ``64 * 8 * SPREAD`` a source), and ranks
inside a cell are added. One shuffle by cell serves both the join and the window. Inside a cell documents stand by size,
id and the hash of their text, so reruns agree whatever the ids.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; an empty table gives no rows; a
source of size 0 has target 0 and takes nothing; rows with a null id take part; input columns that clash with the added
ones are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import saved
from .wordstream import shield

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
SPREAD = 256
ADDED = ("size", "source_size", "target", "copies", "taken")


def source_targets(sized: DataFrame, source_col: str = "source") -> DataFrame:
    """``source, source_size, target``: weights 1, 2, 3 repeating over sources by code point (null last) share the total
    size; a target stops at ``MOST_COPIES`` times its source and the excess is shared again by weight.

    Sources sorted by cap over weight stop in that order, so the water level after each follows from running sums.
    """
    totals = sized.groupBy(F.col(source_col).alias("_s")).agg(F.sum("size").cast("double").alias("source_size"))
    everything = Window.partitionBy()
    weighed = totals.withColumn("weight", 1 + (F.row_number().over(Window.orderBy(F.col("_s").asc_nulls_last())) - 1) % 3)
    weighed = weighed.withColumn("cap", MOST_COPIES * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("_s").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.select(
        "*",
        F.row_number().over(order).alias("place"),
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("level"),
    )
    full = F.col("ratio") <= F.col("level")
    first_open = F.min(F.when(~full, F.struct("place", "level"))).over(everything)
    share = F.least("cap", F.col("open.level") * F.col("weight"))
    return levels.withColumn("open", first_open).select("_s", F.col("source_size").cast("long"), F.when(F.col("open").isNull() | (F.col("place") < F.col("open.place")), F.col("cap")).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size)."""
    docs, names = shield(docs.drop(*ADDED), ("_s", "_text", "_len", "_top", "_sub", "_len_", "_top_", "_sub_", "_rank", "_ahead", "_offset", "_upto", "_each"))
    sized = docs.withColumn("size", F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long"))
    binary = F.bin("size")
    sized = sized.withColumns({"_len": F.length(binary), "_top": F.substring(binary, 1, 4), "_sub": F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % SPREAD, "_text": F.md5(text_col)})
    cell = ["_len", "_top", "_sub"]
    cells = saved(sized.groupBy(F.col(source_col).alias("_s"), *cell).agg(F.count("*").alias("n"), F.sum("size").alias("size")), "cells")
    targets = source_targets(cells, "_s")
    before = Window.partitionBy("_s").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    ahead = cells.withColumn("_ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).select("_s", *cell, "_ahead")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.when(F.col("_s").isNull(), "n").otherwise(F.concat(F.lit("s"), "_s")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    plan = ahead.join(targets.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t").withColumn("_offset", offset)
    plan = plan.select("_s", *[F.col(c).alias(f"{c}_") for c in cell], "_ahead", "_offset", "source_size", "target")

    same = F.col(source_col).eqNullSafe(F.col("_s"))
    for c in cell:
        same &= F.col(c) == F.col(f"{c}_")
    rank = F.row_number().over(Window.partitionBy(source_col, *cell).orderBy("size", id_col, "_text"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = sized.withColumn("_rank", rank).join(plan, same)
    out = out.withColumn("_upto", F.col("_rank") + F.col("_ahead")).withColumn("_each", expected)
    copies = F.floor(F.col("_each") * F.col("_upto") + F.col("_offset")) - F.floor(F.col("_each") * (F.col("_upto") - 1) + F.col("_offset"))
    return out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).select(*docs.columns, *ADDED).withColumnsRenamed(names)


def mixed_rows(docs: DataFrame, **names: str) -> DataFrame:
    """The mix itself: each document as many times as it has copies, with its own columns, also those named like added ones."""
    held, back = shield(docs, ADDED)
    mixed = mix_sources(held, **names).where("copies > 0")
    return mixed.select(*held.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(*held.columns).withColumnsRenamed(back)


ORACLE = r"""
with sized as (select doc_id, source, md5(text) as m, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
bits as (select *, bin(size) as b from sized),
cells as (select *, length(b) as l, substr(b, 1, 4) as t, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % 256 as u from bits),
ranked as (select *, row_number() over (partition by source order by l, t, u, size, doc_id nulls first, m nulls first) as upto from cells),
totals as (select source, sum(size)::double as source_size from sized group by source),
weighed as (select *, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from totals),
capped as (select *, 3 * source_size as cap, 3 * source_size / weight as ratio from weighed),
placed as (select *, row_number() over (order by ratio, source nulls last) as place,
  (sum(source_size) over () - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level from capped),
opened as (select min(place) as place from placed where ratio > level),
targets as (select p.source, p.source_size,
  case when o.place is null or p.place < o.place then p.cap
       else least(p.cap, p.weight * (select q.level from placed q where q.place = o.place)) end as target,
  ('0x' || substr(md5('mix' || case when p.source is null then 'n' else 's' || p.source end), 1, 8))::bigint / 4294967296.0::double as shift
  from placed p, opened o),
joined as (select r.doc_id, r.size, t.source_size::bigint as source_size, t.target, t.shift, r.upto,
  case when t.source_size > 0 then t.target / t.source_size else 0 end as each_one
  from ranked r join targets t on r.source is not distinct from t.source)
select doc_id, size, source_size, target,
  ((floor(each_one * upto + shift) - floor(each_one * (upto - 1) + shift)) * size)::bigint as taken
from joined
"""
