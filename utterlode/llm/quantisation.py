"""Embedding near-dedup by iterative quantisation.

1. Vectors that are equal fall into one class; classes take part below.
2. A rotation is learnt on a sample of at most ``SAMPLE`` vectors: principal directions first, then turns that bring the
   rotated vectors closest to the corners of the cube (alternating signs and an orthogonal Procrustes step). The signs of
   a rotated vector are its binary code, at most 64 bits. Several rotations from different starts give several codes.
3. Codes are cut into disjoint substrings, one hash table each (multi-index Hamming). How often bits of two vectors at
   the threshold differ is measured on the codes of ``PAIRS`` such pairs, made from the sample; vectors near the mean
   differ in more bits. Substring length and number of tables follow from that and the number of vectors, so that a pair
   at the threshold misses every table with probability ``MISS`` at most.
4. In each bucket, rows with another one within the Hamming radius go on; a bucket beyond ``BLOCK`` rows is cut into
   blocks that meet in pairs. Only these rows meet again by bucket, with their original vectors, which decide. A pair
   counts in the first table that finds it. What leaves a bucket is a row for each vector, with the number of its links
   there and the least vector that links there reach, so a big group of near copies gives no square of rows.

Vectors of different lengths have no cosine; those of each length are compared among themselves.

Edge cases: vectors that are null, zero, or hold null or non-finite components, link with nothing; a null id stays alone,
without component; rows with one id are one node; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.spread import spread_join
from ..plans.durable import discard, saved
from . import wordstream as ws
from .vectors import lengths, matrix, sample, usable

THRESHOLD, SAMPLE, MISS, ROUNDS = 0.95, 20_000, 1e-3, 30
PAIRS, BLOCK = 2000, 4096
#: Comparing two codes costs so much of moving a row.
COMPARE = 0.01


def rotations(points: np.ndarray, bits: int, how_many: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The mean, and matrices that take a centred unit vector to real values whose signs are its code."""
    points = points / np.linalg.norm(points, axis=1, keepdims=True)
    mean = points.mean(axis=0)
    centred = points - mean
    _, directions = np.linalg.eigh(centred.T @ centred)
    directions = directions[:, ::-1][:, :bits]
    flat, out = centred @ directions, []
    for start in range(how_many):
        turn = np.linalg.qr(np.random.default_rng(start).standard_normal((bits, bits)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        out.append(directions @ turn)
    return mean, out


def difference(points: np.ndarray, bits: int, threshold: float) -> np.ndarray:
    """For pairs at the threshold, made from sample vectors and differences of others: the share of bits that differ."""
    rng = np.random.default_rng(0)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    pick = lambda: unit[rng.integers(len(unit), size=PAIRS)]
    x, toward = pick(), pick() - pick()
    toward -= (toward * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(toward, axis=1)
    apart = size > 1e-6
    if not apart.any():
        return np.array([math.acos(threshold) / math.pi])
    x, toward = x[apart], toward[apart] / size[apart, None]
    y = threshold * x + math.sqrt(1 - threshold**2) * toward
    mean, turns = rotations(points, bits, 4)
    return np.mean([(((x - mean) @ t >= 0) != ((y - mean) @ t >= 0)).mean(axis=1) for t in turns], axis=0)


def tables_for(differ: np.ndarray, length: int, miss: float = MISS) -> int:
    """How many tables of substrings of ``length`` bits bring the mean chance to miss a pair below ``miss``."""
    alone = 1 - (1 - differ) ** length
    low, high = 0, 1
    while (alone**high).mean() > miss:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if (alone**middle).mean() > miss else (low, middle)
    return high


def shape(differ: np.ndarray, n: int, bits: int) -> tuple[int, int, int]:
    """Bits of a substring, number of tables, Hamming radius of whole codes: the cheapest that keep the chance to miss."""
    cost, length, tables = min((t * (n + COMPARE * n * n / 2 ** (k + 1)), k, t) for k in range(1, min(bits, 32) + 1) for t in [tables_for(differ, k)])
    most = float(np.quantile(differ, 0.999))
    return length, tables, math.ceil(bits * most + 5 * math.sqrt(bits * most * (1 - most)))


def _encode(dimension: int, mean: np.ndarray, turns: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            x = matrix(batch.column("vector"), dimension)
            x = x / np.linalg.norm(x, axis=1, keepdims=True) - mean
            codes = np.stack([((x @ t >= 0).astype(np.uint64) << np.arange(t.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64) for t in turns], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(codes.view(np.int64).ravel()), len(turns)).cast(pa.list_(pa.int64()))], ["id", "codes"])

    return run


def _groups(batches, keys: tuple[str, ...], values: tuple[str, ...]):
    """(key, columns) of each run of rows with equal keys; rows come sorted by them."""
    held = None
    for batch in batches:
        own = [batch.column(c).to_numpy() for c in keys] + [batch.column(c) for c in values]
        own[len(keys) :] = [c.to_numpy(zero_copy_only=False) if not pa.types.is_list(c.type) else c.flatten().to_numpy().reshape(batch.num_rows, -1) for c in own[len(keys) :]]
        held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in held[: len(keys)]])) + 1
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False):
            yield tuple(k[a] for k in held[: len(keys)]), [v[a:b] for v in held[len(keys) :]]
        if len(cuts):
            held = [h[cuts[-1] :] for h in held]
    if held is not None and len(held[0]):
        yield tuple(k[0] for k in held[: len(keys)]), [v for v in held[len(keys) :]]


_KEY = ("t", "sub", "i", "j")


def _meet(radius: int):
    """Rows of a bucket with another one within the Hamming radius."""
    schema = pa.schema([("t", pa.int32()), ("sub", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("own", pa.int32()), ("id", pa.int64())])

    def run(batches):
        for key, (own, ids, codes) in _groups(batches, _KEY, ("own", "id", "code")):
            codes, met = codes.view(np.uint64), np.zeros(len(ids), bool)
            for lo in range(0, len(ids), 256):
                near = np.bitwise_count(codes[lo : lo + 256, None] ^ codes[None, :]) <= radius
                near &= ids[lo : lo + 256, None] != ids[None, :]
                if key[2] != key[3]:
                    near &= own[lo : lo + 256, None] != own[None, :]
                met[lo : lo + 256] = near.any(axis=1)
            if met.any():
                n = int(met.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k), schema.field(c).type) for c, k in enumerate(key)] + [pa.array(own[met]), pa.array(ids[met])], schema=schema)

    return run


class Forest:
    """Components of rows under pairs that come in blocks."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.label[x], self.label[y]
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                after = self.label[self.label]
                if (after == self.label).all():
                    break
                self.label = after


def _link(tables: list[tuple[int, int]], length: int, radius: int, threshold: float):
    """Of the rows of a bucket that have links there: how many, and the least vector that they reach."""
    mask = np.uint64((1 << length) - 1)
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def first_found(t: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs of codes that table ``t`` finds and none before it."""
        differ = x ^ y
        near = np.bitwise_count(differ) <= radius
        r, _ = tables[t]
        first = near[:, r].copy()
        for r, c in tables[:t]:
            first &= ~(near[:, r] & ((differ[:, r] >> np.uint64(c * length)) & mask == 0))
        return first

    def run(batches):
        for key, (own, ids, n, codes, vectors) in _groups(batches, _KEY, ("own", "id", "n", "codes", "vector")):
            order = np.argsort(ids, kind="stable")
            own, ids, n, codes, vectors = own[order], ids[order], n[order], codes[order].view(np.uint64), vectors[order].astype(np.float64)
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            unit = vectors / norms[:, None]
            links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
            for lo in range(0, len(ids), 256):
                score = unit[lo : lo + 256] @ unit[lo:].T
                x, y = np.nonzero(score >= threshold - 1e-9)
                sure, x, y = score[x, y] > threshold + 1e-9, x + lo, y + lo
                kept = (x < y) & (ids[x] != ids[y])
                if key[2] != key[3]:
                    kept &= own[x] != own[y]
                sure, x, y = sure[kept], x[kept], y[kept]
                at = np.flatnonzero(~sure)
                sure[at] = (vectors[x[at]] * vectors[y[at]]).sum(axis=1) / (norms[x[at]] * norms[y[at]]) >= threshold
                x, y = x[sure], y[sure]
                for i in range(0, len(x), 1 << 16):
                    some = slice(i, i + (1 << 16))
                    first = first_found(int(key[0]), codes[x[some]], codes[y[some]])
                    a, b = x[some][first], y[some][first]
                    links += (np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))).astype(np.int64)
                    forest.join(a, b)
            hit = links > 0
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[forest.label[hit]])], schema=schema)

    return run


def _linked(classes: DataFrame, dimension: int, threshold: float) -> DataFrame:
    """``id, links, root``, a row for each bucket in which a class has links."""
    spark = classes.sparkSession
    n, bits = classes.count(), min(64, dimension)
    picked = sample(classes, SAMPLE)
    length, how_many, radius = shape(difference(picked, bits, threshold), n, bits)
    per_code, mask = bits // length, (1 << length) - 1
    mean, turns = rotations(picked, bits, -(-how_many // per_code))
    tables = [(r, c) for r in range(len(turns)) for c in range(per_code)][:how_many]
    coded = saved(classes.select("id", "vector").mapInArrow(_encode(dimension, mean, turns), "id long, codes array<long>"), "codes")

    numbered = F.array(*[F.struct(F.lit(t).alias("t"), F.element_at("codes", r + 1).alias("code"), F.expr(f"shiftrightunsigned(codes[{r}], {c * length}) & {mask}L").alias("sub")) for t, (r, c) in enumerate(tables)])
    keyed = coded.select("id", F.inline(numbered))
    big = saved(keyed.groupBy("t", "sub").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).select("t", "sub", "blocks"), "buckets")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = keyed.join(big, ["t", "sub"], "left").withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("t", "sub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "code")
    width = ws.tasks_for(spark, n * len(tables), 1 << 20)
    met = dealt.repartition(width, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(_meet(radius), "t int, sub long, i int, j int, own int, id long")
    met = saved(met, "met")
    again = met.join(classes.select("id", "n", "vector").join(coded, "id"), "id").select(*_KEY, "own", "id", "n", "codes", "vector")
    found = saved(again.repartition(width, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(_link(tables, length, radius, threshold), "id long, links long, root long"), "found")
    for table in (coded, big, met):
        discard(table)
    return found


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``."""
    spark = vectors.sparkSession
    ws.tune(spark)
    everything = usable(vectors, id_col, vector_col)
    names, done = vectors.select(F.col(id_col).cast("long").alias("vec_id")), None
    for dimension, total in lengths(everything):
        rows = everything.where(F.size("vector") == dimension)
        classes = saved(rows.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("n")), "classes")
        found = _linked(classes, dimension, threshold)
        components = connected_components(found, "id", "root")
        linked = found.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("_others"))
        copies = classes.select("vector", F.col("id").alias("node"), F.col("n").alias("_own")).join(linked, "node", "left").join(components, "node", "left")
        placed = spread_join(rows, saved(copies, "copies"), "vector", "_own", total, ws.shuffle_width(spark))
        part = placed.groupBy("id").agg(F.max(F.coalesce("_others", F.lit(0)) + F.col("_own") - 1).alias("_n"), F.min(F.coalesce("component", "node")).alias("_c"))
        done = part if done is None else done.unionByName(part)
    if done is None:
        done = spark.createDataFrame([], "id long, _n long, _c long")
    done = done.groupBy("id").agg(F.max("_n").alias("_n"), F.min("_c").alias("_c"))
    out = names.join(done, names["vec_id"] == done["id"], "left")
    component = F.coalesce("_c", "vec_id")
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
