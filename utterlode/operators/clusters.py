"""Similarity of phrases and leader clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as x
from ..functions import text as t
from ..plans.durable import discard, saved

MOST_PIVOTS = 1024
#: Blocks that vectors make, more only where a block would exceed ``BLOCK_BYTES``; rows and cells of a product; numbers in a step.
BLOCKS, BLOCK_BYTES, ROWS, STEP = 32, 32 << 20, 1024, 1 << 20


def tfidf_weights(texts: DataFrame) -> DataFrame:
    """``ord, term, weight, df`` of ``ord, key``: character 2- to 4-grams, sublinear tf, smoothed idf, L2 norm."""
    clean = F.regexp_replace(F.lower(F.substring("key", 1, x.TFIDF_CHARS)), r"(?U)\s\s+", " ")
    terms = texts.select("ord", F.explode(t.char_grams(clean, *x.TFIDF_GRAMS)).alias("term")).groupBy("ord", "term").agg(F.count("*").alias("tf"))
    n = texts.agg(F.count("*").alias("n"))
    df = terms.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n))
    raw = terms.join(df, "term").withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("ord")))
    return raw.select("ord", "term", (F.col("w") / norm).alias("weight"), "df")


def cosine_pairs(weights: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` (a before b) of all pairs of unit vectors at least ``threshold`` alike.

    Exact: with terms rare-first, a vector's prefix runs until what follows has a norm below the threshold; by
    Cauchy-Schwarz two similar vectors share a term in both prefixes, so only prefixes are joined.
    """
    rest = Window.partitionBy("ord").orderBy("df", "term").rowsBetween(0, Window.unboundedFollowing)
    prefix = weights.withColumn("rest", F.sum(F.col("weight") * F.col("weight")).over(rest)).where(F.col("rest") >= (threshold - 1e-9) ** 2).select("ord", "term")
    met = prefix.select(F.col("ord").alias("a"), "term").join(prefix.select(F.col("ord").alias("b"), "term"), "term").where("a < b").select("a", "b").distinct()
    side = lambda s: weights.select(F.col("ord").alias(s), "term", F.col("weight").alias(f"w_{s}"))
    dots = met.join(side("a"), "a").join(side("b"), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("similarity"))
    return dots.where(F.col("similarity") >= threshold)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1, 1))


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _near_blocks(threshold: float, pivots: np.ndarray, reach: np.ndarray, groups: np.ndarray):
    """Pairs of a block's own rows, which come first and stay, and the rows that visit it, which stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, cells = None, [], None
        for batch in _slices(batches, ROWS):
            key = np.stack([batch.column(c).to_numpy() for c in ("block", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if key[lo, 0] != now:
                    now, held, cells = key[lo, 0], [], None
                part = batch.slice(lo, hi - lo)
                ord_, home, rows = part.column("ord").to_numpy(), part.column("home").to_numpy(), _matrix(part.column("vector"))
                if key[lo, 1] == 0:
                    held.append((ord_, home, rows))
                    continue
                if cells is None:
                    cells, held = _by_cell(held), []
                near = _angles(rows, pivots[[c for c, *_ in cells]]) <= reach[[c for c, *_ in cells]] if cells else []
                for k, (cell, own, block) in enumerate(cells):
                    some = np.flatnonzero(near[:, k])
                    for at in range(0, len(own) if len(some) else 0, 2 * ROWS):
                        scores = rows[some] @ block[at : at + 2 * ROWS].T
                        r, c = np.nonzero(scores >= threshold)
                        a, b = ord_[some[r]], own[at + c]
                        # a pair of one group is met from both sides, one of two groups in one of them only
                        kept = (groups[home[some[r]]] != groups[cell]) | (a < b)
                        r, c, a, b = r[kept], c[kept], a[kept], b[kept]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(scores[r, c])], schema=_PAIRS)

    return run


def _by_cell(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``cell, ord, vectors`` of the rows of a block."""
    if not held:
        return []
    ord_, home = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    order = np.argsort(home, kind="stable")
    rows = np.empty((len(order), held[0][2].shape[1]))
    place, at = np.argsort(order), 0
    for *_, part in held:
        rows[place[at : at + len(part)]] = part
        at += len(part)
    ord_, home = ord_[order], home[order]
    cuts = [0, *(np.flatnonzero(home[1:] != home[:-1]) + 1).tolist(), len(home)]
    return [(int(home[lo]), ord_[lo:hi], rows[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def _grouped(pivots: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A group for each cell, neighbours together and up to ``most`` rows in all; blocks of each group, several for a larger cell."""
    groups, subs, last, full, left = np.zeros(len(pivots), int), [], 0, most, np.ones(len(pivots), bool)
    for _ in range(len(pivots)):
        last = int(np.argmax(np.where(left, pivots @ pivots[last], -np.inf)))
        left[last] = False
        if not subs or full + sizes[last] > most:
            subs.append(1)
            full = 0
        full += sizes[last]
        groups[last], subs[-1] = len(subs) - 1, max(1, -(-full // most))
    return groups, np.array(subs)


def dense_pairs(vectors: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """``a, b, similarity`` for unit vectors ``ord, vector``: no term is rare in a dense vector, so blocks of rows meet and a
    matrix product finds what is near (C4, C6).

    Rows belong to the cell of their nearest pivot, one of a sample row for each ``block`` rows. Angles are a metric: a row is
    near one of a cell only if its angle to the pivot is at most the cell's radius and the threshold's angle, so other cells
    are not compared. Neighbouring cells form blocks and a larger cell is several; of two groups of cells one visits the
    other. There are about ``BLOCKS`` blocks whatever the number of vectors, so what travels grows with it and not with its
    square, until a block has ``BLOCK_BYTES``. A task holds one block, and all else passes it in steps of a fixed size.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    picked = vectors.select("ord", "vector").orderBy(F.xxhash64("ord"), "ord").limit(max(1, min(MOST_PIVOTS, -(-n // block)))).collect()
    pivots = np.array([r["vector"] for r in picked], np.float64)
    if not len(pivots):
        return spark.createDataFrame([], "a long, b long, similarity double")
    rows = max(1, STEP // max(pivots.shape))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, rows):
            angles = _angles(_matrix(batch.column("vector")), pivots)
            home = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("vector"), pa.array(home, pa.int32()), pa.array(angles[np.arange(len(home)), home])], ["ord", "vector", "home", "angle"])

    placed = saved(vectors.select(F.col("ord").cast("long").alias("ord"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(place, "ord long, vector array<double>, home int, angle double"), "placed")
    cells = {r["home"]: r for r in placed.groupBy("home").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # at most one a pivot
    sizes = np.array([cells[i]["n"] if i in cells else 0 for i in range(len(pivots))])
    reach = np.array([cells[i]["radius"] if i in cells else -np.inf for i in range(len(pivots))]) + np.arccos(threshold) + 1e-6
    groups, subs = _grouped(pivots, sizes, max(block, min(-(-n // BLOCKS), BLOCK_BYTES // (8 * pivots.shape[1]))))
    first = np.cumsum(subs) - subs
    order = np.argsort(groups, kind="stable")
    starts = np.searchsorted(groups[order], np.arange(len(subs)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, rows):
            mine = groups[batch.column("home").to_numpy()]
            met = np.logical_or.reduceat((_angles(_matrix(batch.column("vector")), pivots) <= reach)[:, order], starts, axis=1)
            gap = np.arange(len(subs)) - mine[:, None]
            row, group = np.nonzero(met & np.where(gap > 0, gap % 2 == 1, gap % 2 == 0))
            block = np.concatenate([first[mine] + batch.column("mark").to_numpy() % subs[mine], *(first[group] + s for s in range(subs.max()))])
            wanted = np.concatenate([np.ones(len(mine), bool), *(s < subs[group] for s in range(subs.max()))])
            row, kind = np.concatenate([np.arange(len(mine)), *[row] * subs.max()]), (np.arange(len(block)) >= len(mine)).astype(np.int32)
            row, block, kind = row[wanted], block[wanted], kind[wanted]
            for at in range(0, len(row), ROWS):
                own = batch.take(pa.array(row[at : at + ROWS]))
                yield pa.RecordBatch.from_arrays([pa.array(block[at : at + ROWS], pa.int32()), pa.array(kind[at : at + ROWS]), own.column("ord"), own.column("home"), own.column("vector")], ["block", "kind", "ord", "home", "vector"])

    met = placed.select("ord", "home", "vector", F.xxhash64("ord").alias("mark")).mapInArrow(visit, "block int, kind int, ord long, home int, vector array<double>")
    met = met.repartitionById(int(subs.sum()), F.col("block")).sortWithinPartitions("block", "kind")
    return met.mapInArrow(_near_blocks(threshold, pivots, reach, groups), "a long, b long, similarity double")


def leader_clusters(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """``ord, leader`` as if items were taken in order, each joining its most similar leader so far or becoming one.

    Leaders are the first maximal independent set of the pairs: an item whose earlier neighbours are all settled as
    members leads, one with a leading earlier neighbour is a member. Each round settles all such items at once.
    """
    edges = saved(pairs.select(F.col("a").alias("before"), F.col("b").alias("ord"), "similarity"), "edges")
    state = saved(items.select("ord").join(edges.select("ord").distinct().withColumn("_has", F.lit(True)), "ord", "left").select("ord", F.when(F.col("_has").isNull(), "leader").alias("role")), "roles")
    while state.where("role is null").limit(1).count():
        ahead = edges.join(state.select(F.col("ord").alias("before"), F.col("role").alias("known")), "before")
        seen = ahead.groupBy("ord").agg(F.max(F.coalesce(F.col("known") == "leader", F.lit(False))).alias("led"), F.count_if(F.col("known").isNull()).alias("open"))
        role = F.coalesce("role", F.when(F.col("led"), "member").when(F.col("open") == 0, "leader"))
        after = saved(state.join(seen, "ord", "left").select("ord", role.alias("role")), "roles")
        discard(state)
        state = after
    leaders = state.where("role = 'leader'").select(F.col("ord").alias("before"))
    nearest = edges.join(leaders, "before").groupBy("ord").agg(F.max_by("before", F.struct("similarity", -F.col("before"))).alias("leader"))
    return state.join(nearest, "ord", "left").select("ord", F.when(F.col("role") == "leader", F.col("ord")).otherwise(F.col("leader")).alias("leader"))
