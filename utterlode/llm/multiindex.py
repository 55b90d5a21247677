"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately, each by its own codebook of ``k`` centroids, so ``k * k`` cells need
only ``2 k`` centroids; ``k`` grows with the root of the number of rows. For a query the centroids of each half are
taken by distance (the negative inner product), and the cells that hold rows are visited by summed distance until they
hold the wanted share of all rows. Their entries are reranked with the original vectors in double precision.

Codebooks come from a sample of at most ``SAMPLE`` vectors; every row is indexed. The share is the least that finds
``RECALL`` of the neighbours that sample vectors have among the sample (so vectors with structure need few cells, and
those without need many), unless the caller names one.

Rows meet in blocks of about ``BLOCK`` entries: neighbouring first codes share a block, and a first code with more rows has
several by salt. A block's entries come first and stay in memory by cell, the queries that visit the block stream past, and
only entries of visited cells are found; where queries visit much of a block, it is multiplied whole and the cells that a
query did not visit are taken out. A cell that holds a third of all rows is just more blocks. Entries are copied only once for each ``QUERIES`` queries.

Vectors of another length have no inner product with a query; each length is searched by itself.

Edge cases: rows without an id, and vectors that are null, zero, or hold null or non-finite components, are neither
queries nor entries; of rows with one id the one with the least vector takes part; without queries or entries there are no
rows; equal scores go by id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import saved
from . import wordstream as ws
from .vectors import lengths, matrix, sample, usable

TOP, RECALL = 20, 0.95
SAMPLE, TRIED, BLOCK, QUERIES = 20_000, 400, 8192, 1 << 20
#: Sample vectors to a centroid, at least.
EACH = 20
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def codebook_size(n: int) -> int:
    """About as many cells as rows, as far as the sample can tell centroids apart."""
    most = min(n, SAMPLE) // EACH
    return 1 << max(3, min(round(np.log2(max(n, 1)) / 2), most.bit_length() - 1))


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced points of the sample; at most as many centroids as distinct points."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)]
    for _ in range(rounds):
        code = nearest(points, centres)
        order = np.argsort(code, kind="stable")
        at = ws.runs(code[order])
        centres = centres.copy()
        centres[code[order][at]] = np.add.reduceat(points[order], at) / np.diff(np.append(at, len(code)))[:, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    for lo in range(0, len(points), 4096):
        out[lo : lo + 4096] = ((centres**2).sum(axis=1) - 2 * points[lo : lo + 4096] @ centres.T).argmin(axis=1)
    return out


def cells_by_distance(near_a: np.ndarray, near_b: np.ndarray, counts: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second codes of the cells that hold rows, by summed distance until they hold ``wanted`` rows."""
    i, j = np.nonzero(counts)
    order = np.argsort(near_a[i] + near_b[j], kind="stable")
    held = np.cumsum(counts[i[order], j[order]])
    order = order[: int(np.searchsorted(held, wanted)) + 1 if wanted > 0 else 0]
    return i[order], j[order]


def walk(near_a: np.ndarray, near_b: np.ndarray, counts: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    return list(zip(*(x.tolist() for x in cells_by_distance(near_a, near_b, counts, wanted)), strict=True))


def blocks_of(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each first code, its block and how many salts it has there; codes share a block up to ``most`` entries."""
    block, salts, now, held = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most)), 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            now, held = now + 1, 0
        block[i], held = now, held + size
    return block, salts


def needed_share(points: np.ndarray, first: np.ndarray, second: np.ndarray, top: int, recall: float = RECALL) -> float:
    """The share of rows that the cells of a walk must hold to find ``recall`` of the neighbours within the sample."""
    half = first.shape[1]
    i, j = nearest(points[:, :half], first), nearest(points[:, half:], second)
    picked = np.linspace(0, len(points) - 1, min(TRIED, len(points))).astype(int)
    upto = []
    for q in picked.tolist():
        score = points @ points[q]
        score[q] = -np.inf
        best = np.argpartition(score, -top)[-top:] if len(score) > top else np.flatnonzero(np.isfinite(score))
        distance = -(first @ points[q, :half])[i] - (second @ points[q, half:])[j]
        upto.append(np.searchsorted(np.sort(distance), distance[best], side="right") / len(points))
    places = np.sort(np.concatenate(upto))
    return float(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) if len(places) else 1.0


def _assign(dimension: int, first: np.ndarray, second: np.ndarray):
    def run(batches):
        for batch in batches:
            x = matrix(batch.column("vector"), dimension)
            half = first.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(nearest(x[:, :half], first), pa.int32()), pa.array(nearest(x[:, half:], second), pa.int32())], ["id", "vector", "i", "j"])

    return run


def _probe(dimension: int, first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float, block: np.ndarray, salts: np.ndarray):
    """A row for each query and block (and salt) that it visits, with its cells there."""
    salts_of = np.ones(int(block.max()) + 1, np.int64)
    np.maximum.at(salts_of, block, salts)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("vector"), dimension)
            half = first.shape[1]
            near_a, near_b = -x[:, :half] @ first.T, -x[:, half:] @ second.T
            for lo in range(0, len(x), 20):
                rows, where, salt, cells = [], [], [], []
                for row in range(lo, min(lo + 20, len(x))):
                    i, j = cells_by_distance(near_a[row], near_b[row], counts, wanted)
                    order = np.argsort(i, kind="stable")
                    code, at = (i * len(second) + j)[order].astype(np.int32), block[i[order]]
                    for a, b in ws.ranges(ws.runs(at), len(at)):
                        for s in range(int(salts_of[at[a]])):
                            rows.append(row)
                            where.append(int(at[a]))
                            salt.append(s)
                            cells.append(code[a:b])
                own = lambda name: batch.column(name).take(pa.array(rows, pa.int64()))  # noqa: B023, E731
                ends = np.cumsum([0, *map(len, cells)]).astype(np.int32)
                visited = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *cells])))
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(salt, pa.int32()), own("set"), own("id"), own("vector"), visited], ["block", "salt", "set", "id", "vector", "cells"])

    return run


class _Block:
    """The entries of a block by second code."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        ids, cell, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(cell, kind="stable")
        self.ids, self.vectors, cell = ids[order], vectors[order], cell[order]
        at = ws.runs(cell)
        self.cells, self.edges = cell[at], np.append(at, len(cell))
        self.sizes = np.diff(self.edges)

    def found(self, ids: np.ndarray, queries: np.ndarray, wanted: pa.Array, top: int):
        rows, cells = np.repeat(np.arange(len(ids)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy()
        at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        here = self.cells[at] == cells  # a salt has not all cells
        rows, at = rows[here], at[here]
        if 4 * self.sizes[at].sum() > len(ids) * len(self.ids):
            visited = np.zeros((len(ids), len(self.cells)), bool)
            visited[rows, at] = True
            score = np.where(np.repeat(visited, self.sizes, axis=1), queries @ self.vectors.T, -np.inf)
        else:
            score = np.full((len(ids), len(self.ids)), -np.inf)
            order = np.argsort(at, kind="stable")
            rows, at = rows[order], at[order]
            for a, b in ws.ranges(ws.runs(at), len(at)):
                lo, hi = self.edges[at[a]], self.edges[at[a] + 1]
                score[rows[a:b], lo:hi] = queries[rows[a:b]] @ self.vectors[lo:hi].T
        score[ids[:, None] == self.ids] = -np.inf
        least = np.partition(score, -top, axis=1)[:, -top] if len(self.ids) > top else np.full(len(ids), -np.inf)
        margin = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        row, column = np.nonzero((score >= (least - margin)[:, None]) & np.isfinite(score))
        exact = (queries[row] * self.vectors[column]).sum(axis=1)
        order = np.lexsort((self.ids[column], -exact, row))
        row, column, exact = row[order], column[order], exact[order]
        kept = np.arange(len(row)) - np.searchsorted(row, np.arange(len(ids)))[row] < top
        return pa.RecordBatch.from_arrays([pa.array(ids[row[kept]]), pa.array(self.ids[column[kept]]), pa.array(exact[kept])], schema=_FOUND)


def _rerank(dimension: int, top: int):
    """Rows come by block, entries (without ``cells``) before queries."""

    def run(batches):
        now, parts, block = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("block", "salt", "set", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                own, part = tuple(key[a, :3].tolist()), batch.slice(a, b - a)
                if own != now:
                    now, parts, block = own, [], None
                ids, vectors = part.column("id").to_numpy(), matrix(part.column("vector"), dimension)
                if key[a, 3] == 0:
                    parts.append((ids, part.column("cell").to_numpy(), vectors))
                    continue
                if parts and block is None:
                    block, parts = _Block(parts), []
                for lo in range(0, len(ids) if block else 0, 128):
                    yield block.found(ids[lo : lo + 128], vectors[lo : lo + 128], part.column("cells").slice(lo, 128), top)

    return run


def _search(rows: DataFrame, dimension: int, n: int, is_query: Callable[[Column], Column], top: int, k: int | None, visit: float | None) -> DataFrame:
    spark = rows.sparkSession
    picked, half = sample(rows, SAMPLE), max(1, dimension // 2)
    k = k or codebook_size(n)
    first = codebook(picked[:, :half], k)
    second = codebook(picked[:, half:], k) if half < dimension else np.zeros((1, 0))
    if visit is None:
        visit = needed_share(picked, first, second, top)
    entries = saved(rows.mapInArrow(_assign(dimension, first, second), "id long, vector array<float>, i int, j int"), "entries")
    counts = np.zeros((len(first), len(second)), np.int64)
    for r in entries.groupBy("i", "j").count().collect():  # at most k * k rows
        counts[r["i"], r["j"]] = r["count"]
    block, salts = blocks_of(counts.sum(axis=1), min(BLOCK, max(2048, n // ws.shuffle_width(spark))))
    queries = entries.where(is_query(F.col("id"))).select("id", "vector")
    asked = queries.count()
    sets = max(1, -(-asked // QUERIES))
    queries = queries.withColumn("set", F.pmod(F.xxhash64("id"), F.lit(sets)).cast("int")).repartition(ws.tasks_for(spark, asked, 2000))
    probes = queries.mapInArrow(_probe(dimension, first, second, counts, visit * n, block, salts), "block int, salt int, set int, id long, vector array<float>, cells array<int>")
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("i") + 1)
    dealt = entries.withColumn("block", of(block)).withColumn("salt", F.pmod(F.xxhash64("id"), of(salts)).cast("int")).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    shape = lambda df, kind, cell, cells: df.select("block", "salt", "set", F.lit(kind).alias("kind"), "id", cell.alias("cell"), "vector", cells.alias("cells"))
    both = shape(dealt, 0, (F.col("i") * len(second) + F.col("j")).cast("int"), F.lit(None).cast("array<int>")).unionByName(shape(probes, 1, F.lit(None).cast("int"), F.col("cells")))
    met = both.repartition(max(ws.shuffle_width(spark), (int(block.max()) + int(salts.sum()) - len(salts)) * sets // 4), "block", "salt", "set").sortWithinPartitions("block", "salt", "set", "kind")
    return met.mapInArrow(_rerank(dimension, top), "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Callable[[Column], Column], id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, k: int | None = None, visit: float | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` picks by id, the ``top`` found by inner product."""
    spark = vectors.sparkSession
    ws.tune(spark)
    everything = usable(vectors, id_col, vector_col)
    if everything.groupBy("id").count().where("count > 1").limit(1).count():
        everything = everything.groupBy("id").agg(F.min("vector").alias("vector"))
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for dimension, n in lengths(everything):
        found = found.unionByName(_search(everything.where(F.size("vector") == dimension), dimension, n, is_query, top, k, visit))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
