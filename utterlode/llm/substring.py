"""Substring dedup by seed and extend.

1. *Seeds.* Every run of ``span`` words is represented by its anchor: the first of the least hashes among its
   ``seed_words``-grams (winnowing), so equal runs have equal anchors at equal places, and a document keeps about
   ``2 / (span - seed_words + 2)`` anchors a word. Anchors meet in hash buckets; those that only one document holds end there.
2. *Join and extension.* Documents are joined on the anchors that they share: each occurrence goes to its anchor's bucket
   with the words beside it, ``span - seed_words`` to the left and as many to the right, held by 32 bits each. There the
   match is extended word by word to the left, for each extension to the left as far to the right as makes ``span`` words,
   and an extension counts as repeated if the same words stand around the anchor in a document with a smaller id. It is
   decided for all occurrences of an anchor at once, by sorting them by the words in question and comparing neighbours
   word by word; no pairs of documents are formed.
3. *Maximal repeats.* Extensions of neighbouring anchors overlap; their union are the maximal repeats of at least ``span``
   words, which are cut.

Before either shuffle a task folds what its own documents share (one entry for each anchor, context and task), so a
passage that a third of all documents holds sends one entry a task, not one a document. An anchor that would fill an
eighth of a bucket (a common phrase in many different contexts) is dealt by its extensions, not by itself: an occurrence then
sends an entry for each extension, with only the words of that one. The number of buckets and tasks follows the bytes of
text.

Edge cases: a null text has no words and stays null; texts shorter than ``span`` words are never cut; rows with a null
id are returned uncut and cut nothing; rows with one and the same id never cut each other; input columns that clash with
the columns added here are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.durable import saved
from . import wordstream as ws

SPAN = 13
SEED_WORDS = 5
#: Entries that a task folds together before it sends them on: anchors, and anchors with their contexts.
FLUSH, CONTEXTS = 1_000_000, 200_000
#: An anchor is dealt by its extensions if it has more occurrences (one a document) than this, and than one in
#: ``HOT_SHARE`` of its bucket; so a bucket names ``HOT_SHARE`` of them at most.
HOT, HOT_SHARE = 5000, 8
#: Bytes of text for each hash bucket.
BUCKET_BYTES = 12 << 20
ADDED = ("n_words", "n_removed", "repeats")


def _anchors(words: np.ndarray, first: np.ndarray, seed_words: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the anchors stand, each once, and their hashes."""
    grams = ws.gram_hashes(words, seed_words)
    n = max(0, len(words) - span + 1)
    best, place = grams[:n].copy(), np.arange(n)
    for j in range(1, span - seed_words + 1):
        less = grams[j : j + n] < best
        best[less] = grams[j : j + n][less]
        place[less] = np.flatnonzero(less) + j
    place = place[ws.whole_grams(first, span)]
    place = place[ws.runs(place)]
    return place, grams[place]


def _owners(first: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, positions, side="right") - 1


def _texts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = ws.byte_view(batch.column(text))
    for lo, hi in ws.slices(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = ws.word_bounds(part, at)
        yield lo, hi, part, at, starts, ends, first


# --- seeds ----------------------------------------------------------------------------------------------------------

def _seed_map(bits: int, seed_words: int, span: int):
    shift, low = np.uint64(32 - bits), np.uint64(32)

    def flush(hashes: np.ndarray, docs: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(hashes, kind="stable")
        hashes, docs = hashes[order], docs[order]
        at = ws.runs(hashes)
        least, most = np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at)
        many = np.diff(np.append(at, len(hashes)))
        many[least == most] = 1  # one document, however often it holds the anchor
        # one document stands for all that share an anchor here; the bucket's answer reaches the others by the task's own
        sent = hashes[at]
        buckets = (sent >> low).astype(np.int64)
        here = np.repeat(least != most, np.diff(np.append(at, len(hashes))))
        rows = ws.answers(bits, keys[docs[here]], hashes[here])
        for a, b in ws.ranges(ws.runs(buckets), len(buckets)):
            names, index = np.unique(least[a:b], return_inverse=True)
            rows.append((int(buckets[a]), False, ws.pack(sent[a:b].astype(np.uint32), index.astype(np.uint32 if len(names) > 65535 else np.uint16), keys[names], np.minimum(many[a:b], 65535).astype(np.uint16))))
        yield ws.dealt(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, keys, size, known = [], [], [], 0, 0
        for batch in batches:
            row_keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            for lo, hi, part, _, starts, ends, first in _texts(batch, "text"):
                at, grams = _anchors(ws.word_hashes(part, starts, ends), first, seed_words, span)
                hashes.append(grams >> shift)
                docs.append(_owners(first, at) + known)
                keys.append(row_keys[lo:hi])
                known += hi - lo
                size += len(at)
                if size >= FLUSH:
                    yield from flush(np.concatenate(hashes), np.concatenate(docs), np.concatenate(keys))
                    hashes, docs, keys, size, known = [], [], [], 0, 0
        if size:
            yield from flush(np.concatenate(hashes), np.concatenate(docs), np.concatenate(keys))

    return run


def _seed_reduce(bits: int):
    """Back to documents go the anchors that several hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in ws.buckets(batches):
            if bucket is None:
                yield blobs
                continue
            low = np.concatenate([b[0] for b in blobs])
            keys = np.concatenate([b[2][b[1]] for b in blobs])
            many = np.concatenate([b[3] for b in blobs]).astype(np.int64)
            order = np.argsort(low, kind="stable")
            low, keys, many = low[order], keys[order], many[order]
            at = ws.runs(low)
            total = np.add.reduceat(many, at)
            size = np.diff(np.append(at, len(low)))
            here = np.repeat((np.minimum.reduceat(keys, at) != np.maximum.reduceat(keys, at)) | (total > size), size)
            anchors = low.astype(np.uint64) | (np.uint64(bucket) << np.uint64(32))
            rows = ws.answers(bits, keys[here], anchors[here])
            for a in np.flatnonzero((total > HOT) & (total * HOT_SHARE > total.sum())).tolist():
                rows.append((-1, True, ws.pack(anchors[at[a] : at[a] + 1].view(np.int64))))
            yield ws.dealt(rows)

    return run


# --- extension ------------------------------------------------------------------------------------------------------

def _same(*columns: np.ndarray) -> np.ndarray:
    """Which rows equal the row before them."""
    same = np.zeros(len(columns[0]), bool)
    same[1:] = np.logical_and.reduce([(c[1:] == c[:-1]) if c.ndim == 1 else (c[1:] == c[:-1]).all(axis=1) for c in columns])
    return same


def _mixed(anchors: np.ndarray, context: np.ndarray) -> np.ndarray:
    out = anchors.copy()
    for j in range(context.shape[1]):
        out = ws.mix64((out ^ context[:, j]) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _context(words: np.ndarray, first: np.ndarray, at: np.ndarray, seed_words: int, reach: int) -> np.ndarray:
    """32 bits of each of the words beside anchors, 0 beyond the text: the nearest on the left first, then on the right."""
    owner = _owners(first, at)
    out = np.zeros((len(at), 2 * reach), np.uint32)
    short = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for j in range(reach):
        for column, place, inside in ((j, at - 1 - j, at - 1 - j >= first[owner]), (reach + j, at + seed_words + j, at + seed_words + j < first[owner + 1])):
            out[inside, column] = short[place[inside]]
    return out


def _extend_map(bits: int, seed_words: int, span: int, hot: np.ndarray, id_col: str, text_col: str):
    shift, reach = np.uint64(32 - bits), span - seed_words
    spread = 0x9E3779B97F4A7C15

    def flush(anchors, context, docs, places, ids, keys) -> Iterator[pa.RecordBatch]:
        """Folds equal contexts of an anchor: documents after the first are answered here, whatever the extension."""
        if len(hot):
            known = hot[np.minimum(np.searchsorted(hot, anchors >> shift), len(hot) - 1)] == anchors >> shift
            parts = [(anchors[~known], context[~known], docs[~known], places[~known])]
            for left in range(reach + 1):
                one = np.zeros((int(known.sum()), 2 * reach), np.uint32)
                used = [*range(left), *range(reach, 2 * reach - left)]
                one[:, used] = context[known][:, used]
                whole = (one[:, used] != 0).all(axis=1)
                parts.append((_mixed(anchors[known], one)[whole], one[whole], docs[known][whole], places[known][whole]))
            anchors, context, docs, places = (np.concatenate(x) for x in zip(*parts, strict=True))
        buckets = (anchors >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        held_by, key = ids[docs], _mixed(anchors, context)
        order = np.lexsort((held_by, key, buckets))
        anchors, context, docs, places, buckets, held_by, key = (x[order] for x in (anchors, context, docs, places, buckets, held_by, key))
        at = np.flatnonzero(~_same(key, anchors, context))
        least = np.repeat(held_by[at], np.diff(np.append(at, len(key))))
        later = held_by > least
        every = _available(context[later], reach)
        rows = ws.answers(bits, keys[docs[later]], held_by[later], (places[later].astype(np.uint64) << np.uint64(16)) | every)
        anchors, context, docs, places, buckets = (x[~later] for x in (anchors, context, docs, places, buckets))
        for a, b in ws.ranges(ws.runs(buckets), len(buckets)):
            names, index = np.unique(docs[a:b], return_inverse=True)
            rows.append((int(buckets[a]), False, ws.pack(anchors[a:b], context[a:b].ravel(), index.astype(np.uint32 if len(names) > 65535 else np.uint16), ids[names], keys[names], places[a:b])))
        yield ws.dealt(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, 0
        for batch in batches:
            usable = np.asarray(batch.column(id_col).is_valid()) & np.asarray(batch.column(text_col).is_valid())
            batch = batch.filter(pa.array(usable))
            ids, keys = batch.column(id_col).cast(pa.int64()).to_numpy(), batch.column("_row_key").to_numpy()
            seeds = batch.column("_seeds")
            for lo, hi, part, _, starts, ends, first in _texts(batch, text_col):
                words = ws.word_hashes(part, starts, ends)
                at, grams = _anchors(words, first, seed_words, span)
                owner = _owners(first, at)
                wanted = [np.frombuffer(seeds[i].as_buffer(), np.uint64) + np.uint64((i - lo) * spread & (1 << 64) - 1) for i in range(lo, hi)]
                shared = np.isin((grams >> shift) + owner.astype(np.uint64) * np.uint64(spread), np.concatenate(wanted))
                at, grams, owner = at[shared], grams[shared], owner[shared]
                for i in range(0, len(at), CONTEXTS):
                    some = slice(i, i + CONTEXTS)
                    held.append((grams[some], _context(words, first, at[some], seed_words, reach), owner[some] + known, (at[some] - first[owner[some]]).astype(np.uint32), ids[lo:hi] if i == 0 else ids[:0], keys[lo:hi] if i == 0 else keys[:0]))
                known += hi - lo if len(at) else 0
                size += len(at)
                if size >= CONTEXTS:
                    yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size, known = [], 0, 0
        if size:
            yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _available(context: np.ndarray, reach: int) -> np.ndarray:
    """Of each occurrence: the extensions (bit ``l``: ``l`` words to the left) for which its text has words enough."""
    out = np.zeros(len(context), np.uint64)
    for left in range(reach + 1):
        out |= (context[:, [*range(left), *range(reach, 2 * reach - left)]] != 0).all(axis=1).astype(np.uint64) << np.uint64(left)
    return out


def _extend_reduce(bits: int, reach: int):
    def answer(blobs: list[list[np.ndarray]]) -> pa.RecordBatch:
        anchors = np.concatenate([b[0] for b in blobs])
        context = np.concatenate([b[1].reshape(-1, 2 * reach) for b in blobs])
        ids = np.concatenate([b[3][b[2]] for b in blobs])
        keys = np.concatenate([b[4][b[2]] for b in blobs])
        places = np.concatenate([b[5] for b in blobs])
        blobs.clear()
        order = np.argsort(anchors, kind="stable")
        anchors = anchors[order]
        at = ws.runs(anchors)
        size = np.diff(np.append(at, len(anchors)))
        several = np.repeat(np.minimum.reduceat(ids[order], at) != np.maximum.reduceat(ids[order], at), size)
        order, anchors = order[several], anchors[several]
        context, ids, keys, places = context[order], ids[order], keys[order], places[order]
        available, found = _available(context, reach), np.zeros(len(anchors), np.uint64)
        for left in range(reach + 1):
            some = np.flatnonzero(available & np.uint64(1 << left))
            if not len(some):
                continue
            used = context[some][:, [*range(left), *range(reach, 2 * reach - left)]]
            key = _mixed(anchors[some], used)
            order = np.lexsort((ids[some], key))
            some, used, key = some[order], used[order], key[order]
            at = np.flatnonzero(~_same(key, anchors[some], used))
            least = np.repeat(ids[some][at], np.diff(np.append(at, len(some))))
            found[some[ids[some] > least]] |= np.uint64(1 << left)
        hit = found > 0
        return ws.dealt(ws.answers(bits, keys[hit], ids[hit], (places[hit].astype(np.uint64) << np.uint64(16)) | found[hit]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in ws.buckets(batches):
            yield blobs if bucket is None else answer(blobs)

    return run


# --- cut ------------------------------------------------------------------------------------------------------------


def _starts(found: np.ndarray, reach: int) -> np.ndarray:
    """First words of the repeated runs, from places of anchors and the extensions found."""
    place = (found >> np.uint64(16)).astype(np.int64)
    return np.unique(np.concatenate([place[found & np.uint64(1 << left) > 0] - left for left in range(reach + 1)]))


def _cut_map(span: int, seed_words: int, schema: pa.Schema, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("_found")
            data, offsets = ws.byte_view(batch.column(text))
            for lo, hi in ws.slices(offsets):
                part, at = data[offsets[lo] : offsets[hi]].copy(), offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = ws.word_bounds(part, at)
                edge = np.zeros(len(starts) + 1, np.int32)
                repeats: list[list[dict]] = []
                for i in range(lo, hi):
                    if not found[i].is_valid:
                        repeats.append([])
                        continue
                    where = _starts(np.frombuffer(found[i].as_buffer(), np.uint64), span - seed_words)
                    new = np.ones(len(where), bool)
                    new[1:] = np.diff(where) > span
                    a = where[new]
                    b = where[np.append(np.flatnonzero(new)[1:] - 1, len(where) - 1)] + span
                    np.add.at(edge, first[i - lo] + a, 1)
                    np.add.at(edge, first[i - lo] + b, -1)
                    repeats.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                kept = np.cumsum(edge[:-1]) == 0
                total = np.concatenate(([0], np.cumsum(kept)))
                n_words, n_kept = np.diff(first), np.diff(total[first])
                # a kept word goes with one separator, unless it is its text's last
                index = np.flatnonzero(kept)
                owner = np.searchsorted(first, index, side="right") - 1
                last = np.ones(len(index), bool)
                last[:-1] = owner[1:] != owner[:-1]
                part[ends[index][~last]] = 0x20
                open_ = np.zeros(len(part) + 2, np.int8)
                open_[starts[index]] += 1
                open_[ends[index] + ~last] -= 1
                inside = np.cumsum(open_[: len(part)], dtype=np.int8).astype(bool)
                cuts = np.concatenate(([0], np.cumsum(inside)))[at]
                new_text = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(part[inside])).cast(pa.string())
                slice_ = batch.slice(lo, hi - lo)
                if slice_.column(text).null_count:
                    new_text = pa.compute.if_else(slice_.column(text).is_valid(), new_text, pa.scalar(None, pa.string()))
                own = {text: new_text, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_words - n_kept, pa.int64()), "repeats": pa.array(repeats, schema.field("repeats").type)}
                yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else slice_.column(f.name) for f in schema], schema=schema)

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, seed_words: int = SEED_WORDS) -> DataFrame:
    """``docs`` with repeated runs of ``span`` words cut out of ``text_col`` (kept words joined by one space).

    Adds ``n_words``, ``n_removed`` and ``repeats``, the maximal repeats as word ranges [start, end) of the input text.
    """
    spark = docs.sparkSession
    ws.tune(spark)
    size = ws.text_bytes(docs, text_col)
    bits = ws.bits_for(size, BUCKET_BYTES)
    width = max(ws.shuffle_width(spark), 1 << bits)
    docs, names = ws.shield(docs.drop(*ADDED), ("_row_key", "_found", "_seeds", "_id"))
    keyed = docs.withColumn("_row_key", F.xxhash64(F.col(id_col), F.col(text_col)))
    taking_part = F.col(id_col).isNotNull() & F.col(text_col).isNotNull()

    def gathered(met: DataFrame, names: list[str], blob: str) -> DataFrame:
        home = met.repartition(width, "bucket").sortWithinPartitions("bucket")
        kinds = ", ".join(f"{n} long" for n in names)
        return home.mapInArrow(ws.gather(*names), f"{kinds}, blob binary").withColumnRenamed("blob", blob)

    def reduced(asked: DataFrame, reduce) -> DataFrame:
        return asked.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(reduce, ws.DEALT_TYPE)

    asked = keyed.where(taking_part).select(F.col("_row_key").alias("row_key"), F.col(text_col).alias("text")).mapInArrow(_seed_map(bits, seed_words, span), ws.DEALT_TYPE)
    met = saved(reduced(asked, _seed_reduce(bits)), "anchors")
    hot = [np.frombuffer(r["blob"], np.uint64)[-1] for r in met.where("bucket < 0").select("blob").collect()]  # at most HOT_SHARE a bucket
    seeds = gathered(met.where("bucket >= 0"), ["_row_key"], "_seeds")

    # the texts move once: both joins read this exchange, so neither may prune its columns
    placed = keyed.repartition(width, "_row_key")
    asked = placed.join(seeds, "_row_key").mapInArrow(_extend_map(bits, seed_words, span, np.sort(np.array(hot, np.uint64)), id_col, text_col), ws.DEALT_TYPE)
    found = gathered(reduced(asked, _extend_reduce(bits, span - seed_words)), ["_row_key", "_id"], "_found")

    # only the row key is a join key, as above; the id beside it guards against equal hashes
    joined = placed.join(found, (placed["_row_key"] == found["_row_key"]) & (placed[id_col].cast("long") - found["_id"] == 0), "left").drop(found["_row_key"]).drop("_id")
    out = T.StructType([*[f for f in docs.schema.fields], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    return joined.drop("_row_key").mapInArrow(_cut_map(span, seed_words, to_arrow_schema(out), text_col), out).withColumnsRenamed(names)
