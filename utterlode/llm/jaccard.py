"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of its distinct ``k``-word shingles (with fewer words: its whole word sequence as one shingle).

1. *Classes.* Documents with equal sets fall into one class by a 128-bit signature of the set; classes take part below,
   so thousands of copies count as one.
2. *Rarity.* Shingles are counted over classes in hash buckets: a task sends its shingles as packed arrays, 6 bytes of
   name each, and the bucket answers with the counts of those that two classes or more hold. The number of buckets
   follows the number of shingles (``BUCKET`` each), so a bucket stays as small as it is however large the table. A shingle
   that alone would fill an eighth of a bucket is found beforehand by summing counts of slices (``_heavy``), ranks last,
   and never travels to a bucket. A shingle that one class holds alone comes first in the rare-first order and can match
   nothing, so its name is never sent back.
3. *Prefixes.* Of ``n`` shingles in rare-first order, the first ``n - ceil(t n) + 1`` make the prefix; lone shingles use
   it up first, and a class without a prefix left cannot be similar to any other.
4. *Candidates.* Classes meet on prefix shingles and pass the length and positional filters. First each class meets, in
   each of its posting lists, the class that has the fewest shingles rarer than this one, which is the most central: a
   copy's own edits are rare shingles, its original has none (as many pairs as postings at most). Pairs inside one
   component need no further look, and then all pairs of a posting list that lie in different components are formed; a
   list beyond ``BLOCK`` classes is cut into blocks that meet in pairs. So components are exact, and a big group of near
   copies gives no square of pairs.
5. *Verification*, once per pair: the suffix filter, then the intersection over all shared shingles.

Sets are told apart by 64 bits a shingle, shared shingles by 52 to 56 bits: two sets of 1000 shingles seem to share one
that they don't with a chance of 1e-10 or less.

Edge cases: a null or wordless text has an empty set and links with nothing; a null id has its count but no component;
rows with one id are one node; repeated rows are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.spread import spread_join
from ..plans.durable import discard, saved
from . import wordstream as ws

K = 5
PERCENT = 80
OWNER_BITS = 12
#: Entries of a hash bucket, and bytes of shingles that a task of the later joins reads.
BUCKET, TASK_BYTES = 2 << 20, 64 << 20
#: A slice (up to 1000 rows or 2 MB) reports the shingles that so many of its classes hold.
OFTEN = 16
#: A shingle is heavy if it has more than one in ``BUCKET_PARTS * buckets`` of all entries; at most so many can be.
BUCKET_PARTS = 8
#: Classes of a posting list that meet in one task at once.
BLOCK = 4096
_SHIFT = np.uint64(56)
_HEAVY = np.uint64(255)


def _name_bits(bits: int) -> int:
    """Shingles are named by so many high bits of their hash: 6 bytes beside the ``bits`` of their bucket."""
    return min(56, 48 + bits)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows: (row, hash) of every distinct shingle, by row and hash."""
    data, offsets = ws.byte_view(batch.column("text"))
    limit = (1 << OWNER_BITS) - 1
    for first_row, last_row in ws.slices(offsets, 2 * ws.SLICE):
        for lo in range(first_row, last_row, limit):
            hi = min(last_row, lo + limit)
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, first = ws.word_bounds(part, at)
            words = ws.word_hashes(part, starts, ends, ws.LOWER_ASCII)
            counts = np.diff(first)
            hashes = ws.gram_hashes(words, k)[ws.whole_grams(first, k)]
            many = np.maximum(counts - k + 1, 0)
            rows = np.repeat(np.arange(hi - lo), many)
            for a, b in ws.ranges(np.cumsum(many) - many, len(hashes)):
                hashes[a:b].sort()
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
            hashes, rows = hashes[new], rows[new]
            short = np.flatnonzero((counts > 0) & (counts < k))
            if len(short):
                own = np.array([ws.gram_hashes(words[first[i] : first[i + 1]], int(counts[i]), 1000 + int(counts[i]))[0] for i in short], np.uint64)
                at = np.searchsorted(rows, short)
                rows, hashes = np.insert(rows, at, short), np.insert(hashes, at, own)
            yield lo, hi, rows, hashes


def _signatures(n_rows: int, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the size of its set, and two signatures."""
    edges = np.searchsorted(rows, np.arange(n_rows + 1))
    counts = np.diff(edges)

    def signature(seed: int) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ws.mix64(hashes + np.uint64(seed)))))
        return ws.mix64(sums[edges[1:]] - sums[edges[:-1]] + counts.astype(np.uint64)).view(np.int64)

    return counts, signature(1), signature(0x2545F4914F6CDD1D)


def _one_each(sigs: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which entries belong to the first row of each class of a slice."""
    _, unique = np.unique(sigs, return_index=True)
    one = np.zeros(len(sigs), bool)
    one[unique] = True
    return one[rows]


def _sign(k: int, bits: int):
    """Size and signatures of each row's set; a slice's first row carries the shingles that are frequent in it, and counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.int64()), ("sig2", pa.int64()), ("often", pa.binary())])
    drop = np.uint64(64 - _name_bits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, rows, hashes in _sets(batch, k):
                counts, sigs, more = _signatures(hi - lo, rows, hashes)
                names = np.sort(hashes[_one_each(sigs, rows)] >> drop)
                at = ws.runs(names)
                held_by = np.diff(np.append(at, len(names)))
                many = held_by >= OFTEN
                often = ws.pack(names[at[many]].view(np.int64), held_by[many]) if many.any() else None
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(sigs), pa.array(more), pa.array([often] + [None] * (hi - lo - 1), pa.binary())], schema=schema)

    return run


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("often").to_pylist():
            names, held_by = ws.unpack(blob)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(held_by, pa.int64())], names=["name", "held_by"])


def _heavy(signed: DataFrame, total: int, bits: int) -> np.ndarray:
    """Names of the heavy shingles, sorted: ``BUCKET_PARTS << bits`` at most, as their shares add up to no more than all."""
    counts = signed.where("often is not null").select("often").mapInArrow(_reported, "name long, held_by long").groupBy("name").agg(F.sum("held_by").alias("held_by"))
    rows = counts.where(F.col("held_by") * (BUCKET_PARTS << bits) > total).select("name").collect()
    return np.sort(np.array([r["name"] for r in rows], np.int64).view(np.uint64))


def _deal(k: int, bits: int, heavy: np.ndarray):
    """Each slice's shingles, dealt to buckets: low name bits, index of the class, classes. Heavy ones are answered here."""
    drop, width = np.uint64(64 - _name_bits(bits)), np.uint64(_name_bits(bits) - bits)
    low = np.uint64((1 << 48) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, rows, hashes in _sets(batch, k):
                _, sigs, _ = _signatures(hi - lo, rows, hashes)
                one = _one_each(sigs, rows)
                names, rows = hashes[one] >> drop, rows[one]
                out = []
                if len(heavy):
                    known = heavy[np.minimum(np.searchsorted(heavy, names), len(heavy) - 1)] == names
                    out += ws.answers(bits, sigs[rows[known]], (_HEAVY << _SHIFT) | names[known])
                    names, rows = names[~known], rows[~known]
                bucket = (names >> width).astype(np.uint16 if bits <= 16 else np.uint32)
                order = np.argsort(bucket, kind="stable")  # rows stay in order within a bucket
                bucket, names, rows = bucket[order], names[order] & low, rows[order]
                cuts = ws.runs(bucket)
                for a, b in ws.ranges(cuts, len(bucket)):
                    owners, index = np.unique(rows[a:b], return_inverse=True)
                    out.append((int(bucket[a]), False, ws.pack(names[a:b].astype(np.uint32), (names[a:b] >> np.uint64(32)).astype(np.uint16), index.astype(np.uint16), sigs[owners])))
                yield ws.dealt(out)

    return run


def _rank(df: np.ndarray) -> np.ndarray:
    """Counts on a scale of 254 steps, exact up to 127: any order that all classes share makes a prefix filter."""
    steps = np.where(df <= 127, df, 127 + 4 * np.log2(np.maximum(df, 1) / 127))
    return np.minimum(steps, 254).astype(np.uint64)


def _count(bits: int):
    """In a bucket: how many classes hold each shingle; back to each class go those that another one holds too."""
    width = np.uint64(_name_bits(bits) - bits)

    def answer(bucket: int, blobs: list[list[np.ndarray]]) -> pa.RecordBatch:
        low = np.concatenate([b[0].astype(np.uint64) | (b[1].astype(np.uint64) << np.uint64(32)) for b in blobs])
        sigs = np.concatenate([b[3][b[2]] for b in blobs])
        blobs.clear()
        order = np.argsort(low, kind="stable")
        low, sigs = low[order], sigs[order]
        at = ws.runs(low)
        size = np.diff(np.append(at, len(low)))
        many = np.repeat(size > 1, size)
        low, sigs = low[many], sigs[many]
        order = np.lexsort((sigs, low))
        low, sigs = low[order], sigs[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (sigs[1:] != sigs[:-1])
        low, sigs = low[new], sigs[new]
        at = ws.runs(low)
        size = np.diff(np.append(at, len(low)))
        df = np.repeat(size, size)
        low, sigs, df = low[df > 1], sigs[df > 1], df[df > 1]
        # rare first: by count, then by name
        return ws.dealt(ws.answers(bits, sigs, (_rank(df) << _SHIFT) | (np.uint64(bucket) << width) | low))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in ws.buckets(batches):
            yield blobs if bucket is None else answer(bucket, blobs)

    return run


def _prefixes(percent: int):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("shared", pa.binary()), ("prefix", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, n, blob in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                keys = np.unique(np.frombuffer(blob, np.uint64))  # slices that hold copies of a class each answer heavy ones
                prefix = len(keys) - (percent * n + 99) // 100 + 1
                if prefix > 0:
                    out.append((node, n, keys.tobytes(), prefix))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], schema.field(c).type) for c in range(4)], schema=schema)

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("shingle", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("place", pa.int64())])
    for batch in batches:
        for node, n, shared, prefix in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "shared", "prefix")), strict=True):
            keys = np.frombuffer(shared, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:prefix]), pa.array(np.full(prefix, node)), pa.array(np.full(prefix, n)), pa.array(np.arange(prefix) + (n - len(keys)))], schema=schema)


def _filters(percent: int, n_a: str, n_b: str, place_a: str, place_b: str):
    """Length and positional filters; the need is the smallest intersection that makes the pair similar."""
    need = f"ceil({percent}D * ({n_a} + {n_b}) / {100 + percent} - 1e-9D)"
    return F.expr(f"100 * least({n_a}, {n_b}) >= {percent} * greatest({n_a}, {n_b}) and 1 + least({n_a} - {place_a}, {n_b} - {place_b}) - 1 >= {need}")


def _across(percent: int):
    """Pairs of one shingle's postings whose components differ; rows come by shingle, pair of blocks and component."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    block = 1 << 18

    def pairs(i, j, own, label, node, n, place) -> Iterator[pa.RecordBatch]:
        one_block = i[0] == j[0]
        at = ws.runs(label)
        size = np.diff(np.append(at, len(label)))
        beyond = np.repeat(np.append(at[1:], len(label)), size)
        many = len(label) - beyond
        total, i = np.concatenate(([0], np.cumsum(many))), 0
        while i < len(many) and total[i] < total[-1]:
            j = max(i + 1, int(np.searchsorted(total, total[i] + block, side="right")) - 1)
            x = np.repeat(np.arange(i, j), many[i:j])
            y = np.arange(len(x)) - np.repeat(total[i:j] - total[i], many[i:j]) + beyond[x]
            least, most = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            near = (100 * least >= percent * most) & (np.minimum(n[x] - place[x], n[y] - place[y]) * (100 + percent) >= percent * (n[x] + n[y]))
            if not one_block:
                near &= own[x] != own[y]
            x, y = x[near], y[near]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], schema=schema)
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("shingle", "i", "j", "own", "label", "node", "n", "place")
        held = [np.zeros(0, np.int64)] * len(names)
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names, strict=True)]
            new = np.ones(len(held[0]), bool)
            new[1:] = np.logical_or.reduce([h[1:] != h[:-1] for h in held[:3]])
            cuts = np.flatnonzero(new)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield from pairs(*(h[a:b] for h in held[1:]))
            if len(cuts):
                held = [h[cuts[-1] :] for h in held]
        if len(held[0]):
            yield from pairs(*held[1:])

    return run


def _room(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """Suffix filter: at most so many shingles are common, by splitting both at the middle of one."""
    if depth == 0 or len(x) < 8 or len(y) < 8:
        return min(len(x), len(y))
    middle = len(y) // 2
    cut = int(np.searchsorted(x, y[middle]))
    return _room(x[:cut], y[:middle], depth - 1) + _room(x[cut:], y[middle:], depth - 1)


def _verify(percent: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (n_a, n_b, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "x", "y")), strict=True)):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                need = -(-percent * (n_a + n_b) // (100 + percent))
                if _room(x, y, 3) >= need:
                    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                    good[i] = 100 * common >= percent * (n_a + n_b - common)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], schema=schema)

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row: the smallest id that links of similarity ``percent`` reach."""
    spark = docs.sparkSession
    ws.tune(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a shingle takes 2 bytes of text at least, 6 or so as a rule
    bits = ws.bits_for(ws.text_bytes(texts, "text") // 5, BUCKET)

    signed = saved(texts.mapInArrow(_sign(k, bits), "doc_id long, n_shingles long, sig long, sig2 long, often binary"), "signed")
    sums = signed.agg(F.sum("n_shingles").alias("entries"), F.count_if(F.col("n_shingles") > 0).alias("rows")).first()
    entries, tasks = sums["entries"] or 0, max(ws.shuffle_width(spark), 1 << bits)
    heavy = _heavy(signed, entries, bits)
    whole = signed.where("n_shingles > 0").withColumn("sig", F.struct("sig", "sig2"))
    classes = saved(whole.groupBy("sig").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.count("*").alias("copies")), "classes")

    met = (
        texts.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(_deal(k, bits, heavy), ws.DEALT_TYPE)
        .repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(bits), ws.DEALT_TYPE)
    )
    counted = met.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(ws.gather("name"), "name long, blob binary")
    known = classes.where("node is not null").select(F.col("sig.sig").alias("name"), "node", "n").repartition(tasks, "name")
    vectors = saved(counted.repartition(tasks, "name").join(known, "name").select("node", "n", "blob").mapInArrow(_prefixes(percent), "node long, n long, shared binary, prefix long"), "vectors")
    postings = saved(vectors.mapInArrow(_postings, "shingle long, node long, n long, place long"), "postings")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = saved(pairs.distinct(), "pairs")
        width = ws.tasks_for(spark, pairs.count() * 16 * (entries // max(1, sums["rows"]) + 1), TASK_BYTES)
        left = vectors.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("x")).repartition(width, "a")
        right = vectors.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("y")).repartition(width, "b")
        found = saved(pairs.repartition(width, "a").join(left, "a").repartition(width, "b").join(right, "b").mapInArrow(_verify(percent), "src long, dst long"), "edges")
        discard(pairs)
        return found

    leaders = postings.groupBy("shingle").agg(F.min(F.struct("place", "n", "node")).alias("first"), F.count("*").alias("size")).where("size > 1")
    met = postings.join(leaders, "shingle").where("node <> first.node").where(_filters(percent, "n", "first.n", "place", "first.place"))
    near = verified(met.select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b")))
    labels = connected_components(near)

    placed = postings.join(labels, "node", "left").select("shingle", "node", "n", "place", F.coalesce("component", "node").alias("label"))
    open_lists = placed.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    dealt = placed.join(open_lists, "shingle").withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "label", "node", "n", "place")
    width = ws.shuffle_width(spark)
    apart = dealt.repartition(width, "shingle", "i", "j").sortWithinPartitions("shingle", "i", "j", "label").mapInArrow(_across(percent), "a long, b long")
    far = verified(apart)
    final = connected_components(near.union(far))

    groups = saved(classes.join(final, "node", "left").select("sig", F.coalesce("component", "node").alias("component"), "copies"), "groups")
    for table in (postings, vectors, near, far, labels, final, classes):
        discard(table)
    placed = spread_join(whole, groups, "sig", "copies", sums["rows"], width)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    return placed.select("doc_id", "n_shingles", own).unionByName(signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
