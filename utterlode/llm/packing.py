"""Best-fit packing by linear grouping.

1. *Pieces.* Texts become token ids plus a closing id; only documents beyond the capacity are cut, into full pieces.
2. *Grouping.* Lengths above a fraction of the capacity are sorted and split into groups of equal cardinality, and each is rounded
   up to its group's largest, so few sizes remain. The configurations (multisets of sizes that fit in a sequence) that
   cover the groups with fewest sequences come from the Gilmore-Gomory linear program by column generation, rounded down.
3. *Substitution.* The actual documents take the slots of their group, largest first; what rounding up held free is free
   again.
4. *Best fit.* What is left, large ones first and then the small ones by length, goes where it leaves least room.

Steps 2 to 4 only need the histogram of piece lengths, which has at most ``capacity`` rows whatever the corpus; all
pieces of one length are interchangeable. So the driver plans over the histogram, the plan says for each length which
range of its pieces goes where, and the pieces, numbered within their length in parallel, look their place up.

Edge cases: a null or empty text is one piece, the closing id alone; repeated rows and null ids are packed like others;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import saved
from . import wordstream as ws

CAPACITY = 2048
#: Of these (large lengths are above capacity / the first; groups), the plan with the fewest sequences is taken.
GROUPINGS = ((2, 32), (3, 32), (4, 64), (8, 64))
#: Pieces of one length are numbered in cells of about so many.
CELL = 100_000
CLOSING_ID = 0

# --- token ids ------------------------------------------------------------------------------------------------------


#: ASCII letters 1, ASCII signs but for the apostrophe 2, white space 0, all else 8.
_KIND = np.array([0 if not ws.WORD_BYTES[b] else 1 if b < 128 and chr(b).isalpha() else 2 if 0x20 < b < 0x7F and not chr(b).isdigit() and b != 0x27 else 8 for b in range(256)], np.uint8)
#: How the vocabulary's special tokens begin; texts that hold this are cut at white space only, and keep their case.
_SPECIAL = b"<|"


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Stretches that are tokenized by themselves, and the folding under which equal ones have equal ids.

    The tokenizer drops white space, takes letters and signs apart (contractions aside, hence no cut beside an
    apostrophe) and folds case before it merges, so a text's ids are those of its stretches in order.
    """
    starts, ends, first = ws.word_bounds(data, offsets)
    if _SPECIAL in data.tobytes():
        return starts, ends, first, None
    kind = _KIND[data]
    cut = np.flatnonzero(kind[:-1] + kind[1:] == 3) + 1
    mark = np.zeros(len(data) + 1, bool)
    mark[starts], mark[cut] = True, True
    begin = np.flatnonzero(mark)
    mark[:] = False
    mark[ends], mark[cut] = True, True
    return begin, np.flatnonzero(mark), np.searchsorted(begin, offsets), ws.LOWER_ASCII


class WordIds:
    """Token ids of stretches of text, kept in a table by their hash; a check beside it tells apart what one hash holds."""

    SLOTS, MOST_IDS, JOIN = 22, 12_000_000, 1 << 15

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.key = np.zeros(1 << self.SLOTS, np.uint64)
        self.check = np.zeros(1 << self.SLOTS, np.uint64)
        self.at = np.zeros(1 << self.SLOTS, np.int32)
        self.n = np.zeros(1 << self.SLOTS, np.int32)
        self.clear()

    def clear(self) -> None:
        self.key[:], self.check[:] = 0, 0
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 1
        self.ids[0] = CLOSING_ID

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        ids, counts, i = [], [], 0
        while i < len(words):
            size, j = 0, i
            while j < len(words) and (j == i or size < self.JOIN):
                size += len(words[j]) + 1
                j += 1
            texts = [w.decode() for w in words[i:j]]
            begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
            found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            starts = np.fromiter((x[0] for x in found.offsets), np.int64, len(found.offsets))
            counts.append(np.bincount(np.searchsorted(begin, starts, side="right") - 1, minlength=j - i))
            i = j
        return np.concatenate(ids), np.concatenate(counts)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids begin in ``self.ids``, and how many there are."""
        if self.used > self.MOST_IDS:
            self.clear()
        hashes, checks = ws.word_hashes(data, starts, ends, fold), ws.word_checks(data, starts, ends, fold)
        slot = hashes >> np.uint64(64 - self.SLOTS)
        missing = np.flatnonzero((self.key[slot] != hashes) | (self.check[slot] != checks))
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        if len(missing):
            order = missing[np.lexsort((checks[missing], hashes[missing]))]
            first = np.ones(len(order), bool)
            first[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (checks[order[1:]] != checks[order[:-1]])
            where, back = order[first], np.cumsum(first) - 1
            raw = data.tobytes()
            ids, counts = self._encode([raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
            begin = self.used + np.concatenate(([0], np.cumsum(counts)[:-1]))
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            at[order], n[order] = begin[back], counts[back]
            slot = hashes[where] >> np.uint64(64 - self.SLOTS)
            self.key[slot], self.check[slot], self.at[slot], self.n[slot] = hashes[where], checks[where], begin, counts
        return at, n


_known: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _known.setdefault(path, None) or WordIds(path)
        _known[path] = table
        for batch in batches:
            data, offsets = ws.byte_view(batch.column("text"))
            names = batch.column("doc_id")
            for lo, hi in ws.slices(offsets):
                part, cut = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first, fold = units(part, cut)
                at, n = table.find(part, starts, ends, fold)
                at, n = np.insert(at, first[1:], 0), np.insert(n, first[1:], 1)  # the closing id ends each document
                total = np.concatenate(([0], np.cumsum(n)))
                ids = table.ids[np.repeat(at - total[:-1], n) + np.arange(total[-1])].astype("<u4")
                begin = total[first + np.arange(len(first))]
                counts = -(-np.diff(begin) // capacity)
                owner = np.repeat(np.arange(hi - lo), counts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(np.diff(begin)[owner] - start, capacity)
                raw = memoryview(ids).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((begin[owner] + start).tolist(), (begin[owner] + start + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names.slice(lo, hi - lo).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(sums, pa.int64())], schema=schema)

    return run


# --- the plan -------------------------------------------------------------------------------------------------------


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    by_size, by_worth = sizes[order], worth[order]
    fits = np.searchsorted(by_size, np.arange(capacity + 1), side="right")
    for room in range(int(by_size[0]), capacity + 1):
        values = best[room - by_size[: fits[room]]] + by_worth[: fits[room]]
        top = int(values.argmax())
        if values[top] > best[room - 1] + 1e-12:
            best[room], pick[room] = values[top], top
        else:
            best[room] = best[room - 1]
    chosen, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            chosen[order[pick[room]]] += 1
            room -= int(by_size[pick[room]])
    return float(best[capacity]), chosen


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(how many sequences, how many of each size in one) from the linear program, rounded down."""
    basis = np.diag(np.floor(capacity / sizes))
    for _ in range(20 * len(sizes)):
        inverse = np.linalg.inv(basis)
        value, column = _best_configuration(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        level, step = inverse @ demand, inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(level, 0) / step, np.inf)
        basis[:, int(ratio.argmin())] = column
    return [(int(np.floor(x + 1e-9)), basis[:, j].astype(int)) for j, x in enumerate(np.linalg.solve(basis, demand.astype(float))) if x >= 1]


class Plan:
    """Rows: pieces ``first .. first + bins * each`` of a length go, ``each`` by ``each``, to consecutive sequences."""

    def __init__(self, histogram: dict[int, int], capacity: int, large: int, groups: int) -> None:
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.next = dict.fromkeys(histogram, 0)
        self.left = {k: v for k, v in histogram.items() if v}
        self.capacity, self.sequences = capacity, 0
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self._group(groups, capacity // large)
        self._best_fit()

    def _place(self, length: int, bins: int, each: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.next[length], bins, each, sequence, offset))
        self.next[length] += bins * each
        self.left[length] -= bins * each

    def _group(self, groups: int, large: int) -> None:
        lengths = sorted((k for k in self.left if large < k <= self.capacity), reverse=True)
        total = sum(self.left[k] for k in lengths)
        if not total:
            return
        share, members = -(-total // groups), []  # of each group: runs (length, count), longest first
        free = 0
        for k in lengths:
            n = self.left[k]
            while n:
                if not free:
                    members.append([])
                    free = share
                take = min(n, free)
                members[-1].append((k, take))
                n, free = n - take, free - take
        by_size: dict[int, list[tuple[int, int]]] = {}
        for runs in members:
            by_size.setdefault(runs[0][0], []).extend(runs)
        sizes = np.array(list(by_size))
        queues = [list(reversed(runs)) for runs in by_size.values()]
        demand = np.array([sum(n for _, n in runs) for runs in by_size.values()])
        for bins, configuration in configurations(sizes, demand, self.capacity):
            open_ = [(self.sequences, bins, 0)]
            self.sequences += bins
            for group, slots in enumerate(configuration.tolist()):
                for _ in range(slots):
                    after = []
                    for sequence, n, used in open_:
                        while n and queues[group]:
                            length, count = queues[group].pop()
                            take = min(n, count)
                            if count > take:
                                queues[group].append((length, count - take))
                            self._place(length, take, 1, sequence, used)
                            after.append((sequence, take, used + length))
                            sequence, n = sequence + take, n - take
                        if n:
                            after.append((sequence, n, used))
                    open_ = after
            for sequence, n, used in open_:
                self.room[self.capacity - used].append((sequence, n))

    def _best_fit(self) -> None:
        for length in sorted((k for k, n in self.left.items() if n), reverse=True):
            room = length
            while self.left[length]:
                while room <= self.capacity and not self.room[room]:
                    room += 1
                if room > self.capacity:
                    each = self.capacity // length
                    self.room[self.capacity].append((self.sequences, -(-self.left[length] // each)))
                    self.sequences += -(-self.left[length] // each)
                    room = self.capacity
                sequence, bins = self.room[room].pop()
                each = min(room // length, self.left[length])
                take = min(bins, self.left[length] // each)
                if bins > take:
                    self.room[room].append((sequence + take, bins - take))
                self._place(length, take, each, sequence, self.capacity - room)
                if room - each * length:
                    self.room[room - each * length].append((sequence, take))


def _assign(rows: list[tuple[int, int, int, int, int, int]]):
    length, first, _, each, sequence, offset = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True))
    keys = (length << 44) | first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, number = batch.column("length").to_numpy().astype(np.int64), batch.column("_number").to_numpy()
            row = np.searchsorted(keys, (own << 44) | number, side="right") - 1
            step = number - first[row]
            columns = {"sequence_id": sequence[row] + step // each[row], "offset": offset[row] + step % each[row] * own}
            kept = [c for c in batch.schema.names if c != "_number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v) for v in columns.values())], [*kept, *columns])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece; ``tokenizer`` is the path of a
    vocabulary whose tokens never hold white space."""
    spark = docs.sparkSession
    ws.tune(spark)
    kinds = "doc_id long, piece int, start long, length int, ids_crc32 long"
    pieces = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(tokenizer, capacity), kinds), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    spread = max(1, -(-max(histogram.values(), default=0) // CELL))
    dealt = pieces.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread)))
    cells = dealt.groupBy("length", "_cell").agg(F.count("*").alias("n"))
    plan = min((Plan(histogram, capacity, large, groups) for large, groups in GROUPINGS), key=lambda p: p.sequences)
    if not plan.rows:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    ahead = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "_cell").orderBy("doc_id", "piece"))
    numbered = dealt.withColumn("_rank", rank).join(cells, ["length", "_cell"]).select(*pieces.columns, (F.col("_rank") + F.col("_ahead") - 1).alias("_number"))
    return numbered.mapInArrow(_assign(plan.rows), f"{kinds}, sequence_id long, offset long")
