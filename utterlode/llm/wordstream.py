"""Vectorised word handling for Arrow batches of text.

Everything here works on the UTF-8 bytes of whole texts with numpy, so that the operators on words pay a few
nanoseconds a byte and never build a Python string per word. Texts are taken in slices of about ``SLICE`` bytes, which
bounds the memory of a worker whatever the size of an Arrow batch; a longer text makes a slice of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 20
_MASK = (1 << 64) - 1


_settled: list[bool] = []


def _settle_worker() -> None:
    """Python workers live on between tasks: have them return large freed arrays to the system at once.

    By default glibc raises the size from which it maps memory to 32 MB as arrays are freed, and keeps what lies below;
    Arrow's own pool keeps freed memory too. Only done inside a task; the driver's process is left alone.
    """
    _settled.append(True)
    if TaskContext.get() is None:
        return
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):  # not glibc
        return
    mmap_threshold, arena_max = -3, -8  # fixed values of malloc.h
    mallopt(mmap_threshold, 1 << 20)
    mallopt(arena_max, 2)


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get: rows may hold texts of any length.

    Plans run after this returns, so the session keeps these bounds; smaller ones that it has stay.
    """
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = (spark.conf.get(key) or "").rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def tasks_for(spark: SparkSession, amount: int, each: int) -> int:
    """Shuffle partitions so that each gets about ``each`` of ``amount``, and not fewer than the session's."""
    return max(shuffle_width(spark), -(-amount // each))


def bits_for(amount: int, each: int) -> int:
    """Hash buckets, as a power of two and 4 at least, so that each gets about ``each`` of ``amount``."""
    return max(2, (-(-amount // each) - 1).bit_length())


def free(name: str, taken) -> str:
    """``name``, or a name made of it that is not ``taken``."""
    while name in taken:
        name = f"_{name}"
    return name


def shield(df: DataFrame, reserved: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns that bear an operator's internal names renamed, and the names to give back."""
    back, taken = {}, {*df.columns, *reserved}
    for name in [c for c in df.columns if c in reserved]:
        other = free(f"_{name}", taken)
        taken.add(other)
        back[other], df = name, df.withColumnRenamed(name, other)
    return df, back


# --- slices ---------------------------------------------------------------------------------------------------------


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (one more than rows) of a string or binary column; a null counts as empty."""
    if not _settled:
        _settle_worker()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts take about ``limit`` bytes together."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


# --- words ----------------------------------------------------------------------------------------------------------


def byte_class(members: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(members)] = False
    return table


#: Words are runs of anything but these.
WORD_BYTES = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Folds A-Z only.
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[ord("A") : ord("Z") + 1] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, members: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each row's first word (one more than rows)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = members[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = inside[inner]  # a text's first byte starts a word whatever the text before it ended with
    last[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Of the last lane of a word, the bytes that belong to it.
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 1024


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every process; ``fold`` maps bytes first.

    Words are taken in lanes of 8 bytes, each mixed non-linearly into the state, so no arrangement of letters cancels
    out. Words of one length of at most 8 bytes never collide: every step is a bijection.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros((len(data) + 7) // 8 * 8 + 16, np.uint8)
    padded[: len(data)] = data if fold is None else fold[data]
    whole, size = padded.view("<u8"), ends - starts
    out = mix64(size.astype(np.uint64) + np.uint64(seed))
    at, left, rows = starts, np.where(size > _LONG, 0, size), None
    while True:
        lane, turn = at >> 3, ((at & 7) << 3).astype(np.uint64)
        here = ((whole[lane] >> turn) | ((whole[lane + 1] << np.uint64(1)) << (np.uint64(63) - turn))) & _TAIL[np.minimum(left, 8)]
        if rows is None:
            out = mix64((out ^ here) * _ODD)
        else:
            out[rows] = mix64((out[rows] ^ here) * _ODD)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        at, left, rows = at[more] + 8, left[more] - 8, more if rows is None else rows[more]
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return out


def word_checks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """With ``word_hashes``, tells words apart: the length of those of at most 8 bytes, a second 64-bit hash of others."""
    out = ends - starts
    long_ = np.flatnonzero(out > 8)
    out = out.astype(np.uint64)
    out[long_] = word_hashes(data, starts[long_], ends[long_], fold, seed=0x5851F42D4C957F2D) | np.uint64(1 << 63)
    return out


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each ``k`` consecutive words, at its first word; runs over rows' ends must be masked by the caller."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = np.uint64((0x9E3779B97F4A7C15 + 2 * seed) & _MASK)
    out = words[:n] + np.uint64(seed)
    for j in range(1, k):
        out = out * step + words[j : j + n]
    return mix64(out)


def whole_grams(first_word: np.ndarray, k: int) -> np.ndarray:
    """Which word positions start ``k`` words of one row (for ``len(words) - k + 1`` positions)."""
    counts = np.diff(first_word)
    room = np.repeat(first_word[1:], counts) - np.arange(int(first_word[-1] - first_word[0]))
    return room[: max(0, len(room) - k + 1)] >= k


# --- blobs ----------------------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one binary value: a count, then for each its length and dtype, then the bytes."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), ord(a.dtype.kind), a.dtype.itemsize))], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 3 * n, 8).reshape(n, 3)
    out, at = [], 8 + 24 * n
    for length, kind, width in head.tolist():
        out.append(np.frombuffer(blob, np.dtype(f"{chr(kind)}{width}"), length, at))
        at += length * width
    return out


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """The index at which each run of equal values starts."""
    if len(sorted_values) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def ranges(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """The [start, end) of each run, given the starts and the length of it all."""
    return zip(starts.tolist(), [*starts[1:].tolist(), n][: len(starts)], strict=True)


# --- questions to hash buckets, answers to rows ---------------------------------------------------------------------
# Tasks send packed arrays to hash buckets, buckets send packed arrays back to groups of rows, and a group's answers are
# brought together by row. Both hops carry one table row per task or bucket and target, however many entries it holds.

DEALT = pa.schema([("bucket", pa.int32()), ("answer", pa.bool_()), ("blob", pa.binary())])
DEALT_TYPE = "bucket int, answer boolean, blob binary"


def dealt(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], DEALT.field(c).type) for c in range(3)], schema=DEALT)


def answers(bits: int, key: np.ndarray, *others: np.ndarray) -> list[tuple[int, bool, bytes]]:
    """Entries for rows, grouped by the low bits of the row's key."""
    group = key & ((1 << bits) - 1)
    order = np.argsort(group, kind="stable")
    group, key, others = group[order], key[order], [x[order] for x in others]
    cuts = runs(group)
    return [(int(group[a]), True, pack(key[a:b], *(x[a:b] for x in others))) for a, b in ranges(cuts, len(group))]


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[list[np.ndarray]] | pa.RecordBatch]]:
    """Unpacked questions of each bucket; rows that are answers already come out as batches under None. Rows come sorted."""
    now, held = None, []
    for batch in batches:
        done = batch.column("answer").to_numpy(zero_copy_only=False)
        if done.any():
            yield None, batch.filter(pa.array(done))
        for bucket, blob in zip(batch.column("bucket").to_numpy()[~done].tolist(), batch.column("blob").filter(pa.array(~done)), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(unpack(blob.as_buffer().to_pybytes()))
    if held:
        yield now, held


def gather(*names: str):
    """Brings the answers of each row together: the columns that name it, and its entries packed as ``blob``."""
    schema = pa.schema([*((n, pa.int64()) for n in names), ("blob", pa.binary())])

    def by_row(blobs: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*blobs, strict=True)]
        order = np.lexsort(columns[: len(names)])
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[: len(names)]])
        cuts = np.flatnonzero(new)
        found = list(ranges(cuts, len(order)))
        for i in range(0, len(cuts), 1000):
            some = cuts[i : i + 1000]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[some]) for c in columns[: len(names)]), pa.array([columns[-1][a:b].tobytes() for a, b in found[i : i + 1000]], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for group, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                if group != now and held:
                    yield from by_row(held)
                    held = []
                now = group
                held.append(unpack(blob.as_buffer().to_pybytes()))
        if held:
            yield from by_row(held)

    return run
