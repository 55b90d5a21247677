"""Toxicity by class-conditional Kneser-Ney models.

The models of toxic and of ordinary text differ in what a class has seen and share what neither has:

    P_c(w) = max(n_c(w) - D(n_c(w)), 0) / n_c + lambda_c P(w)

``n_c(w)`` is the Kneser-Ney continuation count, the number of different words that ``w`` follows in the class, and
``P(w)`` the same over both classes, undiscounted; a word that neither has is as likely in both. So copies of a text,
however many, count once. ``D`` depends on the count and is below it. It is estimated by leaving out: the training texts are halved,
and a count shrinks to what words with that count in one half have in the other (for toxic text, words that ordinary text of
the half has not). So rare expressions, which by chance are only in one class, give most of their mass to the shared backoff.
The order of bigrams above this one is left out: with a discount of 0.75 and a shared bigram backoff it lowered held-out
accuracy on both sets that were tried (README).

Each half of the training texts has its models, and a text is judged by the mean of what both say: an expression that by
chance is in one class of one half counts half.

A text is read whole. Its two log-likelihoods are compared per word: over every word, over every run of ``RUN`` words, and
over the text. The largest word, the largest run and the text's mean go into a logistic curve, fitted on training texts by
the models of the half that they are not in.

Training takes every labelled text. Pairs of a word and the one before it go to buckets by both (a frequent word's pairs to
several), are told apart there by 38 bits beside the word's 64, and are counted; the discounts come from how many words have
which counts. All words stay in the models, whose size grows with the vocabulary, so nothing broadcasts them: texts lie in
groups, a group asks buckets for the ratios of its different words, and the answers meet the group's texts. The curve is
fitted by sums over all labelled texts.

Edge cases: a null or wordless text scores as a text without evidence; repeated rows each get their score, and repeated
training texts count once; labels other than 0 and 1 are left out, of repeated labels the larger counts; without both
classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import discard, release, saved
from . import wordstream as ws

RUN = 4
#: Bytes of text to a bucket of pairs and to a group; words that a task counts at once; bits that spread a word's pairs.
BUCKET, GROUP, HELD, SALT = 8 << 20, 8 << 20, 1 << 20, 4
#: From so many bytes of text on, texts meet their answers in so many parts, one after another.
WHOLE, PARTS = 64 << 20, 3
#: More labels than these are not broadcast.
BROADCAST = 1_000_000
CELLS = ("n0", "n1", "n2", "n3")
#: Sorts a group's rows behind its answers.
LAST = (1 << 31) - 1
#: Counts from each of these to the next are discounted alike.
BINS = np.array([1, 2, 3, 4, 5, 7, 11, 21, 41])
#: Words are runs of letters: ASCII ones, lower-cased, and all other characters beyond ASCII.
LETTERS = ws.byte_class(bytes(b for b in range(128) if not chr(b).isalpha()))
_START = np.uint64(0x1234567)


def _words(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = ws.word_bounds(part, at, LETTERS)
    return ws.word_hashes(part, starts, ends, ws.LOWER_ASCII), first


def _slices(batch: pa.RecordBatch, text: str):
    data, offsets = ws.byte_view(batch.column(text))
    for lo, hi in ws.slices(offsets):
        yield lo, hi, *_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


# --- counts ---------------------------------------------------------------------------------------------------------


def _distinct(words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((pairs, words))
    words, pairs = words[order], pairs[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (pairs[1:] != pairs[:-1])
    return words[new], pairs[new]


def _pairs(bits: int):
    """The different pairs of some texts by bucket: words, how many pairs each has, and for each pair 38 bits of the word
    before and the text's cell (half and class)."""
    salt = np.uint64(min(SALT, bits - 1))
    high = np.uint64(64 - bits) + salt

    def flushed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        words, pairs = _distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
        bucket = ((words >> high) << salt) | (pairs >> np.uint64(2)) & ((np.uint64(1) << salt) - np.uint64(1))
        order = np.argsort(bucket, kind="stable")
        bucket, words, pairs = bucket[order], words[order], pairs[order]
        out = []
        for a, b in ws.ranges(ws.runs(bucket), len(bucket)):
            at = ws.runs(words[a:b])
            out.append((int(bucket[a]), False, ws.pack(words[a:b][at], np.diff(np.append(at, b - a)).astype(np.uint32), pairs[a:b].astype(np.uint32), (pairs[a:b] >> np.uint64(32)).astype(np.uint8))))
        return ws.dealt(out)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for lo, hi, words, first in _slices(batch, "text"):
                if not len(words):
                    continue
                before = np.concatenate(([_START], words[:-1]))
                counts = np.diff(first)
                before[first[:-1][counts > 0]] = _START
                held.append((words, (ws.mix64(before) >> np.uint64(26) << np.uint64(2)) | np.repeat(cells[lo:hi], counts).astype(np.uint64)))
                size += len(words)
                if size >= HELD:
                    yield flushed(held)
                    held, size = [], 0
        if held:
            yield flushed(held)

    return run


def _counted(batches):
    """How many different words each word of a bucket follows, by cell."""
    for _, blobs in ws.buckets(batches):
        words = np.concatenate([np.repeat(b[0], b[1]) for b in blobs])
        words, pairs = _distinct(words, np.concatenate([b[2] | (b[3].astype(np.uint64) << np.uint64(32)) for b in blobs]))
        at = ws.runs(words)
        cell = (pairs & np.uint64(3)).astype(np.int64)
        n = [np.add.reduceat((cell == c).astype(np.int64), at) for c in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(words[at].view(np.int64)), *map(pa.array, n)], ["word", *CELLS])


def counts_of(texts: DataFrame, size: int) -> DataFrame:
    """``word`` and its Kneser-Ney continuation counts by cell, from all rows of ``texts`` (``cell``, ``text``)."""
    bits = ws.bits_for(size, BUCKET)
    asked = texts.mapInArrow(_pairs(bits), ws.DEALT_TYPE)
    met = asked.repartition(max(ws.shuffle_width(texts.sparkSession), 1 << bits >> 1), "bucket").sortWithinPartitions("bucket")
    parts = met.mapInArrow(_counted, "word long, " + ", ".join(f"{c} long" for c in CELLS))
    return parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in CELLS])


# --- models ---------------------------------------------------------------------------------------------------------


def shrinkage(n: np.ndarray, times: np.ndarray, toxic: int) -> np.ndarray:
    """For each bin of counts: the share of a count that the other half confirms. ``n``: counts by cell, had by ``times`` words."""
    seen, confirmed = np.zeros(len(BINS)), np.zeros(len(BINS))
    for own, other in ((0, 2), (2, 0)):
        rows = n[:, own + toxic] > 0
        if toxic:
            rows &= n[:, own] == 0
        bins = np.searchsorted(BINS, n[rows, own + toxic], side="right") - 1
        seen += np.bincount(bins, n[rows, own + toxic] * times[rows], len(BINS))
        confirmed += np.bincount(bins, n[rows, other + toxic] * times[rows], len(BINS))
    full = np.flatnonzero(seen)
    if not len(full):
        return np.zeros(len(BINS))
    nearest = full[np.minimum(np.searchsorted(full, np.arange(len(BINS))), len(full) - 1)]  # an empty bin goes by the next one
    return np.minimum(confirmed[nearest] / seen[nearest], 1.0)


@dataclass
class Models:
    """Counts of every word, and what turns them into log ratios of words, toxic over ordinary, for each half."""

    counts: DataFrame
    kept: list[np.ndarray]
    totals: np.ndarray
    halves: tuple[int, ...]

    def ratios(self, n: np.ndarray) -> np.ndarray:
        """A column for each half; words that neither class has say nothing there."""
        return np.stack([_log_ratio(n[:, 2 * h : 2 * h + 2], self.totals[2 * h : 2 * h + 2], self.kept[2 * h : 2 * h + 2]) for h in self.halves], axis=1)


def _log_ratio(n: np.ndarray, totals: np.ndarray, kept: list[tuple[np.ndarray, float]]) -> np.ndarray:
    shared, chance = n.sum(axis=1), []
    for c in (0, 1):
        share, back = kept[c]
        left = n[:, c] * share[np.maximum(np.searchsorted(BINS, n[:, c], side="right") - 1, 0)]
        chance.append(left / totals[c] + back * shared / totals.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, np.log(chance[1] / chance[0]), 0.0)


def models_of(counts: DataFrame, shares: list[np.ndarray] | None = None) -> tuple[Models | None, list[np.ndarray]]:
    """Models of the halves that have words of both classes, and the shares that discounting keeps."""
    table = counts.groupBy(*CELLS).count().toArrow()
    n, times = np.stack([table.column(c).to_numpy() for c in CELLS], axis=1).astype(np.float64), table.column("count").to_numpy().astype(np.float64)
    shares = shares or [shrinkage(n, times, c) for c in (0, 1)]
    totals, kept = (n * times[:, None]).sum(axis=0), []
    for cell in range(4):
        left = n[:, cell] * shares[cell % 2][np.maximum(np.searchsorted(BINS, n[:, cell], side="right") - 1, 0)]
        kept.append((shares[cell % 2], max(1 - float((left * times).sum()) / max(totals[cell], 1.0), 1e-9)))
    halves = tuple(h for h in (0, 1) if totals[2 * h] and totals[2 * h + 1])
    return Models(counts, kept, totals, halves) if halves else None, shares


# --- texts and their words' ratios ----------------------------------------------------------------------------------


def _grouped(batches):
    """Rows in groups with about ``GROUP`` bytes, compressed."""
    first, held, size = TaskContext.get().partitionId() << 32, [], 0

    def group() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["grp", "blob"])

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GROUP:
            yield group()
            first, held, size = first + 1, [], 0
    if any(len(b) for b in held):
        yield group()


def _opened(blob, text: str):
    """Batches of a group's rows, with words and each row's first word."""
    for batch in pa.ipc.open_stream(blob):
        for lo, hi, words, first in _slices(batch, text):
            yield batch.slice(lo, hi - lo), words, first


def _asked(text: str, bits: int):
    """A group's different words, in order, by bucket."""

    def run(batches):
        for batch in batches:
            for grp, blob in zip(batch.column("grp").to_pylist(), batch.column("blob"), strict=True):
                words = [np.unique(w) for _, w, _ in _opened(blob.as_buffer(), text)]
                words = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
                bucket = (words >> np.uint64(64 - bits)).astype(np.int64)
                rows = [(int(bucket[a]), True, ws.pack(np.array([grp]), words[a:b])) for a, b in ws.ranges(ws.runs(bucket), len(bucket))]
                if rows:
                    yield ws.dealt(rows)

    return run


def _told(models: Models, bits: int, mean: bool):
    """The words of the models with their ratios, by bucket."""
    ratios = Models(None, models.kept, models.totals, models.halves).ratios

    def flushed(held) -> pa.RecordBatch:
        words = np.concatenate([b.column("word").to_numpy() for b in held]).view(np.uint64)
        order = np.argsort(words)
        values = ratios(np.concatenate([np.stack([b.column(c).to_numpy() for c in CELLS], axis=1) for b in held])[order].astype(np.float64))
        words, values = words[order], (values.mean(axis=1, keepdims=True) if mean else values).astype(np.float32)
        bucket = (words >> np.uint64(64 - bits)).astype(np.int64)
        return ws.dealt([(int(bucket[a]), False, ws.pack(words[a:b], values[a:b].ravel())) for a, b in ws.ranges(ws.runs(bucket), len(bucket))])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= HELD // 4:
                yield flushed(held)
                held, size = [], 0
        if size:
            yield flushed(held)

    return run


def _squeezed(values: np.ndarray) -> bytes:
    """Few values differ: a byte or two for each, and those that differ."""
    seen, at = np.unique(values, return_inverse=True)
    packed = ws.pack(seen, at.astype(np.uint8 if len(seen) <= 256 else np.uint16 if len(seen) <= 1 << 16 else np.uint32).ravel())
    return np.int64(len(packed)).tobytes() + pa.compress(packed, "zstd", asbytes=True)


def _loosened(blob: bytes) -> np.ndarray:
    seen, at = ws.unpack(pa.decompress(blob[8:], int(np.frombuffer(blob, np.int64, 1)[0]), "zstd", asbytes=True))
    return seen[at]


def _answered(wide: int):
    """Words of the models, then questions: the ratios of a question's words, in its order, 0 for unknown ones."""

    def run(batches):
        now, words, values, parts = None, None, None, []
        for batch in batches:
            for bucket, asks, blob in zip(batch.column("bucket").to_pylist(), batch.column("answer").to_pylist(), batch.column("blob"), strict=True):
                if bucket != now:
                    now, words, parts = bucket, None, []
                own = ws.unpack(blob.as_buffer().to_pybytes())
                if not asks:
                    parts.append(own)
                    continue
                if words is None:
                    words = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)])
                    order = np.argsort(words)
                    words, values, parts = words[order], np.concatenate([p[1] for p in parts] or [np.zeros(0, np.float32)]).reshape(-1, wide)[order], []
                out = np.zeros((len(own[1]), wide), np.float32)
                if len(words):
                    at = np.minimum(np.searchsorted(words, own[1]), len(words) - 1)
                    hit = words[at] == own[1]
                    out[hit] = values[at[hit]]
                yield pa.RecordBatch.from_arrays([pa.array([int(own[0][0])], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_squeezed(out)], pa.binary())], ["grp", "bucket", "blob"])

    return run


def _measured(schema: pa.Schema, text: str, wide: int, half: str | None, curve: np.ndarray | None):
    """Answers in the order of buckets, then the group: its rows with their features or score."""
    from_features = ("word", "run", "mean") if curve is None else ("score",)

    def run(batches):
        now, parts = None, []
        for batch in batches:
            for grp, bucket, blob in zip(batch.column("grp").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                if grp != now:
                    now, parts = grp, []
                if bucket < LAST:
                    parts.append(_loosened(blob.as_buffer().to_pybytes()))
                    continue
                values = np.concatenate(parts).reshape(-1, wide) if parts else np.zeros((0, wide), np.float32)
                known = [np.unique(w) for _, w, _ in _opened(blob.as_buffer(), text)]
                known = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
                if len(known) != len(values):
                    raise RuntimeError(f"group {grp}: {len(values)} answers for {len(known)} words")
                for rows, words, first in _opened(blob.as_buffer(), text):
                    which = np.zeros(len(words), np.int64) if half is None else np.repeat(1 - rows.column(half).to_numpy(zero_copy_only=False), np.diff(first))
                    x = _features(values[np.searchsorted(known, words), which].astype(np.float64), first)
                    made = dict(zip(from_features, x.T if curve is None else [_curve(curve, x)], strict=True))
                    for lo in range(0, len(rows), 1000):
                        yield pa.RecordBatch.from_arrays([pa.array(made[f.name][lo : lo + 1000]) if f.name in made else rows.column(f.name).slice(lo, 1000) for f in schema], schema=schema)

    return run


def _features(ratios: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: the largest log ratio of a word, the largest mean of a run of ``RUN`` words, and the text's mean."""
    counts = np.diff(first)
    sums = np.concatenate(([0.0], np.cumsum(ratios)))
    mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(counts, 1)
    word, run, full = mean.copy(), mean.copy(), np.flatnonzero(counts > 0)
    if len(full):
        upto = np.minimum(np.arange(len(ratios)) + RUN, np.repeat(first[1:], counts))
        word[full] = np.maximum.reduceat(ratios, first[:-1][full])
        run[full] = np.maximum.reduceat((sums[upto] - sums[:-1]) / RUN, first[:-1][full])
    return np.stack([word, run, mean], axis=1)


def _through(rows: DataFrame, text: str, size: int, models: Models, schema, half: str | None = None, curve: np.ndarray | None = None) -> DataFrame:
    """``rows`` with what their words' ratios make of them, as ``schema``: saved, in parts one after another, so the copies of
    the texts that travel are a part's."""
    done, parts = None, 1 if size < WHOLE else PARTS
    for part in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64(text), F.lit(parts)) == part)
        found, groups = _part(own, text, size // parts, models, schema, half, curve)
        found = saved(found, "scored")
        discard(groups)
        release(rows.sparkSession)
        done = found if done is None else done.unionByName(found)
    return done


def _part(rows: DataFrame, text: str, size: int, models: Models, schema, half: str | None, curve: np.ndarray | None) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, wide = rows.sparkSession, len(models.halves) if half else 1
    bits = ws.bits_for(size, 16 * BUCKET)
    groups = saved(rows.mapInArrow(_grouped, "grp long, blob binary"), "groups")
    asked = groups.mapInArrow(_asked(text, bits), ws.DEALT_TYPE).unionByName(models.counts.mapInArrow(_told(models, bits, half is None), ws.DEALT_TYPE))
    met = asked.repartition(max(ws.shuffle_width(spark), 1 << bits), "bucket").sortWithinPartitions("bucket", "answer")
    answers = met.mapInArrow(_answered(wide), "grp long, bucket int, blob binary")
    both = answers.unionByName(groups.select("grp", F.lit(LAST).alias("bucket"), "blob"))
    home = both.repartition(ws.tasks_for(spark, size, 4 * GROUP), "grp").sortWithinPartitions("grp", "bucket")
    return home.mapInArrow(_measured(to_arrow_schema(schema), text, wide, half, curve), schema), groups


def _curve(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40)))


def _sums(z: np.ndarray, y: np.ndarray, curves: list[np.ndarray]) -> np.ndarray:
    """For each curve, as a row: its loss, the loss's gradient and its second derivatives, over these rows."""
    out = []
    for w in curves:
        m = z @ w
        p = 1 / (1 + np.exp(-np.clip(m, -40, 40)))
        out.append(np.concatenate(([(np.logaddexp(0, m) - y * m).sum()], z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel())))
    return np.array(out)


def _newton(sums: Callable[[list[np.ndarray]], np.ndarray], size: int, rounds: int = 100, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method; a step is halved until it lowers the loss."""
    pull = ridge * np.append(np.ones(size - 1), 1e-6)
    loss = lambda w, s: float(s[0] + (pull * w * w).sum() / 2)
    w = np.zeros(size)
    own = sums([w])[0]
    for _ in range(rounds):
        step = np.linalg.solve(own[1 + size :].reshape(size, size) + np.diag(pull + 1e-9), -own[1 : 1 + size] - pull * w)
        found = None
        for halved in range(0, 24, 6):
            tried = [w + step / 2**k for k in range(halved, halved + 6)]
            found = next(((t, s) for t, s in zip(tried, sums(tried), strict=True) if loss(t, s) <= loss(w, own)), None)
            if found:
                break
        if not found:
            break
        before, now = loss(w, own), loss(*found)
        w, own = found
        if before - now < 1e-9 * (1 + before):
            break
    return w


def _unscaled(w: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    slopes = w[:-1] / scale
    return np.append(slopes, w[-1] - slopes @ centre)


def _standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.concatenate([(x - centre) / scale, np.ones((len(x), 1))], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = _standard(x, centre, scale)
    return _unscaled(_newton(lambda curves: _sums(z, y, curves), z.shape[1]), centre, scale)


def fit_curve_of(rows: DataFrame) -> np.ndarray:
    """``fit_curve`` of all ``rows`` (the features and ``toxic``), whose sums are taken where they lie."""
    names = ("word", "run", "mean")
    about = rows.agg(*[f(c).alias(f"{k}_{c}") for k, f in (("a", F.avg), ("s", F.stddev_pop)) for c in names]).first()
    centre, scale = (np.array([about[f"{k}_{c}"] for c in names]) for k in "as")
    scale = np.maximum(scale, 1e-9)

    def sums(curves: list[np.ndarray]) -> np.ndarray:
        def run(batches):
            total = 0.0
            for batch in batches:
                x, y = np.stack([batch.column(c).to_numpy() for c in names], axis=1), batch.column("toxic").to_numpy()
                total = total + _sums(_standard(x, centre, scale), y, curves)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

        parts = rows.mapInArrow(run, "sums array<double>").collect()
        return np.sum([r["sums"] for r in parts], axis=0).reshape(len(curves), -1)

    return _unscaled(_newton(sums, len(names) + 1), centre, scale)


@dataclass
class Scorer:
    models: Models
    curve: np.ndarray


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer | None:
    """A scorer from the rows of ``labels`` (id and 0 or 1), all of which are learnt from."""
    ws.tune(docs.sparkSession)
    size = ws.text_bytes(docs, text_col)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = saved(known, "labels")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    own = texts.join(F.broadcast(known) if known.count() <= BROADCAST else known, "id").select("toxic", "text").withColumn("half", (F.crc32(F.col("text").cast("binary")) % 2).cast("int"))
    counts = saved(counts_of(own.select((F.col("half") * 2 + F.col("toxic")).alias("cell"), "text"), size), "counts")
    models, shares = models_of(counts)
    if models and len(models.halves) == 2:
        release(docs.sparkSession)
        rows = own.select("toxic", "half", F.md5(F.col("text").cast("binary")).alias("same"), "text")
        schema = rows.drop("text", "half").schema.add("word", "double").add("run", "double").add("mean", "double")
        features = saved(_through(rows, "text", size, models, schema, "half").dropDuplicates(["toxic", "same"]).drop("same"), "features")
        curve = fit_curve_of(features)
        release(docs.sparkSession)
        return Scorer(models, curve)
    counts = saved(counts_of(own.select(F.col("toxic").alias("cell"), "text"), size), "counts")
    whole, _ = models_of(counts, shares)
    return Scorer(whole, np.array([1.0, 1.0, 1.0, -10.0])) if whole else None


def score(docs: DataFrame, scorer: Scorer | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``score``; the text is the only input of a score."""
    ws.tune(docs.sparkSession)
    kept = [c for c in keep if c != "score"]
    if scorer is None:
        return docs.select(*kept, F.lit(0.0).alias("score"))
    schema, own = docs.select(*kept).schema.add("score", "double"), text_col if text_col in kept else ws.free("_text", kept)
    rows = docs.select(*kept, *([] if own in kept else [F.col(text_col).alias(own)]))
    return _through(rows, own, ws.text_bytes(docs, text_col), scorer.models, schema, curve=scorer.curve)
