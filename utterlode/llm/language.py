"""Language identification by a byte convolutional network.

The network reads windows of ``WINDOW`` bytes: filters over 2, 3 and 4 bytes, maximum over the positions, rectifier,
softmax. A byte has one weight per filter and place, so a convolution is a sum of table rows, and no floating-point input
is ever built. It is trained in numpy with Adam on a bounded sample of labelled windows: of about ``EACH`` documents a
language, ``MOST`` in all, every window of the whole text is a candidate, and ``WINDOWS`` a language, ``MOST_WINDOWS`` in
all, are taken by the hash of their bytes (equal ones once). Half of them are cut to a shorter length, for short texts.

A text is read whole, in windows that overlap by the widest filter; its probabilities are the windows' mean by length.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is everything if there is nothing to learn
from; ties between languages go to the first by name. Repeated rows each get their prediction; among labelled ones, of two
labels of one text both are learnt.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordstream as ws
from .folds import sample_ids

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
EACH, MOST, WINDOWS, MOST_WINDOWS = 320, 6400, 1200, 24_000
EPOCHS, BATCH, RATE = 12, 64, 0.01
STRIDE = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"


@dataclass
class Network:
    labels: list[str]
    tables: list[np.ndarray]  # of each width: (width, 256, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator) -> Network:
        tables = [(rng.standard_normal((w, 256, FILTERS)) * 0.3 / w).astype(np.float32) for w in WIDTHS]
        return cls(labels, tables, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], (rng.standard_normal((FILTERS * len(WIDTHS), len(labels))) * 0.1).astype(np.float32), np.zeros(len(labels), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.biases, self.out, self.out_bias]

    def convolve(self, x: np.ndarray, i: int) -> np.ndarray:
        """(rows, positions, filters) for the i-th width."""
        table, n = self.tables[i], x.shape[1] - WIDTHS[i] + 1
        total = table[0].take(x[:, :n], axis=0)
        for j in range(1, WIDTHS[i]):
            total += table[j].take(x[:, j : j + n], axis=0)
        return total

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([np.maximum(self.convolve(x, i).max(axis=1) + self.biases[i], 0) for i in range(len(WIDTHS))], axis=1)
        return softmax(pooled @ self.out + self.out_bias)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        rows, peaks, pooled = np.arange(len(x)), [], []
        for i in range(len(WIDTHS)):
            total = self.convolve(x, i)
            peak = total.argmax(axis=1)
            peaks.append(peak)
            pooled.append(np.take_along_axis(total, peak[:, None], axis=1)[:, 0] + self.biases[i])
        raw = np.concatenate(pooled, axis=1)
        hidden = np.maximum(raw, 0)
        error = softmax(hidden @ self.out + self.out_bias)
        error[rows, y] -= 1
        error /= len(x)
        back = (error @ self.out.T) * (raw > 0)
        tables = []
        for i, w in enumerate(WIDTHS):
            own, grad = back[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(self.tables[i])
            for j in range(w):
                seen = np.take_along_axis(x, peaks[i] + j, axis=1)
                np.add.at(grad[j], (seen, np.arange(FILTERS)[None, :]), own)
            tables.append(grad)
        biases = [back[:, i * FILTERS : (i + 1) * FILTERS].sum(axis=0) for i in range(len(WIDTHS))]
        return [*tables, *biases, hidden.T @ error, error.sum(axis=0)]


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, labels: list[str], seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    net = Network.fresh(labels, rng)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            some = order[at : at + BATCH]
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for w, g, (m, v) in zip(net.weights(), net.gradient(x[some], y[some]), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def spans(size: int) -> range:
    """Where the windows of a text of ``size`` bytes start."""
    return range(0, max(1, size - WINDOW + STRIDE), STRIDE)


def _windows(batches):
    """Every window of every text, its order in the sample; the window's bytes decide whether it is cut."""
    for batch in batches:
        data, offsets = ws.byte_view(batch.column("text"))
        for i in range(batch.num_rows):
            text, starts = data[offsets[i] : offsets[i + 1]].tobytes(), spans(int(offsets[i + 1] - offsets[i]))
            for lo in range(0, len(starts), 4096):
                some = [text[at : at + WINDOW] for at in starts[lo : lo + 4096]]
                marks = [zlib.crc32(w) for w in some]
                cut = [w[: 8 + m // 2 % (WINDOW - 8)] if m % 2 else w for w, m in zip(some, marks, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, 1).take(pa.array(np.zeros(len(cut), np.int64))), pa.array(cut, pa.binary()), pa.array(ws.mix64(np.array(marks, np.uint64)).view(np.int64))], ["label", "window", "mark"])


def train(labelled: DataFrame, id_col: str, text_col: str, label_col: str) -> Network | None:
    """A network from a bounded sample of the rows of ``labelled`` that have an id, a text and a label."""
    ws.tune(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where("id is not null and label is not null")
    picked = sample_ids(rows, "label", EACH, MOST)
    candidates = rows.join(F.broadcast(picked), ["id", "label"], "left_semi").where(F.col("text").rlike(r"\p{L}")).select("label", "text").mapInArrow(_windows, "label string, window binary, mark long").distinct()
    rank = F.row_number().over(Window.partitionBy("label").orderBy("mark", "window"))
    windows = candidates.withColumn("rank", rank).where(F.col("rank") <= WINDOWS).orderBy("rank", "label").limit(MOST_WINDOWS).select("label", "window").collect()
    if not windows:
        return None
    windows.sort(key=lambda r: (r["label"], bytes(r["window"])))
    labels = sorted({r["label"] for r in windows})
    x = np.zeros((len(windows), WINDOW), np.uint8)
    for i, r in enumerate(windows):
        x[i, : len(r["window"])] = np.frombuffer(r["window"], np.uint8)
    return fit(x, np.array([labels.index(r["label"]) for r in windows]), labels)


def _predict(net: Network, schema: pa.Schema, text: str, letters: str):
    spread = np.arange(WINDOW)

    def run(batches):
        for batch in batches:
            data, offsets = ws.byte_view(batch.column(text))
            legible = batch.column(letters).to_numpy(zero_copy_only=False)
            total = np.zeros((batch.num_rows, len(net.labels)))
            for lo, hi in ws.slices(offsets):
                size = np.where(legible[lo:hi], np.diff(offsets[lo : hi + 1]), 0)
                many = np.where(size > 0, np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1), 0)  # as in `spans`
                owner = np.repeat(np.arange(lo, hi), many)
                start = offsets[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
                length = np.minimum(offsets[owner + 1] - start, WINDOW)
                for at in range(0, len(owner), 64):
                    some = slice(at, at + 64)
                    place = start[some, None] + spread
                    inside = spread < length[some, None]
                    x = np.where(inside, data[np.minimum(place, len(data) - 1)], 0)
                    np.add.at(total, owner[some], net.probabilities(x) * length[some, None])
            weight = total.sum(axis=1)
            known, best = weight > 0, total.argmax(axis=1)
            score = np.where(known, total[np.arange(len(total)), best] / np.where(known, weight, 1), 0.0)
            names = [net.labels[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            own = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.clip(score, 0, 1))}
            yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else batch.column(f.name) for f in schema], schema=schema)

    return run


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``; the text is the only input of a prediction."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ws.tune(docs.sparkSession)
    kept = [c for c in keep if c not in ("lang_pred", "score")]
    if net is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    own, letters = ws.free("_text", kept), ws.free("_legible", kept)
    legible = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(letters)
    return docs.select(*kept, F.col(text_col).alias(own), legible).mapInArrow(_predict(net, to_arrow_schema(schema), own, letters), schema)
