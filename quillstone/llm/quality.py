"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a dozen statistics of its bytes, words and lines.  Random
Fourier features of the standardised statistics approximate a Gaussian kernel;
every partition sums its part of the normal equations, the parts are added by
matrix row, and the driver solves a system whose size is the number of
features, whatever the corpus.  Scores are binned and calibrated by isotonic
regression on the bins.  All labelled training rows are used, none sampled.

Edge cases: null text counts as empty; an empty text is scored like any other;
very long texts are whole, one such text at a time in memory; equal scores share
a bin, and a score equal to the threshold is predicted good; labels of null are
no labels; repeated rows and labels each count; a document with a null id can't
have a label but is scored; without any label every score is 0.5; an empty table
gives no rows.  Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.common import held_out, map_arrow, materialise

STATISTICS = ("log_words", "word_length", "symbols", "exclamations", "bars", "capitals", "digits", "variety", "echoes", "repeated_triples", "stops", "line_length")
FEATURES = 256
RIDGE = 1.0
SEED = 20240229
BINS = 1000

_LETTER = K.byte_set((0x41, 0x5A), (0x61, 0x7A))
_CAPITAL = K.byte_set((0x41, 0x5A))
_DIGIT = K.byte_set((0x30, 0x39))
_STOP = K.byte_set(*((ord(c), ord(c)) for c in ".,;:?"))
_SYMBOL = K.byte_set(*((ord(c), ord(c)) for c in "#*$%&<>~^@_=\\{}[]"))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of :data:`STATISTICS` for each text."""

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def distinct(values: np.ndarray, by: np.ndarray) -> np.ndarray:
        keys = np.sort((K.row_of(by).astype(K.U64) << K.U64(44)) | (values >> K.U64(20)))
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        return np.bincount((keys[new] >> K.U64(44)).astype(np.int64), minlength=len(by) - 1).astype(float)

    size = np.maximum(np.diff(offsets), 1).astype(float)
    lower = K.LOWER[data]
    starts, ends, by = K.spans(lower, offsets, K.NOT_BLANK)
    n = np.diff(by).astype(float)
    some = np.maximum(n, 1)
    h = K.hash_spans(lower, starts, ends)
    row = K.row_of(by)
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    in_row = row[2:] == row[:-2]
    triple = K.mix(h[2:] * K.U64(3) + K.mix(h[1:-1] * K.U64(5) + K.mix(h[:-2])))[in_row] if len(h) > 2 else np.zeros(0, K.U64)
    triples = np.bincount(row[2:][in_row], minlength=len(size)).astype(float) if len(h) > 2 else np.zeros(len(size))
    by3 = np.concatenate([[0], np.cumsum(triples.astype(np.int64))])
    root = lambda x, of: np.sqrt(x / np.maximum(of, 1))
    lines = count(data == 0x0A) + 1
    return np.column_stack(
        [
            np.log1p(n),
            np.minimum(K.per_row((ends - starts).astype(float), by) / some, 40),
            root(count(_SYMBOL[data]), size),
            root(count(data == 0x21), size),
            root(count(data == 0x7C), size),
            root(count(_CAPITAL[data]), count(_LETTER[data])),
            root(count(_DIGIT[data]), size),
            np.log1p(distinct(h, by)) / np.log1p(some),
            root(np.bincount(row[1:][same], minlength=len(size)), some),
            root(triples - distinct(triple, by3), triples),
            root(count(_STOP[data]), size),
            np.log1p(np.diff(offsets) / lines),
        ]
    )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the statistics of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(1)):
                x = statistics(part.data, part.offsets)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.record_batch([batch.column(0).slice(part.first, len(part)), rows], names=["doc_id", "x"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Fourier:
    """Random Fourier features of standardised statistics, with a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(size=(len(mean), features)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6) @ self.w + self.b
        return np.column_stack([np.sqrt(2 / len(self.b)) * np.cos(z), np.ones(len(x))])


def normal_equations(labelled: DataFrame, features: Fourier) -> np.ndarray:
    """[Z'Z | Z'y] over all rows of (x, y): summed in each partition, then added by matrix row."""
    size = len(features.b) + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        seen = False
        for batch in batches:
            if len(batch):
                z = features(_matrix(batch.column(0)))
                total += z.T @ np.column_stack([z, batch.column(1).to_numpy(zero_copy_only=False)])
                seen = True
        if seen:
            yield pa.record_batch([pa.array(np.arange(size), pa.int32()), K.binary_column([r.tobytes() for r in total])], names=["i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(v)
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), K.binary_column([x.tobytes() for x in total.values()])], names=["i", "v"])

    out = np.zeros((size, size + 1))
    for r in map_arrow(map_arrow(labelled.select("x", "y"), part, "i int, v binary").repartition(16, "i"), add, "i int, v binary").collect():
        out[r.i] = np.frombuffer(r.v)
    return out


def isotonic(at: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and non-decreasing means, for interpolation."""
    blocks: list[list[float]] = []
    for x, w, t in sorted(zip(at, weight, total, strict=True)):
        blocks.append([x * w, w, t])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, raw (the ridge score before calibration) for every document."""
    stats = materialise(document_statistics(docs))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y is not null")
    # statistics, means, equations and bins read it again
    train = materialise(stats.where(~held_out("doc_id", 4, 2)).join(marked, "doc_id").select("x", "y"))
    width = len(STATISTICS)
    row = train.agg(F.count("y"), *[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(width)]).first()
    if not row[0]:
        return stats.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.lit(0.5).alias("score"), F.lit(0).alias("predicted"), F.lit(0.5).alias("raw"))
    features = Fourier(np.array(row[1 : 1 + width]), np.array(row[1 + width :]))
    system = normal_equations(train, features)
    weights = np.linalg.solve(system[:, :-1] + RIDGE * np.diag([1.0] * len(features.b) + [1e-6]), system[:, -1])

    def raw(x: pa.Array) -> np.ndarray:
        return np.clip(features(_matrix(x)) @ weights, -0.5, 1.5)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.record_batch([pa.array(np.rint(raw(batch.column(0)) * BINS).astype(np.int32)), batch.column(1)], names=["bin", "y"])

    counted = map_arrow(train, bins, "bin int, y double").groupBy("bin").agg(F.count("y").alias("n"), F.sum("y").alias("s")).collect()
    xs, ys = isotonic(*(np.array([float(r[k]) for r in counted]) for k in ("bin", "n", "s")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                r = raw(batch.column(1))
                yield pa.record_batch([batch.column(0), pa.array(np.round(np.clip(np.interp(r * BINS, xs, ys), 0, 1), 6)), pa.array(np.round(r, 6))], names=["doc_id", "score", "raw"])

    out = map_arrow(stats.select("doc_id", "x"), score, "doc_id long, score double, raw double")
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "raw")
