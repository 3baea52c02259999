"""Toxicity by multiple-instance learning over sentences.

A document is a bag of sentences.  Each sentence has the probability of a
logistic model over its words and their stems (the first 3 to 7 letters), all
hashed to a fixed number of weights; the document's is their noisy-or,
1 - prod(1 - p).  Only document labels are needed for training, by gradient
descent on the documents' likelihood, and the sentence probabilities then say
where the offending sentences are.  Steps are in proportion to the gradient,
so that words seen once can't explain the documents that hold them.

The model is fitted on a bounded sample of labelled rows: at most ``SAMPLE``
documents of each class, the first by a hash of their ids, and of those as many
whole texts as ``SAMPLE_BYTES`` hold, one at least.  Scores cover every document.

Edge cases: null text counts as empty; a text without words scores the
probability of no toxic sentence, 0; very long texts are scored whole, one at a
time in memory; null labels are ignored; a label that repeats an id counts
again, as does a document that repeats one; ids whose hashes tie are taken by
id; a score equal to the threshold counts as toxic; a null id is scored, never
trained on; without both classes in the sample every score is 0; an empty table
gives no rows.  Only ``doc_id``, ``text`` and the label are read, whatever other
columns there are and however they are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.common import discard, held_out, map_arrow, stored

SAMPLE = 1500
SAMPLE_BYTES = 8 << 20
WEIGHTS = 1 << 20
STEPS = 200
RATE = 0.3
SPARSITY = 1e-3
STEMS = (3, 4, 5, 6, 7)
#: Features of fewer training documents get no weight.
LEAST_DOCUMENTS = 3
_END = K.byte_set(*((ord(c), ord(c)) for c in ".!?\n"))


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word and stem, their offsets by sentence, sentence offsets by row, and each sentence's first byte."""
    lower = K.LOWER[data]
    starts, ends, by_row = K.spans(lower, offsets, K.ALNUM)
    hashes, there = K.hash_prefixes(lower, starts, ends, STEMS)
    bucket = (hashes[there] >> K.U64(44)).astype(np.int32)
    before = np.concatenate([[0], np.cumsum(there.sum(axis=1))])
    ended = np.cumsum(_END[data])
    number = ended[starts] if len(starts) else np.zeros(0, np.int64)
    row = K.row_of(by_row)
    new = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (row[1:] != row[:-1])])) if len(starts) else np.zeros(0, np.int64)
    return bucket, before[np.append(new, len(starts))], np.searchsorted(new, by_row), starts[new] if len(new) else new


def noisy_or(weights: np.ndarray, bias: float, bucket: np.ndarray, by_sentence: np.ndarray, by_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each sentence and of each row."""
    p = 1 / (1 + np.exp(-np.clip(K.per_row(weights[bucket].astype(float), by_sentence) + bias, -30, 30)))
    return p, -np.expm1(K.per_row(np.log1p(-np.minimum(p, 1 - 1e-12)), by_row))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], steps: int = STEPS, rate: float = RATE, sparsity: float = SPARSITY) -> tuple[np.ndarray, float]:
    """Weights and bias from (buckets, their offsets by sentence, label) of each training document."""
    bucket = np.concatenate([r[0] for r in rows])
    by_sentence = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(r[1]) for r in rows]))])
    by_row = np.concatenate([[0], np.cumsum([len(r[1]) - 1 for r in rows])])
    y = np.array([r[2] for r in rows])
    documents = np.zeros(WEIGHTS, np.int32)
    for r in rows:
        documents[np.unique(r[0])] += 1
    known = documents >= LEAST_DOCUMENTS
    names = np.flatnonzero(known)
    # features without a weight are left out before the descent
    keep = known[bucket]
    local = np.searchsorted(names, bucket[keep]).astype(np.int32)
    by_sentence = np.concatenate([[0], np.cumsum(keep)])[by_sentence]
    del bucket, keep
    share = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    w, b = np.zeros(len(names)), -5.0
    move, move_b = np.zeros(len(names)), 0.0
    sizes, per_doc = np.diff(by_sentence), np.diff(by_row)
    for k in range(steps if len(names) else 0):
        p, doc = noisy_or(w, b, local, by_sentence, by_row)
        doc = np.clip(doc, 1e-9, 1 - 1e-9)
        g = p * np.repeat(np.where(y > 0.5, -(1 - doc) / doc, 1.0) * share, per_doc)
        grad = np.bincount(local, np.repeat(g, sizes), len(w))
        step = rate * (1 - k / steps) / max(np.abs(grad).max(), 1e-3)
        move = 0.9 * move - step * grad
        w = w + move
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparsity, 0)
        move_b = 0.9 * move_b - rate * (1 - k / steps) * np.clip(5 * g.sum(), -1, 1)
        b = b + 0.3 * move_b
    out = np.zeros(WEIGHTS, np.float32)
    out[names] = w
    return out, float(b)


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """At most ``sample`` documents of each class, of SAMPLE_BYTES at most, as hashed sentences; their ids are the only rows broadcast."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y is not null and doc_id is not null").where(~held_out("doc_id", 5, 0))
    chosen = None
    for side in ("y > 0.5", "y <= 0.5"):
        part = marked.where(side).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
        chosen = part if chosen is None else chosen.union(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(0)):
                bucket, by_sentence, by_row, _ = sentences(part.data, part.offsets)
                a, b = [], []
                for i in range(len(part)):
                    cut = by_sentence[by_row[i] : by_row[i + 1] + 1]
                    a.append(bucket[cut[0] : cut[-1]].tobytes())
                    b.append((cut - cut[0]).astype(np.int32).tobytes())
                yield pa.record_batch([K.binary_column(a), K.binary_column(b), batch.column(1).slice(part.first, len(part))], names=["w", "s", "y"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, at = stored(texts.join(F.broadcast(chosen), "doc_id"))
    # over ids and lengths of the sample alone; a document that repeats an id stands or falls with its id
    order = Window.partitionBy(F.col("y") > 0.5).orderBy(F.xxhash64("doc_id"), "doc_id")
    sizes = found.groupBy("doc_id", "y").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.count("*").alias("rows"))
    fit = sizes.withColumn("before", F.sum("n").over(order) - F.col("n")).where((F.col("before") + F.col("n") <= SAMPLE_BYTES) | (F.col("before") == 0)).select("doc_id", "y")
    rows = map_arrow(found.join(F.broadcast(fit), ["doc_id", "y"]).select("text", "y"), run, "w binary, s binary, y double").collect()
    discard(docs.sparkSession, at)
    return [(np.frombuffer(r.w, np.int32), np.frombuffer(r.s, np.int32), r.y) for r in rows if len(r.w)]


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, and sentences: the text and probability of those at or over ``threshold``, in order."""
    rows = training_sample(docs, labels, label_col, sample)
    if len({r[2] > 0.5 for r in rows}) == 2:
        weights, bias = fit(rows)
    else:
        weights, bias = np.zeros(WEIGHTS, np.float32), -30.0
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            for part in K.slices(batch.column(1)):
                bucket, by_sentence, by_row, first = sentences(part.data, part.offsets)
                p, doc = noisy_or(w, b, bucket, by_sentence, by_row)
                bad: list[list[dict]] = [[] for _ in range(len(part))]
                row = K.row_of(by_row)
                for s in np.flatnonzero(p >= threshold):
                    end = int(first[s + 1]) if s + 1 < by_row[row[s] + 1] else int(part.offsets[row[s] + 1])
                    bad[row[s]].append({"text": part.data[first[s] : end].tobytes().decode("utf-8", "replace").strip(), "p": float(p[s])})
                yield pa.record_batch([batch.column(0).slice(part.first, len(part)), pa.array(np.round(np.clip(doc, 0, 1), 6)), pa.array(bad, pa.list_(pa.struct([("text", pa.string()), ("p", pa.float64())])))], names=["doc_id", "score", "sentences"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double, sentences array<struct<text:string,p:double>>")
