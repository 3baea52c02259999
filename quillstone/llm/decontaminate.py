"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: each row of :func:`build_index` is one
shard of a few MiB of text, holding the shard's sorted term hashes and, for
each term, the sorted positions at which it occurs (differences, compressed).
Building it shuffles nothing, and no list of a frequent term ever leaves its
shard, so a word that stands in every document is no hot key.

:func:`search` sends blocks of test phrases to every shard.  A phrase with a
term that the shard lacks ends there; the others start from the positions of
their rarest term and keep those whose offset-adjusted position is in the list
of the next rarest term, and so on.  With ``slop`` 0 these are exact phrases;
with more, each term may stand that many words from its place (proximity).
Terms are 64-bit hashes of words.

Edge cases: null or empty texts have no words, no hits and no items; very long
texts are indexed whole, as a shard of their own; a test item without words is
no phrase; items that share a phrase are all named; an item with a null id marks
words as hit but is never named; an id that several items have is named once;
repeated documents are judged one by one; a null document id is kept as it is;
terms that are equally rare are looked up in their order.  An empty document
table gives no rows, an empty test table gives rows without hits.  Only the ids
and texts are read, whatever other columns there are and however they are named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.common import map_arrow, materialise

#: Positions left free between two documents of a shard, more than a phrase and its slop can span.
GAP = 64
WINDOW = 10
SHARD_BYTES = 4 << 20
#: Test text that is searched for together, and in one pass over the index, one such block after the other.
BLOCK_BYTES = 4 << 20
PASS_BLOCKS = 4
#: Candidate positions that are looked at together.
CANDIDATES = 2 << 20

INDEX_SCHEMA = "shard long, doc_ids array<long>, n_words binary, terms binary, starts binary, n_postings long, postings binary"
HIT_SCHEMA = "shard long, ord int, doc_id long, n_words long, hits array<int>, items array<string>, near array<string>"


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (digits, letters with A-Z lowered, all non-ASCII) and n+1 word offsets by row."""
    lower = K.LOWER[data]
    starts, ends, by_row = K.spans(lower, offsets, K.ALNUM)
    return K.hash_spans(lower, starts, ends), by_row


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The positional inverted index of ``docs``, one row a shard (see the module).

    It is stored at once: shards are named by the partition that makes them,
    so passes over an index that is made anew could not be put together.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            ids = batch.column(0)
            for part in K.slices(batch.column(1), shard_bytes):
                hashes, by_row = words(part.data, part.offsets)
                place = np.arange(len(hashes), dtype=np.int64) + GAP * (K.row_of(by_row) + 1)
                order = np.argsort(hashes, kind="stable")
                grouped = hashes[order]
                first = np.flatnonzero(np.concatenate([[True], grouped[1:] != grouped[:-1]])) if len(grouped) else np.zeros(0, np.int64)
                steps = np.diff(place[order], prepend=0).astype(np.int32)
                yield pa.record_batch(
                    [
                        pa.array([shard], pa.int64()),
                        pa.array([ids.slice(part.first, len(part)).to_pylist()], pa.list_(pa.int64())),
                        K.binary_column([np.diff(by_row).astype(np.int32).tobytes()]),
                        K.binary_column([grouped[first].tobytes()]),
                        K.binary_column([first.astype(np.int32).tobytes()]),
                        pa.array([len(steps)], pa.int64()),
                        K.binary_column([pa.compress(steps.tobytes(), "zstd", asbytes=True)]),
                    ],
                    names=["shard", "doc_ids", "n_words", "terms", "starts", "n_postings", "postings"],
                )
                shard += 1

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialise(map_arrow(texts, build, INDEX_SCHEMA))


@dataclass
class Phrases:
    """Distinct phrases as starts and lengths in a row of term hashes, and the items that each belongs to."""

    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    owners: np.ndarray
    owner_offsets: np.ndarray
    items: list[str | None]
    window: int

    @property
    def terms(self) -> np.ndarray:
        """A row of hashes a phrase, padded with 0."""
        return _terms(self.hashes, self.starts, self.lengths, self.window)


def _terms(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    if not len(starts):
        return np.zeros((0, window), K.U64)
    place = np.arange(window)[None, :]
    return np.where(place < lengths[:, None], hashes[np.minimum(starts[:, None] + place, len(hashes) - 1)], K.U64(0))


def phrases(texts: list[str | None], items: list[str | None], window: int = WINDOW) -> Phrases:
    """All runs of ``window`` consecutive words of each text; a shorter text is one phrase."""
    raw = [(t or "").encode() for t in texts]
    hashes, by_row = words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]))
    n = np.diff(by_row)
    size = np.minimum(n, window)
    count = np.where(n > 0, n - size + 1, 0)
    row = np.repeat(np.arange(len(texts)), count)
    starts = by_row[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    lengths = size[row]
    if not len(row):
        return Phrases(hashes, starts, lengths, row, np.zeros(1, np.int64), items, window)
    _, first, which = np.unique(np.column_stack([lengths.astype(K.U64), _terms(hashes, starts, lengths, window)]), axis=0, return_index=True, return_inverse=True)
    pairs = np.unique(which.ravel() * len(texts) + row)
    return Phrases(hashes, starts[first].astype(np.int32), lengths[first], pairs % len(texts), np.searchsorted(pairs // len(texts), np.arange(len(first) + 1)), items, window)


def intersect(query: Phrases, terms: np.ndarray, starts: np.ndarray, place: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position of its first word) of all occurrences in one shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(terms) or not len(query.starts):
        return none
    wanted, width = query.terms, query.window
    used = np.arange(width)[None, :] < query.lengths[:, None]
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    alive = np.flatnonzero(((terms[at] == wanted) | ~used).all(axis=1))
    del wanted
    if not len(alive):
        return none
    at, used, lengths = at[alive], used[alive], query.lengths[alive]
    bounds = np.append(starts, len(place))
    count = np.where(used, bounds[at + 1] - bounds[at], np.iinfo(np.int64).max)
    rank = np.argsort(count, axis=1, kind="stable")
    rarest = rank[:, 0]
    anchors = at[np.arange(len(at)), rarest]
    size = bounds[anchors + 1] - bounds[anchors]
    n = int(place[-1] if len(place) == 1 else place.max()) + GAP
    keys = np.repeat(np.arange(len(terms)), np.diff(bounds)) * n + place
    found_phrase, found_at = [], []
    total = np.cumsum(size)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + CANDIDATES, "right")))
        which = np.repeat(np.arange(i, j), size[i:j])
        inner = np.arange(len(which)) - np.repeat(np.cumsum(size[i:j]) - size[i:j], size[i:j])
        start = place[bounds[anchors[which]] + inner] - rarest[which]
        for k in range(1, width):
            more = k < lengths[which]
            if not more.any():
                break
            other = rank[which, k]
            want = at[which, other] * n + start + other
            got = np.minimum(np.searchsorted(keys, want - slop), len(keys) - 1)
            keep = ~more | ((keys[got] >= want - slop) & (keys[got] <= want + slop))
            which, start = which[keep], start[keep]
        found_phrase.append(alive[which])
        found_at.append(start)
        i = j
    return np.concatenate(found_phrase), np.concatenate(found_at)


def _named(query: Phrases, phrase: np.ndarray, row: np.ndarray, out: list[set[str]]) -> None:
    """Adds the items of the phrases found in each row."""
    sizes = query.owner_offsets[phrase + 1] - query.owner_offsets[phrase]
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    owner = query.owners[np.repeat(query.owner_offsets[phrase], sizes) + inner]
    for key in np.unique(np.repeat(row, sizes) * len(query.items) + owner):
        name = query.items[int(key % len(query.items))]
        if name is not None:
            out[int(key // len(query.items))].add(name)


def search(index: DataFrame, tests: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each indexed document: hit word numbers, items found word for word, and items found within ``slop``.

    Test texts are read in blocks of at most ``block_bytes`` (one text at
    least).  A pass over the index takes PASS_BLOCKS of them, so what is
    broadcast is bounded whatever their number; a worker looks for one at a time.
    """
    spark = index.sparkSession
    parts: list[DataFrame] = []
    blocks: list[Phrases] = []
    texts: list[str | None] = []
    items: list[str | None] = []

    def one_pass() -> None:
        shared = spark.sparkContext.broadcast(list(blocks))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.to_pylist():
                    n_words = np.frombuffer(x["n_words"], np.int32).astype(np.int64)
                    place = np.cumsum(np.frombuffer(pa.decompress(x["postings"], 4 * x["n_postings"], "zstd"), np.int32), dtype=np.int64) if x["n_postings"] else np.zeros(0, np.int64)
                    terms, starts = np.frombuffer(x["terms"], K.U64), np.frombuffer(x["starts"], np.int32).astype(np.int64)
                    rows = len(n_words)
                    base = np.cumsum(n_words) - n_words + GAP * (np.arange(rows) + 1)
                    inside = np.zeros(int(place.max()) + GAP if len(place) else 0, bool)
                    hit_rows: set[int] = set()
                    exact, near = [set() for _ in range(rows)], [set() for _ in range(rows)]
                    for block in shared.value:
                        phrase, start = intersect(block, terms, starts, place)
                        row = np.searchsorted(base, start, "right") - 1
                        _named(block, phrase, row, exact)
                        if len(phrase):
                            edge = np.zeros(len(inside), np.int32)
                            np.add.at(edge, start, 1)
                            np.add.at(edge, start + block.lengths[phrase], -1)
                            inside |= np.cumsum(edge) > 0
                            hit_rows.update(np.unique(row).tolist())
                        if slop:
                            phrase, start = intersect(block, terms, starts, place, slop)
                            _named(block, phrase, np.clip(np.searchsorted(base - GAP // 2, start, "right") - 1, 0, None), near)
                    hit = [np.flatnonzero(inside[base[r] : base[r] + n_words[r]]).astype(np.int32) if r in hit_rows else np.zeros(0, np.int32) for r in range(rows)]
                    yield pa.record_batch(
                        [
                            pa.array([x["shard"]] * rows, pa.int64()),
                            pa.array(np.arange(rows), pa.int32()),
                            pa.array(x["doc_ids"], pa.int64()),
                            pa.array(n_words, pa.int64()),
                            pa.array(hit, pa.list_(pa.int32())),
                            pa.array([sorted(e) for e in exact], pa.list_(pa.string())),
                            pa.array([sorted(n | e) for n, e in zip(near, exact, strict=True)], pa.list_(pa.string())),
                        ],
                        names=["shard", "ord", "doc_id", "n_words", "hits", "items", "near"],
                    )

        parts.append(map_arrow(index, look, HIT_SCHEMA))
        blocks.clear()

    def flush() -> None:
        blocks.append(phrases(texts, list(items), window))
        texts.clear()
        items.clear()
        if len(blocks) == PASS_BLOCKS:
            one_pass()

    size = 0
    for r in tests.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        size += len(r.t or "")
        if texts and size > block_bytes:
            flush()
            size = len(r.t or "")
        texts.append(r.t)
        items.append(r.i)
    if texts:
        flush()
    if blocks or not parts:
        one_pass()
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    merged = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("hits", "items", "near")]
    return out.groupBy("shard", "ord").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *merged)


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = WINDOW, slop: int = 2) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items within ``slop``)."""
    found = search(build_index(docs), tests, window=window, slop=slop)
    names = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size(F.array_distinct("near")).cast("long").alias("n_near"),
    )
