"""Token counts through a two-tier table of pre-token lengths.

A byte-level BPE never merges across pre-tokens, so a text's tokens are the
sum of its pre-tokens' tokens.  Tier one is a compact dictionary of frequent
pre-tokens with their lengths, broadcast to all workers.  It holds the most
frequent ones of the whole table, every pre-token of every text counted where it
is; it only affects speed, as no document's count depends on what is in it.
Tier two encodes what is missing, the misses of a slice of documents together,
and keeps it in the worker's own bounded cache; when that is full it starts
anew, and tier one stays.  The documents' pre-tokens are never shuffled: the
only things that leave a partition are a count for each document and one for
each different pre-token.

Edge cases: null text counts as empty, with no bytes and no tokens; texts that
hold one of the vocabulary's special strings are encoded whole by the library,
as its default says; very long texts are split and counted whole, one at a time;
long pre-tokens are encoded but not cached; repeated rows count each; null ids
are kept; an empty table gives no rows.  A tokenizer with a normaliser or
another splitter than the byte-level one is encoded whole.  Only ``doc_id`` and
``text`` are read, whatever other columns there are and however they are named.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.common import discard, map_arrow, stored

#: The splitting pattern of byte-level vocabularies, as published with them.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries of the table of frequent pre-tokens, and about how many files it is made from where a caller asks for some documents only.
FREQUENT = 50_000
SAMPLE_FILES = 64
#: A worker's own entries, and the longest pre-token that it keeps.
CACHED = 400_000
LONGEST = 48

_workers: dict[str, object] = {}


class TokenCounter:
    """Counts tokens of texts with one vocabulary."""

    def __init__(self, vocabulary: str, frequent: dict[str, int], cached: int = CACHED):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.special = [x["content"] for x in spec.get("added_tokens") or ()]
        pre = spec.get("pre_tokenizer") or {}
        self.splits = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not spec["model"].get("dropout")
        self.pieces = regex.compile(PATTERN).findall
        self.frequent, self.room = frequent, len(frequent) + cached
        self.lengths = dict(frequent)

    def __call__(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        whole = [not self.splits or any(s in t for s in self.special) for t in texts]
        split = [[] if w else self.pieces(t) for t, w in zip(texts, whole, strict=True)]
        known = [list(map(self.lengths.get, p)) for p in split]
        missing = list({x for p, k in zip(split, known, strict=True) if None in k for x, n in zip(p, k, strict=True) if n is None})
        found = dict(zip(missing, map(len, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)), strict=True)) if missing else {}
        out = [sum(k) if None not in k else sum(found[x] if n is None else n for x, n in zip(p, k, strict=True)) for p, k in zip(split, known, strict=True)]
        self.keep(found)
        for i in (i for i, w in enumerate(whole) if w):
            out[i] = len(self.tokenizer.encode(texts[i], add_special_tokens=False).ids)
        return out

    def keep(self, found: dict[str, int]) -> None:
        """Adds what was encoded to tier two; a full one starts anew beside tier one."""
        if len(self.lengths) + len(found) > self.room:
            self.lengths = dict(self.frequent)
        room = self.room - len(self.lengths)
        self.lengths.update(islice(((x, n) for x, n in found.items() if len(x) <= LONGEST), room))


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of slices of a column; null is empty."""
    for part in K.slices(column):
        yield part.first, [t or "" for t in column.slice(part.first, len(part)).to_pylist()]


def _some_files(docs: DataFrame, files: int = SAMPLE_FILES) -> DataFrame:
    """The rows of about so many files, picked by a hash of their names: a table of many files is not read as a whole for this."""
    one_in = len(docs.inputFiles()) // files
    if one_in < 2:
        return docs
    try:
        return docs.where(F.pmod(F.xxhash64("_metadata.file_path"), F.lit(one_in)) == 0)
    except AnalysisException:
        return docs


def _most_frequent(counts: DataFrame, entries: int) -> list[str]:
    """The ``entries`` most frequent pieces of (piece, n), ties by piece; rows that can't be among them stay where they are."""
    size = F.length(F.bin("n"))
    reached, least = 0, 1
    for bits, pieces in sorted(counts.groupBy(size.alias("bits")).count().collect(), reverse=True):
        reached += pieces
        if reached >= entries:
            least = 1 << (bits - 1)
            break
    return [r.piece for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "piece").limit(entries).collect()]


def frequent_lengths(docs: DataFrame, vocabulary: str, documents: int | None = None, entries: int = FREQUENT) -> dict[str, int]:
    """Tier one: lengths of the most frequent pre-tokens of all documents, or of about so many picked by a hash; ``entries`` short strings are kept."""
    counter = TokenCounter(vocabulary, {})
    if not counter.splits:
        return {}
    pieces = counter.pieces

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])
            seen.clear()
            return out

        for batch in batches:
            for _, texts in _texts(batch.column(0)):
                for t in texts:
                    seen.update([p for p in pieces(t) if len(p) <= LONGEST])
                if len(seen) > CACHED:
                    yield flush()
        yield flush()

    if documents is not None:
        docs = _some_files(docs)
        docs = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, docs.count() // documents))) == 0)
    found = map_arrow(docs.select(F.col("text").cast("string").alias("text")), count, "piece string, n long")
    counts, at = stored(found.groupBy("piece").agg(F.sum("n").alias("n")))
    names = _most_frequent(counts, entries)
    discard(docs.sparkSession, at)
    return dict(zip(names, counter(names), strict=True))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, frequent_lengths(docs, vocabulary)))
    key = str(hash(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers:
            # a task has one core
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _workers.clear()
            _workers[key] = TokenCounter(*shared.value)
        count = _workers[key]
        for batch in batches:
            n_tokens = np.zeros(len(batch), np.int64)
            for first, texts in _texts(batch.column(1)):
                n_tokens[first : first + len(texts)] = count(texts)
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.record_batch([batch.column(0), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(texts, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
