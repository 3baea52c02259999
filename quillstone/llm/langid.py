"""Language identification with interpolated Kneser-Ney character models.

The training rows' character n-grams of the highest order are counted over the
whole corpus: per partition first, then by (language, n-gram).  The lower
orders follow from continuation counts of those, and discounts from how many
n-grams were seen once and twice.  All of it is made by aggregates and joins
on (language, n-gram), so no n-gram is left out, however rare or many, and
nothing but the names of the languages reaches the driver.  A document goes to
the language with the lowest cross-entropy per character.

A model of at most ``MODEL_ROWS`` entries is broadcast as sorted hash arrays:
for each order the hashes of (language, n-gram) with their interpolated
probability, and of (language, context) with the weight of the next lower
order.  Lookups go through a direct-mapped cache in each worker; misses search
the arrays.  A larger model stays where it is.  Then the documents are cut into
blocks of ``BLOCK_BYTES``, each block asks for its distinct n-grams, and gets
them back as a sorted hash array of its own.  Both ways give the same results.

A rejection is calibrated on the training rows whose language is the predicted
one: for each language and text length (in powers of two), the median of the
winning cross-entropy, and its spread below the median, which foreign texts
hardly move.
A document that exceeds the median by more than ``DEVIATIONS`` spreads, and by
more than ``LEAST_EXCESS`` nats, is rejected, as is one without letters.

Edge cases: a text that is null or has no letter is ``und`` with score 0 and
rejected; very long texts are scored whole, some characters at a time; rows
with a null language are never learned from; a tie goes to the first language
by code point; without any training row all texts are ``und``; repeated rows
count each; a null id is kept and counts as training data only through its
language, its held_out being false; an empty table gives no rows.  Only
``doc_id``, ``text`` and ``lang`` are read, and the columns that a caller asks to
keep, whatever others there are and however they are named.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.common import held_out, join_heavy, map_arrow, materialise

ORDER = 4
#: Discount of a language and order where no n-gram was seen once, or none twice, and the limits of others.
DISCOUNT = 0.75
DISCOUNTS = (0.1, 0.95)
#: Entries of a model that is broadcast, 16 bytes each.
MODEL_ROWS = 4_000_000
#: Text of a block that asks for its n-grams.
BLOCK_BYTES = 8 << 20
#: Counted n-grams that a task holds before it hands them on to be summed.
HELD_GRAMS = 1_000_000
DEVIATIONS = 8.0
LEAST_EXCESS = 0.6
#: Rows that a length class of a language needs for limits of its own.
LEAST_ROWS = 30
#: Probabilities that are looked up together (characters times languages).
TOGETHER = 1 << 20
_CACHE_BITS = 18
_SPACE = 0x20
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def characters(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (lower case, runs of others as one space, order-1 spaces before each text), row offsets, letters by row."""
    table = _letter_table()
    pad = " " * (order - 1)
    lowered = [(t or "").lower() for t in texts]
    raw = np.frombuffer("".join(pad + t for t in lowered).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t) for t in lowered], np.int64) + order - 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    letter = table[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    for k in range(order - 1):
        keep[offsets[:-1] + k] = True
    if order > 1:
        at = offsets[:-1] + order - 1
        at = at[at < offsets[1:]]
        keep[at] = letter[at]
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    total = np.concatenate([[0], np.cumsum(letter)])
    return np.where(letter, raw, np.uint32(_SPACE))[keep], kept, total[offsets[1:]] - total[offsets[:-1]]


def gram_hash(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), K.U64)
    for p in parts:
        h = (h + p.astype(K.U64)) * K.U64(0x9E3779B97F4A7C15)
        h ^= h >> K.U64(29)
    return h


def _language_salt(k: int | np.ndarray) -> np.ndarray:
    """What is added to the hash of an n-gram for each language."""
    return (np.atleast_1d(k).astype(np.int64) + 1).astype(K.U64) * K.U64(0xD1B54A32D192ED03)


def windows(points: np.ndarray, offsets: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all n-grams that end in a text's own characters, and row offsets of them."""
    inside = np.ones(len(points), bool)
    for k in range(order - 1):
        inside[offsets[:-1] + k] = False
    at = np.flatnonzero(inside)
    return [points[at - order + 1 + k] for k in range(order)], offsets - (order - 1) * np.arange(len(offsets))


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text); gram has ``order`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def add(lang: str, h: np.ndarray, n: np.ndarray, cols: np.ndarray) -> None:
            if lang in total:
                h, n, cols = (np.concatenate(x) for x in zip(total[lang], (h, n, cols), strict=True))
                o = np.argsort(h, kind="stable")
                h, n, cols = h[o], n[o], cols[o]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                h, n, cols = h[first], np.add.reduceat(n, first), cols[first]
            total[lang] = h, n, cols

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (_, n, cols) in total.items():
                text = np.ascontiguousarray(cols).astype("<u4").tobytes().decode("utf-32-le")
                yield pa.record_batch([pa.array([lang] * len(n)), pa.array([text[i : i + order] for i in range(0, len(text), order)], pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            total.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for part in K.slices(batch.column(1)):
                by: dict[str, list[int]] = defaultdict(list)
                for i in range(len(part)):
                    by[langs[part.first + i]].append(i)
                for lang, rows in by.items():
                    texts = [part.data[part.offsets[i] : part.offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in rows]
                    points, offsets, _ = characters(texts, order)
                    cols, _ = windows(points, offsets, order)
                    if len(cols[0]):
                        h, first, n = _unique(gram_hash(cols))
                        add(lang, h, n, np.column_stack([c[first] for c in cols]))
            if sum(len(x[0]) for x in total.values()) > HELD_GRAMS:
                yield from flush()
        yield from flush()

    return map_arrow(docs.select("lang", "text"), run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, first, n = np.unique(h, return_index=True, return_counts=True)
    return u, first, n


@dataclass
class Tables:
    """A model as distributed tables: (lang, g, p) and (lang, c, back) by order, c being g without its last character."""

    langs: list[str]
    floor: list[float]
    grams: dict[int, DataFrame]
    contexts: dict[int, DataFrame]

    def rows(self) -> int:
        return sum(t.count() for t in (*self.grams.values(), *self.contexts.values()))


def tables(counts: DataFrame, order: int = ORDER) -> Tables:
    """Interpolated Kneser-Ney models from (lang, gram, n), gram having ``order`` characters."""
    level = {order: materialise(counts.select("lang", F.col("gram").alias("g"), "n"))}
    for o in range(order - 1, 0, -1):
        level[o] = materialise(level[o + 1].groupBy("lang", F.substring("g", 2, o).alias("g")).agg(F.count("*").alias("n")))
    langs = sorted(r.lang for r in level[1].select("lang").distinct().collect())
    alphabet = level[1].select("g").union(counts.sparkSession.range(1).select(F.lit(" "))).distinct().count() + 1
    grams: dict[int, DataFrame] = {}
    contexts: dict[int, DataFrame] = {}
    floor: list[float] = []
    for o in range(1, order + 1):
        rows = level[o].withColumn("c", F.substring("g", 1, o - 1))
        once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        usual = F.greatest(F.lit(DISCOUNTS[0]), F.least(F.lit(DISCOUNTS[1]), once / (once + 2 * twice)))
        # one row a language
        discount = F.broadcast(rows.groupBy("lang").agg(F.when((once > 0) & (twice > 0), usual).otherwise(DISCOUNT).alias("d")))
        found = rows.groupBy("lang", "c").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(discount, "lang")
        found = materialise(found.select("lang", "c", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("back")))
        p = rows.join(found, ["lang", "c"]).withColumn("own", F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total"))
        if o == 1:
            of = {r.lang: r.back for r in found.collect()}
            floor = [of[k] / alphabet for k in langs]
            p = p.withColumn("lower", F.lit(1.0 / alphabet))
        else:
            p = p.join(grams[o - 1].select("lang", F.col("g").alias("end"), F.col("p").alias("lower")).withColumnRenamed("lang", "l"), (F.col("lang") == F.col("l")) & (F.substring("g", 2, o - 1) == F.col("end")))
            contexts[o] = found.select("lang", "c", "back")
        grams[o] = materialise(p.select("lang", "g", (F.col("own") + F.col("back") * F.col("lower")).alias("p")))
    return Tables(langs, floor, grams, contexts)


def _columns_of(texts: pa.Array | pa.ChunkedArray, width: int) -> list[np.ndarray]:
    """Code points of strings that all have ``width`` characters, a column each place."""
    parts = [np.zeros(0, np.uint32)]
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        chunk = chunk.cast(pa.large_string())
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, np.int64)
        raw = data.to_pybytes()[ends[0] : ends[-1]] if len(chunk) else b""
        parts.append(np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32))
    points = np.concatenate(parts).reshape(-1, width)
    return [points[:, i] for i in range(width)]


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


class Scorer:
    """Cross-entropies of texts; subclasses look up the probabilities of n-grams."""

    def __init__(self, langs: list[str], order: int):
        self.langs, self.order = langs, order

    def looked_up(self, cols: list[np.ndarray]) -> np.ndarray:
        """log p(last character | the others), one column a language."""
        raise NotImplementedError

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy in nats a character by row and language, characters and letters by row."""
        points, offsets, letters = characters(texts, self.order)
        cols, by_row = windows(points, offsets, self.order)
        total = np.zeros((len(texts), len(self.langs)))
        step = max(1, TOGETHER // max(1, len(self.langs)))
        row = K.row_of(by_row)
        for i in range(0, len(row) if self.langs else 0, step):
            got = self.looked_up([c[i : i + step] for c in cols])
            here = row[i : i + step]
            first = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
            total[here[first]] += np.add.reduceat(got, first, axis=0, dtype=np.float64)
        n = np.diff(by_row)
        return -total / np.maximum(n, 1)[:, None], n, letters

    def judged(self, texts: list[str | None]) -> list[pa.Array]:
        """lang_pred, score, entropy and n of each text."""
        entropy, n, letters = self.entropies(texts)
        if self.langs:
            best = entropy.argmin(axis=1)
            low = entropy[np.arange(len(texts)), best]
            odds = np.exp(-(entropy - low[:, None]) * np.minimum(n, 100)[:, None]).sum(axis=1)
            sure = np.where(letters > 0, 1 / odds, 0.0)
            names = [self.langs[b] if k else "und" for b, k in zip(best, letters, strict=True)]
        else:
            low, sure, names = np.zeros(len(texts)), np.zeros(len(texts)), ["und"] * len(texts)
        return [pa.array(names, pa.string()), pa.array(np.round(sure, 6)), pa.array(np.round(low, 9)), pa.array(n, pa.int64())]


class Model(Scorer):
    """All n-grams of all languages in sorted hash arrays."""

    def __init__(self, made: Tables):
        order = max(made.grams)
        super().__init__(made.langs, order)
        self.floor = np.array(made.floor)

        def arrays(df: DataFrame, name: str, value: str, width: int) -> tuple[np.ndarray, np.ndarray]:
            place = F.array_position(F.array(*[F.lit(x) for x in self.langs]), F.col("lang")) if self.langs else F.lit(0)
            got = df.select((place - 1).cast("int").alias("k"), F.col(name).alias("s"), F.col(value).alias("v")).toArrow()
            h = gram_hash(_columns_of(got.column("s"), width))
            return _sorted(K.mix(h + _language_salt(got.column("k").to_numpy())), got.column("v").to_numpy())

        none = (np.zeros(0, K.U64), np.zeros(0))
        self.grams = [none] + [arrays(made.grams[o], "g", "p", o) for o in range(1, order + 1)]
        self.contexts = [none, none] + [arrays(made.contexts[o], "c", "back", o - 1) for o in range(2, order + 1)]
        self._cache: tuple[np.ndarray, np.ndarray] | None = None

    @staticmethod
    def _find(store: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: np.ndarray | float) -> np.ndarray:
        if not len(store[0]):
            return np.broadcast_to(missing, len(keys)).astype(float)
        at = np.minimum(np.searchsorted(store[0], keys), len(store[0]) - 1)
        return np.where(store[0][at] == keys, store[1][at], missing)

    def log_probabilities(self, cols: list[np.ndarray]) -> np.ndarray:
        """log p(last character | the others), one column a language, by searching the sorted arrays."""
        out = np.empty((len(cols[0]), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            p = np.full(len(cols[0]), self.floor[k])
            for o in range(1, self.order + 1):
                end = cols[self.order - o :]
                if o > 1:
                    p = p * self._find(self.contexts[o], K.mix(gram_hash(end[:-1]) + _language_salt(k)), 1.0)
                p = self._find(self.grams[o], K.mix(gram_hash(end) + _language_salt(k)), p)
            out[:, k] = np.log(p)
        return out

    def looked_up(self, cols: list[np.ndarray]) -> np.ndarray:
        if self._cache is None:
            self._cache = np.zeros(1 << _CACHE_BITS, K.U64), np.zeros((1 << _CACHE_BITS, len(self.langs)), np.float32)
        keys, rows = self._cache
        h = gram_hash(cols)
        slot = (h >> K.U64(64 - _CACHE_BITS)).astype(np.int64)
        out = rows[slot]
        miss = np.flatnonzero(keys[slot] != h)
        if len(miss):
            u, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            got = self.log_probabilities([c[miss[first]] for c in cols])
            out[miss] = got[back]
            at = (u >> K.U64(64 - _CACHE_BITS)).astype(np.int64)
            keys[at] = u
            rows[at] = got
            # of several n-grams for a slot numpy keeps the last in both arrays
        return out


class Answers(Scorer):
    """The n-grams that one block asked for, in a sorted hash array."""

    def __init__(self, langs: list[str], order: int, names: pa.ChunkedArray, logs: np.ndarray):
        super().__init__(langs, order)
        self.keys, self.logs = _sorted(gram_hash(_columns_of(names, order)), logs)

    def looked_up(self, cols: list[np.ndarray]) -> np.ndarray:
        h = gram_hash(cols)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        if (self.keys[at] != h).any():
            raise RuntimeError("a block holds an n-gram that it did not ask for")
        return self.logs[at]


def train(docs: DataFrame, order: int = ORDER) -> Tables:
    """A model of all n-grams from all rows of (text, lang) whose language is known."""
    return tables(count_grams(docs.where("lang is not null").select("lang", "text"), order), order)


_JUDGED = ("lang_pred", "score", "entropy", "n")


def identify(docs: DataFrame, made: Tables, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """lang_pred, score, entropy and n of every text, beside the columns to keep."""
    texts = docs.select(*keep, F.col("text").cast("string").alias("text"))
    if made.rows() > MODEL_ROWS:
        return _by_block(texts, made)
    shared = docs.sparkSession.sparkContext.broadcast(Model(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in K.slices(batch.column("text")):
                here = batch.slice(part.first, len(part))
                yield pa.record_batch([*here.columns[:-1], *m.judged(here.column("text").to_pylist())], names=[*here.schema.names[:-1], *_JUDGED])

    return map_arrow(texts, run, _schema(texts.drop("text")))


def _schema(kept: DataFrame) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return ", ".join([*fields, "lang_pred string, score double, entropy double, n long"])


def _by_block(texts: DataFrame, made: Tables) -> DataFrame:
    """The same where the model is too large to be broadcast."""
    order, langs = max(made.grams), made.langs

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in K.slices(batch.column("text"), BLOCK_BYTES):
                if held and held + len(part.data) > BLOCK_BYTES:
                    block, held = block + 1, 0
                held += len(part.data)
                here = batch.slice(part.first, len(part))
                yield pa.record_batch([*here.columns, pa.array(np.full(len(part), block, np.int64))], names=[*here.schema.names, "__block"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    dealt = materialise(map_arrow(texts, deal, f"{fields}, __block long"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, np.zeros((0, order), np.uint32)
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for part in K.slices(batch.column(1)):
                here = blocks[part.first : part.first + len(part)]
                cuts = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1], [True]]))
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if here[lo] != at:
                        yield _asked(at, seen)
                        at, seen = here[lo], seen[:0]
                    points, offsets, _ = characters(batch.column(1).slice(part.first + lo, hi - lo).to_pylist(), order)
                    seen = np.concatenate([seen, np.column_stack(windows(points, offsets, order)[0])])
                    seen = seen[np.unique(gram_hash(list(seen.T)), return_index=True)[1]]
        yield _asked(at, seen)

    def _asked(at: int | None, seen: np.ndarray) -> pa.RecordBatch:
        text = np.ascontiguousarray(seen).astype("<u4").tobytes().decode("utf-32-le")
        return pa.record_batch([pa.array(np.full(len(seen), at or 0, np.int64)), pa.array([text[i : i + order] for i in range(0, len(text), order)], pa.string())], names=["__block", "g"])

    asked = materialise(map_arrow(dealt.select("__block", "text"), ask, "__block long, g string"))
    probabilities = materialise(_probabilities(asked.groupBy("g").agg(F.count("*").alias("rows")), made))
    answers = join_heavy(asked, probabilities, ["g"], "rows", asked.count()).select("__block", "g", "logs")
    names = texts.columns

    def judge(docs: pa.Table, found: pa.Table) -> pa.Table:
        logs = found.column("logs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs)) if len(found) else np.zeros((0, len(langs)), np.float32)
        scorer = Answers(langs, order, found.column("g"), logs)
        out = []
        for part in K.slices(docs.column("text")):
            here = docs.slice(part.first, len(part)).combine_chunks()
            got = scorer.judged(here.column("text").to_pylist())
            out.append(pa.table([*[here.column(c) for c in names[:-1]], *got], names=[*names[:-1], *_JUDGED]))
        return pa.concat_tables(out)

    return dealt.groupBy("__block").cogroup(answers.groupBy("__block")).applyInArrow(judge, _schema(texts.drop("text")))


def _probabilities(asked: DataFrame, made: Tables) -> DataFrame:
    """(g, rows, logs): the log probability by language of every n-gram that is asked for.

    Each order joins its n-grams and contexts to the probabilities of the next
    lower one.  No more than an alphabet of n-grams share a context or an end.
    """
    order, langs = max(made.grams), made.langs
    place = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int")

    def by_language(df: DataFrame, name: str, value: str) -> DataFrame:
        return df.groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct(place, value))).alias(value))

    of: Column = F.array(*[F.lit(x) for x in made.floor])
    lower: DataFrame | None = None
    for o in range(1, order + 1):
        wanted = asked.select("g", "rows") if o == order else asked.select(F.substring("g", order - o + 1, o).alias("g")).distinct()
        rows = wanted.join(by_language(made.grams[o], "g", "p"), "g", "left")
        if lower is None:
            rows = rows.withColumn("lower", of).withColumn("back", F.lit(None).cast("map<int,double>"))
        else:
            rows = rows.withColumn("c", F.substring("g", 1, o - 1)).withColumn("end", F.substring("g", 2, o - 1))
            rows = rows.join(by_language(made.contexts[o], "c", "back"), "c", "left").join(lower.select(F.col("g").alias("end"), F.col("ps").alias("lower")), "end")
        ps = F.transform(F.sequence(F.lit(1), F.lit(len(langs))), lambda k: F.coalesce(F.try_element_at("p", k), F.coalesce(F.try_element_at("back", k), F.lit(1.0)) * F.get("lower", k - 1)))
        lower = rows.select("g", *(["rows"] if o == order else []), ps.alias("ps"))
    return lower.select("g", "rows", F.transform("ps", lambda p: F.log(p).cast("float")).alias("logs"))


def predict(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected for every document of (doc_id, text, lang), and the columns to keep."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), *keep)
    made = train(texts.where(~held_out("doc_id", 4, 2)))
    found = materialise(identify(texts, made, ("doc_id", "lang", *keep)).withColumn("held_out", held_out("doc_id", 4, 2)).withColumn("size", F.floor(F.log2(F.col("n") + 1)).cast("int")))
    usual = found.where(~F.col("held_out") & (F.col("lang_pred") == F.col("lang")))
    middle = lambda: F.percentile_approx("entropy", [0.25, 0.5])
    # a row a language, and one for each of its powers of two
    whole = F.broadcast(usual.groupBy("lang_pred").agg(middle().alias("all_at")))
    sized = F.broadcast(usual.groupBy("lang_pred", "size").agg(middle().alias("at"), F.count("*").alias("rows")))
    own = F.coalesce(F.col("rows"), F.lit(0)) >= LEAST_ROWS
    at = F.when(own, F.col("at")).otherwise(F.col("all_at"))
    # the lower quartile of a normal distribution is 0.6745 deviations below its median
    limit = at[1] + F.greatest(F.lit(LEAST_EXCESS), DEVIATIONS / 0.6745 * (at[1] - at[0]))
    # short texts vary more than the limits of a whole language allow for
    spread = F.when(own, F.lit(0.0)).otherwise(F.lit(12.0) / F.sqrt(F.col("n") + 1))
    rejected = F.when(F.col("lang_pred") == "und", True).otherwise(F.coalesce(F.col("entropy") > limit + spread, F.lit(False)))
    return found.join(whole, "lang_pred", "left").join(sized, ["lang_pred", "size"], "left").select("doc_id", "held_out", "lang_pred", "score", "entropy", rejected.alias("rejected"), *keep)
