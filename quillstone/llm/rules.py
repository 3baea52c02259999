"""Quality rules combined by weak supervision, in DataFrame operations only.

Each rule reads a few counts of a document and votes 1 (good), -1 (bad) or 0
(abstains).  Expectation-maximisation over the votes of all documents, without
any label, estimates the share of good documents and each rule's accuracy on
either side: how often it votes which way on good and on bad documents.  A
rare vote against that good documents hardly ever get thus weighs more than
many common votes for.  The posterior probability of being good then replaces
the usual demand that all rules pass.  The driver only ever sees the number of
documents by vote pattern, at most 3 to the number of rules.

Repeated three-word windows are found through their 64-bit hashes, within one
document at a time.

Edge cases: null text has no words, counts of 0 and fails the base rules, as
does an empty one; very long texts are counted whole; repeated rows are judged
each; documents with equal votes have equal posteriors, and one equal to the
threshold is kept; null ids are kept; an empty table gives no rows.  Only
``doc_id`` and ``text`` are read, whatever other columns there are and however
they are named.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import BLANK, blank_ends, materialise

ITERATIONS = 60
#: Limits of the share of good documents, and pseudo-counts of the votes: a rule always may err.
PRIOR = (0.5, 0.98)
SMOOTH = 0.002
#: First guess of being good without and with a vote against.
GUESS = (0.95, 0.3)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_shouts, n_stops, n_letters, n_marked."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = lambda chars: F.length(F.regexp_replace("text", rf"[^{chars}]+", ""))
    df = docs.select("doc_id", text.alias("text"))
    df = df.withColumn("split", F.split("text", BLANK))
    first, last = blank_ends(F.col("text"))
    # without the empty words at the ends; an empty text is one of them
    n = F.when(F.col("text") == "", 0).otherwise(F.size("split") - first - last)
    df = df.withColumn("words", F.slice("split", first + 1, n))
    df = df.withColumn("n", F.size("words"))
    m = F.greatest(F.col("n") - 2, F.lit(0))
    pair = F.zip_with(F.slice("words", 1, m), F.slice("words", 2, m), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("triples", F.when(m > 0, F.zip_with(pair, F.slice("words", 3, m), lambda h, c: F.xxhash64(h, c))).otherwise(F.array().cast("array<long>")))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # only documents that repeat a window pay for finding where
    placed = F.sort_array(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("triples")) < F.size("triples")
    df = df.withColumn("placed", F.when(repeats, placed))
    k = F.size("placed") - 1
    twice = F.flatten(F.zip_with(F.slice("placed", 1, k), F.slice("placed", 2, k), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>"))))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(twice), lambda i: F.array(i, i + 1, i + 2)))))
    return df.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        kept(r"#*$%&|<>").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("placed").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        kept("A-Z").cast("long").alias("n_capitals"),
        kept("!").cast("long").alias("n_shouts"),
        kept(".?").cast("long").alias("n_stops"),
        kept(r"\p{L}").cast("long").alias("n_letters"),
        # words that hold one of the symbols
        F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D#*$%&|<>]*+[#*$%&|<>]")).cast("long").alias("n_marked"),
    )


def rules() -> dict[str, Column]:
    """The votes, as columns over :func:`counts`."""
    c = F.col
    chars, words = F.greatest(c("word_chars"), F.lit(1)), F.greatest(c("n_words"), F.lit(1))

    def vote(value: Column, bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    def low(value: Column, good: float, bad: float) -> Column:
        return vote(value, value > bad, value <= good)

    length = c("word_chars") / words
    return {
        "enough_words": vote(words, c("n_words") < 50, c("n_words") >= 80),
        "few_symbols": low(c("n_symbols") / chars, 0.005, 0.03),
        "few_marked_words": low(c("n_marked") / words, 0.02, 0.15),
        "mostly_letters": vote(words, c("n_letters") * 100 < 80 * c("word_chars"), c("n_letters") * 100 >= 90 * c("word_chars")),
        "new_lines": low(c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)), 0.0, 0.2),
        "new_windows": low(c("n_repeat_words") / words, 0.1, 0.3),
        "few_capitals": low(c("n_capitals") / chars, 0.1, 0.3),
        "few_shouts": low(c("n_shouts") / chars, 0.002, 0.02),
        "word_length": vote(length, (length < 2.5) | (length > 16), (length >= 3) & (length <= 12)),
        "has_stops": vote(words, c("n_stops") * 100 < words, (c("n_stops") * 50 >= words) & (c("n_stops") * 2 <= words)),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, iterations: int = ITERATIONS) -> tuple[float, list[dict[int, float]]]:
    """(share of good documents, log odds of being good by rule and vote) by expectation-maximisation over vote patterns.

    A vote against never speaks for a document, nor a vote for against it;
    abstaining says nothing.
    """
    none = [{-1: 0.0, 0: 0.0, 1: 0.0} for _ in range(n_rules)]
    if not patterns:
        return 0.8, none
    good = [GUESS[-1 in votes] for votes, _ in patterns]
    total = sum(n for _, n in patterns)
    prior, odds = 0.8, none
    for _ in range(iterations):
        n_good = sum(n * p for (_, n), p in zip(patterns, good, strict=True))
        prior = min(max(n_good / total, PRIOR[0]), PRIOR[1])
        odds = []
        for j in range(n_rules):
            seen = {(v, y): 0.0 for v in (-1, 1) for y in (0, 1)}
            for (votes, n), p in zip(patterns, good, strict=True):
                if votes[j]:
                    seen[votes[j], 1] += n * p
                    seen[votes[j], 0] += n * (1 - p)
            voted = [seen[-1, y] + seen[1, y] for y in (0, 1)]
            rate = {(v, y): (seen[v, y] + SMOOTH * total * 0.5) / (voted[y] + SMOOTH * total) for v, y in seen}
            against, in_favour = (math.log(rate[v, 1] / rate[v, 0]) for v in (-1, 1))
            odds.append({-1: min(against, 0.0), 0: 0.0, 1: max(in_favour, 0.0)})
        good = [posterior(prior, odds, votes) for votes, _ in patterns]
    return prior, odds


def posterior(prior: float, odds: list[dict[int, float]], votes: tuple[int, ...]) -> float:
    z = math.log(prior / (1 - prior)) + sum(o[v] for o, v in zip(odds, votes, strict=True))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The counts, base_failed, each rule's vote, posterior and kept for every document."""
    votes = rules()
    counted = materialise(counts(docs).select("*", *[v.alias(f"vote_{k}") for k, v in votes.items()]))
    names = [f"vote_{k}" for k in votes]
    patterns = [(tuple(r[n] for n in names), r["count"]) for r in counted.groupBy(*names).count().collect()]
    prior, weights = estimate(sorted(patterns), len(names))
    odds = F.lit(math.log(prior / (1 - prior)))
    for n, w in zip(names, weights, strict=True):
        odds = odds + F.when(F.col(n) < 0, w[-1]).when(F.col(n) > 0, w[1]).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = counted.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
