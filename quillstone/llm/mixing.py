"""Mixing sources to target weights, in DataFrame operations only.

Every source's words, in the order of a hash of the documents, form a stream
that is packed into blocks of ``BLOCK`` words.  The mix is a row of slots dealt
into output shards.  Each slot draws its source from the targets, which gives
every shard multinomial source counts; draws beyond a source's exact total are
handed to the sources that came short, so the totals hold to half a block.
The k-th slot of a source takes block perm(k mod n) of its n blocks, where
perm is a keyed swap-or-not permutation of 0..n-1: no block is taken again
before all have been, and the order of blocks is pseudorandom.  Slots and the
documents' pieces of blocks are then joined by (source, block).

Prefix sums run in two steps, within (source, bucket) and over the buckets, so
no source's rows meet in one task.  All draws are hashes of stable values and a
seed, so reruns agree.

Edge cases: null text has size 0; a document without words is never taken; very
long texts span many blocks; a null source is a source of its own and comes
last; sources that are full at the same level are taken in order of their names;
repeated rows and ids are packed one after the other like others, rows of equal
id and size being interchangeable; a null id sorts first; an empty table gives
no rows.  Only ``doc_id``, ``text`` and ``source`` are read, whatever other columns
there are and however they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import BLANK, blank_ends, materialise

BLOCK = 64
SHARD_SLOTS = 1024
BUCKETS = 1024
#: Weights of the sources by code point, repeating; most repeats of a source.
WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 7
#: Pieces that the range of draws is cut into, so that slots find their source by an equi-join.
PIECES = 4096
ROUNDS = 24


def size_of(text: str | Column = "text") -> Column:
    """Words of a text; 0 for null."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    first, last = blank_ends(text)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, BLANK)) - first - last).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) to target: shares by weight, with no source over ``repeats`` times its size.

    The windows are over one row a source.  Sorted by how soon a source is
    full, the common level is the largest that any prefix of full sources gives.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.withColumn("weight", F.get(w, (F.row_number().over(order) - 1) % len(weights))).withColumn("cap", repeats * F.col("source_size").cast("double"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole)
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / rest
    return ranked.withColumn("level", level).withColumn("level", F.max("level").over(whole)).select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def permuted(k: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 (swap-or-not, exact for every n)."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(x, partner)), F.lit(2)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), k, swap)


def _running(df: DataFrame, by: list[str], bucket: str, order: list[str], size: str, out: str) -> DataFrame:
    """Adds the sum of ``size`` over the earlier rows of ``by``: within buckets, then over the buckets' totals."""
    inner = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by, bucket).agg(F.sum(size).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(outer), F.lit(0)))
    return df.withColumn("_inner", F.coalesce(F.sum(size).over(inner), F.lit(0))).join(sums.drop("_sum"), [*by, bucket]).withColumn(out, F.col("_inner") + F.col("_before")).drop("_inner", "_before")


def slots(plan: DataFrame, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, s, k): the source of each slot and its number within the source.

    ``plan`` has (s, quota), one row a source.  The first slots of a source, up
    to its quota, keep what they drew; the others go by rank to open quotas.
    """
    spark = plan.sparkSession
    whole = Window.partitionBy()
    bounds = plan.where("quota > 0").withColumn("hi", F.sum("quota").over(Window.orderBy("s"))).withColumn("lo", F.col("hi") - F.col("quota")).withColumn("total", F.sum("quota").over(whole))
    step = F.greatest(F.lit(1), F.ceil(F.col("total") / PIECES))
    pieces = bounds.withColumn("step", step).withColumn("piece", F.explode(F.sequence(F.floor(F.col("lo") / F.col("step")), F.floor((F.col("hi") - 1) / F.col("step")))))
    total = bounds.agg(F.coalesce(F.max("total"), F.lit(0)).alias("n")).first().n
    each = max(1, -(-total // PIECES))
    parts = max(1, min(100_000, total // 50_000 + 1))
    drawn = spark.range(0, total, 1, parts).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(total, 1))).alias("u"))
    drawn = drawn.withColumn("piece", F.floor(F.col("u") / each)).join(pieces.select("piece", "lo", "hi", "s", "quota"), "piece").where("u >= lo and u < hi").select("shard", "slot", "s", "quota")
    # number within the source: slots before it, by shard and then within the shard
    counts = drawn.groupBy("s", "shard").agg(F.count("*").alias("c"))
    counts = counts.withColumn("group", F.floor(F.col("shard") / 4096))
    first = _running(counts, ["s"], "group", ["shard"], "c", "first").select("s", "shard", "first")
    inner = Window.partitionBy("shard", "s").orderBy("slot")
    numbered = drawn.withColumn("i", F.row_number().over(inner) - 1).join(first, ["s", "shard"]).withColumn("k", F.col("first") + F.col("i")).drop("first", "i")
    numbered = materialise(numbered)
    kept = numbered.where("k < quota").select("shard", "slot", "s", "k")
    got = numbered.groupBy("s").agg(F.count("*").alias("got"))
    short = plan.join(got, "s", "left").withColumn("got", F.least(F.coalesce("got", F.lit(0)), "quota")).where("quota > got")
    open_ = short.withColumn("k", F.explode(F.sequence(F.col("got"), F.col("quota") - 1))).select("s", "k", F.floor(F.col("k") / 4096).alias("group"), F.lit(1).alias("one"))
    # ranks of the open quotas and of the surplus slots, both few: of the order of the square root of all
    opened = _running(open_.withColumn("key", F.lit(0)).withColumn("group", F.col("s") * 1_000_000 + F.col("group")), ["key"], "group", ["k"], "one", "rank").select("rank", "s", "k")
    spare = numbered.where("k >= quota").select("shard", "slot", F.lit(0).alias("key"), F.floor(F.col("slot") / 65536).alias("group"), F.lit(1).alias("one"))
    spared = _running(spare, ["key"], "group", ["slot"], "one", "rank").select("rank", "shard", "slot")
    return kept.unionByName(spared.join(opened, "rank").select("shard", "slot", "s", "k"))


def pack(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, start): where each document begins in its source's stream."""
    rows = docs.select("doc_id", "source", "size").withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(BUCKETS)))
    # joins do not match nulls, so the source is also carried as a flag and a text
    keyed = rows.withColumn("no", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    return _running(keyed, ["no", "name"], "bucket", [F.col("doc_id"), F.col("size")], "size", "start").drop("bucket")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """(blocks, taken) for documents of (doc_id, text, source).

    blocks: (shard, slot, source, block), the mixed order; a block is the words
    block*BLOCK .. of its source's stream.  taken: doc_id, source, size,
    source_size, target and taken of every document.
    """
    sized = materialise(docs.select("doc_id", "source", size_of("text").alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(totals, weights, repeats).withColumn("s", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))))
    plan = plan.withColumn("n", F.ceil(F.col("source_size") / block)).withColumn("quota", F.when(F.col("n") > 0, F.least(repeats * F.col("n"), F.round(F.col("target") * F.col("n") / F.greatest(F.col("source_size"), F.lit(1))).cast("long"))).otherwise(F.lit(0).cast("long")))
    plan = materialise(plan.withColumn("no", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit(""))))
    drawn = slots(plan.select("s", "quota"), seed).join(plan.select("s", "source", "n"), "s")
    blocks = materialise(drawn.withColumn("block", permuted(F.pmod("k", "n"), F.col("n"), F.xxhash64(F.lit(seed), F.col("s")))).select("shard", "slot", "s", "source", "block"))
    times = blocks.groupBy("s", "block").agg(F.count("*").alias("times"))
    placed = pack(sized).join(plan.select("no", "name", "s", "source_size", "target"), ["no", "name"])
    pieces = placed.where("size > 0").select("s", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    part = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    got = pieces.join(times, ["s", "block"]).groupBy("s", "start").agg(F.sum(part * F.col("times")).alias("taken"))
    taken = placed.join(got, ["s", "start"], "left")
    taken = taken.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))
    return blocks.drop("s"), taken
