"""Connected components of a distributed list of links.

Up to ALONE distinct links, 16 MB of them, are joined within one task.  The
steps below are dozens of jobs, which the driver plans, and with few links
most of their joins are broadcasts, which the driver builds.

More links take alternating large-star and small-star steps: each step joins
links with the smallest neighbour of one end, which is a map-side combined
minimum, and the number of links never grows.  Nodes with very many links are
joined by broadcast (see :func:`join_heavy`), so a hub is no hot key.  Nothing
is collected but sums for the end test; when those repeat, the links are stars
or the steps go on, so equal sums of different links end nothing.

Links are kept in few partitions (one for each TOGETHER of them), as every
step shuffles, and a shuffle writes a file for each partition that it reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import join_heavy, map_arrow, materialise

#: Distinct links that one task joins at most.
ALONE = 1_000_000

#: Links that a partition holds at least, where there are as many.
TOGETHER = 200_000


def _sums(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(links: DataFrame) -> bool:
    """No node has two links upwards, or one and a link from below."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _least(links: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, and how many it has."""
    return links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links"))


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as :func:`components`, of links in memory.

    Each root takes the smallest root that it is linked to, where that is
    smaller, until no link is between two roots; two rounds at least halve
    the roots that have links.
    """
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    below = root != np.arange(len(names))
    return names[below], names[root[below]]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [[c.to_numpy() for c in batch.columns] for batch in batches if len(batch)]
    if links:
        found = joined(*map(np.concatenate, zip(*links, strict=True)))
        yield pa.record_batch([pa.array(c, pa.int64()) for c in found], names=["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root): for each node of a link, the smallest node that links reach; roots are left out."""
    links = materialise(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    if links.count() <= ALONE:
        return materialise(map_arrow(links.coalesce(1), _at_once, "node long, root long"))
    before = _sums(links)
    for _ in range(most):
        if not before[0]:
            break
        few = -(-before[0] // TOGETHER)
        meet = (lambda x, y: x.join(y, "u")) if few == 1 else (lambda x, y: join_heavy(x, y, ["u"], "links", 2 * before[0]))  # noqa: B023
        links = links.coalesce(few)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(2 * few)
        least = _least(both).select("u", F.least("u", "m").alias("m"), "links")
        large = meet(both, least).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few).distinct()
        least = _least(large)
        small = meet(large, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).coalesce(few).distinct()
        links = materialise(small.coalesce(few))
        after = _sums(links)
        if after == before and _stars(links):
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
