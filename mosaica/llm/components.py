"""Connected components of links between rows, without gathering a component anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import discard, save, tidied

#: Links whose components a task finds at once.
AT_ONCE = 500_000
LINK = "a long, b long, part int"


class Forest:
    """Components that joined edges make, one after the other; the root is the smallest."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars: each node with the smallest that its part of the links joins it to.

    ``part`` tells pieces apart: if there is one only, the stars are the components.
    """
    part, piece, forest, n = TaskContext.get().partitionId(), 0, Forest(), 0

    def stars() -> pa.RecordBatch:
        nodes = list(forest.up)
        pairs = [(x, r) for x in nodes if (r := forest.root(x)) != x]
        own = part if not piece else -part * 1000 - piece
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array(np.full(len(pairs), own, np.int32))], ["a", "b", "part"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(x, y)
        n += batch.num_rows
        if n > AT_ONCE:
            yield stars()
            forest, n, piece = Forest(), 0, piece + 1
    if n:
        yield stars()


def state_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.min("part"), F.max("part")).first())


def at_once(links: DataFrame) -> DataFrame:
    """The stars of at most ``AT_ONCE`` links, in one task: their components."""
    return save(links.select("a", "b").coalesce(1).mapInArrow(tidied(contract), LINK))


def rooted(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(stars.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long): ``root`` is the component's smallest node.

    Up to ``AT_ONCE`` links are one task's.  Of more, each partition makes stars of its links.  While these are more than
    ``AT_ONCE``, large-star and small-star steps follow in turn, and stars again, until nothing changes: each step is a
    minimum by node and a join with it, so a node of any degree is pre-aggregated or split, and all state is a written table.
    """
    if links.count() <= AT_ONCE:
        return rooted(at_once(links))
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = save(pairs.mapInArrow(tidied(contract), LINK))
    seen = state_of(edges)
    for _ in range(rounds):
        if not seen[0] or seen[2] == seen[3] >= 0:  # all in one piece
            break
        if seen[0] <= AT_ONCE:
            whole = at_once(edges)
            discard(edges)
            return rooted(whole)
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = save(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))  # all neighbours b are smaller than a now
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = save(small.mapInArrow(tidied(contract), LINK))
        discard(edges, large)
        edges, before = after, seen
        seen = state_of(edges)
        if seen[:2] == before[:2]:
            break
    else:
        raise RuntimeError("components did not settle")
    return rooted(edges)
