"""Connected components of a graph that is given as a table of links.

Each task first joins its own links by union-find, so that a star is left of
them.  Then rounds of large-star and small-star steps, each two shuffles, bring
every node to the smallest node it can reach.  Nothing of the graph comes to the
driver but a count of links and their checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, give_back

_LINKS = "a long, b long"


class UnionFind:
    """Sets of integers; the smallest member stands for its set."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while (above := self.up.get(top, top)) != top:
            top = above
        while (above := self.up.get(x, x)) != top and x != top:
            self.up[x] = top
            x = above
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contract(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """A task's links as stars; written out whenever ``most`` nodes are held."""
    sets = UnionFind()

    def stars() -> pa.RecordBatch:
        nodes = list(sets.up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([sets.find(x) for x in nodes], pa.int64())], ["a", "b"])

    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for x, y in np.stack([a, b], 1).tolist():
            sets.join(x, y)
        if len(sets.up) > most:
            yield stars()
            sets = UnionFind()
    yield stars()
    del sets
    give_back()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or not larger) neighbours on the smallest node that it knows."""
    # links go from a to the smaller b
    if large:
        seen = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = seen.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        moved = seen.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("least"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node`` and ``component``, the smallest node it reaches, for all nodes of ``links`` (columns ``a`` and ``b``).

    Links with a null end, and links of a node to itself, are left out.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = cut(links.mapInArrow(_contract, _LINKS).where("a <> b"), "links")
    state = None
    for _ in range(most_rounds):
        links = cut(_star(_star(links, True), False), "stars")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
