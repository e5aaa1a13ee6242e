"""Connected components of a link table by star contraction, and spanning forests inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.common import discard, materialise


class Forest:
    """Components of a task's links between the positions 0..n-1; links may come in blocks."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while not np.array_equal(shorter := label[label], label):
                label = shorter
        self.label = label

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, smallest position of its component) where the two differ."""
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return moved, self.label[moved]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links(src, dst)``; component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the links no longer change. Each step
    is an aggregation, which combines before its shuffle, and a join on the node, whose hot keys AQE splits; each
    round's links are written to the shared folder, and never come to the driver.
    Self-links and nulls are ignored; an empty table gives an empty result.
    """
    edges = materialise(
        links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        "links",
    )
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        done, edges = edges, materialise(small, "links")
        discard(done)
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
