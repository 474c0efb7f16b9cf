"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import staged


#: Edges that a worker holds at once.
HELD = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least node of a component, other node) with the same components as the edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[x], least[y])
        new = least.copy()
        for side in (least[x], least[y], x, y):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    hung = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[least[hung]], nodes[hung]


def _forests(batches):
    """Edges (a, b) of a task, as a forest of stars for every HELD of them."""
    held, count = [], 0

    def flush():
        a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(k).to_numpy() for k in (0, 1)])
            count += batch.num_rows
        if count >= HELD:
            yield flush()
            held, count = [], 0
    if held:
        yield flush()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or else: its smaller and its own) neighbours on the least of the neighbours and itself."""
    if large:
        links = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return links.where("b > a").join(least, "a").select(F.col("b").alias("b"), F.col("m").alias("a"))
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    hung = links.join(least, "a").where("b != m").select(F.col("b").alias("b"), F.col("m").alias("a"))
    return hung.union(least.select(F.col("a").alias("b"), F.col("m").alias("a")))


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """node, component (its least node), for every node of the edges (a, b: long, not null); stored.

    Each task first reduces its edges to a forest of stars. Then large and small stars alternate until the edges are stars: no node hangs on two others, or hangs and holds. All that is handled is rows of
    edges, stored after each step, and a node with very many neighbours is pre-aggregated before the shuffle and joined by a join whose hot keys are split.
    """
    edges = staged(edges.where("a != b").select("a", "b").mapInArrow(_forests, "a long, b long").distinct(), name)
    for _ in range(rounds):
        roles = edges.select(F.col("b").alias("node"), F.lit(1).alias("hung"), F.lit(0).alias("holds")).union(edges.select("a", F.lit(0), F.lit(1)))
        roles = roles.groupBy("node").agg(F.sum("hung").alias("hung"), F.max("holds").alias("holds"))
        if not roles.where("hung + holds > 1").agg(F.count(F.lit(1))).head()[0]:
            break
        big = staged(_star(edges, True), name)
        edges = staged(_star(big, False).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), name)
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return staged(out.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()), name)
