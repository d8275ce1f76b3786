"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Edges up to which one task joins them, in arrays; more are joined by rounds over all tasks.
FEW_EDGES = 500_000


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, label) of the edges' nodes that aren't the smallest of their component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, label): the smallest node that each node of edges (u, v) reaches; the smallest nodes themselves have no row.

    Up to `few` edges are joined by one task. Beyond that large stars and small stars alternate: a node's larger
    neighbours, then its smaller ones, are tied to the smallest node in sight, until nothing changes. That takes
    about as many rounds as the logarithm of the longest path has. Each round is kept in the shared folder.
    Loops and repeated edges are allowed; edges with a null end are left out.
    """
    e = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u is not null and v is not null and u != v").distinct())
    if e.count() <= few:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = list(batches)
            if held:
                node, label = joined(np.concatenate([x["u"].to_numpy() for x in held]), np.concatenate([x["v"].to_numpy() for x in held]))
                yield pd.DataFrame({"node": node, "label": label})

        kinds = [f.dataType.simpleString() for f in e.schema.fields]
        return checkpointed(e.coalesce(1).mapInPandas(run, f"node {kinds[0]}, label {kinds[1]}"))
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u != v").distinct()
        e = checkpointed(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now
