"""Connected components of a large graph by contraction of partitions, with each round written to the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edges that a task contracts at a time.
CHUNK = 1 << 18


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of the edges (a, b) that are not the least of their component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: the same components, in fewer edges; about CHUNK edges of a partition at a time become stars.

    The edge of the last row's first end goes on to the next ones, so where edges are sorted by it, each has one v.
    """

    def run(batches):
        a, b, n = [], [], 0
        for batch in batches:
            a.append(batch[0].to_numpy())
            b.append(batch[1].to_numpy())
            n += batch.num_rows
            if n >= CHUNK:
                last = a[-1][-1:]
                u, v = _stars(np.concatenate(a), np.concatenate(b))
                on = u == last
                yield pa.RecordBatch.from_arrays([pa.array(u[~on], pa.int64()), pa.array(v[~on], pa.int64())], names=["u", "v"])
                a, b, n = [u[on]], [v[on]], 0
        if a:
            u, v = _stars(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _is_forest(edges: DataFrame) -> bool:
    """Whether all of (u, v) are stars: each u has one v, which is no u."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.agg(F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()[0]


def _jumped(edges: DataFrame) -> DataFrame:
    """(u, v) with each v that is also a u replaced by its least v."""
    above = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("w"))
    return edges.join(above, "v", "left").select("u", F.coalesce("w", "v").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not the least of its component, root being that least node. edges: (a, b), any
    order.

    A round contracts each partition, deals the edges by their greater end, sorts them and contracts what met. Contracted partitions
    hold a node's edge once, so no node gets more edges than there are partitions. Ends that have an edge of their own are
    replaced by its other end, until none has; no round gathers a node's neighbours in one row.
    """
    e = edges.where(F.col("a") != F.col("b")).select("a", "b")
    while True:
        e = materialize(_contracted(_contracted(e).repartition("u").sortWithinPartitions("u")), "edges")
        if _is_forest(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = _jumped(e)
