"""Connected components of an edge table, by alternating large and small stars.

Each half-round is a partial aggregation for the least neighbour and an equi
join to hand it on (which adaptive execution may split where a node has very
many edges); edges are written to the shared folder after each round, and
those of the round before are deleted.  The number of rounds is logarithmic
in the largest component, and no edge or label reaches the driver.  A table
of at most ``ONE_TASK`` edges (a few MB, whatever the nodes' type) is finished
by one task instead of by rounds; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop_path, written, written_at

ONE_TASK = 1 << 18


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` and ``m``, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each node 0 to n - 1."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        live = a != b
        if not live.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[live], np.minimum(a, b)[live])
        while not np.array_equal(root, to := root[root]):
            root = to


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    edges = pa.Table.from_batches(held)
    ends = pa.chunked_array([*edges.column("u").chunks, *edges.column("v").chunks]).combine_chunks()
    nodes = ends.unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    at = pc.index_in(ends, nodes).to_numpy()
    root = roots(at[: edges.num_rows], at[edges.num_rows :], len(nodes))
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], ["node", "root"])


def components(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """node, root for every node of ``edges(u, v)`` (any orientation); root is the component's least node."""
    most = ONE_TASK if one_task is None else one_task
    edges, path = written_at(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, n = None, edges.count()
    while n > most:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = _with_least(large)
        near = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        replaced = path
        edges, path = written_at(near.where("u <> v").distinct(), "edges")
        drop_path(edges.sparkSession, replaced)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            heads = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(heads)
        before, n = state, state[0]
    kind = dict(edges.dtypes)["u"]
    return written(edges.repartition(1).mapInArrow(_finish, f"node {kind}, root {kind}"), "roots")
