"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import hook_components
from .common import cut

#: Links in a task (16 bytes each): up to so many are settled by one task, more are contracted by several first.
LINKS_PER_TASK = 500_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for all ends of the links (u, v); root is the smallest node of the component."""
    nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = where[: len(u)], where[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        up = root[root]
        while not np.array_equal(up, root):
            root, up = up, up[up]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node = root = np.zeros(0, np.int64)
    for batch in batches:
        u, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        node, root = contract(np.concatenate([node, u]), np.concatenate([root, v]))
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all ends of links, the first two columns of edges; label is the smallest node of the component.

    Each task contracts its links to stars. One task is enough up to LINKS_PER_TASK links;
    the stars of more tasks are joined by alternating rounds. edges is read twice, so it
    should be a table that is written.
    """
    a, b = edges.columns[:2]
    links = edges.select(F.col(a).cast("long"), F.col(b).cast("long"))
    tasks = -(-links.count() // LINKS_PER_TASK)
    stars = cut(links.coalesce(max(1, tasks)).mapInArrow(_contracted, "node long, label long"))
    if tasks <= 1:
        return stars
    return hook_components(stars.select(F.col("node").alias("u"), F.col("label").alias("v")))
