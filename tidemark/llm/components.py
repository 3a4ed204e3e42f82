"""Connected components of a link table, never on the driver.

Each round contracts the graph twice. First every task takes up to ``TASK_LINKS`` links and joins
what they connect by itself, so few links are one round. Then every node that is left points to
its smallest neighbour: such pointers form trees whose only cycles are pairs (the smaller of the
two is the root), each with at least two nodes, so the nodes at least halve in a round. Pointers
are followed by doubling, links move to the roots, and rounds go on until no link is left: their
number grows with the logarithm of the nodes, whatever the shape; a long chain takes no longer.

Defined cases: without links there are no nodes; repeated links, links in both directions and links
of a node with itself change nothing (a node without any other link isn't listed).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, lean, written

TASK_LINKS = 1 << 20


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links, and the smallest node that each is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[root]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def _forest(batches):
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]  # at most about TASK_LINKS
    if held:
        nodes, roots = local_roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def _pointers(links: DataFrame) -> DataFrame:
    """(node, root) of every node: the root of the tree that pointers to smallest neighbours make."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    to = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "pointers")
    back = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
    mutual = (F.col("next") == F.col("node")) & (F.col("node") < F.col("root"))
    to = written(to.join(back, "root").select("node", F.when(mutual, F.col("node")).otherwise(F.col("root")).alias("root")), "pointers")
    while True:
        back = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
        further = written(to.join(back, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "pointers")
        if further.filter("moved").isEmpty():
            return to
        to = further.select("node", "root")


def components(links: DataFrame, task_links: int = TASK_LINKS, report: list | None = None) -> DataFrame:
    """(node, label) for every node of (a, b) links; nodes with the same label are connected. ``report`` gets the links of each round."""
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    steps = []
    n = edges.count()
    while n:
        if report is not None:
            report.append(n)
        tasks = -(-n // task_links)
        forest = written(edges.repartition(tasks).mapInArrow(lean(_forest), "node long, root long"), "forest")
        drop_written(edges)
        if tasks == 1:
            steps.append(forest)
            break
        links = written(forest.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct(), "links")
        to = _pointers(links)
        steps.append(to)
        x, y = (to.select(F.col("node").alias(c), F.col("root").alias(r)) for c, r in (("a", "x"), ("b", "y")))
        edges = written(links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "links")
        n = edges.count()
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = steps[-1].select("node", F.col("root").alias("label"))
    for step in reversed(steps[:-1]):
        out = step.join(out.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("label", "root").alias("label"))
    return written(out, "labels")
