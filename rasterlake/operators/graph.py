"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterlake.session import materialize, ship_code, tasks_for

#: Edges of a block, and how many times as long the block of one group may get.
BLOCK_EDGES, LONG = 1_000_000, 4


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``n`` nodes that each reaches by the edges ``a, b``."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _forest_of(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Each node of some edges with the smallest node that it reaches by them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = roots(len(nodes), at[: len(u)], at[len(u) :])
    keep = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[keep], pa.int64()), pa.array(nodes[root[keep]], pa.int64())], names=["u", "v"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of a task, block by block, by stars of what they connect.

    A third column names groups whose edges follow each other; a block ends with a
    group, unless that is long.
    """
    u, v, held = [], [], 0

    def pieces() -> Iterator[tuple[pa.RecordBatch, bool]]:
        for batch in batches:
            cut = 0
            if batch.num_columns > 2 and held + batch.num_rows >= BLOCK_EDGES and batch.num_rows:
                key = batch.column(2).to_numpy(zero_copy_only=False)
                cut = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
            yield batch.slice(0, cut), cut > 0
            yield batch.slice(cut), batch.num_columns == 2 or held > LONG * BLOCK_EDGES

    for batch, ends in pieces():
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held >= BLOCK_EDGES and ends:
            yield _forest_of(np.concatenate(u), np.concatenate(v))
            u, v, held = [], [], 0
    if held:
        yield _forest_of(np.concatenate(u), np.concatenate(v))


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller node at most, and that one has none."""
    low = edges.select(F.col("u").alias("x"), "v", F.lit(False).alias("root"))
    ends = low.unionByName(edges.select(F.col("v").alias("x"), F.lit(None).cast("bigint").alias("v"), F.lit(True).alias("root")))
    node = ends.groupBy("x").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max("root").alias("root"))
    return node.filter("least <> most or (root and least is not null)").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", within: str | None = None) -> DataFrame:
    """Smallest reachable id of every node that has an edge.

    Each task first reduces its edges to stars.  Then the published large-star
    and small-star steps alternate until only stars are left.  Every step is a
    ``groupBy`` minimum (combined before the shuffle) and one join, so no
    component is gathered in one task.  Null ends and self loops are ignored;
    repeated edges count once; ids are whole numbers of 64 bits.

    ``within`` is a column of groups that no edge leaves.  Their edges then meet in a
    task, sorted by group, so that most groups are stars from the start; adaptive
    execution splits the tasks of large groups, and the rounds join those.

    Returns ``node, component``; nodes without edges are absent.
    """
    ship_code(edges.sparkSession)
    e = edges.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v"), *([F.col(within).alias("g")] if within else []))
    e = e.filter("u is not null and v is not null and u <> v")
    if within:
        e = e.hint("rebalance", "g").select("u", "v", F.xxhash64("g").alias("g")).sortWithinPartitions("g")
    e = materialize(e.mapInArrow(_forest, "u bigint, v bigint").distinct(), "cc")
    while not _is_stars(e):
        # a step makes at most two rows of an edge
        tasks = tasks_for(e.sparkSession, 2 * e.count())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc", tasks)
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "cc", tasks)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc", tasks)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc", tasks)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
