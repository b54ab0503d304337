"""Approximate nearest neighbours: NN-descent and greedy graph search.

Equal vectors are one node.  Blocks of a few random projections give a first
graph.  An NN-descent round gathers at each node its neighbours and a bounded
number of reverse neighbours, with their vectors, compares them with each other
and offers each the others that are nearer than its worst neighbour so far;
offers meet their node by a grouped top k.  A greedy search then starts at each
query's own node, expands the nearest nodes it has not expanded, and stops when
nothing nearer turns up.  It follows the graph's links and, of those that point at
a node, the ``reverse`` nearest, so a hub is no larger key than others.  All steps
are Spark joins; no vector is collected.

Inside the graph vectors are centred by column, scaled to 1 and held in single
precision, and distances are taken about each block's own centre; the final order
and scores are computed in double precision on the original vectors.

Edge cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part; a query without a valid vector has
no rows; ties go to the smaller ``vec_id``; of rows that repeat a ``vec_id`` the
one whose vector sorts first counts; with fewer candidates than ``k`` all are
returned; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rasterlake.session import materialize

SALTS = 32
BLOCK = 384


def _bytes(batches: Iterator[pa.RecordBatch], projections: int, scale: float, centre: np.ndarray, spread: float) -> Iterator[pa.RecordBatch]:
    """(id, vec, p0, p1, ...): centred and scaled single-precision bytes and random projections."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = ((np.array(batch.column(1).to_pylist(), np.float64) / scale - centre) / spread).astype(np.float32)
        axes = np.random.default_rng(7).standard_normal((x.shape[1], projections)).astype(np.float32)
        p = (x @ axes).astype(np.float64)
        cols = [batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), *(pa.array(p[:, j]) for j in range(projections))]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "vec", *(f"p{j}" for j in range(projections))])


def _nearest(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, d): the ``k`` nearest others of each row."""
    n = len(ids)
    if n < 2:
        return ids[:0], ids[:0], np.zeros(0, np.float32)
    x = x - x.mean(0)
    sq = (x * x).sum(1)
    d = sq[:, None] + sq - 2 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    k = min(k, n - 1)
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[at].ravel(), np.sqrt(np.maximum(np.take_along_axis(d, at, 1), 0)).ravel()


def _edges(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d.astype(np.float32))], names=["a", "b", "d"])


EDGES = "a bigint, b bigint, d float"


def _blocks(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vecs += batch.column(1).to_pylist()
            while len(ids) >= 2 * BLOCK:
                yield _edges(*_nearest(np.array(ids[:BLOCK]), np.array([np.frombuffer(v, np.float32) for v in vecs[:BLOCK]]), k))
                ids, vecs = ids[BLOCK:], vecs[BLOCK:]
        if ids:
            yield _edges(*_nearest(np.array(ids), np.array([np.frombuffer(v, np.float32) for v in vecs]), k))

    return run


def _local_join(k: int):
    """At one node: offers between the nodes gathered there, nearer than their limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for members in batch.column(0).to_pylist():
                ids = np.array([m["id"] for m in members], np.int64)
                x = np.array([np.frombuffer(m["vec"], np.float32) for m in members])
                limit = dict(zip(ids.tolist(), (m["far"] for m in members)))
                a, b, d = _nearest(ids, x, k)
                near = d < np.array([limit[i] for i in a.tolist()], np.float32)
                out.append((a[near], b[near], d[near]))
            if out:
                yield _edges(*(np.concatenate(c) for c in zip(*out)))

    return run


def _top(edges: DataFrame, k: int, key: str = "a") -> DataFrame:
    """The ``k`` nearest of each node; the limit is applied before the shuffle too."""
    w = Window.partitionBy(key).orderBy("d", "b")
    merged = edges.groupBy(key, "b").agg(F.min("d").alias("d"), *(F.max(c).alias(c) for c in edges.columns if c not in (key, "b", "d")))
    return merged.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def build_graph(nodes: DataFrame, k: int = 20, rounds: int = 5, reverse: int = 20, projections: int = 4) -> DataFrame:
    """``a, b, d``: about the ``k`` nearest others of each of ``nodes(id, vec, p*)``."""
    first = None
    for j in range(projections):
        part = nodes.repartitionByRange(f"p{j}").sortWithinPartitions(f"p{j}", "id").select("id", "vec").mapInArrow(_blocks(k), EDGES)
        first = part if first is None else first.unionByName(part)
    graph = materialize(_top(first, k), "ann")
    for r in range(rounds):
        back = Window.partitionBy("a").orderBy(F.xxhash64("b", F.lit(r)))
        turned = graph.select(F.col("b").alias("a"), F.col("a").alias("b")).withColumn("r", F.row_number().over(back)).filter(F.col("r") <= reverse).drop("r")
        gather = graph.select("a", "b").unionByName(turned).distinct()
        far = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).cast("float").alias("far"))
        info = materialize(nodes.select("id", "vec").join(far.withColumnRenamed("a", "id"), "id", "left").select("id", "vec", F.coalesce("far", F.lit(float("inf")).cast("float")).alias("far")), "ann")
        held = gather.join(info.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.collect_list(F.struct(F.col("b").alias("id"), "vec", "far")).alias("members"))
        offers = held.select("members").mapInArrow(_local_join(max(4, k // 3)), EDGES)
        merged = graph.withColumn("old", F.lit(1)).unionByName(offers.filter("a <> b").withColumn("old", F.lit(0)))
        new = materialize(_top(merged, k), "ann")
        graph = new.drop("old")
        now = new.agg(F.count("*").alias("n"), F.sum(1 - F.col("old")).alias("changed")).first()
        if (now["changed"] or 0) <= 0.01 * now["n"]:
            break
    return graph


def distance(x: str, y: str):
    """Euclidean distance of two array columns in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        q = np.array([np.frombuffer(v, np.float32) for v in batch.column(2).to_pylist()]).reshape(batch.num_rows, -1)
        x = np.array([np.frombuffer(v, np.float32) for v in batch.column(3).to_pylist()]).reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sqrt(((q - x) ** 2).sum(1)).astype(np.float32))], names=["a", "b", "d"])


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = 300, expand: int = 75, hops: int = 12, reverse: int = 40) -> DataFrame:
    """``a, b, d``: the ``beam`` nearest nodes found for each of ``queries(id, vec)``.

    ``queries`` are nodes of the graph; a hop expands the ``expand`` nearest
    nodes of each query that were not expanded, within its beam.
    """
    back = _top(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"), reverse)
    both = materialize(graph.select("a", "b").unionByName(back.select("a", "b")).distinct().withColumnsRenamed({"a": "from", "b": "to"}), "ann")
    vecs, asked = nodes.select(F.col("id").alias("b"), "vec"), queries.select(F.col("id").alias("a"), F.col("vec").alias("qvec"))
    best, order = Window.partitionBy("a").orderBy("d", "b"), Window.partitionBy("a", "done").orderBy("d", "b")
    found = materialize(asked.select("a", F.col("a").alias("b"), F.lit(0.0).cast("float").alias("d"), F.lit(False).alias("done"), F.lit(True).alias("now")), "ann")
    for _ in range(hops):
        # what is known of a pair and what is reached again meet once; a pair without a distance is new
        known = found.select("a", "b", "d", (F.col("done") | F.col("now")).alias("done"))
        steps = found.filter("now").select("a", F.col("b").alias("from")).join(both, "from").select("a", F.col("to").alias("b"), F.lit(None).cast("float").alias("d"), F.lit(False).alias("done"))
        pairs = materialize(known.unionByName(steps).groupBy("a", "b").agg(F.max("d").alias("d"), F.max("done").alias("done")), "ann")
        seen = pairs.filter("d is null").select("a", "b").join(vecs, "b").join(asked, "a").select("a", "b", "qvec", "vec").mapInArrow(_measure, EDGES)
        # a pair beyond the beam does not come back: what is in the beam only gets nearer
        ranked = pairs.filter("d is not null").unionByName(seen.select("a", "b", "d", F.lit(False).alias("done"))).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= beam)
        found = materialize(ranked.withColumn("e", F.row_number().over(order)).withColumn("now", (~F.col("done")) & (F.col("e") <= expand)).drop("r", "e"), "ann")
        if found.filter("now").isEmpty():
            break
    return found.select("a", "b", "d")


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding array<double>`` of the rows that take part."""
    ok = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    ok = ok.filter(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))).filter(F.exists("embedding", lambda v: v != 0))
    sizes = ok.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    ok = ok.filter(F.size("embedding") == (sizes[0]["n"] if sizes else 0))
    return ok.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("vec_id", F.transform("embedding", lambda v: v + F.lit(0.0)).alias("embedding"))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, neighbours: int = 20, rounds: int = 5, beam: int = 300) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose ``vec_id`` is divisible by ``every``."""
    rows = materialize(valid_vectors(vectors), "ann")
    classes = materialize(rows.groupBy("embedding").agg(F.min("vec_id").alias("id")), "ann")
    member = rows.join(classes, "embedding").select("id", "vec_id")
    # the k + 1 smallest ids of a class are all that a result may need of it
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    part = member.withColumn("r", F.row_number().over(Window.partitionBy("id", salt).orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    few = materialize(part.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).filter(F.col("r") <= k + 1).select("id", "vec_id"), "ann")
    projections = 4
    shape = "id bigint, vec binary, " + ", ".join(f"p{j} double" for j in range(projections))
    scale = classes.agg(F.max(F.array_max(F.transform("embedding", lambda v: F.abs(v))))).first()[0] or 1.0
    column = classes.select(F.posexplode(F.transform("embedding", lambda v: v / scale)).alias("p", "v")).groupBy("p")
    column = column.agg(F.avg("v").alias("c"), F.max("v").alias("hi"), F.min("v").alias("lo")).orderBy("p").collect()  # one row a dimension
    centre = np.array([r["c"] for r in column])
    spread = max([1e-300, *(max(r["hi"] - r["c"], r["c"] - r["lo"]) for r in column)])
    nodes = materialize(classes.select("id", "embedding").mapInArrow(lambda b: _bytes(b, projections, scale, centre, spread), shape), "ann")
    graph = build_graph(nodes, neighbours, rounds, neighbours, projections)
    ask = materialize(member.filter(F.col("vec_id") % every == 0).withColumnsRenamed({"vec_id": "query_id"}), "ann")
    found = search(ask.select("id").distinct().join(nodes, "id").select("id", "vec"), nodes, graph, beam)
    keep = Window.partitionBy("a").orderBy("d", "b")
    close = found.withColumn("r", F.row_number().over(keep)).filter(F.col("r") <= 3 * (k + 1)).select("a", "b")
    exact = close.join(classes.select(F.col("id").alias("a"), F.col("embedding").alias("x")), "a").join(classes.select(F.col("id").alias("b"), F.col("embedding").alias("y")), "b")
    exact = materialize(exact.select("a", "b", distance("x", "y").alias("score")), "ann")
    pairs = ask.withColumnRenamed("id", "a").join(exact, "a").join(few.withColumnsRenamed({"id": "b"}), "b").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
