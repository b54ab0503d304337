"""Connected components against a plain union of sets."""

import random

import pytest

from rasterlake.operators import graph


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


CHAIN = [(i, i + 1) for i in range(120)]
HUB = [(7, i) for i in range(1000, 1400)] + [(9, 1000), (9, 5), (None, 3), (4, None), (8, 8)]
LOOSE = [(random.Random(3).randrange(500), random.Random(i).randrange(500) - 250) for i in range(400)]


@pytest.mark.parametrize("block", [50, 1_000_000])
@pytest.mark.parametrize("edges", [[], CHAIN, HUB, LOOSE, CHAIN + CHAIN], ids=["none", "chain", "hub", "loose", "twice"])
def test_components(spark, monkeypatch, edges, block):
    monkeypatch.setattr(graph, "BLOCK_EDGES", block)
    table = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    found = [tuple(r) for r in graph.connected_components(table).collect()]
    assert len(found) == len(set(found))
    assert dict(found) == plain(edges)


def test_groups_are_stars_from_the_start(spark, monkeypatch):
    """Edges of a group meet in a task, so no round is needed; split groups are joined by the rounds."""
    r, written, write = random.Random(6), [], graph.materialize
    edges = [(1000 * g + i, 1000 * g + i + 1, g) for g in range(40) for i in range(90)]
    r.shuffle(edges)
    monkeypatch.setattr(graph, "materialize", lambda df, name, *a: written.append(name) or write(df, name, *a))
    table = spark.createDataFrame(edges, "src long, dst long, image_id long").repartition(7)
    assert dict(map(tuple, graph.connected_components(table, within="image_id").collect())) == plain([e[:2] for e in edges])
    assert written == ["cc"]
    import pyarrow as pa

    monkeypatch.setattr(graph, "BLOCK_EDGES", 100)
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sorted(edges, key=lambda e: e[2])[i : i + 70])], names=["u", "v", "g"]) for i in range(0, len(edges), 70)]
    stars = [(u, v) for b in graph._forest(iter(batches)) for u, v in zip(*(c.to_pylist() for c in b.columns))]
    assert len(stars) == 40 * 90 and all(v % 1000 == 0 for _, v in stars)
