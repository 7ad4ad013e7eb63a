"""Products of a matrix in blocks, against dense ones."""

import numpy as np
import pyarrow as pa

from thicket.graph import blocks, resistance
from thicket.sources import fixtures


def double():
    class Double(blocks.Work):
        """Two vectors that follow from the ids, and their products."""

        k = 2

        def make(self, part):
            return np.column_stack([part.columns["id"] % 7.0, part.columns["d"]])

        def done(self, part, x, y):
            yield pa.RecordBatch.from_arrays([pa.array(part.columns["id"]), pa.array(y[:, 0]), pa.array(y[:, 1])], names=["id", "a", "b"])

    return Double()  # a class of this function goes to the tasks whole


def hub_and_pairs(n=60, seed=5):
    rng = np.random.default_rng(seed)
    pairs = {(0, i) for i in range(1, n)} | {(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (3 * n, 2)).tolist() if a != b}
    return sorted((10 * a, 10 * b) for a, b in pairs)


def test_product(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ENDS", 32)
    pairs = hub_and_pairs()
    graph = blocks.Blocks(fixtures.edges_of(spark, pairs))
    assert graph.parts > 10
    m = np.zeros((60, 60))
    for a, b in pairs:
        m[a // 10, b // 10] = m[b // 10, a // 10] = 1
    got = {r.id: (r.a, r.b) for r in graph.step(double(), "id long, a double, b double").collect()}
    x = np.column_stack([np.arange(0, 600, 10) % 7.0, m.sum(1)])
    assert np.allclose([got[i] for i in range(0, 600, 10)], m @ x)


def test_a_product_moves_touched_nodes_not_edges(spark):
    """Of a graph in which few nodes meet many, it sends some numbers for the few, though there are far more edges and nodes."""
    edges = spark.range(3000).selectExpr("100000 + id DIV 3 AS dst", "id % 3 AS src").select("src", "dst")
    graph = blocks.Blocks(edges)
    sent = sum(len(b["payload"][i].as_py()) for n in range(graph.parts) for b in blocks._send([pa.RecordBatch.from_pydict({"id": [n]})], graph.files, double()) for i in range(b.num_rows))
    assert 0 < sent <= 2 * 2 * 8 * 3 * graph.parts


def test_resistances_follow_from_the_signs(spark, monkeypatch):
    """The same as by a dense solution for the same signs."""
    from pyspark.sql import functions as F

    from thicket.functions.rng import hash_integer

    monkeypatch.setattr(blocks, "ENDS", 64)
    pairs = hub_and_pairs(40)
    edges = fixtures.edges_of(spark, pairs)
    rows = edges.select("src", "dst", hash_integer(42, "src", "dst").alias("h0"), hash_integer(43, "src", "dst").alias("h1")).collect()
    ids = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(ids)}
    a, b = np.array([at[r.src] for r in rows]), np.array([at[r.dst] for r in rows])
    signs = np.array([[1.0 if (r.h0, r.h1)[k // 32] >> (k % 32) & 1 else -1.0 for k in range(40)] for r in rows]) / 40**0.5
    right = np.zeros((len(ids), 40))
    np.add.at(right, a, signs)
    np.add.at(right, b, -signs)
    x = np.linalg.pinv(resistance.laplacian(a, b, len(ids))) @ right
    expected = dict(zip([(r.src, r.dst) for r in rows], ((x[a] - x[b]) ** 2).sum(1), strict=True))
    got = {(r.src, r.dst): r.resistance for r in resistance.sketched(edges, 40, tolerance=1e-8).collect()}
    assert got.keys() == expected.keys() and max(abs(got[e] - expected[e]) for e in got) < 1e-6
    assert resistance.sketched(edges.filter(F.lit(False))).count() == 0
