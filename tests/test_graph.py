"""Components, detection, resistance and generators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.graph import communities, components, generators, halves, homes, leiden, lfr, resistance
from thicket.operators import statistics as T
from thicket.operators.edges import nodes_of
from thicket.sources import fixtures, registry


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.id: r.component for r in components.component_labels(edges).collect()}
    assert got == {x: find(x) for x in parent}
    near = {r.id: r.component for r in components.near_labels(edges).collect()}
    assert all(find(c) == find(x) for x, c in near.items())
    assert components.component_labels(edges.limit(0)).count() == 0


def test_largest_component(spark):
    edges = fixtures.edges_of(spark, [(0, 1), (5, 6), (6, 7)])
    assert {r.id for r in registry.largest_component(edges).collect()} == {5, 6, 7}


def test_leiden_small(spark):
    edges, _ = fixtures.karate(spark)
    bell, _ = fixtures.barbell(spark, 8)
    both = edges.withColumn("graph_id", F.lit("k")).unionByName(bell.withColumn("graph_id", F.lit("b")))
    found = leiden.leiden_small(both).cache()
    assert T.modularity_terms(edges, found.filter("graph_id = 'k'").select("id", "comm")).first().q >= 0.40
    assert found.filter("graph_id = 'b'").select("comm").distinct().count() == 2
    inside = T.classified(edges, found.filter("graph_id = 'k'").select("id", "comm")).filter("is_intra")
    comps = components.component_labels(inside).select("component").distinct().count()
    assert comps == found.filter("graph_id = 'k'").select("comm").distinct().count()


def settled(edges, comm, gamma=1.0, cpm=False):
    """Quality, whether communities are connected, and the most that a node gains by a move, by plain loops."""
    total = 2.0 * sum(w for _, _, w in edges)
    ways, mass = {}, {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            mass[x] = mass.get(x, 0.0) + w
            if x != y:
                ways.setdefault(x, []).append((y, w))
    mass, scale = ({x: 1.0 for x in mass}, gamma) if cpm else (mass, gamma / total)
    volume = {}
    for x, c in comm.items():
        volume[c] = volume.get(c, 0.0) + mass[x]
    worst, seen = 0.0, set()
    for x, c in comm.items():
        to = {c: 0.0}
        for y, w in ways.get(x, []):
            to[comm[y]] = to.get(comm[y], 0.0) + w
        gain = {k: w - scale * mass[x] * (volume[k] - (mass[x] if k == c else 0.0)) for k, w in to.items()}
        worst = max(worst, max(0.0, *gain.values()) - gain[c])
    parts = 0
    for x in comm:
        if x not in seen:
            parts, todo = parts + 1, [x]
            seen.add(x)
            while todo:
                for y, _ in ways.get(todo.pop(), []):
                    if y not in seen and comm[y] == comm[x]:
                        seen.add(y)
                        todo.append(y)
    quality = sum(w for a, b, w in edges if comm[a] == comm[b]) - scale / 2 * sum(v * v for v in volume.values())
    return 2 * quality / total, parts == len(volume), worst


def test_leiden_parallel(spark):
    """Communities are connected, named by their least nodes, and no single move gains; about as good as the sequential method."""
    edges, _ = fixtures.karate(spark)
    plain = [(r.src, r.dst, 1.0) for r in edges.collect()]
    found = {r.id: r.comm for r in communities.leiden_parallel(edges).collect()}
    q, connected, gain = settled(plain, found)
    assert set(found) == {x for a, b, _ in plain for x in (a, b)} and all(min(x for x in found if found[x] == c) == c for c in found.values())
    small = leiden.leiden_small(edges.withColumn("graph_id", F.lit("k")))
    assert connected and gain < 1e-8 and q > T.modularity_terms(edges, small).first().q - 0.01


def test_leiden_parallel_weights(spark):
    """CPM on a graph with weights, a loop and a lone pair."""
    edges = [(a, b, 2.0) for a in range(5) for b in range(a)] + [(a + 10, b + 10, 1.0) for a in range(5) for b in range(a)] + [(0, 10, 0.5), (7, 7, 3.0), (20, 21, 0.1)]
    found = {r.id: r.comm for r in communities.leiden_parallel(spark.createDataFrame(edges, "src long, dst long, weight double"), 0.4, True).collect()}
    assert found == {**{x: 0 for x in range(5)}, **{x: 10 for x in range(10, 15)}, 7: 7, 20: 20, 21: 21}
    assert settled(edges, found, 0.4, True)[1:] == (True, 0.0)
    assert communities.leiden_parallel(spark.createDataFrame([], "src long, dst long")).count() == 0


def shuffled(spark):
    """Bytes that all tasks so far have written to shuffles."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_leiden_moves_labels(spark):
    """A round of moves shuffles rows of nodes, not of edges; it is done by several homes, and raises the quality."""
    pairs = [(a, 1000 + b) for a in range(400) for b in range(200) if (a * 31 + b * 17 + a * b) % 4 or a % 2 == b % 2]
    both = spark.createDataFrame([(a, b, 1.0) for x in pairs for a, b in (x, x[::-1])], "src long, dst long, w double")
    degree = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("mass"))
    level = communities._Level(both, degree, 1 / (2 * len(pairs)))
    assert level.homes > 1
    state = level.nodes.select("id", F.col("id").alias("comm"), "mass", "home", "at", (F.col("id") + 5000).alias("fresh"), F.lit(2000).alias("step"))
    before = shuffled(spark)
    moved = {r.id: r.comm for r in communities._moves(level, state).collect()}
    assert shuffled(spark) - before < 4 * len(pairs)
    edges = [(a, b, 1.0) for a, b in pairs]
    assert settled(edges, moved)[0] > settled(edges, {x: x for x in moved})[0]


def test_leiden_rounds_are_a_job_each(spark):
    """A round starts one query only, and homes of their own give the same as one home."""
    rng = np.random.default_rng(5)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 60, (500, 2)).tolist() if a != b})
    both = spark.createDataFrame([(a, b, 1.0) for x in pairs for a, b in (x, x[::-1])], "src long, dst long, w double")
    degree = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("mass"))
    found = []
    for few in (16, 1 << 16):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(homes, "FEW", few)
            level = communities._Level(both, degree, 1 / (2 * len(pairs)))
            asks = 0
            writes = lambda: spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()
            state = communities._begun(level, level.nodes.selectExpr("id", "id AS comm", "mass", "home", "at", "id + 120 AS fresh", "60L AS step"))
            if level.homes > 1:
                before = writes()
                level.round(state, level.moves(), communities._learn)
                asks = writes() - before
            settled = level.rounds(state, level.moves(), communities._learn)[0]
            parts = communities._refined(level, settled)
            found.append(({r.id: r.comm for r in communities._labels(level, settled).collect()}, {r.id: r.part for r in parts.collect()}))
            assert asks <= 6, asks
            assert (level.homes > 1) == (few == 16)
    assert found[0] == found[1]
    assert settled_by(pairs, found[0][0]) < 1e-8


def settled_by(pairs, comm):
    return settled([(a, b, 1.0) for a, b in pairs], comm)[2]


def test_cpm(spark):
    bell, _ = fixtures.barbell(spark, 6)
    found = leiden.leiden_small(bell.withColumn("graph_id", F.lit("b")), 0.5, cpm=True)
    assert found.select("comm").distinct().count() == 2


def best_swaps(pairs, side):
    """The cut after Kernighan-Lin passes: swaps of the best pairs, of which the best beginning is kept, until none helps."""
    ids = sorted(side)
    w = {x: set() for x in ids}
    for a, b in pairs:
        w[a].add(b)
        w[b].add(a)
    cut = lambda s: sum(s[a] != s[b] for a, b in pairs)
    while True:
        now, free, seen = dict(side), set(ids), []
        for _ in range(len(ids) // 2):
            gain = {x: sum(1 if now[y] != now[x] else -1 for y in w[x]) for x in free}
            best = max(((gain[a] + gain[b] - 2 * (b in w[a]), a, b) for a in free for b in free if now[a] < now[b]), default=None)
            if best is None:
                break
            _, a, b = best
            now[a], now[b] = 1, 0
            free -= {a, b}
            seen.append((cut(now), dict(now)))
        least = min(seen, key=lambda x: x[0])
        if least[0] >= cut(side):
            return cut(side)
        side = least[1]


def test_bisection(spark):
    """Balanced, and about as few edges between as by the plain method from the same beginning or from the nodes' order."""
    bell = fixtures.barbell(spark, 6)[0]
    side = {r.id: r.comm for r in halves.bisection(bell).collect()}
    assert len({side[i] for i in range(6)}) == 1 and len({side[i] for i in range(6, 12)}) == 1 and side[0] != side[11]
    karate = fixtures.karate(spark)[0]
    pairs = [(r.src, r.dst) for r in karate.collect()]
    side = {r.id: r.comm for r in halves.bisection(karate).collect()}
    assert sum(side.values()) == 17 and sum(side[a] != side[b] for a, b in pairs) <= 1.05 * best_swaps(pairs, {i: int(i >= 17) for i in range(34)})


def test_resistance(spark):
    edges = fixtures.two_cliques_with_hub(spark)
    got = {(r.src, r.dst): r.resistance for r in resistance.exact(edges.withColumn("graph_id", F.lit("g"))).collect()}
    assert math.isclose(sum(got.values()), 8) and math.isclose(got[0, 1], 0.4) and math.isclose(got[2, 3], 0.5) and math.isclose(got[0, 8], 0.6)
    karate = fixtures.karate(spark)[0]
    rows = resistance.exact(karate.withColumn("graph_id", F.lit("g"))).collect()
    assert math.isclose(sum(r.resistance for r in rows), 33) and max(r.resistance for r in rows) <= 1 + 1e-9
    assert 0 < resistance.fiedler(karate.withColumn("graph_id", F.lit("g"))).first().lambda2 < 1


def test_sketched_resistance(spark):
    edges = fixtures.two_cliques_with_hub(spark)
    exact = {(r.src, r.dst): r.resistance for r in resistance.exact(edges.withColumn("graph_id", F.lit("g"))).collect()}
    sketch = {(r.src, r.dst): r.resistance for r in resistance.sketched(edges, columns=40, rounds=12).collect()}
    assert abs(sum(sketch.values()) / sum(exact.values()) - 1) < 0.25


def test_spectral(spark):
    edges = fixtures.complete(spark, 40)
    kept = resistance.spectral(edges, 3.0, dense=True)
    assert kept.count() < 780 and kept.agg(F.min("weight")).first()[0] >= 1


def test_lfr(spark):
    """Degrees exact, sizes in bounds, mixing right, and a simple graph."""
    n, mu = 10_000, 0.2
    edges, labels = lfr.lfr(spark, n, mu)
    pairs = [(r.src, r.dst) for r in edges.collect()]
    comm = {r.id: r.comm for r in labels.collect()}
    assert len(set(pairs)) == len(pairs) and all(a < b for a, b in pairs) and sorted(comm) == list(range(n))
    degree = np.bincount(np.array(pairs).ravel(), minlength=n)
    drawn = {r.id: r.d for r in lfr.drawn_degrees(spark, n, 15, 50, 3.0, 43).collect()}
    assert degree.tolist() == [drawn[i] for i in range(n)] and abs(degree.mean() - 15) < 0.5 and degree.max() <= 50
    sizes = np.bincount(list(comm.values()))
    assert sizes.min() >= 20 and sizes.max() <= 100
    assert abs(sum(comm[a] != comm[b] for a, b in pairs) / len(pairs) - mu) < 0.01


def test_lfr_small(spark):
    """No mixing leaves no edge between communities; one community can't be mixed; what is left of n is dealt out."""
    edges, labels = lfr.lfr(spark, 60, 0.0, average=4, most=8)
    assert T.classified(edges, labels).filter("NOT is_intra").count() <= 6 and edges.count() > 60
    with pytest.raises(ValueError, match="mu"):
        lfr.lfr(spark, 60, 1.5)
    sizes = [r.size for r in lfr.community_sizes(spark, 107, 20, 25, 1.5, 3).collect()]
    assert sum(sizes) == 107 and min(sizes) >= 20


def test_realised():
    """A community's inner degrees as a simple graph; stubs without partners are told."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        degrees = rng.integers(0, 15, 20)
        edges, left = lfr._realised(degrees, rng)
        got = np.bincount(edges.ravel(), minlength=20) if len(edges) else np.zeros(20, int)
        assert (got + left == degrees).all() and len({tuple(sorted(e)) for e in edges.tolist()}) == len(edges) and (edges[:, 0] != edges[:, 1]).all()


def test_rewired(spark):
    """About as the process that moves one edge after the other with the degrees of that time."""
    rng = np.random.default_rng(4)
    comm = {i: i % 4 for i in range(120)}
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 120, (700, 2)).tolist() if a != b})
    strength = 2.0

    def product(edges):
        d = np.bincount(np.array(sorted(edges)).ravel(), minlength=120)
        return np.mean([d[a] * d[b] for a, b in edges if comm[a] != comm[b]])

    def one_by_one():
        edges, d = set(pairs), np.bincount(np.array(pairs).ravel(), minlength=120)
        inter = [e for e in pairs if comm[e[0]] != comm[e[1]]]
        for i in rng.choice(len(inter), int(0.7 * len(inter)), replace=False):
            a, b = inter[i]
            new = []
            for x in (a, b):
                own = np.array([y for y in comm if comm[y] == comm[x]])
                p = np.maximum(d[own], 1.0) ** strength
                new.append(int(rng.choice(own, p=p / p.sum())))
            new = (min(new), max(new))
            if new not in edges:
                edges.remove((a, b))
                edges.add(new)
                for x, k in ((a, -1), (b, -1), (new[0], 1), (new[1], 1)):
                    d[x] += k
        return product(edges)

    runs = [one_by_one() for _ in range(20)]
    labels = spark.createDataFrame(list(comm.items()), "id long, comm long")
    edges = fixtures.edges_of(spark, pairs)
    new = [(r.src, r.dst) for r in generators.rewired_to_hubs(edges, labels, strength).collect()]
    assert len(set(new)) == len(new) == len(pairs)
    assert abs(product(new) - np.mean(runs)) < 5 * np.std(runs) and product(new) > 1.2 * product(pairs)
    count = lambda e: sorted((min(comm[a], comm[b]), max(comm[a], comm[b])) for a, b in e)
    assert count(new) == count(pairs)


def test_stored_tables_can_be_cleared(spark):
    import os

    from thicket import storage

    t = storage.stored(spark.range(3))
    folder = storage._made[-1].removeprefix("file://")
    assert t.count() == 3 and os.path.isdir(folder)
    kept, storage._made[:] = storage._made[:-1], storage._made[-1:]
    storage.clear_stored(spark)
    storage._made[:] = kept
    assert not os.path.isdir(folder)


def test_rewiring_does_not_write_the_graph_for_every_batch(spark):
    """Of the graph that many batches change, only the changes are written, beside the beginning and the end."""
    from thicket import storage

    edges = spark.range(400).selectExpr("id % 20 AS src", "20 + id DIV 20 AS dst").select("src", "dst")
    labels = spark.range(40).selectExpr("id", "id % 2 AS comm")
    before = len(storage._made)
    new = generators.rewired_to_hubs(edges, labels, 1.0, share=0.2, batches=4)
    whole = 0
    for folder in storage._made[before:]:
        rows = spark.read.parquet(folder + "/*")
        whole += {"src", "dst"} <= set(rows.columns) and rows.count() >= 400
    assert new.count() == 400 and whole == 3  # the edges as they came, by piece, and at the end
