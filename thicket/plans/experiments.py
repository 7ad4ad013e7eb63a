"""Experiment grids: sampling trials over alpha and seeds, and single trials with detection before and after."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from itertools import product
from zlib import crc32

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph.communities import leiden_parallel
from ..graph.components import component_labels
from ..graph.generators import rewired_to_hubs
from ..graph.leiden import leiden_small
from ..graph.lfr import lfr
from ..graph.resistance import spectral
from ..operators.agreement import ari, nmi
from ..operators.degrees import degrees, scored
from ..operators.sparsify import sparsify
from ..operators.statistics import classified, hub_bridge, modularity_terms, observed, preservation, reconstruction, scored_by_class, separation, theory
from ..operators.edges import induced
from ..sources import fixtures
from ..sources.registry import largest_component
from ..storage import once, stored
from .policy import limited


def sampled_trials(edges: DataFrame, labels: DataFrame, alphas: Iterable[float], seeds: Iterable[int]) -> DataFrame:
    """(alpha, seed, m, m_sparse, intra, inter, f, df): Bernoulli trials of the whole grid in one pass.

    Edges and degrees are stored, scores and classes computed once; each edge meets each seed, whose draw all alphas share, and the counts of
    all alphas are summed side by side.  A trial that keeps no edge gives no row.
    """
    alphas, seeds = [float(a) for a in alphas], [int(s) for s in seeds]
    edges = once(edges.select("src", "dst"), "edges")
    known = stored(degrees(edges), "degrees")
    n, ends = known.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
    m = ends // 2
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", "src", "dst", "seed")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    rows = scored_by_class(edges, labels, known=known).select("src", "dst", (F.col("score") / float(max(n, 1))).alias("share"), "is_intra")
    rows = rows.withColumn("seed", F.explode(F.lit(seeds).cast("array<long>"))).select("seed", "share", "is_intra", u.alias("u"))
    kept = [F.col("u") < F.least(F.lit(1.0), F.col("share") * F.ceil(F.lit(a) * float(m)).cast("double")) for a in alphas]
    counts = [F.struct(F.lit(a).alias("alpha"), F.count_if(k).alias("m_sparse"), F.count_if(k & F.col("is_intra")).alias("intra")) for a, k in zip(alphas, kept, strict=True)]
    sums = rows.groupBy("seed").agg(F.count("*").alias("m"), F.count_if("is_intra").alias("intra_all"), F.array(*counts).alias("trials"))
    trials = sums.withColumn("t", F.explode("trials")).select("t.alpha", "seed", "m", "t.m_sparse", "t.intra", (F.col("t.m_sparse") - F.col("t.intra")).alias("inter"), (F.col("intra_all").cast("double") / F.col("m")).alias("f0")).filter("m_sparse > 0")
    f = F.col("intra").cast("double") / F.col("m_sparse")
    return trials.select("alpha", "seed", "m", "m_sparse", "intra", "inter", f.alias("f"), (f - F.col("f0")).alias("df"))


def detected(edges: DataFrame, resolution: float = 1.0, cpm: bool = False, seed: int = 0, small: bool = False) -> DataFrame:
    """(id, comm), in DataFrames; small: by the sequential method in one task, which the seed orders, for graphs of experiments."""
    if not small:
        return leiden_parallel(edges, resolution, cpm)
    return leiden_small(edges.select(F.lit("g").alias("graph_id"), "src", "dst"), resolution, cpm, seed).select("id", "comm")


def _first(df: DataFrame, prefix: str = "") -> dict:
    return {prefix + k: v for k, v in df.first().asDict().items()}


def theory_trial(edges: DataFrame, labels: DataFrame, alpha: float, seed: int, method: str = "paper", detect: bool = False, small: bool = False) -> dict:
    """Predictions, what sampling did, and the changes of q: one row of the prediction experiment.  detect: communities are
    also found on both graphs, and their q on the original one compared."""
    edges, labels = stored(edges, "edges"), stored(labels, "labels")
    sparse = stored(sparsify(edges, method, alpha, seed), "sparse")
    t, o, r = _first(theory(edges, labels)), _first(observed(edges, sparse, labels)), _first(reconstruction(edges, sparse, labels))
    q = {}
    if detect:
        before, after = (stored(detected(g, seed=seed, small=small), "found") for g in (edges, sparse))
        q = {"q_leiden_original": modularity_terms(edges, before).first()["q"], "q_leiden_sparse": modularity_terms(edges, after).first()["q"]}
        q["dq_leiden"] = q["q_leiden_sparse"] - q["q_leiden_original"]
    return {"retention": alpha, "seed": seed, **t, **o, **r, **q, "ratio_prediction_error": abs(o["ratio"] - t["ratio_predicted"]), "f_prediction_error": abs(r["df"] - t["f_improvement"])}


def recovery_trial(edges: DataFrame, truth: DataFrame, baseline: DataFrame, alpha: float, seed: int, dataset: str, method: str = "paper", small: bool = False) -> dict:
    """Agreement with the truth before and after sampling; the baseline partition is computed once by the caller."""
    sparse = stored(sparsify(edges, method, alpha, seed), "sparse")
    after = stored(detected(sparse, seed=seed, small=small), "after")
    row = {"dataset": dataset, "alpha": alpha, "seed": seed, "m_sparse": sparse.count(), **_first(separation(edges, truth)), "hub_bridge_ratio": hub_bridge(edges, truth).first()["ratio"]}
    for name, found in (("orig", baseline), ("sparse", after)):
        row |= {f"nmi_{name}": nmi(found, truth).first()[0], f"ari_{name}": ari(found, truth).first()[0], f"q_{name}": modularity_terms(edges, found).first()["q"], f"n_communities_{name}": found.select("comm").distinct().count()}
    return row | {f"delta_{k}": row[f"{k}_sparse"] - row[f"{k}_orig"] for k in ("nmi", "ari", "q")}


def scaling_trial(edges: DataFrame, baseline: DataFrame, t_original: float, method: str, alpha: float, seed: int, dataset: str, small: bool = False) -> dict:
    """Times of sampling and detection, and quality of the partition found on the sparse graph."""
    began = time.perf_counter()
    sparse = stored(sparsify(edges, method, alpha, seed), "sparse")
    m_sparse = sparse.count()
    t_sparsify = time.perf_counter() - began
    began = time.perf_counter()
    after = stored(detected(sparse, seed=seed, small=small), "after")
    n_after = after.select("comm").distinct().count()
    t_sparse = time.perf_counter() - began
    q0, fixed, found = (modularity_terms(e, p).first()["q"] for e, p in ((edges, baseline), (sparse, baseline), (sparse, after)))
    total = t_sparsify + t_sparse
    return {
        "dataset": dataset, "method": method, "alpha": alpha, "seed": seed, "m_edges": edges.count(), "m_sparse": m_sparse, "t_sparsify": t_sparsify, "t_leiden_orig": t_original, "t_leiden_sparse": t_sparse, "t_pipeline": total,
        "speedup": t_original / total if total else 1.0, "q0": q0, "q_sparse_fixed": fixed, "dq_fixed": fixed - q0, "q_sparse_leiden": found, "dq_leiden": found - q0, "n_communities_sparse": n_after, "nmi_before_after": nmi(baseline, after).first()[0],
    }


def community_trial(edges: DataFrame, labels: DataFrame, alpha: float, seed: int, method: str = "paper") -> dict:
    """Planted communities: hub bridges, separation, and the changes of f, g and q under sampling."""
    sparse = stored(sparsify(edges, method, alpha, seed), "sparse")
    return {"retention": alpha, "seed": seed, "m_edges": edges.count(), "m_sparse": sparse.count(), **_first(hub_bridge(edges, labels), "hub_"), **_first(separation(edges, labels)), **_first(reconstruction(edges, sparse, labels))}


def citation_row(edges: DataFrame, baseline: DataFrame, method: str, alpha: float, seed: int, small: bool = False) -> dict:
    """One method at one retention against the original partition."""
    sparse = stored(sparsify(edges, method, alpha, seed), "sparse")
    return _citation_row(edges, sparse, baseline, detected(sparse, seed=seed, small=small), method, f"r={alpha}")


def planted_trial(spark: SparkSession, n: int, mu: float, strength: float, retention: float, seed: int, rewired: bool = True) -> dict:
    """community_trial of an LFR graph, rewired to hubs or not, cut to its largest component; ValueError without edges."""
    edges, labels = lfr(spark, n, mu, seed=seed)
    edges = stored(rewired_to_hubs(edges, labels, strength, seed=seed) if rewired else edges, "planted")
    edges = stored(induced(edges, largest_component(edges)), "largest")
    if not edges.limit(1).count():
        raise ValueError("the planted graph has no edges")
    return {"n": n, "mu": mu, "strength": strength, **community_trial(edges, labels, retention, seed)}


def _citation_row(edges: DataFrame, sparse: DataFrame, baseline: DataFrame, found: DataFrame, method: str, param: str) -> dict:
    found = stored(found, "found")
    kept = preservation(edges, sparse, baseline, empty_rate=1.0).first()
    parts = component_labels(sparse).select("component").distinct().count()
    m, all_m = sparse.count(), edges.count()
    return {"method": method, "param": param, "edges": m, "edge_pct": 100.0 * m / all_m, "cc": parts, "communities": found.select("comm").distinct().count(), "modularity": modularity_terms(sparse, found).first()["q"], "nmi": nmi(baseline, found).first()[0], "ari": ari(baseline, found).first()[0], "intra_pct": 100 * kept["intra_rate"], "inter_pct": 100 * kept["inter_rate"], "ratio": kept["ratio"]}


def sampling_trial(edges: DataFrame, labels: DataFrame, method: str, alpha: float, seed: int) -> dict:
    """What one method keeps of edges within and between communities.  Edges may be scored already, for many trials of one graph."""
    kept = classified(sparsify(edges, method, alpha, seed).select("src", "dst"), labels)
    r = kept.agg(F.count("*").alias("m_sparse"), F.count_if("is_intra").alias("intra")).first()
    return {"method": method, "alpha": alpha, "seed": seed, "m_sparse": r["m_sparse"], "intra": r["intra"], "inter": r["m_sparse"] - r["intra"]}


def prediction_grid(alphas: int = 15, runs: int = 10) -> list[tuple[float, int]]:
    """(alpha, seed): alphas evenly from 0.3 to 1, seeds floor(1e5 alpha) + run."""
    steps = [0.3 + 0.7 * i / max(1, alphas - 1) for i in range(alphas)]
    return [(a, int(a * 100_000) + run) for a in steps for run in range(runs)]


def community_grid(sizes: dict[int, int] | None = None) -> list[dict]:
    """Configurations of planted graphs by nodes and replicates: five mixings and two retentions, each as it is and rewired to
    hubs with three strengths.  Its seed is the same for both kinds of a strength, and differs by retention."""
    out = []
    for n, replicates in (sizes or {1_000: 10, 10_000: 3}).items():
        for kind, strengths in (("standard", (1.0,)), ("modified", (1.0, 2.0, 4.0))):
            for mu, h, alpha, rep in product((0.1, 0.2, 0.3, 0.4, 0.5), strengths, (0.5, 0.8), range(replicates)):
                out.append({"n": n, "kind": kind, "mu": mu, "strength": h, "retention": alpha, "replicate": rep, "seed": crc32(f"{n}|{mu}|{h}|{alpha}|{rep}".encode()) & 0x7FFFFFFF})
    return out


def recovery_grid(datasets: Iterable[str] = ("karate", "dolphins", "football", "polbooks", "email-Eu-core"), alphas: Iterable[float] = (0.5, 0.8), runs: int = 10) -> list[tuple[str, float, int]]:
    """(dataset, alpha, seed)."""
    return list(product(datasets, alphas, range(runs)))


def scaling_grid(datasets: Iterable[str], methods: Iterable[str] = ("paper", "uniform_random", "degree_sampling", "spectral"), alphas: Iterable[float] = (0.2, 0.4, 0.6, 0.8, 1.0), runs: int = 3) -> list[tuple[str, str, float, int]]:
    """(dataset, method, alpha, seed)."""
    return list(product(datasets, methods, alphas, range(runs)))


def citation_grid(edges: DataFrame, seed: int = 42, retentions: Iterable[float] = (0.9, 0.75, 0.5), epsilons: Iterable[float] = (0.75, 1.0, 1.5), resolutions: Iterable[float] = (0.1, 0.01, 0.001), small: bool = False) -> DataFrame:
    """A row for each method and retention, and each strength of the spectral method, against the original partition; then a
    sweep of CPM resolutions on the sparse graph with the best modularity."""
    edges = stored(edges.select("src", "dst"), "edges")
    baseline = stored(detected(edges, seed=seed, small=small), "baseline")
    rows, kept = [], {}
    for method, alpha in product(("paper", "probabilistic_no_replace", "deterministic"), retentions):
        kept[method, f"r={alpha}"] = stored(sparsify(edges, method, alpha, seed), "sparse")
    for epsilon in epsilons:
        kept["spectral", f"eps={epsilon}"] = stored(spectral(edges, epsilon, seed), "sparse")
    for (method, param), sparse in kept.items():
        rows.append(_citation_row(edges, sparse, baseline, detected(sparse, seed=seed, small=small), method, param))
    best = max(rows, key=lambda r: r["modularity"])
    for gamma in resolutions:
        sparse = kept[best["method"], best["param"]]
        rows.append(_citation_row(edges, sparse, baseline, detected(sparse, gamma, True, seed, small), f"{best['method']}+cpm", f"{best['param']} gamma={gamma}"))
    return edges.sparkSession.createDataFrame(rows)


def run_datasets(spark: SparkSession, load: Callable[[str], tuple[DataFrame, DataFrame]], names: Iterable[str], trial: Callable[..., dict], grid: Iterable[tuple], seconds: float = 3600) -> DataFrame:
    """Rows of trial(edges, labels, *arguments) for every dataset and entry of the grid, with ``dataset``; a dataset that takes
    longer than that, or whose files can't be read, gives no rows."""
    rows: list[dict] = []
    grid = list(grid)
    for name in names:

        def one(name=name) -> list[dict]:
            edges, labels = load(name)
            edges, labels = stored(edges, "edges"), stored(labels, "labels")
            return [{"dataset": name, **trial(edges, labels, *arguments)} for arguments in grid]

        try:
            rows += limited(spark, seconds, one) or []
        except (ValueError, AnalysisException):
            continue
    return spark.createDataFrame(rows) if rows else spark.createDataFrame([], "dataset string")


def run_grid(trial, grid: Iterable[tuple], spark: SparkSession) -> DataFrame:
    """Rows of trial(*arguments) for every entry of the grid; a trial that raises ValueError gives no row."""
    rows = []
    for arguments in grid:
        try:
            rows.append(trial(*arguments))
        except ValueError:
            continue
    return spark.createDataFrame(rows)


def compare_methods(edges: DataFrame, alpha: float, seed: int = 42) -> DataFrame:
    """(method, edges, total_weight, least_weight, greatest_weight) of the three score samplers, over edges that are scored once."""
    edges, out = stored(scored(once(edges.select("src", "dst"), "edges")), "scored"), None
    for method in ("paper", "probabilistic_no_replace", "deterministic"):
        s = sparsify(edges, method, alpha, seed)
        row = s.agg(F.lit(method).alias("method"), F.count("*").alias("edges"), F.sum("weight").alias("total_weight"), F.min("weight").alias("least_weight"), F.max("weight").alias("greatest_weight"))
        out = row if out is None else out.unionByName(row)
    return out


def toy_suite(spark: SparkSession) -> DataFrame:
    """(graph, mu_intra, mu_inter, delta, hub_difference, ratio, m, f, g, q) of the toy graphs."""
    from ..graph.generators import hub_bridge as hub_graph

    out = None
    for name, (edges, labels) in (("barbell", fixtures.barbell(spark, 10)), ("grid", fixtures.grid(spark, 10)), ("hub_bridge", hub_graph(spark)), ("karate", fixtures.karate(spark))):
        row = separation(edges, labels, strict=True).crossJoin(hub_bridge(edges, labels).select(F.col("difference").alias("hub_difference"), "ratio")).crossJoin(modularity_terms(edges, labels)).withColumn("graph", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


