"""Queries over graphs derived from the driver's tables, each with the SQL that gives the same rows.

Doubles are rounded to nine digits after aggregation, since sums differ in their last bits by their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mean_std, title
from ..graph import communities, components, generators, halves, lfr, resistance, spectrum
from ..operators import agreement, degrees, edges as E, frontier, sparsify as S, statistics as T, summaries as M
from ..sources import derived, files, registry, sinks
from ..storage import shared_folder, stored
from . import experiments, runs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TRADE = """
WITH pairs AS (SELECT o_custkey * 10 + 1 AS src, l_suppkey * 10 + 2 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
edges AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM pairs WHERE src <> dst),
places AS (
  SELECT c_custkey * 10 + 1 AS id, n_nationkey::BIGINT AS nation, n_regionkey::BIGINT AS region FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_suppkey * 10 + 2, n_nationkey::BIGINT, n_regionkey::BIGINT FROM supplier JOIN nation ON s_nationkey = n_nationkey),
labels AS (SELECT id, region AS comm FROM places),
deg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id),
size AS (SELECT (SELECT count(*) FROM deg)::DOUBLE AS n, (SELECT count(*) FROM edges)::DOUBLE AS m),
scored AS (
  SELECT e.src, e.dst, a.d AS d_src, b.d AS d_dst, 1.0::DOUBLE / a.d + 1.0::DOUBLE / b.d AS score, a.d * b.d AS d_product, a.d + b.d AS d_sum
  FROM edges e JOIN deg a ON e.src = a.id JOIN deg b ON e.dst = b.id),
classified AS (
  SELECT s.*, a.comm AS comm_src, b.comm AS comm_dst, a.comm = b.comm AS is_intra FROM scored s JOIN labels a ON s.src = a.id JOIN labels b ON s.dst = b.id),
volumes AS (SELECT comm, sum(coalesce(d, 0))::BIGINT AS vol, count(*) AS nodes FROM labels LEFT JOIN deg USING (id) GROUP BY comm)
"""
U = "((('0x' || substr(md5(concat_ws('|', {a}, {b}, {seed})), 1, 8))::BIGINT + 0.5) / 4294967296.0)"
UNIFORM = U.format(a="src", b="dst", seed=42)
H60 = "('0x' || substr(md5(concat_ws('|', {keys}, {seed})), 1, 15))::BIGINT"
TOP = "top AS (SELECT src, dst FROM scored ORDER BY score DESC, src, dst LIMIT (SELECT ceil(0.5::DOUBLE * m)::BIGINT FROM size))"
TERMS = """
terms AS (SELECT count(*) FILTER (WHERE is_intra)::DOUBLE / (SELECT m FROM size) AS f, (SELECT sum(vol::DOUBLE * vol) FROM volumes) / (4.0 * (SELECT m * m FROM size)) AS g FROM classified)
"""
GRID = "grid AS (SELECT a.alpha::DOUBLE AS alpha, s.seed::BIGINT AS seed FROM (VALUES (0.2), (0.4), (0.6), (0.8)) a(alpha), (VALUES (1), (2), (3)) s(seed))"
TRIALS = (
    GRID
    + """,
kept AS (
  SELECT alpha, seed, is_intra FROM classified, grid, size
  WHERE """
    + U.format(a="src", b="dst", seed="seed")
    + """ < least(1.0, score / n * ceil(alpha * m))),
trials AS (
  SELECT alpha, seed, (SELECT count(*) FROM classified) AS m, count(*) AS m_sparse, count(*) FILTER (WHERE is_intra) AS intra, count(*) FILTER (WHERE NOT is_intra) AS inter,
    count(*) FILTER (WHERE is_intra)::DOUBLE / count(*) AS f, count(*) FILTER (WHERE is_intra)::DOUBLE / count(*) - (SELECT avg(is_intra::INT::DOUBLE) FROM classified) AS df
  FROM kept GROUP BY alpha, seed)
"""
)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _trade(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return derived.trade(spark, d), derived.trade_labels(spark, d)


@query(TRADE + "," + TERMS + "SELECT round(f, 9) AS f, round(g, 9) AS g, round(f - g, 9) AS q, round((SELECT avg(score) FROM classified WHERE is_intra), 9) AS mu_intra, round((SELECT avg(score) FROM classified WHERE NOT is_intra), 9) AS mu_inter, (SELECT m FROM size)::BIGINT AS m FROM terms")
def flagship(spark, d):
    edges, labels = _trade(spark, d)
    return rounded(T.modularity_terms(edges, labels).crossJoin(T.separation(edges, labels).select("mu_intra", "mu_inter")))


@query(TRADE + "SELECT src, dst FROM edges")
def canonical_edges(spark, d):
    return derived.trade(spark, d)


@query(TRADE + ", k AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM pairs GROUP BY 1, 2) SELECT sum(n)::BIGINT AS raw_rows, coalesce(sum(n) FILTER (WHERE a = b), 0)::BIGINT AS self_loops, count(*) FILTER (WHERE a <> b) AS edges, (sum(n) - coalesce(sum(n) FILTER (WHERE a = b), 0) - count(*) FILTER (WHERE a <> b))::BIGINT AS multi_edges_collapsed FROM k")
def raw_counts(spark, d):
    return E.raw_counts(derived.trade_pairs(spark, d))


@query(TRADE + "SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges")
def symmetric_edges(spark, d):
    return E.symmetric(derived.trade(spark, d))


@query(TRADE + "SELECT id, coalesce(d, 0)::BIGINT AS d FROM places LEFT JOIN deg USING (id)")
def node_degrees(spark, d):
    return degrees.degrees(derived.trade(spark, d), derived.trade_nodes(spark, d))


@query(TRADE + "SELECT d, count(*) AS nodes FROM deg GROUP BY d")
def degree_histogram(spark, d):
    return degrees.degree_histogram(derived.trade(spark, d))


@query(TRADE + "SELECT src, dst, d_src, d_dst, round(score, 9) AS score, d_product, d_sum FROM scored")
def edge_scores(spark, d):
    return rounded(degrees.scored(derived.trade(spark, d)))


@query(TRADE + "SELECT count(*) AS m, round(sum(score), 6) AS total, round(avg(score), 9) AS mean, round(min(score), 9) AS least, round(max(score), 9) AS greatest FROM scored")
def score_summary(spark, d):
    return rounded(degrees.score_summary(derived.trade(spark, d)).withColumn("total", F.round("total", 6)))


@query(TRADE + "SELECT src, dst, round(score / n, 12) AS p, round(score * m / n, 9) AS w FROM scored, size")
def normalized_scores(spark, d):
    return degrees.normalized(derived.trade(spark, d)).select("src", "dst", (F.round("p", 12)).alias("p"), F.round("w", 9).alias("w"))


@query("SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey")
def parts_together(spark, d):
    return derived.parts_together(spark, d)


@query(TRADE + "," + TOP + "SELECT src, dst, 1.0::DOUBLE AS weight FROM top")
def topk_sparsify(spark, d):
    return S.top_k(derived.trade(spark, d), 0.5)


@query(TRADE + f"SELECT src, dst, 1.0::DOUBLE AS weight FROM scored, size WHERE {UNIFORM} < least(1.0, score / n * ceil(0.5::DOUBLE * m))")
def bernoulli_sparsify(spark, d):
    return S.bernoulli(derived.trade(spark, d), 0.5)


@query(TRADE + f"SELECT src, dst, 1.0::DOUBLE AS weight FROM scored, size WHERE {UNIFORM} < least(1.0, 0.5::DOUBLE * score / (n / m))")
def bernoulli_by_mean(spark, d):
    return S.bernoulli_by_mean(derived.trade(spark, d), 0.5)


@query(TRADE + f"SELECT src, dst, 1.0::DOUBLE AS weight FROM scored, size WHERE {UNIFORM} < least(1.0, d_sum / (SELECT sum(d * d)::DOUBLE FROM deg) * ceil(0.5::DOUBLE * m))")
def degree_sum_bernoulli(spark, d):
    return S.degree_sum(derived.trade(spark, d), 0.5)


@query(TRADE + f"SELECT src, dst, 1.0::DOUBLE AS weight FROM edges ORDER BY {H60.format(keys='src, dst', seed=42)}, src, dst LIMIT (SELECT ceil(0.5::DOUBLE * m)::BIGINT FROM size)")
def uniform_k(spark, d):
    return S.uniform(derived.trade(spark, d), 0.5)


@query(
    TRADE
    + f""", spans AS (SELECT src, dst, score, sum(w) OVER (ORDER BY src, dst)::BIGINT - w AS low, sum(w) OVER (ORDER BY src, dst)::BIGINT AS high FROM (SELECT *, floor(score * 1000000000)::BIGINT AS w FROM scored)),
q AS (SELECT ceil(0.5::DOUBLE * m)::BIGINT AS q, n FROM size), total AS (SELECT max(high) AS total FROM spans),
draws AS (SELECT ({H60.format(keys='i', seed=42)}) % total AS r FROM (SELECT unnest(range((SELECT q FROM q))) AS i), total)
SELECT src, dst, count(*) AS k, round(count(*) / (any_value(q)::DOUBLE * (any_value(score) / any_value(n))), 9) AS weight FROM draws JOIN spans ON r >= low AND r < high, q GROUP BY src, dst"""
)
def weighted_resample(spark, d):
    return rounded(S.with_replacement(derived.trade(spark, d), 0.5))


@query(TRADE + "SELECT src, dst, comm_src, comm_dst, is_intra FROM classified")
def classify_edges(spark, d):
    edges, labels = _trade(spark, d)
    return T.classified(edges, labels)


@query(TRADE + "SELECT round(avg(score) FILTER (WHERE is_intra), 9) AS mu_intra, round(avg(score) FILTER (WHERE NOT is_intra), 9) AS mu_inter, round(avg(score) FILTER (WHERE is_intra) - avg(score) FILTER (WHERE NOT is_intra), 9) AS delta FROM classified")
def separation(spark, d):
    return rounded(T.separation(*_trade(spark, d)))


@query(TRADE + ", x AS (SELECT avg(d_product) FILTER (WHERE NOT is_intra) AS mean_inter, avg(d_product) FILTER (WHERE is_intra) AS mean_intra FROM classified) SELECT round(mean_inter, 6) AS mean_inter, round(mean_intra, 6) AS mean_intra, round(mean_inter - mean_intra, 6) AS difference, round(mean_inter / mean_intra, 9) AS ratio FROM x")
def hub_bridge_terms(spark, d):
    out = T.hub_bridge(*_trade(spark, d))
    return out.select(*(F.round(c, 6).alias(c) for c in ("mean_inter", "mean_intra", "difference")), F.round("ratio", 9).alias("ratio"))


@query(TRADE + "," + TERMS + "SELECT (SELECT m FROM size)::BIGINT AS m, round(f, 9) AS f, round(g, 9) AS g, round(f - g, 9) AS q FROM terms")
def modularity(spark, d):
    return rounded(T.modularity_terms(*_trade(spark, d)))


@query(TRADE + "SELECT comm, vol, nodes FROM volumes")
def community_volumes(spark, d):
    return T.volumes(*_trade(spark, d))


@query(
    TRADE
    + """, x AS (SELECT count(*) FILTER (WHERE is_intra) AS n1, count(*) FILTER (WHERE NOT is_intra) AS n2, count(*) AS m, avg(score) FILTER (WHERE is_intra) AS mu1, avg(score) FILTER (WHERE NOT is_intra) AS mu2, sum(score) FILTER (WHERE is_intra) AS s1, sum(score) AS s FROM classified),
w AS (SELECT sum(v * v) AS sq FROM (SELECT comm, sum(score) AS v FROM (SELECT comm_src AS comm, score FROM classified UNION ALL SELECT comm_dst, score FROM classified) GROUP BY comm)),
y AS (SELECT *, n1 * n2 * (mu1 - mu2) / (m * s) AS pred, (SELECT sum(vol::DOUBLE * vol) FROM volumes) / (4.0 * m * m) AS g, (SELECT sq FROM w) / (4.0 * s * s) AS gw FROM x)
SELECT n1, n2, m, round(mu1, 9) AS mu_intra, round(mu2, 9) AS mu_inter, round(mu1 - mu2, 9) AS delta, round(mu2 / mu1, 9) AS ratio_predicted, round(n1::DOUBLE / m, 9) AS f_original, round(s1 / s, 9) AS f_weighted, round(pred, 9) AS f_improvement,
  m::DOUBLE AS w_unweighted, m::DOUBLE AS w_weighted, round(g, 9) AS g_original, round(gw, 9) AS g_weighted, round(gw - g, 9) AS g_change, round(pred - (gw - g), 9) AS q_lower_bound FROM y"""
)
def theory_bundle(spark, d):
    return rounded(T.theory(*_trade(spark, d)))


_KEPT = """
kept AS (SELECT c.*, t.src IS NOT NULL AS kept FROM classified c LEFT JOIN top t USING (src, dst)),
k AS (SELECT count(*) FILTER (WHERE is_intra) AS intra_original, count(*) FILTER (WHERE NOT is_intra) AS inter_original, count(*) FILTER (WHERE is_intra AND kept) AS intra_preserved, count(*) FILTER (WHERE NOT is_intra AND kept) AS inter_preserved FROM kept),
r AS (SELECT *, intra_preserved::DOUBLE / intra_original AS a, inter_preserved::DOUBLE / inter_original AS b FROM k)
"""


@query(TRADE + "," + TOP + "," + _KEPT + "SELECT intra_original, inter_original, intra_preserved, inter_preserved, round(a, 9) AS intra_rate, round(b, 9) AS inter_rate, round(b / a, 9) AS ratio, b / a > 1 AS supported FROM r")
def edge_preservation(spark, d):
    edges, labels = _trade(spark, d)
    return rounded(T.preservation(edges, S.top_k(edges, 0.5), labels))


_SPARSE = """
sdeg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM top UNION ALL SELECT dst FROM top) GROUP BY id),
sparse AS (SELECT (SELECT count(*) FROM top) AS m1, (SELECT count(*) FILTER (WHERE is_intra AND kept) FROM kept)::DOUBLE / (SELECT count(*) FROM top) AS f1,
  (SELECT sum(v * v) FROM (SELECT sum(coalesce(d, 0))::DOUBLE AS v FROM labels LEFT JOIN sdeg USING (id) GROUP BY comm)) / (4.0 * (SELECT count(*)::DOUBLE * count(*) FROM top)) AS g1)
"""


@query(TRADE + "," + TOP + "," + _KEPT + "," + _SPARSE + "SELECT intra_original, inter_original, intra_preserved, inter_preserved, round(a, 9) AS intra_rate, round(b, 9) AS inter_rate, round(b / a, 9) AS ratio, m1 AS m_sparse, round(f1, 9) AS f_sparse, round(g1, 9) AS g_sparse, round(f1 - g1, 9) AS q_sparse FROM r, sparse")
def observed_bundle(spark, d):
    edges, labels = _trade(spark, d)
    return rounded(T.observed(edges, S.top_k(edges, 0.5), labels))


@query(TRADE + "," + TOP + "," + _KEPT + "," + _SPARSE + "," + TERMS + "SELECT round((f1 - g1) - (f - g), 9) AS dq, round(f1 - f, 9) AS df, round(g1 - g, 9) AS dg, round((f1 - f) - (g1 - g), 9) AS dq_reconstructed, 0.0::DOUBLE AS epsilon FROM sparse, terms")
def dq_reconstruction(spark, d):
    edges, labels = _trade(spark, d)
    return rounded(T.reconstruction(edges, S.top_k(edges, 0.5), labels))


@query(
    TRADE
    + ","
    + TOP
    + """, x AS (SELECT c.is_intra AS found, a.nation = b.nation AS truth, t.src IS NOT NULL AS kept FROM classified c JOIN places a ON c.src = a.id JOIN places b ON c.dst = b.id LEFT JOIN top t ON c.src = t.src AND c.dst = t.dst),
k AS (SELECT count(*) FILTER (WHERE NOT kept AND NOT found) AS inter_removed, count(*) FILTER (WHERE NOT kept AND NOT found AND truth) AS inter_removed_but_intra, count(*) FILTER (WHERE kept AND found) AS intra_preserved, count(*) FILTER (WHERE kept AND found AND NOT truth) AS intra_preserved_but_inter FROM x)
SELECT *, round(coalesce(inter_removed_but_intra / nullif(inter_removed, 0)::DOUBLE, 0), 9) AS removed_rate, round(coalesce(intra_preserved_but_inter / nullif(intra_preserved, 0)::DOUBLE, 0), 9) AS preserved_rate FROM k"""
)
def misclassification(spark, d):
    edges, labels = _trade(spark, d)
    return rounded(T.misclassification(edges, S.top_k(edges, 0.5), labels, derived.trade_labels(spark, d, "nation")))


_CELLS = """cells AS (SELECT region AS a, nation % 7 AS b, count(*) AS n FROM places GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n) FROM cells)::DOUBLE AS n, {ab} AS ab, {a} AS a, {b} AS b)"""


def _cells(f: str) -> str:
    one = lambda source: f"(SELECT sum({f}) FROM {source})"
    return _CELLS.format(ab=one("(SELECT n::DOUBLE AS x FROM cells)"), a=one("(SELECT sum(n)::DOUBLE AS x FROM cells GROUP BY a)"), b=one("(SELECT sum(n)::DOUBLE AS x FROM cells GROUP BY b)"))


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = derived.trade_nodes(spark, d)
    return nodes.select("id", F.col("region").alias("comm")), nodes.select("id", (F.col("nation") % 7).alias("comm"))


@query(TRADE + ", " + _cells("x") + " SELECT a, b, n FROM cells")
def contingency(spark, d):
    return agreement.contingency(*_two(spark, d))


@query(TRADE + ", " + _cells("x * ln(x)") + " SELECT round(2 * ((ln(n) - a / n) + (ln(n) - b / n) - (ln(n) - ab / n)) / ((ln(n) - a / n) + (ln(n) - b / n)), 9) AS nmi FROM s")
def nmi(spark, d):
    return rounded(agreement.nmi(*_two(spark, d)))


@query(TRADE + ", " + _cells("x * (x - 1) / 2") + " SELECT round((ab - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 9) AS ari FROM s")
def ari(spark, d):
    return rounded(agreement.ari(*_two(spark, d)))


_COMPONENTS = """
ways AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
comp(id, component) USING KEY (id) AS (
  SELECT DISTINCT a, a FROM ways
  UNION SELECT w.b, min(c.component) FROM comp c JOIN ways w ON c.id = w.a JOIN recurring.comp r ON r.id = w.b WHERE c.component < r.component GROUP BY w.b)
"""
RECURSIVE = TRADE.replace("WITH", "WITH RECURSIVE", 1) + "," + _COMPONENTS


@query(RECURSIVE + "SELECT id, component FROM comp")
def connected_components(spark, d):
    return components.component_labels(derived.trade(spark, d))


@query(RECURSIVE + "SELECT id FROM comp WHERE component = (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)")
def largest_component(spark, d):
    return registry.largest_component(derived.trade(spark, d))


@query(TRADE + "SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM deg")
def densify_ids(spark, d):
    return E.dense_ids(E.nodes_of(derived.trade(spark, d)))


@query(TRADE + "SELECT e.src, e.dst FROM edges e JOIN places a ON e.src = a.id JOIN places b ON e.dst = b.id WHERE a.region = 1 AND b.region = 1")
def induced_subgraph(spark, d):
    return E.induced(derived.trade(spark, d), derived.trade_nodes(spark, d).filter("region = 1"))


_NOISE = f"""ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS at FROM places),
wanted AS (SELECT floor(m * 0.1::DOUBLE)::BIGINT AS k, (SELECT count(*) FROM ids) AS n FROM size),
draws AS (SELECT i, ({H60.format(keys='i', seed=42)}) % n AS a, ({H60.format(keys='i', seed=43)}) % n AS b FROM (SELECT unnest(range((SELECT 20 * k FROM wanted))) AS i), wanted),
cand AS (SELECT least(x.id, y.id) AS src, greatest(x.id, y.id) AS dst, min(i) AS draw FROM draws JOIN ids x ON x.at = a JOIN ids y ON y.at = b WHERE x.id <> y.id GROUP BY 1, 2),
noise AS (SELECT src, dst FROM cand ANTI JOIN edges USING (src, dst) ORDER BY draw LIMIT (SELECT k FROM wanted))
"""


def _noise(spark: SparkSession, d: str) -> DataFrame:
    return generators.noise_edges(derived.trade(spark, d), derived.trade_nodes(spark, d), 0.1)


@query(TRADE + "," + _NOISE + "SELECT src, dst FROM noise")
def noise_edges(spark, d):
    return _noise(spark, d)


@query(TRADE + "," + _NOISE + ", k AS (SELECT (SELECT count(*) FROM edges) AS n_original, count(*) AS n_added, count(*) FILTER (WHERE a.comm <> b.comm) AS noise_inter, count(*) FILTER (WHERE a.comm = b.comm) AS noise_intra FROM noise JOIN labels a ON noise.src = a.id JOIN labels b ON noise.dst = b.id) SELECT *, round(n_added / n_original::DOUBLE, 9) AS ratio, round(noise_inter / n_added::DOUBLE, 9) AS inter_ratio FROM k")
def noise_stats(spark, d):
    edges, labels = _trade(spark, d)
    return rounded(T.noise_statistics(edges, _noise(spark, d), labels))


@query(TRADE + "," + TOP + f", bern AS (SELECT src, dst FROM scored, size WHERE {UNIFORM} < least(1.0, score / n * ceil(0.5::DOUBLE * m))) SELECT count(*) FILTER (WHERE t.src IS NOT NULL AND b.src IS NOT NULL) AS common, count(*) FILTER (WHERE b.src IS NULL) AS only_a, count(*) FILTER (WHERE t.src IS NULL) AS only_b FROM top t FULL JOIN bern b ON t.src = b.src AND t.dst = b.dst")
def overlap_sets(spark, d):
    edges = derived.trade(spark, d)
    return E.jaccard_overlap(S.top_k(edges, 0.5), S.bernoulli(edges, 0.5))


@query(TRADE + "," + TOP + f", bern AS (SELECT src, dst FROM scored, size WHERE {UNIFORM} < least(1.0, score / n * ceil(0.5::DOUBLE * m))) SELECT e.src, e.dst, CASE WHEN t.src IS NOT NULL AND b.src IS NOT NULL THEN 'both' WHEN t.src IS NOT NULL THEN 'only_a' WHEN b.src IS NOT NULL THEN 'only_b' ELSE 'neither' END AS status FROM edges e LEFT JOIN top t ON e.src = t.src AND e.dst = t.dst LEFT JOIN bern b ON e.src = b.src AND e.dst = b.dst")
def edge_status(spark, d):
    edges = derived.trade(spark, d)
    return E.status(edges, S.top_k(edges, 0.5), S.bernoulli(edges, 0.5))


def _trials(spark: SparkSession, d: str) -> DataFrame:
    return experiments.sampled_trials(*_trade(spark, d), (0.2, 0.4, 0.6, 0.8), (1, 2, 3))


@query(TRADE + "," + TRIALS + "SELECT alpha, seed, m, m_sparse, intra, inter, round(f, 9) AS f, round(df, 9) AS df FROM trials")
def alpha_sweep(spark, d):
    return rounded(_trials(spark, d))


@query(TRADE + "," + TRIALS + "SELECT alpha, round(avg(m_sparse), 6) AS m_sparse_mean, round(stddev_samp(m_sparse), 6) AS m_sparse_std, round(avg(df), 6) AS df_mean, round(stddev_samp(df), 6) AS df_std FROM trials GROUP BY alpha")
def trial_summary(spark, d):
    return rounded(M.mean_std(_trials(spark, d), ["alpha"], ["m_sparse", "df"]), 6)


@query(TRADE + "," + TRIALS + "SELECT alpha, seed, round(df, 9) AS df FROM trials QUALIFY row_number() OVER (PARTITION BY alpha ORDER BY df DESC, seed) = 1")
def best_by_metric(spark, d):
    return rounded(M.best_by(_trials(spark, d), ["alpha"], "df", ["seed"]).select("alpha", "seed", "df"))


@query(TRADE + "," + TRIALS + "SELECT seed, alpha, m_sparse FROM trials QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round(abs(alpha - 0.7), 9), alpha) = 1")
def closest_alpha(spark, d):
    return E.closest_alpha(_trials(spark, d).select("seed", "alpha", "m_sparse"), 0.7, ["seed"])


@query(TRADE + "," + TRIALS + ", e AS (SELECT df - (0.9::DOUBLE - alpha) * 0.001 AS e, sign(df) = sign((0.9::DOUBLE - alpha) * 0.001) AS same FROM trials) SELECT round(avg(abs(e)), 9) AS mae, round(sqrt(avg(e * e)), 9) AS rmse, round(max(abs(e)), 9) AS max_error, round(avg(same::INT::DOUBLE) * 100, 9) AS sign_percent FROM e")
def prediction_errors(spark, d):
    return rounded(M.prediction_errors(_trials(spark, d).withColumn("guess", (F.lit(0.9) - F.col("alpha")) * 0.001), "guess", "df"))


@query(TRADE + "," + TRIALS + "SELECT round(corr(alpha, m_sparse), 9) AS r, count(*) AS n FROM trials")
def pearson(spark, d):
    return rounded(M.pearson(_trials(spark, d), "alpha", "m_sparse").select("r", "n"))


@query(TRADE + "," + TRIALS + "SELECT round(avg(df), 9) AS mean, round(stddev_pop(df), 9) AS std, round(min(df), 9) AS least, round(max(df), 9) AS greatest, count(*) FILTER (WHERE df > 0) AS positive, count(*) AS n FROM trials")
def cross_dataset_stats(spark, d):
    return rounded(M.across(_trials(spark, d), "df"))


@query(TRADE + "," + TRIALS + ", g AS (SELECT seed, avg(df) AS flag, avg(f) AS value FROM trials GROUP BY seed) SELECT flag > 0 AS favorable, count(*) AS groups, round(avg(value), 9) AS mean_value FROM g GROUP BY 1")
def favorable_group_means(spark, d):
    return rounded(M.favorable_means(_trials(spark, d), "seed", "df", "f"))


@query(TRADE + "," + TRIALS + "SELECT alpha, seed, CASE WHEN df > 0 THEN 'improved' WHEN df < -0.01 THEN 'degraded' ELSE 'maintained' END AS note, 'Degree Sum' AS label FROM trials")
def quality_notes(spark, d):
    return _trials(spark, d).select("alpha", "seed", M.quality_note(F.col("df")).alias("note"), title(F.lit("degree_sum")).alias("label"))


@query(
    TRADE
    + ","
    + GRID
    + f""", x AS (SELECT alpha, is_intra, least(1.0, alpha * score / (n / m)) AS p, ({U.format(a='src', b='dst', seed='seed')} >= least(1.0, alpha * score / (n / m)))::INT::DOUBLE AS gone FROM classified, grid, size)
SELECT alpha, round(avg(p) FILTER (WHERE NOT is_intra), 9) AS p_bridge, round(avg(p) FILTER (WHERE is_intra), 9) AS p_other, round(avg(gone) FILTER (WHERE NOT is_intra), 9) AS bridge_removed, round(avg(p) FILTER (WHERE NOT is_intra) / avg(p) FILTER (WHERE is_intra), 9) AS ratio FROM x GROUP BY alpha"""
)
def survival_curve(spark, d):
    edges, labels = _trade(spark, d)
    bridge = T.classified(edges, labels).filter("NOT is_intra")
    return rounded(S.survival_curve(edges, bridge, [0.2, 0.4, 0.6, 0.8], [1, 2, 3]))


_DRAWN = _SQL["weighted_resample"]


@query(f"SELECT CASE WHEN weight > 1.5 THEN 'strong' WHEN weight > 0.7 THEN 'usual' ELSE 'weak' END AS bucket, count(*) AS edges, sum(k)::BIGINT AS draws FROM ({_DRAWN}) GROUP BY 1")
def weight_buckets(spark, d):
    drawn = rounded(S.with_replacement(derived.trade(spark, d), 0.5))
    return drawn.groupBy(M.weight_bucket(F.col("weight")).alias("bucket")).agg(F.count("*").alias("edges"), F.sum("k").alias("draws"))


@query(f"WITH w AS ({_DRAWN}), t AS (SELECT *, 'top' AS \"end\" FROM w ORDER BY weight DESC, src, dst LIMIT 5), b AS (SELECT *, 'bottom' AS \"end\" FROM w ORDER BY weight, src, dst LIMIT 3) SELECT * FROM t UNION ALL SELECT * FROM b")
def extreme_weights(spark, d):
    return M.extremes(rounded(S.with_replacement(derived.trade(spark, d), 0.5)), "weight", ["src", "dst"])


@query(TRADE + "SELECT round(median(score), 9) AS median_score FROM scored")
def median_score(spark, d):
    return rounded(degrees.scored(derived.trade(spark, d)).agg(F.median("score").alias("median_score")))


# -- labels that lack, tables of trials, set tests ------------------------------------------------------------------


def _some_labels(spark: SparkSession, d: str) -> DataFrame:
    return derived.trade_nodes(spark, d).filter("region <> 1").select("id", F.col("region").alias("comm"))


_SOME = "told AS (SELECT id, region AS comm FROM places WHERE region <> 1), marked AS (SELECT e.src, e.dst, a.comm AS a, b.comm AS b FROM edges e LEFT JOIN told a ON e.src = a.id LEFT JOIN told b ON e.dst = b.id)"


@query(TRADE + "," + _SOME + "SELECT src, dst, a AS comm_src, b AS comm_dst, a IS NOT DISTINCT FROM b AS is_intra FROM marked")
def classify_equal(spark, d):
    return T.classified(derived.trade(spark, d), _some_labels(spark, d), "equal")


@query(TRADE + "," + _SOME + "SELECT src, dst, coalesce(a, -1) AS comm_src, coalesce(b, -1) AS comm_dst, coalesce(a, -1) = coalesce(b, -1) AS is_intra FROM marked")
def classify_sentinel(spark, d):
    return T.classified(derived.trade(spark, d), _some_labels(spark, d), "sentinel")


@query(TRADE + "," + TERMS + "SELECT CASE WHEN (SELECT count(*) FROM places ANTI JOIN labels USING (id)) = 0 THEN round(f - g, 9) END AS q FROM terms")
def label_modularity(spark, d):
    edges, labels = _trade(spark, d)
    return rounded(T.label_modularity(edges, labels, derived.trade_nodes(spark, d)))


@query(TRADE + "SELECT NULL::DOUBLE AS q")
def label_modularity_unlabelled(spark, d):
    return T.label_modularity(derived.trade(spark, d), _some_labels(spark, d), derived.trade_nodes(spark, d))


@query(TRADE + ", k AS (SELECT count(DISTINCT comm) AS n FROM labels) SELECT n AS communities FROM k")
def community_count(spark, d):
    return derived.trade_labels(spark, d).agg(F.countDistinct("comm").alias("communities"))


@query(TRADE + "SELECT src, dst, 1.0::DOUBLE AS weight FROM edges")
def topology(spark, d):
    edges = derived.trade(spark, d)
    return E.topology(edges.withColumn("weight", F.lit(7.0)))


@query(TRADE + "SELECT src, dst, 1.0::DOUBLE AS weight FROM edges")
def full_retention(spark, d):
    return S.sparsify(derived.trade(spark, d), "deterministic", 1.0)


@query(TRADE + "," + TRIALS + "SELECT alpha, seed, m_sparse FROM trials WHERE abs(alpha - 0.6::DOUBLE) <= 1e-8 + 1e-5 * 0.6::DOUBLE")
def trials_at_alpha(spark, d):
    return E.at_alpha(_trials(spark, d), 0.6).select("alpha", "seed", "m_sparse")


@query(TRADE + "," + TRIALS + "SELECT alpha, m, round(avg(m_sparse), 6) AS m_sparse_mean, round(stddev_samp(m_sparse), 6) AS m_sparse_std FROM trials GROUP BY alpha, m")
def summary_with_baseline(spark, d):
    trials = stored(_trials(spark, d), "trials")
    return rounded(M.with_baseline(M.mean_std(trials, ["alpha"], ["m_sparse"]), trials, "alpha", ["m"]), 6)


_TIMES = "t AS (SELECT alpha, seed, m_sparse / 1000.0::DOUBLE AS a, m_sparse / 500.0::DOUBLE AS b, m / 250.0::DOUBLE AS c FROM trials)"


@query(TRADE + "," + TRIALS + "," + _TIMES + "SELECT alpha, seed, round(a + b, 9) AS t_pipeline, round(c / (a + b), 9) AS speedup, round(c / b, 9) AS speedup_leiden, round(a / (a + b), 9) AS sparsify_share FROM t")
def pipeline_speedups(spark, d):
    t = _trials(spark, d).select("alpha", "seed", (F.col("m_sparse") / 1000.0).alias("t_sparsify"), (F.col("m_sparse") / 500.0).alias("t_leiden_sparse"), (F.col("m") / 250.0).alias("t_leiden_orig"))
    return rounded(M.speedups(t).select("alpha", "seed", "t_pipeline", "speedup", "speedup_leiden", "sparsify_share"))


@query(TRADE + "," + TOP + "SELECT count(*) = 0 AS subset, count(*) AS missing FROM (SELECT src, dst FROM top EXCEPT SELECT src, dst FROM edges)")
def subset_test(spark, d):
    edges = derived.trade(spark, d)
    return E.is_subset(S.top_k(edges, 0.5), edges)


@query(RECURSIVE + ", parts AS (SELECT count(*) + (SELECT count(*) FROM places ANTI JOIN deg USING (id)) AS components FROM comp WHERE id = component) SELECT (SELECT count(*) FROM places) AS n, (SELECT count(*) FROM edges) AS m, components, components <= 1 AS connected FROM parts")
def graph_counts(spark, d):
    return components.graph_counts(stored(derived.trade(spark, d), "edges"), derived.trade_nodes(spark, d))


@query(TRADE + "SELECT src, dst FROM (SELECT src, dst FROM edges ORDER BY " + H60.format(keys="src, dst", seed=42) + ", src, dst LIMIT (SELECT (2 * m)::BIGINT // 6 FROM size)) UNION ALL SELECT dst, src FROM (SELECT src, dst FROM edges ORDER BY " + H60.format(keys="src, dst", seed=42) + ", src, dst LIMIT (SELECT (2 * m)::BIGINT // 6 FROM size))")
def random_both_directions(spark, d):
    edges = stored(derived.trade(spark, d), "edges")
    return S.random_sparsify(edges, 2 * edges.count() // 3)[0]


# -- files: what is written is read back ----------------------------------------------------------------------------


def _written(lines: DataFrame, ordered: bool = False) -> str:
    """A folder with the lines of lines(value), or lines(at, value) in their order in one file."""
    path = f"{shared_folder(lines.sparkSession)}/lines"
    (lines.coalesce(1).sortWithinPartitions("at").select("value") if ordered else lines.select("value")).write.text(path)
    return path


def _edge_lines(spark: SparkSession, d: str, separator: str, comment: str) -> DataFrame:
    pairs = derived.trade_pairs(spark, d)
    lines = pairs.select(F.concat_ws(separator, F.col("src").cast("string"), F.col("dst").cast("string"), F.lit("extra")).alias("value"))
    more = spark.createDataFrame([(f"{comment} comment 1 2",), ("",), ("   ",), ("no numbers",), (separator.join(("999999999", "999999999")),)], "value string")
    return lines.unionByName(more)


_DENSE = "ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM (SELECT id FROM deg UNION SELECT 999999999)), dense AS (SELECT least(a.new_id, b.new_id) AS src, greatest(a.new_id, b.new_id) AS dst FROM edges e JOIN ids a ON e.src = a.id JOIN ids b ON e.dst = b.id)"


@query(TRADE + "," + _DENSE + "SELECT src, dst FROM dense")
def read_edge_list(spark, d):
    return files.read_snap(spark, _written(_edge_lines(spark, d, "\t", "#")))[0]


@query(TRADE + "," + _DENSE + "SELECT src, dst FROM dense")
def read_network_file(spark, d):
    return files.read_network_repository(spark, _written(_edge_lines(spark, d, " ", "%")))[0]


@query(TRADE + "," + _DENSE + "SELECT src, dst FROM dense")
def read_classic_file(spark, d):
    return files.read_classic(spark, _written(_edge_lines(spark, d, " , ", "%")))[0]


@query(TRADE + "SELECT src, dst FROM edges")
def read_bare_file(spark, d):
    path = f"{shared_folder(spark)}/edges"
    sinks.write_edges(derived.trade(spark, d), path)
    return files.read_bare(spark, path)


@query(TRADE + "SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges")
def write_both_directions(spark, d):
    path = f"{shared_folder(spark)}/edges"
    sinks.write_edges(derived.trade(spark, d), path, both=True)
    return files.read_bare(spark, path)


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return E.dense_ids(derived.trade_nodes(spark, d))


_PLACE_IDS = "pids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id, region, nation FROM places)"


@query(TRADE + "," + _PLACE_IDS + "SELECT new_id AS id, CASE WHEN id % 10 = 1 THEN region ELSE nation END AS comm FROM pids")
def read_label_file(spark, d):
    """Of two lines of a node the last counts."""
    nodes = derived.trade_nodes(spark, d)
    lines = nodes.select(F.lit(0).alias("k"), "id", F.concat_ws(" ", "id", "region").alias("value")).unionByName(nodes.filter("id % 10 = 2").select(F.lit(1).alias("k"), "id", F.concat_ws("\t", "id", "nation").alias("value")))
    lines = lines.withColumn("at", F.struct("k", "id")).select("at", "value")
    return files.read_node_labels(spark, _written(lines, True), _ids(spark, d))


@query(TRADE + "," + _PLACE_IDS + "SELECT new_id AS id, region + 2 AS comm FROM pids")
def read_community_file(spark, d):
    nodes = derived.trade_nodes(spark, d)
    lines = nodes.groupBy((F.col("region") + 2).alias("at")).agg(F.concat_ws("\t", F.sort_array(F.collect_list(F.col("id").cast("string")))).alias("value"))
    more = spark.createDataFrame([(0, "# two lines before"), (1, " ")], "at long, value string")
    return files.read_communities(spark, _written(lines.unionByName(more), True), _ids(spark, d))


_PAPERS = "papers AS (SELECT id, row_number() OVER (ORDER BY id DESC) - 1 AS new_id, 'n' || nation AS class FROM places), classes AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS comm FROM (SELECT DISTINCT class FROM papers))"


def _citations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = derived.trade_nodes(spark, d)
    content = nodes.select((-F.col("id")).alias("at"), F.concat_ws("\t", F.concat(F.lit("p"), "id"), F.lit("0"), F.lit("1"), F.concat(F.lit("n"), "nation")).alias("value"))
    cites = derived.trade_pairs(spark, d).select(F.concat_ws("\t", F.concat(F.lit("p"), "src"), F.concat(F.lit("p"), "dst")).alias("value"))
    return files.read_citations(spark, _written(content, True), _written(cites.unionByName(spark.createDataFrame([("p11\tunknown",), ("p11\tp11",)], "value string"))))


@query(TRADE + "," + _PAPERS + "SELECT least(a.new_id, b.new_id) AS src, greatest(a.new_id, b.new_id) AS dst FROM edges e JOIN papers a ON e.src = a.id JOIN papers b ON e.dst = b.id")
def read_citation_edges(spark, d):
    return _citations(spark, d)[0]


@query(TRADE + "," + _PAPERS + "SELECT new_id AS id, comm FROM papers JOIN classes USING (class)")
def read_citation_labels(spark, d):
    return _citations(spark, d)[1]


@query(TRADE + ", known AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM places WHERE region <> 1) SELECT least(a.new_id, b.new_id) AS src, greatest(a.new_id, b.new_id) AS dst FROM edges e JOIN known a ON e.src = a.id JOIN known b ON e.dst = b.id")
def read_labelled_graph(spark, d):
    labels = _some_labels(spark, d).select(F.concat_ws(" ", "id", "comm").alias("value"))
    return files.read_labelled(spark, _written(_edge_lines(spark, d, " ", "#")), _written(labels))[0]


@query(TRADE + "," + TRIALS + "SELECT alpha, seed, m_sparse FROM trials")
def trials_as_csv(spark, d):
    path = f"{shared_folder(spark)}/trials"
    sinks.write_table(_trials(spark, d).select("alpha", "seed", "m_sparse"), path)
    return sinks.read_trials(spark, path, "alpha double, seed long, m_sparse long")


@query(TRADE + "," + TRIALS + "SELECT CASE WHEN alpha < 0.5 THEN 'trade' ELSE 'other' END AS dataset, alpha, seed, m_sparse FROM trials")
def trials_appended(spark, d):
    """A batch added twice counts once, and one that was left without its line in the log doesn't count."""
    path = shared_folder(spark)
    trials = stored(_trials(spark, d).select("alpha", "seed", "m_sparse"), "trials")
    for name, condition in (("trade", "alpha < 0.5"), ("other", "alpha > 0.5"), ("trade", "alpha < 0.5")):
        rows = trials.filter(condition).withColumn("dataset", F.lit(name))
        sinks.append_trials(rows, path, f"{name}-1")
        sinks.log_batch(spark, path, f"{name}-1", name, "done", rows.count())
    sinks.append_trials(trials.withColumn("dataset", F.lit("trade")), path, "trade-2")
    return sinks.committed(spark, path, "alpha double, seed long, m_sparse long").select("dataset", "alpha", "seed", "m_sparse")


_RUNS = TRADE + """, grid AS (SELECT alpha::DOUBLE AS alpha, seed::BIGINT AS seed FROM (VALUES (0.3), (0.7)) a(alpha), (VALUES (42), (7)) s(seed)),
kept AS (
  SELECT 'probabilistic_no_replace' AS method, alpha, seed, is_intra FROM classified, grid, size WHERE """ + U.format(a="src", b="dst", seed="seed") + """ < least(1.0, score / n * ceil(alpha * m))
  UNION ALL SELECT 'degree_sampling', alpha, seed, is_intra FROM classified, grid, size WHERE """ + U.format(a="src", b="dst", seed="seed") + """ < least(1.0, d_sum / (SELECT sum(d * d)::DOUBLE FROM deg) * ceil(alpha * m))
  UNION ALL SELECT 'deterministic', alpha, seed, is_intra FROM (SELECT *, row_number() OVER (PARTITION BY alpha, seed ORDER BY score DESC, src, dst) AS r FROM classified, grid), size WHERE r <= ceil(alpha * m)
  UNION ALL SELECT 'uniform_random', alpha, seed, is_intra FROM (SELECT *, row_number() OVER (PARTITION BY alpha, seed ORDER BY """ + H60.format(keys="src, dst", seed="seed") + """, src, dst) AS r FROM classified, grid), size WHERE r <= ceil(alpha * m))
"""


def _grid_run(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """16 trials over the trade graph in two runs: the second goes on where the first one, of every third trial, stopped."""
    edges, labels = (stored(x) for x in _trade(spark, d))
    edges = stored(degrees.scored(edges), "scored")
    ledger = shared_folder(spark)
    grid = [("trade", {"method": m, "alpha": a, "seed": s}) for m in ("probabilistic_no_replace", "degree_sampling", "deterministic", "uniform_random") for a in (0.3, 0.7) for s in (42, 7)]
    trial = lambda dataset, **arguments: experiments.sampling_trial(edges, labels, **arguments)
    schema = "method string, alpha double, seed long, m_sparse long, intra long, inter long"
    runs.run_trials(spark, trial, grid[::3], ledger, schema)
    return runs.run_trials(spark, trial, grid, ledger, schema), ledger


@query(_RUNS + "SELECT method, alpha, seed, count(*) AS m_sparse, count(*) FILTER (WHERE is_intra) AS intra, count(*) FILTER (WHERE NOT is_intra) AS inter FROM kept GROUP BY method, alpha, seed")
def grid_run(spark, d):
    return _grid_run(spark, d)[0].drop("dataset", "batch")


@query("WITH o AS (SELECT o_orderkey, round(o_totalprice::DOUBLE, 2) AS price, sum(l_quantity::DOUBLE) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT * FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.price <= a.price AND b.quantity >= a.quantity AND (b.price < a.price OR b.quantity > a.quantity))")
def pareto_front(spark, d):
    """Orders of which none has more pieces for as little."""
    orders, lines = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    sums = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("double")).alias("quantity"))
    rows = stored(orders.select("o_orderkey", F.round(F.col("o_totalprice").cast("double"), 2).alias("price")).join(sums, "o_orderkey").select("o_orderkey", "price", "quantity"), "orders")
    return frontier.pareto(rows, "price", "quantity")


@query(TRADE + ", h AS (SELECT ln(d::DOUBLE) AS x, ln(count(*)::DOUBLE) AS y FROM deg GROUP BY d) SELECT count(*) AS n, round(regr_slope(y, x), 6) AS exponent, round(exp(regr_intercept(y, x)), 6) AS factor, round(regr_r2(y, x), 6) AS r2 FROM h")
def degree_power_fit(spark, d):
    return rounded(frontier.power_fit(degrees.degree_histogram(derived.trade(spark, d)), "d", "nodes"), 6)


def _gml(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = f"{shared_folder(spark)}/gml"
    sinks.write_gml(derived.trade_pairs(spark, d).filter("src <> dst").distinct(), derived.trade_nodes(spark, d).select("id", F.col("region").alias("value")), path)
    return files.read_gml(spark, path)


@query(TRADE + "SELECT src, dst FROM edges")
def read_gml_edges(spark, d):
    return _gml(spark, d)[0]


@query(TRADE + "SELECT id, region AS comm FROM places")
def read_gml_labels(spark, d):
    return _gml(spark, d)[1]


@query(TRADE + "," + TRIALS + "SELECT alpha, '$' || printf('%.3f', round(avg(f), 6)) || ' \\pm ' || printf('%.3f', round(stddev_samp(f), 6)) || '$' AS cell, printf('%.1f', avg(m_sparse)) AS edges FROM trials GROUP BY alpha")
def table_cells(spark, d):
    """Cells of a table: mean and deviation by alpha, four rows."""
    rows = rounded(M.mean_std(_trials(spark, d), ["alpha"], ["f", "m_sparse"]), 6).collect()
    return spark.createDataFrame([(r.alpha, mean_std(r.f_mean, r.f_std), f"{r.m_sparse_mean:.1f}") for r in rows], "alpha double, cell string, edges string")


_NUMBERED = "ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM deg), dense AS (SELECT least(a.new_id, b.new_id) AS src, greatest(a.new_id, b.new_id) AS dst FROM edges e JOIN ids a ON e.src = a.id JOIN ids b ON e.dst = b.id)"


@query(TRADE + "," + _NUMBERED + "SELECT 'com-DBLP' AS name, src, dst FROM dense UNION ALL SELECT 'wiki-Vote', src, dst FROM dense UNION ALL SELECT 'jazz', src, dst FROM dense")
def dataset_registry(spark, d):
    """The trade graph's pairs as files of three layouts, looked up and loaded by name."""
    folder, out, pairs = shared_folder(spark), None, stored(derived.trade_pairs(spark, d), "pairs")
    for name, separator, reader in (("com-DBLP", "\t", "snap"), ("wiki-Vote", " ", "snap"), ("jazz", ",", "classic")):
        lines = pairs.select(F.concat_ws(separator, F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
        lines.write.text(f"{folder}/{name}")
        registry.register(name, registry.Dataset(f"{folder}/{name}", reader))
        try:
            edges = registry.load(spark, {"com-DBLP": "dblp"}.get(name, name))[0].select(F.lit(name).alias("name"), "src", "dst")
        finally:
            registry.forget(name)
        out = edges if out is None else out.unionByName(edges)
    return out


@query(RECURSIVE + ", big AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), inner_edges AS (SELECT src, dst FROM edges JOIN comp ON src = id WHERE component = (SELECT component FROM big)), lids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM (SELECT src AS id FROM inner_edges UNION SELECT dst FROM inner_edges)) SELECT least(a.new_id, b.new_id) AS src, greatest(a.new_id, b.new_id) AS dst FROM inner_edges e JOIN lids a ON e.src = a.id JOIN lids b ON e.dst = b.id")
def load_large(spark, d):
    return registry.load_large(derived.trade_pairs(spark, d), dense=True)[0]


@query(RECURSIVE + "SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM comp) - (SELECT count(*) FROM comp WHERE id = component) AS expected, true AS within_5_percent, true AS within_bounds")
def resistance_sum(spark, d):
    """Resistances of all edges add up to nodes less components; here as sketched for the whole trade graph."""
    edges = stored(derived.trade(spark, d), "edges")
    parts = stored(components.component_labels(edges), "parts")
    expected = parts.agg(F.count("*") - F.countDistinct("component")).first()[0]
    r = resistance.sketched(edges).agg(F.count("*").alias("edges"), F.sum("resistance").alias("sum"), F.min("resistance").alias("low")).first()
    return spark.createDataFrame([(r["edges"], expected, abs(r["sum"] / expected - 1) < 0.05, r["low"] > 0)], "edges long, expected long, within_5_percent boolean, within_bounds boolean")


# -- without SQL: iterative algorithms and generated graphs ---------------------------------------------------------


@query()
def prediction_trial(spark, d):
    """Predictions and what sampling did, on the trade graph."""
    return rounded(spark.createDataFrame([experiments.theory_trial(*_trade(spark, d), 0.5, 1)]))


def _customers(spark: SparkSession, d: str) -> int:
    return max(200, spark.read.parquet(f"{d}/customer.parquet").count())


@query()
def planted_trial(spark, d):
    """An LFR graph of as many nodes as there are customers, rewired to hubs and sampled."""
    return rounded(spark.createDataFrame([experiments.planted_trial(spark, _customers(spark, d), 0.3, 2.0, 0.5, 1)]))


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return derived.trade_nodes(spark, d).select("id", F.col("nation").alias("comm"))


@query()
def recovery_trial(spark, d):
    """Regions as the truth, nations as the partition before sampling."""
    edges, labels = _trade(spark, d)
    return rounded(spark.createDataFrame([experiments.recovery_trial(stored(edges), labels, stored(_nations(spark, d)), 0.5, 1, "trade")]))


@query()
def scaling_trial(spark, d):
    """Without its times, which no two runs share."""
    row = experiments.scaling_trial(stored(derived.trade(spark, d)), stored(_nations(spark, d)), 1.0, "deterministic", 0.5, 1, "trade")
    return rounded(spark.createDataFrame([{k: v for k, v in row.items() if not k.startswith("t_") and k != "speedup"}]))


@query()
def trade_resistance(spark, d):
    return rounded(resistance.sketched(derived.trade(spark, d)), 6)


@query()
def trade_cpm(spark, d):
    return communities.leiden_parallel(derived.trade(spark, d), 0.1, True)


@query()
def spectral_sparsify(spark, d):
    return rounded(S.sparsify(derived.trade(spark, d), "spectral", 0.4), 6)


@query()
def trade_lambda2(spark, d):
    """Second eigenvalue before and after keeping half of the edges by score."""
    edges = derived.trade(spark, d)
    both = [(name, *spectrum.second_eigenpair(stored(g))[:2]) for name, g in (("original", edges), ("sparse", S.top_k(edges, 0.5)))]
    return spark.createDataFrame([(name, round(value, 5), residual < 1e-5) for name, value, residual in both], "graph string, lambda2 double, settled boolean")


@query()
def trade_bisection(spark, d):
    """Two halves of the trade graph: their nodes, and the edges within and between them."""
    edges = stored(derived.trade(spark, d))
    sides = stored(halves.bisection(edges), "sides")
    inside = T.classified(edges, sides).agg(F.count_if("is_intra").alias("inside"), F.count_if(~F.col("is_intra")).alias("between"))
    return sides.groupBy("comm").agg(F.count("*").alias("nodes")).crossJoin(inside)  # of two rows and one


@query()
def leiden_communities(spark, d):
    return communities.leiden_parallel(derived.trade(spark, d))


@query()
def planted_communities(spark, d):
    """Of an LFR graph of as many nodes as there are customers."""
    edges, labels = lfr.lfr(spark, _customers(spark, d), 0.3)
    return rounded(T.theory(edges, labels))


@query()
def hub_rewiring(spark, d):
    """Inter-community edges of the trade graph moved to hubs."""
    edges, labels = _trade(spark, d)
    return rounded(T.hub_bridge(generators.rewired_to_hubs(edges, labels, 2.0), labels))


_OF_METHOD = "SELECT '{name}' AS method, count(*) AS edges, round(sum(weight), 6) AS total_weight, round(min(weight), 6) AS least_weight, round(max(weight), 6) AS greatest_weight FROM ({sql}) {name}"


@query(" UNION ALL ".join(_OF_METHOD.format(name=name, sql=_SQL[of]) for name, of in (("paper", "weighted_resample"), ("probabilistic_no_replace", "bernoulli_sparsify"), ("deterministic", "topk_sparsify"))))
def method_comparison(spark, d):
    return rounded(experiments.compare_methods(derived.trade(spark, d), 0.5), 6)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
