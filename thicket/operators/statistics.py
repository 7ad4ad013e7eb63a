"""Edge statistics by community: separation, hub bridges, modularity terms, predictions and what sampling did.

Classes with no edges: means are 0 unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .degrees import degrees, with_scores

INF = float("inf")


def classified(edges: DataFrame, labels: DataFrame, unlabelled: str = "skip") -> DataFrame:
    """Edges with comm_src, comm_dst and is_intra.  Edges with an unlabelled end are skipped, or ("equal") kept with two
    missing labels counted as equal, or ("sentinel") with -1 for a missing label."""
    how = "inner" if unlabelled == "skip" else "left"
    a, b = labels.select(F.col("id").alias("src"), F.col("comm").alias("comm_src")), labels.select(F.col("id").alias("dst"), F.col("comm").alias("comm_dst"))
    both = edges.join(a, "src", how).join(b, "dst", how)
    if unlabelled == "sentinel":
        both = both.withColumn("comm_src", F.coalesce("comm_src", F.lit(-1))).withColumn("comm_dst", F.coalesce("comm_dst", F.lit(-1)))
    return both.withColumn("is_intra", F.col("comm_src").eqNullSafe(F.col("comm_dst")))


def scored_by_class(edges: DataFrame, labels: DataFrame, unlabelled: str = "skip", known: DataFrame | None = None) -> DataFrame:
    """classified(scored(edges), labels).  A node's degree and community are joined first, so that edges move once for either end.
    known(id, d): the degrees, where they are there already."""
    ends = (degrees(edges) if known is None else known).join(labels.select("id", "comm"), "id", "inner" if unlabelled == "skip" else "left")
    if unlabelled == "sentinel":
        ends = ends.withColumn("comm", F.coalesce("comm", F.lit(-1)))
    a, b = (ends.select(F.col("id").alias(x), F.col("d").alias(f"d_{x}"), F.col("comm").alias(f"comm_{x}")) for x in ("src", "dst"))
    rows = with_scores(edges.join(a, "src").join(b, "dst"))
    return rows.withColumn("is_intra", F.col("comm_src").eqNullSafe(F.col("comm_dst")))


def _mean(value: str, intra: bool) -> Column:
    return F.coalesce(F.avg(F.when(F.col("is_intra") == intra, F.col(value))), F.lit(0.0))


def _both_or_zero(a: str, b: str) -> list[Column]:
    """The two means, both 0 if either class is empty."""
    some = (F.col("n1") > 0) & (F.col("n2") > 0)
    return [F.when(some, F.col(a)).otherwise(0.0).alias(a), F.when(some, F.col(b)).otherwise(0.0).alias(b)]


def separation(edges: DataFrame, labels: DataFrame, strict: bool = False, unlabelled: str = "skip") -> DataFrame:
    """One row: mu_intra, mu_inter, delta of the scores.  strict: all are 0 if a class is empty."""
    out = scored_by_class(edges, labels, unlabelled).agg(F.count(F.when(F.col("is_intra"), 1)).alias("n1"), F.count(F.when(~F.col("is_intra"), 1)).alias("n2"), _mean("score", True).alias("mu_intra"), _mean("score", False).alias("mu_inter"))
    if strict:
        out = out.select(*_both_or_zero("mu_intra", "mu_inter"))
    return out.select("mu_intra", "mu_inter", (F.col("mu_intra") - F.col("mu_inter")).alias("delta"))


def hub_bridge(edges: DataFrame, labels: DataFrame, empty_intra: float = 0.0, unlabelled: str = "skip") -> DataFrame:
    """One row: mean degree products of inter and intra edges, their difference (0 if a class is empty) and ratio.
    Without intra edges the ratio is 1, or with empty_intra > 0 that number stands for their mean."""
    out = scored_by_class(edges, labels, unlabelled).agg(F.count(F.when(F.col("is_intra"), 1)).alias("n1"), F.count(F.when(~F.col("is_intra"), 1)).alias("n2"), _mean("d_product", False).alias("mean_inter"), _mean("d_product", True).alias("mean_intra"))
    some = (F.col("n1") > 0) & (F.col("n2") > 0)
    base = F.when(F.col("mean_intra") > 0, F.col("mean_intra")).otherwise(F.lit(empty_intra))
    ratio = F.when(base > 0, F.try_divide(F.col("mean_inter"), base)).otherwise(1.0)
    return out.select("mean_inter", "mean_intra", F.when(some, F.col("mean_inter") - F.col("mean_intra")).otherwise(0.0).alias("difference"), ratio.alias("ratio"))


def volumes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(comm, vol, nodes): degrees summed over each community's nodes."""
    d = labels.join(degrees(edges), "id", "left")
    return d.groupBy("comm").agg(F.coalesce(F.sum("d"), F.lit(0)).alias("vol"), F.count("*").alias("nodes"))


def modularity_terms(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: m, f (share of intra edges), g (sum of squared volumes over 4 m^2), q = f - g; 0 for a graph without edges.
    Only labelled nodes have a community."""
    intra = classified(edges, labels).agg(F.count(F.when(F.col("is_intra"), 1)).alias("intra"))
    m = edges.agg(F.count("*").alias("m"))
    squares = volumes(edges, labels).agg(F.coalesce(F.sum(F.col("vol").cast("double") * F.col("vol")), F.lit(0.0)).alias("squares"))
    one = intra.crossJoin(m).crossJoin(squares)  # of one row each
    f = F.coalesce(F.try_divide(F.col("intra").cast("double"), F.col("m")), F.lit(0.0))
    g = F.coalesce(F.try_divide("squares", F.lit(4.0) * F.col("m") * F.col("m")), F.lit(0.0))
    return one.select("m", f.alias("f"), g.alias("g"), (f - g).alias("q"))


def label_modularity(edges: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row with q, or null if any of nodes(id) has no label."""
    missing = nodes.join(labels, "id", "left_anti").agg(F.count("*").alias("missing"))
    return modularity_terms(edges, labels).crossJoin(missing).select(F.when(F.col("missing") == 0, F.col("q")).alias("q"))


def theory(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of predictions: counts, means, ratio, f terms, weighted volumes, and the lower bound of the change in q."""
    rows = scored_by_class(edges, labels)
    sums = rows.agg(
        F.count(F.when(F.col("is_intra"), 1)).alias("n1"), F.count(F.when(~F.col("is_intra"), 1)).alias("n2"), _mean("score", True).alias("mu_intra"), _mean("score", False).alias("mu_inter"),
        F.coalesce(F.sum(F.when(F.col("is_intra"), F.col("score"))), F.lit(0.0)).alias("s_intra"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("s"), F.count("*").alias("m"),
    )
    weighted = rows.select(F.explode(F.array(F.struct(F.col("comm_src").alias("comm"), "score"), F.struct(F.col("comm_dst").alias("comm"), "score"))).alias("x"))
    by_score = weighted.groupBy("x.comm").agg(F.sum("x.score").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("square_scores"))
    plain = volumes(edges, labels).agg(F.sum(F.col("vol").cast("double") * F.col("vol")).alias("squares"))
    one = sums.crossJoin(by_score).crossJoin(plain)
    m, s = F.col("m").cast("double"), F.col("s")
    delta = F.col("mu_intra") - F.col("mu_inter")
    f, f_w = F.try_divide(F.col("n1").cast("double"), m), F.try_divide("s_intra", s)
    # a weighted volume is a sum of score / mean score, so that 4 W^2 is 4 m^2
    g, g_w = F.try_divide("squares", 4.0 * m * m), F.try_divide("square_scores", 4.0 * s * s)
    predicted = F.try_divide(F.col("n1") * F.col("n2") * delta, m * s)
    return one.select(
        "n1", "n2", "m", "mu_intra", "mu_inter", delta.alias("delta"), F.when(F.col("mu_intra") > 0, F.try_divide("mu_inter", "mu_intra")).otherwise(1.0).alias("ratio_predicted"), f.alias("f_original"), f_w.alias("f_weighted"),
        predicted.alias("f_improvement"), m.alias("w_unweighted"), m.alias("w_weighted"), g.alias("g_original"), g_w.alias("g_weighted"), (g_w - g).alias("g_change"), (predicted - (g_w - g)).alias("q_lower_bound"),
    )


def preservation(edges: DataFrame, sparse: DataFrame, labels: DataFrame, empty_rate: float = 0.0) -> DataFrame:
    """One row: edges of each class before and after, rates, ratio of inter to intra rate and whether it is over 1.

    An empty class has ``empty_rate``.  With empty_rate 0 the ratio is 0 if a class is empty; it is infinite if only the
    intra rate is 0 and 0 if both are.
    """
    kept = classified(edges.select("src", "dst"), labels).join(sparse.select("src", "dst", F.lit(1).alias("kept")), ["src", "dst"], "left")
    count = lambda intra, on: F.count(F.when((F.col("is_intra") == intra) & on, 1))
    every, still = F.lit(True), F.col("kept").isNotNull()
    n = kept.agg(count(True, every).alias("intra_original"), count(False, every).alias("inter_original"), count(True, still).alias("intra_preserved"), count(False, still).alias("inter_preserved"))
    rate = lambda k: F.coalesce(F.try_divide(F.col(f"{k}_preserved").cast("double"), F.col(f"{k}_original")), F.lit(float(empty_rate)))
    n = n.withColumn("intra_rate", rate("intra")).withColumn("inter_rate", rate("inter"))
    empty = (F.col("intra_original") == 0) | (F.col("inter_original") == 0)
    ratio = F.when(F.col("intra_rate") > 0, F.try_divide("inter_rate", "intra_rate")).when(F.col("inter_rate") > 0, INF).otherwise(0.0)
    ratio = F.when(empty, 0.0).otherwise(ratio) if empty_rate == 0 else ratio
    return n.withColumn("ratio", ratio).withColumn("supported", F.col("ratio") > 1)


def observed(edges: DataFrame, sparse: DataFrame, labels: DataFrame) -> DataFrame:
    """preservation() with empty classes at rate 1, and m, f, g, q of the sparse graph."""
    terms = modularity_terms(sparse, labels).select(F.col("m").alias("m_sparse"), F.col("f").alias("f_sparse"), F.col("g").alias("g_sparse"), F.col("q").alias("q_sparse"))
    return preservation(edges, sparse, labels, empty_rate=1.0).drop("supported").crossJoin(terms)


def reconstruction(edges: DataFrame, sparse: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: changes of q, f and g, and what is left of q's change after f's and g's."""
    a = modularity_terms(edges, labels).select(F.col("f").alias("f0"), F.col("g").alias("g0"), F.col("q").alias("q0"))
    b = modularity_terms(sparse, labels).select(F.col("f").alias("f1"), F.col("g").alias("g1"), F.col("q").alias("q1"))
    d = lambda k: F.col(f"{k}1") - F.col(f"{k}0")
    return a.crossJoin(b).select(d("q").alias("dq"), d("f").alias("df"), d("g").alias("dg"), (d("f") - d("g")).alias("dq_reconstructed"), F.abs(d("q") - (d("f") - d("g"))).alias("epsilon"))


def misclassification(edges: DataFrame, sparse: DataFrame, found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: removed edges between found communities that the truth puts inside one, and kept edges within a found
    community that the truth puts between two; shares are 0 without such edges."""
    both = classified(classified(edges.select("src", "dst"), found).select("src", "dst", F.col("is_intra").alias("found")), truth).select("src", "dst", "found", F.col("is_intra").alias("true"))
    both = both.join(sparse.select("src", "dst", F.lit(1).alias("kept")), ["src", "dst"], "left")
    count = lambda c: F.count(F.when(c, 1))
    gone, stays = F.col("kept").isNull(), F.col("kept").isNotNull()
    n = both.agg(
        count(gone & ~F.col("found")).alias("inter_removed"), count(gone & ~F.col("found") & F.col("true")).alias("inter_removed_but_intra"),
        count(stays & F.col("found")).alias("intra_preserved"), count(stays & F.col("found") & ~F.col("true")).alias("intra_preserved_but_inter"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return n.withColumn("removed_rate", share("inter_removed_but_intra", "inter_removed")).withColumn("preserved_rate", share("intra_preserved_but_inter", "intra_preserved"))


def noise_statistics(edges: DataFrame, noise: DataFrame, labels: DataFrame) -> DataFrame:
    """One row about added edges; those with an unlabelled end count only among the added."""
    m, added = edges.agg(F.count("*").alias("n_original")), noise.agg(F.count("*").alias("n_added"))
    kinds = classified(noise.select("src", "dst"), labels).agg(F.count(F.when(~F.col("is_intra"), 1)).alias("noise_inter"), F.count(F.when(F.col("is_intra"), 1)).alias("noise_intra"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return m.crossJoin(added).crossJoin(kinds).withColumn("ratio", share("n_added", "n_original")).withColumn("inter_ratio", share("noise_inter", "n_added"))
