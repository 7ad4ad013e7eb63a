"""Construction, projection and filtering of simple undirected graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from ..functions.text import near


def canonical(pairs: DataFrame) -> DataFrame:
    """Edges with src < dst, each once, without self-loops, of any (src, dst) pairs; rows with a null end go."""
    ends = pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src <> dst")
    return ends.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def require_canonical(edges: DataFrame) -> None:
    """Raises ValueError for directed, repeated or looping input."""
    bad = edges.filter("src >= dst OR src IS NULL OR dst IS NULL").limit(1).count()
    if bad or edges.groupBy("src", "dst").count().filter("count > 1").limit(1).count():
        raise ValueError("edges must be undirected, simple and canonical (src < dst)")


def raw_counts(pairs: DataFrame) -> DataFrame:
    """One row: raw_rows, self_loops, edges, multi_edges_collapsed."""
    both = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    kinds = both.groupBy("src", "dst").agg(F.count("*").alias("n"))
    loop = F.col("src") == F.col("dst")
    counts = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"), F.coalesce(F.sum(F.when(loop, F.col("n"))), F.lit(0)).alias("self_loops"), F.count(F.when(~loop, 1)).alias("edges"))
    return counts.withColumn("multi_edges_collapsed", F.col("raw_rows") - F.col("self_loops") - F.col("edges"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; other columns are kept."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def dense_ids(nodes: DataFrame) -> DataFrame:
    """(id, new_id): 0, 1, ... by id."""
    return numbered(nodes.select("id").distinct(), ["id"], "new_id")


def relabelled(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges in the ids' new numbers, canonical again."""
    a, b = ids.select(F.col("id").alias("src"), F.col("new_id").alias("a")), ids.select(F.col("id").alias("dst"), F.col("new_id").alias("b"))
    moved = edges.join(a, "src").join(b, "dst")
    return moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes(id)."""
    first = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return first.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns)


def topology(edges: DataFrame) -> DataFrame:
    """Edges with weight 1."""
    return edges.select("src", "dst", F.lit(1.0).alias("weight"))


def at_alpha(rows: DataFrame, alpha: float, column: str = "alpha") -> DataFrame:
    return rows.filter(near(F.col(column), alpha))


def closest_alpha(rows: DataFrame, alpha: float, keys: list[str], column: str = "alpha") -> DataFrame:
    """Of each key the row whose alpha is closest; of two as close, the smaller alpha's."""
    rest = [c for c in rows.columns if c not in keys]
    # rounded: 0.8 - 0.75 and 0.85 - 0.8 differ in their last bits
    order = F.struct(F.round(F.abs(F.col(column) - F.lit(alpha)), 9).alias("gap"), F.col(column).alias("at"))
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("best"))
    return best.select(*keys, "best.*")


def jaccard_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: common, only_a, only_b edges."""
    both = a.select("src", "dst", F.lit(1).alias("a")).join(b.select("src", "dst", F.lit(1).alias("b")), ["src", "dst"], "full")
    return both.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("common"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"))


def status(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Each edge with status both, only_a, only_b or neither."""
    marked = edges.select("src", "dst").join(a.select("src", "dst", F.lit(True).alias("a")), ["src", "dst"], "left").join(b.select("src", "dst", F.lit(True).alias("b")), ["src", "dst"], "left")
    kind = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_a").when(F.col("b"), "only_b").otherwise("neither")
    return marked.select("src", "dst", kind.alias("status"))


def is_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether each edge of a is one of b's, and how many are not."""
    missing = a.select("src", "dst").join(b.select("src", "dst"), ["src", "dst"], "left_anti").agg(F.count("*").alias("missing"))
    return missing.select((F.col("missing") == 0).alias("subset"), "missing")
