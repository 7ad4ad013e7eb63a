"""Writers: edge files, trial tables and LaTeX."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escaped, mean_std
from ..operators.edges import symmetric


#: Rows of a LaTeX table.
MAX_ROWS = 1000


def read_trials(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that write_table wrote as CSV; lines that don't fit the schema fail."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def write_edges(edges: DataFrame, path: str, both: bool = False) -> None:
    """``src dst`` lines; both: each edge in both directions, without weights."""
    rows = symmetric(edges.select("src", "dst")) if both else edges
    rows.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"))).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, kind: str = "csv") -> None:
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path) if kind == "json" else writer.parquet(path)


def append_trials(rows: DataFrame, path: str, batch: str) -> None:
    """Adds a batch of trials(dataset, ...) below path, a folder a dataset and batch.  A batch that is added again takes its own
    place, so that an attempt may be repeated; the log names the batches that are whole (``log_batch``, ``committed``)."""
    named = rows.withColumn("batch", F.lit(batch))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "batch").parquet(f"{path}/rows")


_LOG = "dataset string, state string, n long, seconds double, message string, batch string"


def log_batch(spark: SparkSession, path: str, batch: str, dataset: str, state: str, n: int = 0, seconds: float = 0.0, message: str = "") -> None:
    """One line of the run log: a batch's last state (done, failed, late), rows, seconds and message."""
    line = spark.createDataFrame([(dataset, state, n, float(seconds), message, batch)], _LOG)
    line.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/log")


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, state, n, seconds, message, batch) of every batch that was tried; no rows if none was."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _LOG)
    return spark.read.schema(_LOG).parquet(f"{path}/log")


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the batches that the log calls done; what a failed attempt left is passed over."""
    done = run_log(spark, path).filter("state = 'done'").select("batch")
    if not done.limit(1).count():
        return spark.createDataFrame([], f"{schema}, dataset string, batch string")
    return spark.read.schema(f"{schema}, dataset string, batch string").parquet(f"{path}/rows").join(done, "batch", "left_semi")


def write_gml(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """A GML file of edges(src, dst) and nodes(id, value), in lines of a key and a value each, as a folder of parts: the parts in the
    order of their names make up the file.  The first has the head and the last the tail; blocks are written where they lie."""
    spark = edges.sparkSession
    block = lambda name, *pairs: F.concat_ws("\n", F.lit(f"  {name} ["), *(F.concat(F.lit(f"    {k} "), v) for k, v in pairs), F.lit("  ]"))
    text = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    head, tail = (spark.createDataFrame([(line,)], "value string").coalesce(1) for line in ("graph [\n  directed 0", "]"))
    own = nodes.select(block("node", ("id", F.col("id").cast("string")), ("value", text("value"))).alias("value"))
    ties = edges.select(block("edge", ("source", F.col("src").cast("string")), ("target", F.col("dst").cast("string"))).alias("value"))
    # a union's tasks are those of its parts, one after the other, and tasks number the files
    head.unionByName(own).unionByName(ties).unionByName(tail).write.mode("overwrite").text(path)


def latex_table(summary: DataFrame, key: str, metrics: list[str], caption: str, digits: int = 3, order: str | None = None) -> str:
    """A LaTeX table of ``metric_mean`` and ``metric_std`` columns, a row a key, in order of order, largest first, or of the
    key.  The summary is collected: ValueError if it has more than MAX_ROWS rows."""
    rows = summary.orderBy(*([F.desc(order)] if order else []), key).limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows")
    head = " & ".join(escaped(x) for x in (key, *metrics))
    body = "\n".join(" & ".join([escaped(str(r[key])), *(mean_std(r[f"{m}_mean"], r[f"{m}_std"], digits) for m in metrics)]) + r" \\" for r in rows)
    return f"\\begin{{table}}\n\\caption{{{escaped(caption)}}}\n\\begin{{tabular}}{{l{'r' * len(metrics)}}}\n\\toprule\n{head} \\\\\n\\midrule\n{body}\n\\bottomrule\n\\end{{tabular}}\n\\end{{table}}\n"


def wide_latex(summary: DataFrame, key: str, across: str, metric: str, caption: str, digits: int = 3) -> str:
    """A LaTeX table of one metric's means and deviations: a row a key, a column for each value of across; MAX_ROWS cells."""
    rows = summary.select(key, across, f"{metric}_mean", f"{metric}_std").limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} cells")
    cells = {(r[0], r[1]): mean_std(r[2], r[3], digits) for r in rows}
    columns, keys = sorted({c for _, c in cells}), sorted({k for k, _ in cells})
    body = "\n".join(" & ".join([escaped(str(k)), *(cells.get((k, c), "--") for c in columns)]) + r" \\" for k in keys)
    head = " & ".join([escaped(key), *(escaped(str(c)) for c in columns)])
    return f"\\begin{{table}}\n\\caption{{{escaped(caption)}}}\n\\begin{{tabular}}{{l{'r' * len(columns)}}}\n\\toprule\n{head} \\\\\n\\midrule\n{body}\n\\bottomrule\n\\end{{tabular}}\n\\end{{table}}\n"
