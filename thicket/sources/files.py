"""Readers of edge lists, labels and communities.

Lines that don't parse are passed over, as are blank lines and comments; ids become long.  Paths are anything that
Spark reads, gzip included, and zip and tar archives: of those the members are read whose names end in one of the endings
that a reader asks for.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from ..operators.edges import canonical, dense_ids, induced, nodes_of, relabelled
from ..storage import stored

def sniffed() -> Column:
    """A line's fields: split at commas if it has one, else at tabs if it has one, else at blanks."""
    return F.when(F.contains(F.col("line"), F.lit(",")), F.split("line", r"\s*,\s*")).when(F.contains(F.col("line"), F.lit("\t")), F.split("line", r"\t+")).otherwise(F.split("line", r"\s+"))


def _members(content: bytes, endings: tuple[str, ...]) -> Iterator[Iterable[bytes]]:
    """The lines of each member of a zip or tar archive, by name."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for name in sorted(n for n in archive.namelist() if n.endswith(endings)):
                with archive.open(name) as lines:
                    yield lines
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as archive:
            for member in sorted((m for m in archive.getmembers() if m.isfile() and m.name.endswith(endings)), key=lambda m: m.name):
                yield archive.extractfile(member)


def _unpacked(batches: Iterable[pa.RecordBatch], endings: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content").to_pylist():
            lines: list[str] = []
            for member in _members(content, endings):
                for line in member:
                    lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                    if len(lines) >= 65536:
                        yield pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])
                        lines = []
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])


#: Endings of archives.
ARCHIVES = (".zip", ".tgz", ".tar", ".tar.gz")


def raw_lines(spark: SparkSession, path: str, endings: tuple[str, ...] = ("",)) -> DataFrame:
    """(value) of a text file's lines, or of an archive's members; an archive is unpacked by one task, and may have 2 GB."""
    if not path.endswith(ARCHIVES):
        return spark.read.text(path)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(partial(_unpacked, endings=endings), "value string")


def _lines(spark: SparkSession, path: str, comment: str, endings: tuple[str, ...] = ("",)) -> DataFrame:
    lines = raw_lines(spark, path, endings).select(F.trim(F.regexp_replace("value", "[\r\n]+$", "")).alias("line"))
    return lines.filter((F.col("line") != "") & ~F.substring("line", 1, 1).isin(*comment)) if comment else lines.filter("line <> ''")


def read_pairs(spark: SparkSession, path: str, comment: str = "#", separator: str = r"\s+", sniff: bool = False, endings: tuple[str, ...] = ("",)) -> DataFrame:
    """(src, dst) as they stand in the file, repeats and loops included.  comment: characters that begin a comment; of a
    line only the first two fields are read."""
    parts = sniffed() if sniff else F.split("line", separator)
    fields = _lines(spark, path, comment, endings).select(parts.alias("f")).select(F.try_element_at("f", F.lit(1)).alias("a"), F.try_element_at("f", F.lit(2)).alias("b"))
    return fields.select(F.expr("try_cast(a AS long)").alias("src"), F.expr("try_cast(b AS long)").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")


def read_bare(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a file of ``src dst`` lines only; anything else fails."""
    return spark.read.csv(path, sep=" ", schema="src long, dst long", mode="FAILFAST")


def dense_graph(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, ids): canonical edges in new ids 0, 1, ... by old id; ids that only a self-loop has count too."""
    # the file is read once; a loop stays until its id is known
    pairs = stored(pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "pairs")
    ids = stored(dense_ids(nodes_of(pairs)), "ids")
    return relabelled(pairs.filter("src <> dst"), ids), ids


def read_snap(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return dense_graph(read_pairs(spark, path, "#"))


def read_network_repository(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """.edges and .mtx files; a size line of .mtx reads as an edge, and as a self-loop it only adds its id."""
    return dense_graph(read_pairs(spark, path, "%#", endings=(".edges", ".mtx")))


def read_classic(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return dense_graph(read_pairs(spark, path, "%#", sniff=True, endings=(".edges", ".mtx", ".txt", ".csv")))


def _numbered_lines(spark: SparkSession, path: str, endings: tuple[str, ...] = ("",)) -> DataFrame:
    """(line_no, line) in file order; a folder's files come by name, as parts of one file.  Rows of a split have numbers that follow each
    other, so a count for each split is all that is needed: nothing is sorted."""
    if path.endswith(ARCHIVES):
        raw = raw_lines(spark, path, endings).select("value", F.lit("").alias("file"), F.spark_partition_id().cast("long").alias("start"))
    else:
        raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    raw = raw.withColumn("at", F.monotonically_increasing_id())
    offsets, before = [], 0
    for r in raw.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("file", "start").collect():  # a row a split
        offsets.append((r["file"], r["start"], before - r["first"]))
        before += r["n"]
    shift = spark.createDataFrame(offsets, "file string, start long, shift long")
    return raw.join(F.broadcast(shift), ["file", "start"]).select((F.col("at") + F.col("shift")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))


def read_citations(spark: SparkSession, content: str, cites: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, labels, ids) of a .content and a .cites file, or of an archive that holds both: ids are numbered as they stand in content, the last column's
    classes by name; citations with an unknown end go."""
    fields = _numbered_lines(spark, content, (".content",)).filter("trim(line) <> ''").select("line_no", F.split("line", "\t").alias("f"))
    known = fields.select("line_no", F.col("f")[0].alias("name"), F.element_at("f", -1).alias("class"))
    known = known.groupBy("name").agg(F.min("line_no").alias("line_no"), F.min_by("class", "line_no").alias("class"))
    ids = numbered(known, ["line_no"], "new_id")
    classes = ids.select("class").distinct()
    classes = numbered(classes, ["class"], "comm")
    labels = ids.join(F.broadcast(classes), "class").select(F.col("new_id").alias("id"), "comm")
    pair = _lines(spark, cites or content, "", (".cites",)).select(F.split("line", r"\s+").alias("f")).filter("size(f) >= 2").select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"))
    a, b = ids.select(F.col("name").alias("a"), F.col("new_id").alias("src")), ids.select(F.col("name").alias("b"), F.col("new_id").alias("dst"))
    return canonical(pair.join(a, "a").join(b, "b").select("src", "dst")), labels, ids.select(F.col("name").alias("id"), "new_id")


def read_node_labels(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(id, comm) of ``node label`` lines; unknown nodes go, a node's last line counts."""
    f = _numbered_lines(spark, path).select("line_no", F.split(F.trim("line"), r"\s+").alias("f"))
    rows = f.select("line_no", F.expr("try_cast(try_element_at(f, 1) AS long)").alias("id"), F.expr("try_cast(try_element_at(f, 2) AS long)").alias("comm")).filter("id IS NOT NULL AND comm IS NOT NULL")
    last = rows.groupBy("id").agg(F.max_by("comm", "line_no").alias("comm"))
    return last.join(ids, "id").select(F.col("new_id").alias("id"), "comm")


def read_communities(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(id, comm) of lines of nodes: comm is the line's number from 0, comments and blank lines counted; of several
    communities a node's first counts; what is no number is passed over."""
    lines = _numbered_lines(spark, path).filter("trim(line) <> '' AND NOT startswith(trim(line), '#')")
    nodes = lines.select("line_no", F.explode(F.split(F.trim("line"), r"\s+")).alias("t")).select("line_no", F.expr("try_cast(t AS long)").alias("id")).filter("id IS NOT NULL")
    return nodes.groupBy("id").agg(F.min("line_no").alias("comm")).join(ids, "id").select(F.col("new_id").alias("id"), "comm")


def read_labelled(spark: SparkSession, edges: str, labels: str) -> tuple[DataFrame, DataFrame]:
    """(edges, labels) restricted to labelled nodes, which are renumbered by id."""
    own = spark.read.text(labels).select(F.split(F.trim("value"), r"\s+").alias("f")).select(F.expr("try_cast(try_element_at(f, 1) AS long)").alias("id"), F.expr("try_cast(try_element_at(f, 2) AS long)").alias("comm")).filter("id IS NOT NULL AND comm IS NOT NULL").dropDuplicates(["id"])
    ids = dense_ids(own)
    kept = induced(canonical(read_pairs(spark, edges)), own)
    return relabelled(kept, ids), own.join(ids, "id").select(F.col("new_id").alias("id"), "comm")


#: Labels of books' leanings.
LEANING = {"l": 0, "n": 1, "c": 2}


_GML, _BRACKETS = (re.compile(x, re.ASCII) for x in (r'"[^"]*"|\[|\]|[^\s\[\]"]+', r'"[^"]*"|\[|\]'))


def _gml_splits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Lines without comments, with the split that they lie in; a split's lines follow each other."""
    for batch in batches:
        values, names, starts = (batch.column(c).to_pylist() for c in ("value", "file", "start"))
        low = 0
        for at in range(1, len(values) + 1):
            if at == len(values) or (names[at], starts[at]) != (names[low], starts[low]):
                yield (names[low], starts[low]), [v.removesuffix("\r") for v in values[low:at] if not v.lstrip(" ").startswith("#")]
                low = at


def _gml_depths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, how much deeper it ends than it begins, and how many brackets open at each depth."""
    found: dict[tuple[str, int], list] = {}
    for split, lines in _gml_splits(batches):
        own = found.setdefault(split, [0, {}])
        for line in lines:
            if "[" in line or "]" in line:
                for token in _BRACKETS.findall(line):
                    if token == "[":
                        own[1][own[0]] = own[1].get(own[0], 0) + 1
                        own[0] += 1
                    elif token == "]":
                        own[0] -= 1
    rows = [(*split, turn, list(opened), list(opened.values())) for split, (turn, opened) in found.items()]
    if rows:
        columns = list(zip(*rows, strict=True))
        types = pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "start", "turn", "depths", "opened"])


def _gml_pieces(batches: Iterable[pa.RecordBatch], begun: dict[tuple[str, int], tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Blocks with their names and tokens: whole ones, and what a split holds of those that lie in several."""
    out: list[tuple] = []
    split = name = None
    seq = depth = block = 0
    tokens: list[str] = []
    mine = False  # whether the block and its name began in this split

    def put(whole: bool) -> None:
        if tokens or own is not None and not whole:
            out.append((block - 1, seq, own, tokens, whole))

    def drained() -> Iterator[pa.RecordBatch]:
        if out:
            types = pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["block", "seq", "name", "tokens", "whole"])
            out.clear()

    def ended() -> None:
        """What is open at the end of a split is told as pieces: the open block, and a name of the next one."""
        put(False)
        if name is not None:
            out.append((block, seq, name, [], False))

    own = None
    for at, lines in _gml_splits(batches):
        if at != split:
            if split is not None:
                ended()
            split, tokens, name, own, mine = at, [], None, None, False
            seq, depth, block = begun[at]
        for line in lines:
            for token in _GML.findall(line):
                if token == "[":
                    if depth == 1:
                        block += 1
                        tokens, own, name, mine = [], name, None, name is not None
                    elif depth == 2:
                        tokens.append(token)
                    depth += 1
                elif token == "]":
                    depth -= 1
                    if depth == 1:
                        put(mine)
                        tokens, own = [], None
                elif depth == 2:
                    tokens.append(token)
                elif depth == 1:
                    name = token
        if len(out) >= 1 << 14:
            yield from drained()
    if split is not None:
        ended()
    yield from drained()


def gml_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block, name, fields) of the blocks directly within the outermost one of a GML file, as ``node [ ... ]`` in ``graph [ ... ]``;
    fields is a map of a block's own keys, each with its first value, without quotes; a nested block's value is ``[``.

    The file is read twice in splits, side by side: how deep each split ends, a few numbers a split, tells where the others begin; then
    each makes up the blocks that lie in it, and only what lies in several splits is gathered.  Lines that begin with # are
    comments.  A string must end in its line; keys, brackets and values may be spread over lines as they like.
    """
    if path.endswith(ARCHIVES):
        raw = raw_lines(spark, path).select("value", F.lit("").alias("file"), F.spark_partition_id().cast("long").alias("start"))
    else:
        raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    begun, depth, block = {}, 0, 0
    for seq, r in enumerate(sorted(raw.mapInArrow(_gml_depths, "file string, start long, turn long, depths array<long>, opened array<long>").collect(), key=lambda r: (r["file"], r["start"]))):  # a row a split
        begun[r["file"], r["start"]] = seq, depth, block
        block += sum(n for d, n in zip(r["depths"], r["opened"], strict=True) if depth + d == 1)
        depth += r["turn"]
    pieces = raw.mapInArrow(partial(_gml_pieces, begun=begun), "block long, seq long, name string, tokens array<string>, whole boolean")
    pieces = stored(pieces, "pieces")
    cut = pieces.filter("NOT whole").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("seq", "name", "tokens"))).alias("p"))
    names = F.filter(F.transform("p", lambda x: x["name"]), lambda x: x.isNotNull())
    cut = cut.select("block", F.try_element_at(names, F.lit(-1)).alias("name"), F.flatten(F.transform("p", lambda x: x["tokens"])).alias("t")).filter("size(t) > 0 AND name IS NOT NULL")
    own = pieces.filter("whole").select("block", "name", F.col("tokens").alias("t")).unionByName(cut)
    keys = F.transform(F.sequence(F.lit(0), F.floor(F.size("t") / 2).cast("int") - 1), lambda i: F.struct(F.get("t", 2 * i).alias("key"), F.btrim(F.get("t", 2 * i + 1), F.lit('"')).alias("value")))
    pairs = F.when(F.size("t") > 1, keys).otherwise(F.slice(keys, 1, 0))
    first = F.aggregate(pairs, F.slice(pairs, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: y["key"] == x["key"]), acc).otherwise(F.array_append(acc, x)))
    return own.select("block", "name", F.map_from_entries(first).alias("fields"))


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, labels) of a GML file: its edges, and ids and values of its nodes; a value that is a leaning's letter is numbered, one
    that is no number or missing is 1.  Nodes and edges without whole numbers for ids are passed over."""
    blocks = gml_blocks(spark, path)
    number = lambda k: F.try_element_at("fields", F.lit(k)).try_cast("long")
    pairs = blocks.filter("name = 'edge'").select(number("source").alias("src"), number("target").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")
    value = F.try_element_at("fields", F.lit("value"))
    leaning = F.create_map(*(F.lit(x) for pair in LEANING.items() for x in pair))
    comm = F.coalesce(F.try_element_at(leaning, value).cast("long"), value.try_cast("long"), F.lit(1).cast("long"))
    return canonical(pairs), blocks.filter("name = 'node'").select(number("id").alias("id"), comm.alias("comm")).filter("id IS NOT NULL")


def first_appearance(pairs: DataFrame) -> DataFrame:
    """(id, new_id) by where an id first stands in pairs(at, src, dst)."""
    seen = pairs.select(F.explode(F.array(F.struct((F.col("at") * 2).alias("at"), F.col("src").alias("id")), F.struct((F.col("at") * 2 + 1).alias("at"), F.col("dst").alias("id")))).alias("x"))
    first = seen.groupBy("x.id").agg(F.min("x.at").alias("at"))
    return numbered(first, ["at"], "new_id").select("id", "new_id")
