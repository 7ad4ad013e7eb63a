"""Named datasets: where their files lie, which reader takes them and where their labels are.

No network is used: an entry holds paths.  Names are added with ``register``; the names below are known already, and their
files are looked for below a folder by the layout of their family.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph.components import component_labels
from ..graph.halves import bisection
from ..operators.edges import canonical, dense_ids, induced, nodes_of, raw_counts, relabelled
from ..operators.sparsify import uniform_count
from . import files
from .fixtures import karate

READERS: dict[str, Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]] = {"snap": files.read_snap, "network": files.read_network_repository, "classic": files.read_classic}

# Names of public graphs, by the layout of their files.
EDGE_LISTS = """wiki-Vote ca-HepPh ca-HepTh ca-AstroPh ca-CondMat ca-GrQc ego-Facebook soc-Epinions1 cit-HepPh cit-HepTh cit-Patents wiki-Talk
facebook-combined soc-Pokec email-Enron""".split()
WITH_NODE_LABELS = ["email-Eu-core"]
WITH_COMMUNITIES = "com-DBLP com-Amazon com-Youtube com-LiveJournal com-Orkut com-Friendster wiki-topcats".split()
CITATIONS = ["cora", "citeseer"]
PROTEINS = ["yeast-ppi", "human-ppi"]
CLASSIC = "karate dolphins football polbooks lesmis polblogs jazz celegans netscience power".split()
CLASSIC_WITH_LABELS = "karate dolphins football polbooks polblogs".split()
FACEBOOK = """Amherst41 Bowdoin47 Brandeis99 Brown11 Bucknell39 Cal65 Caltech36 Carnegie49 Colgate88 Columbia2 Cornell5 Dartmouth6 Duke14 Emory27
Georgetown15 GWU54 Hamilton46 Harvard1 Haverford76 Howard90 Indiana69 JMU79 JohnsHopkins55 Lehigh96 Maine59 Mich67 Michigan23 Middlebury45
MIT8 MSU24 UCSB37 UNC28 Northeastern19 Northwestern25 NotreDame57 NYU9 Oberlin44 Penn94 Pepperdine86 Princeton12 Reed98 Rice31 Rochester38
Rutgers89 Santa74 Simmons81 Smith60 Stanford3 Swarthmore42 Syracuse56 Temple83 Tennessee95 Texas80 Tufts18 Tulane29 UC33 UC61 UC64 UCLA26
UCSC68 UChicago30 UConn91 UF21 UIllinois20 UMass92 UPenn7 USC35 USF51 USFCA72 UVA16 Vanderbilt48 Vermont70 Villanova62 Virginia63 Wake73
WashU32 Wellesley22 Wesleyan43 William77 Williams40 Wisconsin87 Yale4""".split()
# Short names.
_ALIASES = {"dblp": "com-DBLP", "amazon": "com-Amazon", "youtube": "com-Youtube", "livejournal": "com-LiveJournal", "orkut": "com-Orkut"}


@dataclass(frozen=True)
class Dataset:
    path: str
    #: one of READERS, or "citation" for an archive with .content and .cites, which hold labels too
    reader: str = "snap"
    labels: str | None = None
    #: "nodes" for ``node label`` lines, "communities" for a community a line
    labels_format: str = "communities"


_known: dict[str, Dataset] = {}


def has_labels(name: str) -> bool:
    """Whether a known name comes with labels; ValueError for other names."""
    name = _ALIASES.get(name, name)
    if name in _known:
        return bool(_known[name].labels) or _known[name].reader == "citation"
    of_family(name, "")
    return name in (*WITH_NODE_LABELS, *WITH_COMMUNITIES, *CITATIONS, *CLASSIC_WITH_LABELS)


def of_family(name: str, folder: str) -> Dataset:
    """Where a known name's files lie below folder."""
    base = f"{folder}/{name}"
    if name in EDGE_LISTS:
        return Dataset(f"{base}.txt.gz")
    if name in WITH_NODE_LABELS:
        return Dataset(f"{base}.txt.gz", labels=f"{base}-labels.txt.gz", labels_format="nodes")
    if name in WITH_COMMUNITIES:
        return Dataset(f"{base}.txt.gz", labels=f"{base}-communities.txt.gz")
    if name in CITATIONS:
        return Dataset(f"{base}.tgz", "citation")
    if name in PROTEINS or name in FACEBOOK:
        return Dataset(f"{base}.zip", "network")
    if name in CLASSIC:
        return Dataset(f"{base}.zip", "classic")
    raise ValueError(f"unknown dataset {name!r}")


def register(name: str, dataset: Dataset) -> None:
    if dataset.reader not in READERS and dataset.reader != "citation":
        raise ValueError(f"unknown reader {dataset.reader!r}")
    _known[name] = dataset


def forget(name: str) -> None:
    _known.pop(name, None)


def lookup(name: str, folder: str = "data") -> Dataset:
    """A registered name, or a known one below folder; ValueError for others."""
    key = _ALIASES.get(name, name)
    return _known[key] if key in _known else of_family(key, folder)


def load(spark: SparkSession, name: str, folder: str = "data") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(edges, nodes, labels or None); nodes are 0 to n-1, isolated ones included."""
    if name == "karate" and name not in _known:
        edges, labels = karate(spark)
        return edges, labels.select("id"), labels
    if name == "polblogs" and name not in _known:
        raise ValueError("polblogs has no file of this layout: register one")
    found = lookup(name, folder)
    if found.reader == "citation":
        edges, labels, ids = files.read_citations(spark, found.path)
        return edges, ids.select(F.col("new_id").alias("id")), labels
    edges, ids = READERS[found.reader](spark, found.path)
    labels = None
    if found.labels:
        read = files.read_node_labels if found.labels_format == "nodes" else files.read_communities
        labels = read(spark, found.labels, ids)
        labels = labels if labels.limit(1).count() else None
    elif name == "dolphins":
        labels = bisection(edges)
    return edges, ids.select(F.col("new_id").alias("id")), labels


def largest_component(edges: DataFrame) -> DataFrame:
    """(id) of the component with the most nodes; of equals the one with the least id."""
    parts = component_labels(edges)
    best = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return parts.join(F.broadcast(best), "component").select("id")


def load_large(pairs: DataFrame, max_edges: int | None = None, seed: int = 42, dense: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, info) of raw pairs: the largest component, cut to max_edges edges and to its largest component again if it is
    larger; info counts raw rows, self-loops and collapsed edges.  dense: nodes are renumbered 0, 1, ... by id."""
    info = raw_counts(pairs)
    edges = canonical(pairs)
    edges = induced(edges, largest_component(edges))
    if max_edges is not None and edges.count() > max_edges:
        edges = uniform_count(edges, max_edges, seed).select("src", "dst")
        edges = induced(edges, largest_component(edges))
    return relabelled(edges, dense_ids(nodes_of(edges))) if dense else edges, info
