"""Readers and writers on small files."""

import pytest
from pyspark.sql import functions as F

from thicket.functions.text import mean_std, scientific, seconds
from thicket.operators.summaries import mean_std as summary
from thicket.sources import files, registry, sinks


def pairs(df):
    return sorted((r.src, r.dst) for r in df.collect())


def test_snap(spark, tmp_path):
    f = tmp_path / "g.txt"
    f.write_text("# a comment\n\n10 20\n20\t10\n30 30\n20 40 7\nx 3\n10 20\n")
    edges, ids = files.read_snap(spark, str(f))
    assert {r.id: r.new_id for r in ids.collect()} == {10: 0, 20: 1, 30: 2, 40: 3}
    assert pairs(edges) == [(0, 1), (1, 3)]


def test_size_line_and_separators(spark, tmp_path):
    f = tmp_path / "g.mtx"
    f.write_text("%%MatrixMarket\n3 3 2\n1 2\n2 3\n")
    assert pairs(files.read_network_repository(spark, str(f))[0]) == [(0, 1), (1, 2)]
    for sep in (",", "\t", "  "):
        f.write_text(f"1{sep}2\n2{sep}3\n")
        assert pairs(files.read_classic(spark, str(f))[0]) == [(0, 1), (1, 2)]


def test_bare(spark, tmp_path):
    f = tmp_path / "g.txt"
    f.write_text("1 2\n3 4\n")
    assert pairs(files.read_bare(spark, str(f))) == [(1, 2), (3, 4)]
    f.write_text("1 2\nx 4\n")
    with pytest.raises(Exception):
        files.read_bare(spark, str(f)).collect()


def test_citations(spark, tmp_path):
    (tmp_path / "c.content").write_text("p9\t0\t1\tNeural\np2\t1\t0\tCase\np5\t1\t1\tNeural\n")
    (tmp_path / "c.cites").write_text("p9\tp2\np2\tp9\np5\tp9\np5\tzz\np5\tp5\n")
    edges, labels, ids = files.read_citations(spark, str(tmp_path / "c.content"), str(tmp_path / "c.cites"))
    assert {r.id: r.new_id for r in ids.collect()} == {"p9": 0, "p2": 1, "p5": 2}
    assert pairs(edges) == [(0, 1), (0, 2)]
    assert {r.id: r.comm for r in labels.collect()} == {0: 1, 1: 0, 2: 1}


def test_labels_and_communities(spark, tmp_path):
    ids = spark.createDataFrame([(10, 0), (20, 1), (30, 2)], "id long, new_id long")
    f = tmp_path / "l.txt"
    f.write_text("10 1\n20 2\n10 3\n99 4\n")
    assert {r.id: r.comm for r in files.read_node_labels(spark, str(f), ids).collect()} == {0: 3, 1: 2}
    f.write_text("# comment\n10 20\n\n20 x 30\n")
    assert {r.id: r.comm for r in files.read_communities(spark, str(f), ids).collect()} == {0: 1, 1: 1, 2: 3}


def test_gml_and_labelled(spark, tmp_path):
    f = tmp_path / "g.gml"
    f.write_text('graph [\n node [ id 0 label "a" value "l" ]\n node [ id 1 value "c" ]\n node [ id 2 ]\n edge [ source 0 target 1 ]\n edge [ source 1 target 0 ]\n]')
    edges, labels = files.read_gml(spark, str(f))
    assert pairs(edges) == [(0, 1)] and {r.id: r.comm for r in labels.collect()} == {0: 0, 1: 2, 2: 1}
    (tmp_path / "e.txt").write_text("5 7\n7 9\n5 9\n")
    (tmp_path / "n.txt").write_text("5 1\n7 2\n")
    edges, labels = files.read_labelled(spark, str(tmp_path / "e.txt"), str(tmp_path / "n.txt"))
    assert pairs(edges) == [(0, 1)] and {r.id: r.comm for r in labels.collect()} == {0: 1, 1: 2}


def test_registry(spark, tmp_path):
    with pytest.raises(ValueError):
        registry.lookup("nowhere")
    (tmp_path / "g.txt").write_text("1 2\n2 3\n")
    (tmp_path / "c.txt").write_text("1 2\n3\n")
    registry.register("tiny", registry.Dataset(str(tmp_path / "g.txt"), labels=str(tmp_path / "c.txt")))
    edges, nodes, labels = registry.load(spark, "tiny")
    assert edges.count() == 2 and nodes.count() == 3 and {r.comm for r in labels.collect()} == {0, 1}
    assert registry.load(spark, "karate")[0].count() == 78
    raw = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (5, 6), (3, 3)], "src long, dst long")
    edges, info = registry.load_large(raw)
    assert pairs(edges) == [(0, 1), (1, 2)] and info.first().self_loops == 1
    assert registry.load_large(raw, max_edges=1)[0].count() == 1


def test_sinks(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    sinks.write_edges(edges, str(tmp_path / "out"), both=True)
    assert len(pairs(files.read_bare(spark, str(tmp_path / "out")))) == 4
    rows = spark.createDataFrame([("a", 0.5, 1.0), ("a", 0.5, 2.0), ("b", 0.5, 3.0)], "dataset string, alpha double, q double")
    path = str(tmp_path / "trials")
    for batch, some in (("one", rows), ("two", rows.filter("q < 3")), ("one", rows)):
        sinks.append_trials(some, path, batch)
        sinks.log_batch(spark, path, batch, "a", "done", some.count(), 1.5)
    schema = "alpha double, q double"
    assert sinks.committed(spark, path, schema).count() == 5
    # an attempt that breaks off midway changes nothing, nor does one whose line in the log is missing
    with pytest.raises(Exception, match="broken"):
        sinks.append_trials(rows.withColumn("q", rows.q + F.when(rows.q > 2, F.raise_error(F.lit("broken"))).otherwise(1.0)), path, "one")
    sinks.append_trials(rows, path, "three")
    assert sorted(r.q for r in sinks.committed(spark, path, schema).collect()) == [1, 1, 2, 2, 3]
    assert sorted((r.batch, r.state, r.n, r.seconds) for r in sinks.run_log(spark, path).collect()) == [("one", "done", 3, 1.5), ("two", "done", 2, 1.5)]
    assert sinks.run_log(spark, path + "x").count() == 0 and sinks.committed(spark, path + "x", schema).count() == 0
    table = sinks.latex_table(summary(rows, ["dataset"], ["q"]), "dataset", ["q"], "100 %")
    assert r"$1.500 \pm 0.707$" in table and r"100 \%" in table and "3.000" in table
    assert mean_std(None, None) == "--" and seconds(0.25) == "250ms" and scientific(0.0) == "0" and "10^{-5}" in scientific(2e-5)


def test_archives_and_registry(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    with zipfile.ZipFile(tmp_path / "Yale4.zip", "w") as z:
        z.writestr("readme.html", "9 9\n")
        z.writestr("socfb-Yale4.mtx", "%%MatrixMarket\n4 4 3\n1 2\n2 3\n3 1\n")
    with zipfile.ZipFile(tmp_path / "dolphins.zip", "w") as z:
        z.writestr("dolphins.edges", "".join(f"{a},{b}\n" for part in (range(5), range(5, 10)) for a in part for b in part if a < b) + "4,5\n")
    with tarfile.open(tmp_path / "cora.tgz", "w:gz") as t:
        for name, text in (("cora/cora.content", "p3\t0\tNets\np1\t1\tArt\np2\t0\tNets\n"), ("cora/cora.cites", "p1\tp3\np3\tp1\np2\tp2\np9\tp1\n")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    edges, nodes, labels = registry.load(spark, "Yale4", str(tmp_path))
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (0, 2), (1, 2)] and nodes.count() == 4 and labels is None
    edges, nodes, labels = registry.load(spark, "cora", str(tmp_path))
    assert sorted(map(tuple, edges.collect())) == [(0, 1)] and {r.id: r.comm for r in labels.collect()} == {0: 1, 1: 0, 2: 1}
    edges, nodes, labels = registry.load(spark, "dolphins", str(tmp_path))
    comm = {r.id: r.comm for r in labels.collect()}
    assert edges.count() == 21 and len({comm[i] for i in range(5)}) == 1 and comm[0] != comm[9]
    for name in ("nonsense", "polblogs"):
        with pytest.raises(ValueError):
            registry.load(spark, name, str(tmp_path))
    assert registry.lookup("dblp", "x").path == "x/com-DBLP.txt.gz" and registry.has_labels("dblp") and not registry.has_labels("jazz")
    assert len(registry.FACEBOOK) == len(set(registry.FACEBOOK)) == 82


def test_p_value_and_tables(spark):
    from thicket.operators.summaries import correlation_p, mean_std, pearson
    from thicket.sources import sinks

    assert abs(correlation_p(0.576, 12) - 0.05) < 1e-3 and correlation_p(0.0, 9) == 1.0 and correlation_p(1.0, 9) == 0.0 and correlation_p(0.5, 2) is None
    rows = spark.createDataFrame([(a, b, float(a * b + a)) for a in range(4) for b in "xyz" for b in (ord(b) - 119,)], "a long, b long, v double")
    one = pearson(rows, "a", "v").first()
    assert one.r > 0.5 and 0 < one.p < 0.05 and one.n == 12
    assert pearson(rows.filter("a = 1 AND b = 1"), "a", "v").first()[:2] == (None, None)
    table = sinks.wide_latex(mean_std(rows, ["a", "b"], ["v"]).filter("a + b < 6"), "a", "b", "v", "x_y")
    assert table.count("&") == 3 * 5 and "--" in table and r"x\_y" in table
    with pytest.raises(ValueError):
        sinks.latex_table(spark.range(1001).selectExpr("id", "id AS v_mean", "id AS v_std"), "id", ["v"], "c")


def test_gml_in_parts(spark, tmp_path):
    """A graph is written by as many tasks as it lies in, read in the order of the parts' names, and cut anywhere."""
    edges = spark.range(0, 200, 1, 4).selectExpr("id AS src", "id + 200 AS dst")
    nodes = spark.range(0, 400, 1, 3).selectExpr("id", "id % 7 AS value")
    path = str(tmp_path / "gml")
    sinks.write_gml(edges, nodes, path)
    parts = sorted((tmp_path / "gml").glob("part-*"))
    assert len(parts) > 5
    text = "".join(p.read_text() for p in parts)
    assert text.startswith("graph [") and text.rstrip().endswith("]") and text.count("edge [") == 200
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        found, labels = files.read_gml(spark, path)
        assert pairs(found) == [(i, i + 200) for i in range(200)]
        assert {r.id: r.comm for r in labels.collect()} == {i: i % 7 for i in range(400)}
        numbers = files._numbered_lines(spark, path)
        assert [r.line for r in numbers.orderBy("line_no").collect()] == text.splitlines() and numbers.agg(F.max("line_no")).first()[0] == text.count("\n") - 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_gml_moves_cut_blocks_only(spark, tmp_path, monkeypatch):
    """Splits cut blocks anywhere; what lies in one split is not sent, and tokens are not written one by one."""
    f = tmp_path / "g.gml"
    f.write_text("graph [ directed 0\n" + "".join(f'node\n[\nid {i} value\n"{i % 3}" graphics [ x 1 id 9 ] id 7 ]\n# node [ id 5 ]\n' for i in range(60)) + "edge [ source 0\ntarget 1 ] [ id 3 ] ]\n")
    names = []
    monkeypatch.setattr(files, "stored", lambda df, name="t", g=files.stored: names.append(name) or g(df, name))
    expected = {(i, i % 3) for i in range(60)}
    for size in ("250b", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            edges, labels = files.read_gml(spark, str(f))
            assert {tuple(r) for r in labels.collect()} == expected and labels.count() == 60 and pairs(edges) == [(0, 1)]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert set(names) == {"pieces"}
