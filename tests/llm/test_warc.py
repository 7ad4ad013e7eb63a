import hashlib
import gzip
from pathlib import Path

import pytest

from thicket.llm import warc

BIG = "x" * 1200


def rows():
    out = [(1, "http://a/", BIG), (2, "http://b/?q=é x", BIG), (7, None, BIG), (3, "http://c/", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "n", BIG), (8, "u", "é" * 600), (9, "u", "é" * 600), (10, "u", "\r\n\r\n" * 400), (11, "u", "y" * 999), (12, "u", "y" * 999)]
    return out + [(20, "a", "dup" * 500), (20, "b", "dup" * 500), (None, "m", "only null" * 200), (None, "k", "only null" * 200)]


def frame(spark, some):
    return spark.createDataFrame([(*r, "x", 1) for r in some], "page_id long, url string, html string, digest string, kind int")


def brute(some):
    groups = {}
    for p, u, h in some:
        data = (h or "").encode()
        if len(data) >= 1000:
            groups.setdefault(data, []).append((p is not None, p or 0, u or ""))
    out = []
    for p, u, h in some:
        data = (h or "").encode()
        refers, kind = None, "response"
        if data in groups:
            top = max(x[:2] for x in groups[data])
            first = min(x for x in groups[data] if x[:2] == top)
            if (p is not None, p or 0, u or "") != first:
                kind, refers = "revisit", top[1] if top[0] else None
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), kind, refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("roll", [1 << 20, 400])
def test_read_back(spark, tmp_path, roll):
    folder = str(tmp_path / "w")
    manifest = warc.write_warc(frame(spark, rows()), folder, shards=3, roll_bytes=roll).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, folder).collect()), key=str)
    assert got == brute(rows())
    assert sum(m.records for m in manifest) == len(rows())
    assert not [p for p in Path(folder).iterdir() if "_temporary" in p.name]
    for m in manifest:
        data = (Path(folder) / m.file).read_bytes()
        assert len(data) == m.bytes and hashlib.sha256(data).hexdigest() == m.sha256 and gzip.decompress(data).count(b"WARC/1.1\r\n") == m.records
        assert m.records == 1 or m.bytes <= roll
    again = str(tmp_path / "v")
    assert sorted(map(str, warc.write_warc(frame(spark, rows()), again, shards=3, roll_bytes=roll).collect())) == sorted(map(str, manifest))


def test_same_files_however_partitioned(spark, tmp_path):
    """Equal manifests, with digests, from two plans over the same rows; shards are about as large as each other."""
    some = [(i * i % 9973 if i % 7 else 1 << 40 | i, f"http://h{i % 11}/{i}", f"page {i % 500} " * (20 + i % 300)) for i in range(1500)]
    folders = [str(tmp_path / x) for x in "ab"]
    one = warc.write_warc(frame(spark, some), folders[0], shards=5).collect()
    two = warc.write_warc(frame(spark, some[::-1]).repartition(7), folders[1], shards=5).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    by_shard = {m.shard: m.records for m in one}
    assert set(by_shard) == set(range(5)) and sum(by_shard.values()) == len(some)
    got = sorted(((r.page_id, r.payload_digest, r.record_type) for r in warc.read_warc(spark, folders[0]).collect()), key=str)
    assert got == sorted(((b[0], b[2], b[3]) for b in brute(some)), key=str)


def test_shards_of_crowded_ids(spark):
    """Ids that lie close together, far from the others, are still parted."""
    ids = [i for i in range(600)] + [-(1 << 62), (1 << 62), None]
    df = spark.createDataFrame([(i, 10) for i in ids], "page_id long, bytes long")
    got = {r.page_id: r.shard for r in warc._with_shards(df, df, 6).collect()}
    by_id = [got[i] for i in sorted(i for i in ids if i is not None)]
    assert by_id == sorted(by_id) and max(by_id.count(x) for x in set(by_id)) <= 130 and got[None] == 0


def test_attempts_that_are_lost(spark, tmp_path):
    """A task that dies after its first file leaves nothing that counts; renaming may be done twice."""
    import pyarrow as pa

    folder = str(tmp_path / "w")
    (tmp_path / "w" / "_temporary").mkdir(parents=True)
    columns = {"shard": [0] * 4, "page_id": [1, 2, 3, 4], "kind": [1] * 4, "url": ["u"] * 4, "html": ["a" * 900, "b" * 900, "c" * 900, "d" * 900], "digest": [None] * 4, "winner": [None] * 4}
    types = {"shard": pa.int32(), "page_id": pa.int64(), "kind": pa.int32(), "digest": pa.string(), "winner": pa.int64()}
    batch = pa.record_batch([pa.array(v, types.get(k, pa.string())) for k, v in columns.items()], names=list(columns))

    def dies():
        yield batch
        raise OSError("lost")

    with pytest.raises(OSError):
        list(warc._write(dies(), f"file://{folder}", 500))
    assert list((Path(folder) / "_temporary").iterdir()) and not list(Path(folder).glob("part-*"))
    (done,) = warc._write(iter([batch]), f"file://{folder}", 500)
    for _ in range(2):
        list(warc._commit(iter([done]), f"file://{folder}"))
    for m in done.to_pylist():
        assert hashlib.sha256((Path(folder) / m["file"]).read_bytes()).hexdigest() == m["sha256"]
    with pytest.raises(FileNotFoundError):
        (Path(folder) / done.to_pylist()[0]["file"]).unlink()
        list(warc._commit(iter([done]), f"file://{folder}"))


def test_damage():
    data = warc.record(1, "u", b"hello", None, False)
    assert warc.parse(data)[0] == 1
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"hello", b"hallo"))


def test_empty(spark):
    assert warc.archived(frame(spark, [])).collect() == []
