"""Deterministic sharded WARC writer and reader (operator 5).

Records are range-sorted by page_id and written by one task per range into gzip files (a member per record) that roll
over by compressed size.  The ranges' borders come from exact counts of bytes, so they are the same however the input is
partitioned.  Headers and digests are computed anew.  Tasks write under temporary names that no other attempt shares; when
all are done, the files of the attempts that counted are renamed, then the manifest is, and what is left over is deleted.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import qualified, shared_folder, stored
from .exchange import partitions

#: A fixed date keeps reruns equal byte for byte.
DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 64 << 20
#: Smaller payloads are never revisits.
LEAST_REVISIT = 1000
#: Ranges of ids that bytes are counted in, and parts that a range is cut into if it holds more than a shard's share.
BIN_BITS, PART_BITS = 14, 6
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "file string, shard int, roll int, records long, bytes long, sha256 string"
_TEMPORARY = "_temporary"


def _id(page_id: int | None, no: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page/{page_id}/{no}')}>"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def _clean(url: str | None) -> str:
    """A URL as a header's value: control characters are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, no: int = 0) -> bytes:
    """One uncompressed record.  Of a revisit only the HTTP header is kept; its digest and length are the full payload's."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _id(page_id, no)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _id(refers_to, 0)), ("X-Refers-To-Page", "" if refers_to is None else str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


class _Roller:
    """The files of one shard."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int, limit: int):
        self.fs, self.folder = fs, folder
        self.shard, self.limit, self.roll, self.out, self.rows = shard, limit, 0, None, []

    def write(self, member: bytes) -> None:
        if self.out is not None and self.size + len(member) > self.limit:
            self.close()
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.roll:05d}.warc.gz"
            self.temporary = f"{uuid.uuid4().hex}-{self.name}"
            self.out = self.fs.open_output_stream(f"{self.folder}/{_TEMPORARY}/{self.temporary}", compression=None)
            self.size, self.records, self.digest = 0, 0, hashlib.sha256()
        self.out.write(member)
        self.digest.update(member)
        self.size, self.records = self.size + len(member), self.records + 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.name, self.shard, self.roll, self.records, self.size, self.digest.hexdigest(), self.temporary))
            self.out, self.roll = None, self.roll + 1


def _write(batches: Iterable[pa.RecordBatch], folder: str, limit: int) -> Iterator[pa.RecordBatch]:
    fs, base = pafs.FileSystem.from_uri(folder)
    roller: _Roller | None = None
    current, begun, refs, done, no = None, False, {}, set(), 0

    def rows_of(roller: _Roller) -> pa.RecordBatch:
        roller.close()
        columns = list(zip(*roller.rows, strict=True)) or [()] * 7
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "shard", "roll", "records", "bytes", "sha256", "temporary"])

    for batch in batches:
        urls, payloads = batch.column("url"), batch.column("html").cast(pa.binary())
        shards, pages, kinds, keys, winners = (batch.column(c).to_pylist() for c in ("shard", "page_id", "kind", "digest", "winner"))
        for i in range(batch.num_rows):
            if roller is None or shards[i] != roller.shard:
                if roller is not None:
                    yield rows_of(roller)
                roller = _Roller(fs, base, shards[i], limit)
            if not begun or pages[i] != current:
                current, begun, refs, done, no = pages[i], True, {}, set(), 0
            if kinds[i] == 0:
                refs[keys[i]] = winners[i]
                continue
            payload = payloads[i].as_py() or b""
            refers, revisit = None, False
            if len(payload) >= LEAST_REVISIT:
                key = hashlib.sha1(payload).hexdigest()
                if revisit := key in refs or key in done:
                    refers = refs.get(key, current)
                done.add(key)
            roller.write(zlib.compress(record(current, urls[i].as_py(), payload, refers, revisit, no), 6, 31))
            no += 1
    if roller is not None:
        yield rows_of(roller)


def _commit(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Gives files their names; a file that an earlier attempt of this task has renamed stays."""
    fs, base = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for name, temporary in zip(batch.column("file").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
            old, new = f"{base}/{_TEMPORARY}/{temporary}", f"{base}/{name}"
            there = fs.get_file_info([old, new])
            if there[0].type == pafs.FileType.File:
                if there[1].type == pafs.FileType.File:
                    fs.delete_file(new)
                fs.move(old, new)
            elif there[1].type != pafs.FileType.File:
                raise FileNotFoundError(old)
        yield pa.RecordBatch.from_arrays([batch.column("file")], names=["file"])


def _with_shards(rows: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """rows(page_id, ...) with ``shard``: ranges of page_id with about as many bytes of sizes(page_id, bytes) each.

    Bytes are summed in ranges of ids, 2^BIN_BITS at most, and ranges that hold more than a shard's share again in parts of
    them.  Ids that differ in their last bit only are in one shard; a null id is in the first.
    """
    spark = rows.sparkSession
    half = F.shiftright("page_id", 1)
    low, high, total = sizes.agg(F.min(half), F.max(half), F.sum("bytes")).first()
    if low is None:
        return rows.withColumn("shard", F.lit(0))
    top = bits = max(0, (high - low).bit_length() - BIN_BITS)
    share = max(1, total // shards)
    known = sizes.filter("page_id IS NOT NULL").select((half - F.lit(low)).alias("at"), "bytes")

    def counted(df: DataFrame, shift: int) -> list[tuple[int, int, int]]:
        return [(r["bin"] << shift, shift, r["bytes"]) for r in df.groupBy(F.shiftright("at", shift).alias("bin")).agg(F.sum("bytes").alias("bytes")).collect()]

    ranges, large = [], counted(known, bits)
    while True:
        ranges += [x for x in large if x[2] <= share or not x[1]]
        large = [x for x in large if x[2] > share and x[1]]  # no more than there are shards
        if not large:
            break
        marks = spark.createDataFrame([(a >> bits,) for a, _, _ in large], "mark long")
        known = known.join(F.broadcast(marks), F.shiftright("at", bits) == F.col("mark"), "left_semi")
        bits = max(0, bits - PART_BITS)
        large = counted(known, bits)
    table, before = [], 0
    for a, shift, size in sorted(ranges):
        table.append((a >> top, a, a + (1 << shift), min(shards - 1, before * shards // total)))
        before += size
    told = spark.createDataFrame(table, "_bin long, _from long, _to long, shard int")
    at = half - F.lit(low)
    placed = rows.withColumn("_at", at).join(F.broadcast(told), (F.shiftright("_at", top) == F.col("_bin")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")), "left")
    return placed.select(*rows.columns, F.coalesce("shard", F.lit(0)).alias("shard"))


def _rename(spark: SparkSession, old: str, new: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(old)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).rename(path, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} can't be renamed to {new}")


def write_warc(pages: DataFrame, folder: str, shards: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record per row of pages(page_id, url, html) below folder, a URI that all executors share; returns the
    manifest: file, shard, roll, records, bytes, sha256.

    The payload is the html in UTF-8, empty for null.  Of records with equal payloads of LEAST_REVISIT bytes or more the
    one with the largest page_id is a response and the others revisit it; if that page_id is repeated, the first of its
    rows by url is.  A null page_id counts as the smallest.  The same rows give the same files, however they are partitioned.
    All rows of one page_id are written by one task; a record is held in memory whole.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keys = rows.filter(F.octet_length("html") >= LEAST_REVISIT).select("page_id", F.sha1("html").alias("digest"))
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1")
    refs = keys.join(groups, "digest").filter("page_id IS NULL AND winner IS NOT NULL OR page_id < winner").select("page_id", "digest", "winner").distinct()
    every = rows.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("winner")).unionByName(
        refs.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "winner")
    )
    shards = shards or partitions(spark)
    sizes = stored(rows.select("page_id", (F.coalesce(F.octet_length("html"), F.lit(0)) + F.lit(500)).cast("long").alias("bytes")), "sizes")
    placed = _with_shards(every, sizes, shards).repartitionById(shards, "shard")
    ordered = placed.sortWithinPartitions("shard", "page_id", "kind", "url", "digest", F.xxhash64("html"))
    uri = qualified(spark, folder)
    qualified(spark, f"{folder}/{_TEMPORARY}")
    ordered.mapInArrow(partial(_write, folder=uri, limit=roll_bytes), f"{MANIFEST}, temporary string").write.parquet(f"{folder}/_temporary-manifest")
    files = spark.read.parquet(f"{folder}/_temporary-manifest")
    files.repartition(partitions(spark), "file").mapInArrow(partial(_commit, folder=uri), "file string").write.format("noop").mode("overwrite").save()
    _rename(spark, f"{folder}/_temporary-manifest", f"{folder}/manifest")
    left = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_TEMPORARY}")
    left.getFileSystem(spark._jsc.hadoopConfiguration()).delete(left, True)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records_of(stream) -> Iterator[bytes]:
    """The members of a gzip stream, one at a time."""
    rest = b""
    while True:
        if not rest and not (rest := stream.read(1 << 20)):
            return
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not rest and not (rest := stream.read(1 << 20)):
                raise ValueError("a record ends early")
            parts.append(member.decompress(rest))
            rest = member.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> tuple[int | None, str, int, str, str, int | None]:
    """(page_id, url, payload bytes, digest in hex, type, page that it refers to); checks lengths and digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or _sha1(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and (_sha1(payload) != fields["WARC-Payload-Digest"] or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"payload of record {fields['WARC-Record-ID']} is damaged")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return number("X-Page-ID"), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], number("X-Refers-To-Page")


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = pafs.FileSystem.from_uri(folder)
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in _READ.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, types, strict=True)], names=names)

    for batch in batches:
        for name in batch.column("file").to_pylist():
            rows = []
            with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for data in records_of(stream):
                    rows.append(parse(data))
                    if len(rows) >= 4096:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the files in folder's manifest, checked: page_id, url, payload_bytes, payload_digest (hex SHA-1),
    record_type, refers_to."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file")
    uri = qualified(spark, folder)
    return files.repartition(partitions(spark), "file").mapInArrow(partial(_read, folder=uri), _READ)


def archived(pages: DataFrame) -> DataFrame:
    """pages written to the shared folder and read back."""
    folder = f"{shared_folder(pages.sparkSession)}/warc"
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder)
