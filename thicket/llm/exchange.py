"""Moving arrays of 64-bit records between tasks as a few binary rows instead of one row a record.

``scatter`` cuts an array of records by bucket and yields Arrow batches of (bucket, blob); ``shuffled`` brings each
bucket to one partition, in order of the buckets; ``gathers`` gives a partition's records back, bucket by bucket.  There are
as many buckets as keep one of them small (``buckets_for``), whatever the number of shuffle partitions is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import U64, mix

PACKED = "bucket int, blob binary"
#: Bytes of input that a bucket's records come from.
BUCKET_BYTES = 32 << 20
#: Buckets in a partition, at most, and where Spark doesn't know a size.
MOST_BUCKETS, UNKNOWN = 256, 4
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scatter(records: np.ndarray, buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of (bucket, blob); records is (n, width) of uint64, buckets the bucket of each record."""
    if not len(records):
        return
    order = np.argsort(buckets, kind="stable")
    records, buckets = np.ascontiguousarray(records[order]), buckets[order]
    at = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    ends = np.r_[at[1:], len(buckets)]
    blobs = [records[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(buckets[at].astype(np.int32)), pa.array(blobs, pa.binary())], schema=_PACKED_ARROW)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(np.asarray(keys).view(U64)) % U64(n)).astype(np.int64)


def buckets_for(df: DataFrame) -> int:
    """Buckets for records of df's rows: a multiple of the shuffle partitions, by the size that Spark expects of df."""
    n = partitions(df.sparkSession)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n * (UNKNOWN if size >= 1 << 60 else max(1, min(MOST_BUCKETS, -(-size // (n * BUCKET_BYTES)))))


def shuffled(df: DataFrame) -> DataFrame:
    """Each bucket in one partition, buckets in order."""
    n = partitions(df.sparkSession)
    return df.repartitionById(n, F.pmod("bucket", F.lit(n))).sortWithinPartitions("bucket")


def returned() -> None:
    """Gives memory that is free, but still held by this worker, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def gathers(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The records of each bucket of a partition as (n, width) of uint64."""
    now, parts = None, []

    def whole() -> np.ndarray:
        joined = b"".join(parts)
        parts.clear()
        return np.frombuffer(joined, U64).reshape(-1, width)

    for batch in batches:
        blobs = batch.column("blob")
        for i, bucket in enumerate(batch.column("bucket").to_pylist()):
            if bucket != now and parts:
                yield whole()
            now = bucket
            parts.append(blobs[i].as_buffer())
    if parts:
        yield whole()
    returned()


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal values in sorted keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return at, np.r_[at[1:], len(keys)]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
