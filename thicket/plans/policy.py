"""Time limits for trials: a job group is cancelled when its time is up."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


def spectral_limit(longest_score_seconds: float | None) -> int:
    """Seconds that a spectral trial may take: ten times the longest score sampling, 30 at least; 300 before any is known."""
    return 300 if longest_score_seconds is None else max(30, int(10 * longest_score_seconds))


def limited(spark: SparkSession, seconds: float, f: Callable[[], T]) -> T | None:
    """What f returns, or None if its Spark jobs ran longer than that and were cancelled; other errors are raised."""
    group, late = f"limited-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, "a trial with a time limit", interruptOnCancel=True)
    timer.start()
    try:
        return f()
    except Exception:
        if late.is_set():
            return None
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
