"""Grids of trials as runs: trials side by side, each in a job group and a scheduler pool of its own, under time limits that are learnt
on the way, with a ledger from which a run goes on where it stopped."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import append_trials, committed, log_batch, run_log
from .policy import limited, spectral_limit

Trial = tuple[str, dict]


class Limits:
    """Seconds that a trial may take.  A spectral trial gets ten times the longest score sampling known by then (``spectral_limit``);
    others get ``others``."""

    def __init__(self, others: float = 3600.0):
        self.others, self.longest, self._lock = others, None, threading.Lock()

    def of(self, arguments: dict) -> float:
        with self._lock:
            return float(spectral_limit(self.longest)) if arguments.get("method") == "spectral" else self.others

    def took(self, arguments: dict, seconds: float) -> None:
        if arguments.get("method") != "spectral":
            with self._lock:
                self.longest = max(self.longest or 0.0, seconds)


def key_of(trial: Trial) -> str:
    """A trial's name in the ledger, the same for the same dataset and arguments."""
    dataset, arguments = trial
    return ",".join([dataset, *(f"{k}={json.dumps(arguments[k])}" for k in sorted(arguments))]).replace("/", "_")


def run_trials(spark: SparkSession, f: Callable[..., dict], trials: Iterable[Trial], ledger: str, schema: str, workers: int = 4, limits: Limits | None = None) -> DataFrame:
    """The rows f(dataset, **arguments) of all trials that are done, (schema..., dataset, batch), from this run and earlier ones of the
    same ledger, a folder that driver and executors share.

    Trials that the ledger calls done aren't run again; what failed, was late or was cut off is.  ``workers`` trials run at a time,
    spectral ones after the others, so that their limit is known.  A trial that takes too long is cancelled and logged as late; one
    that raises ValueError or can't read its tables is logged as failed; neither gives a row.  Other errors end the run once the
    trials that have begun are over; the ledger keeps what is done.
    """
    limits = limits or Limits()
    done = {r["batch"] for r in run_log(spark, ledger).filter("state = 'done'").select("batch").collect()}  # a name a trial of the grid
    wanted = {key_of(t): t for t in trials}
    rest = [t for k, t in wanted.items() if k not in done]
    columns = [c.split()[0] for c in schema.split(",")]
    lock = threading.Lock()

    def one(trial: Trial) -> None:
        dataset, arguments = trial
        key, began = key_of(trial), time.perf_counter()
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{threading.get_ident() % workers}")
        try:
            row = limited(spark, limits.of(arguments), lambda: f(dataset, **arguments))
            seconds = time.perf_counter() - began
            state, message = ("done", "") if row is not None else ("late", f"more than {limits.of(arguments):g} s")
        except (ValueError, AnalysisException) as e:
            row, seconds, state, message = None, time.perf_counter() - began, "failed", str(e)[:500]
        with lock:  # commits to one table don't meet
            if row is not None:
                limits.took(arguments, seconds)
                append_trials(spark.createDataFrame([tuple(row[c] for c in columns) + (dataset,)], f"{schema}, dataset string"), ledger, key)
            log_batch(spark, ledger, key, dataset, state, int(row is not None), seconds, message)

    for spectral in (False, True):
        some = [t for t in rest if (t[1].get("method") == "spectral") == spectral]
        with ThreadPoolExecutor(max(1, min(workers, len(some)))) as pool:
            for future in [pool.submit(inheritable_thread_target(spark)(one), t) for t in some]:
                future.result()
    return committed(spark, ledger, schema)
