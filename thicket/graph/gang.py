"""Tasks of one stage that run side by side, hold what they work on, and send each other rows through the shared folder.

A round of a chain of Spark jobs takes seconds, however little is done in it.  Where all tasks of a stage can run at once (barrier
execution), they go through all rounds of an algorithm within that stage: what a task sends another one is a file, which its
receiver deletes.
"""

from __future__ import annotations

import pickle
import time
import uuid
from collections.abc import Iterable

import pyarrow.fs as pafs
from pyspark import BarrierTaskContext
from pyspark.sql import SparkSession

#: Seconds after which a task that waits for another one fails, and the stage with it.
PATIENCE = 3600
#: Ends of edges that a task keeps between steps.
HELD = 1 << 24

def places(spark: SparkSession) -> int:
    """How many tasks can run side by side; 0 where executors come and go, since Spark has no barriers there."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    sc = spark.sparkContext._jsc.sc()
    return int(sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))


class Gang:
    """The tasks of a stage as one of them sees them; folder is a URI that all of them can write to."""

    def __init__(self, folder: str):
        context = BarrierTaskContext.get()
        self.number, self.size, self.step = context.partitionId(), len(context.getTaskInfos()), 0
        # an attempt of the stage has a folder of its own; Spark's own messages take a second each, so there are no more of them
        name = context.allGather(uuid.uuid4().hex if self.number == 0 else "")[0]
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.folder = f"{base}/{name}"
        self.fs.create_dir(self.folder)

    def _sent(self, to: int, thing: object) -> None:
        path = f"{self.folder}/{self.step}-{self.number}-{to}"
        with self.fs.open_output_stream(f"{path}.part") as f:
            pickle.dump(thing, f, protocol=5)
        self.fs.move(f"{path}.part", path)  # what has its name is whole

    def _received(self, sender: int) -> object:
        path, pause, since = f"{self.folder}/{self.step}-{sender}-{self.number}", 0.001, time.monotonic()
        while self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            if time.monotonic() - since > PATIENCE:
                raise RuntimeError(f"task {sender} has sent nothing in {PATIENCE} s")
            time.sleep(pause)
            pause = min(0.05, pause * 1.3)
        with self.fs.open_input_file(path) as f:
            thing = pickle.loads(f.readall())
        self.fs.delete_file(path)
        return thing

    def swapped(self, things: dict[int, object]) -> list:
        """A thing to each task, None where there is none; what all tasks, in their order, have sent to this one."""
        self.step += 1
        others = [(self.number + k) % self.size for k in range(1, self.size)]
        for to in others:
            self._sent(to, things.get(to))
        came = {sender: self._received(sender) for sender in others}
        came[self.number] = things.get(self.number)
        return [came[n] for n in range(self.size)]

    def all_told(self, word: object) -> list:
        """The words of all tasks, in their order."""
        return self.swapped(dict.fromkeys(range(self.size), word))


def shared(numbers: Iterable[int], gang: Gang) -> list[int]:
    """Those of the numbers that this task holds."""
    return [n for n in numbers if n % gang.size == gang.number]
