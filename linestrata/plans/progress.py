"""Messages about how far a run is."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

log = logging.getLogger("linestrata")

#: Fixed value: seconds between two messages at level 3.
SECONDS = 5


class Progress:
    """Logs every phase when it ends; levels 2 and 3 also log the tasks that are done meanwhile.

    Level 2 has a message for every tenth of a stage, level 3 one every five seconds.
    """

    def __init__(self, spark: SparkSession, level: int, seconds: float = SECONDS):
        self.tracker = spark.sparkContext.statusTracker()
        self.level, self.seconds = level, seconds

    @contextmanager
    def phase(self, name: str) -> Iterator[dict]:
        """What is put into the dictionary is logged with the phase's name and time."""
        found: dict = {}
        began, over = time.time(), threading.Event()
        watch = threading.Thread(target=self._watch, args=(name, over), daemon=True) if self.level >= 2 else None
        if watch:
            watch.start()
        try:
            yield found
        finally:
            over.set()
            if watch:
                watch.join()
        counted = ", ".join(f"{v:,} {k}" if isinstance(v, int) else f"{k} {v}" for k, v in found.items())
        log.info("%s: %s%s", name, counted or "done", f" ({time.time() - began:.1f} s)" if self.level else "")

    def _watch(self, name: str, over: threading.Event) -> None:
        tenths: dict[int, int] = {}
        while not over.wait(self.seconds if self.level == 3 else min(self.seconds, 0.5)):
            for stage in self.tracker.getActiveStageIds():
                info = self.tracker.getStageInfo(stage)
                if info is None or not info.numTasks:
                    continue
                tenth = 10 * info.numCompletedTasks // info.numTasks
                if self.level == 3 or tenths.get(stage) != tenth:
                    tenths[stage] = tenth
                    log.info("%s: %d of %d tasks of stage %d", name, info.numCompletedTasks, info.numTasks, stage)
