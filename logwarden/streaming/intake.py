"""A bounded intake before the stream: events are taken until it is full, and flushed as files that the stream reads."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

#: Events, and seconds, after which what came is flushed, and the most events that wait.
FLUSH_EVENTS, FLUSH_SECONDS, CAPACITY = 500, 5.0, 100_000


class IntakeFull(RuntimeError):
    """Raised when not all events were taken; accepted of offered were."""

    def __init__(self, accepted: int, offered: int) -> None:
        super().__init__(f"{accepted} of {offered} events were taken")
        self.accepted, self.offered = accepted, offered


class Intake:
    """Events wait here until there are enough of them, or the oldest has waited long enough; then each source's are a file of lines in the stream's folder."""

    def __init__(self, spark: SparkSession, folder: str, events: int = FLUSH_EVENTS, seconds: float = FLUSH_SECONDS, capacity: int = CAPACITY, clock=time.monotonic) -> None:
        self.spark, self.folder, self.events, self.seconds, self.capacity, self.clock = spark, folder.rstrip("/"), events, seconds, capacity, clock
        self._waiting: list[tuple[str, str]] = []
        self._since = 0.0
        self._lock = threading.Lock()

    def offer(self, events: Iterable[dict], source: str) -> int:
        """The number of events taken. Beyond the capacity, those before it are taken and IntakeFull tells how many."""
        rows = [json.dumps(e, ensure_ascii=False, default=str) for e in events]
        with self._lock:
            room = max(0, self.capacity - len(self._waiting))
            if not self._waiting:
                self._since = self.clock()
            self._waiting += [(source, r) for r in rows[:room]]
        if len(rows) > room:
            raise IntakeFull(room, len(rows))
        return len(rows)

    def due(self) -> bool:
        return len(self._waiting) >= self.events or (bool(self._waiting) and self.clock() - self._since >= self.seconds)

    def flush(self, force: bool = False) -> int:
        """Writes what waits, if it is due or with force; the number of events written. A file is whole before it has its name. If a write fails, what isn't written waits again, before what came since, and the error is raised."""
        with self._lock:
            if not (force or self.due()):
                return 0
            taken, self._waiting = self._waiting, []
        by_source: dict[str, list[str]] = {}
        for source, row in taken:
            by_source.setdefault(source, []).append(row)
        left = dict(by_source)
        try:
            for source, rows in by_source.items():
                self._write(source, rows)
                del left[source]
        except BaseException:
            with self._lock:
                self._waiting = [x for x in taken if x[0] in left] + self._waiting
            raise
        return len(taken)

    def _write(self, source: str, rows: list[str]) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        name = f"{source}.{uuid.uuid4().hex}.ndjson"
        tmp, at = hadoop.Path(f"{self.folder}/_{name}"), hadoop.Path(f"{self.folder}/{name}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = fs.create(tmp, True)
            out.write(bytearray("\n".join(rows).encode()))
            out.close()
            if not fs.rename(tmp, at):
                raise OSError(f"{name} could not be named")
        except BaseException:
            fs.delete(tmp, False)
            raise
