"""A bounded backlog of items that are stored in the background.

Items are written as JSON lines into an inbox folder and a stream hands them, file by file, to ``MemoryEngine.process``. What is
done is counted in the store's manifest under the batch's number, so that the backlog is known after a restart and a batch
that comes again is neither counted nor stored twice. One writer at a time may add to an inbox.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from memtide.engine import MemoryEngine
from memtide.sources.store import counter, with_counter

ITEM = "pos bigint, text string, importance double"


class Full(RuntimeError):
    """The backlog has no room for the items."""


class Backlog:
    """``folder`` holds the inbox and the stream's checkpoint; ``max_pending=0`` sets no bound; ``files`` is how many puts a
    micro-batch takes at most."""

    def __init__(self, engine: MemoryEngine, folder: str, max_pending: int = 0, threshold: float = 0.95, files: int = 100) -> None:
        self.engine, self.spark, self.folder, self.max_pending, self.threshold, self.files = engine, engine.spark, folder.rstrip("/"), max_pending, threshold, files
        self._lock = threading.Lock()
        self._query: StreamingQuery | None = None
        self.spark.createDataFrame([], ITEM).write.mode("append").json(f"{self.folder}/inbox")
        self._put = self.spark.read.schema(ITEM).json(f"{self.folder}/inbox").count()

    def put(self, items: Sequence[tuple[str, float]] | Sequence[str]) -> None:
        """Texts, or texts with importances, are pending when this returns; :class:`Full` if they don't all find room."""
        rows = [(self._put + i, *(x if isinstance(x, tuple) else (x, 1.0))) for i, x in enumerate(items)]
        with self._lock:
            if self.max_pending and self.pending() + len(rows) > self.max_pending:
                raise Full(f"{self.pending()} of {self.max_pending} items are pending, {len(rows)} more were refused")
            if rows:
                self.spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").json(f"{self.folder}/inbox")
                self._put += len(rows)

    def pending(self) -> int:
        return self._put - (counter(self.engine.tables.read("counters"), "backlog_rows") or 0)

    def start(self) -> None:
        """The background stream; it goes on where an earlier one ended."""
        if not self.alive():
            items = self.spark.readStream.schema(ITEM).option("maxFilesPerTrigger", self.files).json(f"{self.folder}/inbox")
            self._query = items.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/state").start()

    def _batch(self, items: DataFrame, number: int) -> None:
        n = items.count()
        self.engine.process(items.orderBy("pos"), threshold=self.threshold)

        def counted(counters: DataFrame) -> dict[str, DataFrame]:
            last = counter(counters, "backlog_batch")
            if last is not None and last >= number:
                return {}
            return {"counters": with_counter(counters, backlog_batch=number, backlog_rows=(counter(counters, "backlog_rows") or 0) + n)}

        self.engine.tables.commit(lambda read: counted(read("counters")))

    def alive(self) -> bool:
        return self._query is not None and self._query.isActive

    def flush(self, timeout: float | None = None) -> bool:
        """Waits until nothing is pending; False if that takes longer than ``timeout`` seconds or the stream has failed."""
        if not self.alive():
            return self.pending() == 0
        worker = threading.Thread(target=self._drained, daemon=True)
        worker.start()
        worker.join(timeout)
        return not worker.is_alive() and self.pending() == 0

    def _drained(self) -> None:
        try:
            self._query.processAllAvailable()
        except Exception:  # noqa: BLE001  flush tells by what is pending
            pass

    def stop(self, timeout: float | None = None) -> bool:
        """Ends the stream; what is pending stays in the inbox. False if it still runs after ``timeout`` seconds."""
        if self._query is None:
            return True
        worker = threading.Thread(target=self._query.stop, daemon=True)
        worker.start()
        worker.join(timeout)
        return not worker.is_alive() and not self._query.isActive
