"""Progress of a running batch: rows are observed as they pass, a listener hears of each part."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "credalyt_progress"


class Progress(StreamingQueryListener):
    """Hears of the parts of one stream while it runs: (part, rows, failed, heard_at), one row a part."""

    def __init__(self, total: int | None = None, tell: Callable[[dict], None] | None = None):
        self.total, self.tell = total, tell
        self.parts: list[dict] = []
        self.ended = threading.Event()
        self.run_id: str | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(NAME)
        if seen is None or not seen["n"] or (self.run_id and str(event.progress.runId) != self.run_id):
            return
        done = sum(p["n_rows"] for p in self.parts) + seen["n"]
        part = {"part": int(event.progress.batchId), "n_rows": int(seen["n"]), "n_failed": int(seen["failed"]), "n_done": int(done), "percent": round(100.0 * done / self.total, 1) if self.total else None, "heard_at": event.progress.timestamp, "while_running": not self.ended.is_set()}
        self.parts.append(part)
        if self.tell:
            self.tell(part)

    def onQueryTerminated(self, event) -> None:
        if not self.run_id or str(event.runId) == self.run_id:
            self.ended.set()


def run_observed(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], failed: Column, total: int | None = None, tell: Callable[[dict], None] | None = None, wait: float = 60.0) -> DataFrame:
    """Process what is there in parts, with ``tell`` called for each part as it ends.

    Gives (part, n_rows, n_failed, n_done, percent, heard_at, while_running), one row a part."""
    spark = stream.sparkSession
    listener = Progress(total, tell)
    spark.streams.addListener(listener)
    try:
        observed = stream.observe(NAME, F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed"))
        query = observed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
        listener.run_id = str(query.runId)
        query.awaitTermination()
        listener.ended.wait(wait)
    finally:
        spark.streams.removeListener(listener)
    schema = "part long, n_rows long, n_failed long, n_done long, percent double, heard_at string, while_running boolean"
    return spark.createDataFrame([tuple(p[f.split()[0]] for f in schema.split(", ")) for p in listener.parts], schema)
