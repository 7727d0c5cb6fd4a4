"""Events that come late and more than once: state that ends with the watermark, and what each batch says of its lag.

A run takes what has arrived since the last one and ends; the next goes on from the checkpoint, with the state and the watermark as they
were. An event counts once, whatever comes again within the watermark; one that comes after it is dropped, and counted as such. What a batch
lets through is written under its number, so a batch that is replayed writes the same again.
"""

from __future__ import annotations

import json
from datetime import datetime

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from marlstone.sources.blobs import opened
from marlstone.sources.store import collected

PROGRESS = "batch long, rows long, late long, held long, watermark timestamp, newest timestamp, lag_seconds double"


def said(p) -> tuple:
    """batch, rows, rows dropped as late, keys held in state, watermark, newest event and seconds between both, of a batch's progress."""
    p = json.loads(p.json) if hasattr(p, "json") else p
    time = p.get("eventTime") or {}
    at = lambda k: datetime.fromisoformat(time[k].replace("Z", "+00:00")) if k in time else None
    state = p.get("stateOperators") or [{}]
    mark, newest = at("watermark"), at("max")
    mark = mark if mark and mark.timestamp() else None  # none yet
    return p["batchId"], p["numInputRows"], sum(s.get("numRowsDroppedByWatermark", 0) for s in state), sum(s.get("numRowsTotal", 0) for s in state), mark, newest, (newest - mark).total_seconds() if mark and newest else None


class Lag(StreamingQueryListener):
    """Writes a line for each batch of a query to ``path``: what was late, what is held, how far the watermark lies behind."""

    def __init__(self, path: str):
        self.path = path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = said(event.progress)
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{event.progress.runId}-{row[0]}.json") as f:
            f.write(json.dumps(dict(zip(("batch", "rows", "late", "held", "watermark", "newest", "lag_seconds"), row)), default=str).encode())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def deduplicated(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """``events`` with a time, each key once: what comes again within ``delay`` is dropped, and so is what comes later than that."""
    return events.where(F.col(time).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def take(events: DataFrame, out: str, key: str, time: str, delay: str) -> list[tuple]:
    """One run: all that arrived into the table at ``out``; the progress of its batches that had rows."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")

    q = deduplicated(events, key, time, delay).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(write).start()
    q.awaitTermination()
    return [x for x in map(said, q.recentProgress) if x[1]]


def taken(spark: SparkSession, out: str, shape) -> DataFrame:
    """What all runs let through."""
    fs, root = opened(out)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/rows", allow_not_found=True))
    folders = [f"{out}/rows/{f.base_name}" for f in found if f.base_name.startswith("batch=")]
    return spark.read.schema(shape).parquet(*folders) if folders else spark.createDataFrame([], shape)


def replayed(events: DataFrame, out: str, key: str, time: str, arrived: str, delay: str = "24 hours") -> tuple[DataFrame, DataFrame]:
    """``events`` as they arrived, a run for each month: what was let through, and the progress of each run."""
    spark = events.sparkSession
    month = F.date_format(arrived, "yyyy-MM")
    progress = []
    for r in collected(events.select(month.alias("m")).distinct().orderBy("m")):
        events.where(month.eqNullSafe(F.lit(r["m"]))).write.mode("append").parquet(f"{out}/in")
        progress += take(spark.readStream.schema(events.schema).parquet(f"{out}/in"), out, key, time, delay)
    return taken(spark, out, events.schema), spark.createDataFrame(progress, PROGRESS)
