"""Following a folder or a table of change events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import EXTENSIONS, extension, hidden
from ..sources.files import _PARSED, _parse


def sessions(events: DataFrame, key: str, gap: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """key, start, fire_at, n of each burst of events: a burst ends, and would fire, once a key was quiet for the gap.
    Batch and streaming alike; a stream needs `late`, the watermark beyond which events are dropped."""
    own = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late is not None:
        own = own.withWatermark(ts, late)
    w = F.session_window(ts, gap).alias("w")
    return own.groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("fire_at"), "n")


def file_stream(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, modified, text, error of new files below folder, as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.select(path.alias("path"), extension(path).alias("ext"), "content").filter(F.col("ext").isin(*extensions) & ~hidden(F.substring_index("path", "/", -1))).mapInArrow(_parse, _PARSED)


def watch(spark: SparkSession, folder: str, checkpoint: str, add: Callable[[DataFrame], object], *, available_now: bool = False) -> StreamingQuery:
    """Adds every file that appears; micro-batches are serial, so `add` is never run twice at once. A batch that is run again
    after a failure replaces the same documents by their ids, so the store ends the same."""
    out = file_stream(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: add(df) and None)
    return (out.trigger(availableNow=True) if available_now else out).start()
