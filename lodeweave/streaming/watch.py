"""An index that follows a folder, and running states over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeweave.operators.store import Store
from lodeweave.session import dropped, stored
from lodeweave.streaming import listing


def follow(docs: DataFrame, store: Store, checkpoint: str, once: bool = True, every: str = "5 seconds") -> StreamingQuery:
    """Takes a stream of documents (doc_path, text, checksum) up into store, batch by batch.

    A batch that runs again after a failure changes nothing, as its checksums are known. Files that vanish are
    no events of Spark's file source: mirror() follows a stream that has them.
    """

    def take(batch: DataFrame, _: int) -> None:
        store.add(batch)

    writer = docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def mirror(changes: DataFrame, store: Store, checkpoint: str, once: bool = True, every: str = "5 seconds") -> StreamingQuery:
    """Makes store follow a folder's stream of changes (listing.changes): files written again are taken up anew, files that are gone are forgotten.

    Each batch is one commit of the store. A batch that runs again after a failure changes nothing.
    """

    def take(batch: DataFrame, _: int) -> None:
        fresh = stored(batch, "changes")
        store.add(fresh.filter(F.col("state") == listing.UPSERT), gone=fresh.filter(F.col("state") == listing.GONE))
        dropped(fresh)

    writer = changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def usage(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", at: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """(start, by, n, total): uses a window of time and kind; events that come later than late after the newest are out."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    counts = timed.groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total"))
    return counts.select(F.col("w.start").alias("start"), by, "n", "total")
