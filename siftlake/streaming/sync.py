"""Syncing a folder of scan listings as a stream.

Listings arrive as files; every micro-batch is compared with the store and the differences are committed as one version of
it. A batch that is run again after a failure finds its documents unchanged in the store and commits nothing. Repeated rows
can be dropped within a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LISTING = "collection_id long, path string, title string, content string, content_hash string, mtime double, line_count int, seen_at timestamp"


def listings(spark: SparkSession, folder: str, schema: str = LISTING, most_files: int = 1000) -> DataFrame:
    """The parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def newest(rows: DataFrame) -> DataFrame:
    """One row per document of a batch, the latest seen."""
    return rows.filter("path IS NOT NULL").groupBy("collection_id", "path").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("collection_id", "path")]), "seen_at").alias("r")).select("collection_id", "path", "r.*")


def upsert_batches(store) -> Callable[[DataFrame, int], None]:
    """What a stream does with each batch: new and changed documents are upserted, others left. Listings of a stream are never whole, so none is deleted."""
    from siftlake.operators.sync import sync_actions

    def run(rows: DataFrame, number: int) -> None:
        rows = newest(rows)
        actions = sync_actions(rows, store.read("documents"), failed=True).filter(F.col("action").isin("insert", "update"))
        changed = rows.join(actions.select("collection_id", "path"), ["collection_id", "path"])
        if not changed.isEmpty():
            store.upsert(changed)

    return run


def start(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Run a stream every so many seconds, or once over what there is; offsets are kept below `checkpoint`."""
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{max(seconds, 60)} seconds") if seconds else writer.trigger(availableNow=True)).start()


def unrepeated(stream: DataFrame, keys: list[str], at: str = "seen_at", delay: str = "7 days") -> DataFrame:
    """The first of repeated rows of a stream; rows later than `delay` are dropped, so that the state stays bounded."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
