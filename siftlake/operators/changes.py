"""Handing on only new or changed records, run by run, although runs fail and rows come late.

The scan log is a change log with one partition per collection; the run number is the offset. Only runs with status
'ok' commit an offset, so a run's batch always starts after the last committed one: what a failed run handed on is
handed on again by the next run, and what a committed run stored is not. `pending_changes` states this for a whole
history as one plan. `LogConsumer` is the contract itself: offsets per partition, a batch plan written ahead and replayed
after a failure, and a sink that keeps one row per key and offset; `consume_scans` runs the scan log through it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions.instants import instant_micros, micros_of_number

#: Collection types by the kind of state they keep.
HASHED = ("markdown", "code", "document", "pdf", "image")
FILE_TIMED = ("conversation",)
CURSORED = ("parser",)


def canonical_hash(text: Column) -> Column:
    """Lower-case hex without an algorithm prefix; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(text)), r"^sha-?256[:=]\s*|\s+", ""), F.lit(""))


def mtime_micros(mtime: Column) -> Column:
    """A file time in seconds, milliseconds, microseconds or nanoseconds (by size) as whole microseconds."""
    size = F.abs(mtime)
    scale = F.when(size < 1e11, 1e6).when(size < 1e14, 1e3).when(size < 1e17, 1.0).otherwise(1e-3)
    return F.when(F.isnan(mtime) | (mtime == 0), None).otherwise(F.round(mtime * scale).cast("long"))


def cursor_micros(text: Column, cursor_format: Column) -> Column:
    """A session cursor read by its collection's format; wall time is UTC. A format that does not fit gives way to the text."""
    number = F.regexp_extract(text, r"^\s*([+-]?\d{1,18})(?:\.(\d*))?\s*$", 1)
    whole = number.try_cast("long")
    read = F.when(number == "", None).when(cursor_format == "epoch_s", F.when(F.length(number) <= 11, micros_of_number(number, F.regexp_extract(text, r"\.(\d+)\s*$", 1))))
    read = read.when(cursor_format == "epoch_ms", F.when(whole != 0, whole * 1000))
    return F.coalesce(read, instant_micros(text, F.lit("UTC"), F.lit("dmy")))


def listed_entries(entries: DataFrame, runs: DataFrame, collections: DataFrame) -> DataFrame:
    """What each run listed: (run_id, collection_id, run_no, ok, prior, path, hash, us), one row per run and path.

    `prior` counts the committed runs of the collection before this one. Rows whose run or path is unknown, rows seen
    after their run finished, and entries without a readable state are left out; of several rows of a run for one path
    the latest seen_at counts (ties: the larger entry_id).
    """
    order = Window.partitionBy("collection_id").orderBy("run_no", "run_id")
    ok = (F.lower(F.trim("status")) == "ok").cast("int")
    timeline = runs.select(
        "run_id", "collection_id", "run_no", "finished_at",
        F.coalesce(ok, F.lit(0)).alias("ok"),
        F.coalesce(F.sum(F.coalesce(ok, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("prior"),
    )
    kinds = collections.select("collection_id", "coll_type", F.lower(F.trim("cursor_format")).alias("cursor_format"))
    joined = (
        entries.select("entry_id", "run_id", "path", "content_hash", "mtime", "cursor_value", "seen_at")
        .filter(F.col("path").isNotNull())
        .join(timeline, "run_id")
        .filter(F.col("finished_at").isNull() | (F.col("seen_at") <= F.col("finished_at")))
        .join(kinds, "collection_id")
    )
    hashed, timed, cursored = (F.col("coll_type").isin(*k) for k in (HASHED, FILE_TIMED, CURSORED))
    state = joined.select(
        "run_id", "collection_id", "run_no", "ok", "prior", "path", "seen_at", "entry_id",
        F.when(hashed, canonical_hash(F.col("content_hash"))).alias("hash"),
        F.when(timed, mtime_micros(F.col("mtime"))).when(cursored, cursor_micros(F.col("cursor_value"), F.col("cursor_format"))).alias("us"),
    )
    latest = Window.partitionBy("collection_id", "path", "run_id").orderBy(F.col("seen_at").desc_nulls_last(), F.col("entry_id").desc())
    return (
        state.repartition("collection_id", "path")  # one shuffle serves this window and those of pending_changes
        .withColumn("nth", F.row_number().over(latest))
        .filter("nth = 1 AND (hash IS NOT NULL OR us IS NOT NULL)")
        .drop("nth", "seen_at", "entry_id")
    )


def pending_changes(entries: DataFrame, runs: DataFrame, collections: DataFrame) -> DataFrame:
    """(run_id, collection_id, path) that each run must process, whatever its own status.

    A path is pending if the store before the run does not hold it, or holds another hash, or an instant earlier by at
    least a millisecond. After a committed run the store holds the paths of that run alone; an instant it holds never
    goes back while the path stays listed in every committed run. Empty tables give no rows.
    """
    path = Window.partitionBy("collection_id", "path").orderBy("run_no", "run_id")
    listed = listed_entries(entries, runs, collections)
    # committed listings without a gap share prior - (their number so far): within such an island instants only grow
    islands = listed.withColumn("island", F.when(F.col("ok") == 1, F.col("prior") - F.sum("ok").over(path.rowsBetween(Window.unboundedPreceding, 0))))
    within = Window.partitionBy("collection_id", "path", "island").orderBy("run_no", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    grown = islands.withColumn("kept", F.when(F.col("ok") == 1, F.struct("prior", "hash", F.max("us").over(within).alias("us"))))
    held = grown.withColumn("held", F.last("kept", ignorenulls=True).over(path.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.col("held").isNull() | (F.col("held.prior") != F.col("prior") - 1)
    changed = ~F.col("hash").eqNullSafe(F.col("held.hash")) & F.col("hash").isNotNull()
    later = F.col("us") - F.col("held.us") >= 1000
    return held.filter(fresh | changed | F.coalesce(later, F.col("us").isNotNull() & F.col("held.us").isNull())).select(
        F.col("run_id").cast("long"), F.col("collection_id").cast("long"), "path"
    )


class LogConsumer:
    """Exactly-once consumption of an append-only log table, across failures.

    All state is in tables under `folder` (any shared Hadoop file system): `plans/NNN` holds the batch plan (partition, from,
    to), written before any row is read, `offsets/NNN` the committed offset of every partition, `rows/batch=NNN` the sink. A
    plan without offsets of the same number belongs to a failed batch and is replayed as written, so a row that came since
    cannot change it; the sink of that batch is overwritten. A table counts once its writer has finished it. No plan, offset
    or row passes through the driver. Rows that come late, at an offset committed before, and rows without an offset are
    part of the next batch unless the sink holds their key and offset. A null partition is a partition like any other.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str], partition: str, offset: str, latest: str | None = None, late: bool = True):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.key, self.partition, self.offset, self.latest, self.late = key, partition, offset, latest, late
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the finished tables of a kind; there is one per batch."""
        at = self._path(f"{self.folder}/{kind}")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._path(f"{self.folder}/{kind}/{n}/_SUCCESS")))

    def read(self, kind: str, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{kind}/{number:09d}")

    def write(self, kind: str, number: int, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/{number:09d}")
        return self.read(kind, number)

    def committed(self) -> DataFrame:
        """(partition, offset) of every partition consumed so far."""
        done = self._numbers("offsets")
        return self.read("offsets", done[-1]) if done else self.spark.createDataFrame([], "partition string, offset long")

    def _known(self, log: DataFrame) -> DataFrame:
        return log.select(F.col(self.partition).cast("string").alias("partition"), F.col(self.offset).cast("long").alias("offset"))

    def _plan(self, offsets: DataFrame, stepwise: bool) -> DataFrame:
        since = self.committed().select(F.col("partition").alias("p"), F.col("offset").alias("from"))
        ahead = offsets.filter("offset IS NOT NULL").join(since, F.col("partition").eqNullSafe(F.col("p")), "left").filter(F.col("from").isNull() | (F.col("offset") > F.col("from")))
        return ahead.groupBy("partition", "from").agg((F.min if stepwise else F.max)("offset").alias("to"))

    def _late(self, log: DataFrame) -> DataFrame:
        """Rows at offsets committed before, or at none, of which the sink knows nothing."""
        if not self.late:
            return log.limit(0)
        since = self.committed().select(F.col("partition").alias("p"), F.col("offset").alias("_done"))
        old = log.join(since, F.col(self.partition).cast("string").eqNullSafe(F.col("p")), "left").filter(F.col(self.offset).isNull() | (F.col(self.offset) <= F.col("_done"))).drop("p", "_done")
        if not self._numbers("offsets"):
            return old.filter(F.col(self.offset).isNull())
        ids = [*self.key, self.partition, self.offset]
        held = self.taken().select(*[F.col(c).alias(f"_{c}") for c in ids])
        same = F.lit(True)
        for c in ids:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return old.join(held, same, "left_anti")

    def run(self, log: DataFrame, process: Callable[[DataFrame, int], DataFrame] = lambda rows, _: rows, offsets: DataFrame | None = None, stepwise: bool = False) -> int:
        """Process what the log holds beyond the committed offsets; the number of the batch, or -1 if there is nothing new.

        `offsets` (partition, offset) names the offsets where not every one has rows. A batch takes all offsets that are
        ahead or, `stepwise`, the next one of each partition.
        """
        done, planned = self._numbers("offsets"), self._numbers("plans")
        number = done[-1] + 1 if done else 0
        if planned and planned[-1] == number:
            plan = self.read("plans", number)
        else:
            plan = self.write("plans", number, self._plan(offsets if offsets is not None else self._known(log).distinct(), stepwise))
            if plan.isEmpty() and self._late(log).isEmpty():
                self._fs.delete(self._path(f"{self.folder}/plans/{number:09d}"), True)
                return -1
        spec = plan.select(F.col("partition").alias("_p"), F.col("from").alias("_from"), F.col("to").alias("_to"))
        ahead = log.join(spec, F.col(self.partition).cast("string").eqNullSafe(F.col("_p")))
        ahead = ahead.filter((F.col("_from").isNull() | (F.col(self.offset) > F.col("_from"))) & (F.col(self.offset) <= F.col("_to"))).drop("_p", "_from", "_to")
        batch = ahead.unionByName(self._late(log)) if self.late else ahead
        ids = [*self.key, self.partition, self.offset]
        by = Window.partitionBy(*ids).orderBy(*([F.col(self.latest).desc_nulls_last()] if self.latest else []), F.xxhash64(*[c for c in batch.columns]))
        once = batch.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")
        if self.late:
            self.write("taken", number, once.select(*ids))
        self.write("rows", number, process(once, number))
        since = self.committed().select("partition", "offset").unionByName(plan.select("partition", F.col("to").alias("offset")))
        self.write("offsets", number, since.groupBy("partition").agg(F.max("offset").alias("offset")))
        return number

    def _all(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{kind}/{n:09d}" for n in self._numbers("offsets")])

    def taken(self) -> DataFrame:
        """Keys and offsets of all rows consumed in committed batches."""
        return self._all("taken")

    def rows(self) -> DataFrame:
        """What committed batches put out. There must be one."""
        return self._all("rows")


def consume_scans(entries: DataFrame, runs: DataFrame, collections: DataFrame, folder: str, steps: int | None = None) -> DataFrame:
    """`pending_changes` by consuming the scan log: a partition per collection, a run as offset, a batch for each next run.

    A batch compares its listings with the store of the batch before, puts out what is new or changed, and writes the store
    that follows: that of the listings where the run committed, else the one before. Started again over the same folder it
    goes on, or replays the batch that failed. `steps` ends it after so many batches (for tests).
    """
    spark = entries.sparkSession
    order = Window.partitionBy("collection_id").orderBy("run_no", "run_id")
    ok = F.coalesce((F.lower(F.trim("status")) == "ok").cast("int"), F.lit(0))
    timeline = runs.filter("run_id IS NOT NULL AND collection_id IS NOT NULL").select("run_id", "collection_id", ok.alias("commits"), F.row_number().over(order).alias("seq"))
    consumer = LogConsumer(spark, folder, ["path"], "collection_id", "seq", late=False)
    logged = consumer._path(f"{folder}/log/_SUCCESS")
    if not consumer._fs.exists(logged):  # the log by offset, so that a batch reads its own runs alone
        listed = listed_entries(entries, runs, collections).select("run_id", "path", "hash", "us").join(timeline, "run_id")
        listed.write.mode("overwrite").partitionBy("seq").parquet(f"{folder}/log")
    log = spark.read.schema("run_id long, path string, hash string, us long, collection_id long, commits int, seq int").parquet(f"{folder}/log")
    offsets = timeline.select(F.col("collection_id").cast("string").alias("partition"), F.col("seq").cast("long").alias("offset"))
    empty = spark.createDataFrame([], "collection_id long, path string, hash string, us long")

    def process(batch: DataFrame, number: int) -> DataFrame:
        store = consumer.read("store", number - 1) if number else empty
        held = store.select("collection_id", "path", F.col("hash").alias("old_hash"), F.col("us").alias("old_us"), F.lit(True).alias("held"))
        both = batch.join(held, ["collection_id", "path"], "left")
        later = (F.col("us") - F.col("old_us") >= 1000) | (F.col("us").isNotNull() & F.col("old_us").isNull())
        changed = F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("old_hash"))
        went = consumer.read("plans", number).select(F.col("partition").cast("long").alias("collection_id"), F.col("to").cast("int").alias("seq"))
        closed = timeline.filter("commits = 1").join(went, ["collection_id", "seq"]).select("collection_id")
        grown = both.filter("commits = 1").select("collection_id", "path", "hash", F.greatest("us", "old_us").alias("us"))
        consumer.write("store", number, store.join(closed, "collection_id", "left_anti").select("collection_id", "path", "hash", "us").unionByName(grown))
        return both.filter(F.col("held").isNull() | changed | F.coalesce(later, F.lit(False))).select(F.col("run_id").cast("long"), F.col("collection_id").cast("long"), "path")

    done = 0
    while (steps is None or done < steps) and consumer.run(log.filter(F.col("seq") == len(consumer._numbers("offsets")) + 1), process, offsets, stepwise=True) >= 0:
        done += 1
    return consumer.rows() if consumer._numbers("offsets") else spark.createDataFrame([], "run_id long, collection_id long, path string")
