import datetime as dt
import shutil
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftlake.operators.changes import LogConsumer, canonical_hash, consume_scans, mtime_micros, pending_changes
from siftlake.plans.session import table

E_SCHEMA = "entry_id long, run_id long, collection_id long, path string, content_hash string, mtime double, cursor_value string, line_count int, seen_at timestamp"
R_SCHEMA = "run_id long, collection_id long, run_no int, status string, started_at timestamp, finished_at timestamp"
C_SCHEMA = "collection_id long, coll_type string, cursor_format string"


def at(h):
    return dt.datetime(2024, 3, 1, h)


def frames(spark, entries, runs, collections, extra=False):
    e = spark.createDataFrame(entries, E_SCHEMA)
    if extra:  # columns that clash with those the operator makes
        e = e.withColumn("ok", F.lit("x")).withColumn("prior", F.lit(1)).withColumn("status", F.lit("ok")).withColumn("held", F.lit(2))
    return e, spark.createDataFrame(runs, R_SCHEMA), spark.createDataFrame(collections, C_SCHEMA)


def simulate(entries, runs, kinds, value):
    """The store walked run by run in plain Python."""
    found = set()
    by = defaultdict(list)
    for r in runs:
        by[r["collection_id"]].append(r)
    listed = defaultdict(dict)
    for e in entries:
        listed[e["run_id"]].setdefault(e["path"], []).append(e)
    for c, rs in by.items():
        store = {}
        for r in sorted(rs, key=lambda r: r["run_no"]):
            now = {}
            for path, es in listed[r["run_id"]].items():
                es = [e for e in es if r["finished_at"] is None or e["seen_at"] <= r["finished_at"]]
                if es:
                    v = value(max(es, key=lambda e: (e["seen_at"], e["entry_id"])), kinds[c])
                    if v is not None:
                        now[path] = v
            for path, v in now.items():
                old = store.get(path)
                if old is None or (v != old if isinstance(v, str) else v - old >= 1000):
                    found.add((r["run_id"], c, path))
            if r["status"] == "ok":
                store = {p: v if isinstance(v, str) else max(v, store.get(p, v)) for p, v in now.items()}
    return found


def test_against_a_walk_through_the_runs(spark, small):
    e, r, c = (table(spark, small, n) for n in ("scan_entries", "sync_runs", "collections"))
    kinds = {x.collection_id: x.coll_type for x in c.collect()}
    from siftlake.operators.changes import cursor_micros

    fmt = c.select("collection_id", "cursor_format")
    rows = e.join(fmt, "collection_id").select("*", canonical_hash(F.col("content_hash")).alias("h"), mtime_micros(F.col("mtime")).alias("m"), cursor_micros(F.col("cursor_value"), F.col("cursor_format")).alias("u")).collect()
    value = lambda x, kind: x["h"] if kind in ("markdown", "code", "document", "pdf") else x["m"] if kind == "conversation" else x["u"]
    want = simulate([x.asDict() for x in rows], [x.asDict() for x in r.collect()], kinds, value)
    got = [tuple(x) for x in pending_changes(e, r, c).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_failed_runs_late_rows_and_gaps(spark):
    runs = [(1, 7, 1, "ok", None, at(1)), (2, 7, 2, "failed", None, at(2)), (3, 7, 3, "killed", None, None), (4, 7, 4, "ok", None, at(4)), (5, 7, 5, "ok", None, at(5)), (6, 7, 6, "ok", None, at(6))]
    E = lambda i, run, path, h, when: (i, run, 7, path, h, None, None, None, when)
    entries = [
        E(1, 1, "a", "AA", at(1)), E(2, 1, "late", "x", at(2)),  # late: after the run finished
        E(3, 2, "a", "sha256:aa", at(2)), E(4, 2, "b", "b", at(2)),  # same hash, other spelling; b handed on, not committed
        E(5, 3, "b", "b", at(9)),  # run without an end
        E(6, 4, "a", None, at(4)), E(7, 4, "b", "b", at(3)), E(8, 4, "b", "c", at(4)), E(8, 4, "b", "c", at(4)),  # a unreadable: dropped from the store
        E(9, 5, "a", "aa", at(5)), E(10, 5, "b", "c", at(5)), E(11, 5, None, "c", at(5)), E(12, None, "z", "c", at(5)),
        E(13, 6, "b", "c", None),
    ]
    e, r, c = frames(spark, entries, runs, [(7, "code", None)], extra=True)
    got = {(x.run_id, x.path) for x in pending_changes(e, r, c).collect()}
    assert got == {(1, "a"), (2, "b"), (3, "b"), (4, "b"), (5, "a")}


def test_instants_never_go_back_while_listed(spark):
    runs = [(i, 1, i, "ok", None, None) for i in range(1, 6)]
    E = lambda i, run, m: (i, run, 1, "p", None, m, None, None, at(run))
    entries = [E(1, 1, 1.7e9), E(2, 2, 1.6e9), E(3, 3, 1.65e12), E(4, 4, 1.7e12 + 0.5), E(5, 5, 1.7e9 + 0.002)]
    got = {x.run_id for x in pending_changes(*frames(spark, entries, runs, [(1, "conversation", None)])).collect()}
    assert got == {1, 5}


def test_empty_tables(spark):
    assert pending_changes(*frames(spark, [], [], [])).count() == 0


def test_consumer_replays_a_failed_batch(spark, tmp_path):
    log = lambda rows: spark.createDataFrame(rows, "part string, off long, k string, v int")
    c = LogConsumer(spark, str(tmp_path / "c"), ["k"], "part", "off", latest="v")
    first = [("a", 1, "x", 1), ("a", 2, "y", 2), ("a", 2, "y", 9), ("b", 1, "z", 3), (None, 1, "n", 0)]
    assert c.run(log(first)) == 0
    assert c.run(log(first)) == -1
    assert {(r.k, r.v) for r in c.rows().collect()} == {("x", 1), ("y", 9), ("z", 3), ("n", 0)}
    second = [*first, ("a", 3, "x", 4)]

    def breaks(rows, number):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        c.run(log(second), breaks)
    assert c.rows().count() == 4
    # rows that came since the plan was written wait for the next batch
    third = [*second, ("a", 4, "x", 5)]
    assert c.run(log(third)) == 1
    assert max(r.off for r in c.rows().collect() if r.part == "a") == 3
    assert c.run(log(third)) == 2 and {(r.partition, r.offset) for r in c.committed().collect()} == {("a", 4), ("b", 1), (None, 1)}
    # late: an offset committed before, and none at all; neither is skipped, neither comes twice
    fourth = [*third, ("a", 2, "late", 6), ("b", None, "none", 7)]
    assert c.run(log(fourth)) == 3 and c.run(log(fourth)) == -1
    assert c.rows().count() == 8 and {"late", "none"} <= {r.k for r in c.rows().collect()}


def test_the_log_consumer_gives_the_rows_of_the_window_plan(spark, small, tmp_path):
    e, r, c = (table(spark, small, n) for n in ("scan_entries", "sync_runs", "collections"))
    want = sorted(tuple(x) for x in pending_changes(e, r, c).collect())
    assert sorted(tuple(x) for x in consume_scans(e, r, c, str(tmp_path / "a")).collect()) == want
    # stopped and started again, with a batch planned and begun but not committed
    consume_scans(e, r, c, str(tmp_path / "b"), steps=3)
    shutil.copytree(tmp_path / "b/plans/000000002", tmp_path / "b/plans/000000003", dirs_exist_ok=True)
    shutil.rmtree(tmp_path / "b/plans/000000003")
    shutil.rmtree(tmp_path / "b/offsets/000000002")  # the commit of the third batch is lost: it is replayed
    assert sorted(tuple(x) for x in consume_scans(e, r, c, str(tmp_path / "b")).collect()) == want


def test_a_committed_run_that_lists_nothing_empties_the_store(spark, tmp_path):
    runs = [(1, 7, 1, "ok", None, None), (2, 7, 2, "ok", None, None), (3, 7, 3, "ok", None, None)]
    entries = [(1, 1, 7, "a", "x", None, None, None, at(1)), (2, 3, 7, "a", "x", None, None, None, at(3))]
    found = frames(spark, entries, runs, [(7, "code", None)], extra=True)
    want = {(1, "a"), (3, "a")}
    assert {(x.run_id, x.path) for x in pending_changes(*found).collect()} == want
    assert {(x.run_id, x.path) for x in consume_scans(*found, str(tmp_path / "s")).collect()} == want
    assert consume_scans(*frames(spark, [], [], []), str(tmp_path / "e")).count() == 0
