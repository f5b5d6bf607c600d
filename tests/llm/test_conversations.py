import datetime as dt
import json
import random

from __spark_entry__ import queries
from siftlake.llm.conversations import chain_places, conversations, dropped_sessions, latest_rows
from siftlake.plans.session import table

SCHEMA = "msg_id long, session_id string, turn_index int, prev_id long, time_created long, role string, content string, ingested_at timestamp"
DAY = dt.datetime(2024, 1, 1)


def rows(*talks):
    """(session, [(role, content, turn, prev, time)]) with ids 100 * session number + place."""
    out = []
    for n, (sid, lines) in enumerate(talks, 1):
        out += [(100 * n + i, sid, turn, None if prev is None else 100 * n + prev, t, role, text, DAY) for i, (role, text, turn, prev, t) in enumerate(lines)]
    return out


def dropped(spark, data, listed=(), in_task=200_000):
    messages = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS sid", "2 AS place", "3 AS talk", "4 AS n")
    sessions = spark.createDataFrame([(s,) for s in listed], "session_id string")
    return sorted(r.session_id for r in dropped_sessions(messages, sessions, in_task).collect())


def test_what_is_dropped(spark):
    U, A = "user", "assistant"
    data = rows(
        ("good", [(U, "q", 0, None, 1), (U, "more", 1, None, 2), ("Bot", "a", 2, None, 3)]),
        (" Good2 ", [("system", "s", 0, None, 1), ("Human", json.dumps([{"type": "text", "text": "q"}]), 1, None, 2), ("TOOL", "t", 2, None, 3), ("AI", "a", 3, None, 4), ("system", "end", 4, None, 5)]),
        ("noreply", [(U, "q", 0, None, 1), (A, "a", 1, None, 2), (U, "q", 2, None, 3)]),
        ("starts", [(A, "a", 0, None, 1), (U, "q", 1, None, 2), (A, "a", 2, None, 3)]),
        ("silent", [(U, " ​", 0, None, 1), (A, json.dumps([{"type": "image"}]), 1, None, 2)]),
        ("gap", [(U, "q", 0, None, 1), (A, "a", 2, None, 2)]),
        ("twice", [(U, "q", 0, None, 1), (A, "a", 1, None, 2), (A, "b", 1, None, 3)]),
        ("stranger", [(U, "q", 0, None, 1), ("narrator", "x", 1, None, 2), (A, "a", 2, None, 3)]),
        ("mute", [(U, "q", 0, None, 1), ("narrator", "", 1, None, 2), (A, "a", 2, None, 3)]),
        ("chain", [(A, "a", None, 1, 1), (U, "q", None, None, 2)]),
        ("torn", [(U, "q", None, None, 1), (A, "a", None, 77, 2)]),
        ("time", [(A, "a", None, None, 9), (U, "q", None, None, 3)]),
        ("nulltext", [(U, None, 0, None, 1), (A, "a", 1, None, 2)]),
        (None, [(U, "q", 0, None, 1)]), ("  ", [(U, "q", 0, None, 1)]),
    )
    want = ["gap", "noreply", "nulltext", "only listed", "silent", "starts", "stranger", "torn", "twice"]
    for in_task in (200_000, 0):
        assert dropped(spark, data, ["GOOD", "Only Listed ", None, ""], in_task) == want
    assert dropped(spark, []) == [] and dropped(spark, [], ["x"]) == ["x"]


def test_the_latest_state_of_a_message_counts_and_long_texts_pass(spark):
    late = DAY + dt.timedelta(days=9)
    data = [(1, "s", 0, None, 1, "user", "x" * 300_000, DAY), (2, "s", 1, None, 2, "assistant", "", DAY), (2, "s", 1, None, 2, "assistant", "done", late), (2, "s", 1, None, 2, "assistant", "done", late), (1, "s", 0, None, 1, "user", "q", None)]
    assert dropped(spark, data) == []
    assert dropped(spark, [data[0], data[2], (2, "s", 1, None, 2, "assistant", "", late + dt.timedelta(1))]) == ["s"]


def test_rows_without_id_differ_by_text(spark):
    data = [(None, "s", None, None, 1, "user", "a", DAY), (None, "s", None, None, 1, "user", "b", DAY), (None, "s", None, None, 1, "user", "b", DAY)]
    assert latest_rows(spark.createDataFrame(data, SCHEMA)).count() == 2


def test_both_walks_give_the_same_places(spark):
    rng = random.Random(3)
    links = []
    for s in range(6):
        ids = rng.sample(range(-5000, 5000), 60)
        links += [(f"s{s}", i, p) for i, p in zip(ids, [None, *ids[:40], *rng.choices(ids, k=19)], strict=True)]
    links += [("ring", 1, 2), ("ring", 2, 1), ("ring", 3, 3), ("lost", 5, 99), ("none", None, 4), ("none", 4, None)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "sid string, msg_id long, prev_id long")
    places = [sorted((tuple(r) for r in chain_places(df, large).collect() if r.msg_id is not None), key=str) for large in (df.select("sid").limit(0), df.select("sid").distinct(), df.filter("sid = 's1'").select("sid").distinct())]
    assert places[0] == places[1] == places[2]


def test_rebuilt_conversations(spark, small):
    messages, sessions = table(spark, small, "messages"), table(spark, small, "sessions", "session_id")
    gone = {r.session_id for r in queries()["p3_found"](spark, small).collect()}
    turns = {}
    for r in sorted(conversations(messages, sessions).collect(), key=lambda r: (r.session_id, r.place, r.time_created is None, r.time_created, r.msg_id)):
        turns.setdefault(r.session_id, []).append((r.speaker, r.text))
    assert turns and not gone & set(turns)
    for said in turns.values():
        assert said[0][0] == "user" and said[-1][0] == "assistant" and all(text.strip() for _, text in said)
    ids = {r.sid for r in latest_rows(messages).select("sid").distinct().collect()}
    assert set(turns) | gone >= ids
