"""Rebuilding conversations from message rows, and dropping those that are broken, empty or unanswered.

A conversation is judged by a finite automaton over its speaking rows in order: START -user-> ASKED -assistant-> ANSWERED,
user and assistant may repeat, an assistant at START or an unknown speaker anywhere leads to BROKEN, and only ANSWERED
accepts. What a stretch of rows does to the automaton is fixed by its first and last speaker and whether an unknown one
occurs, so stretches compose in any grouping: the verdict is an ordinary aggregate with map-side combining, and a
conversation holding a third of all rows is never brought into one task. The secondary sort becomes the key of min_by
and max_by. Texts do not travel: speaker and "does it speak" are computed before the first shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.plans.session import cut

# fixed values: the usual names of each speaker
SPEAKERS = {
    1: ["user", "human", "customer", "you", "prompter", "client"],
    2: ["assistant", "ai", "bot", "model", "agent", "chatbot", "gpt", "claude", "gemini", "chatgpt", "ai_assistant"],
    3: ["system", "developer", "tool", "function", "tool_result", "tool_use", "tool_call", "function_call", "ipython"],
}
USER, ASSISTANT, OTHER, UNKNOWN = 1, 2, 3, 0
#: Chained conversations up to this many rows are ordered in one task (32 bytes a row); longer ones by pointer jumping over joins.
IN_TASK = 200_000
_BLANK = r"[^\s\p{Z}\p{C}⠀ㅤᅟᅠﾠ͏︀-️]"


def session_key(text: Column) -> Column:
    """Trimmed and in lower case; blank is null."""
    return F.nullif(F.lower(F.regexp_replace(text, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", "")), F.lit(""))


def speaker_code(role: Column) -> Column:
    name = session_key(role)
    return F.coalesce(*[F.when(name.isin(*names), code) for code, names in SPEAKERS.items()], F.lit(UNKNOWN))


def spoken_text(content: Column) -> Column:
    """The text of a message: the content itself, or the text blocks of a JSON array of blocks joined by line ends."""
    blocks = F.when(F.ltrim(content).startswith("["), F.from_json(content, "array<struct<type:string,text:string>>"))
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.coalesce(F.when(blocks.isNotNull(), F.array_join(texts, "\n")), content, F.lit(""))


def latest_rows(messages: DataFrame, *carry: str) -> DataFrame:
    """One row per msg_id, that with the latest ingested_at (ties: by its other values); rows without msg_id count once each if they differ.

    All values of a row travel as one struct, so that every use of these rows asks for the same exchange and Spark writes it once.
    """
    text = spoken_text(F.col("content"))
    named = {"code": speaker_code(F.col("role")), "speaks": text.rlike(_BLANK), "sid": session_key(F.col("session_id")), **{c: text if c == "text" else F.col(c) for c in carry}}
    whole = F.struct(F.col("ingested_at"), named["speaks"].alias("speaks"), named["code"].alias("code"), named["sid"].alias("sid"), "turn_index", "prev_id", "time_created", *[named[c].alias(c) for c in carry], "msg_id")
    other = F.when(F.col("msg_id").isNull(), F.sha2(F.to_json(F.struct("session_id", "turn_index", "prev_id", "time_created", "role", "content")), 256))
    # the id comes out of the struct as well: a filter that a join on it implies would else sink below one exchange of several
    rows = messages.select(F.col("msg_id").alias("key"), other.alias("other"), whole.alias("r")).groupBy("key", "other").agg(F.max("r").alias("r"))
    return rows.filter("r.sid IS NOT NULL").select(*[F.col(f"r.{c}").alias(c) for c in ("msg_id", "sid", "turn_index", "prev_id", "time_created", "code", "speaks", *carry)])


def large_sessions(messages: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(sid) of sessions with more than `in_task` chained rows as delivered: one narrow scan, aggregated map-side."""
    chained = messages.filter("prev_id IS NOT NULL").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return cut(chained.groupBy(session_key(F.col("session_id")).alias("sid")).agg(F.sum("n").alias("n")).filter(F.col("n") > in_task).select("sid"))


def chain_places(rows: DataFrame, large: DataFrame) -> DataFrame:
    """(sid, msg_id, place): how many predecessors a row has along prev_id; rows that no first row leads to come last.

    Sessions in `large` are walked by joins, the others within a task; both ways give the same places.
    """
    links = rows.select("sid", "msg_id", "prev_id")
    if large.isEmpty():
        return _places_in_task(links)
    return _places_in_task(links.join(large, "sid", "left_anti")).unionByName(_places_by_joins(links.join(large, "sid", "left_semi")))


def _places_in_task(links: DataFrame) -> DataFrame:
    """Pointer jumping over whole batches of conversations at once; a conversation arrives as one list of number pairs."""
    lists = links.groupBy("sid").agg(F.collect_list(F.struct(F.col("msg_id").alias("i"), F.col("prev_id").alias("p"))).alias("links"))

    def jump(batches):
        for b in batches:
            sid, pairs = b.column(0), b.column(1)
            lengths = np.asarray(pairs.value_lengths())
            flat = pairs.flatten()
            ids, prevs = flat.field("i"), flat.field("p")
            i, p = (np.asarray(x.fill_null(0)) for x in (ids, prevs))
            named, linked = np.asarray(ids.is_valid()), np.asarray(prevs.is_valid())
            owner = np.repeat(np.arange(len(lengths)), lengths)
            order = np.flatnonzero(named)
            order = order[np.lexsort((i[order], owner[order]))]
            so, si = owner[order], i[order]
            # where (owner, prev) stands among the sorted (owner, id): ids are ranked first so that both fit one number
            known, rank = np.unique(np.concatenate([si, p]), return_inverse=True)
            width = len(known) + 1
            keys, want = so * width + rank[: len(si)], owner * width + rank[len(si) :]
            at = np.searchsorted(keys, want)
            hit = np.zeros(len(p), bool)
            if len(keys):
                hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == want) & linked
            back = np.where(hit, order[np.minimum(at, len(order) - 1)] if len(order) else 0, -1)
            place = (back >= 0).astype("int64")
            for _ in range(int(lengths.max(initial=1)).bit_length() + 1):
                live = np.flatnonzero(back >= 0)
                if not len(live):
                    break
                to = back[live]
                place[live] += place[to]
                back[live] = back[to]
            place[back >= 0] = np.iinfo("int64").max  # a ring
            yield pa.RecordBatch.from_arrays([sid.take(pa.array(owner)), ids, pa.array(place)], ["sid", "msg_id", "place"])

    return lists.mapInArrow(jump, "sid string, msg_id long, place long")


def _places_by_joins(links: DataFrame) -> DataFrame:
    """The same by joins: each round doubles the distance a pointer has jumped; no key repeats but the pointers' targets."""
    known = links.select("sid", F.col("msg_id").alias("prev_id")).distinct()
    good = links.join(known.withColumn("here", F.lit(True)), ["sid", "prev_id"], "left")
    state = cut(good.select("sid", "msg_id", F.when(F.col("here"), F.col("prev_id")).alias("back"), F.when(F.col("here"), 1).otherwise(0).cast("long").alias("place")))
    longest = links.groupBy("sid").count().agg(F.max("count")).first()[0] or 1
    for _ in range(int(longest).bit_length() + 1):
        moving = state.filter("back IS NOT NULL")
        if moving.isEmpty():
            break
        target = state.select("sid", F.col("msg_id").alias("back"), F.col("back").alias("back2"), F.col("place").alias("place2"))
        moved = moving.join(target, ["sid", "back"]).select("sid", "msg_id", F.col("back2").alias("back"), (F.col("place") + F.col("place2")).alias("place"))
        state = cut(state.filter("back IS NULL").unionByName(moved))
    return state.select("sid", "msg_id", F.when(F.col("back").isNull(), F.col("place")).otherwise(F.lit(2**63 - 1)).alias("place"))


def judged(messages: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(sid, mode, first, last, broken) per conversation; mode is 'turn', 'chain' or 'time', by what orders it.

    first and last are the speaker codes of the first and last user or assistant row that speaks, null if none does.
    """
    rows = latest_rows(messages)
    talk = F.when(F.col("speaks") & F.col("code").isin(USER, ASSISTANT), F.col("code"))
    # one row per place in the order first: it finds turns held twice, and a conversation of any size is combined in parts
    per_turn = rows.withColumn("talk", talk).groupBy("sid", "turn_index").agg(
        F.count(F.lit(1)).alias("n"), F.count("prev_id").alias("n_prev"),
        F.max((F.col("speaks") & (F.col("code") == UNKNOWN)).cast("int")).alias("unknown"),
        F.min(F.when(F.col("talk").isNotNull(), F.struct(F.col("time_created").isNull().alias("a"), F.col("time_created").alias("b"), F.col("msg_id").alias("c"), F.col("talk").alias("talk")))).alias("lo"),
        F.max(F.when(F.col("talk").isNotNull(), F.struct(F.col("time_created").isNull().alias("a"), F.col("time_created").alias("b"), F.col("msg_id").alias("c"), F.col("talk").alias("talk")))).alias("hi"),
    )
    spoke = F.col("lo").isNotNull()
    whole = per_turn.groupBy("sid").agg(
        F.sum("n").alias("n"), F.sum("n_prev").alias("n_prev"), F.max("unknown").alias("unknown"),
        F.count("turn_index").alias("turns"), F.max("turn_index").alias("top"), F.min("turn_index").alias("bottom"),
        F.max(F.when(F.col("turn_index").isNotNull(), F.col("n"))).alias("held"), F.max(F.when(F.col("turn_index").isNull(), 1)).alias("unplaced"),
        F.min(F.when(spoke & F.col("turn_index").isNotNull(), F.struct("turn_index", "lo.talk"))).alias("turn_first"),
        F.max(F.when(spoke & F.col("turn_index").isNotNull(), F.struct("turn_index", "hi.talk"))).alias("turn_last"),
        F.min("lo").alias("time_first"), F.max("hi").alias("time_last"),
    )
    mode = F.when(F.col("turns") > 0, "turn").when(F.col("n_prev") > 0, "chain").otherwise("time")
    gaps = (F.col("turns") > 0) & (F.col("unplaced").isNotNull() | (F.col("held") > 1) | (F.col("bottom") != 0) | (F.col("top") != F.col("turns") - 1))
    whole = whole.select("sid", mode.alias("mode"), (gaps | (F.col("unknown") == 1)).alias("flawed"), "turn_first", "turn_last", "time_first", "time_last")
    linked = rows.filter("prev_id IS NOT NULL").select("sid", "prev_id")
    lost = linked.join(rows.select("sid", F.col("msg_id").alias("prev_id")), ["sid", "prev_id"], "left_anti").select("sid").distinct().withColumn("lost", F.lit(True))
    chained = rows.join(whole.filter("mode = 'chain'").select("sid"), "sid", "left_semi").withColumn("talk", talk)
    placed = chain_places(chained, large_sessions(messages, in_task)).join(chained.filter("talk IS NOT NULL").select("sid", "msg_id", "time_created", "talk"), ["sid", "msg_id"])
    key = F.struct("place", F.col("time_created").isNull(), "time_created", "msg_id")
    ends = placed.groupBy("sid").agg(F.min_by("talk", key).alias("chain_first"), F.max_by("talk", key).alias("chain_last"))
    pick = lambda which: F.when(F.col("mode") == "turn", F.col(f"turn_{which}.talk")).when(F.col("mode") == "chain", F.col(f"chain_{which}")).otherwise(F.col(f"time_{which}.talk"))
    return whole.join(ends, "sid", "left").join(lost, "sid", "left").select("sid", "mode", pick("first").alias("first"), pick("last").alias("last"), (F.col("flawed") | F.col("lost").isNotNull()).alias("broken"))


def dropped_sessions(messages: DataFrame, sessions: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(session_id) of conversations that are broken, empty or left without a reply, in either table; ids trimmed, lower case.

    Empty tables give no rows; rows without an id belong to no conversation; null content does not speak.
    """
    verdict = judged(messages, in_task)
    accepted = ~F.col("broken") & (F.col("first") == USER) & (F.col("last") == ASSISTANT)
    bad = verdict.filter(~F.coalesce(accepted, F.lit(False))).select(F.col("sid").alias("session_id"))
    listed = sessions.select(session_key(F.col("session_id")).alias("session_id")).filter("session_id IS NOT NULL").distinct()
    seen = verdict.select(F.col("sid").alias("session_id"))
    return bad.unionByName(listed.join(seen, "session_id", "left_anti"))


def conversations(messages: DataFrame, sessions: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(session_id, place, time_created, msg_id, speaker, text): the kept conversations, a row per speaking turn of user and assistant.

    The order within a conversation is (place, time_created, msg_id): place is the turn index, the position along the
    chain, or 0 where time alone orders. It stays in long form, so that no conversation becomes one value or one task.
    """
    rows = latest_rows(messages, "text").filter("speaks").filter(F.col("code").isin(USER, ASSISTANT))
    verdict = judged(messages, in_task).join(dropped_sessions(messages, sessions, in_task).withColumnRenamed("session_id", "sid"), "sid", "left_anti").select("sid", "mode")
    kept = rows.join(verdict, "sid")
    every = latest_rows(messages).join(verdict.filter("mode = 'chain'"), "sid", "left_semi")
    kept = kept.join(chain_places(every, large_sessions(messages, in_task)), ["sid", "msg_id"], "left")
    place = F.when(F.col("mode") == "turn", F.col("turn_index")).when(F.col("mode") == "chain", F.col("place")).otherwise(0).cast("long")
    return kept.select(F.col("sid").alias("session_id"), place.alias("place"), "time_created", "msg_id", F.when(F.col("code") == USER, "user").otherwise("assistant").alias("speaker"), "text")
