import json
from collections import defaultdict

from __spark_entry__ import queries
from siftlake.operators.drift import consistent_table, path_values, schema_changes
from siftlake.plans.session import table

SCHEMA = "stream_id string, file_seq int, table_name string, payload string"


def kind(v):
    return {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}[type(v)]


def brute(rows):
    files, fields, values, tables = set(), defaultdict(set), defaultdict(dict), set()
    for s, f, t, p in rows:
        files.add((s, f))
        try:
            o = json.loads(p)
        except Exception:
            continue
        if not isinstance(o, dict):
            continue
        tables.add((s, f, t))
        for k, v in o.items():
            fields[s, f, t].add(k)
            if v is not None:
                values[s, f, t, k].setdefault("types", set()).add(kind(v))
                if o.get("id") is not None:
                    values[s, f, t, k].setdefault(o["id"], json.dumps(v, sort_keys=True))
    out = set()
    for s, f in files:
        if (s, f - 1) not in files:
            continue
        for t in {x[2] for x in tables if x[0] == s}:
            a, b = (s, f - 1, t) in tables, (s, f, t) in tables
            if a != b:
                out.add((s, f, t, "", "table_added" if b else "table_removed", ""))
            if not (a and b):
                continue
            old, new = fields[s, f - 1, t], fields[s, f, t]
            gone, come = old - new, new - old
            for g in sorted(gone):
                for c in sorted(come):
                    x, y = values[s, f - 1, t, g], values[s, f, t, c]
                    common = (set(x) & set(y)) - {"types"}
                    if common and all(x[i] == y[i] for i in common):
                        out.add((s, f, t, g, "renamed", c))
                        gone, come = gone - {g}, come - {c}
                        break
            out |= {(s, f, t, g, "removed", "") for g in gone} | {(s, f, t, c, "added", "") for c in come}
            for k in old & new:
                x, y = values[s, f - 1, t, k].get("types"), values[s, f, t, k].get("types")
                if x and y and x != y:
                    out.add((s, f, t, k, "retyped", ""))
    return out


def test_against_plain_python(spark, small):
    for base in (small, "/root/testdata/sf0.01"):
        e = table(spark, base, "session_exports")
        want = brute([(r.stream_id, r.file_seq, r.table_name, r.payload) for r in e.collect()])
        got = [tuple(r) for r in schema_changes(e).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_cases(spark):
    j = json.dumps
    rows = [
        ("s", 1, "t", j({"id": 1, "a": "x", "n": 1, "gone": None})), ("s", 1, "t", j({"id": 2, "a": None, "n": 2.5})), ("s", 1, "u", j({"id": 1})),
        ("s", 2, "t", j({"id": 1, "b": "x", "n": "1", "new": [1]})), ("s", 2, "t", j({"id": 2, "b": "y", "n": None})), ("s", 2, "v", j({"id": 1})),
        ("s", 2, "t", '{"id": 3, "b'), ("s", 2, "t", None), ("s", 2, "t", "[1]"), ("s", 2, "t", ""),
        ("s", 4, "t", j({"id": 1, "z": 1})), (None, 1, "t", j({"id": 9})), ("s", 2, None, j({"id": 9})),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r)[1:] for r in schema_changes(df).collect()}
    assert got == {
        (2, "u", "", "table_removed", ""), (2, "v", "", "table_added", ""), (2, "t", "a", "renamed", "b"), (2, "t", "gone", "removed", ""),
        (2, "t", "new", "added", ""), (2, "t", "n", "retyped", ""),
    }
    assert schema_changes(df.limit(0)).count() == 0


def test_unlike_values_are_no_rename(spark):
    rows = [("s", 1, "t", '{"id":1,"a":1}'), ("s", 1, "t", '{"id":2,"a":2}'), ("s", 2, "t", '{"id":1,"b":1}'), ("s", 2, "t", '{"id":2,"b":3}')]
    got = {(r.field_name, r.change) for r in schema_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "removed"), ("b", "added")}


def test_consistent_table_reports_failed_casts(spark):
    rows = [("s", 1, "t", '{"id":"1","a":"x","n":1}'), ("s", 2, "t", '{"id":"1","b":"x","n":2}'), ("s", 2, "t", '{"id":"2","b":"y","n":"many"}')]
    df = consistent_table(spark.createDataFrame(rows, SCHEMA), "t")
    got = {(r.file_seq, r.record_id): (r.f_b, r.f_n, r.failed_casts) for r in df.collect()}
    assert got == {(1, "1"): ("x", 1.0, []), (2, "1"): ("x", 2.0, []), (2, "2"): ("y", None, ["n"])}


def test_path_values_keeps_types(spark):
    rows = [("s", 1, "t", json.dumps({"id": "é", "a": True, "o": {"b": 1}, "l": [], "x": None, "f": 1.50}))]
    got = {r.field: (r.type, r.value) for r in path_values(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["a"] == ("boolean", "true") and got["o"][0] == "object" and got["l"][0] == "array" and got["x"] == (None, None) and got["f"] == ("number", "1.5")


def test_renames_of_several_streams_share_a_column(spark):
    put = lambda s, f, n, **o: (s, f, n, "t", json.dumps(o))
    rows = [
        put("a", 1, 1, id="1", title="x"), put("a", 2, 1, id="1", name="x"), put("a", 3, 1, id="1", caption="x"), put("a", 3, 2, id="2", caption="y"), put("a", 3, 2, id="2", caption="y"),
        put("b", 1, 1, id="1", title="z"), put("b", 2, 1, id="1", heading="z"), put("c", 1, 1, id="1", title="q", size="7"), put("c", 1, 2),
        # here label and name stand together, so label of d alone joins name
        put("d", 1, 1, id="1", label="l"), put("d", 2, 1, id="1", name="l"), put("e", 1, 1, id="1", label="m", name="n", size=8), put("e", 1, 2, id="2", size=9),
    ]
    df = consistent_table(spark.createDataFrame(rows, "stream_id string, file_seq int, line_no int, table_name string, payload string"), "t")
    fields = [c for c in df.columns if c.startswith("f_")]
    assert len(fields) == 4  # id, size, label and the one of title, name, caption and heading
    title = next(c for c in fields if c not in ("f_id", "f_size", "f_label"))
    got = {(r.stream_id, r.file_seq, r.line_no): (r[title], r.f_label, r.f_size, r.failed_casts) for r in df.collect()}
    assert got == {
        ("a", 1, 1): ("x", None, None, []), ("a", 2, 1): ("x", None, None, []), ("a", 3, 1): ("x", None, None, []), ("a", 3, 2): ("y", None, None, []),
        ("b", 1, 1): ("z", None, None, []), ("b", 2, 1): ("z", None, None, []), ("c", 1, 1): ("q", None, 7, []), ("c", 1, 2): (None, None, None, []),
        ("d", 1, 1): ("l", None, None, []), ("d", 2, 1): ("l", None, None, []), ("e", 1, 1): ("n", "m", 8, []), ("e", 1, 2): (None, None, 9, []),
    }


def test_every_readable_line_is_a_row_of_its_table(spark, small):
    lines = defaultdict(set)
    for r in table(spark, small, "session_exports").collect():
        try:
            o = json.loads(r.payload)
        except ValueError:
            continue
        if isinstance(o, dict):
            lines[r.table_name].add((r.stream_id, r.file_seq, r.line_no))
    assert lines
    for t, want in lines.items():
        df = queries()[f"p4_{t}_table"](spark, small)
        got = [tuple(r) for r in df.select("stream_id", "file_seq", "line_no").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_large_whole_numbers_differ_in_their_last_digits(spark):
    rows = [("s", 1, "t", '{"id":1,"a":9007199254740993,"c":1,"e":123456789012345678901,"g":1e20}'), ("s", 2, "t", '{"id":1,"b":9007199254740992,"d":1.0,"f":123456789012345678901,"h":100000000000000000000}')]
    got = {(r.field_name, r.change, r.new_name) for r in schema_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "removed", ""), ("b", "added", ""), ("c", "renamed", "d"), ("e", "renamed", "f"), ("g", "renamed", "h")}
