"""Schemas that drift between the files of a stream: one consistent table, and a report of each change.

Every record becomes path-value rows with raw types (`variant_explode` of the parsed payload, so nothing leaves the
JVM); path-type statistics are aggregated per file; consecutive files are compared on these small statistics. Values
travel only for fields that go or come, to tell a rename from a removal and an addition.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.plans.session import cut

#: Fields up to this many are sent to every task to pick their values; more are joined.
FEW = 100_000
_TYPE_BITS = {"string": 1, "number": 2, "boolean": 4, "array": 8, "object": 16}


def path_values(exports: DataFrame, carry: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """(stream_id, file_seq, table_name, record_id, field, type, value) per top-level key of every readable record.

    type is one of string, number, boolean, array, object, or null for a null value; value is canonical JSON text
    (numbers as double, whole ones from 2^53 on with all digits). Payloads that are null, broken or no object are unreadable and skipped, as are rows without
    stream, file or table. The columns `carry` come along in front; with `outer` a record without keys is one row without field.
    """
    readable = (
        exports.select(*carry, "stream_id", "file_seq", "table_name", F.try_parse_json("payload").alias("record"))
        .filter("stream_id IS NOT NULL AND file_seq IS NOT NULL AND table_name IS NOT NULL")
        .filter(F.schema_of_variant("record").startswith("OBJECT"))
        .select("*", F.try_variant_get("record", "$.id", "string").alias("record_id"))
    )
    spark = exports.sparkSession
    explode = spark.tvf.variant_explode_outer if outer else spark.tvf.variant_explode
    exploded = readable.lateralJoin(explode(F.col("record").outer()))
    raw = F.schema_of_variant("value")
    kind = (
        F.when(raw == "STRING", "string").when(raw == "BOOLEAN", "boolean").when(raw.startswith("ARRAY"), "array")
        .when(raw.startswith("OBJECT"), "object").when(raw != "VOID", "number")
    )
    double = F.try_variant_get("value", "$", "double")
    large = F.when((F.abs(double) >= 2**53) & ~raw.rlike(r"^DECIMAL\(\d+, ?[1-9]"), F.try_variant_get("value", "$", "decimal(38,0)").cast("string"))
    text = F.when(kind == "number", F.coalesce(large, double.cast("string"), F.to_json("value"))).otherwise(F.to_json("value"))
    return exploded.select(*carry, "stream_id", F.col("file_seq").cast("long"), "table_name", "record_id", F.col("key").alias("field"), kind.alias("type"), F.when(kind.isNotNull(), text).alias("value"))


def field_statistics(values: DataFrame) -> DataFrame:
    """Per file, table and field: the set of types as bits, and how many values and nulls it has."""
    bits = F.coalesce(*[F.when(F.col("type") == t, b) for t, b in _TYPE_BITS.items()])
    return values.groupBy("stream_id", "file_seq", "table_name", "field").agg(
        F.coalesce(F.bit_or(bits), F.lit(0)).alias("types"), F.count("type").alias("n_values"), F.count(F.lit(1)).alias("n_rows")
    )


def schema_changes(exports: DataFrame) -> DataFrame:
    """(stream_id, file_seq, table_name, field_name, change, new_name) of each file against the one before it.

    Only files whose predecessor (file_seq - 1) exists in the stream are compared. A rename needs at least one id with
    both values non-null and no id where they differ; if a field could be renamed to several, the pair with more equal ids
    wins, then the names' order. Empty tables give no rows.
    """
    values = path_values(exports)
    stats = cut(field_statistics(values))  # small, and read by all that follows: payloads are parsed here and for renames alone
    files = exports.select("stream_id", F.col("file_seq").cast("long")).filter("stream_id IS NOT NULL AND file_seq IS NOT NULL").distinct()
    pairs = files.join(files.select("stream_id", (F.col("file_seq") + 1).alias("file_seq")), ["stream_id", "file_seq"], "left_semi")
    keys = ["stream_id", "file_seq", "table_name", "field"]
    now = stats.select(*keys, F.col("types").alias("types_now"))
    before = stats.select("stream_id", (F.col("file_seq") + 1).alias("file_seq"), "table_name", "field", F.col("types").alias("types_before"))
    both = cut(now.join(before, keys, "full_outer").join(pairs, ["stream_id", "file_seq"], "left_semi"))
    table = Window.partitionBy("stream_id", "file_seq", "table_name")
    seen = both.select(
        *keys, "types_now", "types_before",
        (F.count("types_now").over(table) > 0).alias("table_now"), (F.count("types_before").over(table) > 0).alias("table_before"),
    )
    kept = seen.filter("table_now AND table_before")
    whole = seen.filter("table_now <> table_before").select(
        "stream_id", "file_seq", "table_name", F.lit("").alias("field_name"), F.when(F.col("table_now"), "table_added").otherwise("table_removed").alias("change"), F.lit("").alias("new_name")
    ).distinct()
    gone = kept.filter("types_now IS NULL").select(*keys)
    come = kept.filter("types_before IS NULL").select(*keys)
    renames = _renames(values, gone, come)
    at = ["stream_id", "file_seq", "table_name"]
    removed = gone.join(renames.withColumnRenamed("field_name", "field"), [*at, "field"], "left_anti").select(*at, F.col("field").alias("field_name"), F.lit("removed").alias("change"), F.lit("").alias("new_name"))
    added = come.join(renames.withColumnRenamed("new_name", "field"), [*at, "field"], "left_anti").select(*at, F.col("field").alias("field_name"), F.lit("added").alias("change"), F.lit("").alias("new_name"))
    retyped = kept.filter("types_now > 0 AND types_before > 0 AND types_now <> types_before").select(*at, F.col("field").alias("field_name"), F.lit("retyped").alias("change"), F.lit("").alias("new_name"))
    return whole.unionByName(removed).unionByName(added).unionByName(retyped).unionByName(renames.select(*at, "field_name", F.lit("renamed").alias("change"), "new_name"))


def _renames(values: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """(stream_id, file_seq, table_name, field_name, new_name), one-to-one; file_seq is that of the later file."""
    at = ["stream_id", "file_seq", "table_name"]
    # only tables that both lose and gain a field can have renamed one
    gone = gone.join(come.select(at), at, "left_semi")
    come = come.join(gone.select(at), at, "left_semi")
    asked = cut(gone.select(*at, "field", F.lit(True).alias("is_old")).unionByName(come.select(*at, "field", F.lit(False).alias("is_old"))))
    if asked.count() <= FEW:
        asked = F.broadcast(asked)
    # values of the fields asked for alone; an old field's stand in the file before
    typed = values.filter("record_id IS NOT NULL AND value IS NOT NULL").select(*at, "record_id", "field", "value")
    typed = typed.withColumn("is_old", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("file_seq", F.col("file_seq") + F.col("is_old").cast("int"))
    typed = typed.join(asked, [*at, "field", "is_old"]).distinct()
    old = typed.filter("is_old").select(*at, "record_id", F.col("field").alias("field_name"), F.col("value").alias("old"))
    new = typed.filter("NOT is_old").select(*at, "record_id", F.col("field").alias("new_name"), F.col("value").alias("new"))
    left = cut(
        old.join(new, [*at, "record_id"])
        .groupBy(*at, "field_name", "new_name")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.col("old") == F.col("new")).alias("equal"))
        .filter("equal").drop("equal")
    )
    by_old = Window.partitionBy(*at, "field_name").orderBy(F.desc("n"), "new_name")
    by_new = Window.partitionBy(*at, "new_name").orderBy(F.desc("n"), "field_name")
    chosen = left.select(*at, "field_name", "new_name").limit(0)
    # pairs that prefer each other are taken; a field that lost its first choice gets another if one is left
    while not left.isEmpty():
        best = left.withColumn("a", F.row_number().over(by_old)).withColumn("b", F.row_number().over(by_new)).filter("a = 1 AND b = 1").select(*at, "field_name", "new_name")
        chosen = cut(chosen.unionByName(best))
        left = cut(left.join(chosen.select(*at, "field_name"), [*at, "field_name"], "left_anti").join(chosen.select(*at, "new_name"), [*at, "new_name"], "left_anti"))
    return chosen


def _columns(pairs: dict[tuple[str, str], int], together: list[set[str]]) -> dict[str, str]:
    """The column of every renamed field: names joined by renames share one, unless two of them stand together in some file.

    The column is called by the name that more renames lead to than from (ties: the names' order).
    """
    group = {n: {n} for pair in pairs for n in pair}
    for (old, new), _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        joined = group[old] | group[new]
        if group[old] is not group[new] and not any(len(joined & names) > 1 for names in together):
            group |= dict.fromkeys(joined, joined)
    led = {n: sum(k * ((new == n) - (old == n)) for (old, new), k in pairs.items()) for n in group}
    return {n: min(names, key=lambda x: (-led[x], x)) for n, names in group.items()}


def _own_columns(renames: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(stream_id, field, spans): for renames whose two names have no common column, the column of the old name in that stream.

    spans is an array of (until, column), in order: before file `until` the old name's values belong to that column.
    """

    def chains(batch: pd.DataFrame) -> pd.DataFrame:
        spans: dict[str, list[tuple[int, str]]] = {}
        for r in batch.sort_values("file_seq", ascending=False, kind="stable").itertuples():
            later = [c for until, c in spans.get(r.new_name, []) if until > r.file_seq]
            spans.setdefault(r.field_name, []).append((r.file_seq, later[-1] if later else columns[r.new_name]))
        rows = [(batch["stream_id"].iloc[0], f, [{"until": u, "column": c} for u, c in reversed(of)]) for f, of in spans.items()]
        return pd.DataFrame(rows, columns=["stream_id", "field", "spans"])

    return renames.groupBy("stream_id").applyInPandas(chains, "stream_id string, field string, spans array<struct<until:long,column:string>>")


def consistent_table(exports: DataFrame, table_name: str, changes: DataFrame | None = None) -> DataFrame:
    """All readable records of one table under one schema: each field once, whatever it is called in a stream or file, under its most frequent type.

    The result has stream_id, file_seq, line_no where `exports` has it, record_id, one column per field, and `failed_casts`: the
    columns whose value did not fit the type (null there). A record is a line of a file; of a line loaded twice the latest
    loaded_at counts. Without line numbers its id within the file stands for it. Whole numbers are long, others double; arrays
    and objects stay JSON text; a text that reads as a number or boolean fits such a column. Column names follow the field,
    prefixed `f_` so that a field named like a fixed column cannot clash, and numbered where two differ in case alone. What the
    driver reads to plan is a row per renamed pair, per set of such names that stand in one file, and per column and type.
    """
    exports = exports.filter(F.col("table_name") == table_name)
    line = [c for c in ("line_no",) if c in exports.columns]
    if line:
        newest = F.struct(*[c for c in ("loaded_at", "payload") if c in exports.columns])
        readable = exports.filter(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"))
        lines = readable.groupBy("stream_id", "file_seq", "table_name", *line).agg(F.max_by("payload", newest).alias("payload"))
    else:
        lines = exports
    changes = schema_changes(exports) if changes is None else changes.filter(F.col("table_name") == table_name)
    renames = changes.filter("change = 'renamed'").select("stream_id", "file_seq", F.col("field_name"), "new_name")
    pairs = {(r.field_name, r.new_name): r["count"] for r in renames.groupBy("field_name", "new_name").count().collect()}
    values = path_values(lines, carry=tuple(line), outer=True)
    column = F.col("field")
    if pairs:
        names = sorted({n for pair in pairs for n in pair})
        sets = values.filter(F.col("field").isin(names)).groupBy("stream_id", "file_seq").agg(F.array_sort(F.collect_set("field")).alias("names"))
        columns = _columns(pairs, [set(r.names) for r in sets.filter("size(names) > 1").select("names").distinct().collect()])
        column = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in columns.items() for x in kv]), column), column)
        apart = [F.struct(F.lit(a).alias("field_name"), F.lit(b).alias("new_name")) for a, b in pairs if columns[a] != columns[b]]
        if apart:
            own = _own_columns(renames.filter(F.struct("field_name", "new_name").isin(apart)), columns)
            values = values.join(own, ["stream_id", "field"], "left")
            column = F.coalesce(F.try_element_at(F.filter("spans", lambda x: x["until"] > F.col("file_seq")), F.lit(1))["column"], column)
    values = values.withColumn("column", column)
    whole = F.col("value").rlike(r"^-?\d{1,18}(\.0)?$|^-?\d\.\d{1,15}E1?\d$") & (F.col("value").try_cast("double") == F.floor(F.col("value").try_cast("double")))
    kinds: dict[str, dict[str, int]] = {}
    broken_up = set()
    for r in values.filter("column IS NOT NULL").groupBy("column", "type").agg(F.count(F.lit(1)).alias("n"), F.min(whole).alias("whole")).collect():
        kinds.setdefault(r.column, {})
        if r.type is not None:  # a field that is null throughout is a column of text
            kinds[r.column][r.type] = r.n
        if r.type == "number" and not r.whole:
            broken_up.add(r.column)
    chosen = {f: max(sorted(k), key=k.get, default="string") for f, k in kinds.items()}
    called: dict[str, str] = {}
    for f in sorted(chosen):
        name, i = f"f_{f}", 1
        while name.lower() in {x.lower() for x in called.values()}:
            i += 1
            name = f"f_{f}_{i}"
        called[f] = name
    at = {f: F.col(f"_{i}") for i, f in enumerate(sorted(chosen))}
    picked = values.groupBy("stream_id", "file_seq", *line, "record_id").agg(
        *[F.max(F.when((F.col("column") == f) & F.col("value").isNotNull(), F.struct("type", "value"))).alias(f"_{i}") for i, f in enumerate(sorted(chosen))], F.count(F.lit(1)).alias("_n")
    )

    def typed(f: str) -> Column:
        kind, x = chosen[f], at[f]
        plain = F.when(x["type"] == "string", F.try_variant_get(F.try_parse_json(x["value"]), "$", "string")).otherwise(x["value"])
        if kind == "number":
            number = plain.try_cast("decimal(38,9)") if f not in broken_up else plain.try_cast("double")
            return number.try_cast("double") if f in broken_up else F.when(number == F.floor(number), number.try_cast("long"))
        if kind == "boolean":
            return plain.try_cast("boolean")
        return plain if kind == "string" else F.when(x["type"] == kind, x["value"])

    failed = F.array_compact(F.array(*[F.when(at[f].isNotNull() & typed(f).isNull(), F.lit(called[f][2:])) for f in sorted(chosen)])) if chosen else F.array().cast("array<string>")
    return picked.select("stream_id", "file_seq", *line, "record_id", failed.alias("failed_casts"), *[typed(f).alias(called[f]) for f in sorted(chosen)])
