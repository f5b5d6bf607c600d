"""Filters of a search, each a predicate; a set of filters is their conjunction."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_pattern(pattern: str) -> str:
    """A path pattern as a regular expression for the whole path: * and ? cross slashes, [] are sets, case counts.

    Backslashes are slashes and the pattern is cleaned as a path; one that climbs with .. is an error.
    """
    clean = posixpath.normpath(pattern.replace("\\", "/"))
    if ".." in clean.split("/") or ".." in pattern:
        raise ValueError("a path pattern must not hold ..")
    out, i = "", 0
    while i < len(clean):
        c = clean[i]
        end = clean.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = clean[i + 1 : end]
            out += "[" + ("^" + re.escape(body[1:]).replace(r"\-", "-") if body[0] in "^!" else re.escape(body).replace(r"\-", "-")) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


@dataclass(frozen=True)
class FilterSet:
    """What a search may be narrowed by; what is not given does not narrow. `fields` are equalities of fast fields."""

    collection: str | None = None
    coll_type: str | None = None
    since: str | None = None
    until: str | None = None
    path: str | None = None
    chunk_type: str | None = None
    fields: tuple[tuple[str, str], ...] = ()

    def predicates(self) -> list[Column]:
        out = []
        if self.collection is not None:
            out.append(F.col("collection") == self.collection)
        if self.coll_type is not None:
            out.append(F.col("coll_type") == self.coll_type)
        if self.since is not None:
            out.append(instant_text(F.col("created_at")) >= self.since)
        if self.until is not None:
            out.append(instant_text(F.col("created_at")) <= self.until)
        if self.path is not None:
            out.append(F.col("path").rlike(glob_pattern(self.path)))
        if self.chunk_type is not None:
            out.append(F.coalesce(F.col("chunk_type"), F.lit(0)) == (1 if self.chunk_type == "image" else 0))
        out += [field_equals(name, value) for name, value in self.fields]
        return out

    def apply(self, rows: DataFrame) -> DataFrame:
        """The rows that every filter lets through; all of them for an empty set."""
        return rows.filter(reduce(lambda a, b: a & b, self.predicates(), F.lit(True)))


def instant_text(at: Column) -> Column:
    """RFC 3339 in UTC with whole seconds: dates are compared as text, both ends included, so a bare day as end leaves that day out."""
    return F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def field_equals(name: str, value: str) -> Column:
    """Equality of a fast field; languages are compared in lower case."""
    return F.lower(F.col(name)) == value.lower() if name == "lang" else F.col(name) == value


def with_collections(docs: DataFrame, collections: DataFrame) -> DataFrame:
    """Documents with name and type of their collection; the dimension is small and broadcast below Spark's size threshold."""
    return docs.join(collections.select("collection_id", F.col("name").alias("collection"), "coll_type"), "collection_id")


def pending(chunks: DataFrame, force: bool = False) -> DataFrame:
    """Chunks that still lack an embedding; all of them with `force`."""
    return chunks if force else chunks.filter(F.col("embedding").isNull())


def with_defaults(chunks: DataFrame) -> DataFrame:
    """Missing chunk type, image path and lines as 0, '' and 0."""
    given = {"chunk_type": 0, "image_path": "", "start_line": 0, "end_line": 0}
    return chunks.select(*[F.coalesce(F.col(c), F.lit(given[c])).alias(c) if c in given else F.col(c) for c in chunks.columns])


# fixed values: the fields of a document and their types
FIELD_TYPES = {"title": "text", "content": "text", "path": "text", "collection": "text", "type": "text", "created_at": "date", "updated_at": "date", "line_count": "int", "mtime": "int", "lang": "text", "workspace": "text", "metadata": "json"}


def valid(value: Column, kind: str) -> Column:
    """Whether a text is a value of a field type; null always is. Numbers with a fraction pass as int."""
    match kind:
        case "date":
            ok = value.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$") & F.try_to_timestamp(value).isNotNull()
        case "int":
            ok = value.try_cast("double").isNotNull()
        case "bool":
            ok = F.lower(value).isin("true", "false")
        case "json":
            ok = F.try_parse_json(value).isNotNull()
        case _:
            ok = F.lit(True)
    return value.isNull() | F.coalesce(ok, F.lit(False))


def shown_text(text: Column, context: int = 0, image: bool = False) -> Column:
    """One line of at most 200 signs of text (150 beside an image), times 2 C + 1 with C chunks of context around."""
    most = (150 if image else 200) * (2 * context + 1)
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def location(path: Column, start: Column, end: Column, home: str | None = None) -> Column:
    """path:Ls-Le, or the path alone without lines; the home folder shows as ~."""
    short = F.when(path.startswith(home.rstrip("/") + "/"), F.concat(F.lit("~"), F.substring(path, len(home.rstrip("/")) + 1, 1 << 30))).otherwise(path) if home else path
    return F.when(F.coalesce(start, F.lit(0)) > 0, F.concat(short, F.lit(":L"), start.cast("string"), F.lit("-L"), end.cast("string"))).otherwise(short)
