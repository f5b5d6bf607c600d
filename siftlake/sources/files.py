"""Scans of file trees: Markdown, source code, images, PDF and other documents.

Files are read by Spark's binaryFile source, in parallel over the tree; size limits and endings are filters on the file
listing, so the contents of what is left out are not read. Folders whose name begins with a dot are never entered.
"""

from __future__ import annotations

import fnmatch
import os
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import languages
from siftlake.operators.filters import glob_pattern

MB = 1 << 20
# fixed values: the largest file of each kind
LIMITS = {"markdown": 50 * MB, "code": 5 * MB, "image": 100 * MB, "pdf": 500 * MB, "document": 500 * MB}
ENDINGS = {"markdown": ["md", "markdown"], "code": list(languages.EXTENSIONS), "image": languages.IMAGE_EXTENSIONS, "pdf": ["pdf"], "document": languages.DOCUMENT_EXTENSIONS}
TEXT_KINDS = ("markdown", "code")
TITLE_LINES = 20


def ignore_patterns(text: str) -> list[str]:
    """Regular expressions for paths below the root from an ignore file: names, paths with * and ?, and folders.

    Comments and blank lines are dropped, as is one slash at the end. There is no negation, no ** and no anchoring.
    """
    out = []
    for line in text.splitlines():
        rule = line.strip()
        if rule and not rule.startswith("#"):
            rule = rule.removesuffix("/")
            body = fnmatch.translate(rule).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")
            body = body.replace(".*", "[^/]*")
            out.append(f"^(?:.*/)?{body}$|^{body}/.*$" if "/" not in rule else f"^{body}$|^{body}/.*$")
    return out


def markdown_title(content: Column, path: Column) -> Column:
    """The first of the first twenty lines that is a heading of level one, else the name of the file."""
    head = F.filter(F.slice(F.split(content, "\n"), 1, TITLE_LINES), lambda x: F.trim(x).startswith("# "))
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.trim(F.substring(F.trim(F.get(head, F.lit(0))), 3, 1 << 30)), F.lit("")), stem)


def _no_zero_byte(content: Column) -> Column:
    """No zero byte among the first 1024: pairs of hex digits are looked at one by one."""
    return ~F.hex(F.substring(content, 1, 1024)).rlike("^(?:..)*00")


def scan(spark: SparkSession, root: str, kind: str, pattern: str = "") -> DataFrame:
    """(path, rel_path, title, content, content_hash, mtime, line_count, size) of the files of a kind below `root`.

    A pattern that is not empty holds for the name of a file (for source code also its ending must be known). content is null
    for images, PDF and other documents, whose text an extractor reads. A root that does not exist is an error, so that an
    unmounted folder is never taken for an empty one.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    base = fs.makeQualified(path).toString().rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # Spark reads no file without bytes; such files are known by name alone, without a time, and must not look deleted
    names = spark.createDataFrame([(n,) for n in read.inputFiles()], "path string")
    plain = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "%20", " ").alias("path")
    empty = names.select(plain).join(read.select(plain), "path", "left_anti").select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    files = read.filter(F.col("length") <= LIMITS[kind]).unionByName(empty)
    full = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), r"%20", " ")
    rel = F.substring(full, len(re.sub(r"^file:/+", "/", base)) + 2, 1 << 30)
    named = files.select(full.alias("path"), rel.alias("rel_path"), F.substring_index(rel, "/", -1).alias("name"), "modificationTime", "length", F.col("content").alias("raw"))
    kept = named.filter(languages.extension(F.col("name")).isin(*ENDINGS[kind]) if kind != "markdown" or not pattern else F.lit(True))
    if pattern:
        kept = kept.filter(F.col("name").rlike(glob_pattern(pattern)))
    if kind == "code":
        folders = F.slice(F.split("rel_path", "/"), 1, F.greatest(F.size(F.split("rel_path", "/")) - 1, F.lit(0)))
        kept = kept.filter(~F.exists(folders, lambda d: d.isin(*languages.IGNORED_FOLDERS) | d.startswith("."))).filter(~F.col("name").isin(*languages.IGNORED_FILES))
        for ending in languages.IGNORED_ENDINGS:
            kept = kept.filter(~F.col("name").endswith(ending))
        own = spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(root, ".gitignore"))
        if fs.exists(own):
            stream = fs.open(own)
            try:
                for rule in ignore_patterns(bytes(stream.readAllBytes()).decode("utf-8", "replace")):
                    kept = kept.filter(~F.col("rel_path").rlike(rule))
            finally:
                stream.close()
        kept = kept.filter(_no_zero_byte(F.col("raw")))
    text = F.decode("raw", "utf-8") if kind in TEXT_KINDS else F.lit(None).cast("string")
    title = markdown_title(text, F.col("path")) if kind == "markdown" else F.col("rel_path") if kind == "code" else F.col("name")
    lines = languages.line_count(text) if kind in TEXT_KINDS else F.lit(0)
    return kept.select("path", "rel_path", title.alias("title"), text.alias("content"), F.sha2("raw", 256).alias("content_hash"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), lines.cast("int").alias("line_count"), F.col("length").alias("size"))


def save_images(images: DataFrame, folder: str, data: str = "data", name: str = "name") -> DataFrame:
    """(name, path) of binary columns written as files to a folder that all executors share."""

    def run(batches):
        import pyarrow as pa

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            paths = []
            for n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = os.path.join(folder, os.path.basename(n or "unnamed"))
                with open(at, "wb") as f:
                    f.write(raw or b"")
                paths.append(at)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], ["name", "path"])

    return images.select(F.col(name).alias("name"), F.col(data).alias("data")).mapInArrow(run, "name string, path string")
