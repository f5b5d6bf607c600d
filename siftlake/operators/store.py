"""A document store as versioned Parquet tables: every change is a new version that becomes current at once or not at all.

A version is a manifest (table name -> folder); tables that a change does not touch keep their folder. The pointer to the
current manifest is written beside and renamed, so readers see the old state or the new one, and a job that dies leaves the
old one. Changes are joins: an upsert is a full outer join, a deletion an anti join.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import lexical

SCHEMAS = {
    "collections": "collection_id long, name string, coll_type string, path string, pattern string, parser_name string, parser_version int, backend string, created_at timestamp, updated_at timestamp",
    "documents": "doc_id long, collection_id long, path string, title string, content string, content_hash string, mtime double, line_count int, created_at timestamp, updated_at timestamp",
    "chunks": "chunk_id long, doc_id long, seq int, content string, chunk_type int, image_path string, start_line int, end_line int, embedding array<float>, created_at timestamp",
    "fields": "doc_id long, field string, value string",
}


def document_id(collection_id: Column, path: Column) -> Column:
    """The same id for the same path of the same collection, without a counter."""
    return F.xxhash64(collection_id, path)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions

    def version(self) -> int:
        at = self._path(f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{version:09d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of the current version, or of an earlier one."""
        at = self._manifest(self.version() if version is None else version).get(table)
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.folder}/{at}") if at else self.spark.createDataFrame([], SCHEMAS[table])

    def commit(self, **tables: DataFrame) -> int:
        """Write these tables and make them current together; the number of the version. Fails if another writer was first."""
        base = self.version()
        manifest = dict(self._manifest(base))
        for name, rows in tables.items():
            kinds = SCHEMAS[name]
            at = f"tables/{name}-{uuid.uuid4().hex}"
            rows.select(*[F.col(c.split()[0]).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in kinds.split(", ")]).write.parquet(f"{self.folder}/{at}")
            manifest[name] = at
        beside, final = (self._path(f"{self.folder}/manifests/{n}") for n in (f"_{uuid.uuid4().hex}", f"{base + 1:09d}"))
        stream = self._fs.create(beside, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(beside, final):
            raise RuntimeError(f"version {base + 1} exists: another writer changed the store")
        return base + 1

    # --- collections

    def create_collection(self, name: str, coll_type: str, path: str, pattern: str = "", parser_name: str | None = None, backend: str | None = None) -> int:
        """The id of the collection of that name, created if there is none."""
        known = self.read("collections").filter(F.col("name") == name).select("collection_id").head()
        if known:
            return known[0]
        cid = uuid.uuid5(uuid.NAMESPACE_URL, name).int >> 65
        now = F.current_timestamp()
        row = self.spark.range(1).select(F.lit(cid).alias("collection_id"), F.lit(name).alias("name"), F.lit(coll_type).alias("coll_type"), F.lit(path).alias("path"), F.lit(pattern).alias("pattern"), F.lit(parser_name).alias("parser_name"), F.lit(0).alias("parser_version"), F.lit(backend).alias("backend"), now.alias("created_at"), now.alias("updated_at"))
        self.commit(collections=self.read("collections").unionByName(row))
        return cid

    def collection(self, name: str) -> DataFrame:
        return self.read("collections").filter(F.col("name") == name)

    def collections(self) -> DataFrame:
        return self.read("collections").orderBy("name")

    def delete_collection(self, name: str) -> int:
        """The collection with its documents, chunks and fields."""
        gone = self.collection(name).select("collection_id")
        docs = self.read("documents").join(gone, "collection_id", "left_semi").select("doc_id")
        return self.commit(collections=self.read("collections").join(gone, "collection_id", "left_anti"), **self._without(docs))

    # --- documents

    def _without(self, ids: DataFrame) -> dict[str, DataFrame]:
        gone = ids.select("doc_id").distinct()
        return {t: self.read(t).join(gone, "doc_id", "left_anti") for t in ("documents", "chunks", "fields")}

    def delete_documents(self, ids: DataFrame) -> int:
        return self.commit(**self._without(ids))

    def upserted(self, docs: DataFrame) -> DataFrame:
        """The documents table after taking in `docs` (collection_id, path, ...); a known path keeps its id and created_at."""
        old = self.read("documents")
        new = docs.select("collection_id", "path", *[F.col(c).alias(f"_{c}") if c in docs.columns else F.lit(None).alias(f"_{c}") for c in ("title", "content", "content_hash", "mtime", "line_count")], F.lit(True).alias("_new"))
        both = old.join(new, ["collection_id", "path"], "full_outer")
        pick = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        now = F.current_timestamp()
        return both.select(F.coalesce("doc_id", document_id(F.col("collection_id"), F.col("path"))).alias("doc_id"), "collection_id", "path", *[pick(c) for c in ("title", "content", "content_hash", "mtime", "line_count")], F.coalesce("created_at", now).alias("created_at"), F.when(F.col("_new"), now).otherwise(F.col("updated_at")).alias("updated_at"))

    def upsert(self, docs: DataFrame, chunks: DataFrame | None = None, fields: DataFrame | None = None) -> int:
        """Documents with their chunks (doc_id, seq, content, ...) and fields (doc_id, field, value), which replace those they had."""
        table = self.upserted(docs)
        ids = docs.select(document_id(F.col("collection_id"), F.col("path")).alias("_fresh"), "collection_id", "path").join(self.read("documents").select("collection_id", "path", "doc_id"), ["collection_id", "path"], "left").select(F.coalesce("doc_id", "_fresh").alias("doc_id"))
        changed = {"documents": table}
        for name, rows in (("chunks", chunks), ("fields", fields)):
            if rows is not None:
                missing = [c.split(" ", 1) for c in SCHEMAS[name].split(", ") if c.split()[0] not in rows.columns and c.split()[0] != "chunk_id"]
                full = rows.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in missing])
                if name == "chunks" and "chunk_id" not in rows.columns:
                    full = full.withColumn("chunk_id", F.xxhash64("doc_id", "seq"))
                changed[name] = self.read(name).join(ids, "doc_id", "left_anti").unionByName(full.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]))
        return self.commit(**changed)

    def append_text(self, additions: DataFrame, chunks: DataFrame | None = None) -> int:
        """Text (doc_id, text) added to documents on a new line; title kept; chunks numbered on from the document's last."""
        more = additions.select("doc_id", F.col("text").alias("_text"))
        docs = self.read("documents").join(more, "doc_id", "left").withColumn("content", F.concat_ws("\n", "content", "_text")).drop("_text")
        changed = {"documents": docs}
        if chunks is not None:
            last = self.read("chunks").groupBy("doc_id").agg(F.max("seq").alias("_last"))
            numbered = chunks.join(last, "doc_id", "left").withColumn("seq", F.col("seq") + F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_last")
            missing = [c.split(" ", 1) for c in SCHEMAS["chunks"].split(", ") if c.split()[0] not in numbered.columns and c.split()[0] != "chunk_id"]
            full = numbered.select("*", F.xxhash64("doc_id", "seq").alias("chunk_id"), *[F.lit(None).cast(kind).alias(c) for c, kind in missing])
            changed["chunks"] = self.read("chunks").unionByName(full.select(*[c.split()[0] for c in SCHEMAS["chunks"].split(", ")]))
        return self.commit(**changed)

    def update(self, table: str, changes: DataFrame, key: str) -> int:
        """Columns of `changes` that are not null replace those of the rows of the same key: times, parser versions, embeddings."""
        given = [c for c in changes.columns if c != key]
        joined = self.read(table).join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in given]), key, "left")
        return self.commit(**{table: joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in self.read(table).columns])})

    # --- fast fields

    def set_fields(self, fields: DataFrame) -> int:
        """(doc_id, field, value), in place of what these fields held."""
        kept = self.read("fields").join(fields.select("doc_id", "field"), ["doc_id", "field"], "left_anti")
        return self.commit(fields=kept.unionByName(fields.select("doc_id", "field", "value")))

    def fields_of(self, ids: DataFrame) -> DataFrame:
        """(doc_id, fields): all fields of each of these documents; empty for those without."""
        maps = self.read("fields").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
        return ids.select("doc_id").distinct().join(maps, "doc_id", "left").select("doc_id", F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"))

    def delete_fields(self, ids: DataFrame, field: str | None = None) -> int:
        gone = ids.select("doc_id").distinct()
        mine = self.read("fields")
        kept = mine.join(gone, "doc_id", "left_anti")
        return self.commit(fields=kept if field is None else kept.unionByName(mine.join(gone, "doc_id", "left_semi").filter(F.col("field") != field)))

    # --- indexes

    def build_index(self) -> lexical.Index:
        """The lexical index of the current documents, stored beside the version it was built of."""
        at = f"{self.folder}/index/{self.version():09d}"
        lexical.build_index(self.read("documents"), content="content").save(at)
        return lexical.Index.load(self.spark, at)

    def load_index(self) -> lexical.Index:
        """The index of the current version; built if there is none or it is not whole."""
        at = f"{self.folder}/index/{self.version():09d}"
        whole = all(self._fs.exists(self._path(f"{at}/{part}/_SUCCESS")) for part in ("postings", "lengths"))
        return lexical.Index.load(self.spark, at) if whole else self.build_index()


def rebuilt_text(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, title, content) of every document from its chunks in order, one per line; empty for one without chunks."""
    texts = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "\n").alias("_text"))
    return docs.join(texts, "doc_id", "left").select("doc_id", "title", F.coalesce("_text", F.lit("")).alias("content"))
