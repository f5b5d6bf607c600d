"""The engine over one store: adding collections, syncing, embedding and searching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import chunks, embed, facets, filters, fusion, lexical, sync, vector
from siftlake.operators.store import Store, document_id
from siftlake.sources import extract, files, schemas


class Engine:
    def __init__(self, spark: SparkSession, folder: str, embedder: embed.Embedder | None = None, schema_folder: str | None = None):
        self.spark, self.store, self.schema_folder = spark, Store(spark, folder), schema_folder
        self.embedder = embedder or embed.hashing_embedder(64)

    def add(self, name: str, coll_type: str, path: str, pattern: str = "", parser: str | None = None) -> dict[str, int]:
        """Create a collection and sync it; one that exists is only synced."""
        self.store.create_collection(name, coll_type, path, pattern, parser)
        return self.sync(name)

    def remove(self, name: str) -> None:
        self.store.delete_collection(name)

    def _scanned(self, c) -> DataFrame:
        """What a collection's source holds now, as documents."""
        if c.coll_type == "parser":
            found = schemas.read_source(self.spark, schemas.load(c.parser_name, self.schema_folder))
            if found is None:
                raise FileNotFoundError(f"no source of {c.parser_name} is present")
            sessions, messages = found
            talk = sync.transcript(messages)
            rows = sessions.join(talk, "session_id")
            return rows.select(F.col("src_path").alias("path"), sync.session_title(F.col("title"), F.col("title_text"), F.col("session_id")).alias("title"), F.col("transcript").alias("content"), F.sha2("transcript", 256).alias("content_hash"), F.col("cursor_ms").cast("double").alias("mtime"), F.col("n_messages").cast("int").alias("line_count"), sync.session_fields(F.col("workspace"), F.col("parent")).alias("fields"))
        rows = files.scan(self.spark, c.path, c.coll_type, c.pattern or "")
        if c.coll_type == "document":
            raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(c.path).select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), F.col("content").alias("data"))
            texts = extract.extract(rows.select("path", F.col("title").alias("name")).join(raw, "path"), data="data")
            rows = rows.drop("content").join(texts.select("path", F.col("text").alias("content")), "path", "left")
        fields = sync.code_fields(F.col("path"), c.path) if c.coll_type == "code" else F.create_map().cast("map<string,string>")
        return rows.select("path", "title", "content", "content_hash", "mtime", "line_count", fields.alias("fields"))

    def sync(self, name: str) -> dict[str, int]:
        """Bring a collection up to its source in one version of the store; how many documents each action befell."""
        c = self.store.collection(name).head()
        if c is None:
            raise KeyError(f"there is no collection {name}")
        scan = self._scanned(c).withColumn("collection_id", F.lit(c.collection_id).cast("long")).cache()
        held = self.store.read("documents").filter(F.col("collection_id") == c.collection_id)
        actions = sync.sync_actions(scan, held, c.coll_type).cache()
        counts = {r.action: r["count"] for r in actions.groupBy("action").count().collect()}
        changed = scan.join(actions.filter("action IN ('insert', 'update')"), ["collection_id", "path"], "left_semi")
        gone = held.join(actions.filter("action = 'delete'"), ["collection_id", "path"], "left_semi").select("doc_id")
        if counts.get("delete"):
            self.store.delete_documents(gone)
        if counts.get("insert") or counts.get("update"):
            keyed = changed.withColumn("doc_id", document_id(F.col("collection_id"), F.col("path")))
            pieces = chunks.chunk_documents(keyed.select("doc_id", "content"), c.coll_type, text="content") if c.coll_type in chunks.CHUNKERS else None
            fields = keyed.select("doc_id", F.explode("fields").alias("field", "value"))
            self.store.upsert(changed, pieces, fields)
        if counts.get("touch"):
            touched = scan.join(actions.filter("action = 'touch'"), ["collection_id", "path"], "left_semi").join(held.select("collection_id", "path", "doc_id"), ["collection_id", "path"])
            self.store.update("documents", touched.select("doc_id", "mtime"), "doc_id")
        scan.unpersist()
        actions.unpersist()
        return counts

    def embed(self, force: bool = False) -> None:
        embed.embed_pending(self.store, self.embedder, force)

    def documents(self) -> DataFrame:
        """Documents with collection, type and their fast fields lang and workspace."""
        docs = filters.with_collections(self.store.read("documents"), self.store.read("collections"))
        own = self.store.read("fields").filter(F.col("field").isin("lang", "workspace")).groupBy("doc_id").pivot("field", ["lang", "workspace"]).agg(F.first("value"))
        return docs.join(own, "doc_id", "left")

    def search(self, query: str, mode: str = "hybrid", limit: int = fusion.CLI_LIMIT, narrowed: filters.FilterSet | None = None, query_mode: str = "structured", language: str = "en", sort_by: str | None = None, descending: bool = False, context: int = 0, rerank=None) -> DataFrame:
        """The best documents: doc_id, score, collection, title, path, the place and a line of its best chunk.

        Both branches see the filters. Sorting by a field and context come after ranking.
        """
        limit = fusion.limit_of(limit, fusion.CLI_LIMIT)
        docs = self.documents()
        within = (narrowed or filters.FilterSet()).apply(docs)
        pieces = self.store.read("chunks").join(within.select("doc_id"), "doc_id", "left_semi")
        n = fusion.candidates_of(limit, rerank is not None)
        near = vector.nearest(pieces.select("doc_id", "chunk_id", "seq", "embedding"), self.embedder([query])[0], n) if mode != "lexical" else None
        if mode == "vector":
            found = near.groupBy("doc_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)
        else:
            words = lexical.search(self.store.load_index(), query, n, within, mode=query_mode, language=language)
            found = fusion.hybrid(words, near, limit, rerank=rerank)
        found = fusion.with_rank(found, F.desc("score"), "doc_id")
        best = pieces.groupBy("doc_id").agg(F.min_by(F.struct("seq", "content", "start_line", "end_line"), F.col("seq")).alias("c"))
        if near is not None:
            hit = near.groupBy("doc_id").agg(F.max_by("seq", "score").alias("hit"))
            best = pieces.join(hit, "doc_id").filter("seq = hit").groupBy("doc_id").agg(F.first(F.struct("seq", "content", "start_line", "end_line")).alias("c2")).join(best, "doc_id", "full_outer").select("doc_id", F.coalesce("c2", "c").alias("c"))
        rows = found.join(docs, "doc_id").join(best, "doc_id", "left").select("doc_id", "score", "rank", "collection", "title", "path", "line_count", "created_at", "lang", "workspace", F.col("c.seq").alias("seq"), F.col("c.content").alias("content"), F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"))
        if context > 0:
            wide = chunks.with_context(rows.select("doc_id", "seq"), pieces, context)
            rows = rows.drop("content", "start_line", "end_line").join(wide.select("doc_id", F.col("context").alias("content"), F.col("from_line").alias("start_line"), F.col("to_line").alias("end_line")), "doc_id", "left")
        shown = rows.withColumn("location", filters.location(F.col("path"), F.col("start_line"), F.col("end_line"))).withColumn("line", filters.shown_text(F.col("content"), context))
        order = F.col("rank") if sort_by is None else F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_last()
        return shown.orderBy(order, "rank")

    def facets(self, specs: list[str], results: DataFrame | None = None) -> dict[str, DataFrame]:
        """Facets over all documents, or over search results."""
        return facets.facets(self.documents() if results is None else results, specs)

    def complete(self, prefix: str, most: int = 10) -> DataFrame:
        return lexical.completions(lexical.vocabulary(self.store.load_index()), prefix, most)

    def status(self) -> DataFrame:
        return sync.statistics(self.store.read("documents"), self.store.read("chunks"), self.store.read("collections")).orderBy("name")


__all__ = ["Engine"]
