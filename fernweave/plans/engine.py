"""Two facades over the operators: documents and what is asked of them, and memories of conversations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigurationError, DuplicateSourceError, EmptyDocumentError, InputError, MemoryNotFoundError, SourceNotFoundError
from ..functions import text as T
from ..operators import assemble, chunking, evaluate, graph, manage, search
from ..operators import memory as mem
from ..plugins import Embeddings, ExtractiveGenerator, Extractor, Generator, Reranker, SparseEmbeddings, embedded, model_name, reranked, sparse_embedded
from ..sources.snapshots import SnapshotTable
from .config import INGEST_CHARS, ROUTING, ChunkingConfig, MemoryConfig, RetrievalConfig, RoutingConfig, checked_metadata, checked_query


class KnowledgeEngine:
    """Sources, chunks, entities and relations as snapshot tables under one path; queries as plans over them.

    ``retrieve_batch`` answers any frame of queries in one plan; the single-query methods are a batch of one.
    """

    def __init__(self, spark: SparkSession, path: str, embeddings: Embeddings | None = None, retrieval: RetrievalConfig | None = None, routing: RoutingConfig | None = None, chunks: ChunkingConfig | None = None, reranker: Reranker | None = None, generator: Generator | None = None, sparse: SparseEmbeddings | None = None, extractor: Extractor | None = None):
        self.spark, self.embeddings, self.reranker, self.sparse, self.extractor = spark, embeddings, reranker, sparse, extractor
        self.retrieval, self.routing, self.chunking = retrieval or RetrievalConfig(), routing or RoutingConfig(), chunks or ChunkingConfig()
        self.generator = generator or ExtractiveGenerator()
        self.sources = SnapshotTable(spark, f"{path}/sources", ["source_id"])
        self.chunks = SnapshotTable(spark, f"{path}/chunks", ["chunk_id"], ["source_id"], ["knowledge_id"])
        self.entities = SnapshotTable(spark, f"{path}/entities", ["entity_id"])
        self.relations = SnapshotTable(spark, f"{path}/relations", ["from_id", "relation_type", "to_id", "source_id"])

    # --- ingest ---------------------------------------------------------------------------------------------------

    def ingest(self, pages: DataFrame, knowledge_id: str, source_type: str = "document", metadata: dict[str, str] | None = None) -> DataFrame:
        """Pages (source_id, page_number, content) to chunks with headers and vectors; all of a call or nothing: sources
        are written last, and if that fails the chunks go back to what they were. Entities are optional: if their
        extractor fails, a note of the source says so. Contents that a source of the same knowledge base has already,
        or another one of the call, raise."""
        checked_metadata(metadata or {})
        if self.retrieval.source_weights and source_type not in self.retrieval.source_weights:
            raise ConfigurationError(f"no weight for source type {source_type!r}")
        pages = pages.filter(F.col("content").rlike(r"(?U)\S"))
        # A source's digest is that of its pages' digests in order: no source becomes one value.
        digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.sha2(F.col("content").cast("binary"), 256).alias("h")))), lambda x: x["h"]), "")
        new = pages.groupBy("source_id").agg(F.sha2(digests.cast("binary"), 256).alias("file_hash"), F.sum(F.size(T.tokens(F.col("content")))).cast("long").alias("estimated_tokens"), F.sum(F.length("content").cast("long")).alias("_n"))
        if new.isEmpty():
            raise EmptyDocumentError("no page with text")
        if not new.filter(F.col("_n") > INGEST_CHARS).isEmpty():
            raise InputError(f"a source has at most {INGEST_CHARS} characters")
        old = self.sources.read()
        if not new.groupBy("file_hash").count().filter("count > 1").isEmpty():
            raise DuplicateSourceError("two sources of this call have the same content")
        if old is not None and not old.filter(F.col("knowledge_id") == knowledge_id).join(new, "file_hash", "left_semi").isEmpty():
            raise DuplicateSourceError("a source with this content is there already")
        c = self.chunking
        rows = chunking.numbered(chunking.chunks(pages, c.size, c.overlap, c.parent_size)).withColumns({"knowledge_id": F.lit(knowledge_id), "source_type": F.lit(source_type)})
        header = T.context_header(F.col("source_id").cast("string"), F.col("source_type"), F.col("page_number"), F.col("section"))
        rows = rows.withColumn("embedding_text", F.concat(header, F.lit("\n\n"), F.col("content")))
        rows = self._with_vectors(rows)
        note = self._ingest_entities(pages, knowledge_id) if self.extractor else None
        done = new.drop("_n").withColumns({"knowledge_id": F.lit(knowledge_id), "source_type": F.lit(source_type), "embedding_model": F.lit(model_name(self.embeddings) if self.embeddings else ""), "stale": F.lit(False), "status": F.lit("completed"), "note": F.lit(note).cast("string"), "created_at": F.current_timestamp()})
        before = self.chunks.current()
        self.chunks.upsert(rows)
        try:
            self.sources.upsert(done)
        except Exception:
            self.chunks.restore(before) if before else self.chunks.forget()
            raise
        return self.sources.read().filter(F.col("knowledge_id") == knowledge_id)

    def _with_vectors(self, rows: DataFrame) -> DataFrame:
        """Vectors, and the terms that keyword search counts: cut once here, not by every query."""
        rows = rows.withColumn("terms", T.tokens(F.coalesce("content", F.lit(""))))
        rows = embedded(rows, self.embeddings, "embedding_text") if self.embeddings else rows.withColumn("embedding", F.lit(None).cast("array<float>"))
        return sparse_embedded(rows, self.sparse, "embedding_text") if self.sparse else rows.withColumn("sparse", F.lit(None).cast("array<struct<idx:int,val:double>>"))

    def add_chunks(self, rows: DataFrame) -> None:
        """Rows that are chunks already, with their ``embedding_text``; whoever calls commits the sources."""
        self.chunks.upsert(self._with_vectors(rows))

    def _ingest_entities(self, pages: DataFrame, knowledge_id: str) -> str | None:
        """What the extractor (a text to dicts of name, type, category, value) finds on the pages; a note if it fails."""
        extract = self.extractor.extract

        @F.pandas_udf("array<struct<name:string,entity_type:string,category:string,value:string>>")
        def found(texts):
            return texts.map(lambda x: [{"name": e["name"], "entity_type": e.get("type") or "entity", "category": e.get("category"), "value": e.get("value")} for e in extract(x) if e.get("name")])

        try:
            rows = pages.select("source_id", "page_number", F.posexplode(found("content")).alias("n", "e")).select("e.*", F.col("source_id").cast("string").alias("source_id"), F.lit(knowledge_id).alias("knowledge_id"), F.struct("source_id", "page_number", "n").alias("seq"))
            self.add_entities(rows)
        except Exception as e:
            return f"entities:warn:{type(e).__name__}"
        return None

    def add_entities(self, rows: DataFrame) -> None:
        """Rows (name, entity_type, category, value, knowledge_id, source_id, seq). Of an entity that is there already the
        name, type and category stay, a new value wins, and sources add up."""
        new, old = graph.merged_entities(rows), self.entities.read()
        if old is not None:
            was = old.select("entity_id", *[F.col(c).alias(f"_{c}") for c in ("name", "entity_type", "category", "value", "source_ids")])
            new = new.join(was, "entity_id", "left")
            none = F.array().cast("array<string>")
            new = new.select("entity_id", *[F.coalesce(f"_{c}", c).alias(c) for c in ("name", "entity_type", "category")], F.coalesce("value", "_value").alias("value"), "knowledge_id", F.array_sort(F.array_union(F.coalesce("_source_ids", none), "source_ids")).alias("source_ids"))
        self.entities.upsert(new)

    def add_relations(self, rows: DataFrame) -> None:
        """Rows (from_name, from_type, to_name, to_type, relation_type, knowledge_id, source_id, context, seq); those with an
        end that is no entity are left out, a type that isn't allowed raises."""
        known = self.entities.read()
        if known is None:
            return
        end = lambda side: T.entity_id(F.col(f"{side}_name"), F.col(f"{side}_type"), F.col("knowledge_id")).alias(f"{side}_id")
        kind = T.relation_type(F.col("relation_type"), graph.RELATION_TYPES).alias("relation_type")
        self.relations.upsert(graph.resolved_edges(rows.select(end("from"), end("to"), kind, "source_id", "context", "seq"), known))

    def ingest_text(self, source_id: str, text: str, knowledge_id: str) -> DataFrame:
        return self.ingest(self.spark.createDataFrame([(source_id, 1, text)], "source_id string, page_number int, content string"), knowledge_id)

    def remove(self, source_id: str) -> int:
        """How many chunks went."""
        if not self.sources.delete(source_id=source_id):
            raise SourceNotFoundError(source_id)
        entities, relations = self.entities.read(), self.relations.read()
        if entities is not None:
            none = self.spark.createDataFrame([], "from_id string, relation_type string, to_id string, source_id string, context string")
            kept, edges = graph.without_source(entities, relations if relations is not None else none, str(source_id))
            self.entities.replace(kept)
            if relations is not None:
                self.relations.replace(edges.select(*relations.columns))
        return self.chunks.delete(source_id=source_id)

    def mark_stale(self) -> int:
        d = self.sources.read()
        if d is None or not self.embeddings:
            return 0
        now = manage.marked_stale(d, model_name(self.embeddings))
        n = now.filter("stale").count() - d.filter("stale").count()
        if n:
            self.sources.upsert(now)
        return n

    # --- queries --------------------------------------------------------------------------------------------------

    def _lists(self, chunks: DataFrame, queries: DataFrame, knowledge_id: str | None, fetch: int) -> dict[str, tuple[DataFrame, float, DataFrame]]:
        """By name of a search that is on: hits (query_id, chunk_id, score, rank), its weight, and what its ids stand for
        (chunk_id, source_id, source_type, page_number, section, content; with query_id where that depends on it)."""
        r, out = self.retrieval, {}
        shown = ["chunk_id", "source_id", "source_type", "page_number", "section", "content"]
        if self.embeddings and r.dense_weight:
            asked = embedded(queries, self.embeddings, "query", "qvec").select("query_id", "qvec")
            hits = search.dense_top_k(chunks, asked, fetch, "chunk_id")
            if self.sparse:
                model = self.sparse
                rows = [(q.query_id, i, v) for q in queries.collect() for i, v in model.embed_sparse_query(q.query)]  # the queries' own terms
                terms = self.spark.createDataFrame(rows, f"query_id {queries.schema['query_id'].dataType.simpleString()}, term int, qweight double")
                held = chunks.select("chunk_id", F.explode("sparse").alias("x")).select("chunk_id", F.col("x.idx").alias("term"), F.col("x.val").alias("weight"))
                lists = [(hits, 1.0), (search.top_k(search.sparse_scores(held, terms, "chunk_id"), fetch, "chunk_id"), 1.0)]
                hits = search.top_k(search.fused(lists, "chunk_id"), fetch, "chunk_id").drop("first_seen")
            # After the cut: parents among the hits take their places, but aren't shown.
            hits = chunks.select("chunk_id", "chunk_type", "parent_id").join(F.broadcast(hits), "chunk_id").filter("chunk_type = 'child'")
            content = chunks.select(*shown)
            if r.expand_parents and self.chunking.parent_size:
                kids = hits.select("query_id", F.col("chunk_id").alias("point_id"), "score", "rank", "parent_id")
                parents = chunks.filter("chunk_type = 'parent'")
                merged = search.expanded_parents(kids, parents.select(F.col("chunk_id").alias("point_id")))
                w = Window.partitionBy("query_id").orderBy("tier", "rank")
                hits = merged.select("query_id", F.coalesce("parent_id", "point_id").alias("chunk_id"), "score", F.row_number().over(w).alias("rank"))
            else:
                hits = hits.select("query_id", "chunk_id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank"))
            out["semantic"] = (hits, r.dense_weight, content)
        if r.keyword_weight:
            hits = search.top_k(search.bm25_scores(chunks, queries, "chunk_id", "content", stored="terms"), fetch, "chunk_id")
            out["keyword"] = (hits, r.keyword_weight, chunks.select(*shown))
        entities = self.entities.read()
        if r.entity_weight and entities is not None:
            relations = self.relations.read()
            if relations is None:
                relations = self.spark.createDataFrame([], "from_id string, relation_type string, to_id string, source_id string")
            found = graph.entity_results(entities, relations, graph.seeds(entities, queries, fetch, None, knowledge_id), r.entity_hops)
            null = lambda kind: F.lit(None).cast(kind)
            content = found.select("query_id", "chunk_id", F.lit("").alias("source_id"), null("string").alias("source_type"), null("int").alias("page_number"), null("string").alias("section"), "content")
            out["entity"] = (found.select("query_id", "chunk_id", "score", "rank"), r.entity_weight, content)
        return out

    def retrieve_batch(self, queries: DataFrame, knowledge_id: str | None = None, top_k: int | None = None, min_score: float | None = None, trace: dict[str, DataFrame] | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank, source_id, page_number, section, content). Of a query that a single search
        answers that one's scores stay; of one that several answer they are fused, and no longer similarities. Sources'
        weights, if there are any, multiply either. ``trace`` is filled with each search's list and the fused one."""
        k = top_k or self.retrieval.top_k
        chunks = self.chunks.read()
        if chunks is None:
            raise SourceNotFoundError("nothing ingested yet")
        chunks = chunks.filter(F.col("knowledge_id") == knowledge_id) if knowledge_id else chunks
        queries = queries.filter(F.col("query").rlike(r"(?U)\S"))
        fetch = k * search.OVER_FETCH
        lists = self._lists(chunks, queries, knowledge_id, fetch)
        if not lists:
            raise InputError("no kind of search is on")
        weights = self.retrieval.source_weights
        weigh = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source_type")], F.lit(1.0)) if weights else F.lit(1.0)
        shown = ["chunk_id", "source_id", "page_number", "section", "content"]
        parts, contents = [], []
        for name, (hits, weight, content) in lists.items():
            on = ["query_id", "chunk_id"] if "query_id" in content.columns else ["chunk_id"]
            # Hits are fetch rows a query: of a block of queries what is broadcast.
            full = content.join(F.broadcast(hits), on)
            parts.append((full.select("query_id", "chunk_id", "rank", "score", weigh.alias("source_weight")), weight))
            contents.append(full.select("query_id", *[F.col(c).cast("string") if c == "source_id" else F.col(c) for c in shown]))
            if trace is not None:
                trace[name] = hits
        merged = search.fused_or_raw(parts, "chunk_id")
        if trace is not None:
            trace["fused"] = merged
        content = reduce(DataFrame.unionByName, contents).dropDuplicates(["query_id", "chunk_id"])
        if self.reranker:
            best = search.top_k(merged, fetch, "chunk_id").select("query_id", "chunk_id")
            top = reranked(content.join(best, ["query_id", "chunk_id"]).join(F.broadcast(queries), "query_id"), self.reranker, k)
        else:
            top = search.top_k(merged, k, "chunk_id").drop("first_seen")
        out = content.join(top, ["query_id", "chunk_id"])
        out = out.filter(F.col("score") >= min_score) if min_score is not None else out
        if trace is not None:
            trace["final"] = out
        return out

    def retrieve(self, query: str, history: list[tuple[str, str]] | None = None, **how) -> DataFrame:
        """``history``: (role, text) of the turns before; what the user said in the last of them goes with the query."""
        said = [t for role, t in (history or [])[-self.retrieval.history_window :] if role == "user" and t.strip()]
        asked = checked_query(query) + (f"\n\nConversation context: {' '.join(said)}" if said else "")
        return self.retrieve_batch(self.spark.createDataFrame([(1, asked)], "query_id int, query string"), **how).orderBy("rank")

    def trace(self, entity_name: str, hops: int = 2, types: list[str] | None = None, knowledge_id: str | None = None) -> DataFrame:
        """The trails from the entities that answer to a name, as text; only over relations of the given types."""
        entities, relations = self.entities.read(), self.relations.read()
        if entities is None or relations is None or not entity_name.strip():
            return self.spark.createDataFrame([], "query_id int, chunk_id string, score double, rank int, content string, connected_count int")
        q = self.spark.createDataFrame([(1, entity_name)], "query_id int, query string")
        return graph.entity_results(entities, relations, graph.seeds(entities, q, 10, None, knowledge_id), hops, types)

    def query(self, query: str, knowledge_id: str | None = None, ordering: str = "score_desc", threshold: float | None = None, **how) -> dict:
        """An answer with its mode and sources. The context of one query is a few chunks, or, in direct mode, a
        corpus of at most the routing's largest threshold; a larger one raises."""
        mode = self.mode(knowledge_id)
        if mode == "direct":
            if self._tokens(knowledge_id) > ROUTING[1]:
                raise InputError(f"more than {ROUTING[1]} tokens: too many for direct mode")
            chunks = self.chunks.read()
            row = None
            if chunks is not None:
                chunks = chunks.filter("chunk_type = 'child'")
                chunks = chunks.filter(F.col("knowledge_id") == knowledge_id) if knowledge_id else chunks
                row = assemble.direct_corpus(chunks.withColumn("_all", F.lit(1)), "source_id", "source_id", "chunk_index", "content", ["_all"]).first()
            return {"mode": mode, "answer": self.generator.generate(f"{row.corpus if row else ''}\n{query}"), "sources": []}
        hits = self.retrieve(query, knowledge_id=knowledge_id, **how)
        found = hits.collect()  # at most top_k rows
        if not found or (threshold is not None and max(h.score for h in found) < threshold):
            return {"mode": mode, "answer": None, "sources": []}
        text = assemble.context(hits, ordering, order_by=[F.asc("rank")]).first().context
        return {"mode": mode, "answer": self.generator.generate(f"{text}\n{query}"), "sources": sorted({h.source_id for h in found if h.source_id})}

    def query_stream(self, query: str, knowledge_id: str | None = None, **how):
        """The answer word by word, then its sources: a generator on the driver, for one reader."""
        got = self.query(query, knowledge_id, **how)
        if got["answer"] is None:
            yield {"event": "done", "sources": []}
            return
        for word in got["answer"].split(" "):
            yield {"event": "chunk", "text": word}
        yield {"event": "sources", "sources": got["sources"]}

    def _tokens(self, knowledge_id: str | None) -> int:
        d = self.sources.read()
        if d is None:
            return 0
        d = d.filter(F.col("knowledge_id") == knowledge_id) if knowledge_id else d
        return assemble.corpus_tokens(d, F.col("estimated_tokens"), F.lit(0)).first().tokens

    def mode(self, knowledge_id: str | None = None) -> str:
        """Direct or retrieval; where that is left open, direct for a corpus of at most the threshold, an empty one too."""
        if self.routing.mode != "auto":
            return self.routing.mode
        return "direct" if self._tokens(knowledge_id) <= self.routing.direct_threshold else "retrieval"

    def benchmark(self, cases: DataFrame) -> DataFrame:
        """Cases (case_id, query, reference): recall and precision of the retrieved content, as one report row."""
        hits = self.retrieve_batch(cases.select(F.col("case_id").alias("query_id"), "query"))
        full = hits.join(F.broadcast(cases.select(F.col("case_id").alias("query_id"), "reference")), "query_id").withColumnRenamed("query_id", "case_id")
        return evaluate.content_recall_precision(full).agg(F.count(F.lit(1)).alias("n_cases"), F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"))


def vector_only(spark: SparkSession, path: str, embeddings: Embeddings, **how) -> KnowledgeEngine:
    return KnowledgeEngine(spark, path, embeddings, RetrievalConfig(keyword_weight=0.0, entity_weight=0.0), **how)


def document_only(spark: SparkSession, path: str, **how) -> KnowledgeEngine:
    return KnowledgeEngine(spark, path, None, RetrievalConfig(keyword_weight=0.8, entity_weight=0.0), **how)


def hybrid(spark: SparkSession, path: str, embeddings: Embeddings, sparse: SparseEmbeddings, **how) -> KnowledgeEngine:
    """All searches: dense and sparse vectors (1.0), keywords (0.8), entities (0.7)."""
    return KnowledgeEngine(spark, path, embeddings, RetrievalConfig(dense_weight=1.0, keyword_weight=0.8, entity_weight=0.7), sparse=sparse, **how)


class Collections:
    """Engines by name; the first is the default."""

    def __init__(self, engines: dict[str, KnowledgeEngine]):
        if not engines:
            raise InputError("no collections")
        self.engines = engines

    def __getitem__(self, name: str | None) -> KnowledgeEngine:
        if name is None:
            return next(iter(self.engines.values()))
        if name not in self.engines:
            raise InputError(f"unknown collection {name!r}")
        return self.engines[name]


class MemoryEngine:
    """Facts drawn from conversations by an extractor (text of a conversation to facts), kept once each."""

    def __init__(self, spark: SparkSession, path: str, extract: Callable[[str], list[str]], embeddings: Embeddings | None = None, entities: Callable[[str], list[str]] | None = None, config: MemoryConfig | None = None):
        self.spark, self.extract, self.embeddings, self.entities, self.config = spark, extract, embeddings, entities, config or MemoryConfig()
        self.rows = SnapshotTable(spark, f"{path}/memories", ["memory_row_id"])

    def _indexed(self, rows: DataFrame) -> DataFrame:
        """With each text's vector and the names of its entities, as far as there are models for them."""
        rows = embedded(rows, self.embeddings) if self.embeddings else rows.withColumn("embedding", F.lit(None).cast("array<float>"))
        names = self.entities

        @F.pandas_udf("array<string>")
        def named(texts):
            return texts.map(lambda x: sorted({n.strip().lower() for n in names(x) if n.strip()}))

        return rows.withColumn("entities", named("text") if names else F.array().cast("array<string>"))

    def add(self, turns: DataFrame) -> int:
        """Conversations (memory_id, turn, role, text); how many new facts were stored."""
        extract = self.extract

        @F.pandas_udf("array<string>")
        def facts(texts):
            return texts.map(lambda x: [f for f in extract(x) if f.strip()])

        found = mem.interaction_text(turns, "memory_id").select("memory_id", F.posexplode(facts("interaction")).alias("n", "text"))
        old = self.rows.read()
        if old is not None:
            new = mem.new_memories(found, old.select("memory_id", "text_hash"))
        else:
            new = found.withColumn("text_hash", T.memory_hash(F.col("text")))
        new = new.withColumns({"memory_row_id": F.sha2(F.concat_ws("|", F.col("memory_id").cast("string"), "text_hash", F.col("n").cast("string")), 256), "created_at": F.current_timestamp()}).drop("n")
        new = self._indexed(new)
        before = self.rows.count()
        self.rows.upsert(new)
        return self.rows.count() - before

    def search(self, memory_id, query: str, top_k: int | None = None) -> DataFrame:
        """The rows of a memory that answer a query, with ``score``, ``rank`` and each search's own score (0 where it
        didn't find a row): by vectors, by words, and by shared entities, as far as they are on."""
        d, c = self.rows.read(), self.config
        k = top_k or c.top_k
        if d is None or not query.strip():
            return self.spark.createDataFrame([], "memory_row_id string, text string, score double, rank int")
        d = d.filter(F.col("memory_id") == memory_id)
        q = self.spark.createDataFrame([(1, checked_query(query))], "query_id int, query string")
        fetch, lists = k * search.OVER_FETCH, {}
        if self.embeddings and c.semantic_weight:
            asked = embedded(q, self.embeddings, "query", "qvec").select("query_id", "qvec")
            lists["semantic"] = (search.dense_top_k(d, asked, fetch, "memory_row_id"), c.semantic_weight)
        if c.keyword_weight:
            lists["keyword"] = (search.top_k(search.bm25_scores(d, q, "memory_row_id", "text"), fetch, "memory_row_id"), c.keyword_weight)
        if self.entities and c.entity_weight:
            wanted = F.array(*map(F.lit, sorted({n.strip().lower() for n in self.entities(query) if n.strip()}))).cast("array<string>")
            shared = d.select(F.lit(1).alias("query_id"), "memory_row_id", F.size(F.array_intersect("entities", wanted)).cast("double").alias("score")).filter("score > 0")
            lists["entity"] = (search.top_k(shared, fetch, "memory_row_id"), c.entity_weight)
        if not lists:
            raise InputError("no kind of search is on")
        parts = [(hits.select("query_id", "memory_row_id", "rank", "score", F.lit(1.0).alias("source_weight")), w) for hits, w in lists.values()]
        top = search.top_k(search.fused_or_raw(parts, "memory_row_id"), k, "memory_row_id").drop("first_seen")
        top = mem.pillar_scores(top, {name: hits for name, (hits, _) in lists.items()}, "memory_row_id")
        return d.join(F.broadcast(top), "memory_row_id").orderBy("rank")

    def update(self, memory_id, row_id: str, text: str) -> None:
        d = self.rows.read().filter((F.col("memory_id") == memory_id) & (F.col("memory_row_id") == row_id))
        if d.isEmpty():
            raise MemoryNotFoundError(row_id)
        self.rows.upsert(self._indexed(d.withColumn("text", F.lit(text)).withColumn("text_hash", T.memory_hash(F.col("text")))))

    def delete(self, memory_id, row_id: str) -> None:
        if not self.rows.delete(memory_id=memory_id, memory_row_id=row_id):
            raise MemoryNotFoundError(row_id)
