"""Structured documents (PDF, XML, controller exports) and drawings, phase by phase, into an engine's tables.

Each phase takes all sources of the status before it in one plan, writes its own tables, and commits the status last;
a run that stopped goes on where it was, and its rows replace those that were half written. Source ids are digests
of the knowledge base and the file's bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError, IngestionError
from ..functions import text as T
from ..operators import chunking, enrich, graph, structured
from ..plugins import model_name
from ..sources import files, markup
from ..sources.snapshots import SnapshotTable
from .engine import KnowledgeEngine
from .phases import DRAWING, STRUCTURED

# Fixed value: so much of a page's own text stands for its description where no model looks at it.
DESCRIBED_CHARS = 5_000
_ENTITIES = "array<struct<name:string,category:string,context:string,value:string>>"
_TABLES = "array<struct<title:string,columns:array<string>,rows:array<map<string,string>>>>"
_SEEN = f"description string, entities {_ENTITIES}, tables {_TABLES}, annotations array<string>, page_type string, error string"
_SAID = "cross_references array<struct<source_page:int,target_page:int,relationship:string,shared_entities:array<string>>>, page_clusters array<struct<pages:array<int>,reason:string>>, document_summary string, error string"
_DRAWN = "domain string, components array<struct<component_id:string,symbol_class:string,label:string,bbox:array<int>>>, connections array<struct<from_component:string,to_component:string,wire_style:string,from_port:string,to_port:string,net:string>>, connectors array<struct<tag:string,component:string>>, error string"


def _called(fn: Callable, row: Callable[[dict], tuple], schema: str):
    """A UDF of a plug-in from a value to a dict, as a struct; what fails has nothing but its error."""
    names = [c.strip().split(" ")[0] for c in schema.replace(", ", "\n").split("\n")]

    @F.pandas_udf(schema)
    def call(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                out.append((*row(fn(bytes(v) if isinstance(v, (bytearray, memoryview)) else v)), None))
            except Exception as e:
                out.append((*[None] * (len(names) - 1), f"{type(e).__name__}({str(e)[:80]})"))
        return pd.DataFrame(out, columns=names)

    return call


def _picked(items: Iterable[dict] | None, keys: tuple[str, ...]) -> list[dict]:
    return [{k: i.get(k) for k in keys} for i in items or ()]


def _seen(d: dict) -> tuple:
    return d["description"], _picked(d.get("entities"), ("name", "category", "context", "value")), _picked(d.get("tables"), ("title", "columns", "rows")), list(d.get("annotations") or ()), d.get("page_type") or ""


def _said(d: dict) -> tuple:
    return _picked(d.get("cross_references"), ("source_page", "target_page", "relationship", "shared_entities")), _picked(d.get("page_clusters"), ("pages", "reason")), d.get("document_summary") or ""


def _drawn(d: dict) -> tuple:
    wires = _picked(d.get("connections"), ("from_component", "to_component", "wire_style", "from_port", "to_port", "net"))
    return d.get("domain") or "mixed", _picked(d.get("components"), ("component_id", "symbol_class", "label", "bbox")), wires, _picked(d.get("connectors"), ("tag", "component"))


def _digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 32)


class _Phased:
    phases: tuple[str, ...]

    def __init__(self, engine: KnowledgeEngine, path: str):
        self.engine, self.spark = engine, engine.spark
        self.files = SnapshotTable(self.spark, f"{path}/files", ["source_id"])

    def _new_files(self, binaries: DataFrame, knowledge_id: str, kind: Column) -> DataFrame:
        """(source_id, file_hash, file_type, path, content) of the files that no source of the knowledge base has come
        through a phase with; of files with the same bytes the first by path."""
        d = binaries.select("path", "content", F.sha2("content", 256).alias("file_hash"))
        d = d.withColumn("file_type", kind)
        odd = d.filter("file_type IS NULL").select("path").first()
        if odd:
            raise IngestionError(f"unsupported file: {odd.path}")
        old = self.engine.sources.read()
        if old is not None:
            done = old.filter((F.col("knowledge_id") == knowledge_id) & F.col("status").isin(*self.phases))
            d = d.join(done.select("file_hash"), "file_hash", "left_anti")
        first = d.groupBy("file_hash").agg(F.min("path").alias("path"))
        return d.join(first, ["file_hash", "path"], "left_semi").withColumn("source_id", _digest(F.lit(knowledge_id), F.col("file_hash")))

    def _begin(self, knowledge_id: str, source_type: str, outcome: DataFrame) -> None:
        """Commits sources: ``outcome`` has source_id, pages, tokens and failures (an array of notes). A source of which
        nothing but failures came is "failed", and is tried again by the next call."""
        f = self.files.read().filter(F.col("knowledge_id") == knowledge_id)
        d = f.join(outcome, "source_id")
        failed = (F.col("pages") == 0) & (F.size("failures") > 0)
        model = model_name(self.engine.embeddings) if self.engine.embeddings else ""
        self.engine.sources.upsert(d.select("source_id", "file_hash", F.col("tokens").cast("long").alias("estimated_tokens"), F.lit(knowledge_id).alias("knowledge_id"), F.lit(source_type).alias("source_type"), F.lit(model).alias("embedding_model"), F.lit(False).alias("stale"), F.when(failed, "failed").otherwise(self.phases[0]).alias("status"), F.nullif(F.array_join(F.array_sort("failures"), "; "), F.lit("")).alias("note"), F.current_timestamp().alias("created_at")))

    def _todo(self, status: str) -> DataFrame | None:
        """Sources of a status with their file's type and path; None if there are none."""
        s, f = self.engine.sources.read(), self.files.read()
        if s is None or f is None:
            return None
        d = s.filter(F.col("status") == status).select("source_id", "knowledge_id", "source_type").join(f.select("source_id", "file_type", "path"), "source_id")
        return None if d.isEmpty() else d

    def _advance(self, todo: DataFrame, status: str, notes: DataFrame | None = None) -> None:
        """Commits the status of the sources, and adds notes (source_id, more)."""
        d = self.engine.sources.read().join(todo.select("source_id"), "source_id", "left_semi").withColumn("status", F.lit(status))
        if notes is not None:
            d = d.join(notes, "source_id", "left").withColumn("note", F.nullif(F.concat_ws("; ", "note", "more"), F.lit(""))).drop("more")
        self.engine.sources.upsert(d)

    def _store(self, rows: DataFrame) -> None:
        """Rows (source_id, page_number, position, section, content, embedding_text, knowledge_id, source_type, chunk_id) as
        the engine's chunks."""
        d = chunking.numbered(rows.withColumnRenamed("position", "chunk_index"))
        d = d.withColumns({"chunk_type": F.lit("child"), "parent_id": F.lit(None).cast("string"), "hard_split": F.lit(False)})
        self.engine.add_chunks(d)


class StructuredDocuments(_Phased):
    """analyze (a page analysis each), synthesize (what pages share), ingest (vectors, entities, relations).

    ``split`` gives a PDF's pages as (image, text, whether it holds pictures), ``describe`` a dict of an image
    (description, entities, tables, annotations, page_type), ``relate`` one of a document's pages as text (cross_references,
    page_clusters, document_summary); PDFs need all three. A page whose image was described once, in whatever knowledge
    base, isn't again; one with ``text_only`` characters or more (0: never) and no picture is its own description.
    ``methods``: further ingests, whose failures are noted. Tokens of these sources are counted, so that routing by
    size sees them."""

    phases = STRUCTURED

    def __init__(self, engine: KnowledgeEngine, path: str, split: Callable | None = None, describe: Callable[[bytes], dict] | None = None, relate: Callable[[str], dict] | None = None, text_only: int = 300, type_rules: list[tuple[str, str]] | None = None, relation_words: list[tuple[str, str]] | None = None, relation_default: str | None = "MENTIONS", methods: Iterable = ()):
        super().__init__(engine, path)
        self.split, self.describe, self.relate, self.text_only, self.methods = split, describe, relate, text_only, list(methods)
        self.type_rules, self.relation_words, self.relation_default = type_rules or [], relation_words or [], relation_default
        self.analyses = SnapshotTable(self.spark, f"{path}/page_analyses", ["source_id", "page_number"])
        self.references = SnapshotTable(self.spark, f"{path}/cross_references", ["source_id", "source_page", "target_page", "relationship"])
        self.syntheses = SnapshotTable(self.spark, f"{path}/syntheses", ["source_id"])
        self.payloads = SnapshotTable(self.spark, f"{path}/payloads", ["chunk_id"])

    def run(self, binaries: DataFrame, knowledge_id: str, source_type: str = "structured", pages: str | None = None) -> DataFrame:
        """All phases of new files (path, content), and those that older ones still lack; the knowledge base's sources."""
        self.analyze(binaries, knowledge_id, source_type, pages)
        self.synthesize()
        self.ingest()
        return self.engine.sources.read().filter(F.col("knowledge_id") == knowledge_id)

    def pages(self) -> DataFrame:
        """Analyses of pages that didn't fail."""
        return self.analyses.read().filter("error IS NULL")

    def analyze(self, binaries: DataFrame, knowledge_id: str, source_type: str = "structured", pages: str | None = None) -> None:
        ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        controller = F.substring("content", 1, 4096).cast("string").contains("<RSLogix5000Content")
        new = self._new_files(binaries, knowledge_id, F.when(ext == "pdf", "pdf").when((ext == "l5x") | (ext == "xml") & controller, "l5x").when(ext == "xml", "xml"))
        self.files.upsert(new.select("source_id", "file_hash", "file_type", "path", F.lit(knowledge_id).alias("knowledge_id")))
        of = lambda kind: new.filter(F.col("file_type") == kind).select(F.col("source_id").alias("path"), "content")
        text = F.lit("")
        done = self.files.read().filter(F.col("knowledge_id") == knowledge_id)
        parts = []
        for kind, parse in (("xml", markup.xml_pages), ("l5x", markup.controller_export_pages)):
            found = F.transform("entities", lambda e: F.struct(e["name"].alias("name"), e["category"].alias("category"), e["context"].alias("context"), F.lit(None).cast("string").alias("value"))).cast(_ENTITIES)
            parts.append(parse(of(kind)).select("path", "page_number", F.lit(None).cast("string").alias("page_hash"), text.alias("raw_text"), "description", found.alias("entities"), F.array().cast(_TABLES).alias("tables"), F.array().cast("array<string>").alias("annotations"), "page_type", "error"))
        if not done.filter("file_type = 'pdf'").isEmpty():
            parts.append(self._looked_at(of("pdf"), pages))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows = rows.withColumn("page_number", F.coalesce("page_number", F.lit(0))).withColumnRenamed("path", "source_id").withColumn("analyzed_at", F.current_timestamp())
        self.analyses.upsert(rows)
        old = self.engine.sources.read()
        started = done if old is None else done.join(old.filter(F.col("status").isin(*self.phases)).select("source_id"), "source_id", "left_anti")
        a = started.select("source_id").join(self.analyses.read(), "source_id", "left")
        fine = F.col("error").isNull() & F.col("page_number").isNotNull()
        words = F.size(T.tokens(F.concat_ws(" ", "description", "raw_text")))
        note = F.when(F.col("error").isNotNull(), F.concat(F.lit("vision:warn:page_"), F.col("page_number").cast("string"), F.lit(":"), "error"))
        outcome = a.groupBy("source_id").agg(F.count_if(fine).alias("pages"), F.coalesce(F.sum(F.when(fine, words)), F.lit(0)).alias("tokens"), F.collect_list(note).alias("failures"))
        self._begin(knowledge_id, source_type, outcome)

    def _looked_at(self, pdfs: DataFrame, pages: str | None) -> DataFrame:
        if not (self.split and self.describe):
            raise ConfigurationError("PDFs need a splitter and a model that describes images")
        images = files.page_images(pdfs, self.split, files.page_range(pages) if pages else None)
        old = self.analyses.read()
        analysis = F.struct("description", "entities", "tables", "annotations", "page_type")
        if old is None:
            cached = images.withColumn("analysis", F.lit(None).cast(f"struct<description:string,entities:{_ENTITIES},tables:{_TABLES},annotations:array<string>,page_type:string>"))
        else:
            known = old.filter("error IS NULL AND page_hash IS NOT NULL").select("page_hash", analysis.alias("analysis"), F.struct("analyzed_at", "source_id", "page_number").alias("seq"))
            cached = structured.with_cache(images, known)
        routed = cached.withColumn("way", F.when(F.col("error").isNull(), structured.page_route(F.col("analysis").isNotNull(), F.col("raw_text_char_count"), F.col("has_images"), self.text_only)))
        look = _called(self.describe, _seen, _SEEN)
        base = ["path", "page_number", "page_hash", "raw_text"]
        seen = routed.filter("way = 'vision'").select(*base, look("image").alias("s")).select(*base, "s.*")
        kept = routed.filter("way = 'cache'").select(*base, "analysis.*", F.lit(None).cast("string").alias("error"))
        none = lambda kind: F.array().cast(kind)
        own = routed.filter("way = 'text' OR way IS NULL").select(*base, F.substring("raw_text", 1, DESCRIBED_CHARS).alias("description"), none(_ENTITIES).alias("entities"), none(_TABLES).alias("tables"), none("array<string>").alias("annotations"), F.lit("text").alias("page_type"), "error")
        return seen.unionByName(kept).unionByName(own)

    def synthesize(self) -> None:
        todo = self._todo("analyzed")
        if todo is None:
            return
        pages = self.pages().join(todo.select("source_id", "file_type"), "source_id")
        mentions = pages.filter("file_type <> 'pdf'").select("source_id", "page_number", F.posexplode("entities").alias("pos", "e")).select("source_id", "page_number", "pos", "e.name")
        found, notes = graph.shared_references(mentions), None
        pdf = pages.filter("file_type = 'pdf'")
        if not pdf.isEmpty():
            if not self.relate:
                raise ConfigurationError("PDFs need a model that relates pages")
            names = structured.joined_names(F.col("entities"))
            line = F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(" ("), F.coalesce("page_type", F.lit("")), F.lit("): "), F.coalesce("description", F.lit("")), F.when(F.size("entities") > 0, F.concat(F.lit("\n  Entities: "), names)).otherwise(""))
            # A source's descriptions as one value: at most MAX_PDF_PAGES short texts.
            body = pdf.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("body"))
            self.syntheses.upsert(body.select("source_id", _called(self.relate, _said, _SAID)("body").alias("s")).select("source_id", "s.*"))
            said = self.syntheses.read().join(todo.select("source_id"), "source_id", "left_semi")
            found = found.unionByName(said.select("source_id", F.inline("cross_references")))
            notes = said.filter("error IS NOT NULL").select("source_id", F.concat(F.lit("document_synthesis:warn:"), "error").alias("more"))
        self.references.upsert(found)
        self._advance(todo, "synthesized", notes)

    def ingest(self) -> None:
        todo = self._todo("synthesized")
        if todo is None:
            return
        pages = self.pages().join(todo.drop("path"), "source_id")
        names = structured.joined_names(F.col("entities"))
        whole = F.concat_ws("\n", "description", F.when(F.size("entities") > 0, F.concat(F.lit("Entities: "), names)), F.when(F.size("annotations") > 0, F.concat(F.lit("Annotations: "), F.array_join("annotations", ", "))))
        keep = ("shown", "page_type", "entities", "file_type", "knowledge_id")
        rows = structured.page_vectors(pages.withColumn("shown", F.col("description")).withColumn("description", whole), keep)
        rows = rows.withColumns({"chunk_id": _digest(F.col("source_id"), F.col("page_number"), F.col("vector_type"), F.col("pos")), "position": F.struct("vector_type", "pos"), "section": F.col("vector_type"), "content": F.when(F.col("vector_type") == "description", F.col("shown")).otherwise(F.col("text")), "embedding_text": F.col("text"), "source_type": F.lit("structured")})
        refs = self.references.read().join(todo.select("source_id"), "source_id", "left_semi")
        both = refs.select("source_id", F.col("source_page").alias("page_number"), F.col("target_page").alias("other")).unionByName(refs.select("source_id", F.col("target_page").alias("page_number"), F.col("source_page").alias("other")))
        near = both.groupBy("source_id", "page_number").agg(F.array_sort(F.collect_set("other")).alias("cross_references"))
        self._store(rows.select("source_id", "page_number", "position", "section", "content", "embedding_text", "knowledge_id", "source_type", "chunk_id"))
        self.payloads.upsert(rows.join(near, ["source_id", "page_number"], "left").select("chunk_id", F.col("vector_type").alias("vector_role"), "file_type", "page_type", F.transform("entities", lambda e: e["name"]).alias("entities"), F.transform("entities", lambda e: e["category"]).alias("entity_categories"), F.coalesce("cross_references", F.array().cast("array<int>")).alias("cross_references")))
        notes = self._graph(pages, refs)
        for m in self.methods:
            try:
                m.ingest(pages=pages)
            except Exception as e:
                notes.append(f"{m.name}:warn:method_failed({str(e)[:80]})")
        more = todo.select("source_id", F.lit("; ".join(notes)).alias("more")) if notes else None
        self._advance(todo, "completed", more)

    def _graph(self, pages: DataFrame, refs: DataFrame) -> list[str]:
        try:
            e = pages.select("source_id", "knowledge_id", "page_number", F.posexplode("entities").alias("pos", "e")).filter("e.name IS NOT NULL")
            e = e.select("source_id", "knowledge_id", "e.name", T.first_matching_type(F.col("e.name"), self.type_rules, F.col("e.category")).alias("entity_type"), F.col("e.category").alias("category"), F.col("e.value").alias("value"), F.struct("page_number", "pos").alias("seq"))
            # Order over sources too: of an entity that several name the first keeps its name and category.
            self.engine.add_entities(e.withColumn("seq", F.struct("source_id", "seq")))
            r = graph.cross_relations(refs, e, self.relation_words, self.relation_default, ("source_id",))
            kb = pages.select("source_id", "knowledge_id").distinct()
            self.engine.add_relations(r.join(kb, "source_id").select("from_name", "from_type", "to_name", "to_type", "relation_type", "knowledge_id", "source_id", F.col("relationship").alias("context"), F.struct("source_page", "target_page").alias("seq")))
        except Exception as e:
            return [f"graph:warn:method_failed({type(e).__name__})"]
        return []


class Drawings(_Phased):
    """render (pages and geometry), extract (components, connections, connectors), link (connectors of one tag on several
    sheets), ingest (a vector a component, entities, relations).

    Text DXF needs no plug-in: layouts with something on them are the pages; ``draw`` gives their images, if wanted.
    PDFs need ``split``, and ``describe``: a dict (domain, components, connections, connectors) of an image. A page that
    fails there ends the phase. Components are entities by their ids."""

    phases = DRAWING

    def __init__(self, engine: KnowledgeEngine, path: str, split: Callable | None = None, describe: Callable[[bytes], dict] | None = None, draw: Callable | None = None, library: dict[str, list[str]] | None = None, patterns: list[str] | None = None):
        super().__init__(engine, path)
        self.split, self.describe, self.draw, self.library, self.patterns = split, describe, draw, library, patterns
        self.pages = SnapshotTable(self.spark, f"{path}/drawing_pages", ["source_id", "page_number"])
        self.geometry = SnapshotTable(self.spark, f"{path}/geometry", ["source_id", "ord"])
        self.seen = SnapshotTable(self.spark, f"{path}/seen", ["source_id", "page_number"])
        self.components = SnapshotTable(self.spark, f"{path}/components", ["source_id", "page_number", "component_id"])
        self.connections = SnapshotTable(self.spark, f"{path}/connections", ["source_id", "connection_id"])
        self.connectors = SnapshotTable(self.spark, f"{path}/connectors", ["source_id", "page_number", "ord"])

    def run(self, binaries: DataFrame, knowledge_id: str) -> DataFrame:
        self.render(binaries, knowledge_id)
        self.extract()
        self.link()
        self.ingest()
        return self.engine.sources.read().filter(F.col("knowledge_id") == knowledge_id)

    def render(self, binaries: DataFrame, knowledge_id: str) -> None:
        ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        new = self._new_files(binaries, knowledge_id, F.when(ext.isin("pdf", "dxf"), ext))
        self.files.upsert(new.select("source_id", "file_hash", "file_type", "path", F.lit(knowledge_id).alias("knowledge_id")))
        of = lambda kind: new.filter(F.col("file_type") == kind).select(F.col("source_id").alias("path"), "content")
        rows = markup.drawing_rows(of("dxf")).withColumnRenamed("path", "source_id").withColumn("ord", F.coalesce("ord", F.lit(-1)))
        self.geometry.upsert(rows)
        kinds = self.files.read().filter(F.col("knowledge_id") == knowledge_id)
        g = self.geometry.read().join(kinds.select("source_id"), "source_id", "left_semi")
        page = ["source_id", "page_number", "source_format", "image", "page_hash", "raw_text", "error"]
        null = lambda kind: F.lit(None).cast(kind)
        sheets = g.groupBy("source_id", F.coalesce("page", F.lit(0)).alias("page_number")).agg(F.max("error").alias("error")).withColumns({"source_format": F.lit("dxf"), "image": null("binary"), "page_hash": null("string"), "raw_text": F.lit("")}).select(*page)
        shots = lambda kind, split: files.page_images(of(kind), split).select(F.col("path").alias("source_id"), F.coalesce("page_number", F.lit(0)).alias("page_number"), F.lit(kind).alias("source_format"), "image", "page_hash", "raw_text", "error")
        if self.draw:
            draw = self.draw
            sheets = sheets.filter("error IS NOT NULL").unionByName(shots("dxf", lambda data: [(image, "", False) for image in draw(data)]).filter("error IS NULL"))
        if not kinds.filter("file_type = 'pdf'").isEmpty():
            if not self.split:
                raise ConfigurationError("PDFs need a splitter")
            sheets = sheets.unionByName(shots("pdf", self.split))
        self.pages.upsert(sheets)
        old = self.engine.sources.read()
        started = kinds if old is None else kinds.join(old.filter(F.col("status").isin(*self.phases)).select("source_id"), "source_id", "left_anti")
        p = started.select("source_id").join(self.pages.read().drop("image"), "source_id", "left")
        outcome = p.groupBy("source_id").agg(F.count_if(F.col("error").isNull() & F.col("page_number").isNotNull()).alias("pages"), F.lit(0).alias("tokens"), F.collect_list(F.concat(F.lit("render:warn:"), "error")).alias("failures"))
        self._begin(knowledge_id, "drawing", outcome)

    def extract(self) -> None:
        todo = self._todo("rendered")
        if todo is None:
            return
        ids = todo.select("source_id")
        g = self.geometry.read().join(ids, "source_id", "left_semi").filter("error IS NULL").withColumn("sheet", F.struct("source_id", F.col("page").alias("page_number")))
        symbol = structured.block_symbol(F.col("block_name"), self.library)
        parts = g.filter("kind = 'INSERT' AND x IS NOT NULL").select("sheet", "source_id", F.col("page").alias("page_number"), F.coalesce("handle", F.concat(F.lit("c"), "ord")).alias("component_id"), symbol.alias("s"), F.lit(None).cast("string").alias("label"), "ord", "x", "y", "w", "h", "block_name", "layer")
        parts = parts.withColumns({"symbol_class": F.col("s.symbol_class"), "own_domain": F.col("s.domain")}).drop("s")
        domain = structured.majority_domain(parts.select("sheet", F.col("own_domain").alias("domain"), "ord"), "sheet")
        boxes = parts.withColumnRenamed("sheet", "page")
        lines = g.filter("kind = 'LINE'").select(F.struct("source_id", "page", "ord").alias("line_id"), F.col("sheet").alias("page"), "x1", "y1", "x2", "y2")
        null = lambda n: F.lit(None).cast("string").alias(n)
        wires = structured.bound_endpoints(lines, boxes).select("line_id.source_id", F.col("line_id.page").alias("page_number"), F.concat(F.lit("l"), F.col("line_id.ord").cast("string")).alias("connection_id"), F.col("from_id").alias("from_component"), F.col("to_id").alias("to_component"), F.lit("solid").alias("wire_style"), null("from_port"), null("to_port"), null("net"))
        texts = g.filter("kind IN ('TEXT', 'MTEXT')").withColumn("tag", structured.off_page_tag(F.col("text"), self.patterns)).filter("tag IS NOT NULL")
        points = texts.select(F.struct("source_id", "page", "ord").alias("point"), F.col("sheet").alias("page"), F.col("x1").alias("x"), F.col("y1").alias("y"))
        at = structured.components_at(points, boxes, "point").select("point.source_id", "point.ord", F.col("component_id").alias("component"))
        tags = texts.select("source_id", F.col("page").alias("page_number"), "ord", "tag").join(at, ["source_id", "ord"], "left")
        parts = parts.join(domain, "sheet").select("source_id", "page_number", "component_id", "symbol_class", "label", "domain", "ord", "x", "y", "w", "h")
        images = self.pages.read().filter("source_format = 'pdf' AND error IS NULL").join(ids, "source_id", "left_semi")
        if not images.isEmpty():
            if not self.describe:
                raise ConfigurationError("drawings in PDFs need a model that describes them")
            self.seen.upsert(images.select("source_id", "page_number", _called(self.describe, _drawn, _DRAWN)("image").alias("s")).select("source_id", "page_number", "s.*"))
            seen = self.seen.read().join(ids, "source_id", "left_semi")
            bad = seen.filter("error IS NOT NULL").first()
            if bad:
                raise IngestionError(f"page {bad.page_number} of {bad.source_id}: {bad.error}")
            c = seen.select("source_id", "page_number", "domain", F.posexplode("components").alias("ord", "c"))
            box = lambda i, n: F.get("c.bbox", F.lit(i)).alias(n)
            parts = parts.unionByName(c.select("source_id", "page_number", "c.component_id", "c.symbol_class", "c.label", "domain", "ord", box(0, "x"), box(1, "y"), box(2, "w"), box(3, "h")))
            w = seen.select("source_id", "page_number", F.posexplode("connections").alias("n", "c"))
            wires = wires.unionByName(w.select("source_id", "page_number", F.concat_ws("_", F.lit("p"), F.col("page_number").cast("string"), F.col("n").cast("string")).alias("connection_id"), "c.*"))
            t = seen.select("source_id", "page_number", F.posexplode("connectors").alias("ord", "c"))
            tags = tags.unionByName(t.select("source_id", "page_number", "ord", "c.*"))
        self.components.upsert(parts)
        self.connections.upsert(wires.withColumn("to_page", F.lit(None).cast("int")))
        self.connectors.upsert(tags)
        self._advance(todo, "extracted")

    def link(self) -> None:
        todo = self._todo("extracted")
        if todo is None:
            return
        tags = self.connectors.read().join(todo.select("source_id"), "source_id", "left_semi")
        pairs = structured.paired_connectors(tags.select(F.struct("source_id", "tag").alias("tag"), F.col("page_number").alias("page"), "ord", "component"))
        null = lambda n: F.lit(None).cast("string").alias(n)
        self.connections.upsert(pairs.select("tag.source_id", F.col("from_page").alias("page_number"), F.concat(F.lit("x"), _digest(F.col("tag.tag"), F.col("from_page"), F.col("from_component"), F.col("to_page"), F.col("to_component"))).alias("connection_id"), "from_component", "to_component", F.lit("signal").alias("wire_style"), null("from_port"), null("to_port"), F.col("tag.tag").alias("net"), "to_page"))
        self._advance(todo, "linked")

    def ingest(self) -> None:
        todo = self._todo("linked")
        if todo is None:
            return
        ids = todo.select("source_id", "knowledge_id")
        c = self.components.read().join(ids, "source_id")
        wires = self.connections.read().join(ids.select("source_id"), "source_id", "left_semi")
        same = wires.filter("to_page IS NULL")
        ends = lambda a, b: same.select("source_id", "page_number", F.col(a).alias("component_id"), F.col(b).alias("other"))
        links = ends("from_component", "to_component").unionByName(ends("to_component", "from_component")).groupBy("source_id", "page_number", "component_id").agg(F.array_sort(F.collect_set("other")).alias("links"))
        rows = c.join(links, ["source_id", "page_number", "component_id"], "left").withColumn("content", structured.component_text(F.col("symbol_class"), F.col("label"), F.coalesce("links", F.array().cast("array<string>")), F.col("domain"), F.col("page_number")))
        self._store(rows.select("source_id", "page_number", F.struct("ord", "component_id").alias("position"), F.lit("drawing_component").alias("section"), "content", F.col("content").alias("embedding_text"), "knowledge_id", F.lit("drawing").alias("source_type"), _digest(F.col("source_id"), F.col("page_number"), F.col("component_id")).alias("chunk_id")))
        e = enrich.drawing_entities(c.withColumnRenamed("page_number", "page"), ("source_id", "knowledge_id"))
        self.engine.add_entities(e.select("name", "entity_type", "category", F.lit(None).cast("string").alias("value"), "knowledge_id", "source_id", F.struct("source_id", "name").alias("seq")))
        fields = {"wire_style": F.col("wire_style"), "from_port": F.col("from_port"), "to_port": F.col("to_port"), "net": F.col("net"), "page_number": F.col("page_number").cast("string"), "source_id": F.col("source_id")}
        across = F.col("to_page").isNotNull()
        fields |= {"cross_sheet": F.when(across, "true"), "from_page": F.when(across, F.col("page_number").cast("string")), "to_page": F.col("to_page").cast("string")}
        w = wires.withColumn("properties", F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]))
        r = enrich.drawing_relations(w, c.withColumnRenamed("page_number", "page"), ("source_id",), ("connection_id",))
        self.engine.add_relations(r.join(ids, "source_id").withColumnRenamed("connection_id", "seq"))
        words = F.sum(F.size(T.tokens(F.col("content")))).cast("long")
        counted = rows.groupBy("source_id").agg(words.alias("_tokens"))
        d = self.engine.sources.read().join(ids.select("source_id"), "source_id", "left_semi").join(counted, "source_id", "left")
        self.engine.sources.upsert(d.withColumns({"estimated_tokens": F.coalesce("_tokens", F.lit(0).cast("long")), "status": F.lit("completed")}).drop("_tokens"))
