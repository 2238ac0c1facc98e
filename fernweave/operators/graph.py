"""The entity graph as two frames: merging entities, resolving and deleting relations, trails of several hops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_id, first_keyword_relation
from .search import bm25_scores, top_k

# Relation types that may be stored, and those that trails follow.
RELATION_TYPES = ["CONNECTS_TO", "POWERED_BY", "CONTROLLED_BY", "FEEDS", "FLOWS_TO", "MENTIONS", "REFERENCES"]
TRAVERSED = ["CONNECTS_TO", "POWERED_BY", "CONTROLLED_BY", "FEEDS", "FLOWS_TO"]
MAX_HOPS = 5


def merged_entities(rows: DataFrame) -> DataFrame:
    """Rows (name, entity_type, category, value, knowledge_id, source_id, seq) to one entity each: the first
    name, type and category stay, the last value that isn't null wins, sources add up. One aggregation."""
    keyed = rows.withColumn("entity_id", entity_id(F.col("name"), F.col("entity_type"), F.col("knowledge_id")))
    return keyed.groupBy("entity_id").agg(
        F.min_by("name", "seq").alias("name"),
        F.min_by("entity_type", "seq").alias("entity_type"),
        F.min_by("category", "seq").alias("category"),
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("seq"))).alias("value"),
        F.first("knowledge_id").alias("knowledge_id"),
        F.array_sort(F.collect_set("source_id")).alias("source_ids"),
    )


def resolved_edges(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (from_id, to_id, relation_type, source_id, context, seq) whose ends both exist, the last of each
    (from, type, to, source) winning."""
    ids = entities.select("entity_id")
    known = relations.join(ids.withColumnRenamed("entity_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("entity_id", "to_id"), "to_id", "left_semi")
    return known.groupBy("from_id", "relation_type", "to_id", "source_id").agg(F.max_by("context", "seq").alias("context"))


def without_source(entities: DataFrame, relations: DataFrame, source_id) -> tuple[DataFrame, DataFrame]:
    """The graph after a source is deleted: its relations go, its id goes from entities, and entities left
    without a source go with what still hangs on them."""
    e = entities.withColumn("source_ids", F.array_remove("source_ids", source_id))
    gone = e.filter(F.size("source_ids") == 0).select("entity_id")
    r = relations.filter(F.col("source_id") != F.lit(source_id))
    for end in ("from_id", "to_id"):
        r = r.join(gone.withColumnRenamed("entity_id", end), end, "left_anti")
    return e.filter(F.size("source_ids") > 0), r


def trails(edges: DataFrame, seeds: DataFrame, hops: int, types: list[str] | None = None) -> DataFrame:
    """Undirected paths of 1 to ``hops`` (at most MAX_HOPS) edges from the seeds that use no edge twice; nodes may
    come again. ``edges``: edge_id, src, dst, rel; ``seeds``: seed. One join a hop, unrolled; a row carries its
    edges so that the next hop can leave them out. Returns seed, node, hops, nodes, rels, edge_ids."""
    hops = max(1, min(MAX_HOPS, hops))
    e = edges.filter(F.col("rel").isin(types)) if types is not None else edges
    both = e.select("edge_id", F.col("src").alias("a"), F.col("dst").alias("b"), "rel").unionByName(e.filter("src <> dst").select("edge_id", F.col("dst").alias("a"), F.col("src").alias("b"), "rel"))
    front = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"), F.array("seed").alias("nodes"), F.array().cast("array<string>").alias("rels"), F.array().cast(f"array<{edges.schema['edge_id'].dataType.simpleString()}>").alias("edge_ids"))
    out: list[DataFrame] = []
    for _ in range(hops):
        step = front.join(both, front["node"] == both["a"]).filter(~F.array_contains("edge_ids", F.col("edge_id")))
        front = step.select("seed", F.col("b").alias("node"), (F.col("hops") + 1).alias("hops"), F.concat("nodes", F.array("b")).alias("nodes"), F.concat("rels", F.array("rel")).alias("rels"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"))
        out.append(front)
    return reduce(DataFrame.unionByName, out)


def only_relations(paths: DataFrame, allowed: list[str]) -> DataFrame:
    """Paths whose every edge is of an allowed type."""
    return paths.filter(F.forall("rels", lambda r: r.isin(allowed)))


def path_text(name: Column, kind: Column, nodes: Column, rels: Column) -> Column:
    """"name (type)" and the path as a -[R]-> b."""
    steps = F.zip_with(rels, F.slice(nodes, 2, 1000), lambda r, n: F.concat(F.lit(" -["), r, F.lit("]-> "), n))
    return F.concat(name, F.lit(" ("), kind, F.lit(")\nPath: "), F.element_at(nodes, 1), F.array_join(steps, ""))


def shared_pairs(mentions: DataFrame, cap: int = 20, doc: str = "page", name: str = "name", order: str = "ord") -> DataFrame:
    """Pairs of pages that share an entity, of the first ``cap`` pages of each: the cap is the feature, it bounds
    the pairs of an entity to cap * (cap - 1) / 2."""
    w = Window.partitionBy(name).orderBy(order)
    few = mentions.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col(f"a.{name}") == F.col(f"b.{name}")) & (F.col("a._r") < F.col("b._r")))
    return pairs.groupBy(F.col(f"a.{doc}").alias("source_page"), F.col(f"b.{doc}").alias("target_page")).agg(F.array_sort(F.collect_set(F.col(f"a.{name}"))).alias("shared_entities"))


def neighbours(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions: each page with the sorted set of its neighbours."""
    both = pairs.select(F.col(a).alias("page"), F.col(b).alias("other")).unionByName(pairs.select(F.col(b).alias("page"), F.col(a).alias("other")))
    return both.groupBy("page").agg(F.array_sort(F.collect_set("other")).alias("others"))


CONNECTED_SHOWN, PATHS_SHOWN = 5, 50


def seeds(entities: DataFrame, queries: DataFrame, k: int, types: list[str] | None = None, knowledge_id=None) -> DataFrame:
    """(query_id, entity_id, score, rank): the entities whose name and value answer the queries best by BM25, of the given
    types and knowledge base, if any."""
    e = entities.filter(F.col("entity_type").isin(types)) if types is not None else entities
    e = e.filter(F.col("knowledge_id") == knowledge_id) if knowledge_id is not None else e
    named = e.select("entity_id", F.concat_ws(" ", "name", "value").alias("text"))
    return top_k(bm25_scores(named, queries, "entity_id", "text"), k, "entity_id")


def entity_results(entities: DataFrame, relations: DataFrame, found: DataFrame, hops: int = 2, types: list[str] | None = None) -> DataFrame:
    """Seeds (query_id, entity_id, score, rank) as chunks: (query_id, chunk_id, score, rank, content, connected_count).

    The content: the entity, its value, the PATHS_SHOWN shortest trails from it that end in its own knowledge base (or in
    none), and the CONNECTED_SHOWN nearest entities on them. ``types``: only trails whose every relation is among these.
    """
    name = entities.select("entity_id", "name", "entity_type", "value", "knowledge_id")
    edges = relations.filter(F.col("relation_type").isin(TRAVERSED)).select(F.xxhash64("from_id", "relation_type", "to_id", "source_id").alias("edge_id"), F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("relation_type").alias("rel"))
    start = found.select(F.col("entity_id").alias("seed")).distinct()
    paths = trails(edges, start, hops)
    paths = only_relations(paths, types) if types is not None else paths
    ends = paths.join(name.select(F.col("entity_id").alias("node"), F.col("name").alias("end_name"), F.col("entity_type").alias("end_type"), F.col("knowledge_id").alias("end_kb")), "node")
    ends = ends.join(name.select(F.col("entity_id").alias("seed"), F.col("knowledge_id").alias("kb")), "seed").filter("end_kb IS NULL OR end_kb <=> kb")
    w = Window.partitionBy("seed").orderBy("hops", F.array_join(F.transform("edge_ids", lambda x: x.cast("string")), ","))
    few = ends.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= PATHS_SHOWN)
    steps = few.select("seed", "pos", F.posexplode("nodes").alias("i", "entity_id"), "rels").join(name.select("entity_id", "name"), "entity_id")
    line = F.concat(F.when(F.col("i") > 0, F.concat(F.lit("-["), F.get("rels", F.col("i") - 1), F.lit("]-> "))).otherwise(F.lit("")), F.col("name"))
    lines = steps.groupBy("seed", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("t")))), lambda x: x["t"]), " ").alias("t"))
    shown = lines.groupBy("seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: F.concat(F.lit("  Path: "), x["t"])).alias("paths"))
    near = few.groupBy("seed", "end_name", "end_type").agg(F.min("pos").alias("pos"))
    near = near.groupBy("seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("end_name", F.lit(" ("), "end_type", F.lit(")")).alias("t")))), lambda x: F.concat(F.lit("  Connected: "), x["t"])).alias("near"))
    e = found.join(name, "entity_id").join(shown.withColumnRenamed("seed", "entity_id"), "entity_id", "left").join(near.withColumnRenamed("seed", "entity_id"), "entity_id", "left")
    none = F.array().cast("array<string>")
    head = F.array(F.concat("name", F.lit(" ("), "entity_type", F.lit(")")))
    value = F.when(F.coalesce("value", F.lit("")) != "", F.array(F.concat(F.lit("  Specifications: "), "value"))).otherwise(none)
    content = F.array_join(F.concat(head, value, F.coalesce("paths", none), F.slice(F.coalesce("near", none), 1, CONNECTED_SHOWN)), "\n")
    return e.select("query_id", F.concat(F.lit("entity:"), "name", F.lit(":"), "entity_type").alias("chunk_id"), "score", "rank", content.alias("content"), F.size(F.coalesce("near", none)).alias("connected_count"))


def cross_relations(pairs: DataFrame, entities: DataFrame, keywords: list[tuple[str, str]], default: str | None = "MENTIONS", within: tuple[str, ...] = ()) -> DataFrame:
    """Cross references (source_page, target_page, relationship, shared_entities: array) as relations between the entities
    that two pages share: each two of at least two, in their order, both known by name; the type by the first keyword in
    the relationship, else the default; without any the pair is dropped. A name of several types has that of the last
    entity by ``seq``, or, without that column, the greatest. ``within``: columns of both sides that must agree."""
    on = list(within)
    several = pairs.filter(F.size("shared_entities") >= 2).withColumn("relation_type", first_keyword_relation(F.col("relationship"), keywords, default)).filter("relation_type IS NOT NULL")
    a = several.select("*", F.posexplode("shared_entities").alias("i", "from_name"))
    b = a.select(*on, "source_page", "target_page", "relation_type", "relationship", "i", "from_name", F.posexplode("shared_entities").alias("j", "to_name")).filter("i < j")
    known = entities.groupBy(*on, "name").agg(F.max_by("entity_type", "seq" if "seq" in entities.columns else "entity_type").alias("entity_type"))
    for end in ("from", "to"):
        b = b.join(known.select(*on, F.col("name").alias(f"{end}_name"), F.col("entity_type").alias(f"{end}_type")), [*on, f"{end}_name"])
    return b.select(*on, "from_name", "from_type", "to_name", "to_type", "relation_type", "source_page", "target_page", *(["relationship"] if on else []))


def shared_references(mentions: DataFrame, cap: int = 20) -> DataFrame:
    """Mentions (source_id, name, page_number, pos) as cross references (source_id, source_page, target_page, relationship,
    shared_entities): one for each two of the first ``cap`` mentions of a name in a source. A name twice on a page
    pairs the page with itself; as each reference holds one name, none becomes a relation. The cap is the feature."""
    w = Window.partitionBy("source_id", "name").orderBy("page_number", "pos")
    few = mentions.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= cap).select("source_id", "name", "page_number", "r")
    other = few.select("source_id", "name", F.col("page_number").alias("target_page"), F.col("r").alias("s"))
    both = few.join(other, ["source_id", "name"]).filter("r < s")
    return both.select("source_id", F.col("page_number").alias("source_page"), "target_page", F.concat(F.lit("shared entity: "), "name").alias("relationship"), F.array("name").alias("shared_entities"))
