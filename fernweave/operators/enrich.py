"""Enrichment before embedding: situating context and synthetic questions by a plug-in, weights, entities, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import context_string, relation_type
from ..plugins import mapped
from .graph import RELATION_TYPES

# The model's window, what is kept free of it, and the share of failures that fails a whole run.
WINDOW_TOKENS, RESERVED_TOKENS, MOST_FAILED = 150_000, 16_000, 0.5
# How a drawing's wire styles name relations; others connect.
WIRE_RELATIONS = {
    "solid": "CONNECTS_TO",
    "dashed": "CONNECTS_TO",
    "signal": "CONNECTS_TO",
    "pneumatic": "FLOWS_TO",
    "hydraulic": "FLOWS_TO",
    "power": "POWERED_BY",
    "control": "CONTROLLED_BY",
    "feed": "FEEDS",
}


def situated(chunks: DataFrame, documents: DataFrame, situate, most_context: int = 200, tokens: str = "estimated_tokens", key: str = "source_id") -> DataFrame:
    """Chunks with ``context`` and ``note``: what ``situate`` says of a chunk. Documents that don't fit the window are
    skipped as a whole, and noted; the size is a column of ``documents``, so no text is moved for it."""
    room = WINDOW_TOKENS - RESERVED_TOKENS - most_context
    sized = chunks.join(documents.select(key, F.col(tokens).alias("_size")), key)
    fits = mapped(sized.filter(F.col("_size") <= room), situate, "content").withColumnRenamed("value", "context").withColumn("note", F.when(F.col("error").isNotNull(), F.concat(F.lit("contextual:warn:"), "error")))
    skipped = sized.filter(F.col("_size") > room).withColumns({"context": F.lit(None).cast("string"), "note": F.lit("contextual:info:document too large")})
    return fits.drop("error", "_size").unionByName(skipped.drop("_size"))


def expanded(chunks: DataFrame, ask) -> DataFrame:
    """Chunks with ``questions`` (the plug-in's lines) and ``error``; one that fails is left without."""
    out = mapped(chunks, ask, "content")
    lines = F.filter(F.split(F.coalesce("value", F.lit("")), "\n"), lambda x: x.rlike(r"(?U)\S"))
    return out.withColumn("questions", lines).drop("value")


def mostly_failed(expanded_chunks: DataFrame) -> DataFrame:
    """One row: whether more than half of the chunks have an error."""
    return expanded_chunks.agg(F.coalesce(F.avg(F.col("error").isNotNull().cast("double")) > MOST_FAILED, F.lit(False)).alias("failed"))


def source_weight(source_type: Column, weights: dict[str, float]) -> Column:
    """The type's weight; 1 where none are configured; a type that isn't among the configured raises."""
    if not weights:
        return F.lit(1.0)
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(known[source_type], F.raise_error(F.concat(F.lit("no weight for source type "), F.coalesce(source_type, F.lit("null")))).cast("double"))


def drawing_entities(components: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Components (component_id, label, symbol_class, domain, page) as entities by their ids; one that comes again, within
    the same ``within``, is what the last page says."""
    last = components.groupBy(*within, "component_id").agg(F.max_by(F.struct("symbol_class", "domain"), "page").alias("x"))
    return last.select(*within, F.col("component_id").alias("name"), F.coalesce("x.symbol_class", F.lit("component")).alias("entity_type"), F.col("x.domain").alias("category"))


def drawing_relations(connections: DataFrame, components: DataFrame, within: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Connections (from_component, to_component, wire_style, properties) as relations between entities of the types
    that their components have; unknown components count as "component"."""
    e = drawing_entities(components, within)
    d = connections
    for side in ("from", "to"):
        d = d.join(e.select(*within, F.col("name").alias(f"{side}_component"), F.col("entity_type").alias(f"{side}_type")), [*within, f"{side}_component"], "left")
    styles = F.create_map(*[F.lit(x) for kv in WIRE_RELATIONS.items() for x in kv])
    kind = relation_type(F.coalesce(styles[F.coalesce("wire_style", F.lit(""))], F.lit("CONNECTS_TO")), RELATION_TYPES)
    named = lambda side: F.col(f"{side}_component").alias(f"{side}_name")
    typed = lambda side: F.coalesce(f"{side}_type", F.lit("component")).alias(f"{side}_type")
    return d.select(*within, *keep, named("from"), typed("from"), named("to"), typed("to"), kind.alias("relation_type"), context_string(F.col("properties")).alias("context"))
