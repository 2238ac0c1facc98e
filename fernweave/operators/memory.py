"""Memories from conversations: dropping those already stored, links, recent turns, scores of each pillar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import memory_hash


def new_memories(extracted: DataFrame, stored: DataFrame, text: str = "text") -> DataFrame:
    """Extracted facts (memory_id, text) whose hash isn't stored under their memory yet. Facts that are equal
    within one batch all stay."""
    hashed = extracted.withColumn("text_hash", memory_hash(F.col(text)))
    return hashed.join(stored.select("memory_id", "text_hash").filter("text_hash <> ''").distinct(), ["memory_id", "text_hash"], "left_anti")


def valid_links(memories: DataFrame, links: str = "linked", ids: str = "known_ids") -> DataFrame:
    """Links to known memories, in order, and how many were dropped."""
    kept = F.filter(F.col(links), lambda x: F.array_contains(F.col(ids), x))
    return memories.withColumns({links: kept, "dropped_links": (F.size(links) - F.size(kept)).cast("long")})


def interaction_text(turns: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """"[role] content" lines of each conversation."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(turn, "role", "text"))), lambda x: F.concat(F.lit("["), x["role"], F.lit("] "), x["text"]))
    return turns.groupBy(key).agg(F.array_join(lines, "\n").alias("interaction"))


def pillar_scores(fused: DataFrame, lists: dict[str, DataFrame], id_col: str = "doc_id") -> DataFrame:
    """Fused hits with their score from each pillar, 0 where it didn't find them."""
    out = fused
    for name, hits in lists.items():
        out = out.join(hits.select("query_id", id_col, F.col("score").alias(f"{name}_score")), ["query_id", id_col], "left")
    return out.fillna(0.0, [f"{name}_score" for name in lists])
