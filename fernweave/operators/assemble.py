"""From hits to a prompt: routing by corpus size, the corpus as one text, orders of context, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\n\n---\n\n"
DIRECT_THRESHOLD = 150_000


def corpus_tokens(sources: DataFrame, estimated: Column, counted: Column) -> DataFrame:
    """One row: the tokens of all sources; where none are noted, as counted."""
    return sources.agg(F.coalesce(F.sum(F.coalesce(estimated, counted)), F.lit(0)).alias("tokens"))


def auto_route(total: DataFrame, threshold: int = DIRECT_THRESHOLD) -> DataFrame:
    return total.withColumn("mode", F.when(F.col("tokens") <= threshold, "direct").otherwise("retrieval"))


def direct_corpus(chunks: DataFrame, source: str, name: str, position: str, text: str, group: list[str]) -> DataFrame:
    """Each group's sources as "[Source: name]" and their chunks in order, blank ones left out. A source's text
    is one value, so a group is bounded by the direct-mode threshold; larger corpora are retrieved from instead."""
    per = chunks.groupBy(*group, source).agg(F.first(name).alias("_name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda x: x[text]), "\n\n").alias("_body"))
    per = per.filter(F.col("_body").rlike(r"(?U)\S")).withColumn("_part", F.concat(F.lit("[Source: "), "_name", F.lit("]\n"), "_body"))
    return per.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(source, "_part"))), lambda x: x["_part"]), "\n\n").alias("corpus"))


def context_order(ordering: str, rank: Column, n: Column) -> Column:
    """The place (sort key) of the chunk of rank 0.. among n: by score; best first and last; first two, then the rest reversed."""
    if ordering == "score_desc":
        return rank
    if ordering == "primacy_recency":
        return F.when(n <= 2, rank).when(rank % 2 == 0, rank / 2).otherwise(n - (rank + 1) / 2 + 0.25)
    if ordering == "sandwich":
        return F.when((n <= 2) | (rank < 2), rank).otherwise(n + 1 - rank)
    raise ValueError(f"unknown ordering {ordering!r}")


def context(hits: DataFrame, ordering: str, key: str = "query_id", text: str = "content", order_by: list[Column] | None = None) -> DataFrame:
    """A context for each query from its few hits."""
    w = Window.partitionBy(key).orderBy(*(order_by or [F.desc("score"), F.asc("chunk_id")]))
    ranked = hits.withColumn("_rank", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    placed = ranked.withColumn("_place", context_order(ordering, F.col("_rank"), F.col("_n")).cast("double"))
    sorted_ = F.array_sort(F.collect_list(F.struct("_place", F.col(text).alias("_text"))))
    return placed.groupBy(key).agg(F.array_join(F.transform(sorted_, lambda x: x["_text"]), SEPARATOR).alias("context"))


def last_turns(turns: DataFrame, n: int, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n rows of each conversation; the window keeps n rows a group before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(turn))
    return turns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def history_query(turns: DataFrame, n: int = 3, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The last user turn as the query, with the user turns among the n turns before it as context."""
    last = turns.filter(F.col(role) == "user").groupBy(key).agg(F.max(turn).alias("_at"), F.max_by(text, turn).alias("_q"))
    before = turns.join(last, key).filter(F.col(turn) < F.col("_at"))
    recent = last_turns(before, n, key, turn).filter(F.col(role) == "user").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, text))), lambda x: x[text]), " ").alias("_h"))
    said = F.when(F.coalesce("_h", F.lit("")) != "", F.concat("_q", F.lit("\n\nConversation context: "), "_h")).otherwise(F.col("_q"))
    return last.join(recent, key, "left").select(key, said.alias("query"))
