"""Sources: their totals, health, staleness, duplicates; upserts; telemetry over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_totals(chunks: DataFrame, source: str, order: str, attributes: list[str]) -> DataFrame:
    """Each source's first-seen attributes and its number of chunks."""
    return chunks.groupBy(source).agg(*[F.min_by(a, order).alias(a) for a in attributes], F.count(F.lit(1)).alias("chunk_count"))


def source_health(sources: DataFrame, hits: DataFrame, key: str = "source_id") -> DataFrame:
    """Sources with their hits and the share of grounded ones, null where there was none."""
    n = hits.groupBy(key).agg(F.count(F.lit(1)).alias("total_hits"), F.count_if("grounded").alias("grounded_hits"))
    return sources.join(n, key, "left").withColumn("grounding_rate", F.when(F.col("total_hits") > 0, F.col("grounded_hits") / F.col("total_hits")))


def marked_stale(sources: DataFrame, current_model: str) -> DataFrame:
    """Sources embedded by another model become stale; without a name nothing changes."""
    if not current_model:
        return sources
    return sources.withColumn("stale", F.col("stale") | (F.col("embedding_model") != current_model))


def duplicate_sources(sources: DataFrame, content: str, key: str) -> DataFrame:
    """Contents (by sha256) that more than one source holds, with the first of them."""
    return sources.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("file_hash")).agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """An upsert: of all rows of a key the last by ``order``; one aggregation over both."""
    every = old.unionByName(new)
    rest = [c for c in every.columns if c not in keys]
    best = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x"))
    return best.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def telemetry_range(rows: DataFrame, since, until, limit: int = 1000, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Rows of an inclusive time range, latest first."""
    d = rows.filter(F.col(at).between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))
    return d.orderBy(F.desc(at), F.asc(tie)).limit(limit)


def usage_rollup(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))


def batch_dedup(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first record of each key."""
    rest = [c for c in records.columns if c not in keys]
    first = records.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_x"))
    return first.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def listed_sources(sources: DataFrame, knowledge_id=None, order: str = "created_at") -> DataFrame:
    """Latest first, of one knowledge base or of all."""
    d = sources.filter(F.col("knowledge_id") == knowledge_id) if knowledge_id is not None else sources
    return d.orderBy(F.desc(order), F.asc("source_id"))


def found_by_hash(sources: DataFrame, file_hash: str, knowledge_id=None) -> DataFrame:
    """One source with that content, at most; without a knowledge base, of any."""
    d = sources.filter(F.col("file_hash") == file_hash)
    d = d.filter(F.col("knowledge_id") == knowledge_id) if knowledge_id is not None else d
    return d.orderBy("source_id").limit(1)


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "source_id") -> DataFrame:
    """A row for each asked id in the order asked (``ids``: key, ord), null where it is unknown."""
    return ids.join(rows, key, "left").orderBy("ord")


def with_payload(rows: DataFrame, ids: list, payload: dict[str, str], key: str = "point_id") -> DataFrame:
    """Merges keys into the map column ``payload`` of the rows with those ids; given values win."""
    new = F.create_map(*[F.lit(x) for kv in payload.items() for x in kv])
    kept = F.map_filter("payload", lambda k, v: ~k.isin(*payload))
    return rows.withColumn("payload", F.when(F.col(key).isin(*ids), F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), new)).otherwise(F.col("payload")))


def embedding_migration(sources: DataFrame, current_model: str) -> DataFrame:
    """One row: how many sources another model embedded that aren't stale yet."""
    stale = ~F.col("stale") & (F.col("embedding_model") != current_model) if current_model else F.lit(False)
    return sources.agg(F.count_if(stale).alias("to_migrate"))


def without_credentials(uri):
    """A URI without its user information, for logs."""
    return F.regexp_replace(uri, "//[^@/]*@", "//")


def batch_stats(outcomes: DataFrame, outcome: str = "outcome") -> DataFrame:
    """One row of an ingest's records: total, succeeded, failed, skipped."""
    n = lambda x: F.count_if(F.col(outcome) == x).alias(x)
    return outcomes.agg(F.count(F.lit(1)).alias("total"), n("succeeded"), n("failed"), n("skipped"))


def merged_usage(rows: DataFrame, by: list[str], order: str, counters: list[str]) -> DataFrame:
    """Token counters summed (nulls count nothing), with the first provider and model that are named."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return rows.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters], first("provider"), first("model"))
