"""Retrieval: BM25, exact vector search, substring and all-terms search, parent expansion, rank fusion.

All operators take frames of queries as well as of chunks, so that one plan answers one query or many.
Query frames are parameters (a few rows up to a batch of BATCH); larger sets are run in blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, excerpt_window, tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
OVER_FETCH = 4
BATCH = 10_000


Cut = Callable[[Column], Column]


def _terms(text_col: str, cut: Cut, stored: str | None) -> Column:
    """A text's terms in order: from the column that holds them already, or cut now; none for a null text."""
    return F.coalesce(F.col(stored) if stored else cut(F.coalesce(F.col(text_col), F.lit(""))), F.array().cast("array<string>"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: Cut = tokens, stored: str | None = None) -> DataFrame:
    """(id, term, tf, dl): one shuffle, counted before it on each side of it."""
    toks = docs.select(F.col(id_col), _terms(text_col, cut, stored).alias("_t"))
    each = toks.select(id_col, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    return each.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame, text_col: str = "text", cut: Cut = tokens, stored: str | None = None) -> DataFrame:
    """One row: n_docs, avgdl."""
    n = F.size(_terms(text_col, cut, stored))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(n).alias("avgdl"))


def document_frequency(docs: DataFrame, text_col: str = "text", cut: Cut = tokens, stored: str | None = None) -> DataFrame:
    """(term, df): each text's distinct terms, counted before the shuffle, so that it carries a vocabulary a task."""
    return docs.select(F.explode(F.array_distinct(_terms(text_col, cut, stored))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf): ln(N - df + .5) - ln(df + .5); negative ones become EPSILON times the mean over the vocabulary."""
    raw = df.crossJoin(F.broadcast(stats)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: Cut = tokens, stored: str | None = None) -> DataFrame:
    """(query_id, id, score > 0). ``queries``: query_id, query. A term asked twice counts twice. ``cut`` makes terms of
    texts and queries; ``stored`` names a column of the texts that holds theirs.

    Only the queries' terms of a text are counted: they are met by a broadcast join before the shuffle."""
    asked = queries.select("query_id", F.explode(cut(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    stats = corpus_stats(docs, text_col, cut, stored)
    idf = term_idf(document_frequency(docs, text_col, cut, stored), stats)
    wanted = asked.join(idf, "term").select("query_id", "term", "n", "idf")  # as many rows as the queries have terms
    toks = docs.select(F.col(id_col), _terms(text_col, cut, stored).alias("_t"))
    met = toks.select(id_col, F.size("_t").alias("dl"), F.explode("_t").alias("term")).join(F.broadcast(asked.select("term").distinct()), "term")
    counted = met.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    weight = F.col("n") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = counted.join(F.broadcast(wanted), "term").crossJoin(F.broadcast(stats)).groupBy("query_id", id_col).agg(F.sum(weight).alias("score"))
    return scored.filter("score > 0")


def top_k(scored: DataFrame, k: int, id_col: str, score_col: str = "score", digits: int = 6) -> DataFrame:
    """The k best of each query with their ranks from 1; scores rounded; ties by first appearance where fused() says
    it, then by id."""
    s = scored.withColumn(score_col, F.round(score_col, digits))
    seen = [F.asc("first_seen")] if "first_seen" in s.columns else []
    w = Window.partitionBy("query_id").orderBy(F.desc(score_col), *seen, F.asc(id_col))
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dense_scores(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score) by cosine. ``queries``: query_id, qvec; broadcast, so a block of at most BATCH."""
    return vectors.crossJoin(F.broadcast(queries)).select("query_id", id_col, cosine(F.col(vector_col), F.col("qvec")).alias("score"))


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """top_k() of dense_scores() for many queries: each Arrow batch of vectors meets a block of queries as one matrix
    product and passes on only its own k best (and their ties) for each query, so that what is shuffled grows
    with batches and queries, not with pairs. Queries beyond BATCH go in further blocks. Null vectors are left out."""
    import numpy as np

    asked = queries.select("query_id", "qvec")
    blocks = -(-asked.count() // BATCH)
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, `{id_col}` {vectors.schema[id_col].dataType.simpleString()}, score double"
    parts: list[DataFrame] = []
    for b in range(max(1, blocks)):
        rows = (asked if blocks <= 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()
        ids, matrix = [r.query_id for r in rows], np.array([r.qvec for r in rows], np.float64)
        norms = np.linalg.norm(matrix, axis=1) if len(rows) else None
        sent = vectors.sparkSession.sparkContext.broadcast((ids, matrix / np.where(norms == 0, np.nan, norms)[:, None] if len(rows) else matrix))

        def run(batches, sent=sent):
            import pandas as pd

            own, q = sent.value
            for batch in batches:
                if not len(own) or not len(batch):
                    continue
                m = np.stack(batch[vector_col].to_numpy()).astype(np.float64)
                length = np.linalg.norm(m, axis=1)
                m /= np.where(length == 0, np.nan, length)[:, None]
                for lo in range(0, len(own), 512):
                    s = np.round(m @ q[lo : lo + 512].T, digits)
                    s = np.where(np.isnan(s), -np.inf, s)
                    least = np.partition(s, len(s) - k, axis=0)[len(s) - k] if len(s) > k else np.full(s.shape[1], -np.inf)
                    i, j = np.nonzero((s >= least) & (s > -np.inf))
                    yield pd.DataFrame({"query_id": [own[lo + x] for x in j], id_col: batch[id_col].to_numpy()[i], "score": s[i, j]})

        parts.append(vectors.select(id_col, vector_col).filter(F.col(vector_col).isNotNull()).mapInPandas(run, kinds))
    return top_k(reduce(DataFrame.unionByName, parts), k, id_col, digits=digits)


def sparse_scores(sparse: DataFrame, query_terms: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Dot product of sparse vectors in rows (id, term, weight) and (query_id, term, qweight)."""
    return sparse.join(F.broadcast(query_terms), "term").groupBy("query_id", id_col).agg(F.sum(F.col("weight") * F.col("qweight")).alias("score"))


def fused(lists: list[tuple[DataFrame, float]], id_col: str, k: int = RRF_K, source_weight: Column | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of (query_id, id, rank from 1) frames: one union and one aggregation
    instead of outer joins. Ties by first appearance (list, rank)."""
    parts = [df.select("query_id", id_col, "rank", F.lit(float(w)).alias("_w"), F.lit(i).alias("_list"), *([source_weight.alias("_sw")] if source_weight is not None else [])) for i, (df, w) in enumerate(lists)]
    every = reduce(DataFrame.unionByName, parts)
    share = F.col("_w") / (F.lit(k) + F.col("rank"))
    share = share * F.col("_sw") if source_weight is not None else share
    return every.groupBy("query_id", id_col).agg(F.sum(share).alias("score"), F.min(F.struct("_list", "rank")).alias("first_seen"))


def exact_hits(docs: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """Case-insensitive substring match, literally."""
    return docs.filter(F.lower(F.col(text_col)).contains(query.lower()))


def all_terms_hits(docs: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """Texts that hold every term of the query, cut to terms as the texts are; a query without a term finds nothing."""
    asked, held = tokens(F.lit(query)), tokens(F.col(text_col))
    return docs.filter((F.size(asked) > 0) & (F.size(F.array_except(asked, held)) == 0))


def exact_over_bm25(docs: DataFrame, query: str, k: int, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, score, match_type): texts that hold the query literally, with score 1, and BM25 hits among the others, best
    first by raw score, so that a BM25 hit above 1 comes before an exact one. A blank query finds nothing here."""
    if not query.strip():
        return docs.select(id_col, F.lit(0.0).alias("score"), F.lit("").alias("match_type")).limit(0)
    asked = docs.sparkSession.createDataFrame([(1, query)], "query_id int, query string")
    exact = exact_hits(docs, query, text_col).select(id_col, F.lit(1.0).alias("score"), F.lit("exact").alias("match_type"))
    ranked = bm25_scores(docs, asked, id_col, text_col).select(id_col, "score", F.lit("bm25").alias("match_type"))
    first = exact.unionByName(ranked).groupBy(id_col).agg(F.max_by(F.struct("score", "match_type"), F.col("match_type") == "exact").alias("x"))
    out = first.select(id_col, F.round("x.score", 6).alias("score"), F.col("x.match_type").alias("match_type"))
    return out.orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def hybrid_top_k(dense: DataFrame, sparse: DataFrame, k: int, id_col: str) -> DataFrame:
    """Dense and sparse scores of the same vectors, fused by the ranks of the OVER_FETCH * k best of each."""
    lists = [(top_k(s, k * OVER_FETCH, id_col), 1.0) for s in (dense, sparse)]
    return top_k(fused(lists, id_col), k, id_col).drop("first_seen")


def fulltext_chunks(hits: DataFrame, query: str, source: str = "source_id", text_col: str = "content", window: int = 800) -> DataFrame:
    """Hits among whole documents in the shape of chunks: id "fulltext:<source>", and an excerpt as the content."""
    return hits.withColumns({"chunk_id": F.concat(F.lit("fulltext:"), F.col(source).cast("string")), text_col: excerpt_window(F.col(text_col), query, window)})


def topped_up(ranked: DataFrame, fallback: DataFrame, k: int, id_col: str) -> DataFrame:
    """``ranked`` (at most k rows), filled up with rows of ``fallback`` that it lacks, in order of their id."""
    first = ranked.withColumn("_tier", F.lit(0))
    rest = fallback.join(ranked.select(id_col), id_col, "left_anti").orderBy(id_col).limit(k).withColumn("_tier", F.lit(1))
    return first.unionByName(rest, allowMissingColumns=True).orderBy("_tier", F.desc("score"), id_col).limit(k).drop("_tier")


def with_excerpts(hits: DataFrame, query: str, text_col: str = "text", window: int = 800) -> DataFrame:
    return hits.withColumn("excerpt", excerpt_window(F.col(text_col), query, window))


def expanded_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits with a parent are merged into it: the sum of their scores, how many, and their ids by rank. Unknown
    parents drop out; hits without a parent stay in front. ``children``: point_id, score, rank, parent_id, and query_id
    where there are several queries. A merged hit keeps its parent's id as ``parent_id``."""
    by = ["query_id"] if "query_id" in children.columns else []
    plain = children.filter("parent_id IS NULL").select(*by, "point_id", "score", "rank", F.lit(1).cast("long").alias("child_hits"), F.array("point_id").alias("expanded_from"), F.lit(0).alias("tier"), "parent_id")
    hit = children.filter("parent_id IS NOT NULL").groupBy(*by, "parent_id").agg(F.sum("score").alias("score"), F.min("rank").alias("rank"), F.count(F.lit(1)).alias("child_hits"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "point_id"))), lambda x: x["point_id"]).alias("expanded_from"))
    merged = hit.join(parents.select(F.col("point_id").alias("parent_id")), "parent_id").select(*by, F.element_at("expanded_from", 1).alias("point_id"), "score", "rank", "child_hits", "expanded_from", F.lit(1).alias("tier"), "parent_id")
    return plain.unionByName(merged)


def fused_or_raw(lists: list[tuple[DataFrame, float]], id_col: str, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, first_seen): of a query that several lists answer the fused scores, of one that a single
    list answers that list's own. Lists: query_id, id, rank, score, source_weight, which multiplies either."""
    parts = [df.select("query_id", id_col, "rank", "score", "source_weight", F.lit(float(w)).alias("_w"), F.lit(i).alias("_list")) for i, (df, w) in enumerate(lists)]
    every = reduce(DataFrame.unionByName, parts)
    answered = every.withColumn("_n", F.size(F.collect_set("_list").over(Window.partitionBy("query_id"))))
    share = F.when(F.col("_n") > 1, F.col("_w") / (F.lit(k) + F.col("rank"))).otherwise(F.col("score")) * F.col("source_weight")
    return answered.groupBy("query_id", id_col).agg(F.sum(share).alias("score"), F.min(F.struct("_list", "rank")).alias("first_seen"))
