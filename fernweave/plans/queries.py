"""The registered queries of the retrieval operators, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import plugins
from ..functions import text as T
from ..operators import assemble, chunking, evaluate, graph, manage, memory, search, structured
from ..sources import markup
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def checked(sql: str | None = None):
    """Registers a query, and its SQL if it has any, under the function's name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
TOKS = f"SELECT doc_id, unnest({TOK}) AS term FROM documents"
QUERY = "the reti und the"
BM25_CTE = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM ({TOKS}) GROUP BY ALL),
 dls AS (SELECT doc_id, len({TOK}) AS dl FROM documents),
 st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
 raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY term),
 idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
 asked AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM q) GROUP BY ALL),
 bm AS (SELECT query_id, doc_id, sum(asked.n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN asked USING (term) JOIN idf USING (term) JOIN dls USING (doc_id), st GROUP BY ALL HAVING score > 0)"""
ONE_Q = f"q AS (SELECT 1 AS query_id, '{QUERY}' AS query)"
MANY_Q = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def ranked_sql(source: str, k: int, id_col: str = "doc_id") -> str:
    return f"SELECT query_id, {id_col}, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, {id_col}) AS rank FROM {source} QUALIFY rank <= {k}"


def fused_sql(k: int, weight: str = "w") -> str:
    """Of lists (query_id, doc_id, rank, w, l: the list's place): fused, ties by first appearance, then by id."""
    return f"SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, seen, doc_id) AS rank FROM (SELECT query_id, doc_id, sum({weight} / (60 + rank)) AS score, min(l * 100000 + rank) AS seen FROM lists GROUP BY ALL) QUALIFY rank <= {k}"


def one_query(spark: SparkSession) -> DataFrame:
    return few(spark, [(1, QUERY)], "query_id int, query string")


def benchmark_queries(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's items as a block of queries."""
    return t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# --- keyword search ---------------------------------------------------------------------------------------------


@checked(f"SELECT doc_id, term, count(*) AS tf FROM ({TOKS}) GROUP BY ALL")
def tokenize_tf(spark, d):
    return search.postings(t(spark, d, "documents")).select("doc_id", "term", "tf")


@checked(f"WITH {ONE_Q}, {BM25_CTE} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_stats(spark, d):
    docs = t(spark, d, "documents")
    return search.term_idf(search.document_frequency(docs), search.corpus_stats(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


@checked(f"WITH {ONE_Q}, {BM25_CTE} {ranked_sql('bm', 10)}")
def bm25_topk(spark, d):
    return search.top_k(search.bm25_scores(t(spark, d, "documents"), one_query(spark)), 10, "doc_id")


@checked(f"WITH {MANY_Q}, {BM25_CTE} {ranked_sql('bm', 5)}")
def bm25_batch(spark, d):
    return search.top_k(search.bm25_scores(t(spark, d, "documents"), benchmark_queries(spark, d)), 5, "doc_id")


@checked(f"WITH {ONE_Q}, tf AS (SELECT doc_id, term, count(*) AS tf FROM ({TOKS}) GROUP BY ALL), asked AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM q) GROUP BY ALL), s AS (SELECT query_id, doc_id, sum(tf * n)::DOUBLE AS score FROM tf JOIN asked USING (term) GROUP BY ALL) {ranked_sql('s', 10)}")
def sparse_dot_topk(spark, d):
    sparse = search.postings(t(spark, d, "documents")).select("doc_id", "term", F.col("tf").cast("double").alias("weight"))
    asked = one_query(spark).select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qweight"))
    return search.top_k(search.sparse_scores(sparse, asked), 10, "doc_id")


@checked("SELECT doc_id, source, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'Anan on'.lower()) ".replace("'Anan on'.lower()", "'anan on'"))
def exact_match_search(spark, d):
    return search.exact_hits(t(spark, d, "documents"), "Anan on").select("doc_id", "source", F.lit(1.0).alias("score"))


@checked(f"SELECT doc_id FROM documents WHERE list_has_all({TOK}, ['the', 'and', 'with'])")
def fts_all_terms(spark, d):
    return search.all_terms_hits(t(spark, d, "documents"), "The and with").select("doc_id")


@checked(f"""WITH {ONE_Q}, {BM25_CTE}, ranked AS (SELECT doc_id, score FROM ({ranked_sql('bm', 15)})),
 more AS (SELECT doc_id, 0.5 AS score FROM documents WHERE contains(lower(text), 'license') AND doc_id NOT IN (SELECT doc_id FROM ranked) ORDER BY doc_id LIMIT 20),
 every AS (SELECT *, 0 AS tier FROM ranked UNION ALL SELECT *, 1 FROM more)
 SELECT doc_id, score FROM every ORDER BY tier, score DESC, doc_id LIMIT 20""")
def fts_exact_topup(spark, d):
    docs = t(spark, d, "documents")
    ranked = search.top_k(search.bm25_scores(docs, one_query(spark)), 15, "doc_id").select("doc_id", "score")
    return search.topped_up(ranked, search.exact_hits(docs, "license").select("doc_id", F.lit(0.5).alias("score")), 20, "doc_id")


@checked("""WITH a AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS c FROM documents),
 b AS (SELECT *, strpos(lower(c), 'with the') - 1 AS hit, length(c) AS n FROM a),
 e AS (SELECT *, greatest(0, hit - 100) AS s0, least(n, hit + 8 + 100) AS e0 FROM b),
 f AS (SELECT *, left(c, s0::INT) AS head, substr(c, e0 + 1) AS tail FROM e),
 g AS (SELECT *, CASE WHEN strpos(head, chr(10) || chr(10)) > 0 THEN length(head) - strpos(reverse(head), chr(10) || chr(10)) - 1 ELSE -1 END AS l, strpos(tail, chr(10) || chr(10)) - 1 AS ah FROM f),
 h AS (SELECT *, CASE WHEN l >= 0 AND s0 - l < 100 THEN l + 2 ELSE s0 END AS s1, CASE WHEN ah >= 0 AND ah < 100 THEN e0 + ah ELSE e0 END AS e1 FROM g)
 SELECT doc_id, CASE WHEN hit >= 0 THEN (CASE WHEN s1 > 0 THEN '...' ELSE '' END) || regexp_replace(substr(c, (s1 + 1)::INT, (e1 - s1)::INT), '^\\s+|\\s+$', '', 'g') || (CASE WHEN e1 < n THEN '...' ELSE '' END) ELSE left(c, 200) END AS excerpt FROM h""")
def excerpt_window(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    return search.with_excerpts(docs, "With the", window=200).select("doc_id", "excerpt")


# --- vectors and fusion ------------------------------------------------------------------------------------------

COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def query_vectors(spark, d, condition: str) -> DataFrame:
    return t(spark, d, "embeddings").filter(condition).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


@checked(f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7) {ranked_sql('s', 10, 'vec_id')}")
def dense_topk(spark, d):
    return search.top_k(search.dense_scores(t(spark, d, "embeddings"), query_vectors(spark, d, "vec_id = 7")), 10, "vec_id")


@checked(f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7 AND e.label IN (1, 3)) {ranked_sql('s', 10, 'vec_id')}")
def dense_topk_filtered(spark, d):
    return search.top_k(search.dense_scores(t(spark, d, "embeddings").filter(F.col("label").isin(1, 3)), query_vectors(spark, d, "vec_id = 7")), 10, "vec_id")


@checked(f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) {ranked_sql('s', 5, 'vec_id')}")
def dense_batch_topk(spark, d):
    """The stated query set: every vector whose id is divisible by 50, against all."""
    return search.dense_top_k(t(spark, d, "embeddings"), query_vectors(spark, d, "vec_id % 50 = 0"), 5)


LISTS_SQL = f"""WITH {ONE_Q}, {BM25_CTE}, kw AS ({ranked_sql('bm', 32)}),
 ds AS (SELECT 1 AS query_id, e.vec_id AS doc_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7), dn AS ({ranked_sql('ds', 32)})"""


def two_lists(spark, d) -> tuple[DataFrame, DataFrame]:
    """Keyword and dense hits, 4 times the final 8 each. vec_id = doc_id is only a stand-in for a real link."""
    kw = search.top_k(search.bm25_scores(t(spark, d, "documents"), one_query(spark)), 8 * search.OVER_FETCH, "doc_id")
    q = query_vectors(spark, d, "vec_id = 7").withColumn("query_id", F.lit(1))
    vectors = t(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return kw, search.top_k(search.dense_scores(vectors, q, "doc_id"), 8 * search.OVER_FETCH, "doc_id")


@checked(f"{LISTS_SQL}, lists AS (SELECT *, 1.0 AS w, 0 AS l FROM kw UNION ALL SELECT *, 1.0, 1 FROM dn) {fused_sql(8)}")
def rrf_fusion(spark, d):
    kw, dn = two_lists(spark, d)
    return search.top_k(search.fused([(kw, 1.0), (dn, 1.0)], "doc_id"), 8, "doc_id").select("query_id", "doc_id", "score", "rank")


@checked(f"{LISTS_SQL}, lists AS (SELECT *, 1.0 AS w, 0 AS l FROM dn UNION ALL SELECT *, 0.8, 1 FROM kw) SELECT r.*, lang, source FROM ({fused_sql(8)}) r JOIN documents USING (doc_id)")
def hybrid_rrf(spark, d):
    """The flagship: dense (1.0) and keyword (0.8) hits fused, with the hits' attributes."""
    kw, dn = two_lists(spark, d)
    top = search.top_k(search.fused([(dn, 1.0), (kw, 0.8)], "doc_id"), 8, "doc_id").select("query_id", "doc_id", "score", "rank")
    return t(spark, d, "documents").select("doc_id", "lang", "source").join(F.broadcast(top), "doc_id").select("query_id", "doc_id", "score", "rank", "lang", "source")


@checked(f"{LISTS_SQL}, w AS (SELECT doc_id, CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS sw FROM documents LEFT JOIN labels USING (doc_id)), lists AS (SELECT query_id, doc_id, rank, coalesce(sw, 1.0) AS w, l FROM (SELECT *, 0 AS l FROM kw UNION ALL SELECT *, 1 FROM dn) LEFT JOIN w USING (doc_id)) {fused_sql(8)}")
def rrf_weighted_source(spark, d):
    labels = t(spark, d, "labels").select("doc_id", "quality")
    weigh = lambda hits: labels.join(F.broadcast(hits), "doc_id", "right")
    sw = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    kw, dn = (weigh(x) for x in two_lists(spark, d))
    return search.top_k(search.fused([(kw, 1.0), (dn, 1.0)], "doc_id", source_weight=sw), 8, "doc_id").select("query_id", "doc_id", "score", "rank")


@checked(f"""WITH {ONE_Q}, {BM25_CTE}, hits AS ({ranked_sql('bm', 40)}), c AS (SELECT h.*, CASE WHEN lang = 'es' THEN NULL WHEN source = 'src1' THEN 'gone' ELSE source END AS parent_id FROM hits h JOIN documents USING (doc_id)),
 m AS (SELECT parent_id, sum(score) AS score, min(rank) AS rank, count(*) AS child_hits, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS expanded_from FROM c WHERE parent_id IS NOT NULL AND parent_id <> 'gone' GROUP BY 1)
 SELECT split_part(expanded_from, ',', 1) AS point_id, round(score, 4) AS score, rank, child_hits, expanded_from, 1 AS tier FROM m UNION ALL SELECT doc_id::VARCHAR, round(score, 4), rank, 1, doc_id::VARCHAR, 0 FROM c WHERE parent_id IS NULL""")
def parent_expand_sum(spark, d):
    docs = t(spark, d, "documents")
    hits = search.top_k(search.bm25_scores(docs, one_query(spark)), 40, "doc_id")
    parent = F.when(F.col("lang") == "es", None).when(F.col("source") == "src1", "gone").otherwise(F.col("source"))
    children = docs.select("doc_id", "lang", "source").join(F.broadcast(hits), "doc_id").select(F.col("doc_id").cast("string").alias("point_id"), "score", "rank", parent.alias("parent_id"))
    out = search.expanded_parents(children, docs.select(F.col("source").alias("point_id")).distinct()).drop("parent_id")
    return out.withColumns({"score": F.round("score", 4), "expanded_from": F.array_join("expanded_from", ",")})


@checked(f"WITH {ONE_Q}, {BM25_CTE} SELECT r.* FROM ({ranked_sql('bm', 20)}) r JOIN documents USING (doc_id) WHERE lang <> 'de'")
def child_filter_after_topk(spark, d):
    """The filter comes after the cut, so fewer than k may stay. lang stands in for the chunk's type."""
    docs = t(spark, d, "documents")
    top = search.top_k(search.bm25_scores(docs, one_query(spark)), 20, "doc_id")
    return docs.filter("lang <> 'de'").select("doc_id").join(F.broadcast(top), "doc_id").select("query_id", "doc_id", "score", "rank")


@checked(f"WITH {ONE_Q}, {BM25_CTE} SELECT * FROM ({ranked_sql('bm', 20)}) WHERE score >= 3.0")
def min_score_filter(spark, d):
    return search.top_k(search.bm25_scores(t(spark, d, "documents"), one_query(spark)), 20, "doc_id").filter("score >= 3.0")


@checked(f"WITH {ONE_Q}, {BM25_CTE}, r AS ({ranked_sql('bm', 20)}), w AS (SELECT query_id, doc_id, score * CASE source WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 0.5 ELSE 1.0 END AS score FROM r JOIN documents USING (doc_id)) {ranked_sql('w', 20)}")
def source_weight_rerank(spark, d):
    """A single list keeps raw scores, times the source's weight."""
    docs = t(spark, d, "documents")
    top = search.top_k(search.bm25_scores(docs, one_query(spark)), 20, "doc_id").drop("rank")
    weighed = docs.select("doc_id", "source").join(F.broadcast(top), "doc_id").withColumn("score", F.col("score") * F.when(F.col("source") == "src1", 2.0).when(F.col("source") == "src2", 0.5).otherwise(1.0))
    return search.top_k(weighed, 20, "doc_id").select("query_id", "doc_id", "score", "rank")


@checked(f"WITH {MANY_Q}, {BM25_CTE} SELECT query_id, max(round(score, 6)) AS best, max(round(score, 6)) >= 5.0 AS passed FROM bm GROUP BY 1")
def score_gate(spark, d):
    hits = search.top_k(search.bm25_scores(t(spark, d, "documents"), benchmark_queries(spark, d)), 5, "doc_id")
    return evaluate.score_gate(hits, 5.0)


# --- prompts ------------------------------------------------------------------------------------------------------


@checked(f"SELECT sum(len({TOK}))::BIGINT AS tokens FROM documents")
def corpus_tokens(spark, d):
    return assemble.corpus_tokens(t(spark, d, "documents"), F.lit(None).cast("int"), F.size(T.tokens(F.col("text"))))


@checked(f"SELECT source, sum(len({TOK}))::BIGINT AS tokens, CASE WHEN sum(len({TOK})) <= 20000 THEN 'direct' ELSE 'retrieval' END AS mode FROM documents GROUP BY source")
def auto_route(spark, d):
    """The corpus of each source routed by its size."""
    per = t(spark, d, "documents").groupBy("source").agg(F.sum(F.size(T.tokens(F.col("text")))).alias("tokens"))
    return assemble.auto_route(per, 20_000)


@checked("""WITH per AS (SELECT conv_id, '[Source: ' || 'conv-' || conv_id || ']' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS p FROM conversations GROUP BY 1),
 one AS (SELECT conv_id % 10 AS kb, string_agg(p, chr(10) || chr(10) ORDER BY conv_id) AS corpus FROM per GROUP BY 1) SELECT kb, length(corpus) AS n_chars, sha256(corpus) AS corpus_sha256 FROM one""")
def direct_corpus(spark, d):
    turns = t(spark, d, "conversations").withColumns({"kb": F.col("conv_id") % 10, "name": F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))})
    return assemble.direct_corpus(turns, "conv_id", "name", "turn", "text", ["kb"]).select("kb", F.length("corpus").cast("long").alias("n_chars"), F.sha2(F.col("corpus").cast("binary"), 256).alias("corpus_sha256"))


def _context(ordering: str):
    def fn(spark, d):
        docs = t(spark, d, "documents")
        hits = search.top_k(search.bm25_scores(docs, benchmark_queries(spark, d)), 5, "doc_id")
        full = docs.select("doc_id", F.col("text").alias("content")).join(F.broadcast(hits), "doc_id").withColumn("chunk_id", F.col("doc_id"))
        return assemble.context(full, ordering).select("query_id", F.sha2(F.col("context").cast("binary"), 256).alias("context_sha256"))

    return fn


for _name, _place in {
    "score_desc": "r",
    "primacy_recency": "CASE WHEN n <= 2 THEN r WHEN r % 2 = 0 THEN r / 2 ELSE n - (r + 1) / 2 + 0.25 END",
    "sandwich": "CASE WHEN n <= 2 OR r < 2 THEN r ELSE n + 1 - r END",
}.items():
    QUERIES[f"context_{_name}"] = _context(_name)
    ORACLE_SQL[f"context_{_name}"] = f"""WITH {MANY_Q}, {BM25_CTE}, hits AS ({ranked_sql('bm', 5)}), p AS (SELECT query_id, doc_id, (rank - 1)::DOUBLE AS r, count(*) OVER (PARTITION BY query_id) AS n FROM hits),
     o AS (SELECT query_id, text, {_place.replace("r % 2", "r::INT % 2")} AS place FROM p JOIN documents USING (doc_id))
     SELECT query_id, sha256(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)) AS context_sha256 FROM o GROUP BY 1"""


@checked("""WITH l AS (SELECT conv_id, max(turn) AS last_at, arg_max(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY 1),
 b AS (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn DESC) AS r FROM conversations c JOIN l USING (conv_id) WHERE turn < last_at),
 h AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS h FROM b WHERE r <= 3 AND role = 'user' GROUP BY 1)
 SELECT conv_id, CASE WHEN coalesce(h, '') <> '' THEN q || chr(10) || chr(10) || 'Conversation context: ' || h ELSE q END AS query FROM l LEFT JOIN h USING (conv_id)""")
def history_window_query(spark, d):
    return assemble.history_query(t(spark, d, "conversations"))


@checked("SELECT doc_id, concat_ws(' | ', 'Document: ' || source, 'Type: ' || lang, 'Page: ' || (doc_id % 7)) AS header, '[' || source || ' — ' || CASE WHEN doc_id % 7 = 0 THEN 'Unknown page' ELSE 'Page ' || (doc_id % 7) END || ']' AS label FROM documents")
def chunk_header_context(spark, d):
    page = F.col("doc_id") % 7
    none = F.lit(None).cast("string")
    return t(spark, d, "documents").select("doc_id", T.context_header(F.col("source"), F.col("lang"), page, none).alias("header"), T.chunk_label(F.col("source"), page, none).alias("label"))


@checked("SELECT doc_id, sha256((CASE WHEN doc_id % 2 = 0 THEN 'Document: ' || source || chr(10) || chr(10) || text ELSE text END) || (CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || chr(10) || 'Questions this passage answers:' || chr(10) || 'what is ' || source || chr(10) || 'why ' || lang END)) AS text_sha256 FROM documents")
def compose_embedding_text(spark, d):
    docs = t(spark, d, "documents")
    header = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Document: "), "source", F.lit("\n\n"), "text"))
    asked = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("what is "), "source"), F.concat(F.lit("why "), "lang")))
    return docs.select("doc_id", F.sha2(T.embedding_text(F.col("text"), header, asked).cast("binary"), 256).alias("text_sha256"))


# --- graph --------------------------------------------------------------------------------------------------------

ENTITY_ROWS_SQL = """er AS (SELECT r_name AS name, 'region' AS entity_type, 'place' AS category, NULL AS value, 'src-r' AS source_id, r_regionkey AS seq FROM region
 UNION ALL SELECT n_name, 'nation', 'place', CASE WHEN n_nationkey % 2 = 0 THEN 'v' || n_regionkey END, 'src-n', 100 + n_nationkey FROM nation
 UNION ALL SELECT '  ' || upper(n_name), 'Nation', 'country', 'again', 'src-n2', 1000 + n_nationkey FROM nation WHERE n_nationkey < 12
 UNION ALL SELECT s_name, 'supplier', 'firm', NULL, 'src-s', 10000 + s_suppkey FROM supplier),
 ek AS (SELECT *, sha256(regexp_replace(lower(trim(name)), '\\s+', ' ', 'g') || '|' || lower(trim(entity_type)) || '|' || 'kb') AS entity_id FROM er),
 ents AS (SELECT entity_id, arg_min(name, seq) AS name, arg_min(entity_type, seq) AS entity_type, arg_min(category, seq) AS category, arg_max(value, seq) FILTER (value IS NOT NULL) AS value, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS source_ids FROM ek GROUP BY 1)"""


def entity_rows(spark, d) -> DataFrame:
    n = t(spark, d, "nation")
    rows = [
        t(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("entity_type"), F.lit("place").alias("category"), F.lit(None).cast("string").alias("value"), F.lit("src-r").alias("source_id"), F.col("r_regionkey").cast("long").alias("seq")),
        n.select(F.col("n_name").alias("name"), F.lit("nation").alias("entity_type"), F.lit("place").alias("category"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("v"), F.col("n_regionkey").cast("string"))).alias("value"), F.lit("src-n").alias("source_id"), (F.col("n_nationkey") + 100).cast("long").alias("seq")),
        n.filter("n_nationkey < 12").select(F.concat(F.lit("  "), F.upper("n_name")).alias("name"), F.lit("Nation").alias("entity_type"), F.lit("country").alias("category"), F.lit("again").alias("value"), F.lit("src-n2").alias("source_id"), (F.col("n_nationkey") + 1000).cast("long").alias("seq")),
        t(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type"), F.lit("firm").alias("category"), F.lit(None).cast("string").alias("value"), F.lit("src-s").alias("source_id"), (F.col("s_suppkey") + 10000).cast("long").alias("seq")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("knowledge_id", F.lit("kb"))


@checked(f"WITH {ENTITY_ROWS_SQL} SELECT * FROM ents")
def entity_upsert(spark, d):
    return graph.merged_entities(entity_rows(spark, d)).drop("knowledge_id").withColumn("source_ids", F.array_join("source_ids", ","))


@checked("SELECT p_partkey, sha256(regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g') || '|' || lower(trim(p_type)) || '|' || p_brand) AS entity_id FROM part")
def entity_id_hash(spark, d):
    return t(spark, d, "part").select("p_partkey", T.entity_id(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("entity_id"))


EDGES_SQL = """rel AS (SELECT sha256(lower(n_name) || '|nation|kb') AS from_id, sha256(lower(CASE WHEN n_nationkey = 3 THEN 'nowhere' ELSE r_name END) || '|region|kb') AS to_id, 'CONNECTS_TO' AS relation_type, 'src-n' AS source_id, 'in ' || r_name AS context, n_nationkey AS seq FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT sha256(lower(s_name) || '|supplier|kb'), sha256(lower(n_name) || '|nation|kb'), 'FEEDS', 'src-s', 'of ' || n_name, 1000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT sha256(lower(s_name) || '|supplier|kb'), sha256(lower(n_name) || '|nation|kb'), 'FEEDS', 'src-s', 'again ' || n_name, 100000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0),
 edges AS (SELECT from_id, relation_type, to_id, source_id, arg_max(context, seq) AS context FROM rel WHERE from_id IN (SELECT entity_id FROM ents) AND to_id IN (SELECT entity_id FROM ents) GROUP BY ALL)"""


def relation_rows(spark, d) -> DataFrame:
    kb, n, r, s = F.lit("kb"), t(spark, d, "nation"), t(spark, d, "region"), t(spark, d, "supplier")
    nr = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    to = F.when(F.col("n_nationkey") == 3, "nowhere").otherwise(F.col("r_name"))
    a = nr.select(T.entity_id(F.col("n_name"), F.lit("nation"), kb).alias("from_id"), T.entity_id(to, F.lit("region"), kb).alias("to_id"), F.lit("CONNECTS_TO").alias("relation_type"), F.lit("src-n").alias("source_id"), F.concat(F.lit("in "), "r_name").alias("context"), F.col("n_nationkey").cast("long").alias("seq"))
    sn = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
    b = lambda word, plus, rows: rows.select(T.entity_id(F.col("s_name"), F.lit("supplier"), kb).alias("from_id"), T.entity_id(F.col("n_name"), F.lit("nation"), kb).alias("to_id"), F.lit("FEEDS").alias("relation_type"), F.lit("src-s").alias("source_id"), F.concat(F.lit(word), "n_name").alias("context"), (F.col("s_suppkey") + plus).alias("seq"))
    return a.unionByName(b("of ", 1000, sn)).unionByName(b("again ", 100000, sn.filter("s_suppkey % 2 = 0")))


@checked(f"WITH {ENTITY_ROWS_SQL}, {EDGES_SQL} SELECT * FROM edges")
def edge_resolve(spark, d):
    return graph.resolved_edges(relation_rows(spark, d), graph.merged_entities(entity_rows(spark, d)))


@checked(f"""WITH {ENTITY_ROWS_SQL}, {EDGES_SQL}, e2 AS (SELECT entity_id, list_filter(string_split(source_ids, ','), lambda x: x <> 'src-n') AS s FROM ents), gone AS (SELECT entity_id FROM e2 WHERE len(s) = 0)
 SELECT 'entity' AS kind, entity_id AS id FROM e2 WHERE len(s) > 0 UNION ALL SELECT 'relation', from_id FROM edges WHERE source_id <> 'src-n' AND from_id NOT IN (FROM gone) AND to_id NOT IN (FROM gone)""")
def delete_by_source(spark, d):
    e = graph.merged_entities(entity_rows(spark, d))
    e, r = graph.without_source(e, graph.resolved_edges(relation_rows(spark, d), e), "src-n")
    return e.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id")).unionByName(r.select(F.lit("relation").alias("kind"), F.col("from_id").alias("id")))


TRAILS_SQL = """WITH RECURSIVE ed AS (SELECT 's' || s_suppkey AS edge_id, s_name AS src, n_name AS dst, 'FEEDS' AS rel FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 'n' || n_nationkey, n_name, r_name, 'CONNECTS_TO' FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'x' || r_regionkey, r_name, (SELECT r_name FROM region r2 WHERE r2.r_regionkey = (region.r_regionkey + 1) % 5), 'FLOWS_TO' FROM region),
 both_ AS (SELECT edge_id, src AS a, dst AS b, rel FROM ed UNION ALL SELECT edge_id, dst, src, rel FROM ed WHERE src <> dst),
 p AS (SELECT r_name AS seed, r_name AS node, 0 AS hops, [r_name] AS nodes, []::VARCHAR[] AS rels, []::VARCHAR[] AS eids FROM region
 UNION ALL SELECT seed, b, hops + 1, list_append(nodes, b), list_append(rels, rel), list_append(eids, edge_id) FROM p JOIN both_ ON node = a WHERE hops < 3 AND NOT list_contains(eids, edge_id))"""


def place_trails(spark, d) -> DataFrame:
    n, r, s = t(spark, d, "nation"), t(spark, d, "region"), t(spark, d, "supplier")
    e = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("edge_id"), F.col("s_name").alias("src"), F.col("n_name").alias("dst"), F.lit("FEEDS").alias("rel"))
    e = e.unionByName(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("edge_id"), F.col("n_name").alias("src"), F.col("r_name").alias("dst"), F.lit("CONNECTS_TO").alias("rel")))
    r2 = r.select(F.col("r_regionkey").alias("k2"), F.col("r_name").alias("dst"))
    e = e.unionByName(r.join(F.broadcast(r2), F.col("k2") == (F.col("r_regionkey") + 1) % 5).select(F.concat(F.lit("x"), F.col("r_regionkey").cast("string")).alias("edge_id"), F.col("r_name").alias("src"), "dst", F.lit("FLOWS_TO").alias("rel")))
    return graph.trails(e, r.select(F.col("r_name").alias("seed")), 3, graph.TRAVERSED)


@checked(f"{TRAILS_SQL} SELECT seed, node, hops, array_to_string(nodes, '>') AS path, array_to_string(rels, '>') AS rels FROM p WHERE hops > 0")
def khop_paths(spark, d):
    """A graph with a cycle of regions."""
    return place_trails(spark, d).select("seed", "node", "hops", F.array_join("nodes", ">").alias("path"), F.array_join("rels", ">").alias("rels"))


@checked(f"{TRAILS_SQL} SELECT seed, node, hops, array_to_string(nodes, '>') AS path FROM p WHERE hops > 0 AND len(list_filter(rels, lambda x: x NOT IN ('CONNECTS_TO', 'FLOWS_TO'))) = 0")
def path_relation_filter(spark, d):
    return graph.only_relations(place_trails(spark, d), ["CONNECTS_TO", "FLOWS_TO"]).select("seed", "node", "hops", F.array_join("nodes", ">").alias("path"))


@checked("SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)steel|brass') THEN 'metal' WHEN regexp_matches(p_type, '(?i)^small') THEN 'small_part' ELSE lower(p_brand) END AS entity_type FROM part")
def entity_type_rules(spark, d):
    return t(spark, d, "part").select("p_partkey", T.first_matching_type(F.col("p_type"), [("steel|brass", "metal"), ("^small", "small_part")], F.col("p_brand")).alias("entity_type"))


@checked("SELECT o_orderkey, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'FEEDS' WHEN contains(lower(o_orderpriority), 'high') THEN 'POWERED_BY' ELSE 'MENTIONS' END AS relation FROM orders")
def relation_keyword_map(spark, d):
    return t(spark, d, "orders").select("o_orderkey", T.first_keyword_relation(F.col("o_orderpriority"), [("URGENT", "FEEDS"), ("high", "POWERED_BY")], "MENTIONS").alias("relation"))


@checked("""WITH m AS (SELECT DISTINCT l_partkey AS name, l_orderkey AS page FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page) AS r FROM m QUALIFY r <= 20)
 SELECT a.page AS source_page, b.page AS target_page, string_agg(DISTINCT a.name::VARCHAR, ',' ORDER BY a.name::VARCHAR) AS shared FROM r a JOIN r b ON a.name = b.name AND a.r < b.r GROUP BY ALL""")
def xref_pairs_capped(spark, d):
    m = t(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("name"), F.col("l_orderkey").alias("page")).distinct().withColumn("ord", F.col("page"))
    return graph.shared_pairs(m).select("source_page", "target_page", F.array_join("shared_entities", ",").alias("shared"))


@checked("SELECT page, string_agg(DISTINCT other::VARCHAR, ',' ORDER BY other::VARCHAR) AS others FROM (SELECT 'n' || s_nationkey AS page, 's' || s_suppkey AS other FROM supplier UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier) GROUP BY 1")
def xref_neighbours(spark, d):
    s = t(spark, d, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("b"))
    return graph.neighbours(s, "a", "b").withColumn("others", F.array_join("others", ","))


# --- structured documents and drawings -----------------------------------------------------------------------------


@checked("WITH c AS (SELECT sha256(html) AS h, arg_max(url, page_id) AS analysis FROM pages WHERE page_id % 2 = 0 GROUP BY 1) SELECT page_id, analysis FROM pages LEFT JOIN c ON sha256(html) = h")
def page_cache_join(spark, d):
    pages = t(spark, d, "pages").select("page_id", "url", F.sha2(F.col("html").cast("binary"), 256).alias("page_hash"))
    cache = pages.filter("page_id % 2 = 0").select("page_hash", F.col("url").alias("analysis"), F.col("page_id").alias("seq"))
    return structured.with_cache(pages.select("page_id", "page_hash"), cache).select("page_id", "analysis")


@checked("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'cache' WHEN length(html) >= 900 AND NOT contains(html, '<img') THEN 'text' ELSE 'vision' END AS route FROM pages")
def page_route(spark, d):
    return t(spark, d, "pages").select("page_id", structured.page_route(F.col("page_id") % 5 == 0, F.length("html"), F.col("html").contains("<img"), 900).alias("route"))


@checked("""WITH d AS (SELECT 'doc' AS source_id, r_regionkey AS page_number, 'About ' || r_name AS description, CASE WHEN r_regionkey % 2 = 0 THEN r_name || ' raw' ELSE '  ' END AS raw_text, r_name FROM region)
 SELECT source_id, page_number, 'description' AS vector_type, 0 AS pos, description AS text FROM d UNION ALL SELECT source_id, page_number, 'raw_text', 0, raw_text FROM d WHERE trim(raw_text) <> ''
 UNION ALL SELECT 'doc', n_regionkey, 'table_row', row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1, '[' || r_name || '] key: ' || n_nationkey || ' | name: ' || n_name || ' | none: ' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def table_row_vectors(spark, d):
    n = t(spark, d, "nation").select("n_regionkey", "n_nationkey", F.create_map(F.lit("name"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string")).alias("row"))
    rows = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.map_entries("row").alias("e")))), lambda x: F.map_from_entries(x["e"])).alias("rows"))
    r = t(spark, d, "region").join(rows, F.col("r_regionkey") == F.col("n_regionkey"))
    pages = r.select(F.lit("doc").alias("source_id"), F.col("r_regionkey").alias("page_number"), F.concat(F.lit("About "), "r_name").alias("description"), F.when(F.col("r_regionkey") % 2 == 0, F.concat("r_name", F.lit(" raw"))).otherwise("  ").alias("raw_text"), F.array(F.struct(F.col("r_name").alias("title"), F.array(F.lit("key"), F.lit("name"), F.lit("none")).alias("columns"), "rows")).alias("tables"))
    return structured.page_vectors(pages)


BOX_SQL = "bx AS (SELECT 'c' || p_partkey AS component_id, p_size AS page, p_partkey AS ord, p_partkey * 7 % 100 AS x, p_partkey * 13 % 100 AS y, 6 AS w, 4 AS h FROM part), ln AS (SELECT o_orderkey AS line_id, o_orderkey % 50 + 1 AS page, o_custkey * 3 % 100 AS x1, o_orderkey % 97 AS y1, o_custkey * 11 % 100 AS x2, o_orderkey * 5 % 89 AS y2 FROM orders)"


@checked(f"""WITH {BOX_SQL}, a AS (SELECT line_id, arg_min(component_id, ord) AS from_id FROM ln JOIN bx ON ln.page = bx.page AND x1 BETWEEN x - 2 AND x + w + 2 AND y1 BETWEEN y - 2 AND y + h + 2 GROUP BY 1),
 b AS (SELECT line_id, arg_min(component_id, ord) AS to_id FROM ln JOIN bx ON ln.page = bx.page AND x2 BETWEEN x - 2 AND x + w + 2 AND y2 BETWEEN y - 2 AND y + h + 2 GROUP BY 1) SELECT * FROM a JOIN b USING (line_id) WHERE from_id <> to_id""")
def bbox_range_join(spark, d):
    boxes = t(spark, d, "part").selectExpr("concat('c', p_partkey) AS component_id", "cast(p_size AS bigint) AS page", "p_partkey AS ord", "p_partkey * 7 % 100 AS x", "p_partkey * 13 % 100 AS y", "6 AS w", "4 AS h")
    lines = t(spark, d, "orders").selectExpr("o_orderkey AS line_id", "o_orderkey % 50 + 1 AS page", "o_custkey * 3 % 100 AS x1", "o_orderkey % 97 AS y1", "o_custkey * 11 % 100 AS x2", "o_orderkey * 5 % 89 AS y2")
    return structured.bound_endpoints(lines, boxes)


@checked("""WITH v AS (SELECT o_custkey AS page, nullif(o_orderstatus, 'P') AS domain, count(nullif(o_orderstatus, 'P')) AS n, min(o_orderkey) AS seen FROM orders GROUP BY ALL)
 SELECT page, coalesce(arg_max(domain, n * 100000000 - seen) FILTER (domain IS NOT NULL), 'mixed') AS domain FROM v GROUP BY 1""")
def domain_vote(spark, d):
    return structured.majority_domain(t(spark, d, "orders").selectExpr("o_custkey AS page", "nullif(o_orderstatus, 'P') AS domain", "o_orderkey AS ord"))


TAG_TEXT = "CASE p_partkey % 7 WHEN 0 THEN 'see /A' || p_size || ' OPC-1' WHEN 1 THEN 'line TO SHEET ' || p_size WHEN 2 THEN p_name WHEN 3 THEN 'to sheet 3 zone B' || p_size WHEN 4 THEN 'continues on sheet ' || p_size WHEN 5 THEN 'Z3.B' || p_size || ' /AB12' ELSE 'OPC_' || p_size || ' end' END"


@checked(f"SELECT p_partkey, coalesce(nullif(regexp_extract({TAG_TEXT}, '/[A-Z][0-9]+'), ''), nullif(regexp_extract({TAG_TEXT}, 'OPC[-_][0-9]+'), ''), nullif(regexp_extract({TAG_TEXT}, '(?i)to[ ]+sheet[ ]+[0-9]+([ ]+zone[ ]+[A-H][0-9]+)?'), ''), nullif(regexp_extract({TAG_TEXT}, '(?i)continues[ ]+(on|at)[ ]+sheet[ ]+[0-9]+'), ''), nullif(regexp_extract({TAG_TEXT}, 'Z[0-9]+[.][A-H][0-9]+'), '')) AS tag FROM part")
def offpage_tags(spark, d):
    return t(spark, d, "part").select("p_partkey", structured.off_page_tag(F.expr(TAG_TEXT)).alias("tag"))


@checked("SELECT user_id AS tag, event_id AS from_page, event_type AS from_component, lead(event_id) OVER w AS to_page, lead(event_type) OVER w AS to_component FROM events WHERE event_type <> 'view' WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY to_component IS NOT NULL")
def offpage_pairing(spark, d):
    tags = t(spark, d, "events").select(F.col("user_id").alias("tag"), F.col("event_id").alias("page"), F.lit(0).alias("ord"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("component"))
    return structured.paired_connectors(tags)


@checked("SELECT s_suppkey, 'valve' || (CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ' labelled ' || s_name END) || (CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ' connected to ' || n_name || ', x' END) || ' on piping drawing page ' || s_nationkey AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def component_description(spark, d):
    s = t(spark, d, "supplier").join(F.broadcast(t(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    links = F.when(F.col("s_suppkey") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("n_name", F.lit("x")))
    return s.select("s_suppkey", structured.component_text(F.lit("valve"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")), links, F.lit("piping"), F.col("s_nationkey")).alias("text"))


# --- sources and telemetry -------------------------------------------------------------------------------------------


@checked("SELECT source, arg_min(lang, doc_id) AS lang, count(*) AS chunk_count FROM documents GROUP BY 1")
def source_aggregate(spark, d):
    return manage.source_totals(t(spark, d, "documents"), "source", "doc_id", ["lang"])


@checked("WITH s AS (SELECT DISTINCT user_id % 200 AS source_id FROM events UNION SELECT 1000), h AS (SELECT user_id % 200 AS source_id, count(*) AS total_hits, count(*) FILTER (value > 10) AS grounded_hits FROM events WHERE event_type = 'click' GROUP BY 1) SELECT source_id, total_hits, grounded_hits, round(CASE WHEN total_hits > 0 THEN grounded_hits / total_hits END, 6) AS grounding_rate FROM s LEFT JOIN h USING (source_id)")
def source_health(spark, d):
    ev = t(spark, d, "events")
    sources = ev.select((F.col("user_id") % 200).alias("source_id")).distinct().unionByName(few(spark, [(1000,)], "source_id long"))
    hits = ev.filter("event_type = 'click'").select((F.col("user_id") % 200).alias("source_id"), (F.coalesce(F.col("value"), F.lit(0.0)) > 10).alias("grounded"))
    return manage.source_health(sources, hits).withColumn("grounding_rate", F.round("grounding_rate", 6))


@checked("SELECT s_suppkey, (s_suppkey % 10 = 0) OR CASE WHEN s_suppkey % 3 = 0 THEN 'old' ELSE 'new' END <> 'new' AS stale FROM supplier")
def mark_stale(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "old").otherwise("new").alias("embedding_model"), (F.col("s_suppkey") % 10 == 0).alias("stale"))
    return manage.marked_stale(s, "new").select("s_suppkey", "stale")


@checked("SELECT sha256(text) AS file_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING n > 1")
def duplicate_sources(spark, d):
    return manage.duplicate_sources(t(spark, d, "documents"), "text", "doc_id")


@checked("WITH e AS (SELECT c_custkey, c_name, c_acctbal, 0 AS seq FROM customer UNION ALL SELECT c_custkey, c_name || '!', c_acctbal + 1, 1 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 10000000, c_name, c_acctbal, 1 FROM customer WHERE c_custkey % 7 = 0) SELECT c_custkey, arg_max(c_name, seq) AS c_name, arg_max(c_acctbal, seq) AS c_acctbal FROM e GROUP BY 1")
def upsert_last_wins(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.filter("c_custkey % 3 = 0").selectExpr("c_custkey", "concat(c_name, '!') AS c_name", "c_acctbal + 1 AS c_acctbal").unionByName(c.filter("c_custkey % 7 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))
    return manage.last_wins(c.withColumn("seq", F.lit(0)), new.withColumn("seq", F.lit(1)), ["c_custkey"], "seq").drop("seq")


@checked("SELECT event_id, user_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 1000")
def telemetry_range_topk(spark, d):
    return manage.telemetry_range(t(spark, d, "events"), "2024-01-05", "2024-01-20").select("event_id", "user_id", "event_type")


@checked("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY ALL")
def usage_rollup(spark, d):
    return manage.usage_rollup(t(spark, d, "events"), ["user_id", "event_type"], "value").withColumn("total", F.round("total", 4))


@checked("SELECT source, lang, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY ALL")
def batch_dedup(spark, d):
    return manage.batch_dedup(t(spark, d, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], "doc_id")


# --- memory ----------------------------------------------------------------------------------------------------------

HASH = r"sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')))"


@checked(f"SELECT conv_id AS memory_id, turn, {HASH} AS text_hash FROM conversations e WHERE turn % 2 = 1 AND NOT EXISTS (SELECT 1 FROM (SELECT conv_id, {HASH} AS h FROM conversations WHERE turn % 2 = 0) s WHERE s.conv_id = e.conv_id AND s.h = {HASH.replace('text', 'e.text')})")
def memory_hash_dedup(spark, d):
    c = t(spark, d, "conversations").withColumnRenamed("conv_id", "memory_id")
    stored = c.filter("turn % 2 = 0").withColumn("text_hash", T.memory_hash(F.col("text")))
    return memory.new_memories(c.filter("turn % 2 = 1"), stored).select("memory_id", "turn", "text_hash")


@checked("SELECT conv_id, turn, array_to_string(list_filter([turn - 1, turn + 1, turn * 2, turn - 1], lambda x: x BETWEEN 0 AND 5), ',') AS linked, 4 - len(list_filter([turn - 1, turn + 1, turn * 2, turn - 1], lambda x: x BETWEEN 0 AND 5)) AS dropped_links FROM conversations")
def memory_link_validate(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", F.expr("array(turn - 1, turn + 1, turn * 2, turn - 1)").alias("linked"), F.expr("sequence(0L, 5L)").alias("known_ids"))
    return memory.valid_links(c).select("conv_id", "turn", F.array_join("linked", ",").alias("linked"), "dropped_links")


@checked("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations QUALIFY r <= 3) SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn, role, text) AS interaction FROM r GROUP BY 1")
def memory_recent_turns(spark, d):
    return memory.interaction_text(assemble.last_turns(t(spark, d, "conversations"), 3))


@checked(f"{LISTS_SQL}, lists AS (SELECT *, 0.5 AS w, 0 AS l FROM dn UNION ALL SELECT *, 0.3, 1 FROM kw), top AS ({fused_sql(10)}) SELECT top.*, coalesce(dn.score, 0) AS semantic_score, coalesce(kw.score, 0) AS keyword_score FROM top LEFT JOIN dn USING (query_id, doc_id) LEFT JOIN kw USING (query_id, doc_id)")
def memory_pillar_scores(spark, d):
    kw, dn = two_lists(spark, d)
    top = search.top_k(search.fused([(dn, 0.5), (kw, 0.3)], "doc_id"), 10, "doc_id").select("query_id", "doc_id", "score", "rank")
    return memory.pillar_scores(top, {"semantic": dn, "keyword": kw})


# --- evaluation -------------------------------------------------------------------------------------------------------

PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def norm_sql(c: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(translate(lower({c}), '{PUNCT}', ''), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')"


@checked(f"SELECT item_id, {norm_sql('text')} AS normal FROM benchmark")
def normalize_answer(spark, d):
    return t(spark, d, "benchmark").select("item_id", T.normalize_answer(F.col("text")).alias("normal"))


CASES_SQL = "cases AS (SELECT a.item_id AS case_id, a.text AS prediction, CASE WHEN a.item_id % 3 = 0 THEN 'The ' || a.text || '!' ELSE b.text END AS reference FROM benchmark a JOIN benchmark b ON b.item_id = (a.item_id + 1) % (SELECT count(*) FROM benchmark))"


def answer_cases(spark, d) -> DataFrame:
    """Each item as the answer to itself (dressed up) or to its neighbour."""
    b = t(spark, d, "benchmark")
    n = b.agg(F.count(F.lit(1)).alias("_n"))
    a = b.crossJoin(F.broadcast(n)).select(F.col("item_id").alias("case_id"), F.col("text").alias("prediction"), ((F.col("item_id") + 1) % F.col("_n")).alias("item_id"))
    ref = F.when(F.col("case_id") % 3 == 0, F.concat(F.lit("The "), "prediction", F.lit("!"))).otherwise(F.col("text"))
    return a.join(b, "item_id").select("case_id", "prediction", ref.alias("reference"))


@checked(f"WITH {CASES_SQL} SELECT case_id, ({norm_sql('prediction')} = {norm_sql('reference')})::INT::DOUBLE AS em FROM cases")
def exact_match_metric(spark, d):
    return answer_cases(spark, d).select("case_id", evaluate.exact_match(F.col("prediction"), F.col("reference")).alias("em"))


F1_SQL = f"""w AS (SELECT case_id, string_split({norm_sql('prediction')}, ' ') AS p, string_split({norm_sql('reference')}, ' ') AS r FROM cases),
 np AS (SELECT case_id, x, count(*) AS n FROM (SELECT case_id, unnest(p) AS x FROM w) GROUP BY ALL), nr AS (SELECT case_id, x, count(*) AS n FROM (SELECT case_id, unnest(r) AS x FROM w) GROUP BY ALL),
 both_ AS (SELECT case_id, sum(least(np.n, nr.n)) AS b FROM np JOIN nr USING (case_id, x) GROUP BY 1),
 f AS (SELECT case_id, CASE WHEN coalesce(b, 0) = 0 THEN 0.0 ELSE 2.0 * b / (len(p) + len(r)) END AS f1 FROM w LEFT JOIN both_ USING (case_id))"""


@checked(f"WITH {CASES_SQL}, {F1_SQL} SELECT case_id, round(f1, 6) AS f1 FROM f")
def token_f1_metric(spark, d):
    return evaluate.token_f1(answer_cases(spark, d)).withColumn("f1", F.round("f1", 6))


HIT_SQL = f"WITH {MANY_Q}, {BM25_CTE}, hits AS ({ranked_sql('bm', 5)}), c AS (SELECT query_id AS case_id, contains({norm_sql('d.text')}, {norm_sql('q.query')}) AS hit FROM hits JOIN documents d USING (doc_id) JOIN q USING (query_id))"


def content_cases(spark, d) -> DataFrame:
    docs = t(spark, d, "documents")
    q = benchmark_queries(spark, d)
    hits = search.top_k(search.bm25_scores(docs, q), 5, "doc_id")
    full = docs.select("doc_id", F.col("text").alias("content")).join(F.broadcast(hits), "doc_id").join(F.broadcast(q), "query_id")
    return full.select(F.col("query_id").alias("case_id"), "rank", "content", F.col("query").alias("reference"))


@checked(f"{HIT_SQL} SELECT case_id, max(hit::INT)::DOUBLE AS recall FROM c GROUP BY 1")
def retrieval_recall(spark, d):
    return evaluate.content_recall_precision(content_cases(spark, d)).select("case_id", "recall")


@checked(f"{HIT_SQL} SELECT case_id, round(avg(hit::INT), 6) AS precision FROM c GROUP BY 1")
def retrieval_precision(spark, d):
    return evaluate.content_recall_precision(content_cases(spark, d)).select("case_id", F.round("precision", 6).alias("precision"))


ID_SQL = "ids AS (SELECT l_orderkey AS case_id, list(DISTINCT l_suppkey) FILTER (l_linenumber <= 2) AS expected, list(l_suppkey ORDER BY l_linenumber) FILTER (l_linenumber > 1) AS retrieved FROM lineitem GROUP BY 1), rp AS (SELECT case_id, CASE WHEN len(expected) > 0 THEN (len(list_filter(coalesce(retrieved, []), lambda x: list_contains(expected, x))) > 0)::INT::DOUBLE END AS recall, CASE WHEN len(expected) > 0 THEN CASE WHEN len(coalesce(retrieved, [])) > 0 THEN len(list_filter(retrieved, lambda x: list_contains(expected, x))) / len(retrieved) ELSE 0.0 END END AS precision FROM ids)"


def id_cases(spark, d) -> DataFrame:
    li = t(spark, d, "lineitem")
    c = li.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_suppkey"))).alias("expected"), F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") > 1, F.struct("l_linenumber", "l_suppkey")))), lambda x: x["l_suppkey"]).alias("retrieved"))
    recall, precision = evaluate.id_recall_precision(F.col("expected"), F.col("retrieved"))
    return c.select("case_id", recall.alias("recall"), precision.alias("precision"))


@checked(f"WITH {ID_SQL} SELECT case_id, recall, round(precision, 6) AS precision FROM rp")
def id_recall_precision(spark, d):
    return id_cases(spark, d).withColumn("precision", F.round("precision", 6))


@checked(f"WITH {CASES_SQL}, {F1_SQL}, g AS (SELECT f.case_id, ({norm_sql('prediction')} = {norm_sql('reference')})::INT::DOUBLE AS em, f1, CASE WHEN f.case_id % 4 > 0 THEN 1.0 END AS recall, 0.5 AS precision, CASE WHEN f.case_id % 5 = 0 THEN 'ungrounded' ELSE 'grounded' END AS grounding FROM f JOIN cases USING (case_id)) SELECT count(*) AS n_cases, round(avg(em), 6) AS mean_em, round(avg(f1), 6) AS mean_f1, CASE WHEN count(recall) = count(*) THEN avg(recall) END AS mean_recall, avg(precision)::DOUBLE AS mean_precision, count(*) FILTER (f1 < 0.5 OR grounding = 'ungrounded') AS n_failed FROM g")
def benchmark_report(spark, d):
    cases = answer_cases(spark, d)
    em = cases.select("case_id", evaluate.exact_match(F.col("prediction"), F.col("reference")).alias("em"))
    full = em.join(evaluate.token_f1(cases), "case_id").withColumns({"recall": F.when(F.col("case_id") % 4 > 0, 1.0), "precision": F.lit(0.5), "grounding": F.when(F.col("case_id") % 5 == 0, "ungrounded").otherwise("grounded")})
    return evaluate.report(full).withColumns({"mean_em": F.round("mean_em", 6), "mean_f1": F.round("mean_f1", 6)})


# --- plug-ins, parsers, streams: no SQL form, held against brute force in the tests --------------------------------


def _pages_of_documents(spark, d) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit(1).alias("page_number"), F.col("text").alias("content"))


@checked()
def chunk_flat(spark, d):
    return chunking.chunks(_pages_of_documents(spark, d))


@checked()
def chunk_parent_child(spark, d):
    return chunking.chunks(_pages_of_documents(spark, d), 60, 10, -1)


@checked()
def embed_plugin(spark, d):
    return plugins.embedded(t(spark, d, "conversations"), plugins.HashEmbeddings(), "text").select("conv_id", "turn", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


@checked()
def rerank_plugin(spark, d):
    docs, q = t(spark, d, "documents"), benchmark_queries(spark, d)
    hits = search.top_k(search.bm25_scores(docs, q), 20, "doc_id").select("query_id", "doc_id")
    full = docs.select("doc_id", F.col("text").alias("content")).join(F.broadcast(hits), "doc_id").join(F.broadcast(q), "query_id").withColumnRenamed("doc_id", "chunk_id")
    return plugins.reranked(full, plugins.OverlapReranker(), 5)


@checked()
def xml_parse(spark, d):
    """Each region with its nations as an XML file."""
    n = t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<nation Name="'), "n_name", F.lit('" key="'), F.col("n_nationkey").cast("string"), F.lit('"/>')))), "").alias("x"))
    files_ = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("path"), F.concat(F.lit("<doc>"), "x", F.lit("</doc>")).cast("binary").alias("content"))
    return markup.xml_pages(files_)


@checked()
def l5x_parse(spark, d):
    """Each nation's suppliers as the modules and tags of a controller export."""
    s = t(spark, d, "supplier").groupBy("s_nationkey").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<Tag Name="'), F.translate("s_name", "#", "_"), F.lit('" DataType="DINT"/>')))), "").alias("tags"),
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<Module Name="'), "s_name", F.lit('" CatalogNumber="1756"/>')))), "").alias("modules"),
    )
    xml = F.concat(F.lit('<RSLogix5000Content><Controller Name="C"><Tags>'), "tags", F.lit("</Tags><Modules>"), "modules", F.lit("</Modules></Controller></RSLogix5000Content>"))
    return markup.controller_export_pages(s.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("path"), xml.cast("binary").alias("content")))


@checked("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_usage(spark, d):
    return ingest.windowed_usage(t(spark, d, "events")).withColumn("total", F.round("total", 4))


# --- entity search, hybrid vectors, stores, references ----------------------------------------------------------------


@checked("""WITH d AS (SELECT s_suppkey AS doc_id, s_name || ' ' || n_name AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey % 2 = 0),
 q AS (SELECT 1 AS query_id, 'FRANCE Supplier#000000007 CHINA' AS query),
 """ + BM25_CTE.replace("documents", "d") + " " + ranked_sql("bm", 10, "doc_id"))
def entity_seed_topk(spark, d):
    """Suppliers as entities, their nation as the value; of one type only."""
    e = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    e = e.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.col("n_name").alias("value"), F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise("odd").alias("entity_type"), F.lit("k").alias("knowledge_id"))
    q = few(spark, [(1, "FRANCE Supplier#000000007 CHINA")], "query_id int, query string")
    return graph.seeds(e, q, 10, ["even"], "k").withColumnRenamed("entity_id", "doc_id")


@checked("""WITH q AS (SELECT n.n_nationkey, n.n_name, n.n_regionkey FROM nation n WHERE n.n_nationkey < 5),
 p AS (SELECT q.n_nationkey, 1 AS pos, '  Path: ' || q.n_name || ' -[FEEDS]-> ' || r_name AS t FROM q JOIN region ON q.n_regionkey = r_regionkey)
 SELECT 'entity:' || n_name || ':nation' AS chunk_id, 1 AS query_id, 1.0::DOUBLE AS score, n_nationkey::INT AS rank, 1 AS connected_count,
 n_name || ' (nation)\n  Specifications: v' || n_nationkey || '\n' || t || '\n  Connected: ' || r_name || ' (region)' AS content FROM q JOIN p USING (n_nationkey) JOIN region ON n_regionkey = r_regionkey""")
def entity_results(spark, d):
    """Nations and the region that each feeds, one hop."""
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    e = n.select(F.concat(F.lit("n"), "n_nationkey").alias("entity_id"), F.col("n_name").alias("name"), F.lit("nation").alias("entity_type"), F.concat(F.lit("v"), "n_nationkey").alias("value"), F.lit("k").alias("knowledge_id"))
    e = e.unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("entity_id"), F.col("r_name").alias("name"), F.lit("region").alias("entity_type"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("knowledge_id")))
    rel = n.select(F.concat(F.lit("n"), "n_nationkey").alias("from_id"), F.concat(F.lit("r"), "n_regionkey").alias("to_id"), F.lit("FEEDS").alias("relation_type"), F.lit("s").alias("source_id"))
    found = n.filter("n_nationkey < 5").select(F.lit(1).alias("query_id"), F.concat(F.lit("n"), "n_nationkey").alias("entity_id"), F.lit(1.0).alias("score"), F.col("n_nationkey").alias("rank"))
    return graph.entity_results(e, rel, found, 1)


@checked(f"""WITH {ONE_Q}, tf AS (SELECT doc_id, term, count(*) AS tf FROM ({TOKS}) GROUP BY ALL), asked AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM q) GROUP BY ALL),
 sp AS (SELECT query_id, doc_id, sum(tf * n)::DOUBLE AS score FROM tf JOIN asked USING (term) GROUP BY ALL),
 ds AS (SELECT 1 AS query_id, e.vec_id AS doc_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7),
 lists AS (SELECT *, 1.0 AS w, 0 AS l FROM ({ranked_sql('ds', 32)}) UNION ALL SELECT *, 1.0, 1 FROM ({ranked_sql('sp', 32)})) {fused_sql(8)}""")
def hybrid_dense_sparse(spark, d):
    """Dense and sparse vectors of the same rows, fused by rank. vec_id = doc_id is a stand-in for a real link."""
    dense = search.dense_scores(t(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), query_vectors(spark, d, "vec_id = 7").withColumn("query_id", F.lit(1)), "doc_id")
    sparse = search.postings(t(spark, d, "documents")).select("doc_id", "term", F.col("tf").cast("double").alias("weight"))
    asked = one_query(spark).select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qweight"))
    return search.hybrid_top_k(dense, search.sparse_scores(sparse, asked), 8, "doc_id")


@checked(f"WITH q AS (SELECT 1 AS query_id, 'all rights' AS query), {BM25_CTE}, x AS (SELECT doc_id, 1.0 AS score, 'exact' AS match_type FROM documents WHERE contains(lower(text), 'all rights')) SELECT * FROM (SELECT doc_id, score::DOUBLE AS score, match_type FROM x UNION ALL SELECT doc_id, round(score, 6), 'bm25' FROM bm WHERE doc_id NOT IN (SELECT doc_id FROM x)) ORDER BY score DESC, doc_id LIMIT 25")
def exact_over_bm25(spark, d):
    return search.exact_over_bm25(t(spark, d, "documents"), "all rights", 25, "doc_id")


@checked("""WITH p AS (SELECT o_custkey AS source_page, o_orderkey AS target_page, ['Customer#' || (o_custkey % 7), 'Customer#' || (o_custkey % 11), 'unknown'][:1 + o_orderkey % 3] AS names, o_orderpriority AS rel FROM orders WHERE o_custkey < 40),
 e AS (SELECT source_page, target_page, rel, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM p WHERE len(names) >= 2),
 k AS (SELECT 'Customer#' || i AS name, 't' || i AS entity_type FROM range(11) r(i))
 SELECT a.source_page, a.target_page, a.name AS from_name, ka.entity_type AS from_type, b.name AS to_name, kb.entity_type AS to_type, CASE WHEN contains(lower(a.rel), 'urgent') THEN 'FEEDS' ELSE 'MENTIONS' END AS relation_type
 FROM e a JOIN e b ON a.source_page = b.source_page AND a.target_page = b.target_page AND a.i < b.i JOIN k ka ON a.name = ka.name JOIN k kb ON b.name = kb.name""")
def cross_relations(spark, d):
    """Pairs of one name are dropped, and names that no entity has."""
    names = F.slice(F.array(F.concat(F.lit("Customer#"), F.col("o_custkey") % 7), F.concat(F.lit("Customer#"), F.col("o_custkey") % 11), F.lit("unknown")), F.lit(1), (1 + F.col("o_orderkey") % 3).cast("int"))
    pairs = t(spark, d, "orders").filter("o_custkey < 40").select(F.col("o_custkey").alias("source_page"), F.col("o_orderkey").alias("target_page"), names.alias("shared_entities"), F.col("o_orderpriority").alias("relationship"))
    e = spark.range(11).select(F.concat(F.lit("Customer#"), "id").alias("name"), F.concat(F.lit("t"), "id").alias("entity_type"))
    return graph.cross_relations(pairs, e, [("urgent", "FEEDS")])


@checked("SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS skipped FROM events")
def batch_stats(spark, d):
    e = t(spark, d, "events")
    return manage.batch_stats(e.select(F.when(F.col("event_type") == "click", "succeeded").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").alias("outcome")))


@checked("SELECT user_id, coalesce(sum(event_id) FILTER (event_type <> 'click'), 0)::BIGINT AS tokens, arg_min(nullif(event_type, 'view'), event_id) FILTER (event_type <> 'view') AS provider, arg_min('m' || event_id, event_id) AS model FROM events GROUP BY 1")
def usage_merge(spark, d):
    rows = t(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "click", F.col("event_id")).alias("tokens"), F.nullif("event_type", F.lit("view")).alias("provider"), F.concat(F.lit("m"), "event_id").alias("model"))
    return manage.merged_usage(rows, ["user_id"], "event_id", ["tokens"])


@checked("SELECT doc_id AS p, concat_ws(chr(10) || chr(10), nullif(lang, 'en'), source, CASE WHEN doc_id % 2 = 0 THEN text END) AS folded FROM documents")
def folded_context(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("p"), T.folded(F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("text"))).alias("folded"))


@checked("SELECT conv_id, string_agg('[Page ' || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1")
def pages_as_text(spark, d):
    c = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("page_number"), F.col("text").alias("content"))).alias("pages"))
    return c.select("conv_id", T.pages_text(F.col("pages")).alias("body"))
