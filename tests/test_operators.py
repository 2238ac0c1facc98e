import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernweave.functions import text as T
from fernweave.operators import assemble, chunking, graph, search, structured


def test_fusion_adds_weights_and_keeps_first_seen(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, id string, rank int")
    got = {r.id: r.score for r in search.fused([(a, 2.0), (b, 0.5)], "id").collect()}
    assert got["b"] == pytest.approx(2 / 62 + 0.5 / 61)
    assert got["a"] == pytest.approx(2 / 61) and got["c"] == pytest.approx(0.5 / 62)


def test_parents_sum_their_children_and_unknown_ones_drop(spark):
    rows = [("c1", 0.8, 1, "P1"), ("c2", 0.7, 2, "P1"), ("c3", 0.6, 3, "P1"), ("x", 0.9, 4, "P9"), ("y", 0.5, 5, None)]
    kids = spark.createDataFrame(rows, "point_id string, score double, rank int, parent_id string")
    got = {r.point_id: r for r in search.expanded_parents(kids, spark.createDataFrame([("P1",)], "point_id string")).collect()}
    assert set(got) == {"c1", "y"}
    assert got["c1"].score == pytest.approx(2.1) and got["c1"].child_hits == 3 and got["c1"].expanded_from == ["c1", "c2", "c3"]


@pytest.mark.parametrize("ordering, n, want", [("primacy_recency", 5, [0, 2, 4, 3, 1]), ("sandwich", 5, [0, 1, 4, 3, 2]), ("sandwich", 2, [0, 1]), ("primacy_recency", 1, [0]), ("score_desc", 3, [0, 1, 2])])
def test_context_orders(spark, ordering, n, want):
    hits = spark.createDataFrame([(1, f"c{i}", str(i), 1.0 - i / 10) for i in range(n)], "query_id int, chunk_id string, content string, score double")
    assert assemble.context(hits, ordering).first().context.split(assemble.SEPARATOR) == list(map(str, want))


def test_small_corpora_have_no_positive_idf(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    assert search.bm25_scores(docs, q).count() == 0


def test_answers_and_ids_in_normal_form(spark):
    d = spark.createDataFrame([("The SAE-30 Oil!", " Pump  A ", "pump a")], "a string, b string, c string")
    r = d.select(T.normalize_answer(F.col("a")).alias("n"), (T.entity_id(F.col("b"), F.lit("X"), F.lit(None)) == T.entity_id(F.col("c"), F.lit("x"), F.lit(""))).alias("same"), (T.entity_id(F.col("b"), F.lit("X"), F.lit("1")) == T.entity_id(F.col("b"), F.lit("X"), F.lit("2"))).alias("other")).first()
    assert r.n == "sae30 oil" and r.same and not r.other


def test_unknown_relation_types_raise(spark):
    with pytest.raises(Exception, match="not allowed"):
        spark.range(1).select(T.relation_type(F.lit("eats"), graph.RELATION_TYPES)).collect()


def test_trails_use_no_edge_twice_in_a_cycle(spark):
    e = spark.createDataFrame([(1, "a", "b", "R"), (2, "b", "c", "R"), (3, "c", "a", "R")], "edge_id int, src string, dst string, rel string")
    got = {(r.node, r.hops, tuple(r.edge_ids)) for r in graph.trails(e, spark.createDataFrame([("a",)], "seed string"), 5).collect()}
    assert max(h for _, h, _ in got) == 3 and all(len(set(x)) == len(x) for _, _, x in got)
    assert sum(h == 3 for _, h, _ in got) == 2


def test_connectors_and_blocks(spark):
    d = spark.createDataFrame([("t", 1, 0, "R1"), ("t", 3, 0, "R2"), ("t", 3, 1, None), ("t", 5, 0, "R3")], "tag string, page int, ord int, component string")
    assert [(r.from_page, r.to_page) for r in structured.paired_connectors(d).orderBy("from_page").collect()] == [(1, 3), (3, 5)]
    b = spark.createDataFrame([("RESISTOR",), ("my_valve_2",), ("zzz",)], "n string")
    assert [r[0] for r in b.select(structured.block_class(F.col("n"), ["resistor", "valve"])).collect()] == ["resistor", "valve", "zzz"]


def test_splitting_by_rule():
    assert [p.text for p in chunking.split_text("one para\n\ntwo para\n\nthree para", 20, 0)] == ["one para\n\ntwo para", "three para"]
    assert chunking.split_text("   \n ", 10, 2) == []
    hard = chunking.split_text("x" * 200, 50, 10)
    assert all(p.hard and len(p.text) <= 50 for p in hard) and len(hard) == 5
    with pytest.raises(ValueError):
        chunking.split_text("a", 5, 5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc de", min_size=1, max_size=12), min_size=1, max_size=30), st.integers(8, 40))
def test_splitting_keeps_all_words_in_order(words, size):
    text = " ".join(words)
    pieces = chunking.split_text(text, size, 0)
    assert "".join("".join(p.text.split()) for p in pieces) == "".join(text.split())
    assert all(len(p.text) <= size for p in pieces)


def test_structure_is_kept_whole_and_sections_are_named(spark):
    text = "# Safety #\n\nintro words here\n\n## Pumps\n\n```\n# not a heading\ncode line\n```\n\n| a | b |\n| 1 | 2 |\n\ntail words"
    assert [t for _, _, t in chunking.headings(text)] == ["Safety", "Pumps"]
    d = spark.createDataFrame([("s", 1, text), ("s", 2, None)], "source_id string, page_number int, content string")
    rows = chunking.chunks(d, 12, 2).orderBy("chunk_index").collect()
    assert any(r.content.startswith("```") and r.content.endswith("```") for r in rows)
    assert rows[-1].section == "Safety > Pumps"
    both = chunking.chunks(d, 6, 1, -1).orderBy("chunk_index").collect()
    assert both[0].chunk_type == "parent" and all(r.parent_id for r in both)


@pytest.mark.parametrize("batch", [10_000, 2])
def test_blocks_of_queries_find_what_single_ones_do(spark, monkeypatch, batch):
    monkeypatch.setattr(search, "BATCH", batch)
    rows = [(i, [float(i % 3), 1.0, float(i % 5)]) for i in range(30)] + [(30, [0.0, 0.0, 0.0]), (31, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.filter("vec_id < 5").selectExpr("vec_id AS query_id", "embedding AS qvec")
    want = search.top_k(search.dense_scores(v, q).filter("score IS NOT NULL"), 4, "vec_id")
    assert sorted(map(tuple, search.dense_top_k(v, q, 4).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert search.dense_top_k(v, q.filter("query_id < 0"), 4).count() == 0
