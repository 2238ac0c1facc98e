import pytest

from pyspark.sql import functions as F

from fernweave import plugins
from fernweave.errors import ConfigurationError, DuplicateSourceError, MemoryNotFoundError, SourceNotFoundError
from fernweave.operators import enrich, evaluate, search, structured
from fernweave.plans.config import ChunkingConfig, MemoryConfig, RetrievalConfig, RoutingConfig
from fernweave.plans.engine import KnowledgeEngine, MemoryEngine, document_only, hybrid
from fernweave.plugins import HashEmbeddings, OverlapReranker, Retrying, WordSparse, model_name
from fernweave.sources import files, markup
from fernweave.sources.snapshots import SnapshotTable
from fernweave.streaming.ingest import ingest_records


def test_engine_from_ingest_to_answer(spark, tmp_path):
    e = KnowledgeEngine(spark, str(tmp_path / "kb"), HashEmbeddings(), RetrievalConfig(top_k=3), RoutingConfig("auto", 1_000), reranker=OverlapReranker())
    filler = [(f"s{i}", 1, f"filler text number {i} about nothing at all") for i in range(6)]
    pages = spark.createDataFrame([("pump", 1, "The torque of the pump is 30 newton metres."), *filler], "source_id string, page_number int, content string")
    assert e.ingest(pages, "kb1").count() == 7
    with pytest.raises(DuplicateSourceError):
        e.ingest(pages, "kb1")
    hits = e.retrieve("torque of the pump", knowledge_id="kb1").collect()
    assert hits[0].source_id == "pump" and hits[0].rank == 1 and len(hits) <= 3
    assert e.mode("kb1") == "direct" and e.query("what torque?", "kb1")["mode"] == "direct"
    assert e.remove("pump") == 1
    with pytest.raises(SourceNotFoundError):
        e.remove("pump")


def test_memories_are_kept_once(spark, tmp_path):
    m = MemoryEngine(spark, str(tmp_path / "mem"), lambda text: [x.split("] ", 1)[1] for x in text.split("\n") if x.startswith("[user]")])
    turns = spark.createDataFrame([(1, 0, "user", "I like tea"), (1, 1, "assistant", "ok"), (1, 2, "user", "I live in Rome"), (2, 0, "user", "I run far")], "memory_id int, turn int, role string, text string")
    assert m.add(turns) == 3
    assert m.add(turns) == 0
    row = m.rows.read().filter("text = 'I like tea'").first()
    m.update(1, row.memory_row_id, "I like coffee")
    assert m.rows.read().filter("text = 'I like coffee'").count() == 1
    m.delete(1, row.memory_row_id)
    with pytest.raises(MemoryNotFoundError):
        m.delete(1, row.memory_row_id)


def test_bounds():
    for bad in (lambda: RetrievalConfig(top_k=0), lambda: RetrievalConfig(source_weights={"a": 11}), lambda: RoutingConfig("x"), lambda: RoutingConfig("auto", 10)):
        with pytest.raises(ConfigurationError):
            bad()


def test_snapshots(spark, tmp_path):
    s = SnapshotTable(spark, str(tmp_path / "t"), ["k"])
    s.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    s.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"))
    assert sorted(map(tuple, s.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert s.delete() == 0 and s.delete(k=[1, 3]) == 2 and s.count() == 1


def test_stream_ingest_restarts_where_it_stopped(spark, tmp_path):
    src, t = str(tmp_path / "in"), SnapshotTable(spark, str(tmp_path / "out"), ["kb", "title"])
    d = spark.createDataFrame([("k", "a", 1), ("k", "a", 2), ("k", "b", 3)], "kb string, title string, n int")
    for _ in range(2):
        d.coalesce(1).write.mode("append").parquet(src)
        ingest_records(spark, src, d.schema, t, str(tmp_path / "cp"), ["kb", "title"]).awaitTermination()
        assert t.count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("hello")
    (tmp_path / "b.txt").write_text("  \n")
    (tmp_path / "c.bin").write_bytes(b"\0")
    assert [(r.content, r.page_number) for r in files.text_pages(spark, str(tmp_path)).collect()] == [("hello", 1)]
    pages = files.parsed_pages(files.files(spark, str(tmp_path), ["md", "bin"]), lambda b: [b.decode().upper(), " "] if b != b"\0" else 1 / 0)
    assert {(r.content, r.error is None) for r in pages.collect()} == {("HELLO", True), (None, False)}
    assert files.page_range("1-3, 8,,") == [1, 2, 3, 8]
    for bad in ("", "0", "3-1", "x"):
        with pytest.raises(ValueError):
            files.page_range(bad)


def test_markup(spark):
    xml = b'<r><pump Name="P1" max="3">x<valve id="V"/></pump></r>'
    evil = b'<!DOCTYPE r [<!ENTITY a "b">]><r>&a;</r>'
    d = spark.createDataFrame([("ok", bytearray(xml)), ("evil", bytearray(evil))], "path string, content binary")
    rows = {r.path: r for r in markup.xml_pages(d).collect()}
    assert [e.name for e in rows["ok"].entities] == ["P1", "V"] and "pump (Name=" in rows["ok"].description
    assert "not allowed" in rows["evil"].error
    dxf = "0\nSECTION\n2\nENTITIES\n0\nINSERT\n2\nresistor\n10\n0\n20\n5\n0\nLINE\n10\n5\n20\n5\n11\n55\n21\n5\n0\nENDSEC\n0\nEOF\n"
    g = markup.drawing_rows(spark.createDataFrame([("d", bytearray(dxf.encode()))], "path string, content binary")).orderBy("ord").collect()
    assert [(r.kind, r.x1, r.block_name) for r in g] == [("INSERT", 0.0, "resistor"), ("LINE", 5.0, None)]


PAGES = "source_id string, page_number int, content string"


def test_pages_stay_in_order_and_half_an_ingest_leaves_nothing(spark, tmp_path, monkeypatch):
    e = KnowledgeEngine(spark, str(tmp_path / "kb"), None, routing=RoutingConfig("auto", 1_000), chunks=ChunkingConfig(size=4, overlap=0))
    assert e.mode() == "direct" and e.query("anything?")["mode"] == "direct"
    pages = spark.createDataFrame([("s", 2, "five six seven. eight nine ten eleven."), ("s", 1, "one two three. four and more of it.")], PAGES)
    e.ingest(pages, "k")
    rows = e.chunks.read().orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and [r.page_number for r in rows] == sorted(r.page_number for r in rows)
    seen = []
    e.generator = type("G", (), {"generate": lambda self, prompt: seen.append(prompt) or "ok"})()
    e.query("q?", "k")
    order = [seen[0].index(w) for w in ("one", "four", "five", "eight", "q?")]
    assert order == sorted(order)
    with pytest.raises(DuplicateSourceError):
        e.ingest(spark.createDataFrame([("a", 1, "same text"), ("b", 1, "same text")], PAGES), "k")
    monkeypatch.setattr(e.sources, "upsert", lambda rows: 1 / 0)
    before = e.chunks.count()
    with pytest.raises(ZeroDivisionError):
        e.ingest(spark.createDataFrame([("t", 1, "other text")], PAGES), "k")
    assert e.chunks.count() == before


def names():
    """An extractor, made here so that it is sent by value: capitalised words are entities; "broken" fails."""

    class Names:
        def extract(self, text):
            if "broken" in text:
                raise ValueError("no")
            return [{"name": w.strip("."), "type": "thing", "value": "seen"} for w in text.split() if w[:1].isupper()]

    return Names()


def test_all_searches_together(spark, tmp_path):
    e = hybrid(spark, str(tmp_path / "kb"), HashEmbeddings(), WordSparse(), extractor=names())
    filler = [(f"s{i}", 1, f"some plain words number {i} about nothing") for i in range(8)]
    d = e.ingest(spark.createDataFrame([("p", 1, "the Pump feeds Tank seven"), ("v", 1, "a Valve is closed"), *filler], PAGES), "k")
    assert d.filter("note IS NOT NULL").count() == 0 and {r.name for r in e.entities.read().collect()} == {"Pump", "Tank", "Valve"}
    rel = spark.createDataFrame([("Pump", "thing", "Tank", "thing", "feeds", "k", "p", "", 1), ("Tank", "thing", "Nowhere", "thing", "feeds", "k", "p", "", 2), ("Tank", "thing", "Valve", "thing", "controlled by", "k", "v", "", 3)], "from_name string, from_type string, to_name string, to_type string, relation_type string, knowledge_id string, source_id string, context string, seq int")
    e.add_relations(rel)
    assert e.relations.count() == 2
    trace = {}
    hits = e.retrieve("Pump", knowledge_id="k", top_k=30, trace=trace).collect()
    assert set(trace) == {"semantic", "keyword", "entity", "fused", "final"}
    best = {h.chunk_id: h for h in hits}
    assert best["entity:Pump:thing"].content == "Pump (thing)\n  Specifications: seen\n  Path: Pump -[FEEDS]-> Tank\n  Path: Pump -[FEEDS]-> Tank -[CONTROLLED_BY]-> Valve\n  Connected: Tank (thing)\n  Connected: Valve (thing)"
    assert "p" in {h.source_id for h in hits} and [h.rank for h in hits] == list(range(1, len(hits) + 1)) and all(h.score < 0.1 for h in hits)
    lines = e.trace("Pump", 2, ["FEEDS"], "k").first().content
    assert "FEEDS" in lines and "CONTROLLED_BY" not in lines
    note = e.ingest(spark.createDataFrame([("x", 1, "broken Thing here")], PAGES), "k").filter("source_id = 'x'").first().note
    assert note.startswith("entities:warn") and e.chunks.count(source_id="x") == 1
    e.remove("v")
    assert {r.name for r in e.entities.read().collect()} == {"Pump", "Tank"} and e.relations.count() == 1


def test_one_search_keeps_its_scores_and_weights_of_sources_count(spark, tmp_path):
    e = document_only(spark, str(tmp_path / "kb"))
    rows = [("a", 1, "pump torque pump"), ("b", 1, "pump and other longer words here"), *[(f"s{i}", 1, f"filler number {i}") for i in range(9)]]
    e.ingest(spark.createDataFrame(rows, PAGES), "k")
    raw = e.retrieve("pump", knowledge_id="k").collect()
    assert [h.source_id for h in raw] == ["a", "b"] and raw[0].score > 1
    weighed = KnowledgeEngine(spark, str(tmp_path / "w"), None, RetrievalConfig(entity_weight=0.0, source_weights={"manual": 10.0, "note": 0.1}))
    weighed.ingest(spark.createDataFrame(rows[:1] + rows[2:], PAGES), "k", "note")
    weighed.ingest(spark.createDataFrame(rows[1:2], PAGES), "k", "manual")
    assert [h.source_id for h in weighed.retrieve("pump", knowledge_id="k").collect()] == ["b", "a"]
    with pytest.raises(ConfigurationError):
        weighed.ingest(spark.createDataFrame([("z", 1, "zz")], PAGES), "k", "odd")
    asked = e.retrieve("filler", history=[("user", "pump"), ("assistant", "torque")], knowledge_id="k", top_k=20).collect()
    assert {"a", "b", "s1"} <= {h.source_id for h in asked}


def test_parents_stand_for_their_children(spark, tmp_path):
    e = KnowledgeEngine(spark, str(tmp_path / "kb"), HashEmbeddings(), RetrievalConfig(keyword_weight=0.0, entity_weight=0.0, expand_parents=True), chunks=ChunkingConfig(size=5, overlap=0, parent_size=40))
    e.ingest(spark.createDataFrame([("a", 1, "red pump one two. red pump three four. red pump five six."), ("b", 1, "blue tank zero")], PAGES), "k")
    top = e.retrieve("red pump", knowledge_id="k").first()
    assert top.source_id == "a" and "one two" in top.content and "five six" in top.content and top.score > 1


def test_memories_by_three_searches(spark, tmp_path):
    m = MemoryEngine(spark, str(tmp_path / "mem"), lambda text: [x.split("] ", 1)[1] for x in text.split("\n")], HashEmbeddings(), lambda t: [w for w in t.split() if w[:1].isupper()])
    facts = ["likes green tea", "lives in Rome now", "works with Python", "has a dog", "walks at night", "reads old books"]
    m.add(spark.createDataFrame([(1, i, "user", x) for i, x in enumerate(facts)], "memory_id int, turn int, role string, text string"))
    got = m.search(1, "where in Rome", 3).collect()
    assert got[0].text == "lives in Rome now" and got[0].entity_score == 1.0 and got[0].keyword_score > 0 and got[0].semantic_score > 0
    assert m.search(1, " ").count() == 0
    with pytest.raises(ConfigurationError):
        MemoryConfig(0, 0, 0)


def test_readers_keep_their_snapshot(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), ["k"])
    for v in range(2):
        t.upsert(spark.createDataFrame([(1, v)], "k int, v int"))
    old, first = t.read(), t.current()
    t.upsert(spark.createDataFrame([(1, 2)], "k int, v int"))
    assert old.first().v == 1 and t.read().first().v == 2
    t.restore(first)
    assert t.read().first().v == 1
    for v in range(5, 9):
        t.upsert(spark.createDataFrame([(1, v)], "k int, v int"))
    assert t.read().first().v == 8 and len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("v-")]) == 3


def test_fixed_values_of_drawings_and_rungs(spark):
    tags = ["/A2", "see OPC_12", "to sheet 3 zone B2", "Continues on sheet 4", "Z3.B2", "/AB12", "FROM SHEET 4", "OPC 7"]
    d = spark.createDataFrame([(t,) for t in tags], "t string")
    assert [r[0] for r in d.select(structured.off_page_tag(F.col("t"))).collect()] == ["/A2", "OPC_12", "to sheet 3 zone B2", "Continues on sheet 4", "Z3.B2", None, None, None]
    names = spark.createDataFrame([("RESISTOR",), ("my_tank_2",), ("Zzz",)], "n string")
    assert [tuple(r[0]) for r in names.select(structured.block_symbol(F.col("n"))).collect()] == [("electrical", "resistor"), ("p_and_id", "tank"), ("mixed", "zzz")]
    library = structured.symbol_library({"mechanical": ["bolt", "cam"], "own": ["x"]})
    assert library["mechanical"][-1] == "cam" and library["mechanical"].count("bolt") == 1 and structured.listed_symbols({"b": ["y"], "a": ["x", "z"]}) == "A: x, z\nB: y"
    assert enrich.WIRE_RELATIONS["pneumatic"] == enrich.WIRE_RELATIONS["hydraulic"] == "FLOWS_TO"
    xml = b'<X><Controller Name="C"><Programs><Program Name="P"><Routines><Routine Name="R" Type="RLL"><RLLContent><Rung Number="0"><Text>XIC(a)</Text></Rung><Rung Number="1"><Comment>Emergency stop</Comment><Text>OTE(b)</Text></Rung></RLLContent></Routine></Routines></Program></Programs></Controller></X>'
    pages = markup.controller_export_pages(spark.createDataFrame([("p", bytearray(xml))], "path string, content binary")).collect()
    assert [(r.page_type, r.fault_rungs, r.has_fault_words) for r in pages] == [("controller", [], False), ("routine", [1], True)]


def test_plugins_that_fail(spark):
    calls = []

    class Bad:
        def embed(self, texts):
            calls.append(1)
            raise ValueError("down")

    assert Retrying(Bad(), HashEmbeddings(4), retries=1, wait=0.0).embed(["a"]) == HashEmbeddings(4).embed(["a"]) and len(calls) == 2
    with pytest.raises(ValueError):
        Retrying(Bad(), retries=0).embed(["a"])
    assert model_name(HashEmbeddings()) == "hash"
    c = spark.createDataFrame([(1, "ctx", 0.9), (2, "bad", 0.9), (3, "no", 0.1)], "query_id int, context string, best double")
    gate = evaluate.relevance_gate(c, lambda x: x == "ctx" if x != "bad" else 1 / 0)
    assert {r.query_id: r.passed for r in gate.collect()} == {1: True, 2: True, 3: False}
    j = evaluate.judged(spark.createDataFrame([("a", "a"), ("a", "b"), (None, "c")], "prediction string, reference string"), lambda p, r: 7 if p == r else -1 if p else 1 / 0)
    assert sorted((r.reference, r.judgment) for r in j.collect()) == [("a", 1.0), ("b", 0.0), ("c", None)]
    f1 = evaluate.token_f1_best(spark.createDataFrame([(1, "red oil", ["blue", "the red oil"]), (2, "x", []), (3, "a b c", ["c d"])], "case_id int, prediction string, references array<string>"))
    assert {r.case_id: round(r.f1, 3) for r in f1.collect()} == {1: 1.0, 2: 0.0, 3: 0.5}


def test_words_of_queries_are_cut_as_texts_are(spark):
    d = spark.createDataFrame([(1, "use c++ and the pump"), (2, "nothing")], "doc_id int, text string")
    found = lambda q: [r.doc_id for r in search.all_terms_hits(d, q).collect()]
    assert found("C++") == [1] == found("the, pump") and found("") == [] == found(" !! ")


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), ["k", "n"], ["k"], ["v"])
    rows = lambda *x: spark.createDataFrame(list(x), "k int, n int, v string")
    t.upsert(rows())
    assert t.count() == 0 and t.read().columns == ["k", "n", "v"]
    t.upsert(rows(*[(k, n, f"{k}.{n}") for k in range(40) for n in range(3)], (1, 1, "again")))
    assert t.count() == 120
    before = t._last()["buckets"]
    t.upsert(rows((5, 0, "new"), (5, 9, "more")))
    after = t._last()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and t.count() == 121 and t.read().filter("k = 5 AND n = 0").first().v == "new"
    assert t.delete(k=7) == 3 and t.delete(k=7) == 0 and t.count() == 118
    was = t.current()
    t.upsert(rows())
    assert t.current() == was
    t.upsert(spark.createDataFrame([(5, 0, "wide"), (1 << 40, 0, "x")], "k long, n int, v string"))
    assert t.count() == 119 and t.read().filter("k = 5 AND n = 0").first().v == "wide" and dict(t.read().dtypes)["k"] == "bigint"
    t.upsert(rows((5, 0, "narrow")))
    assert t.count() == 119 and t.read().filter("k = 5 AND n = 0").first().v == "narrow"
    t.restore(was)
    assert t.count() == 118
    t.delete(n=[0, 1, 2, 9])
    assert t.count() == 0 and t.read().columns == ["k", "n", "v"]


def test_own_metrics_cuts_and_usage(spark):
    cases = spark.createDataFrame([("a b", "a b"), ("a", "b c"), (None, "x")], "prediction string, reference string")
    each, means = evaluate.measured(cases, {"same": lambda p, r: (p == r).cast("int"), "shorter": lambda p, r: F.length(p) < F.length(r)})
    row = means.first()
    assert (row.n_cases, row.same, row.shorter) == (3, 0.5, 0.5) and each.columns == ["prediction", "reference", "same", "shorter"]
    docs = spark.createDataFrame([(1, "red-green blue", ["red-green", "blue"]), (2, "green", ["green"]), (3, None, None), (4, "x", ["x"])], "doc_id int, text string, terms array<string>")
    q = spark.createDataFrame([(1, "green")], "query_id int, query string")
    cut = lambda c: F.split(F.lower(c), " ")
    found = lambda **how: {r.doc_id: round(r.score, 9) for r in search.bm25_scores(docs, q, **how).collect()}
    assert set(found(cut=cut)) == {2} and set(found(stored="terms")) == {2}
    calls = spark.createDataFrame([("a",), ("bb",), ("boom",)], "text string")
    m = plugins.metered(calls, lambda x: (x.upper(), {"input_tokens": len(x), "output_tokens": None}) if x != "boom" else 1 / 0)
    assert tuple(plugins.usage(m).first()) == (3, 1, 3, 0) and {r.value for r in m.collect()} == {"A", "BB", None}
