import json

import pytest
from pyspark.sql import functions as F

from fernweave.errors import ConfigurationError, IngestionError
from fernweave.operators import enrich, manage
from fernweave.plans import phases
from fernweave.telemetry import Events, Telemetry, jsonl_sink, parquet_sink


def test_large_documents_are_skipped_and_failures_noted(spark):
    docs = spark.createDataFrame([("a", 10), ("b", 10**6)], "source_id string, estimated_tokens long")
    chunks = spark.createDataFrame([("a", "x"), ("a", "boom"), ("b", "y")], "source_id string, content string")

    def say(text):
        if text == "boom":
            raise ValueError("no")
        return f"about {text}"

    got = {r.content: (r.context, r.note) for r in enrich.situated(chunks, docs, say).collect()}
    assert got["x"] == ("about x", None) and got["y"][1].endswith("too large") and got["boom"] == (None, "contextual:warn:ValueError: no")
    asked = enrich.expanded(chunks, lambda t: "q1\n\nq2" if t != "boom" else 1 / 0)
    assert {r.content: len(r.questions) for r in asked.collect()} == {"x": 2, "boom": 0, "y": 2}
    assert not enrich.mostly_failed(asked).first().failed


def test_weights(spark):
    d = spark.createDataFrame([("manual",), ("odd",)], "t string")
    assert [r[0] for r in d.select(enrich.source_weight(F.col("t"), {})).collect()] == [1.0, 1.0]
    with pytest.raises(Exception, match="no weight"):
        d.select(enrich.source_weight(F.col("t"), {"manual": 2.0})).collect()


def test_drawings_become_graphs(spark):
    comps = spark.createDataFrame([("R1", "R-1", "resistor", "el", 1), ("V1", "", "valve", "el", 1)], "component_id string, label string, symbol_class string, domain string, page int")
    wires = spark.createDataFrame([("R1", "V1", "power", {"b": "2", "a": "x;y"}), ("V1", "Z9", "odd", {})], "from_component string, to_component string, wire_style string, properties map<string,string>")
    got = {(r.from_name, r.from_type, r.to_name, r.to_type, r.relation_type, r.context) for r in enrich.drawing_relations(wires, comps).collect()}
    assert got == {("R1", "resistor", "V1", "valve", "POWERED_BY", "a='x;y';b=2"), ("V1", "valve", "Z9", "component", "CONNECTS_TO", "")}


def test_source_lookups(spark):
    s = spark.createDataFrame([("a", "k", "h", 1, "m1", False), ("b", "j", "h", 2, "m2", False)], "source_id string, knowledge_id string, file_hash string, created_at int, embedding_model string, stale boolean")
    assert [r.source_id for r in manage.listed_sources(s).collect()] == ["b", "a"]
    assert manage.found_by_hash(s, "h").first().source_id == "a" and manage.found_by_hash(s, "h", "j").first().source_id == "b"
    ids = spark.createDataFrame([("zz", 0), ("a", 1)], "source_id string, ord int")
    assert [(r.source_id, r.knowledge_id) for r in manage.by_ids(s, ids).collect()] == [("zz", None), ("a", "k")]
    assert manage.embedding_migration(s, "m1").first().to_migrate == 1
    p = spark.createDataFrame([("p", {"a": "1"}), ("q", {"a": "1"})], "point_id string, payload map<string,string>")
    assert {r.point_id: r.payload for r in manage.with_payload(p, ["p"], {"a": "2", "b": "3"}).collect()} == {"p": {"a": "2", "b": "3"}, "q": {"a": "1"}}
    assert s.select(manage.without_credentials(F.lit("db://u:p@h/x"))).first()[0] == "db://h/x"


def test_phases_go_on_where_they_stopped():
    done, seen = [], []
    steps = {p: (lambda p=p: seen.append(p)) for p in phases.DRAWING}
    assert phases.resume("extracted", phases.DRAWING, steps, done.append) == "completed" and done == ["linked", "completed"] == seen
    with pytest.raises(IngestionError):
        phases.resume(None, phases.STRUCTURED, {"analyzed": lambda: 1 / 0}, done.append)
    with pytest.raises(ConfigurationError):
        phases.remaining("odd", phases.DRAWING)
    assert phases.route(".pdf", "drawing") == "drawing" and phases.route(".L5X", None) == "structured" and phases.route("md", None) == "plain"


def test_runs_are_written_whatever_happens(spark, tmp_path):
    def broken(_):
        raise OSError("full")

    log = str(tmp_path / "t.jsonl")
    t = Telemetry(broken, jsonl_sink(log), parquet_sink(spark, str(tmp_path / "t")))
    with pytest.raises(ValueError), t.run("query", "k") as r:
        with r.timed("retrieval"):
            r.add(hits=3)
        raise ValueError("x")
    row = json.loads(open(log).read())
    assert row["outcome"] == "error" and row["counts"] == {"hits": 3} and spark.read.parquet(str(tmp_path / "t")).first().outcome == "error"
    seen = []
    e = Events("warn", seen.append)
    e.emit("info", "a")
    e.emit("error", "b", ValueError("y"))
    assert [x["event"] for x in seen] == ["b"] and seen[0]["error_type"] == "ValueError"
