import pytest
from pyspark.sql import functions as F

from fernweave.errors import ConfigurationError, IngestionError
from fernweave.operators import structured
from fernweave.plans import phases
from fernweave.plans.config import RetrievalConfig
from fernweave.plans.documents import Drawings, StructuredDocuments
from fernweave.plans.engine import KnowledgeEngine
from fernweave.plugins import HashEmbeddings
from fernweave.sources import files, markup

FILES = "path string, content binary"


def binaries(spark, *rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], FILES)


def dxf(entities, blocks="", objects=""):
    section = lambda name, body: f"0\nSECTION\n2\n{name}\n{body}0\nENDSEC\n"
    return (section("BLOCKS", blocks) + section("ENTITIES", entities) + section("OBJECTS", objects) + "0\nEOF\n").encode()


def record(kind, **codes):
    return f"0\n{kind}\n" + "".join(f"{k[1:]}\n{v}\n" for k, v in codes.items())


LAYOUTS = "".join(f"0\nLAYOUT\n1\nsetup\n71\n9\n100\nAcDbLayout\n1\n{n}\n71\n{t}\n330\n{o}\n" for n, t, o in (("Sheet B", 2, "B0"), ("Model", 0, "M0"), ("Sheet A", 1, "A0")))
BLOCK = record("BLOCK", _2="pump_centrifugal_9") + record("LINE", _10=-3, _20=-2, _11=4, _21=6) + record("CIRCLE", _10=1, _20=1) + "0\nENDBLK\n"
SHEETS = dxf(
    record("INSERT", _5="1A", _2="pump_centrifugal_9", _10=10.5, _20=20.5)
    + record("INSERT", _5="1B", _2="nosuch", _10=100, _20=20, _410="Model")
    + record("LINE", _10=14, _20=22, _11=99, _21=21)
    + record("TEXT", _1="to sheet 2", _10=100, _20=20)
    + record("INSERT", _5="2A", _2="tank", _10=7, _20=7, _410="Sheet A")
    + "0\nMTEXT\n410\nSheet A\n10\n7\n20\n7\n3\n{\\fArial;to \n1\nsheet 2}\n"
    + record("TEXT", _1="far away", _10=7, _20=7, _410="Sheet A"),
    BLOCK,
    LAYOUTS,
)


def test_layouts_and_extents_of_drawings(spark):
    rows = {r.ord: r for r in markup.drawing_rows(binaries(spark, ("d.dxf", SHEETS))).collect()}
    assert (rows[0].x, rows[0].y, rows[0].w, rows[0].h) == (7, 18, 7, 8) and (rows[1].w, rows[1].h) == (1, 1)
    assert [rows[i].page for i in range(7)] == [1, 1, 1, 1, 2, 2, 2] and rows[4].layout == "Sheet A" and rows[4].handle == "2A"
    assert rows[5].text == "to sheet 2"
    bad = markup.drawing_rows(binaries(spark, ("x.dxf", dxf(record("LINE", _10="abc"))))).first()
    assert bad.error.startswith("ValueError") and bad.ord is None


def test_points_find_the_first_box_around_them(spark):
    boxes = [(f"c{i}", i % 3, i, (i * 37) % 400 - 200, (i * 53) % 300 - 100, (i * 7) % 90, (i * 11) % 60 if i % 10 else 0) for i in range(120)] + [("sheet", 0, 500, -1000, -1000, 5000, 5000)]
    points = [(k, k % 4, float((k * 29) % 420 - 210), float((k * 31) % 320 - 110)) for k in range(300)] + [(999, 0, None, 1.0)]
    m = structured.BBOX_MARGIN
    want = {}
    for k, page, x, y in points:
        hit = [b for b in boxes if x is not None and b[1] == page and b[3] - m <= x <= b[3] + b[5] + m and b[4] - m <= y <= b[4] + b[6] + m]
        if hit:
            want[k] = min(hit, key=lambda b: (b[2], b[0]))[0]
    p = spark.createDataFrame(points, "k int, page int, x double, y double")
    b = spark.createDataFrame(boxes, "component_id string, page int, ord int, x int, y int, w int, h int")
    assert {r.k: r.component_id for r in structured.components_at(p, b, "k").collect()} == want and len(set(want.values())) > 20


def joined_rows(df) -> int:
    """The most rows that a join of the executed plan made."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        if "Join" in kind:
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_stacked_boxes_dont_meet_all_points(spark):
    boxes = [(f"c{i}", 1, (i * 7919) % 1500, i % 3 + (i % 50) / 100, (i % 30) / 100, 40 + i % 5, 30) for i in range(1500)]
    lines = [(k, 1, float(k % 48), float(k % 37), float(k % 41) + 0.5, float(k % 29)) for k in range(1000)]
    m = structured.BBOX_MARGIN
    first = lambda x, y: min(((b[2], b[0]) for b in boxes if b[3] - m <= x <= b[3] + b[5] + m and b[4] - m <= y <= b[4] + b[6] + m), default=(0, None))[1]
    ends = {k: (first(x1, y1), first(x2, y2)) for k, _, x1, y1, x2, y2 in lines}
    b = spark.createDataFrame(boxes, "component_id string, page int, ord int, x double, y double, w int, h int")
    got = structured.bound_endpoints(spark.createDataFrame(lines, "line_id int, page int, x1 double, y1 double, x2 double, y2 double"), b)
    want = {k: e for k, e in ends.items() if None not in e and e[0] != e[1]}
    assert {r.line_id: (r.from_id, r.to_id) for r in got.collect()} == want and len(want) > 50
    assert joined_rows(got) < 200_000  # of up to 3 000 000 pairs


def test_drawings_from_files_to_the_graph(spark, tmp_path):
    e = KnowledgeEngine(spark, str(tmp_path / "kb"), HashEmbeddings(8))

    def describe(image):
        if image == b"bad":
            raise ValueError("blurred")
        return {"domain": "electrical", "components": [{"component_id": "F1", "symbol_class": "fuse", "label": "F-1", "bbox": [0, 0, 2, 2]}, {"component_id": "M1", "symbol_class": "motor_ac"}], "connections": [{"from_component": "F1", "to_component": "M1", "wire_style": "power"}], "connectors": [{"tag": "/A1", "component": "M1"}]}

    d = Drawings(e, str(tmp_path / "dr"), split=lambda data: [(part, "", True) for part in data.split(b"|")], describe=describe)
    got = d.run(binaries(spark, ("a.dxf", SHEETS), ("copy.dxf", SHEETS), ("b.pdf", b"one|two"), ("broken.dxf", dxf(record("LINE", _10="abc")))), "k")
    assert sorted((r.status, r.note is None) for r in got.collect()) == [("completed", True), ("completed", True), ("failed", False)]
    texts = sorted(r.content for r in e.chunks.read().collect())
    assert texts == sorted(["pump_centrifugal connected to 1B on p_and_id drawing page 1", "nosuch connected to 1A on p_and_id drawing page 1", "tank on p_and_id drawing page 2", *[f"{a} on electrical drawing page {n}" for n in (1, 2) for a in ("fuse labelled F-1 connected to M1", "motor_ac connected to F1")]])
    name = {r.entity_id: r.name for r in e.entities.read().collect()}
    edges = {(name[r.from_id], r.relation_type, name[r.to_id], "cross_sheet=true" in r.context) for r in e.relations.read().collect()}
    assert edges == {("1A", "CONNECTS_TO", "1B", False), ("1B", "CONNECTS_TO", "2A", True), ("F1", "POWERED_BY", "M1", False), ("M1", "CONNECTS_TO", "M1", True)}
    before = d.engine.sources.current()
    d.extract(), d.link(), d.ingest()
    assert d.engine.sources.current() == before
    with pytest.raises(IngestionError, match="blurred"):
        d.run(binaries(spark, ("c.pdf", b"bad")), "k")
    with pytest.raises(IngestionError, match="unsupported"):
        d.render(binaries(spark, ("c.png", b"x")), "k")


XML = b'<r><pump Name="P1" kind="x"/><valve Name="V1"><pump Name="P1"/></valve></r>'
L5X = b'<RSLogix5000Content><Controller Name="C"/></RSLogix5000Content>'


def test_structured_documents_phase_by_phase(spark, tmp_path):
    e = KnowledgeEngine(spark, str(tmp_path / "kb"), HashEmbeddings(8), RetrievalConfig(top_k=20))
    calls = tmp_path / "calls"

    def describe(image):
        with open(calls, "ab") as f:
            f.write(image + b"\n")
        if image == b"bad":
            raise ValueError("blurred")
        return {"description": f"a plan of {image.decode()}", "entities": [{"name": "Pump A", "category": "Pump"}, {"name": "Valve B", "category": "valve", "value": "3 bar"}], "tables": [{"title": "Parts", "columns": ["no", "what"], "rows": [{"no": "1", "what": "seal"}]}], "annotations": ["rev 2"], "page_type": "schematic"}

    def relate(body):
        if "gamma" in body:
            raise ValueError("no idea")
        assert "Page 1 (schematic): a plan of alpha\n  Entities: Pump A, Valve B" in body
        return {"cross_references": [{"source_page": 1, "target_page": 2, "relationship": "pump feeds valve", "shared_entities": ["Pump A", "Valve B", "unknown"]}], "page_clusters": [{"pages": [1, 2], "reason": "same unit"}], "document_summary": "pumps"}

    class Broken:
        name = "store"

        def ingest(self, **what):
            raise ValueError("store is down")

    split = lambda data: [(p, "x" * 400 if p == b"long" else " raw words " if p == b"alpha" else "", False) for p in data.split(b"|")]
    s = StructuredDocuments(e, str(tmp_path / "st"), split, describe, relate, relation_words=[("feeds", "FEEDS")], methods=[Broken()])
    got = s.run(binaries(spark, ("a.pdf", b"alpha|long|bad"), ("b.xml", XML), ("c.xml", L5X), ("d.xml", b"<!DOCTYPE r><r/>"), ("e.pdf", b"bad")), "k")
    by = {r.path: r.source_id for r in s.files.read().collect()}
    rows = {r.source_id: r for r in got.collect()}
    assert [rows[by[p]].status for p in ("a.pdf", "b.xml", "c.xml", "d.xml", "e.pdf")] == ["completed"] * 3 + ["failed"] * 2
    assert "vision:warn:page_3:ValueError(blurred)" in rows[by["a.pdf"]].note and "store:warn:method_failed(store is down)" in rows[by["b.xml"]].note
    chunks = {(r.page_number, r.section): r.content for r in e.chunks.read().filter(F.col("source_id") == by["a.pdf"]).collect()}
    assert chunks == {(1, "description"): "a plan of alpha", (1, "raw_text"): " raw words ", (1, "table_row"): "[Parts] no: 1 | what: seal", (2, "description"): "x" * 400, (2, "raw_text"): "x" * 400}
    shown = {r.embedding_text for r in e.chunks.read().filter("section = 'description'").collect()}
    assert "a plan of alpha\nEntities: Pump A, Valve B\nAnnotations: rev 2" in shown
    role = s.payloads.read().filter("vector_role = 'table_row'").first()
    assert role.cross_references == [2] and role.entities == ["Pump A", "Valve B"] and role.file_type == "pdf"
    name = {r.entity_id: (r.name, r.entity_type, r.value) for r in e.entities.read().collect()}
    assert ("Valve B", "valve", "3 bar") in name.values() and ("P1", "pump", None) in name.values()
    assert [(name[r.from_id][0], r.relation_type, name[r.to_id][0]) for r in e.relations.read().collect()] == [("Pump A", "FEEDS", "Valve B")]
    xml = [(r.source_page, r.target_page, r.relationship) for r in s.references.read().filter(F.col("source_id") == by["b.xml"]).collect()]
    assert xml == [(1, 2, "shared entity: P1")]
    # A page seen before isn't described again, in another knowledge base too; the failed file is tried again.
    seen = calls.read_bytes().split().count(b"alpha")
    s.run(binaries(spark, ("z.pdf", b"gamma|alpha"), ("a.pdf", b"alpha|long|bad")), "other")
    assert calls.read_bytes().split().count(b"alpha") == seen == 1
    note = {r.source_id: r.note for r in e.sources.read().collect()}
    assert any("document_synthesis:warn:ValueError(no idea)" in (n or "") for n in note.values())
    with pytest.raises(ConfigurationError):
        StructuredDocuments(e, str(tmp_path / "s2")).analyze(binaries(spark, ("q.pdf", b"q")), "k")


def test_empty_and_odd_page_images(spark):
    d = files.page_images(binaries(spark, ("a", b"x|y|z"), ("b", b"")), lambda b: [(p, f" {p.decode()} ", False) for p in b.split(b"|")] if b else 1 / 0, pages=[2, 3])
    got = sorted((r.path, r.page_number or 0, r.raw_text_char_count, r.error is None) for r in d.collect())
    assert got == [("a", 2, 1, True), ("a", 3, 1, True), ("b", 0, None, False)]
    assert all(r.page_hash is None or len(r.page_hash) == 32 for r in d.collect())


def test_methods_by_name_and_their_failures():
    class Method:
        def __init__(self, name, fail=False, required=True):
            self.name, self.fail, self.required = name, fail, required

        def ingest(self, **what):
            if self.fail:
                raise ValueError(self.name)

    space = phases.MethodNamespace([Method("a"), Method("b")])
    assert len(space) == 2 and space.a.name == "a" and "b" in space and [m.name for m in space] == ["a", "b"]
    with pytest.raises(AttributeError):
        space.c
    with pytest.raises(ConfigurationError):
        phases.MethodNamespace([Method("a"), Method("a")])
    heard = []
    notes = phases.dispatched([Method("opt", True, False), Method("a")], lambda *x: heard.append(x))
    assert notes == ["opt:warn:method_failed(opt)"] and heard == [(1, 2), (2, 2)]
    with pytest.raises(IngestionError, match="x; y"):
        phases.dispatched([Method("x", True), Method("y", True)])
