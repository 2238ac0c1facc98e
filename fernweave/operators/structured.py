"""Structured documents and drawings: page routing and caching, vectors of tables, geometry, connectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import table_row_text

# Tags that continue a line on another sheet; the first pattern found wins.
OFF_PAGE_PATTERNS = [
    r"/[A-Z]\d+",
    r"OPC[-_]\d+",
    r"(?i)to\s+sheet\s+\d+(\s+zone\s+[A-H]\d+)?",
    r"(?i)continues\s+(on|at)\s+sheet\s+\d+",
    r"Z\d+\.[A-H]\d+",
]
# Symbol classes by domain, in the order in which a block's name is looked up.
SYMBOLS: dict[str, list[str]] = {
    "electrical": ["resistor", "capacitor", "inductor", "diode", "led", "transistor_npn", "transistor_pnp", "mosfet_n", "mosfet_p", "opamp", "ic_dip", "ic_soic", "switch_spst", "switch_spdt", "relay", "battery", "voltage_source", "current_source", "ground", "junction", "off_page_connector", "fuse", "transformer", "motor_dc", "motor_ac", "lamp"],
    "p_and_id": ["valve_ball", "valve_gate", "valve_globe", "valve_check", "valve_control", "pump_centrifugal", "pump_positive_displacement", "tank", "vessel", "heat_exchanger", "compressor", "filter", "instrument_field", "instrument_panel", "flow_transmitter", "pressure_transmitter", "temperature_transmitter", "controller_local", "controller_distributed", "off_page_connector", "pipe_tee", "pipe_reducer"],
    "mechanical": ["bolt", "nut", "washer", "gear", "bearing", "shaft", "dimension_line", "leader_line", "section_view", "datum_feature", "surface_finish_symbol", "gd_t_symbol"],
}
BBOX_MARGIN = 2


def page_route(has_cached: Column, char_count: Column, has_images: Column, threshold: int) -> Column:
    """cache, text (enough text and no image) or vision."""
    text_only = (F.lit(threshold) > 0) & (char_count >= threshold) & ~has_images
    return F.when(has_cached, "cache").when(text_only, "text").otherwise("vision")


def with_cache(pages: DataFrame, cache: DataFrame, key: str = "page_hash", order: str = "seq") -> DataFrame:
    """Pages with the last cached analysis of their hash, null where there is none."""
    last = cache.groupBy(key).agg(F.max_by("analysis", order).alias("analysis"))
    return pages.join(last, key, "left")


def page_vectors(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows to embed: each page's description, its raw text if it isn't blank, each row of its tables.
    ``pages``: source_id, page_number, description, raw_text, tables (title, columns, rows), and what to ``keep``."""
    base = ["source_id", "page_number", *keep]
    described = pages.select(*base, F.lit("description").alias("vector_type"), F.lit(0).alias("pos"), F.col("description").alias("text"))
    raw = pages.filter(F.col("raw_text").rlike(r"(?U)\S")).select(*base, F.lit("raw_text").alias("vector_type"), F.lit(0).alias("pos"), F.col("raw_text").alias("text"))
    tables = pages.select(*base, F.posexplode("tables").alias("t_pos", "t")).select(*base, "t_pos", "t", F.posexplode("t.rows").alias("r_pos", "row"))
    rows = tables.select(*base, F.lit("table_row").alias("vector_type"), (F.col("t_pos") * 10_000 + F.col("r_pos")).alias("pos"), table_row_text(F.col("t.title"), F.col("t.columns"), F.col("row")).alias("text"))
    return described.unionByName(raw).unionByName(rows)


def _first_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """``points`` (page, x, y and what else they have) with boxes that each lies in as ``first`` (ord, component_id): the
    first in order among them, and few others.

    A box lies in some cells (25 at most) of a grid about a quarter as wide as itself; a point looks into one cell of
    each such grid that its page has. Of boxes with the same bounds only the first can be asked for, and in a cell none
    behind the first box that covers the cell: so boxes stacked on each other don't meet their points in all pairs."""
    m = BBOX_MARGIN
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    b = boxes.select("component_id", "page", "ord", (F.col("x") - m).alias("x_lo"), (F.col("x") + F.col("w") + m).alias("x_hi"), (F.col("y") - m).alias("y_lo"), (F.col("y") + F.col("h") + m).alias("y_hi"))
    b = b.filter("x_lo <= x_hi AND y_lo <= y_hi").groupBy("page", "x_lo", "x_hi", "y_lo", "y_hi").agg(F.min(F.struct("ord", "component_id")).alias("first"))
    wide = F.greatest(F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo"), F.lit(1)).cast("double")
    b = b.withColumn("level", F.ceil(F.log2(wide)).cast("int") - 2)
    levels = b.select("page", "level").distinct()
    cells = b.withColumn("cx", F.explode(F.sequence(cell(F.col("x_lo")), cell(F.col("x_hi"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("y_lo")), cell(F.col("y_hi")))))
    # A cell strictly between those of the bounds is covered, however the division rounds.
    covers = (F.col("cx") > cell(F.col("x_lo"))) & (F.col("cx") < cell(F.col("x_hi"))) & (F.col("cy") > cell(F.col("y_lo"))) & (F.col("cy") < cell(F.col("y_hi")))
    keys = ["page", "level", "cx", "cy"]
    last = cells.filter(covers).groupBy(*keys).agg(F.min("first").alias("last"))
    cells = cells.join(last, keys, "left").filter("last IS NULL OR first <= last").drop("last")
    p = points.join(levels, "page").withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y"))})
    return p.join(cells, keys).filter(F.col("x").between(F.col("x_lo"), F.col("x_hi")) & F.col("y").between(F.col("y_lo"), F.col("y_hi")))


def components_at(points: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """For each of points (key, page, x, y) the first in order of the boxes (component_id, page, ord, x, y, w, h) that it
    lies in, with BBOX_MARGIN around each; points in none are left out."""
    return _first_boxes(points, boxes).groupBy(key).agg(F.min("first").alias("first")).select(key, F.col("first.component_id").alias("component_id"))


def bound_endpoints(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines (line_id, page, x1, y1, x2, y2) whose ends lie in two different components (component_id, page, ord,
    x, y, w, h), with BBOX_MARGIN around each; of several the first in order."""
    start = F.col("start")
    ends = lines.filter("line_id IS NOT NULL").withColumn("start", F.explode(F.array(F.lit(True), F.lit(False))))
    ends = ends.select("line_id", "page", "start", F.when(start, F.col("x1")).otherwise(F.col("x2")).alias("x"), F.when(start, F.col("y1")).otherwise(F.col("y2")).alias("y"))
    both = _first_boxes(ends, boxes).groupBy("line_id").agg(F.min(F.when(start, F.col("first"))).alias("a"), F.min(F.when(~start, F.col("first"))).alias("b"))
    return both.select("line_id", F.col("a.component_id").alias("from_id"), F.col("b.component_id").alias("to_id")).filter("from_id <> to_id")


def majority_domain(components: DataFrame, key: str = "page") -> DataFrame:
    """The most common domain of each page, of equal ones the first seen; "mixed" if there is none."""
    votes = components.groupBy(key, "domain").agg(F.count("domain").alias("n"), F.min("ord").alias("seen"))
    best = votes.groupBy(key).agg(F.max_by("domain", F.struct(F.when(F.col("domain").isNotNull(), F.col("n")), -F.col("seen"))).alias("domain"))
    return best.withColumn("domain", F.coalesce("domain", F.lit("mixed")))


def off_page_tag(text: Column, patterns: list[str] | None = None) -> Column:
    found = [F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in (OFF_PAGE_PATTERNS if patterns is None else patterns)]
    return F.coalesce(*found)


def paired_connectors(tags: DataFrame) -> DataFrame:
    """Neighbouring hits (tag, page, ord, component) of one tag: from each to the next by page."""
    w = Window.partitionBy("tag").orderBy("page", "ord")
    d = tags.filter("component IS NOT NULL").withColumns({"to_page": F.lead("page").over(w), "to_component": F.lead("component").over(w)})
    return d.filter("to_component IS NOT NULL").select("tag", F.col("page").alias("from_page"), F.col("component").alias("from_component"), "to_page", "to_component")


def component_text(symbol: Column, label: Column, links: Column, domain: Column, page: Column) -> Column:
    """"class labelled L connected to a, b on D drawing page N", without what is missing."""
    return F.concat_ws(
        " ",
        symbol,
        F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit("labelled "), label)),
        F.when(F.size(links) > 0, F.concat(F.lit("connected to "), F.array_join(links, ", "))),
        F.concat(F.lit("on "), domain, F.lit(" drawing page "), page.cast("string")),
    )


def symbol_library(more: dict[str, list[str]] | None = None, base: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """The library (the default one, or ``base``) with further classes; a class that a domain has isn't added again."""
    out = {k: list(v) for k, v in (SYMBOLS if base is None else base).items()}
    for domain, names in (more or {}).items():
        own = out.setdefault(domain, [])
        own += [n for n in dict.fromkeys(names) if n not in own]
    return out


def listed_symbols(library: dict[str, list[str]]) -> str:
    """"DOMAIN: a, b" lines in the order of the domains' names, for a prompt."""
    return "\n".join(f"{d.upper()}: {', '.join(library[d])}" for d in sorted(library))


def block_class(name: Column, library: list[str]) -> Column:
    """The library's class of a block name: the same, else one that holds the other, in order; else the name."""
    return block_symbol(name, {"": library})["symbol_class"]


def block_symbol(name: Column, library: dict[str, list[str]] | None = None) -> Column:
    """A struct of ``domain`` and ``symbol_class`` for a block's name: of the class with the same name, else of the first
    that holds the name or is held by it, else "mixed" and the name in lower case."""
    low = F.lower(name)
    every = [(d, s) for d, names in (SYMBOLS if library is None else library).items() for s in names]
    found = lambda d, s: F.struct(F.lit(d).alias("domain"), F.lit(s).alias("symbol_class"))
    none = F.struct(F.lit("mixed").alias("domain"), low.alias("symbol_class"))
    chain = reduce(lambda acc, x: acc.when(low == x[1].lower(), found(*x)), every, F.when(F.lit(False), none))
    chain = reduce(lambda acc, x: acc.when(low.contains(x[1].lower()) | F.lit(x[1].lower()).contains(low), found(*x)), every, chain)
    return chain.otherwise(none)


def merged_extracts(old: DataFrame, new: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """Pages with the maps of an earlier and a later analysis as one; the later one's values win."""
    both = old.select(*keys, F.col(data).alias("_old")).join(new.select(*keys, F.col(data).alias("_new")), keys, "full")
    empty = F.create_map().cast("map<string,string>")
    later = F.coalesce("_new", empty)
    kept = F.map_filter(F.coalesce("_old", empty), lambda k, v: ~F.map_contains_key(later, k))
    return both.select(*keys, F.map_concat(kept, later).alias(data))


def joined_names(entities: Column) -> Column:
    """The names of an array of entities, in order, comma-joined: the text that their vector is made of."""
    return F.array_join(F.transform(entities, lambda e: e["name"]), ", ")
