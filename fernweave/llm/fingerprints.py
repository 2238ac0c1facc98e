"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs. DataFrame operations only.

Each distinct paragraph has a 64-bit digest. A sketch is an array of cells (n, k, c): how many digests fell
into the cell, their exclusive or, and the exclusive or of their checks; a digest falls into one cell of each
of three parts. Two sketches subtract cell by cell, so that what both texts hold cancels out; a cell with
one digest left is recognised by its check, its digest is recovered and taken from its other cells, and so
on until all cells are empty: the digests recovered are those that the two texts don't share. If that stops
early, there were more differences than the sketch can hold. The next one is larger: the digests are first
dealt by their high bits into as many blocks as their number asks for, each with a sketch of its own, and a
block that fails again gets a sketch of twice the size. What then still fails (two digests in the same three
cells of all sizes) is settled by comparing the block's digests themselves.

All of it is array arithmetic within a row: the work grows with the text's length to the power 1.5 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A paragraph ends at a line feed, or behind . ! ? with white space after them (texts here rarely have more
#: than a line between blank ones, and short texts would have a single paragraph).
PARAGRAPH = r"\n|(?<=[.!?])\s+"
#: Cells of each of a fingerprint's three parts; of the blocks' sketches, from one try to the next; digests in a block.
PART, BLOCK_PARTS, IN_BLOCK = 4, (8, 16, 32), 6
ROUNDS = 10
#: Rows in a bucket of neighbours, and buckets at most; of so many sampled keys each last one begins a bucket.
BUCKET_ROWS, MAX_BUCKETS, SAMPLED = 128, 1 << 16, 4

_CELL0 = "named_struct('n', 0, 'k', 0L, 'c', 0L)"


def _check(x: str) -> str:
    return f"(xxhash64({x}, 7) & 4294967295L)"


def _placed(fields: str, x: str, part: int) -> str:
    """An element with its check and its cell in each part; other bits for other sizes."""
    return _let("q", f"xxhash64({x}, {part})", f"named_struct({fields}, 'h', {_check(x)}, 'p0', cast(pmod(q, {part}L) AS int), 'p1', cast(pmod(shiftright(q, 20), {part}L) AS int), 'p2', cast(pmod(shiftright(q, 40), {part}L) AS int))")


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _plus(cell: str, n: str, k: str, c: str) -> str:
    return f"named_struct('n', {cell}.n + {n}, 'k', {cell}.k ^ {k}, 'c', {cell}.c ^ {c})"


def cells(signed: str, part: int) -> str:
    """The sketch of an array of (s sign, x digest): three parts of ``part`` cells."""
    known = f"transform({signed}, e -> {_placed("'s', e.s, 'x', e.x", 'e.x', part)})"
    cell = lambda j: f"aggregate(filter(es, e -> e.p{j} = i), {_CELL0}, (a, e) -> {_plus('a', 'e.s', 'e.x', 'e.h')})"
    return _let("es", known, f"concat({', '.join(f'transform(sequence(0, {part - 1}), i -> {cell(j)})' for j in range(3))})")


def peeled(sketch: str, part: int) -> str:
    """The number of digests recovered; null if cells are left."""
    pure = f"array_distinct(transform(filter(st.cells, c -> abs(c.n) = 1 AND {_check('c.k')} = c.c), c -> named_struct('n', c.n, 'k', c.k)))"
    known = f"transform({pure}, e -> {_placed("'n', e.n, 'k', e.k", 'e.k', part)})"
    hit = f"e.p0 = i OR e.p1 + {part} = i OR e.p2 + {2 * part} = i"
    # A digest has one cell in each part: what is taken from a cell are those that were found for it.
    minus = f"aggregate(filter(ps, e -> {hit}), c, (a, e) -> {_plus('a', '(-e.n)', 'e.k', 'e.h')})"
    left = f"transform(st.cells, (c, i) -> CASE WHEN c.n = 0 AND c.k = 0L THEN c ELSE {minus} END)"
    step = _let("ps", known, f"CASE WHEN size(ps) = 0 THEN named_struct('cells', st.cells, 'd', st.d, 'on', false) ELSE named_struct('cells', {left}, 'd', st.d + size(ps), 'on', true) END")
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {sketch}, 'd', 0, 'on', true), (st, r) -> CASE WHEN st.on THEN {step} ELSE st END, st -> CASE WHEN exists(st.cells, c -> c.n != 0 OR c.k != 0L) THEN CAST(NULL AS int) ELSE st.d END)"


def subtracted(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (u, v) -> {_plus('u', '(-v.n)', 'v.k', 'v.c')})"


def signed(digests: str, s: int) -> str:
    return f"transform({digests}, x -> named_struct('s', {s}, 'x', x))"


def _blocks(a: str, b: str) -> str:
    """The number of digests not shared, block by block."""
    exact = "size(array_except(transform(filter(bl, e -> e.s = 1), e -> e.x), transform(filter(bl, e -> e.s = -1), e -> e.x))) + size(array_except(transform(filter(bl, e -> e.s = -1), e -> e.x), transform(filter(bl, e -> e.s = 1), e -> e.x)))"
    tries = [peeled(cells("bl", p), p) for p in BLOCK_PARTS]
    one = f"CASE WHEN size(bl) = 0 THEN 0 ELSE coalesce({', '.join(tries)}, {exact}) END"
    # About size / IN_BLOCK blocks, by two cuts of about the square root of that each.
    inner = f"aggregate(transform(transform(sequence(0L, g - 1L), h -> filter(su, e -> pmod(shiftright(e.x, 24), g) = h)), bl -> {one}), 0, (t, d) -> t + d)"
    outer = f"aggregate(transform(transform(sequence(0L, g - 1L), h -> filter(al, e -> pmod(shiftright(e.x, 44), g) = h)), su -> {inner}), 0, (t, d) -> t + d)"
    return _let("al", f"concat({signed(a, 1)}, {signed(b, -1)})", _let("g", f"cast(ceil(sqrt(size(al) / {float(IN_BLOCK)})) AS bigint)", f"CASE WHEN size(al) = 0 THEN 0 ELSE {outer} END"))


def likeness(a: str, b: str, sketch_a: str, sketch_b: str) -> str:
    """Shared paragraphs among all paragraphs of two texts, from the digests that peeling recovers."""
    d = f"coalesce({peeled(subtracted(sketch_a, sketch_b), PART)}, {_blocks(a, b)})"
    n = f"(size({a}) + size({b}))"
    return f"CASE WHEN {n} = 0 THEN 1.0D ELSE " + _let("df", d, f"cast({n} - df AS double) / cast({n} + df AS double)") + " END"


def digests(text: Column) -> Column:
    """The distinct paragraphs' digests; the empty text, and such of line feeds only, have none."""
    return F.array_distinct(F.transform(F.filter(F.split(text, PARAGRAPH), lambda p: p != ""), lambda p: F.xxhash64(p)))


def shown(sketch: str) -> str:
    """A sketch as text: count, digests and checks of each cell in hexadecimal."""
    return f"array_join(transform({sketch}, c -> concat(lpad(lower(hex(c.n)), 4, '0'), lpad(lower(hex(c.k)), 16, '0'), lpad(lower(hex(c.c)), 8, '0'))), '')"


def with_next(docs: DataFrame, id_col: str, extra: dict[str, Column]) -> DataFrame:
    """Rows (``_id``, ``_text``, those of ``extra``, and ``next_...`` of each but the id): the next row in
    descending order of the id, after the last the first. Rows without an id come last, rows of one id in the
    order of their texts' digests; ids may be of any type that has an order.

    One shuffle of the texts, to buckets of neighbours: rows whose hash lies below a bound, SAMPLED in BUCKET_ROWS,
    are sampled, and a bucket begins at each SAMPLED-th of them, which makes the buckets more alike. Rows of one id, or of none, are spread by their texts' digests; only rows
    that repeat id and text meet in one bucket, where sorting spills. Beside a bucket's own rows goes a copy of the
    row that follows its last one. The buckets' beginnings are a scalar subquery, their first rows are broadcast: at
    most some MAX_BUCKETS ids and numbers each (SAMPLED times that while they are drawn); to the driver goes the number of rows besides.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Descending order of the key is the order of rows: no id is less than any.
    key = F.struct(F.col("_id"), F.bitwise_not(F.xxhash64("_text")).alias("t"))
    d = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_key", key)
    n = d.agg(F.count(F.lit(1))).first()[0]
    buckets = min(MAX_BUCKETS, n // BUCKET_ROWS)
    if buckets > 1:
        below = F.shiftrightunsigned(F.xxhash64("_key", F.lit(5)), 1) <= F.lit(int(((1 << 63) - 1) * min(n, SAMPLED * buckets) // n))
        drawn = F.array_sort(F.collect_set("_key"))
        # One value, held once a task: a row of a join would carry all of it along with each row.
        known = d.filter(below).agg(F.filter(drawn, lambda _, i: i % SAMPLED == SAMPLED - 1).alias("_known")).scalar()
        d = d.withColumn("_bucket", F.lit(0))
        for k in reversed(range((2 * buckets).bit_length())):  # how many bounds the key has reached, by halving
            at = F.col("_bucket") + F.lit(1 << k)
            d = d.withColumn("_bucket", F.when((at <= F.size(known)) & (F.get(known, at - 1) <= F.col("_key")), at).otherwise(F.col("_bucket")))
    else:
        d = d.withColumn("_bucket", F.lit(0))
    # The first row of each bucket that has any is needed in the next one above too, the first of all at the end of the lowest.
    firsts = d.groupBy("_bucket").agg(F.max("_key").alias("_first"))
    above = F.lead("_bucket").over(Window.orderBy("_bucket"))
    lowest = F.first("_bucket").over(Window.orderBy("_bucket"))
    copies = firsts.select(F.col("_first._id").alias("_i"), F.col("_first.t").alias("_t"), F.struct(F.coalesce(above, lowest).alias("bucket"), F.when(above.isNull(), 1).otherwise(0).alias("wrap"), F.lit(True).alias("copy")).alias("_to"))
    copies = copies.groupBy("_i", "_t").agg(F.collect_list("_to").alias("_to"))  # a row begins one bucket: a single entry
    d = d.join(F.broadcast(copies), F.col("_key._id").eqNullSafe(F.col("_i")) & (F.col("_key.t") == F.col("_t")), "left")
    own = F.array(F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("wrap"), F.lit(False).alias("copy")))
    own = F.concat(own, F.coalesce("_to", F.array().cast("array<struct<bucket:int,wrap:int,copy:boolean>>")))
    d = d.select("_id", "_text", "_key", F.explode(own).alias("_at")).select("_id", "_text", "_key", F.col("_at.bucket").alias("_bucket"), F.col("_at.wrap").alias("_wrap"), F.col("_at.copy").alias("_copy"))
    d = d.repartition("_bucket").withColumns(extra)
    follows = Window.partitionBy("_bucket").orderBy("_wrap", F.desc("_key"), "_copy")
    d = d.select("*", *[F.lead(c).over(follows).alias(f"next_{c.lstrip('_')}") for c in ["_text", *extra]])
    return d.filter("NOT _copy").drop("_bucket", "_wrap", "_copy", "_key")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: its id, ``n_chars`` (code points), ``edited_sha256`` (of the edited text's UTF-8: the last
    floor(n_chars / 2) code points replaced by the first as many, or all, of the next document in descending
    order of the id; after the last comes the first), ``fingerprint``, ``edited_fingerprint``, and the likeness
    (0 to 1) of the fingerprint to the edited text's (``near_edited``) and to the next document's (``near_next``).

    A null text counts as empty; texts without paragraphs are like each other (1) and unlike others (0). A
    single row is followed by itself. Rows without an id come last; repeated rows each get their row.
    """
    d = with_next(docs.select(F.col(id_col), F.col("text")), id_col, {"_d": digests(F.col("_text"))})
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    # substring() counts code points, as length() does.
    d = d.select("_id", "_d", F.col("next_d").alias("_nd"), n.cast("long").alias("n_chars"), F.concat(F.substring("_text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("_edited"))
    d = d.select("_id", "n_chars", "_d", "_nd", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("_edited")).alias("_ed"))
    d = d.select("*", *[F.expr(cells(signed(c, 1), PART)).alias(f"{c}_s") for c in ("_d", "_nd", "_ed")])
    return d.select(
        F.col("_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        F.expr(shown("_d_s")).alias("fingerprint"),
        F.expr(shown("_ed_s")).alias("edited_fingerprint"),
        F.expr(likeness("_d", "_ed", "_d_s", "_ed_s")).alias("near_edited"),
        F.expr(likeness("_d", "_nd", "_d_s", "_nd_s")).alias("near_next"),
        F.size("_d").cast("long").alias("n_paragraphs"),
    )
