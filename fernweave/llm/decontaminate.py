"""Benchmark decontamination by a prefix-filtered set join over windows of an item's words.

A window (ten consecutive words of an item, or all of a shorter one) is a set of tokens: its shingles of five words,
each with its place. A text holds the window only if it holds all of them, so the rarest one alone is the whole
necessary prefix at containment 1: tokens are ordered by the number of documents that hold them, counted over the
whole corpus. One pass over the texts finds the tokens that any window has, by a bit table of bounded size, and
keeps stretches of neighbouring tokens that are as long as the shortest window needs (the bound on length). The
rest is joins: tokens with their counts, the rarest of each window with the places in texts, and there the bounds
on position (the window must lie inside its stretch) and the comparison word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, looked_up, written
from .words import Hashes, shingles, words_of

#: Words of a token (fewer in a shorter window); tokens' places that are passed on together.
SHINGLE, PIECE = 5, 256
#: Bits of the table for a token (which sets two), and of the table at most (32 MB: what is sent to the executors). A
#: fuller table lets more places through to the joins, which drop them.
BITS_EACH, MOST_BITS = 32, 1 << 28


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def _windows(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """(item, win: words joined by spaces, len, k: words of a token, hashes of the tokens), a row an occurrence."""
    import pyarrow as pa

    schema = pa.schema([("item", pa.string()), ("win", pa.string()), ("len", pa.int32()), ("k", pa.int32()), ("hashes", pa.list_(pa.int64()))])

    def rows(batches) -> Iterator[tuple]:
        known = Hashes()
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                if words:
                    n, shown = min(size, len(words)), [w.decode("utf-8", "replace") for w in words]
                    k = min(SHINGLE, n)
                    h = shingles(known.of(words), k).view(np.int64)
                    for i in range(len(words) - n + 1):
                        yield item, " ".join(shown[i : i + n]), n, k, h[i : i + n - k + 1]

    def run(batches):
        held = []
        for row in rows(batches):
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").cast("binary").alias("text")).filter("text IS NOT NULL")
    return items.mapInArrow(run, "item string, win string, len int, k int, hashes array<long>")


def _bit_table(windows: DataFrame, tokens: int) -> np.ndarray:
    """Two bits for each token, at its hash's last bits and at others: 64-bit words, at most MOST_BITS bits whatever the
    benchmark."""
    bits = 1 << 16
    while bits < min(MOST_BITS, BITS_EACH * tokens):
        bits *= 2
    at = windows.select(F.explode("hashes").alias("h")).select(F.explode(F.array(F.pmod("h", F.lit(bits)), F.pmod(F.shiftright("h", 32), F.lit(bits)))).alias("b"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))
    words = at.groupBy(F.shiftright("b", 6).alias("i")).agg(F.bit_or(one).alias("w")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("i").to_numpy()] = words.column("w").to_numpy().view(np.uint64)
    return table


def _stretches(places: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(first, last) of each run of at least ``least`` neighbouring places."""
    cut = np.flatnonzero(np.diff(places) != 1)
    firsts, lasts = np.concatenate([places[:1], places[cut + 1]]), np.concatenate([places[cut], places[-1:]])
    for a, b in zip(firsts.tolist(), lasts.tolist()):
        if b - a + 1 >= least:
            yield a, b


def _scanned(docs: DataFrame, table: np.ndarray, least: dict[int, int], size: int, id_col: str, text_col: str) -> DataFrame:
    """The pass over the texts: _row, _id, _h1 and _h2 (of the text), n_words, seen (its different tokens that the table
    knows), and pieces of stretches: k, first (the place of its first word), lo (of its first token), hashes of the
    tokens, words (of all windows that these tokens may belong to). ``least``: by k the tokens that the shortest
    window has."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(table)
    piece = pa.struct([("k", pa.int32()), ("first", pa.int32()), ("lo", pa.int32()), ("hashes", pa.list_(pa.int64())), ("words", pa.list_(pa.string()))])

    def run(batches):
        bits, known = sent.value, Hashes()
        last = np.uint64(len(bits) * 64 - 1)

        def marked(b: np.ndarray) -> np.ndarray:
            return (bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            n_words, seen, pieces = [], [], []
            for text in batch.column("_text"):
                words = words_of(text.as_py() or b"")
                h = known.of(words)
                own_seen, own = [], []
                for k, needed in least.items():
                    s = shingles(h, k)
                    places = np.flatnonzero(marked(s & last))
                    places = places[marked((s[places] >> np.uint64(32)) & last)]
                    if not len(places):
                        continue
                    own_seen += np.unique(s[places]).view(np.int64).tolist()
                    for a, z in _stretches(places, needed):
                        for lo in range(a, z + 1, PIECE):
                            hi = min(z, lo + PIECE - 1)
                            first = max(a, lo - (size - k))
                            shown = [w.decode("utf-8", "replace") for w in words[first : min(z + k, hi + size)]]
                            own.append({"k": k, "first": first, "lo": lo, "hashes": s[lo : hi + 1].view(np.int64), "words": shown})
                n_words.append(len(words))
                seen.append(own_seen)
                pieces.append(own)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "_id", "_h1", "_h2")), pa.array(n_words, pa.int64()), pa.array(seen, pa.list_(pa.int64())), pa.array(pieces, pa.list_(piece))], names=["_row", "_id", "_h1", "_h2", "n_words", "seen", "pieces"])

    text = F.col(text_col).cast("string")
    d = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2"), text.cast("binary").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return d.mapInArrow(run, f"_row long, _id {kind}, _h1 long, _h2 long, n_words long, seen array<long>, pieces array<struct<k:int,first:int,lo:int,hashes:array<long>,words:array<string>>>")


def _occurrences(docs: DataFrame, benchmark: DataFrame, size: int, id_col: str, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(scanned texts, occurrences: _row, start, len, win; items: win, item; the written tables behind them)."""
    raw = written(_windows(benchmark, size, item_col, item_text))
    windows = written(raw.select("win", "len", "k", "hashes").dropDuplicates(["win"]))
    items = written(raw.select("win", "item").distinct())
    dropped(docs.sparkSession, raw)
    least = {r.k: r.n for r in windows.groupBy("k").agg(F.min(F.col("len") - F.col("k") + 1).alias("n")).collect()}  # SHINGLE rows at most
    tokens = windows.agg(F.sum(F.size("hashes"))).first()[0] or 0
    scanned = written(_scanned(docs, _bit_table(windows, tokens), least, size, id_col, text_col))
    each = windows.select("win", "len", F.posexplode("hashes").alias("at", "h"))
    # Of the tokens seen, those that are the benchmark's: the table alone can't tell.
    own = looked_up(scanned.select(F.explode("seen").alias("h")), each.select("h").distinct(), ["h"], 12 * tokens, "inner")
    counts = own.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rated = looked_up(each, counts, ["h"], 12 * tokens, "left")
    # A window's rarest token; one that no text holds ends the window's part.
    rarest = rated.groupBy("win", "len").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "at")).alias("x")).filter("x.df > 0")
    prefixes = written(rarest.select("win", "len", "x.h", "x.at"))
    places = scanned.select("_row", F.explode("pieces").alias("s")).select("_row", "s", F.posexplode("s.hashes").alias("i", "h"))
    off = F.col("s.lo") + F.col("i") - F.col("s.first")
    before = F.least(off, F.lit(size) - F.col("s.k"))
    near = F.slice("s.words", off - before + 1, F.lit(2 * size) - F.col("s.k"))
    places = places.select("_row", "h", (F.col("s.lo") + F.col("i")).alias("p"), before.alias("before"), near.alias("near"))
    met = looked_up(places, prefixes, ["h"], 150 * prefixes.count(), "inner")
    lo = F.col("before") - F.col("at")
    inside = (lo >= 0) & (lo + F.col("len") <= F.size("near"))
    same = F.when(inside, F.array_join(F.slice("near", F.greatest(lo, F.lit(0)) + 1, F.col("len")), " ") == F.col("win")).otherwise(False)
    found = written(met.filter(same).select("_row", (F.col("p") - F.col("at")).alias("start"), "len", "win"))
    dropped(docs.sparkSession, windows, prefixes)
    return scanned, found, items, [scanned, found, items]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``n_items``,
    ``items`` (ids as text, sorted, comma-joined), ``items_sha256`` of that, ``contaminated`` (n_hit > 0).

    A null or empty text has no words and isn't hit; an item without words has no window; a null item id is
    named by the empty text, and rows of one item id count as one item. Repeated rows of ``docs`` each get
    their row. Other columns aren't read. Either table may be empty.
    """
    scanned, found, items, held = _occurrences(docs, benchmark, size, id_col, text_col, item_col, item_text)
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end"))))
    # Words up to the furthest end so far count once.
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate("x", zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")), lambda a: a["n"])
    hit = found.groupBy("_row").agg(spans.alias("x")).select("_row", covered.cast("long").alias("n_hit"))
    named = looked_up(found.select("_row", "win"), items, ["win"], 120 * items.count(), "inner")
    of_row = named.groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("_items"))
    out = scanned.select("_row", "_id", "n_words").join(hit, "_row", "left").join(of_row, "_row", "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce(F.array_join("_items", ","), F.lit(""))
    n_items = F.coalesce(F.size("_items"), F.lit(0))
    out = written(out.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.when(F.col("_items").isNull(), 0).otherwise(n_items).cast("long").alias("n_items"), listed.alias("items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")))
    dropped(docs.sparkSession, *held)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, in whose text no window of any item occurs. A text is known
    again by 128 bits of hashes."""
    scanned, found, items, held = _occurrences(docs, benchmark, size, text_col, text_col, item_col, item_text)
    bad = written(scanned.join(found.select("_row").distinct(), "_row", "left_semi").select("_h1", "_h2").distinct())
    dropped(docs.sparkSession, *held)
    text = F.col(f"`{text_col}`").cast("string")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2"))
    return looked_up(whole, bad, ["_h1", "_h2"], 16 * bad.count(), "left_anti").select("_doc.*")


def oracle_sql(size: int = 10) -> str:
    """contamination() over the tables documents and benchmark in DuckDB's SQL: all windows of a text, joined by equality."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    cut = "array_to_string(w[pos:pos + len - 1], ' ')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
    b AS (SELECT item_id, {words} AS w FROM benchmark),
    items AS (SELECT DISTINCT item_id, len, {cut} AS win FROM (SELECT *, least({size}, len(w)) AS len, unnest(range(1, greatest(1, len(w) - {size} + 1) + 1)) AS pos FROM b WHERE len(w) > 0)),
    starts AS (SELECT rid, pos, len, {cut} AS win FROM (SELECT rid, w, l.len AS len, unnest(range(1, len(w) - l.len + 2)) AS pos FROM d, (SELECT DISTINCT len FROM items) l WHERE len(w) >= l.len)),
    found AS (SELECT rid, pos, s.len AS len, item_id FROM starts s JOIN items i ON s.win = i.win AND s.len = i.len),
    hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + len)) AS p FROM found) GROUP BY 1),
    ids AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM found GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)"""
