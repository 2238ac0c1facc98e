"""N-gram Jaccard join by chosen paths, and the groups of near-duplicates that it makes.

1. A text's set: hashes of its shingles (five words in a row; all words of a shorter text). Texts with one set
   are a class; from here on a class is one record with a weight, however many copies there are.
2. Chosen paths: a class has COORDINATES minimum hashes. In each run a tree is walked from its root: at a node
   one or two coordinates are drawn from the node's name alone, so the same for all classes there, and a class
   goes on to the child named by its value. Two classes of similarity s share a child for each drawn coordinate
   with probability s. Buckets of at most LEAF classes are compared pair by pair on their minimum hashes;
   larger ones are split further, and what is still together at the last depth is a candidate as a whole.
   The number of runs follows from the recall asked for, over the number of minimum hashes that two classes share.
3. Candidates make components (large-star and small-star steps on edges). A component's sets meet once, in
   tiles of bounded size, and every pair in it is verified exactly, so that a link is counted once. Only sums
   for each class and one edge to its local group leave a task, never all pairs of a group.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_whole_groups, dropped, lean, looked_up, spread, written
from .words import Hashes, mixed, shingles, words_of

COORDINATES = 64
#: Coordinates drawn at a node: one, or with this probability two.
TWO = 0.25
FIRST_DEPTH, STEP, LAST_DEPTH = 3, 2, 7
LEAF = 100
#: A component's classes are compared in tiles of two chunks. A chunk has about TILE rows, as long as that makes no more
#: than CHUNKS chunks; then chunks grow, up to TILE_ROWS rows or TILE_BYTES of sets, and only beyond that their number.
TILE, CHUNKS, TILE_ROWS, TILE_BYTES = 256, 32, 8192, 16 << 20
#: Up to so many candidates' numbers (8 bytes each) are broadcast to sift their sets before a shuffle.
BROADCAST_ROWS = 2_000_000


def shingle_set(words: list[bytes], size: int, hashes: Hashes) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, in order. All words are one shingle where there are fewer."""
    return np.unique(shingles(hashes.of(words), min(size, len(words)))) if words else np.zeros(0, np.uint64)


_FACTORS = (np.random.default_rng(42).integers(0, 1 << 32, COORDINATES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_OFFSETS = np.random.default_rng(43).integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)[:, None]


def minimum_hashes(s: np.ndarray) -> np.ndarray:
    """COORDINATES 16-bit values; two sets agree in one with about the probability of their similarity."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(s), 8192):
        x = (s[lo : lo + 8192] & np.uint64(0xFFFFFFFF)).astype(np.uint32)[None, :]
        y = (x ^ _OFFSETS) * _FACTORS
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x846CA68B)
        y ^= y >> np.uint32(16)
        least = np.minimum(least, y.min(axis=1))
    return ((least * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def missed(similarity: float, depth: int) -> float:
    """The probability that two sets share no bucket of one run at that depth."""
    q = 0.0
    for _ in range(depth):
        x = 1 - similarity + similarity * q
        q = (1 - TWO) * x + TWO * x * x
    return q


def _agreeing(similarity: float) -> np.ndarray:
    """The probabilities that 0 to COORDINATES minimum hashes of two sets agree."""
    n = COORDINATES
    return np.array([math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k) for k in range(n + 1)])


def leaf_share(similarity: float, recall: float) -> float:
    """The share of agreeing minimum hashes from which on a leaf's pair is a candidate: 0.15 (three times what 64
    draws stray by at 0.8) below the threshold, or less where that alone loses a quarter of what may be missed."""
    below = np.concatenate([[0.0], np.cumsum(_agreeing(similarity))[:-1]])
    most = int(np.flatnonzero(below <= (1 - recall) / 4)[-1])
    return max(0.0, min(similarity - 0.15, most / COORDINATES))


def lost(similarity: float, recall: float, runs: int, depth: int) -> float:
    """The probability that two sets are no candidates after ``runs`` runs. All runs draw from the same minimum
    hashes: they are independent only given how many of these agree, so the expectation is over that number."""
    least = leaf_share(similarity, recall) * COORDINATES
    each = [1.0 if k < least else missed(k / COORDINATES, depth) ** runs for k in range(COORDINATES + 1)]
    return float(_agreeing(similarity) @ np.array(each))


def runs_for(similarity: float, recall: float, depth: int = LAST_DEPTH) -> int:
    """The least number of runs that loses at most 1 - recall, at the last depth and with the test in the leaves."""
    high = 1
    while lost(similarity, recall, high, depth) > 1 - recall:
        high *= 2
        if high > 1 << 16:
            raise ValueError(f"{COORDINATES} minimum hashes can't find pairs at {similarity} with a recall of {recall}")
    low = high // 2
    while high - low > 1:
        runs = (low + high) // 2
        low, high = (runs, high) if lost(similarity, recall, runs, depth) > 1 - recall else (low, runs)
    return high


def children(at: np.ndarray, node: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level down: (record, child) for the records ``at`` at ``node``; values: minimum hashes by record."""
    r = mixed(node + np.uint64(0x9E3779B97F4A7C15))
    one = (r & np.uint64(COORDINATES - 1)).astype(np.int64)
    other = ((r >> np.uint64(16)) & np.uint64(COORDINATES - 1)).astype(np.int64)
    other = np.where(other == one, (one + 1) % COORDINATES, other)
    two = ((r >> np.uint64(32)) & np.uint64(0xFFFF)) < np.uint64(int(TWO * 65536))
    at2, node2 = np.concatenate([at, at[two]]), np.concatenate([node, node[two]])
    c = np.concatenate([one, other[two]])
    v = values[at2, c].astype(np.uint64)
    return at2, mixed(node2 * np.uint64(31) + (c.astype(np.uint64) << np.uint64(16)) + v + np.uint64(1))


def _sketched(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """_row, _id, _th (digest of the text), _sig (of its set; null without words), _n, _mh, _set (32 bits a shingle)."""
    import pyarrow as pa

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            sig, n, mh, sets = [], [], [], []
            for text in batch.column("_text"):
                s = shingle_set(words_of((text.as_py() or "").lower().encode("utf-8")), size, hashes)
                short = (s >> np.uint64(32)).astype(np.uint32)
                short = short[np.concatenate([[True], short[1:] != short[:-1]])] if len(short) else short
                sig.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
                n.append(len(short))
                mh.append(minimum_hashes(s).tobytes() if len(s) else None)
                sets.append(short.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), batch.column("_th"), pa.array(sig, pa.int64()), pa.array(n, pa.int32()), pa.array(mh, pa.binary()), pa.array(sets, pa.binary())], names=["_row", "_id", "_th", "_sig", "_n", "_mh", "_set"])

    text = F.col(text_col).cast("string")
    d = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    return written(d.mapInArrow(lean(run), f"_row long, _id {docs.schema[id_col].dataType.simpleString()}, _th long, _sig long, _n int, _mh binary, _set binary"))


def _values(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, COORDINATES)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _rooted(classes: DataFrame, runs: int) -> DataFrame:
    """(_path, _row) at the first depth, of all runs."""
    import pandas as pd

    def run(batches):
        for b in batches:
            if len(b):
                values, rows = _values(b["_mh"]), b["_row"].to_numpy()
                at = np.tile(np.arange(len(b)), runs)
                node = np.repeat(mixed(np.arange(1, runs + 1, dtype=np.uint64)), len(b))
                for _ in range(FIRST_DEPTH):
                    at, node = children(at, node, values)
                yield pd.DataFrame({"_path": _signed(node), "_row": rows[at]})

    return classes.select("_row", "_mh").mapInPandas(run, "_path long, _row long")


def _deeper(rows: DataFrame) -> DataFrame:
    """STEP levels below (_path, _row, _mh)."""
    import pandas as pd

    def run(batches):
        for b in batches:
            if len(b):
                values, own = _values(b["_mh"]), b["_row"].to_numpy()
                at, node = np.arange(len(b)), b["_path"].to_numpy().copy().view(np.uint64)
                for _ in range(STEP):
                    at, node = children(at, node, values)
                yield pd.DataFrame({"_path": _signed(node), "_row": own[at]})

    return rows.mapInPandas(run, "_path long, _row long")


def _local_groups(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's group, by links i-j."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    return label


def _pairs_in(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j inside each run of rows."""
    ends = np.repeat(starts + sizes, sizes)
    rows = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes)]) if len(starts) else np.zeros(0, np.int64)
    more = ends - rows - 1
    i = np.repeat(rows, more)
    j = np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more) + i + 1
    return i, j


def _compared(buckets: DataFrame, least: float) -> DataFrame:
    """Edges (_a, _b) to the least row of each group in buckets (_path, _row, _mh) of at most LEAF rows."""
    import pandas as pd

    def run(f: pd.DataFrame) -> pd.DataFrame:
        path, rows, values = f["_path"].to_numpy(), f["_row"].to_numpy(), _values(f["_mh"])
        order = np.lexsort((rows, path))
        path, rows, values = path[order], rows[order], values[order]
        starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(path)]]))
        found_i, found_j = [], []
        for lo in range(0, len(starts), 2000):
            i, j = _pairs_in(starts[lo : lo + 2000], sizes[lo : lo + 2000])
            for k in range(0, len(i), 200_000):
                same = (values[i[k : k + 200_000]] == values[j[k : k + 200_000]]).sum(axis=1) >= least * COORDINATES
                found_i.append(i[k : k + 200_000][same])
                found_j.append(j[k : k + 200_000][same])
        label = _local_groups(len(rows), np.concatenate(found_i), np.concatenate(found_j))
        keep = rows[label] < rows
        return pd.DataFrame({"_a": rows[keep], "_b": rows[label][keep]}).drop_duplicates()

    return by_whole_groups(buckets, ["_path"], run, "_a long, _b long")


def _candidates(classes: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, list[DataFrame]]:
    """Edges between classes that may be similar, and the written tables behind them."""
    held: list[DataFrame] = []
    values = classes.select("_row", "_mh")
    frontier = _rooted(classes, runs_for(similarity, recall))
    edges = None
    for depth in range(FIRST_DEPTH, LAST_DEPTH + 1, STEP):
        frontier = written(frontier)
        sizes = frontier.groupBy("_path").agg(F.count(F.lit(1)).alias("_size"), F.min("_row").alias("_hub")).filter("_size > 1")
        shared = written(spread(frontier, sizes.withColumn("_c", F.col("_size")), "_path", frontier.count()))
        dropped(shared.sparkSession, frontier)
        held.append(shared)
        found = _compared(shared.filter(F.col("_size") <= LEAF).select("_path", "_row").join(values, "_row"), leaf_share(similarity, recall))
        large = shared.filter(F.col("_size") > LEAF)
        if depth + STEP > LAST_DEPTH:
            found = found.unionByName(large.filter("_row > _hub").select(F.col("_row").alias("_a"), F.col("_hub").alias("_b")))
        edges = found if edges is None else edges.unionByName(found)
        if large.isEmpty():
            break
        frontier = _deeper(large.select("_path", "_row").join(values, "_row"))
    return edges.distinct(), held


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(_a, _b): each node of the edges (_a > _b) but the roots, with its component's least node. Rounds go on until
    no edge changes; a graph that isn't done after ``most`` rounds (they grow with the logarithm of its size) raises."""
    spark = edges.sparkSession
    e = written(edges)
    n = e.count()
    for _ in range(most):
        if not n:
            return e
        # Large star: every greater neighbour goes to the least one.
        both = e.unionByName(e.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        m = both.groupBy("_a").agg(F.least(F.min("_b"), F.first("_a")).alias("_m"), F.count(F.lit(1)).alias("_c"))
        large = written(spread(both, m, "_a", 2 * n).filter("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).distinct())
        # Small star: all lesser neighbours, and the node itself, go to the least one.
        m = large.groupBy("_a").agg(F.min("_b").alias("_m"), F.count(F.lit(1)).alias("_c"))
        near = spread(large, m, "_a", n)
        small = near.select(F.explode(F.array(F.struct(F.col("_a"), F.col("_m").alias("_b")), F.struct(F.col("_b").alias("_a"), F.col("_m").alias("_b")))).alias("x")).select("x.*").filter("_a > _b").distinct()
        new = written(small)
        now = new.count()
        done = now == n and new.join(e, ["_a", "_b"], "left_anti").isEmpty()
        dropped(spark, e, large)
        e, n = new, now
        if done:
            return e
    raise RuntimeError(f"components aren't complete after {most} rounds; {n} edges are left")


def _grouped(e: DataFrame) -> DataFrame:
    """(_row, _root) of all nodes, roots included."""
    return e.select(F.col("_a").alias("_row"), F.col("_b").alias("_root")).unionByName(e.select(F.col("_b").alias("_row"), F.col("_b").alias("_root")).distinct())


def _linked(members: DataFrame, similarity: float) -> DataFrame:
    """Verified links in tiles (_root, _i, _j; _side 0 or 1; _row, _weight, _n, _set): for each row the weight of
    its partners, and one row that stands for its group here (``_hub``)."""
    import pandas as pd

    def tile(rows, weight, side, sets, crossing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(rows)
        sizes = np.array([len(s) for s in sets], np.int64)
        flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
        vocabulary, ids = np.unique(flat, return_inverse=True)
        marked = np.zeros(len(vocabulary), bool)
        found_i, found_j = [], []
        for i in range(n):
            # In a tile of two chunks each pair has one row of either; in one of one, each pair counts once.
            lo, hi = (int(np.searchsorted(side, 1)), n) if crossing else (i + 1, n)
            if lo >= hi or (crossing and side[i]):
                continue
            own = ids[starts[i] : starts[i] + sizes[i]]
            marked[own] = True
            both = np.add.reduceat(marked[ids[starts[lo] :]], starts[lo:hi] - starts[lo], dtype=np.int64)
            marked[own] = False
            close = np.flatnonzero(both >= similarity * (sizes[i] + sizes[lo:hi] - both) - 1e-9)
            found_i.append(np.full(len(close), i))
            found_j.append(close + lo)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_i, found_j))
        links = np.zeros(n, np.int64)
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        return links, _local_groups(n, i, j), rows

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        f = f.sort_values(["_root", "_i", "_j", "_side", "_row"], kind="stable")
        key = f[["_root", "_i", "_j"]].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
        rows, weight, side, raw = f["_row"].to_numpy(), f["_weight"].to_numpy(), f["_side"].to_numpy(), f["_set"].to_numpy()
        for a, b in zip(cut, cut[1:]):
            links, label, own = tile(rows[a:b], weight[a:b], side[a:b], [np.frombuffer(x, np.uint32) for x in raw[a:b]], key[a][1] != key[a][2])
            out.append(pd.DataFrame({"_row": own, "_links": links, "_hub": own[label]}))
        return pd.concat(out) if out else pd.DataFrame({"_row": [], "_links": [], "_hub": []}).astype("int64")

    return by_whole_groups(members, ["_root", "_i", "_j"], run, "_row long, _links long, _hub long", rows=512)


def _tiled(members: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Deals the members (_row, _root, _weight, _n) of a component to tiles (_i, _j) of bounded size.

    A component that fits a chunk is one tile. A larger one is cut by the sets' sizes into bands, each from a size to
    1 / similarity times that: two sets that are similar enough lie in one band or in neighbouring ones, so others
    are never brought together. A band is cut into chunks, and each two chunks that may hold similar sets are a tile:
    a row goes to as many tiles as its own band and the two beside it have chunks. Also returns a table behind it."""
    band = F.floor(F.log("_n") / -math.log(similarity) + 1e-9).cast("int") if similarity < 1 else F.col("_n")
    d = members.withColumn("_band", band)
    per = written(d.groupBy("_root", "_band").agg(F.count(F.lit(1)).alias("_c"), F.sum(4 * F.col("_n").cast("long")).alias("_s")))
    chunks = F.greatest(F.least(F.ceil(F.col("_c") / TILE), F.lit(CHUNKS)), F.ceil(F.col("_c") / TILE_ROWS), F.ceil(F.col("_s") / TILE_BYTES)).cast("int")
    # A component has as many bands as the logarithm of its largest set's size has steps: a map of tens of entries.
    roots = per.groupBy("_root").agg(((F.sum("_c") <= TILE) & (F.sum("_s") <= TILE_BYTES)).alias("_small"), F.map_from_entries(F.collect_list(F.struct("_band", chunks))).alias("_bands"))
    d = looked_up(d, roots, ["_root"], 64 * per.count(), "inner")
    of = lambda b: F.coalesce(F.element_at("_bands", b), F.lit(0))
    name = lambda b, k: b.cast("long") * F.lit(1 << 32) + k
    here = F.col("_band")
    own = F.when(F.col("_small"), F.lit(0)).otherwise(name(here, F.pmod(F.xxhash64("_row"), of(here).cast("long"))))
    several = lambda b: F.when(of(b) > 0, F.transform(F.sequence(F.lit(0), of(b) - 1), lambda k: name(b, k))).otherwise(F.array().cast("array<bigint>"))
    others = F.when(F.col("_small"), F.array(F.lit(0).cast("long"))).otherwise(F.concat(several(here - 1), several(here), several(here + 1)))
    d = d.select("_row", "_root", "_weight", own.alias("_own"), F.explode(others).alias("_other"))
    return d.select("_row", "_root", "_weight", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).cast("int").alias("_side")), per


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ``class_id`` (the least id of its group: of all that links connect), ``n_links`` (how many
    other rows' shingle sets have a Jaccard similarity to its own of at least ``similarity``, copies included),
    and ``text_hash`` (xxhash64 of the text).

    Words are what words.words_of() finds in the lower-cased text. Texts without a word (null and empty
    ones too) link to nothing. A set holds 32 bits of each shingle's hash: at a similarity of just the threshold two
    different shingles with equal bits (one in 2^32 for any two) can decide. Repeated rows are copies of each other. A group without any id has a null
    class_id. Other columns aren't read. A pair at the threshold is found with at least the probability
    ``recall``, a more similar one with a higher; what is found is verified on the sets.
    """
    spark = docs.sparkSession
    base = _sketched(docs, id_col, text_col, size)
    worded = base.filter("_sig IS NOT NULL")
    copies = written(worded.groupBy("_sig").agg(F.min("_row").alias("_row"), F.count(F.lit(1)).alias("_weight"), F.min("_id").alias("_least")))
    classes = written(base.select("_row", "_mh", "_n").join(copies.select("_row", "_weight"), "_row"))
    edges, held = _candidates(classes, similarity, recall)
    maybe = components(edges)
    dropped(spark, *held)
    members = written(_grouped(maybe).join(classes.select("_row", "_weight", "_n"), "_row"))
    sets = base.select("_row", "_set")
    if members.count() <= BROADCAST_ROWS:
        # Only members' sets go into the shuffle; beyond the bound the join itself drops the others.
        sets = sets.join(F.broadcast(members.select("_row")), "_row", "left_semi")
    tiles, sizes = _tiled(members, similarity)
    with_sets = tiles.join(sets.hint("merge"), "_row")
    linked = written(_linked(with_sets, similarity))
    final = components(linked.filter("_hub <> _row").select(F.greatest("_row", "_hub").alias("_a"), F.least("_row", "_hub").alias("_b")).distinct())
    links = linked.groupBy("_row").agg(F.sum("_links").alias("_links"))
    per_class = written(copies.join(_grouped(final), "_row", "left").join(links, "_row", "left").withColumn("_root", F.coalesce("_root", "_row")))
    least = per_class.groupBy("_root").agg(F.min("_least").alias("_class"), F.count(F.lit(1)).alias("_c"))
    n = base.count()
    of_texts = spread(per_class, least, "_root", n).select("_sig", "_class", (F.col("_weight") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"), F.col("_weight").alias("_c"))
    rows = spread(worded.select("_id", "_th", "_sig"), of_texts, "_sig", n).select("_id", "_th", "_class", "_links")
    alone = base.filter("_sig IS NULL").select("_id", "_th", F.col("_id").alias("_class"), F.lit(0).cast("long").alias("_links"))
    out = written(rows.unionByName(alone))
    dropped(spark, base, copies, classes, maybe, members, sizes, linked, final, per_class)
    return out.select(F.col("_id").alias(id_col), F.col("_class").alias("class_id"), F.col("_links").alias("n_links"), F.col("_th").alias("text_hash"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs``, all columns as they are, with one row of each group of near-duplicates: that of the least id (of
    its rows the one whose text's digest is least). Rows without a word stay, each text once for an id. Groups
    without any id can't be told apart by it: of them each text stays once."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    rows = found.select("class_id", F.col(id_col).alias("_id"), F.col("text_hash").alias("_th"))
    first = rows.filter("_id IS NOT NULL").groupBy("class_id").agg(F.min(F.struct("_id", "_th")).alias("_x")).select("_x.*")
    keep = written(first.unionByName(rows.filter("_id IS NULL AND class_id IS NULL").select("_id", "_th").distinct()))
    dropped(docs.sparkSession, found)
    # The row as one column: its columns may have any names.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_col).alias("_own"), F.xxhash64(F.col(text_col).cast("string")).alias("_hash"))
    on: Column = whole["_own"].eqNullSafe(keep["_id"]) & (whole["_hash"] == keep["_th"])
    return whole.join(keep, on, "left_semi").dropDuplicates(["_own", "_hash"]).select("_doc.*")
