import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.llm import common, similarity
from fernweave.llm.words import Hashes, mixed, words_of


def sets_of(texts):
    h = Hashes()
    return [frozenset(similarity.shingle_set(words_of((t or "").lower().encode()), 5, h).tolist()) for t in texts]


def brute(rows):
    """(id, class, links) of each row, by comparing all."""
    sets, up = sets_of([t for _, t in rows]), list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, least.get(root(k)), links[k]) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed=4):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("aeiourstln") for _ in range(draw.randint(2, 7)))
    vocabulary = [word() for _ in range(400)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    rows, common = [], text(12)
    for k in range(60):
        rows.append(common + text(draw.randint(20, 80)))
    base = text(120)
    for k in range(40):  # a group of near copies, and some at the border
        t = list(base)
        for _ in range(draw.randint(0, 3)):
            t[draw.randrange(len(t))] = draw.choice(vocabulary)
        rows.append(t)
    rows += [rows[3]] * 9
    out = [(k * 3 % 1000, " ".join(t)) for k, t in enumerate(rows)]
    return out + [(2001, ""), (2002, None), (2003, "!!"), (2004, "Two words"), (2005, "two  WORDS"), (None, "two words"), (2001, "")]


@pytest.mark.parametrize("leaf, tile, sifted, chunks, size", [(100, 256, 1000, 32, 1 << 20), (2, 7, 0, 32, 1 << 20), (100, 3, 1000, 2, 900)])
def test_links_and_classes_by_brute_force(spark, monkeypatch, leaf, tile, sifted, chunks, size):
    """Also with small buckets, small tiles, components cut to bands and chunks by rows and by bytes, salted joins."""
    monkeypatch.setattr(similarity, "CHUNKS", chunks)
    monkeypatch.setattr(similarity, "TILE_BYTES", size)
    monkeypatch.setattr(common, "BROADCAST_BYTES", sifted)
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", sifted)
    monkeypatch.setattr(similarity, "LEAF", leaf)
    monkeypatch.setattr(similarity, "TILE", tile)
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("x"))
    got = similarity.near_duplicates(d, recall=0.9999)
    worded = [(i, c, n) for i, c, n in brute(rows) if n or i is not None]
    found = sorted(((r.doc_id, r.class_id, r.n_links) for r in got.collect()), key=str)
    assert found == worded


def test_one_of_each_group_stays(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    kept = similarity.one_of_each(d, recall=0.9999)
    assert kept.columns == d.columns
    want = sorted({c for i, c, _ in brute(rows) if c is not None})
    assert sorted(r.doc_id for r in kept.collect()) == want
    clash = d.withColumns({"_th": F.lit("x"), "_doc": F.lit(1), "_id": F.lit(2), "class_id": F.lit(3), "a.b": F.lit(4)})
    again = similarity.one_of_each(clash, recall=0.9999)
    assert again.columns == clash.columns and sorted(r.doc_id for r in again.collect()) == want and again.filter("_th = 'x'").count() == len(want)
    nameless = d.filter("doc_id IS NULL").unionByName(d.filter("doc_id IS NULL"))
    assert similarity.one_of_each(nameless).count() == 1
    assert similarity.one_of_each(d.filter(F.lit(False))).count() == 0


def test_runs_follow_from_the_recall():
    assert similarity.runs_for(0.8, 0.99) > similarity.runs_for(0.8, 0.9) >= 1
    assert similarity.missed(1.0, 5) == 0.0


def test_pairs_at_the_threshold_meet_at_the_last_depth():
    """No bucket is small here: a pair is found only by sharing a node of the last depth, in any run."""
    draw, pairs = np.random.default_rng(7), 6000
    a = draw.integers(0, 1 << 16, (pairs, similarity.COORDINATES), dtype=np.uint16)
    b = np.where(draw.random(a.shape) < 0.8, a, a ^ np.uint16(1))
    met = np.zeros(pairs, bool)
    for run in range(1, similarity.runs_for(0.8, 0.99) + 1):
        nodes = []
        for values in (a, b):
            at, node = np.arange(pairs), np.full(pairs, mixed(np.array([run], np.uint64))[0])
            for _ in range(similarity.LAST_DEPTH):
                at, node = similarity.children(at, node, values)
            nodes.append(set(zip(at.tolist(), node.tolist())))
        met[[i for i, _ in nodes[0] & nodes[1]]] = True
    assert 1 - met.mean() <= 0.01
    assert all(similarity.lost(s, 0.99, similarity.runs_for(0.8, 0.99), d) <= 0.01 for s in (0.8, 0.82, 0.9, 1.0) for d in (3, 5, 7))


def test_components_of_a_long_chain(spark):
    n = 300
    e = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1001, 1000)], "_a long, _b long")
    got = {r._a: r._b for r in similarity.components(e).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def test_components_that_are_not_done_raise(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(300)], "_a long, _b long")
    with pytest.raises(RuntimeError, match="complete"):
        similarity.components(e, most=1)
    assert similarity.components(e.filter("_a < 0")).count() == 0


def test_recall_at_the_registered_rate(spark):
    """1500 pairs with a similarity of just 0.8 and a little above, by the parameters of the registered query."""
    draw = random.Random(11)
    rows, n = [], 0
    for k in range(1500):
        base = [f"w{draw.randrange(10**6)}" for _ in range(140)]
        other = list(base)
        for at in draw.sample(range(10, 130, 11), 3):  # each takes five of 136 shingles
            other[at] = f"w{draw.randrange(10**6)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    sets = sets_of([t for _, t in rows])
    alike = [k for k in range(1500) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])]
    got = {r.doc_id: r.class_id for r in similarity.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[2 * k + 1] == 2 * k for k in alike)
    assert len(alike) > 1400 and found >= 0.985 * len(alike)
    assert all(got[i] == i or i % 2 for i in got)


def test_rows_of_hot_keys_are_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    keys = [1] * 40 + [2] * 3 + [3] + [None]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int")
    per = rows.groupBy("k").agg(F.max("i").alias("m"), F.count(F.lit(1)).alias("_c"))
    got = sorted(map(tuple, common.spread(rows, per, "k", len(keys)).select("k", "i", "m").collect()))
    assert got == sorted((k, i, {1: 39, 2: 42, 3: 43}[k]) for i, k in enumerate(keys) if k)


def test_components_with_hubs_equal_a_union_find(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    edges = {(i, 0) for i in range(1, 60)} | {(1000, i) for i in range(500, 560)} | {(i + 1, i) for i in range(200, 240)} | {(300, 20), (301, 300), (710, 705)}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r._a: r._b for r in similarity.components(spark.createDataFrame(sorted(edges), "_a long, _b long")).collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}
