import math
import pickle
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fernweave.llm import common, decontaminate, language, pii, quality

SF = "/root/testdata/sf0.01"

# --- personal data --------------------------------------------------------------------------------------------------

PLAIN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(t):
    out = []
    for k, p in enumerate(PLAIN):
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (13 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_fixed_patterns_as_written():
    draw = random.Random(6)
    for _ in range(20000):
        t = "".join(draw.choice("0123456789@@..-+ () aé%") for _ in range(draw.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t)


def test_long_texts_take_linear_time():
    m = pii.SemiMarkov()
    for t in ("a" * 300_000, "9" * 300_000, "a@" * 100_000, "+" * 300_000, "1." * 150_000):
        pii.find_spans(t, m)


@pytest.fixture(scope="module")
def crf(spark):
    return pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_the_model_adds_and_never_takes_away(spark, crf):
    model = pickle.loads(crf)
    base, every = pii.find_spans("call (301) 555-0346 or a.b@c.example.com", model)
    assert [s[0] for s in base] == [0] and set(base) <= set(every) and any(s[0] == 3 for s in every)
    for clean in ("on 2024-01-30 there were 1500 of 3.14", "version 2.0.1", "", "no digits here", "The GPL, version 3."):
        assert pii.find_spans(clean, model) == ([], [])


def test_best_cut_by_trying_all(crf):
    model = pickle.loads(crf)
    text = "x +1 (301) 555-0346 12 7"
    region = pii.regions(text)[0]
    rows = model._scored(text, region)

    def cuts(n):
        if n == 0:
            yield []
        for k in range(1, min(pii.MAX_TOKENS, n) + 1):
            for head in cuts(n - k):
                for y in range(5):
                    if rows[n - 1][k - 1][1][y] > -np.inf:
                        yield [*head, (n - 1, k, y)]

    def score(c):
        return sum(rows[j][k - 1][1][y] for j, k, y in c) + sum(model.trans[a[2]][b[2]] for a, b in zip(c, c[1:]))

    every = list(cuts(len(region)))
    best = max(every, key=score)
    want = [(y - 1, region[j - k + 1][0], region[j][1]) for j, k, y in best if y]
    assert model.decode(text, region, 0.0) == want
    _, _, z = model._forward_backward(rows)
    assert z == pytest.approx(np.log(sum(np.exp(score(c)) for c in every)))


def test_gradient_by_finite_differences():
    """Of the log-likelihood by weights and by transitions, at random weights."""
    draw = random.Random(4)
    text = "x +1 (301) 555-0346 12 a@b.co 7"
    region = max(pii.regions(text), key=len)
    gold = pii._gold(text, region, pii.base_spans(text))
    assert {y for _, _, y in gold} >= {0, 1, 4}
    m = pii.SemiMarkov()
    for row in m._scored(text, region):
        for fs, _ in row:
            for f in fs:
                m.w.setdefault(f, [draw.gauss(0, 0.5) for _ in range(5)])
    m.trans = [[draw.gauss(0, 0.5) for _ in range(5)] for _ in range(5)]
    _, grads, pairs = m.gradient(text, region, gold)
    eps = 1e-5

    def slope(at, y):
        was = at[y]
        at[y] = was + eps
        high = m.gradient(text, region, gold)[0]
        at[y] = was - eps
        low = m.gradient(text, region, gold)[0]
        at[y] = was
        return (high - low) / (2 * eps)

    for x in range(5):
        for y in range(5):
            assert pairs[x][y] == pytest.approx(slope(m.trans[x], y), abs=1e-5)
    for f in draw.sample(sorted(m.w), 12):
        for y in range(5):
            assert grads.get(f, [0.0] * 5)[y] == pytest.approx(slope(m.w[f], y), abs=1e-5)


def test_transitions_are_learned(crf):
    model = pickle.loads(crf)
    assert any(abs(v) > 0.01 for row in model.trans for v in row) and any(v < 0 for row in model.trans for v in row)


def test_overlaps_by_trying_all():
    draw = random.Random(9)
    for _ in range(300):
        spans = [(0, a, a + draw.randint(1, 30)) for a in (draw.randrange(100) for _ in range(draw.randint(0, 30)))]
        taken = pii._Taken(spans)
        for _ in range(20):
            a = draw.randrange(110)
            b = a + draw.randint(1, 10)
            assert taken.meets(a, b) == any(s < b and a < e for _, s, e in spans)


def test_pii_frames(spark, crf):
    d = spark.createDataFrame([(1, "mail a@b.co", 11), (1, "mail a@b.co", 11), (None, None, None), (2, "", 0)], "doc_id long, text string, n_chars long").withColumn("spans", F.lit(1))
    rows = pii.private_spans(d, crf).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.spans) for r in rows) == [(0, 0, ""), (1, 1, "email:5:11"), (1, 1, "email:5:11"), (2, 0, "")]
    out = pii.redacted(d, crf)
    assert out.columns == d.columns and {(r.text, r.n_chars) for r in out.collect()} == {("mail <EMAIL>", 12), (None, None), ("", 0)}
    none = d.filter(F.lit(False))
    assert pii.private_spans(none, pii.fit(none)).count() == 0


# --- language ---------------------------------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(d, language.fit(d)).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_forward_backward_by_enumeration():
    draw = np.random.default_rng(1)
    lengths = np.array([3, 1, 4])
    s, t = draw.normal(size=(8, 3)), draw.normal(size=(3, 3))
    p, joint, _ = language.forward_backward(s, lengths, t, True)
    import itertools

    total = np.zeros((3, 3))
    for lo, n in zip([0, 3, 4], lengths):
        seqs = list(itertools.product(range(3), repeat=n))
        w = np.array([np.exp(sum(s[lo + k, y] for k, y in enumerate(q)) + sum(t[a, b] for a, b in zip(q, q[1:]))) for q in seqs])
        w /= w.sum()
        for k in range(n):
            for y in range(3):
                assert p[lo + k, y] == pytest.approx(sum(x for x, q in zip(w, seqs) if q[k] == y))
        for x, q in zip(w, seqs):
            for a, b in zip(q, q[1:]):
                total[a, b] += x
    assert joint == pytest.approx(total)


def test_language_edge_cases(spark):
    d = spark.createDataFrame([(1, "der die und", "de"), (3, "the and of", "en"), (4, None, "en"), (5, "123 ! ² Ⅷ", None), (None, "the of", None), (6, "", "en")], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    m = language.fit(d)
    got = {r.doc_id: r for r in language.identify(d, m).collect()}
    assert got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == "und" and got[4].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 6
    kept = language.known_language(d, m)
    assert kept.columns == d.columns and kept.filter("doc_id IN (4, 5, 6)").count() == 0
    none = d.filter(F.lit(False))
    assert language.identify(none, language.fit(none)).count() == 0 and language.identify(d, language.fit(none)).filter("lang_pred = 'und'").count() == 6


# --- quality ------------------------------------------------------------------------------------------------------------


def test_quality_of_held_out_documents(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score(d, quality.fit(d, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_ftrl_learns_what_it_is_shown():
    rows = [("good words here", 1), ("bad bad bad!!", 0)] * 40
    w = quality.train(rows)
    f = quality.Features()
    s = lambda t: w[-1] + w[f.ids(t)].sum() / np.sqrt(max(1, len(f.ids(t))))
    assert s("good words here") > 0 > s("bad bad bad!!")


def plain_ftrl(rows, epochs=3, seed=7, alpha=0.3, beta=1.0, l1=0.02, l2=0.1):
    """Follow-the-regularised-leader, coordinate by coordinate, as published, in dictionaries and plain numbers."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * l1) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def plain_features(text):
    """{coordinate: value}, by the description: words and neighbours hashed, repetitions, 1 / sqrt(number) each."""
    words = re.findall(r"\w+|[^\w\s]+", text)
    h, m = [zlib.crc32(w.encode()) for w in words], (1 << 64) - 1
    pairs = [((a * 0x9E3779B97F4A7C15 & m) ^ (b * 0xC2B2AE3D27D4EB4F & m)) >> 40 for a, b in zip(h, h[1:])]
    ids = [x % quality.BUCKETS for x in h + pairs]
    ids += [quality.TWICE] * sum(a == b for a, b in zip(h, h[1:])) + [quality.AGAIN] * sum(a == b for a, b in zip(h, h[2:])) + [quality.HAD] * (len(pairs) - len(set(pairs)))
    return {i: ids.count(i) / math.sqrt(len(ids)) for i in set(ids)} | {quality.BUCKETS: 1.0}


def test_training_and_scores_against_plain_python(spark):
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["the", "The", "a", "buy", "!!", "now", "élan", "x1", "."]) for _ in range(draw.randint(0, 30))) for _ in range(60)]
    rows = [(t, int("buy" in t)) for t in texts]
    w = quality.train(rows)
    want = plain_ftrl([(plain_features(t), y) for t, y in rows])
    assert np.count_nonzero(w) == sum(v != 0 for v in want.values()) > 10
    assert all(w[i] == pytest.approx(v, rel=1e-5, abs=1e-7) for i, v in want.items())
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.score(d, w).collect():
        p = 1 / (1 + math.exp(-sum(want.get(i, 0.0) * v for i, v in plain_features(texts[r.doc_id]).items())))
        assert r.score == pytest.approx(p, rel=1e-5) and r.predicted == int(r.score >= 0.5)


def test_labels_that_disagree_and_ids_that_repeat(spark):
    """The greatest label of an id counts, and the least text; 300 copies of a row weigh as much as one."""
    rows = [(i, f"good words number {i}" if i % 2 else f"bad bad stuff {i} !!") for i in range(0, 60)]
    labels = [(i, i % 2) for i, _ in rows]
    once = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    more = spark.createDataFrame(rows + [rows[1]] * 300 + [(rows[3][0], "zzz")], "doc_id long, text string")
    twice = quality.fit(more, spark.createDataFrame(labels * 3 + [(1, 0), (999, 1), (5, None)], "doc_id long, quality int"))
    assert once.any() and np.array_equal(once, twice)
    assert not quality.fit(more, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")).any()


def test_quality_edge_cases(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None), (None, ""), (1, "a b")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(1, None, 0), (2, 1, 0), (None, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.filter(F.lit(False))):
        rows = quality.score(d, quality.fit(d, lab)).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.score(d.filter(F.lit(False)), quality.fit(d, labels)).count() == 0


# --- samples to learn from ------------------------------------------------------------------------------------------------


def test_shares_of_huge_tables_do_not_round_to_nothing():
    for n in (10, 8_000, 200_000_000, 5_000_000_000, 10**13):
        share = common.hash_bound(200, n) / common.LAST_HASH
        assert share == 1.0 if n < 200 else share * n > 200
        assert 0 < common.hash_bound(200, n) <= common.LAST_HASH
    assert common.hash_bound(200, 5_000_000_000) * 5_000_000_000 / common.LAST_HASH == pytest.approx(1.3 * 200 + 10 * 200**0.5 + 20, rel=1e-6)


def test_samples_are_bounded_and_count_copies_once(spark):
    many = spark.range(20_000).selectExpr("concat('t', id) AS t", "CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END AS g")
    d = many.unionByName(spark.range(20_000).selectExpr("'copy' AS t", "'a' AS g")).unionByName(spark.createDataFrame([("only", "c")], "t string, g string"))
    rows = common.sampled(d, 50, "t", 1, "g").collect()
    assert {g: sum(r.g == g for r in rows) for g in "abc"} == {"a": 50, "b": 50, "c": 1} and len({r.t for r in rows}) == 101
    assert common.sampled(d, 50, "t", 1).count() == 50 and common.sampled(d, 10**6, "t", 1).count() == 20_002
    assert common.sampled(d.filter(F.lit(False)), 50, "t", 1).count() == common.sampled(d.filter(F.lit(False)), 50, "t", 1, "g").count() == 0
    assert [len(b) for b in common.within_chars(iter([pd.DataFrame({"x": ["abcd", "e"]}), pd.DataFrame({"x": ["fg", "h"]})]), "x", 6)] == [2, 0]
    assert [len(b) for b in common.within_chars(iter([pd.DataFrame({"x": ["abcdefgh", "e"]})]), "x", 6)] == [1]


def test_an_empty_sample_of_rows_raises(spark, monkeypatch):
    d = spark.createDataFrame([(1, "der die und", "de"), (2, "the and 1 of", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    monkeypatch.setattr(common, "hash_bound", lambda rows, n: 0)
    for learn in (lambda: language.fit(d), lambda: pii.fit(d)):
        with pytest.raises(ValueError, match="sample"):
            learn()
    with pytest.raises(ValueError, match="sample"):
        quality.fit(d, labels)


# --- decontamination ------------------------------------------------------------------------------------------------------


def brute_hits(text, items, size=10):
    words = decontaminate.words_of((text or "").encode())
    hit, ids = set(), set()
    for item, t in items:
        own = decontaminate.words_of((t or "").encode())
        for w in decontaminate.windows_of(own, size):
            for p in range(len(words) - len(w) + 1):
                if tuple(words[p : p + len(w)]) == w:
                    hit.update(range(p, p + len(w)))
                    ids.add("" if item is None else str(item))
    return len(words), len(hit), ",".join(sorted(ids))


@pytest.mark.parametrize("broadcast, bits, piece", [(16 << 20, 1 << 28, 256), (0, 64, 3), (0, 1 << 28, 1)])
def test_windows_by_brute_force(spark, monkeypatch, broadcast, bits, piece):
    """Also with salted joins, with a bit table that lets everything through, and with stretches cut to pieces."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    draw = random.Random(2)
    text = lambda n: " ".join(draw.choice(["Ab", "b", "c,", "é", "d-d", "1"]) for _ in range(n))
    items = [(1, text(14)), (2, text(3)), (3, ""), (None, text(11)), (4, None), (1, text(10)), (10, text(12)), (11, text(6)), (12, "zz b zz b zz b zz b zz b zz b zz b"), (13, "only")]
    texts = [text(draw.randint(0, 40)) for _ in range(40)] + [None, "", f"x {items[0][1]} y", items[6][1] * 2, f"{items[3][1]} {items[6][1]} only", "zz b " * 40, text(400), "only"]
    d = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])] + [(None, texts[42])] * 3, "doc_id long, text string").withColumns({"n_hit": F.lit("x"), "_h1": F.lit(1), "_row": F.lit(2)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit(0))
    rows = decontaminate.contamination(d, b).collect()
    assert len(rows) == len(texts) + 4
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(texts[42 if r.doc_id is None else r.doc_id], items)
        assert r.contaminated == (r.n_hit > 0) and r.n_items == len({x for x in r["items"].split(",")} if r["items"] or r.n_hit else ())
    clean = decontaminate.clean_documents(d, b)
    assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in rows if not r.contaminated)
    none = b.filter(F.lit(False))
    assert decontaminate.contamination(d, none).filter("contaminated").count() == 0 and decontaminate.contamination(d.filter(F.lit(False)), b).count() == 0
    assert decontaminate.clean_documents(d, none).count() == d.count() and decontaminate.clean_documents(d.filter(F.lit(False)), b).count() == 0


def test_long_words_are_read_as_a_whole():
    features = lambda w: set(language.hashed_features([w])[0].tolist())
    a, b = "x" * 20 + "kolmar" * 9 + "y" * 20, "x" * 20 + "tavini" * 9 + "y" * 20
    assert features(a) - features("x" * 20 + "y" * 20) and features(a) != features(b)
    words = ["a", "ab", "abc", "Straße", "漢字", a, "abcde"]
    flat, sizes = language.hashed_features(words)
    assert sizes.tolist() == [9 + max(0, n - 1) + max(0, n - 2) for n in (len(w.encode()) for w in words)]
    ends = np.cumsum(sizes)
    for w, lo, hi in zip(words, ends - sizes, ends):
        assert np.array_equal(flat[lo:hi], language.hashed_features([w])[0])
    shared = features("abcde") & features("xbcdy")
    assert len(shared) == 3  # bc, cd, bcd


def test_marks_belong_to_their_letters():
    assert language.words_of("हिन्दी भाषा 12 é x²y_z") == ["हिन्दी", "भाषा", "é", "x²y", "z"]
    assert language.words_of("der_die 1und ab2cd") == ["der", "die", "und", "ab", "cd"] == language.words_of("der_die 1und ab2cd \u2019")


def test_lines_in_groups_give_what_they_give_together(monkeypatch):
    rows = [("der hund und die katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr")] * 5
    m = language.Model(["de", "en", "fr"], *language.train(rows, ["de", "en", "fr"]))
    texts = ["der hund\nthe dog\nle chat et le chien", None, "", "die katze " * 50, "²", "the cat\n" * 30]
    want = m.predict(texts)
    m.at_once = 3
    monkeypatch.setattr(language, "MEMO_BYTES", 10)
    got = m.predict(texts)
    assert [x[0] for x in got] == [x[0] for x in want] and [x[1] for x in got] == pytest.approx([x[1] for x in want])
    assert m.knows(texts, 0.6) == [True, False, False, True, False, True]


def test_more_languages_than_two_hundred(spark):
    rows = [(i, f"wort{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]} " * 6, f"l{i:03d}") for i in range(300)]
    d = spark.createDataFrame([(10_000 + 7 * k + i * 100, t, x) for i, t, x in rows for k in range(6)], "doc_id long, text string, lang string")
    labels = pickle.loads(language.fit(d))[0]
    assert len(labels) == d.filter(common.fold("doc_id", 4) != 2).select("lang").distinct().count() > 250
