import corpus_pipeline

from fernweave.llm import bpe, decontaminate, pii
from fernweave.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {w for _, t in items for w in decontaminate.windows_of(decontaminate.words_of(t), 10)}
    lengths = {len(w) for w in windows}

    def hit(words):
        return any(tuple(words[i : i + n]) in windows for n in lengths for i in range(len(words) - n + 1))

    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(path := str(tmp_path / name))
        out = spark.read.parquet(path)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        ids, old = {r.doc_id for r in out.select("doc_id").collect()}, {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        assert ids <= set(old)
        if name == "language_id":
            assert ids == {i for i, t in old.items() if any(c.isalpha() for c in t or "")}
        if name == "decontamination":
            assert ids == {i for i, t in old.items() if not hit(decontaminate.words_of(t.encode()))}
        if name == "personal_data":
            rows = out.collect()
            assert ids == set(old) and all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in rows)
        if name == "token_ids":
            codec = bpe.Codec(bpe.read_file(spark, tokenizer_path("byte_bpe_50k.tiktoken")))
            assert {r.doc_id: (r.n_tokens, r.ids) for r in out.collect()} == {i: (len(x), list(x)) for i, x in ((i, codec.encode(t)) for i, t in old.items())}
        before = out


def test_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(3)).unionByName(docs.limit(1).selectExpr("CAST(NULL AS long) AS doc_id", "CAST(NULL AS string) AS text", "CAST(NULL AS string) AS lang", "CAST(NULL AS string) AS source", "CAST(NULL AS long) AS n_chars"))
    for d in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, d, SF).count()


def test_further_columns_with_clashing_names(spark):
    """Stages keep columns that are named as the operators' own, and their order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    more = docs.selectExpr("1 AS _row", "2 AS _th", "*", "3 AS _id", "4 AS _h1", "5 AS class_id", "6 AS _doc", "7 AS ids", "8 AS _text", "9 AS `a.b`")
    for name, stage in corpus_pipeline.STAGES:
        want, got = stage(spark, docs, SF), stage(spark, more, SF)
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in want.select("doc_id").collect())
        if name != "token_ids":
            assert got.columns == more.columns and got.selectExpr("sum(_row + _th + _id + _h1 + class_id + _doc + ids + _text + `a.b`)").first()[0] == 45 * got.count()


def test_texts_in_many_known_languages_stay_and_unknown_ones_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    parts = {r.lang: r.text for r in docs.groupBy("lang").agg({"text": "max"}).withColumnRenamed("max(text)", "text").collect()}
    mixed = "\n".join(" ".join(t.split()[:60]) for t in parts.values())
    odd = docs.limit(1).selectExpr("-1L AS doc_id", f"'{mixed.replace(chr(39), ' ')}' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    cyrillic = odd.selectExpr("-2L AS doc_id", "'Это русский текст, которого модель не знает' AS text", "lang", "source", "n_chars")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(odd).unionByName(cyrillic), SF).select("doc_id").collect()}
    assert len(parts) >= 4 and -1 in kept and -2 not in kept and len(kept) == docs.count() + 1


def test_run_leaves_one_table_behind(spark, tmp_path):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} == set(out.columns) and out.filter("size(ids) <> n_tokens").count() == 0
    left = set(os.listdir(folder)) - before
    assert len(left) <= 4, left
