"""The pipeline's stages on a small table, one by one and together."""

import corpus_pipeline
from helpers import documents

HEX40 = "0123456789abcdef0123456789abcdef01234567"


def test_stages(spark, tmp_path):
    clean = [" ".join(f"c{i}_{j}" for j in range(40)) for i in range(20)]
    item = " ".join(f"q{j}" for j in range(15))
    rows = [(i, t, f"s{i}") for i, t in enumerate(clean)]
    rows += [(100, clean[3], "z"), (101, clean[4] + " more", "z"), (102, "well " + item.upper() + " end", "z"),
             (103, f"my token = {HEX40}", "z"), (104, "you stupid idiot, worthless scum and moron you are", "z"),
             (105, "", "z"), (106, None, "z"), (None, clean[5] + " some other words at the end of it all here", "z")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs, columns, left = spark.read.parquet(str(tmp_path / "documents.parquet")), None, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = columns or docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs = docs.checkpoint()
        left[name] = sorted((r.doc_id is not None, r.doc_id) for r in docs.collect())
    ids = {k: [d for _, d in v] for k, v in left.items()}
    assert ids["toxicity"] == [None, *range(20), 100, 101, 102, 103, 105, 106]
    assert ids["ngram_jaccard_join"] == [None, *range(20), 102, 103, 105, 106]
    assert ids["benchmark_decontamination"] == [None, *range(20), 103, 105, 106]
    assert ids["secret_scan"] == ids["benchmark_decontamination"]
    assert docs.where("doc_id = 103").first().text == "my [SECRET]"

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lang", "source"]
    assert sorted((r.doc_id is not None, r.doc_id) for r in whole.collect()) == left["secret_scan"]


def test_rows_of_one_doc_id_with_unlike_texts_stay(spark):
    words = [" ".join(f"w{i}_{j}" for j in range(30)) for i in range(4)]
    rows = [(5, words[0], "a"), (5, words[1], "a"), (5, words[1], "b"), (5, words[0] + " x", "a"), (3, words[2], "a"),
            (7, words[2], "a"), (5, words[2] + " y", "a"), (8, "", "a"), (8, None, "a"), (9, "", "a"), (9, "", "a"),
            (None, words[3], "a"), (None, words[3], "a")]
    got = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "").collect()
    left = sorted((r.doc_id or 0, r.text or "", r.source) for r in got)
    one = [t for t in left if t[1] in (words[0], words[0] + " x")]
    assert len(one) == 1   # a component of two texts of one id: one of them
    assert sorted(set(left) - set(one)) == sorted([(5, words[1], "a"), (3, words[2], "a"), (8, "", "a"), (9, "", "a"),
                                                   (0, words[3], "a")])
    assert len(left) == 7   # both rows without an id


def test_pipeline_of_an_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
