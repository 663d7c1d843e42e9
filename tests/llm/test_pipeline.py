"""The pipeline's stages one by one against brute force, and its whole run."""

import numpy as np
import public_tokenizers

import corpus_pipeline
from churnkit.llm import quality
from tests.conftest import SF
from tests.llm import test_packing, test_simhash, test_suffix
from tests.llm.helpers import DOCS


def test_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = documents.columns, spark.read.parquet(f"{SF}/labels.parquet")
    predicted = {r.doc_id: r.predicted for r in quality.classify(documents, labels).collect()}
    (_, first), (_, second), (_, third), (_, fourth) = corpus_pipeline.STAGES

    good = first(spark, documents, SF)
    rows = [tuple(r) for r in good.collect()]
    assert good.columns == columns and sorted(rows) == sorted(tuple(r) for r in documents.collect() if predicted[r.doc_id] == 1)
    assert 0 < len(rows) < len(predicted)

    docs = spark.createDataFrame(rows, documents.schema)
    single = second(spark, docs, SF)
    kept = {i for i, _, c in test_simhash.brute([r[:2] for r in rows]) if i == c}
    rows = [tuple(r) for r in single.collect()]
    assert single.columns == columns and {r[0] for r in rows} == kept and len(rows) == len(kept) < docs.count()

    docs = spark.createDataFrame(rows, documents.schema)
    cut = third(spark, docs, SF)
    assert cut.columns == columns and cut.dtypes == documents.dtypes
    removed = {i: n for i, _, n, _, _ in test_suffix.brute([r[:2] for r in rows])}
    text = {r[0]: r[1] for r in rows}
    out = [tuple(r) for r in cut.collect()]
    assert len(out) == len(rows) and sum(removed.values()) > 0
    for i, t, _, _, n in out:
        assert n == len(t) and (t == text[i]) == (removed[i] == 0)
        assert 0 <= len(t.encode()) - (len(text[i].encode()) - removed[i]) <= 6 * text[i].count(" ") + 6

    pieces = [{k: v for k, v in r.asDict().items() if k != "ids_crc32"} for r in fourth(spark, spark.createDataFrame(out, documents.schema), SF).collect()]
    test_packing.check(pieces, {r[0]: test_packing.whole(r[1]) for r in out}, 4096)

    run = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    assert {p["doc_id"] for p in run} == {p["doc_id"] for p in pieces} and sum(p["length"] for p in run) == sum(p["length"] for p in pieces)


def test_odd_tables(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "no id", "en", "s", 5), (3, "twice the same", "en", "s", 14), (3, "twice the same", "en", "s", 14)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/b/documents.parquet")
    for name in "ab":
        spark.createDataFrame([(3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "None"]  # 1 and 2 are empty alike
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_clashing_columns_long_texts_and_ties(spark):
    said = " ".join(f"w{k % 977}x{k % 31}" for k in range(20_000))
    rows = [(1, said), (2, said), (2, "quite another text, kept"), (5, "one text here"), (5, "and a second one"), (5, "one text here"), (None, "no id at all"), (None, "no id at all"),
            (None, "something else without an id"), (9, "no id at all")]
    clash = ["kept_id", "kept_h", "kept_rows", "kept_lot", "cut_id", "cut_hash", "cut_spans", "__d", "__spans", "fp", "root", "h", "component_id"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).selectExpr("*", *[f"'x' AS {c}" for c in clash])
    _, second, third, fourth = (f for _, f in corpus_pipeline.STAGES)
    once = second(spark, docs, SF)
    assert once.columns == docs.columns
    # every different text stays once, with the least id it has
    assert sorted(map(str, ((r.doc_id, r.text) for r in once.collect()))) == sorted(map(str, {(1, said), (2, rows[2][1]), (5, rows[3][1]), (5, rows[4][1]), (None, rows[8][1]), (9, rows[9][1])}))
    again = spark.createDataFrame(once.collect(), docs.schema)
    cut = third(spark, again, SF)
    assert cut.columns == docs.columns and cut.count() == 6 and all(r.n_chars == len(r.text) and r.cut_spans == "x" for r in cut.collect())
    assert fourth(spark, cut, SF).agg({"length": "sum"}).first()[0] > 0


def test_tokenizer_file_is_a_parameter():
    assert np.all([public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_50k.json")])
