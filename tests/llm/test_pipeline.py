from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairlab.llm import langid

from .conftest import TABLES, WORDS
from .test_repeats import classes, kept_words
from .test_tokens import check_packing


def written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


@pytest.mark.parametrize("table", ["documents", "odd", "none"])
def test_stages_against_brute_force(spark, request, tmp_path, table):
    docs = written(request.getfixturevalue(table), tmp_path / "0")
    columns = docs.columns

    judged = written(corpus_pipeline.known_language(spark, docs, TABLES), tmp_path / "1")
    assert judged.columns == columns
    net = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))), "text", "lang", F.col("doc_id"))
    if net is not None:
        says = langid.identify(docs.select("text").distinct().select(F.col("text").alias("t"), "text"), "t", "text", net).collect()
        good = {r["t"] for r in says if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
        assert Counter(map(str, judged.collect())) == Counter(str(r) for r in docs.collect() if r["text"] in good)

    one = written(corpus_pipeline.one_of_near_duplicates(spark, judged, TABLES), tmp_path / "2")
    assert one.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in judged.collect()]
    want = {k[2] for k in classes(rows, 5, (75, 100))}
    kept = one.collect()
    assert len(kept) == sum(1 for _ in {r for r in want}) or table == "odd"
    assert Counter(map(str, kept)) - Counter(map(str, judged.collect())) == Counter()
    again = classes([(i, r["text"]) for i, r in enumerate(kept)], 5, (75, 100))
    assert all(c == 1 for c in Counter(k[2] for k in again).values())
    if table == "documents":
        assert {r["doc_id"] for r in kept} == want

    less = written(corpus_pipeline.without_repeats(spark, one, TABLES), tmp_path / "3")
    assert less.columns == columns
    expected = kept_words([(r["doc_id"], r["text"]) for r in kept], 35)
    assert Counter((k, t) for k, _, _, t in expected.elements()) == Counter((r["doc_id"], r["text"]) for r in less.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in less.collect())

    out = corpus_pipeline.packed(spark, less, TABLES).collect()
    if out:
        used, least = check_packing(less.collect(), out, 4096)
        assert used == least


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, TABLES)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert out.count() > 100
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    assert WORDS.findall("a\tb c") == ["a", "b", "c"]
