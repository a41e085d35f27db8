"""Null, empty, very long, tied and repeated rows, empty tables, and columns whose names clash."""

import pytest

import corpus_pipeline
from karyospark.llm import bpe, decontaminate, html_text, langid, licenses, quality_model, quality_rules, secrets, simhash, token_counts
from karyospark.llm.common import checkpoint
from karyospark.llm.token_counts import vocabulary

NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = {c: "x" for c in ("row", "key", "nid", "root", "v0", "i0", "base", "h", "at", "words", "spans", "key_id", "key_text", "x", "score", "label", "x_", "ids", "decoded", "host", "path", "item_id", "html", "node", "best", "kept_id", "__key_id", "__key_text", "__kept_id", "__kept_text", "__spans", "__span_id", "its_id", "extra_0", "sketch", "keys")}
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 6000
ROWS = [
    (None, None, None, None, None),
    (None, "no id here but words", "en", "s1", 5),
    (1, "", "en", "s1", 0),
    (1, "", "en", "s1", 0),
    (2, "one", None, None, 3),
    (3, "The same words in a row and again the same words in a row.", "en", "s2", 3),
    (4, "The same words in a row and again the same words in a row.", "en", "s3", 3),
    (5, "!!! ... \x00\x1c   \U0001f600", "fr", "s2", 3),
    (6, LONG, "en", "s2", len(LONG)),
    (7, "x" * 50_000, "de", "s2", 50_000),
    (8, "Ünïcödé ßtraße İstanbul ΣΑΣ é", "de", "s2", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, NAMES)
    return rows.withColumns({c: F.lit(v) for c, v in CLASH.items()})


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 3, 4, 5, 6, 7, 8)] + [(None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "The same words in a row and again the same words in a row."), (2, None), (None, "x"), (3, "short")], "item_id bigint, text string")


RUNS = {
    "op1": lambda s, d: simhash.simhash_components(d),
    "op2": lambda s, d: quality_model.with_quality(checkpoint(quality_model.with_statistics(d, "doc_id")), None, "doc_id"),
    "op3": lambda s, d: bpe.encoded(d, vocabulary("word_bpe_49k.json"), "doc_id"),
    "op4": lambda s, d: secrets.judged(d),
    "op5": lambda s, d: langid.with_language(d, langid.learn(d), "doc_id"),
    "op6": lambda s, d: licenses.licensed(d, "doc_id"),
    "op7": lambda s, d: token_counts.with_token_counts(d, vocabulary("byte_bpe_50k.json"), "doc_id"),
    "op9": lambda s, d: quality_rules.apply_policy(quality_rules.ledger(d)),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_one_row_for_each_document(spark, docs, name):
    got = RUNS[name](spark, docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert RUNS[name](spark, docs.limit(0)).count() == 0


def test_repeated_and_empty_rows(spark, docs):
    got = [r for r in simhash.simhash_components(docs).collect()]
    empty = [r for r in got if r["doc_id"] == 1]
    assert {r["fingerprint"] for r in empty} == {"0" * 16} and {r["component_id"] for r in empty} == {1}
    assert [r["component_id"] for r in got if r["doc_id"] == 4] == [3]
    rules = {r["doc_id"]: r for r in quality_rules.ledger(docs).collect()}
    assert rules[1]["n_words"] == 0 and rules[6]["n_repeat_words"] == 60_000
    lang = {r["doc_id"]: r for r in RUNS["op5"](spark, docs).collect()}
    assert lang[1]["lang_pred"] == "und" and lang[5]["lang_pred"] == "und" and lang[1]["score"] == 0


def test_quality_model_of_few_rows(spark, docs):
    rows = checkpoint(quality_model.with_statistics(docs, "doc_id"))
    model = quality_model.fit(quality_model.training_rows(rows, labels(spark)))
    got = quality_model.with_quality(rows, model, "doc_id").collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_model.fit(quality_model.training_rows(rows, labels(spark).limit(0))) is None


def test_leaks(spark, docs):
    got = decontaminate.leaks(docs, benchmark(spark), "doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == [3, 4] and {r["item_id"] for r in got} == {1}
    assert decontaminate.leaks(docs.limit(0), benchmark(spark), "doc_id").count() == 0
    assert decontaminate.leaks(docs, benchmark(spark).limit(0), "doc_id").count() == 0
    kept = decontaminate.keep_clean(docs, benchmark(spark))
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2


def test_pages(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, None), (2, "", ""), (None, "http://h.org/a", "<p>text"), (3, "no url", "<b>bold"), (3, "no url", "<b>bold"), (4, "http://h.org/b", "<p>" + "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "its_path", "text", "votes")})
    got = html_text.extracted(pages, "page_id", "url").collect()
    assert len(got) == len(rows)
    assert {(r["page_id"], r["text"][:5]) for r in got} == {(1, ""), (2, ""), (None, "text"), (3, "bold"), (4, "long ")}
    assert html_text.extracted(pages.limit(0), "page_id").count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_keeps_columns(spark, docs, tmp_path, empty):
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = docs.limit(0) if empty else docs
    names = rows.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = checkpoint(stage(spark, rows, str(tmp_path)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert rows.columns == names
    kept = rows.collect()
    assert not empty or not kept
    if not empty:
        assert 6 in [r["doc_id"] for r in kept] and 1 not in [r["doc_id"] for r in kept]
