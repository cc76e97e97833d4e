"""Nulls, repeated rows, very long texts and columns of clashing names, for every operator and stage."""

import public_tokenizers
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, decontaminate, language_id, line_dedup, ngram_join, quality, queries, substring_dedup, token_counts, url_filter, warc

CLASHING = (
    "gone", "of_doc", "lines", "bad_id", "bad_text", "removed", "kept", "kept_text", "n_words", "text_hash", "node", "component", "component_id", "digest", "content",
    "n_tokens", "accepted", "score", "lang_pred", "start", "hash", "class", "low", "host", "path", "rule", "verdict", "payload", "_text", "_words", "_made", "tile", "size", "key",
)
LONG = "A plain sentence about the river and the town beside it.\n" * 3_000


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, LONG), (1, LONG), (2, None), (None, LONG), (None, None), (3, ""), (4, " \n\n "), (5, "Another sentence that stands in one text only."), (6, "x"), (7, "a" * 50_000)]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", *(F.lit("own").alias(c) for c in CLASHING)).cache()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, f"{DATA}/sf0.001")
    rows = out.collect()
    if name != "bpe":
        assert out.columns == docs.columns
        assert all(r[c] == "own" for r in rows for c in CLASHING)
    if name == "line_dedup":
        kept = [r.text for r in rows if r.doc_id == 1]
        assert len(kept) == 2 and all(t.strip() == LONG.split("\n")[0] for t in kept)


def test_operators_on_documents(spark, docs, tmp_path):
    word_bpe = str(public_tokenizers.path(queries.WORD_BPE))
    n = docs.count()
    items = spark.createDataFrame([(1, None), (None, "one two"), (2, "")], "item_id long, text string")
    assert token_counts.token_counts(docs, word_bpe, str(tmp_path)).count() == n
    assert bpe.encode_digests(docs, word_bpe).count() == n
    assert decontaminate.contamination(docs, items).filter("contaminated").count() == 0
    assert decontaminate.without_contaminated(docs, items).count() == n
    assert quality.measured(docs).count() == n
    assert quality.cleaned(docs).columns == docs.columns
    assert language_id.identify(docs, language_id.fit(docs)).filter("accepted").count() == 0
    assert ngram_join.near_duplicates(docs, ngram_join.Similarity(3, 90)).count() == n
    assert line_dedup.line_classes(docs).filter("doc_id = 5 and not kept").count() == 0
    spans = substring_dedup.repeated_spans(docs)
    assert spans.count() == n
    assert substring_dedup.deduplicated(docs, spans).columns == docs.columns


def test_operators_on_pages(spark):
    rows = [(1, None, None), (None, "http://a.net/es/", "<p>"), (2, "http://a.net/x", "<p>"), (3, "", ""), (None, None, None), (2, "http://a.net/x", "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit("own").alias(c) for c in CLASHING))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == [(0, "response", None), (0, "response", None), (1, "revisit", 3), (2, "response", None), (2, "response", None), (3, "response", None)]
    judged = url_filter.judge(pages, url_filter.parsed_rules(queries.URL_RULES)).collect()
    assert len(judged) == len(rows) and {r.verdict for r in judged} == {"allow", "block"}


def test_windows_above_the_bytes_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "see one two three there"), (2, "none"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "ONE two... three")], "item_id long, text string")
    kept = [tuple(r) for r in decontaminate.contamination(docs, items).orderBy("doc_id").collect()]
    monkeypatch.setattr(decontaminate, "MOST_WINDOW_BYTES", 10)
    assert not decontaminate.may_broadcast(decontaminate.item_windows(items))
    assert [tuple(r) for r in decontaminate.contamination(docs, items).orderBy("doc_id").collect()] == kept
