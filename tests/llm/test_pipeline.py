"""The pipeline's stages on rows made by hand, and the registered queries' contracts."""

import hashlib

import public_tokenizers
import pytest
from conftest import DATA
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    assert corpus_pipeline.encode(spark, docs.limit(0), f"{DATA}/sf0.001").count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{DATA}/sf0.001")
        assert out.columns == docs.columns, name
        assert 0.8 * docs.count() < out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), f"{DATA}/sf0.001").count() == 0


def test_decisions_take_effect(spark):
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    item = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet").first()["text"]
    texts = [base[0], base[0] + "\nsomething else here", base[1].replace("b30", "changed"), base[1], base[2] + " " + item, "...", None, "Plain text that stays."]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {name: stage(spark, docs, f"{DATA}/sf0.001") for name, stage in corpus_pipeline.STAGES}
    ids = lambda name: sorted(r.doc_id for r in got[name].select("doc_id").collect())
    assert ids("language_id") == [0, 1, 2, 3, 4, 7]
    assert {r.doc_id: r.text for r in got["line_dedup"].collect()}[1] == "something else here"
    assert ids("ngram_join") == [0, 2, 4, 5, 6, 7]
    assert ids("decontaminate") == [0, 1, 2, 3, 5, 6, 7]
    assert ids("bpe") == list(range(8))


def test_texts_that_share_a_doc_id(spark):
    base = " ".join(f"a{i}" for i in range(60))
    rows = [(1, f"{base}\nfirst line\nown line"), (5, f"{base}\nfirst line\nanother line"), (5, "unrelated text\nof two\nlines here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in near.collect()) == sorted([rows[0], rows[2]])
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == sorted([rows[0], (5, "another line"), rows[2]])


def test_run(spark):
    assert corpus_pipeline.run(spark, f"{DATA}/sf0.001").count() > 150


def test_run_end_to_end(spark, tmp_path):
    """Planted cases among the documents: what goes is gone, and what stays is encoded as the library does."""
    base = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    known = {r.text for r in base.collect()}
    other = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").filter("lang = 'en' and length(text) > 2500").orderBy("doc_id").collect()
    prose = [" ".join(r.text.split()[:150]) for r in other if r.text not in known][:6]
    item = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet").filter("length(text) > 80").first()["text"]
    words = prose[0].split()
    planted = {
        10_001: prose[0], 10_002: " ".join([*words[:70], "anotherword", *words[71:]]), 10_003: prose[1], 10_004: f"{prose[2]}\n{prose[1]}",
        10_005: "1234 5678 !", 10_006: f"{prose[3]} {item}", 10_007: None, 10_008: f"{prose[4]}\nChapter 1 of the book\n{prose[5][:400]}", 10_009: "",
    }
    rows = spark.createDataFrame([(i, t, None, "planted", len(t or "")) for i, t in planted.items()], base.schema)
    for name, table in (("documents", base.union(rows)), ("benchmark", spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet"))):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(planted) & set(got) == {10_001, 10_003, 10_004, 10_008}
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for i, text in {10_001: prose[0], 10_003: prose[1], 10_004: prose[2], 10_008: planted[10_008]}.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    clean = [r.doc_id for r in base.collect() if r.doc_id in got]
    assert len(clean) > 150


@pytest.mark.parametrize("name", [q for q in entry.queries() if q.startswith("op")])
def test_queries_run_on_whole_tables(spark, name):
    table = "pages" if name.startswith(("op3_", "op9_")) else "documents"
    found = entry.queries()[name](spark, f"{DATA}/sf0.001")
    rows = spark.read.parquet(f"{DATA}/sf0.001/{table}.parquet").count()
    if name.startswith("op10_"):
        assert found.count() == rows and 0 < found.filter("n_removed > 0").count() < rows
    elif name.startswith("op12_"):
        assert found.groupBy("lang").count().filter("count > 2000").isEmpty()
    elif name.startswith("op13_"):
        assert found.count() == 32 * spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").count()
    else:
        assert found.count() >= rows
