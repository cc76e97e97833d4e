"""BPE and token counts against the tokenizer's library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe, token_counts

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id long, text string"
LIBRARY = Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(4)
    pool = "aabbcdetthhiinngerro ..!'sS éñßÜ 12\n\tΣσ漢字İ"
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return [*made, "a" * 3_000, "don't <|endoftext|><|ENDOFTEXT|> x<|startoftext|>", "e\u0301 \u00a0 x\u2003y", "", "  ", "😀😀 🇩🇪"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts(), None])], SCHEMA + ", n_tokens int")


def test_ids_and_text_equal_the_library(spark, docs):
    want = {}
    for i, t in enumerate([*texts(), ""]):
        ids = LIBRARY.encode(t, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False)))
    assert {r[0]: tuple(r[1:]) for r in bpe.encode_digests(docs, PATH).collect()} == want


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert bpe.encode_digests(none, PATH).count() == 0 and bpe.decode(bpe.encode(none, PATH), PATH).count() == 0


def test_round_trip(spark, docs):
    encoded = bpe.encode(docs, PATH)
    decoded = {r.doc_id: r.text for r in bpe.decode(encoded, PATH).collect()}
    for r in encoded.collect():
        assert decoded[r.doc_id] == LIBRARY.decode(r.ids, skip_special_tokens=False)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORD_BYTES", 2_000)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIR_BYTES", 400)
    own = bpe.WordBPE(bpe.vocabulary(PATH))
    assert all(own.encode(t) == LIBRARY.encode(t, add_special_tokens=False).ids for t in texts()[:60])


def test_every_code_point_equals_the_library():
    own = bpe.WordBPE(bpe.vocabulary(PATH))
    # all planes with letters, marks or tags; of the unassigned and private ones some
    points = [c for c in (*range(0x34000), *range(0x34000, 0x110000, 89), *range(0xE0000, 0xE0200)) if not 0xD800 <= c <= 0xDFFF]
    rows = [" ".join(f"a{chr(c)}b {chr(c)}1" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    for at in range(0, len(rows), 2_000):
        part = rows[at : at + 2_000]
        for text, found in zip(part, LIBRARY.encode_batch(part, add_special_tokens=False), strict=True):
            assert own.encode(text) == found.ids, f"{text[1]!r}"


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORD_BYTES", 100_000)
    own = bpe.WordBPE(bpe.vocabulary(PATH))
    for k in range(2_000):
        own.encode(f"w{'x' * (k % 80)}{chr(97 + k % 26)}{'yz' * (k % 7)}")
        assert sum(bpe.sys.getsizeof(x) for k in (own._known, own._older) for w, e in k.items() for x in (w, *e)) <= 100_000
    assert all(len(w) <= bpe.REMEMBERED_SYMBOLS for w in own._known)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, docs, tmp_path, name):
    path = str(public_tokenizers.path(name))
    if name.endswith(".json"):
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path, str(tmp_path)).collect()}
    assert got == {i: (len(t.encode()), count(t)) for i, t in enumerate([*texts(), ""])}


def test_only_misses_are_encoded(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b "), (3, "c")], SCHEMA)
    cache = lambda: spark.read.parquet(str(tmp_path)).count()
    token_counts.token_counts(rows, PATH, str(tmp_path)).collect()
    assert cache() == 2  # the blank at the end counts for nothing
    more = rows.union(spark.createDataFrame([(4, "d e f")], SCHEMA))
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(more, PATH, str(tmp_path)).collect()} == {1: 2, 2: 2, 3: 1, 4: 3}
    assert cache() == 3
    assert token_counts.token_counts(rows.limit(0), PATH, str(tmp_path)).count() == 0


def test_a_text_that_was_counted_twice_gives_one_row(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, "c d e")], SCHEMA)
    token_counts.token_counts(rows, PATH, str(tmp_path)).collect()
    folder = next(tmp_path.iterdir())
    spark.read.parquet(str(folder)).write.mode("append").parquet(str(folder))  # as another writer would have
    assert sorted(map(tuple, token_counts.token_counts(rows, PATH, str(tmp_path)).collect())) == [(1, 3, 2), (2, 5, 3)]
