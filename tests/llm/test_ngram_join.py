"""The similarity join against brute force."""

import random
import re

import numpy as np
import pytest

from millrace.llm import components, hashing, ngram_join

SCHEMA = "doc_id long, text string"


def shingle_sets(rows, size):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        out.append((doc_id, frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()))
    return out


def brute_force(rows, how):
    sets = shingle_sets(rows, how.words)
    group = {d: d for d, _ in sets}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(x & y)
            if x and common and 100 * common >= how.percent * (len(x) + len(y) - common):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    return {d: (len(s), group[d]) for d, s in sets}


def corpus(seed, sizes):
    """Families of near copies from lightly to heavily changed, a hot family among them, and small texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5)))
    rows = []
    for family in range(25):
        base = [word() for _ in range(rng.choice(sizes))]
        for _ in range(60 if family == 0 else rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                at = rng.randrange(len(text) + 1)
                text[at : at + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize(("words", "percent", "sizes"), [(3, 90, (8, 12, 20, 60, 150)), (5, 80, (6, 9, 15, 30, 60, 120)), (2, 70, (4, 10, 40, 90)), (2, 50, (5, 12, 30))])
def test_components_equal_brute_force(spark, words, percent, sizes):
    how = ngram_join.Similarity(words, percent)
    rows = corpus(words, sizes)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA), how).collect()}
    assert got == brute_force(rows, how)


@pytest.mark.parametrize("percent", [50, 60, 70, 74, 80, 90, 95])
def test_nested_sets_at_the_threshold_share_a_tile(percent):
    rng = np.random.default_rng(percent)
    for _ in range(200):
        n = int(rng.integers(2, 400))
        whole = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        part = np.sort(rng.choice(whole, -(-len(whole) * percent // 100), replace=False))
        if len(part) < len(whole):
            assert set(ngram_join.tiles(whole, percent)) & set(ngram_join.tiles(part, percent))


def test_similarities_that_are_none_are_refused():
    for percent in (0, 101):
        with pytest.raises(ValueError, match="similarity"):
            ngram_join.bands(percent)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, " \t"), (3, "one two"), (4, "ONE\ntwo"), (5, text), (6, text + " more"), (7, text), (7, text), (None, text), (8, "x " * 60_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", node int")
    got = [(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs, ngram_join.Similarity(3, 90)).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 5), (7, 5), (7, 5), (None, None), (8, 8)], key=str)
    assert ngram_join.near_duplicates(docs.limit(0), ngram_join.Similarity(3, 90)).count() == 0


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(1)
    for n in (20, 300, 5_000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)]))
        x, y = (np.frombuffer(ngram_join.signature(m), np.uint64) for m in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_blocks_find_what_a_large_tile_holds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    how = ngram_join.Similarity(3, 90)
    rows = corpus(11, (60, 90))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA), how).collect()}
    assert got == brute_force(rows, how)


def test_word_hashes_do_not_depend_on_the_pieces(monkeypatch):
    text = ("ab Cde\tfgh\n" * 500 + "x" * 300 + " yz").encode()
    whole = hashing.words(text)
    monkeypatch.setattr(hashing, "_PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, hashing.words(text), strict=True))


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
